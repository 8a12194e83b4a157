"""Weighted rendezvous sharding with DataFrame functions only.

Every shard k gives a record the score -ln(u) / weight, u in (0, 1) from a hash of the record's key and k; the
smallest score wins (ties: the smaller shard). A further shard can only take records for itself. Null keys hash as
one key. A null text counts no bytes and has the checksum of the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import prepare

#: Rows that one task numbers together, on average.
BLOCK_ROWS = 1000


def score(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def best_shard(key: Column, weights: list[float]) -> Column:
    scored = [F.struct(score(key, k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights)]
    return scored[0]["shard"] if len(scored) == 1 else F.least(*scored)["shard"]


def sharded(docs: DataFrame, weights: list[float] | int = 40, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (with one more shard)."""
    prepare(docs.sparkSession)
    weights = [1.0] * weights if isinstance(weights, int) else list(weights)
    key = F.col("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = light.withColumn("shard", best_shard(key, weights)).withColumn("grown_shard", best_shard(key, [*weights, grown_weight]))
    # Slots: rows are numbered inside blocks of a shard, and a block starts after the rows of the blocks before it.
    blocks = max(1, -(-docs.count() // (BLOCK_ROWS * len(weights))))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(3)), F.lit(blocks)))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("inner", F.row_number().over(inside) - F.lit(1))
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    slotted = numbered.join(offsets, ["shard", "block"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("inner") + F.col("before")).cast("long").alias("slot"), "grown_shard")
