"""The hash-chained audit log: append is a fold in order inside a tenant, verification is parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.canonical import canonical, flat_canonical

GENESIS = "0" * 64
FIELDS = ("actor_id", "decision", "matched_rule_id", "occurred_at", "practice_id", "purpose_of_use", "reason", "resource_type")


def row_hash(prev: Column, columns: tuple[str, ...] = FIELDS) -> Column:
    fields = {c: F.col(c).cast("string") for c in columns} | {"prev_hash": prev, "seq": F.col("seq").cast("string")}
    return F.sha2(flat_canonical(fields), 256)


def appended(rows: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """rows (FIELDS, event_no) with seq, prev_hash and row_hash; tips (practice_id, seq, row_hash) continue chains.

    Each tenant's rows stream through in order of event_no: partitions are sorted, so a task holds one hash a tenant."""
    spark = rows.sparkSession
    tips = tips if tips is not None else spark.createDataFrame([], "practice_id string, seq long, row_hash string")
    started = rows.join(tips.select("practice_id", F.col("seq").alias("__seq"), F.col("row_hash").alias("__hash")), "practice_id", "left")
    ordered = started.repartition("practice_id").sortWithinPartitions("practice_id", "event_no")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, seq, prev = object(), 0, GENESIS
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            out = []
            for row in part.to_dict("records"):
                if row["practice_id"] != tenant:
                    tenant, seq, prev = row["practice_id"], int(row["__seq"] or 0), row["__hash"] or GENESIS
                seq += 1
                fields = {c: row[c] for c in FIELDS} | {"prev_hash": prev, "seq": str(seq)}
                digest = hashlib.sha256(canonical(fields).encode()).hexdigest()
                out.append((*[row[c] for c in FIELDS], row["event_no"], seq, prev, digest))
                prev = digest
            yield pd.DataFrame(out, columns=[*FIELDS, "event_no", "seq", "prev_hash", "row_hash"])

    schema = ", ".join(f"{c} string" for c in FIELDS) + ", event_no long, seq long, prev_hash string, row_hash string"
    return ordered.select(*FIELDS, "event_no", "__seq", "__hash").mapInPandas(fold, schema)


def verified(chain: DataFrame) -> DataFrame:
    """practice_id, n_rows, first_break (position, null if none), kind, of each tenant's chain."""
    order = Window.partitionBy("practice_id").orderBy("seq")
    place = F.row_number().over(order)
    before = F.coalesce(F.lag("row_hash").over(order), F.lit(GENESIS))
    seen = chain.withColumn("__n", place).withColumn("__before", before)
    kind = (
        F.when(F.col("seq") != F.col("__n"), "seq_gap")
        .when(F.col("prev_hash") != F.col("__before"), F.when(F.col("__n") == 1, "genesis_mismatch").otherwise("prev_hash_mismatch"))
        .when(row_hash(F.col("prev_hash")) != F.col("row_hash"), "row_hash_mismatch")
    )
    checked = seen.withColumn("__kind", kind)
    broken = F.when(F.col("__kind").isNotNull(), F.col("__n"))
    return checked.groupBy("practice_id").agg(F.count("*").alias("n_rows"), F.min(broken).cast("long").alias("first_break"), F.min_by("__kind", broken).alias("kind"))
