"""The versioned document store as DataFrame transformations: heads, history, conflicts, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["practice_id", "id"]


def valid_content(content: Column, kind: Column, key: Column) -> Column:
    """Content is an object whose resourceType and id equal the row's."""
    return F.coalesce((F.try_variant_get(content, "$.resourceType", "string") == kind) & (F.try_variant_get(content, "$.id", "string") == key), F.lit(False))


def heads(history: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest version of each key, by an aggregate (partial before the shuffle) and not a window."""
    rest = [c for c in history.columns if c not in [*key, version]]
    latest = history.groupBy(*key).agg(F.max(version).alias(version), F.max_by(F.struct(*rest), version).alias("__r"))
    return latest.select(*key, version, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: list[str] = KEY) -> DataFrame:
    return incoming.dropDuplicates(key).join(current, key, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str] = KEY, order: str | None = None) -> DataFrame:
    """current with incoming rows in place of those of equal key. Of several incoming rows of one key the one of the largest
    `order` stands, or without it the one of the largest hash, so that the result doesn't depend on partitions."""
    rest = [c for c in incoming.columns if c not in key]
    rank = F.col(order) if order else F.xxhash64(F.to_json(F.struct(*incoming.columns)))
    single = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(*key, *[F.col(f"__r.`{c}`").alias(c) for c in rest])
    return current.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(single.select(*current.columns))


def created(current: DataFrame, incoming: DataFrame, content_hash: Column, now: Column, key: list[str] = KEY) -> dict[str, DataFrame]:
    """First versions of incoming resources (key, type, content, raw): outcome (key, outcome), and the rows for resources,
    history and write_inputs, which a caller publishes together.

    outcome: created, INVALID_INPUT (the content's type or id differs, or the key repeats) or ALREADY_EXISTS."""
    marked = incoming.join(current.select(*key).withColumn("__old", F.lit(True)), key, "left").join(incoming.groupBy(*key).agg(F.count("*").alias("__n")), key)
    fits = valid_content(F.col("content"), F.col("type"), F.col("id").cast("string")) & (F.col("__n") == 1)
    outcome = F.when(~fits, "INVALID_INPUT").when(F.col("__old"), "ALREADY_EXISTS").otherwise("created")
    marked = marked.withColumn("outcome", outcome)
    new = marked.filter("outcome = 'created'").withColumn("version_id", F.lit(1).cast("long")).withColumn("last_updated", now)
    return {
        "outcome": marked.select(*key, "outcome"),
        "resources": new.select(*key, "type", "version_id", "last_updated", "content"),
        "history": new.select(*key, "type", "version_id", "last_updated", "content", content_hash.alias("content_hash")),
        "write_inputs": new.select(*key, F.col("raw").alias("raw_payload")),
    }


def committed(current: DataFrame, incoming: DataFrame, content_hash: Column, now: Column, key: list[str] = KEY) -> dict[str, DataFrame]:
    """Next versions of resources: outcome, the new history rows, and all heads after it.

    incoming: key, expected_version (null: any), content, raw. A stale or invalid update writes nothing."""
    decided = update(current, incoming.join(current.select(*key, "type", F.col("version_id").alias("__head")), key, "left").withColumn("expected_version", F.coalesce("expected_version", "__head")).drop("__head"), key)
    fits = valid_content(F.col("content"), F.col("type"), F.col("id").cast("string"))
    decided = decided.withColumn("outcome", F.when((F.col("outcome") == "updated") & ~fits, "INVALID_INPUT").otherwise(F.col("outcome")))
    new = decided.filter("outcome = 'updated'").select(*key, "type", F.col("new_version").alias("version_id"), now.alias("last_updated"), "content", content_hash.alias("content_hash"))
    return {
        "outcome": decided.select(*key, "outcome", F.when(F.col("outcome") == "updated", F.col("new_version")).alias("version_id")),
        "history": new,
        "resources": upsert(current, new.drop("content_hash").select(*current.columns), key, "version_id"),
    }


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n of each table."""
    return reduce(DataFrame.unionAll, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()])


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of which one side has more, with both counts; none where the sides are equal as bags. Nulls equal nulls."""
    names = left.columns
    both = left.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(right.withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1)))
    return both.groupBy(*names).agg(F.sum("__l").alias("n_left"), F.sum("__r").alias("n_right")).filter("n_left <> n_right")


def update(current: DataFrame, incoming: DataFrame, key: list[str] = KEY) -> DataFrame:
    """incoming (key, expected_version, ...) with outcome: updated, VERSION_CONFLICT or NOT_FOUND, and new_version.
    Of several updates of one key only the first expected version can match."""
    order = Window.partitionBy(*key).orderBy("expected_version")
    numbered = incoming.withColumn("__n", F.row_number().over(order))
    joined = numbered.join(current.select(*key, F.col("version_id").alias("__v")), key, "left")
    outcome = F.when(F.col("__v").isNull(), "NOT_FOUND").when((F.col("__v") == F.col("expected_version")) & (F.col("__n") == 1), "updated").otherwise("VERSION_CONFLICT")
    return joined.withColumn("outcome", outcome).withColumn("new_version", F.when(F.col("outcome") == "updated", F.col("__v") + 1)).drop("__n", "__v")


def dump_digest(frame: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """One row: number of rows and a digest that does not depend on their order, so no sort and no single task:
    the sum of 60-bit pieces of each row's SHA-256, and the digest of the sums."""
    columns = sorted(c for c in frame.columns if c not in (exclude or []))
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    pieces = [F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = frame.select(*[p.alias(f"p{k}") for k, p in enumerate(pieces)]).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", "s0", "s1", "s2", "s3"), 256).alias("digest"))
