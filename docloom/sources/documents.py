"""Readers of documents, manifests, terminologies and views, and nested documents built from flat tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import EngineError
from docloom.functions.validators import iso_millis, line_feeds
from docloom.plans.views import View, parse_materialisable


def read_ndjson(spark: SparkSession, path: str | list[str], tenant: str | None = None) -> DataFrame:
    """id, type, practice_id, content (variant), raw; blank lines are skipped, line ends normalised."""
    lines = spark.read.text(path).select(F.trim(line_feeds(F.col("value"))).alias("raw")).filter("raw <> ''")
    content = F.parse_json("raw")
    return lines.select(F.try_variant_get(content, "$.id", "string").alias("id"), F.try_variant_get(content, "$.resourceType", "string").alias("type"), F.lit(tenant).alias("practice_id"), content.alias("content"), "raw")


def verify_manifest(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """file, ok: whether each file's sha256 and number of lines equal the manifest's entry."""
    expected = spark.createDataFrame([(f["file"], f["sha256"], f["lines"]) for f in manifest["files"]], "file string, sha256 string, lines long")
    found = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"), F.size(F.filter(F.split(line_feeds(F.col("content").cast("string")), "\n"), lambda x: F.trim(x) != "")).alias("n")
    )
    return expected.join(found, "file", "left").select("file", F.coalesce((F.col("sha256") == F.col("found")) & (F.col("lines") == F.col("n")), F.lit(False)).alias("ok"))


def read_terminology(spark: SparkSession, path: str, system: str) -> DataFrame:
    """system, code, display of a CSV file with a header; the last row of a code stands."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema="code string, display string")
    numbered = rows.filter("code is not null").withColumn("__at", F.monotonically_increasing_id())
    return numbered.groupBy("code").agg(F.max_by("display", "__at").alias("display")).select(F.lit(system).alias("system"), "code", "display")


def read_views(texts: dict[str, str]) -> list[View]:
    """Materialisable views from file names and their JSON, in order of name; names are unique."""
    views = [parse_materialisable(json.loads(texts[name])) for name in sorted(texts)]
    if len({v.name for v in views}) != len(views):
        raise EngineError("VD_NAME_DUPLICATE", "view names must be unique")
    return views


def read_view_rows(spark: SparkSession, views: dict[str, DataFrame], name: str, limit: int = 200) -> DataFrame:
    """The first rows of a whitelisted view in order of key and row index; limits are 1 to 1000."""
    if name not in views:
        raise EngineError("VIEW_UNKNOWN", name)
    if not 1 <= limit <= 1000:
        raise EngineError("LIMIT_INVALID", str(limit))
    return views[name].orderBy("id", "row_index").limit(limit)


def by_ids(frame: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key is among ids; the planner broadcasts the ids where their size allows."""
    return frame.join(ids.select(*columns).distinct(), columns, "left_semi")


def by_id(frame: DataFrame, key: dict[str, object]) -> DataFrame:
    """The one row of a key, with times as UTC text in milliseconds; a typed error if there is none."""
    found = frame
    for column, value in key.items():
        found = found.filter(F.col(column) == F.lit(value))
    if found.limit(1).isEmpty():
        raise EngineError("RESOURCE_NOT_FOUND", "no such resource in this practice")
    return found.select(*[iso_millis(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in frame.schema])


def versions_by_key(current: DataFrame, history: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Asked (key, version_id) rows of the current table where version_id is null or the head's, else of the history."""
    rest = [c for c in history.columns if c in current.columns and c not in [*key, "version_id"]]
    wanted = asked.select(*key, F.col("version_id").alias("__v")).distinct()
    head = current.join(wanted, key).filter(F.col("__v").isNull() | (F.col("__v") == F.col("version_id"))).select(*key, "version_id", *rest)
    old = history.join(wanted.filter("__v is not null").withColumnRenamed("__v", "version_id"), [*key, "version_id"], "left_semi").join(head.select(*key, "version_id"), [*key, "version_id"], "left_anti")
    return head.unionByName(old.select(*key, "version_id", *rest)).dropDuplicates([*key, "version_id"])


def actor_lookup(directory: DataFrame, subject: str) -> DataFrame:
    """actor, tenant, role of a login subject, read before a tenant is bound; an unknown or repeated one has no row."""
    found = directory.filter(F.col("subject") == subject).limit(2)
    return found.withColumn("__n", F.lit(1)).groupBy("subject").agg(F.count("*").alias("n"), F.first("actor").alias("actor"), F.first("tenant").alias("tenant"), F.first("role").alias("role")).filter("n = 1").drop("n")


def read_suite(text: str) -> dict:
    """A conformance file (title, resources, tests) with its shape checked."""
    suite = json.loads(text)
    cases = suite.get("tests") if isinstance(suite, dict) else None
    if not isinstance(cases, list) or not isinstance(suite.get("resources"), list):
        raise EngineError("SUITE_INVALID", "a suite needs resources and tests")
    for case in cases:
        if not isinstance(case, dict) or not isinstance(case.get("view"), dict) or not ({"expect", "expectError", "expectColumns"} & set(case)):
            raise EngineError("SUITE_INVALID", "a case needs a view and an expectation")
    return suite


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str, order: list[str], fields: dict[str, Column], child_fields: dict[str, Column]) -> DataFrame:
    """One struct a parent with its children in order under `name`; shuffles both sides by the key once."""
    ordered = F.struct(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.struct(*[c.alias(n) for n, c in child_fields.items()]).alias("__c"))
    grouped = children.groupBy(F.col(child_key).alias("__key")).agg(F.transform(F.sort_array(F.collect_list(ordered)), lambda s: s["__c"]).alias(name))
    joined = parents.join(grouped, F.col(key) == F.col("__key"), "left")
    return joined.select(F.col(key), F.struct(*[c.alias(n) for n, c in fields.items()], F.col(name)).alias("doc"))


def as_documents(frame: DataFrame, kind: str, doc: str = "doc") -> DataFrame:
    """type and content (variant) of documents given as structs."""
    return frame.select(F.lit(kind).alias("type"), F.to_variant_object(F.col(doc)).alias("content"))
