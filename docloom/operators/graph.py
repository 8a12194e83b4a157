"""The reference graph: explicit references of documents, digests, profiles and the bounded walk."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.errors import EngineError

_REFERENCE = re.compile(r"([A-Z][A-Za-z]*)/([A-Za-z0-9.-]{1,64})(?:/_history/([A-Za-z0-9.-]{1,64}))?")
EDGE_KEY = ["source_type", "source_id", "json_path", "target_type", "target_id"]
#: Walk limits (fixed values): depth, targets, edges, roots.
MAX_DEPTH, MAX_TARGETS, MAX_EDGES, MAX_ROOTS = 4, 128, 512, 100
# fmt: off
#: Edges that the profiles admit (fixed values): source type, pointer, target types.
MICRO_PROFILE = [
    ("DiagnosticReport", r"^/result/\d+/reference$", "Observation"),
    ("DiagnosticReport", r"^/specimen/\d+/reference$", "Specimen"),
    ("Observation", r"^/hasMember/\d+/reference$", "Observation"),
    ("Observation", r"^/specimen/reference$", "Specimen"),
]
CLINICAL_PROFILE = [
    ("DiagnosticReport", r"^/result/\d+/reference$", "Observation"),
    ("DiagnosticReport", r"^/specimen/\d+/reference$", "Specimen"),
    ("Observation", r"^/hasMember/\d+/reference$", "Observation"),
    ("Observation", r"^/specimen/reference$", "Specimen"),
    ("Condition", r"^/encounter/reference$", "Encounter"),
    ("Condition", r"^/subject/reference$", "Patient"),
    ("DiagnosticReport", r"^/encounter/reference$", "Encounter"),
    ("DiagnosticReport", r"^/subject/reference$", "Patient"),
    ("Encounter", r"^/diagnosis/\d+/condition/reference$", "Condition"),
    ("Encounter", r"^/partOf/reference$", "Encounter"),
    ("Encounter", r"^/reasonReference/\d+/reference$", "Condition"),
    ("Encounter", r"^/subject/reference$", "Patient"),
    ("MedicationRequest", r"^/encounter/reference$", "Encounter"),
    ("MedicationRequest", r"^/medicationReference/reference$", "Medication"),
    ("MedicationRequest", r"^/reasonReference/\d+/reference$", "Condition"),
    ("MedicationRequest", r"^/subject/reference$", "Patient"),
    ("Observation", r"^/encounter/reference$", "Encounter"),
    ("Observation", r"^/subject/reference$", "Patient"),
    ("Procedure", r"^/encounter/reference$", "Encounter"),
    ("Procedure", r"^/report/\d+/reference$", "DiagnosticReport", "DocumentReference"),
    ("Procedure", r"^/subject/reference$", "Patient"),
    ("ServiceRequest", r"^/encounter/reference$", "Encounter"),
    ("ServiceRequest", r"^/specimen/\d+/reference$", "Specimen"),
    ("ServiceRequest", r"^/subject/reference$", "Patient"),
    ("Specimen", r"^/parent/\d+/reference$", "Specimen"),
    ("Specimen", r"^/request/\d+/reference$", "ServiceRequest"),
    ("Specimen", r"^/subject/reference$", "Patient"),
]
# fmt: on


def references(value: object, pointer: str = "") -> Iterator[tuple[str, str, str, str | None]]:
    """(pointer, type, id, version) of every relative reference below a JSON value."""
    if isinstance(value, dict):
        for key, child in value.items():
            at = f"{pointer}/{key.replace('~', '~0').replace('/', '~1')}"
            if key == "reference" and isinstance(child, str):
                m = _REFERENCE.fullmatch(child)
                if m:
                    yield at, m[1], m[2], m[3]
            yield from references(child, at)
    elif isinstance(value, list):
        for k, child in enumerate(value):
            yield from references(child, f"{pointer}/{k}")


def extract_edges(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """source_type, source_id, json_path, target_type, target_id, target_version of documents (type, id, raw JSON)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(t, i, *edge) for t, i, text in zip(part["type"], part["id"], part["raw"], strict=True) if text for edge in references(json.loads(text))]
            yield pd.DataFrame(out, columns=["source_type", "source_id", "json_path", "target_type", "target_id", "target_version"])

    schema = "source_type string, source_id string, json_path string, target_type string, target_id string, target_version string"
    return documents.select("type", F.col("id").cast("string").alias("id"), F.col(raw).alias("raw")).mapInPandas(work, schema)


def edge_digests(edges: DataFrame) -> DataFrame:
    """source_type, source_id, edge_count, digest: SHA-256 of the source's edges in order, with their versions and kind
    where the edges have such columns."""
    extra = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_version", "target_version", "edge_kind") if c in edges.columns]
    line = F.concat_ws("|", "json_path", "target_type", "target_id", *extra)
    return edges.groupBy("source_type", "source_id").agg(F.count("*").alias("edge_count"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("digest"))


def compare_projection(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """source_type, source_id, status: equal, changed, missing or unexpected, of edge_digests."""
    key = ["source_type", "source_id"]
    both = stored.select(*key, F.col("digest").alias("__s")).join(fresh.select(*key, F.col("digest").alias("__f")), key, "full")
    status = F.when(F.col("__s").isNull(), "missing").when(F.col("__f").isNull(), "unexpected").when(F.col("__s") == F.col("__f"), "equal").otherwise("changed")
    return both.select(*key, status.alias("status"))


def allowed_edges(edges: DataFrame, profile: list[tuple[str, str, str]]) -> DataFrame:
    rule = F.lit(False)
    for source, pointer, *targets in profile:
        rule = rule | ((F.col("source_type") == source) & F.col("json_path").rlike(pointer) & F.col("target_type").isin(*targets))
    return edges.filter(rule)


def replaced_edges(stored: DataFrame, sources: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edge table after the sources' edges were replaced by fresh ones, and the heads (edge_digests) of these sources.
    A source without edges loses its old ones and has a head of no edges."""
    key = ["source_type", "source_id"]
    named = sources.select(*key).distinct()
    edges = stored.join(named, key, "left_anti").unionByName(fresh.join(named, key, "left_semi"))
    heads = named.join(edge_digests(fresh), key, "left")
    return edges, heads.select(*key, F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))


def citations(roots: DataFrame, edges: DataFrame, targets: DataFrame | None = None, profile: list[tuple[str, ...]] | None = None, depth: int = MAX_DEPTH, max_targets: int = MAX_TARGETS, max_edges: int = MAX_EDGES) -> tuple[DataFrame, dict[str, int]]:
    """root, depth, source, json_path, target_type, target_id, target_version, status of each edge that a bounded walk from
    roots (type, id) follows, and the walk's counts.

    status: resolved, missing (not among targets (type, id)), already-present (resolved at a smaller depth) or target-limit.
    Edges are charged in total order before any filter. One edge more than the budget is read, so that a truncated page is
    known. Budgets bound every step, so the frontier that joins the edge table is small."""
    if not 1 <= depth <= MAX_DEPTH or not 1 <= max_targets <= MAX_TARGETS or not 1 <= max_edges <= MAX_EDGES:
        raise EngineError("WALK_BOUNDS_INVALID", "walk limits out of range")
    spark = roots.sparkSession
    start = [(r["type"], r["id"]) for r in roots.select("type", F.col("id").cast("string").alias("id")).distinct().orderBy("type", "id").limit(MAX_ROOTS + 1).collect()]
    if len(start) > MAX_ROOTS:
        raise EngineError("WALK_BOUNDS_INVALID", f"more than {MAX_ROOTS} roots")
    frontier = {key: f"{key[0]}/{key[1]}" for key in start}
    stats = {"considered_edges": 0, "read_truncated": 0, "already_present": 0, "target_limit": 0, "missing": 0}
    resolved, scheduled, out = set(), set(), []
    fields = [c for c in ("target_version",) if c in edges.columns]
    for level in range(1, depth + 1):
        remaining = max_edges - stats["considered_edges"]
        if not frontier or remaining <= 0:
            break
        keys = spark.createDataFrame(sorted(frontier), "source_type string, source_id string")
        page = [r.asDict() for r in edges.join(keys, ["source_type", "source_id"], "left_semi").orderBy(*EDGE_KEY).limit(remaining + 1).collect()]
        stats["read_truncated"] |= int(len(page) > remaining)
        page = page[:remaining]
        stats["considered_edges"] += len(page)
        fit = [e for e in page if profile is None or any(e["source_type"] == s and re.search(p, e["json_path"]) and e["target_type"] in t for s, p, *t in profile)]
        pending = []
        for e in fit:
            target = (e["target_type"], e["target_id"], *[e[f] for f in fields])
            if target in resolved:
                status = "already-present"
                stats["already_present"] += 1
            elif target not in scheduled and len(scheduled) >= max_targets:
                status = "target-limit"
                stats["target_limit"] += 1
            else:
                scheduled.add(target)
                status = "resolved"
            pending.append((e, target, status))
        wanted = sorted({t[:2] for _, t, s in pending if s == "resolved"})
        if targets is not None and wanted:
            asked = spark.createDataFrame(wanted, "type string, id string")
            there = {(r["type"], r["id"]) for r in targets.select("type", F.col("id").cast("string").alias("id")).join(asked, ["type", "id"], "left_semi").distinct().collect()}
        else:
            there = set(wanted)
        following = {}
        for e, target, status in pending:
            source = (e["source_type"], e["source_id"])
            if status == "resolved" and target[:2] not in there:
                status = "missing"
                stats["missing"] += 1
            out.append((frontier[source], level, f"{source[0]}/{source[1]}", e["json_path"], target[0], target[1], e.get("target_version"), status))
            if status == "resolved":
                resolved.add(target)
                following.setdefault(target[:2], frontier[source])
        frontier = {k: v for k, v in following.items() if k not in start}
    schema = "root string, depth int, source string, json_path string, target_type string, target_id string, target_version string, status string"
    return spark.createDataFrame(out, schema), stats


def walk(roots: DataFrame, edges: DataFrame, profile: list[tuple[str, ...]] | None = None, depth: int = MAX_DEPTH, max_targets: int = MAX_TARGETS, max_edges: int = MAX_EDGES) -> DataFrame:
    """target_type, target_id, depth, via (source and pointer) of what roots (type, id) reach, each at its smallest depth."""
    found, _ = citations(roots, edges, None, profile, depth, max_targets, max_edges)
    reached = found.filter("status = 'resolved'").groupBy("target_type", "target_id").agg(F.min(F.struct("depth", F.concat_ws("#", "source", "json_path").alias("via"))).alias("r"))
    return reached.select("target_type", "target_id", "r.depth", "r.via")
