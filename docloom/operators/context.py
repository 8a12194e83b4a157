"""Cited context: declared leaves of documents, edge-weighted order, serialised text and its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Declared leaves (fixed values): type -> dotted paths.
LEAVES = {
    "Patient": ["name.0.family", "name.0.given.0", "birthDate"],
    "Encounter": ["class.code", "period.start", "period.end", "status"],
    "Condition": ["code.coding.0.display", "code.coding.0.code", "code.text", "clinicalStatus.coding.0.code", "onsetDateTime", "note.0.text"],
    "Observation": ["code.coding.0.display", "valueQuantity.value", "valueQuantity.unit", "valueString", "note.0.text", "effectiveDateTime"],
    "MedicationRequest": ["medicationCodeableConcept.coding.0.display", "status", "authoredOn"],
    "AllergyIntolerance": ["code.coding.0.display", "clinicalStatus.coding.0.code", "recordedDate"],
    "Procedure": ["code.coding.0.display", "performedDateTime", "status"],
    "DocumentReference": ["type.coding.0.display", "content.0.attachment.title", "date", "status"],
}


def leaf(content: Column, path: str) -> Column:
    """The JSON text of a scalar leaf; null where the path does not end at a scalar."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.split("."))
    text = F.to_json(F.try_variant_get(content, "$" + steps, "variant"))
    return F.when(~text.rlike(r"^[\{\[]") & (text != "null"), text)


def spans(documents: DataFrame, leaves: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep columns, place, json_path, value (JSON text) of the declared leaves that resolve."""
    leaves = leaves or LEAVES
    entries: Column | None = None
    for kind, paths in leaves.items():
        own = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(p).alias("json_path"), leaf(F.col("content"), p).alias("value")) for k, p in enumerate(paths)])
        entries = F.when(F.col("type") == kind, own) if entries is None else entries.when(F.col("type") == kind, own)
    return documents.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.*").filter("value is not null")


def u_shape(frame: DataFrame, rank: str, partition: list[str] | None = None) -> DataFrame:
    """place: odd ranks in order at the front, even ranks reversed at the back."""
    r = F.col(rank)
    total = F.count("*").over(Window.partitionBy(*(partition or [F.lit(0)])))
    return frame.withColumn("place", F.when(r % 2 == 1, (r + 1) / 2).otherwise(total + 1 - r / 2).cast("int"))


def serialised(rows: DataFrame, key: list[str], title: Column, order: str = "place") -> DataFrame:
    """key, text: a title line and one line for each span in order; and the text's digest."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "json_path", "value"))), lambda s: F.concat(F.lit("  "), s["json_path"], F.lit(": "), s["value"]))
    grouped = rows.withColumn("__title", title).groupBy(*key, "__title").agg(lines.alias("__lines"))
    text = F.concat_ws("\n", "__title", "__lines")
    return grouped.select(*key, text.alias("text"), F.sha2(text, 256).alias("digest"))


#: The last line of a context document (fixed value).
ESCAPE_HATCH = "raw FHIR escape hatch: read fhir_resources by (resourceType, id)"


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.to_json(text.cast("variant"))


def document_text(groups: DataFrame, key: list[str], audit_id: Column, excluded: Column | None = None) -> DataFrame:
    """key, text, digest of each context: a header, the types that policy withheld, each resource numbered in order of
    place with its stamp and its spans, and the footer.

    groups: key, place, resource_type, resource_id, last_updated, version_id, spans (array of json_path and value as JSON
    text in order). excluded: an array of resource_type and reason. A context holds one search's results, so its groups
    fit one array."""
    spans = F.transform("spans", lambda s: F.concat(F.lit("  "), s["json_path"], F.lit(": "), s["value"]))
    stamp = F.concat(F.col("resource_type"), F.lit("/"), F.col("resource_id"), F.lit(" @"), F.col("last_updated"), F.lit(" v"), F.col("version_id").cast("string"))
    packed = groups.withColumn("__audit", audit_id).withColumn("__ex", excluded if excluded is not None else F.array().cast("array<struct<resource_type:string,reason:string>>"))
    rows = packed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", stamp.alias("stamp"), spans.alias("lines")))).alias("g"), F.first("__audit").alias("__audit"), F.first("__ex").alias("__ex"))
    body = F.flatten(F.transform("g", lambda g, i: F.concat(F.array(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), g["stamp"])), g["lines"])))
    withheld = F.concat(F.lit("excludedByPolicy: "), F.array_join(F.transform("__ex", lambda e: F.concat(quoted(e["resource_type"]), F.lit("("), quoted(e["reason"]), F.lit(")"))), " "))
    header = F.concat(F.array(F.concat(F.lit("CCP v1 audit="), quoted(F.col("__audit")))), F.when(F.size("__ex") > 0, F.array(withheld)).otherwise(F.array().cast("array<string>")))
    text = F.array_join(F.concat(header, body, F.array(F.lit(ESCAPE_HATCH))), "\n")
    return rows.select(*key, text.alias("text")).withColumn("digest", F.sha2("text", 256))


def guarded(asked: DataFrame, resources: DataFrame, allowed: list[str], key: str = "request") -> DataFrame:
    """key, outcome, n of context requests: the first guard that fails, and for how many of the request's results.

    asked: key, receipt_ok, resource_id, resource_type; resources: id, type of the bound tenant.
    outcome: RECEIPT_MISMATCH, UNRESOLVED_RESULT, TYPE_MISMATCH, SCOPE_EXCLUDED_TYPE or ok."""
    named = asked.select(key, "receipt_ok", "resource_id", "resource_type").distinct()
    joined = named.join(resources.select(F.col("id").alias("resource_id"), F.col("type").alias("__type")), "resource_id", "left")
    missing, wrong, outside = F.col("__type").isNull(), F.col("__type") != F.col("resource_type"), ~F.col("__type").isin(*allowed)
    counts = joined.groupBy(key).agg(F.min("receipt_ok").alias("ok"), *[F.count(F.when(c, 1)).alias(n) for n, c in (("m", missing), ("w", wrong), ("x", outside))])
    outcome = F.when(~F.col("ok"), "RECEIPT_MISMATCH").when(F.col("m") > 0, "UNRESOLVED_RESULT").when(F.col("w") > 0, "TYPE_MISMATCH").when(F.col("x") > 0, "SCOPE_EXCLUDED_TYPE").otherwise("ok")
    n = F.when(~F.col("ok"), 0).when(F.col("m") > 0, F.col("m")).when(F.col("w") > 0, F.col("w")).otherwise(F.col("x"))
    return counts.select(key, outcome.alias("outcome"), n.cast("long").alias("n"))


def token_count(text: Column) -> Column:
    """The default measure: words between blanks."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
