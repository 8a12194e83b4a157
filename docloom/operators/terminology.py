"""Closed value sets and membership of codes in a terminology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Required value sets (fixed values).
REQUIRED = {
    "Patient.gender": ("male", "female", "other", "unknown"),
    "Encounter.status": ("planned", "arrived", "triaged", "in-progress", "onleave", "finished", "cancelled", "entered-in-error", "unknown"),
    "Condition.clinicalStatus": ("active", "recurrence", "relapse", "inactive", "remission", "resolved"),
    "Condition.verificationStatus": ("unconfirmed", "provisional", "differential", "confirmed", "refuted", "entered-in-error"),
    "Observation.status": ("registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown"),
    "MedicationRequest.status": ("active", "on-hold", "cancelled", "completed", "entered-in-error", "stopped", "draft", "unknown"),
    "MedicationRequest.intent": ("proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option"),
    "AllergyIntolerance.clinicalStatus": ("active", "inactive", "resolved"),
    "Procedure.status": ("preparation", "in-progress", "not-done", "on-hold", "stopped", "completed", "entered-in-error", "unknown"),
    "DocumentReference.status": ("current", "superseded", "entered-in-error"),
    "Consent.status": ("draft", "proposed", "active", "rejected", "inactive", "entered-in-error"),
}


def in_required(binding: str, code: Column) -> Column:
    return F.coalesce(code.isin(*REQUIRED[binding]), F.lit(False))


def checked_codes(codes: DataFrame, concepts: DataFrame) -> DataFrame:
    """codes (system, code, ...) with known, display and an issue for unknown ones; concepts hold one row a code."""
    return codes.join(concepts.select("system", "code", "display"), ["system", "code"], "left").withColumn("known", F.col("display").isNotNull()).withColumn("issue", F.when(F.col("display").isNull(), "unknown-code"))


def codings(documents: DataFrame, keep: tuple[str, ...] = ("id",), content: str = "content", depth: int = 12) -> DataFrame:
    """keep, pointer, system, code of every object that has both as strings, wherever it stands.

    Each level of the documents is one generator over the level above, in the JVM; `depth` levels are looked at and deeper
    content fails, so nothing is left out silently."""
    level = documents.select(*keep, F.lit("").alias("pointer"), F.col(content).alias("node"))
    found: list[DataFrame] = []
    for _ in range(depth):
        text = [F.when(F.schema_of_variant(F.try_variant_get("node", f"$.{n}", "variant")) == "STRING", F.try_variant_get("node", f"$.{n}", "string")) for n in ("system", "code")]
        found.append(level.select(*keep, "pointer", text[0].alias("system"), text[1].alias("code")).filter("system is not null and code is not null"))
        members = F.transform(F.map_entries(F.try_variant_get("node", "$", "map<string,variant>")), lambda e: F.struct(F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")).alias("k"), e["value"].alias("v")))
        elements = F.transform(F.try_variant_get("node", "$", "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("k"), v.alias("v")))
        children = F.explode(F.filter(F.coalesce(members, elements), lambda e: F.to_json(e["v"]).rlike(r"^[\[{]")))
        level = level.select(*keep, "pointer", children.alias("e")).select(*keep, F.concat_ws("/", "pointer", "e.k").alias("pointer"), F.col("e.v").alias("node"))
    deeper = level.select(*keep, F.raise_error(F.lit("CODINGS_TOO_DEEP")).cast("string").alias("pointer"), F.lit("").alias("system"), F.lit("").alias("code"))
    return reduce(DataFrame.unionAll, [*found, deeper])


def validated(codes: DataFrame, concepts: DataFrame, formats: dict[str, Column], versions: dict[str, str]) -> DataFrame:
    """codes (system, code, ...) with result, issue and pack version, in the shape of a validate-code answer. formats give
    for a system whether a code is well formed; a system without concepts and format is unknown."""
    checked = checked_codes(codes, concepts).drop("issue")
    systems = concepts.select("system").distinct().withColumn("__pack", F.lit(True))
    formed = F.lit(None).cast("boolean")
    for system, rule in formats.items():
        formed = F.when(F.col("system") == system, rule).otherwise(formed)
    version = F.lit(None).cast("string")
    for system, value in versions.items():
        version = F.when(F.col("system") == system, value).otherwise(version)
    seen = checked.join(systems, "system", "left").withColumn("__formed", formed)
    issue = F.when(F.col("__formed") == F.lit(False), "code-format").when(F.col("__pack").isNotNull() & ~F.col("known"), "unknown-code").when(F.col("__pack").isNull() & F.col("__formed").isNull(), "unknown-system")
    return seen.withColumn("issue", issue).withColumn("result", F.col("issue").isNull()).withColumn("version", version).drop("__pack", "__formed", "known")
