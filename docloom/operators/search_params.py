"""The tall search-parameter index: one row for each token or reference of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.paths import member

#: Search parameters (fixed values): type -> (parameter, kind, path).
PARAMETERS = {
    "Patient": [("identifier", "identifier", "identifier")],
    "Observation": [("subject", "reference", "subject"), ("code", "concept", "code")],
    "Condition": [("subject", "reference", "subject"), ("code", "concept", "code"), ("clinical-status", "concept", "clinicalStatus")],
    "Encounter": [("subject", "reference", "subject")],
    "Procedure": [("subject", "reference", "subject"), ("code", "concept", "code")],
    "MedicationRequest": [("subject", "reference", "subject"), ("code", "concept", "medicationCodeableConcept")],
    "AllergyIntolerance": [("patient", "reference", "patient"), ("code", "concept", "code"), ("clinical-status", "concept", "clinicalStatus")],
    "DocumentReference": [("subject", "reference", "subject"), ("identifier", "identifier", "identifier")],
}

_ENTRY = "array<struct<param_name:string,param_type:string,token_system:string,token_code:string,ref_value:string>>"


def _entries(items: Column, name: str, kind: str) -> Column:
    def get(v: Column, key: str) -> Column:
        found = F.try_variant_get(v, f"$.{key}", "variant")
        return F.when(F.to_json(found).startswith('"'), F.try_variant_get(found, "$", "string"))

    def row(system: Column, code: Column, reference: Column) -> Column:
        return F.struct(F.lit(name).alias("param_name"), F.lit("reference" if kind == "reference" else "token").alias("param_type"), system.alias("token_system"), code.alias("token_code"), reference.alias("ref_value"))

    none = F.lit(None).cast("string")
    if kind == "reference":
        return F.filter(F.transform(items, lambda v: row(none, none, get(v, "reference"))), lambda r: r["ref_value"].isNotNull())
    key = "code" if kind == "concept" else "value"
    tokens = member(items, "coding") if kind == "concept" else items
    return F.filter(F.transform(tokens, lambda v: row(get(v, "system"), get(v, key), none)), lambda r: r["token_code"].isNotNull())


def search_index(documents: DataFrame, keep: tuple[str, ...] = ("practice_id", "id"), parameters: dict | None = None, content: str = "content") -> DataFrame:
    """keep columns, resource_type and the parameter's row; one pass, one generator, no shuffle."""
    parameters = parameters or PARAMETERS
    entries: Column | None = None
    for kind, specs in parameters.items():
        own = F.concat(*[_entries(member(F.array(F.col(content)), path), name, how) for name, how, path in specs]).cast(_ENTRY)
        entries = F.when(F.col("type") == kind, own) if entries is None else entries.when(F.col("type") == kind, own)
    rows = documents.filter(F.col("type").isin(*parameters)).select(*keep, F.col("type").alias("resource_type"), F.explode(entries).alias("e"))
    return rows.select(*keep, "resource_type", "e.*")


def lookup(index: DataFrame, name: str, code: str | None = None, reference: str | None = None) -> DataFrame:
    hit = F.col("token_code") == code if code is not None else F.col("ref_value") == reference
    return index.filter((F.col("param_name") == name) & hit)
