"""Materialised views: table plans, full rebuild and incremental upsert, which must agree."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.views import View, evaluate_view, parse_materialisable, view_schema

SYSTEM = ("practice_id", "version_id", "last_updated")

#: The shipped views (fixed values): name -> resource and columns (name, path, type) after the key column.
# fmt: off
_SHIPPED = {
    "patient_demographics": (
        "Patient",
        [
            ("gender", "gender", "code"),
            ("birth_date", "birthDate", "date"),
            ("family_name", "name.first().family", "string"),
            ("given_name", "name.first().given.first()", "string"),
            ("identifier_system", "identifier.first().system", "uri"),
            ("identifier_value", "identifier.first().value", "string"),
        ],
    ),
    "observation_summary": (
        "Observation",
        [
            ("status", "status", "code"),
            ("code_system", "code.coding.first().system", "uri"),
            ("code_code", "code.coding.first().code", "code"),
            ("category_code", "category.first().coding.first().code", "code"),
            ("subject_ref", "subject.reference", "string"),
            ("effective_date_time", "effectiveDateTime", "dateTime"),
            ("value_quantity_value", "valueQuantity.value", "decimal"),
            ("value_quantity_unit", "valueQuantity.unit", "string"),
        ],
    ),
    "condition_summary": (
        "Condition",
        [
            ("clinical_status_code", "clinicalStatus.coding.first().code", "code"),
            ("verification_status_code", "verificationStatus.coding.first().code", "code"),
            ("code_system", "code.coding.first().system", "uri"),
            ("code_code", "code.coding.first().code", "code"),
            ("category_code", "category.first().coding.first().code", "code"),
            ("subject_ref", "subject.reference", "string"),
        ],
    ),
    "encounter_summary": (
        "Encounter",
        [
            ("status", "status", "code"),
            ("class_system", "class.system", "uri"),
            ("class_code", "class.code", "code"),
            ("type_system", "type.first().coding.first().system", "uri"),
            ("type_code", "type.first().coding.first().code", "code"),
            ("subject_ref", "subject.reference", "string"),
        ],
    ),
    "procedure_summary": (
        "Procedure",
        [
            ("status", "status", "code"),
            ("code_system", "code.coding.first().system", "uri"),
            ("code_code", "code.coding.first().code", "code"),
            ("subject_ref", "subject.reference", "string"),
            ("performed_date_time", "performedDateTime", "dateTime"),
        ],
    ),
    "medication_request_summary": (
        "MedicationRequest",
        [
            ("status", "status", "code"),
            ("intent", "intent", "code"),
            ("medication_system", "medicationCodeableConcept.coding.first().system", "uri"),
            ("medication_code", "medicationCodeableConcept.coding.first().code", "code"),
            ("subject_ref", "subject.reference", "string"),
            ("requester_ref", "requester.reference", "string"),
            ("authored_on", "authoredOn", "dateTime"),
        ],
    ),
    "allergy_intolerance_summary": (
        "AllergyIntolerance",
        [
            ("clinical_status_code", "clinicalStatus.coding.first().code", "code"),
            ("code_system", "code.coding.first().system", "uri"),
            ("code_code", "code.coding.first().code", "code"),
            ("patient_ref", "patient.reference", "string"),
        ],
    ),
    "document_reference_summary": (
        "DocumentReference",
        [
            ("status", "status", "code"),
            ("type_system", "type.coding.first().system", "uri"),
            ("type_code", "type.coding.first().code", "code"),
            ("category_code", "category.first().coding.first().code", "code"),
            ("subject_ref", "subject.reference", "string"),
            ("doc_date", "date", "instant"),
            ("content_url", "content.first().attachment.url", "url"),
        ],
    ),
}
# fmt: on


def shipped_views() -> dict[str, View]:
    out = {}
    for name, (resource, columns) in _SHIPPED.items():
        declared = [{"name": "id", "path": "getResourceKey()", "type": "id"}, *[{"name": n, "path": p, "type": t} for n, p, t in columns]]
        out[name] = parse_materialisable({"name": name, "resource": resource, "status": "active", "select": [{"column": declared}]})
    return out


def table_plan(view: View) -> tuple[str, T.StructType]:
    system = [T.StructField("practice_id", T.StringType()), T.StructField("row_index", T.IntegerType()), T.StructField("version_id", T.LongType()), T.StructField("last_updated", T.TimestampType())]
    return f"vd_{view.name}", T.StructType([*system, *view_schema(view).fields])


def project(view: View, resources: DataFrame) -> DataFrame:
    rows = evaluate_view(view, resources, keep=SYSTEM, row_index=True)
    return rows.select("practice_id", "row_index", "version_id", "last_updated", *[c.name for c in view.columns])


def key_column(view: View) -> str:
    """The name of the view's key column."""
    return next(c.name for c in view.columns if c.path.replace(" ", "") == "getResourceKey()" and not c.collection)


def rebuild(views: list[View], resources: DataFrame, folder: str) -> dict[str, DataFrame]:
    """All views are planned before the first is written, each is one job over its own resource type, and readers see all
    or none: tables go to a new folder, which one atomic rename of a pointer publishes."""
    spark = resources.sparkSession
    plans = {table_plan(v)[0]: project(v, resources) for v in views}
    build = f"build-{uuid.uuid4().hex}"
    for name, rows in plans.items():
        rows.write.parquet(f"{folder}/{build}/{name}")
    path, files = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(path(folder).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    spark.createDataFrame([(build,)], "build string").coalesce(1).write.text(f"{folder}/{build}/pointer")
    entry = next(f.getPath() for f in context.util().listStatus(path(f"{folder}/{build}/pointer")) if f.getPath().getName().startswith("part-"))
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    options = spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = rename
    context.rename(entry, path(f"{folder}/CURRENT"), options)
    return published(spark, folder, list(plans))


def published(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the last rebuild that was published whole."""
    build = spark.read.text(f"{folder}/CURRENT").first()["value"]
    return {name: spark.read.parquet(f"{folder}/{build}/{name}") for name in names}


def rebuild_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows, n_resources of rebuilt tables."""
    counts = [t.agg(F.count("*").alias("n_rows"), F.countDistinct("practice_id", "id").alias("n_resources")).select(F.lit(n).alias("table"), "n_rows", "n_resources") for n, t in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def upserted(view: View, table: DataFrame, changed: DataFrame) -> DataFrame:
    """The table after the changed resources' rows replaced their old ones."""
    key = key_column(view)
    keys = changed.filter(F.col("type") == view.resource).select("practice_id", F.col("id").alias(key)).distinct()
    return table.join(keys, ["practice_id", key], "left_anti").unionByName(project(view, changed))
