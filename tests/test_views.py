import json

import pytest
from pyspark.sql import functions as F

from docloom.errors import EngineError
from docloom.operators.materialize import project, shipped_views, table_plan, upserted
from docloom.operators.store import dump_digest
from docloom.plans.views import evaluate_view, parse_materialisable, parse_view, validate_view

PEOPLE = [
    {"resourceType": "Person", "id": "a", "active": True, "score": 3, "name": [{"use": "official", "family": "Ash", "given": ["Ann", "May"]}, {"use": "old", "family": "Elm"}], "link": {"reference": "Org/7/_history/2"}, "valueQuantity": {"value": 1.5}},
    {"resourceType": "Person", "id": "b", "active": False, "score": 12, "name": [], "part": [{"n": 1, "part": [{"n": 2}, {"n": 3, "part": [{"n": 4}]}]}, {"n": 5}]},
    {"resourceType": "Person", "id": "c"},
]
ID = {"name": "id", "path": "getResourceKey()"}


@pytest.fixture(scope="module")
def people(spark):
    rows = [(p["resourceType"], json.dumps(p)) for p in PEOPLE]
    return spark.createDataFrame(rows, "type string, raw string").select("type", F.parse_json("raw").alias("content"))


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def view(select, **more):
    return {"resource": "Person", "select": select, **more}


def test_for_each_or_null_and_row_index(people):
    found = evaluate_view(view([{"column": [ID]}, {"forEachOrNull": "name", "column": [{"name": "f", "path": "family", "type": "string"}, {"name": "k", "path": "%rowIndex", "type": "integer"}]}]), people)
    assert rows(found) == [('"a"', "Ash", 0), ('"a"', "Elm", 1), ('"b"', None, 0), ('"c"', None, 0)]


def test_for_each_drops_documents_without_items(people):
    assert evaluate_view(view([{"forEach": "name.given", "column": [{"name": "g", "path": "$this", "type": "string"}]}]), people).count() == 2


def test_repeat_is_depth_first(people):
    found = evaluate_view(view([{"repeat": ["part"], "column": [{"name": "n", "path": "n", "type": "integer"}, {"name": "k", "path": "%rowIndex", "type": "integer"}]}]), people)
    assert rows(found) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_union_cross_and_collection(people):
    found = evaluate_view(view([{"column": [{"name": "all", "path": "name.family", "collection": True}]}, {"unionAll": [{"column": [{"name": "x", "path": "'one'", "type": "string"}]}, {"forEach": "name", "column": [{"name": "x", "path": "use", "type": "string"}]}]}]), people)
    assert ('["Ash","Elm"]', "old") in rows(found) and ("[]", "one") in rows(found) and found.count() == 5


@pytest.mark.parametrize(
    ("path", "ids"),
    [
        ("active = true", ["a"]), ("active", ["a"]), ("active.not()", ["b"]), ("score > 3 and active = false", ["b"]), ("name.exists()", ["a"]), ("name.where(use = %use).exists()", ["a"]), ("score.empty()", ["c"]),
        ("score + 1 = 4", ["a"]), ("value.ofType(Quantity).value >= 1.5", ["a"]), ("link.getReferenceKey() = '2'", ["a"]), ("name[1].family = 'Elm' or score = 12", ["a", "b"]), ("id = 'c'", ["c"]),
    ],
)
def test_where(people, path, ids):
    found = evaluate_view(view([{"column": [{"name": "id", "path": "id", "type": "id"}]}], where=[{"path": path}], constant=[{"name": "use", "valueCode": "old"}]), people)
    assert sorted(r["id"] for r in found.collect()) == ids


def test_data_errors(people):
    with pytest.raises(Exception, match="VD_COLUMN_MULTIPLE_VALUES"):
        evaluate_view(view([{"column": [{"name": "f", "path": "name.family"}]}]), people).collect()
    with pytest.raises(Exception, match="VD_WHERE_NOT_BOOLEAN"):
        evaluate_view(view([{"column": [ID]}], where=[{"path": "id"}]), people).collect()


@pytest.mark.parametrize(
    ("bad", "code"),
    [
        ({"resource": "Person"}, "VD_INVALID"), ({"select": [{}]}, "VD_INVALID"), (view([{"column": [{"name": "x", "path": "@@"}]}]), "VD_PATH_INVALID"),
        (view([{"column": [{"name": "x", "path": "%no"}]}]), "VD_CONSTANT_UNDEFINED"), (view([{"column": [{"name": "x", "path": "name.join(',')"}]}]), "VD_FUNCTION_UNSUPPORTED"),
        (view([{"unionAll": [{"column": [ID]}, {"column": [{"name": "z", "path": "id"}]}]}]), "VD_UNION_MISMATCH"), (view([{"column": [ID]}], constant=[{"name": "c"}]), "VD_CONSTANT_INVALID"),
    ],
)
def test_definition_errors(bad, code):
    with pytest.raises(EngineError) as error:
        parse_view(bad)
    assert error.value.code == code


def test_strict_tier():
    assert validate_view(view([{"column": [ID]}])) == ["id"]
    for definition in (view([{"column": [ID]}]), view([{"column": [ID, ID]}], name="v"), view([{"column": [ID, {"name": "row_index", "path": "id"}]}], name="v"), view([{"column": [{"name": "x", "path": "id"}]}], name="v")):
        with pytest.raises(EngineError):
            parse_materialisable(definition)


def test_plan_has_no_python(people):
    plan = evaluate_view(view([{"forEach": "name", "column": [ID]}]), people)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rebuild_equals_incremental(spark):
    def patients(last):
        raw = [(t, k, json.dumps({"resourceType": "Patient", "id": k, "gender": g, "name": [{"family": f}]})) for t, k, g, f in (("t", "1", "male", "A"), ("t", "2", "female", last), ("t", "3", "other", "C"))]
        base = spark.createDataFrame(raw, "practice_id string, id string, raw string")
        return base.select("practice_id", "id", F.lit("Patient").alias("type"), F.lit(1).cast("long").alias("version_id"), F.lit("2024-01-01").cast("timestamp").alias("last_updated"), F.parse_json("raw").alias("content"))

    own = shipped_views()["patient_demographics"]
    assert table_plan(own)[0] == "vd_patient_demographics" and len(shipped_views()) == 8
    old, new = patients("B"), patients("Z")
    merged = upserted(own, project(own, old), new.filter("id = '2'"))
    assert dump_digest(merged).collect() == dump_digest(project(own, new)).collect() != dump_digest(project(own, old)).collect()
