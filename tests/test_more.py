import json

import pytest
from pyspark.sql import functions as F

from docloom.errors import EngineError
from docloom.functions.paths import Temporal
from docloom.operators import diff, graph, materialize, policy, providers, scan, search, store, terminology
from docloom.plans.views import evaluate_view
from docloom.sources import documents as sources


def as_docs(spark, resources):
    rows = [(r.get("resourceType"), str(r.get("id")), json.dumps(r)) for r in resources]
    return spark.createDataFrame(rows, "type string, id string, raw string").withColumn("content", F.parse_json("raw"))


def rows_of(spark, resources, select, where=(), constant=()):
    view = {"resource": "Patient", "select": select, "where": [{"path": w} for w in where], "constant": list(constant)}
    return sorted((tuple(r) for r in evaluate_view(view, as_docs(spark, resources)).collect()), key=repr)


PATIENTS = [
    {"resourceType": "Patient", "id": "a", "birthDate": "1970-03-04", "seen": "2020-01-01T10:00:00+02:00", "at": "10:30", "name": [{"family": "F", "given": ["x", "y"]}, {"family": "G"}]},
    {"resourceType": "Patient", "id": "b", "birthDate": "1980-01", "seen": "2020-01-01T08:00:00Z", "at": "11:00"},
    {"resourceType": "Patient", "id": "c"},
]
ID = {"column": [{"name": "id", "path": "id", "type": "id"}]}


@pytest.mark.parametrize(
    ("path", "kind", "value", "ids"),
    [
        ("birthDate = %v", "Date", "1970-03-04", ["a"]),
        ("birthDate = %v", "String", "1970-03-04", ["a"]),
        ("birthDate < %v", "Date", "1975-01-01", ["a"]),
        ("birthDate > %v", "Date", "1980-01-15", []),  # the month alone doesn't decide
        ("seen = %v", "Instant", "2020-01-01T08:00:00Z", ["a", "b"]),  # one moment in two zones
        ("at > %v", "Time", "10:45", ["b"]),
        ("birthDate = @1970-03-04", "String", "", ["a"]),
        ("%v = @1970-03-04", "String", "1970-03-04", []),  # a text constant is no date
    ],
)
def test_temporals(spark, path, kind, value, ids):
    found = rows_of(spark, PATIENTS, [ID], [path], [{"name": "v", f"value{kind}": value}])
    assert [r[0] for r in found] == ids


def test_iterations_multiply_and_stay_empty(spark):
    names = {"forEach": "name", "column": [{"name": "family", "path": "family", "type": "string"}], "select": [{"forEachOrNull": "given", "column": [{"name": "given", "path": "$this", "type": "string"}, {"name": "k", "path": "%rowIndex", "type": "integer"}]}]}
    assert rows_of(spark, PATIENTS, [ID, names]) == [("a", "F", "x", 0), ("a", "F", "y", 1), ("a", "G", None, 0)]
    union = {"unionAll": [{"forEach": "name", "column": [{"name": "v", "path": "family", "type": "string"}]}, {"column": [{"name": "v", "path": "at", "type": "time"}]}]}
    assert rows_of(spark, PATIENTS, [ID, union]) == [("a", "10:30"), ("a", "F"), ("a", "G"), ("b", "11:00"), ("c", None)]


def test_literals_of_dates_are_typed():
    assert isinstance(Temporal("2020"), str)


def test_rebuild_is_published_whole_and_upsert_agrees(spark, tmp_path):
    def resources(people):
        return as_docs(spark, people).select(F.lit("t").alias("practice_id"), "id", "type", F.lit(1).cast("long").alias("version_id"), F.current_timestamp().alias("last_updated"), "content")

    view = materialize.shipped_views()["patient_demographics"]
    tables = materialize.rebuild([view], resources(PATIENTS), str(tmp_path))
    assert tables["vd_patient_demographics"].count() == 3
    assert materialize.rebuild_summary(tables).first()["n_resources"] == 3
    changed = [{**PATIENTS[0], "name": [{"family": "New"}]}]
    after = materialize.upserted(view, tables["vd_patient_demographics"], resources(changed))
    again = materialize.rebuild([view], resources([changed[0], *PATIENTS[1:]]), str(tmp_path))["vd_patient_demographics"]
    assert store.bag_difference(after.drop("last_updated"), again.drop("last_updated")).isEmpty()
    assert materialize.published(spark, str(tmp_path), ["vd_patient_demographics"])["vd_patient_demographics"].count() == 3


def test_upsert_of_repeated_keys(spark):
    current = spark.createDataFrame([(1, "old")], "id int, v string")
    incoming = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string")
    assert sorted(tuple(r) for r in store.upsert(current, incoming, ["id"]).collect()) == [(1, "x"), (2, "y")]


def test_corrupt_governance_log_fails(spark):
    log = spark.createDataFrame([(1, "commit")], "proposal_id int, action string")
    with pytest.raises(Exception, match="GOVERNANCE_LOG_CORRUPT"):
        policy.proposal_states(log, log).collect()


def test_web_queries():
    assert search.web_query('cat "big dog" -bird or fish') == [(["cat", "big dog"], ["bird"]), (["fish"], [])]
    assert search.web_query(" , -") == []


def test_differences_are_topmost():
    a, b = {"x": [1, {"y": "1"}], "k/~": 1}, {"x": [1, {"y": "2"}, 3]}
    assert list(diff.tree_differences(a, b)) == [("/k~1~0", "missing", "1"), ("/x/1/y", "changed", '"1" != "2"'), ("/x/2", "unexpected", "3")]
    assert list(diff.tree_differences({"a": 1}, {"a": 1.0})) == []
    assert {d[0] for d in diff.scale_losses('{"a": 2.0, "b": [1.50, 3, 0.1, -4]}')} == {"/a", "/b/0"}


def test_scanner(spark):
    planted = {"name": [{"family": "Smith", "given": ["Mary", "X1"]}], "birthDate": "1970-01-01", "note": "123-45-6789", "bad": "000-12-3456", "identifier": [{"system": scan.NPI_SYSTEM, "value": "1234567893"}, {"type": {"coding": [{"code": "MR"}]}, "value": "m"}]}
    frame = spark.createDataFrame([(1, json.dumps(planted)), (2, None), (3, "{}")], "id int, raw string")
    found = {(r["id"], r["rule"], r["pointer"]) for r in scan.findings(frame, "id", "raw").collect()}
    assert found == {
        (1, "name-marker", "/name/0/family"), (1, "name-marker", "/name/0/given/0"), (1, "ssn-structural", "/note"), (1, "npi-luhn", "/identifier/0/value"), (1, "mrn-system", "/identifier/1/system"), (1, "compound-identity", ""),
    }
    text = spark.createDataFrame([(1, "a 123-45-6789, 000-11-2222 9123-45-67890")], "id int, t string")
    assert scan.ssn_in_text(text, "id", "t").count() == 1


def test_codings_stand_anywhere(spark):
    found = terminology.codings(as_docs(spark, [{"id": "p", "a/b": [{"code": {"system": "s", "code": "c"}}], "system": "t", "code": 5}]))
    assert [tuple(r) for r in found.collect()] == [("p", "/a~1b/0/code", "s", "c")]


def test_citations_have_their_status(spark):
    edges = spark.createDataFrame([("A", "1", "/x/reference", "B", "2"), ("A", "1", "/y/reference", "B", "3"), ("B", "2", "/z/reference", "B", "2")], "source_type string, source_id string, json_path string, target_type string, target_id string")
    roots = spark.createDataFrame([("A", "1")], "type string, id string")
    targets = spark.createDataFrame([("B", "2")], "type string, id string")
    found, stats = graph.citations(roots, edges, targets, depth=2)
    assert sorted((r["json_path"], r["status"]) for r in found.collect()) == [("/x/reference", "resolved"), ("/y/reference", "missing"), ("/z/reference", "already-present")]
    assert stats["missing"] == 1 and stats["already_present"] == 1 and not stats["read_truncated"]
    _, stats = graph.citations(roots, edges, None, depth=1, max_edges=1)
    assert stats["read_truncated"] == 1


def test_point_reads(spark):
    frame = spark.createDataFrame([("a", 1)], "id string, version_id long")
    assert sources.by_id(frame, {"id": "a"}).first()["version_id"] == 1
    with pytest.raises(EngineError, match="RESOURCE_NOT_FOUND"):
        sources.by_id(frame, {"id": "z"})
    history = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 7, "b7")], "id string, version_id long, v string")
    current = history.filter("v <> 'old'")
    asked = spark.createDataFrame([("a", None), ("a", 1), ("a", 2), ("b", 7), ("c", None)], "id string, version_id long")
    assert sorted(tuple(r) for r in sources.versions_by_key(current, history, asked, ["id"]).collect()) == [("a", 1, "old"), ("a", 2, "new"), ("b", 7, "b7")]
    with pytest.raises(EngineError, match="SUITE_INVALID"):
        sources.read_suite('{"resources": [], "tests": [{"view": {}}]}')


def test_providers(spark):
    docs = spark.createDataFrame([(1, "t", "Patient", "red apple"), (2, "t", "Patient", "green apple"), (3, "u", "Patient", "apple")], "id int, practice_id string, resource_type string, content_text string")
    model = providers.EmbeddingProvider("len", 2, lambda texts: [[float(len(t)), 1.0] for t in texts])
    indexed = providers.embedded(docs, "content_text", model)
    request = {"actor_id": "x", "role": "clinician", "purpose": "TREAT", "practice_id": "t"}
    hits, receipt = providers.search_clinical(indexed, "id", "apple", [9.0, 1.0], request, "len", "2024-01-01T00:00:00.000Z", providers.Providers(rerank=providers.RerankProvider(lambda q, texts: [float(t.startswith("green")) for t in texts])))
    assert [r["id"] for r in hits.collect()] == [2, 1] and receipt.first()["decision"] == "allow"
    hits, receipt = providers.search_clinical(indexed, "id", "apple", [9.0, 1.0], request | {"role": "biller"}, "len", "2024-01-01T00:00:00.000Z")
    assert hits.isEmpty() and receipt.first()["decision"] == "deny"
