import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import validators
from docloom.functions.canonical import canonical, content_form
from docloom.operators import audit, graph, policy, store
from docloom.operators.search import fused, hashed_embedding, vector_arm
from docloom.session import TenantSession
from docloom.sources.documents import read_ndjson, read_terminology, verify_manifest
from docloom.streaming.reactive import ReactiveQuery


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (validators.sctid_valid, ["73211009", "22298006", "38341003"], ["73211008", "012345", "12", "abc"]),
        (validators.npi_valid, ["1234567893"], ["1234567890", "123", "x"]),
        (validators.ssn_valid, ["123-45-6789"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-1234", "123-45-0000", "1"]),
        (validators.nanp_valid, ["(212) 555-0123", "+1 212-555-0123"], ["112-555-0123", "212-155-0123", "5"]),
        (validators.fictional_phone, ["212-555-0123"], ["212-555-0223"]),
    ],
)
def test_validators(spark, check, good, bad):
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", check(F.col("t")).alias("ok")).collect()
    assert {r["t"] for r in rows if r["ok"]} == set(good)


def test_small_formats(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, validators.uuid5(space, F.lit("a/b"))) == str(uuid.uuid5(uuid.UUID(space), "a/b"))
    assert one(spark, validators.pointer_escape(F.lit("a~/b"))) == "a~0~1b"
    assert one(spark, validators.safe_uuid(F.lit("junk"))) is None
    assert one(spark, validators.iso_millis(F.lit("2024-01-02 03:04:05.678").cast("timestamp"))) == "2024-01-02T03:04:05.678Z"


def test_canonical_json():
    assert canonical({"b": 1.0, "a": [1e21, 1e-7, 0.001, 100.0, -0.0, True, None, "é\n"]}) == '{"a":[1e+21,1e-7,0.001,100,0,true,null,"é\\n"],"b":1}'
    assert canonical(123456789012.5) == "123456789012.5" and canonical(1.5e300) == "1.5e+300" and canonical(1e20) == "100000000000000000000"
    assert content_form({"id": "1", "meta": {"versionId": "2", "lastUpdated": "x"}}) == '{"id":"1"}'


def test_tenant_session(spark):
    tenant = str(uuid.uuid4())
    frame = spark.createDataFrame([(tenant, 1), (str(uuid.uuid4()), 2), (None, 3)], "practice_id string, n int")
    for bound, expected in ((tenant, [1]), (None, []), ("garbage", [])):
        session = TenantSession(spark, bound)
        session.register("t", frame)
        assert [r["n"] for r in session.table("t").collect()] == expected


def _events(spark, n=6):
    rows = [("a", "allow", "r" if k % 2 else None, "2024-01-01T00:00:00.000Z", f"t{k % 2}", "TREAT", 'say "x"', "Patient", k) for k in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in audit.FIELDS) + ", event_no long").withColumn("practice_id", F.concat(F.lit("t"), (F.col("event_no") % 2).cast("string")))


def test_audit_chain_tampering(spark):
    chain = audit.appended(_events(spark)).cache()
    assert all(r["first_break"] is None for r in audit.verified(chain).collect())
    tips = store.heads(chain.select("practice_id", "seq", "row_hash"), ["practice_id"], "seq")
    more = audit.appended(_events(spark).withColumn("event_no", F.col("event_no") + 10), tips)
    assert all(r["first_break"] is None and r["n_rows"] == 6 for r in audit.verified(chain.unionByName(more)).collect())
    broken = {
        "row_hash_mismatch": chain.withColumn("reason", F.when(F.col("seq") == 2, "no").otherwise(F.col("reason"))),
        "seq_gap": chain.filter("seq <> 2"),
        "genesis_mismatch": chain.withColumn("prev_hash", F.when(F.col("seq") == 1, "x").otherwise(F.col("prev_hash"))),
        "prev_hash_mismatch": chain.withColumn("prev_hash", F.when(F.col("seq") == 3, "x").otherwise(F.col("prev_hash"))),
    }
    for kind, frame in broken.items():
        assert {r["kind"] for r in audit.verified(frame).collect()} == {kind}


def test_policy(spark):
    grid = spark.createDataFrame([("clinician", "TREAT", "a", "a", "a", "Patient"), ("biller", "TREAT", "a", "a", "a", "Patient"), ("clinician", "TREAT", "a", "b", "a", "Patient"), (None, None, None, None, None, None)], "r string, p string, s string, q string, o string, k string")
    rule = policy.matched_rule(*[F.col(c) for c in ("r", "p", "s", "q", "o", "k")])
    assert [r[0] for r in grid.select(policy.decision(rule)).collect()] == ["allow", "deny", "deny", "deny"]


def test_store_update_and_upsert(spark):
    current = spark.createDataFrame([("t", "1", 1), ("t", "2", 4)], "practice_id string, id string, version_id long")
    wanted = spark.createDataFrame([("t", "1", 1), ("t", "2", 3), ("t", "9", 1)], "practice_id string, id string, expected_version long")
    assert {r["id"]: (r["outcome"], r["new_version"]) for r in store.update(current, wanted).collect()} == {"1": ("updated", 2), "2": ("VERSION_CONFLICT", None), "9": ("NOT_FOUND", None)}
    fresh = spark.createDataFrame([("t", "2", 5), ("t", "3", 1), ("t", "3", 1)], current.schema)
    assert {(r["id"], r["version_id"]) for r in store.upsert(current, fresh).collect()} == {("1", 1), ("2", 5), ("3", 1)}
    assert [r["id"] for r in store.insert_if_absent(current, fresh).collect()] == ["3"]


def test_references_and_walk(spark):
    docs = [("Observation", "o", {"subject": {"reference": "Patient/p"}, "x~/y": [{"reference": "Specimen/s/_history/3"}, {"reference": "#in"}, {"reference": "urn:uuid:1"}]}), ("Specimen", "s", {"parent": [{"reference": "Specimen/s"}]})]
    edges = graph.extract_edges(spark.createDataFrame([(t, i, json.dumps(d)) for t, i, d in docs], "type string, id string, raw string")).cache()
    assert {(r["json_path"], r["target_id"], r["target_version"]) for r in edges.collect()} == {("/subject/reference", "p", None), ("/x~0~1y/0/reference", "s", "3"), ("/parent/0/reference", "s", None)}
    roots = spark.createDataFrame([("Observation", "o")], "type string, id string")
    assert {(r["target_id"], r["depth"]) for r in graph.walk(roots, edges).collect()} == {("p", 1), ("s", 1)}
    assert graph.walk(roots, edges, profile=graph.CLINICAL_PROFILE).count() == 1 and len(graph.CLINICAL_PROFILE) == 27
    assert graph.walk(roots, edges, max_targets=1).count() == 1
    digests = graph.edge_digests(edges)
    assert {r["status"] for r in graph.compare_projection(digests, digests).collect()} == {"equal"}


def test_search_arms(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "id long, v array<double>")
    arm = vector_arm(vectors, "id", "v", [1.0, 0.0])
    assert [(r["id"], r["rank"]) for r in arm.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vector_arm(vectors, "id", "v", [0.0, 0.0]).count() == 0
    assert [r["id"] for r in fused([arm, arm], "id").collect()] == [1, 2]
    words = spark.createDataFrame([(1, "Alpha beta alpha")], "id long, t string")
    norm = hashed_embedding(words, "id", F.col("t")).agg(F.sum(F.col("weight") ** 2)).first()[0]
    assert abs(norm - 1) < 1e-9


def test_sources(spark, tmp_path):
    body = '{"resourceType":"Patient","id":"1"}\r\n\n{"resourceType":"Patient","id":"2"}\n'
    (tmp_path / "p.ndjson").write_bytes(body.encode())
    assert {r["id"] for r in read_ndjson(spark, str(tmp_path / "p.ndjson")).collect()} == {"1", "2"}
    manifest = {"files": [{"file": "p.ndjson", "sha256": hashlib.sha256(body.encode()).hexdigest(), "lines": 2}, {"file": "q", "sha256": "", "lines": 0}]}
    assert {r["file"]: r["ok"] for r in verify_manifest(spark, str(tmp_path), manifest).collect()} == {"p.ndjson": True, "q": False}
    (tmp_path / "t.csv").write_text('code,display\nA,"x, y"\nB,z\n')
    assert {(r["code"], r["display"]) for r in read_terminology(spark, str(tmp_path / "t.csv"), "s").collect()} == {("A", "x, y"), ("B", "z")}


def test_reactive_emits_on_change_only(spark):
    state, seen = {"n": 1}, []
    live = ReactiveQuery(lambda: spark.range(state["n"]), lambda frame, digest: seen.append(frame.count()))
    assert live.refresh() and not live.refresh()
    state["n"] = 3
    assert live.refresh() and seen == [1, 3]
    state["n"] = "bad"
    assert not live.refresh() and live.error is not None and seen == [1, 3]
