"""Driver queries of the write path, search, context, walk, diff and scanner operators, and the SQL of their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.canonical import flat_canonical
from docloom.operators import context, diff, graph, policy, scan, search, store, terminology
from docloom.queries import _customers, _edges, _read, query


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as incoming resources; ids divisible by 11 carry another id in their content."""
    customer = _read(spark, sf_dir, "customer")
    inner = F.when(F.col("c_custkey") % 11 == 0, F.lit("other")).otherwise(F.col("c_custkey").cast("string"))
    doc = F.struct(F.lit("Customer").alias("resourceType"), inner.alias("id"), F.col("c_name").alias("name"))
    return customer.select(F.lit("t1").alias("practice_id"), F.col("c_custkey").cast("string").alias("id"), F.lit("Customer").alias("type"), F.to_variant_object(doc).alias("content"), F.to_json(doc).alias("raw"), "c_custkey", "c_name")


_NOW = "2024-01-01T00:00:00.000Z"


def _content_hash() -> Column:
    return F.sha2(flat_canonical({"id": F.try_variant_get("content", "$.id", "string"), "name": F.try_variant_get("content", "$.name", "string"), "resourceType": F.col("type")}), 256)


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of customers divisible by 3, at version 4."""
    old = _resources(spark, sf_dir).filter("c_custkey % 3 = 0")
    return old.select("practice_id", "id", "type", F.lit(4).cast("long").alias("version_id"), F.lit(_NOW).alias("last_updated"), "content")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 11 = 0 THEN 'INVALID_INPUT' WHEN c_custkey % 3 = 0 THEN 'ALREADY_EXISTS' ELSE 'created' END AS outcome,
CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 THEN sha256('{"id":"' || c_custkey || '","name":"' || c_name || '","resourceType":"Customer"}') END AS content_hash,
CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 THEN '{"resourceType":"Customer","id":"' || c_custkey || '","name":"' || c_name || '"}' END AS raw_payload FROM customer""")
def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = store.created(_heads(spark, sf_dir), _resources(spark, sf_dir).drop("c_custkey", "c_name"), _content_hash(), F.lit(_NOW))
    rows = made["outcome"].join(made["history"].select("id", "content_hash"), "id", "left").join(made["write_inputs"].select("id", "raw_payload"), "id", "left")
    return rows.select("id", "outcome", "content_hash", "raw_payload")


@query("""WITH u AS (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 2 = 0),
o AS (SELECT k, n, CASE WHEN k % 3 <> 0 THEN 'NOT_FOUND' WHEN k % 5 = 0 THEN 'VERSION_CONFLICT' WHEN k % 11 = 0 THEN 'INVALID_INPUT' ELSE 'updated' END AS outcome FROM u)
SELECT 'outcome' AS part, CAST(k AS VARCHAR) AS id, outcome AS value, CASE WHEN outcome = 'updated' THEN 5 END AS version_id FROM o
UNION ALL SELECT 'history', CAST(k AS VARCHAR), sha256('{"id":"' || k || '","name":"' || n || '","resourceType":"Customer"}'), 5 FROM o WHERE outcome = 'updated'
UNION ALL SELECT 'head', CAST(c_custkey AS VARCHAR), 'Customer', CASE WHEN o.outcome = 'updated' THEN 5 ELSE 4 END FROM customer LEFT JOIN o ON k = c_custkey WHERE c_custkey % 3 = 0""")
def store_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("c_custkey") % 5 == 0, F.lit(3)).when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.lit(4)).cast("long")
    updates = _resources(spark, sf_dir).filter("c_custkey % 2 = 0").select("practice_id", "id", "content", "raw", expected.alias("expected_version"))
    done = store.committed(_heads(spark, sf_dir), updates, _content_hash(), F.lit(_NOW))
    parts = [
        done["outcome"].select(F.lit("outcome").alias("part"), "id", F.col("outcome").alias("value"), "version_id"),
        done["history"].select(F.lit("history").alias("part"), "id", F.col("content_hash").alias("value"), "version_id"),
        done["resources"].select(F.lit("head").alias("part"), "id", F.col("type").alias("value"), "version_id"),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("""SELECT c_custkey AS k, max(v) AS version, CAST(1 AS BIGINT) AS n_rows FROM (SELECT c_custkey, 1 AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 3 = 0) GROUP BY c_custkey""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incoming row stands twice; one row a key is left."""
    customer = _read(spark, sf_dir, "customer")
    current = customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("version"))
    incoming = customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit(2).alias("version"))
    done = store.upsert(current, incoming.unionAll(incoming), ["k"], "version")
    return done.groupBy("k", "version").agg(F.count("*").alias("n_rows"))


@query("SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.table_counts({n: _read(spark, sf_dir, n) for n in ("customer", "orders", "part")})


@query("SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n_left, CAST(count(*) FILTER (WHERE c_custkey % 5 <> 0) AS BIGINT) AS n_right FROM customer GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE c_custkey % 5 <> 0)")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey")
    return store.bag_difference(segments.select("segment"), segments.filter("c_custkey % 5 <> 0").select("segment"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS id FROM orders EXCEPT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 4 <> 0")
def unresolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return search.unresolved(asked, _read(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("id")), ["id"])


@query("SELECT o_orderkey, (SELECT count(*) > 25 FROM orders) AS truncated FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25)")
def page_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, more = search.page(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 25)
    return rows.select("o_orderkey", F.lit(more).alias("truncated"))


@query("SELECT user_id, min(event_id) AS first_event, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_seen(_read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("first_event"), "event_type"), "user_id", "first_event")


@query("""WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ' AS w FROM documents)
SELECT doc_id FROM w WHERE (contains(w, ' of the ') AND contains(w, ' and ') AND NOT contains(w, ' tion ')) OR contains(w, ' der ')""")
def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").filter(search.matches_web(F.col("text"), '"of the" and -tion or der')).select("doc_id")


@query("""SELECT p_partkey AS id, 'Observation' AS resource_type, concat_ws(' ', p_name, p_brand, 'B' || p_size, CAST(p_size AS VARCHAR), 'cm') AS content_text, 'm2' AS model_id, 2 AS source_version_id FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'Observation', 'old', 'm1', 1 FROM part WHERE p_partkey % 3 <> 0""")
def search_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    index = part.select(F.col("p_partkey").alias("id"), F.lit("Observation").alias("resource_type"), F.lit("old").alias("content_text"), F.lit("m1").alias("model_id"), F.lit(1).alias("source_version_id"))
    coding = F.array(F.struct(F.col("p_brand").alias("display"), F.concat(F.lit("B"), F.col("p_size")).alias("code"), F.lit("").alias("system")))
    doc = F.struct(F.struct(F.col("p_name").alias("text"), coding.alias("coding")).alias("code"), F.lit("").alias("valueString"), F.struct(F.col("p_size").alias("value"), F.lit("cm").alias("unit")).alias("valueQuantity"))
    changed = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit("Observation").alias("type"), F.lit(2).alias("version_id"), F.to_variant_object(doc).alias("content"))
    return search.reindexed(index, changed, "m2", ["id"])


@query("SELECT o_orderkey AS id, round(1.0::DOUBLE / (o_orderkey + 1), 9) AS score, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 = 0 AND o_orderpriority = '1-URGENT'")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    found = orders.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.round(F.lit(1.0) / (F.col("o_orderkey") + 1), 9).alias("score"))
    documents = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("model_id"))
    return search.hits(found, documents, "id", ["status"], "1-URGENT")


@query("""SELECT event_id, unnest(CASE WHEN user_id % 2 = 0 THEN ['Account', 'Group'] ELSE ['Account', 'Group', 'Patient'] END) AS resource_type, 'no-rule-allows' AS reason FROM events""")
def excluded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("user_id") % 2 == 0, "clinician").otherwise("biller")
    asked = F.array(F.lit("Patient"), F.lit("Group"), F.lit("Account"))
    found = policy.excluded_types(asked, policy.scope(role, F.lit("TREAT"), F.lit(True)))
    return _read(spark, sf_dir, "events").select("event_id", F.explode(found).alias("e")).select("event_id", "e.*")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'approve' ELSE 'propose' END AS a, event_id % 5 <> 0 AS clinician,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s(user_id, n, event_no, action, before, outcome, after) AS (
  SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'proposed' FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.n, e.event_id, e.a, s.after,
    CASE WHEN a <> 'propose' AND NOT clinician THEN 'DENIED' WHEN a = 'propose' OR (s.after = 'proposed' AND a IN ('approve', 'reject')) OR (s.after = 'approved' AND a = 'commit') THEN 'done' ELSE 'ILLEGAL_TRANSITION' END,
    CASE WHEN a <> 'propose' AND NOT clinician THEN s.after WHEN s.after = 'proposed' AND a = 'approve' THEN 'approved' WHEN s.after = 'proposed' AND a = 'reject' THEN 'rejected' WHEN s.after = 'approved' AND a = 'commit' THEN 'committed' ELSE s.after END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_no, action, before, outcome, after FROM s WHERE n > 0""")
def governance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "approve").otherwise("propose")
    role = F.when(F.col("event_id") % 5 != 0, "clinician").otherwise("biller")
    events = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("event_no"), action.alias("action"), role.alias("role"), F.lit("a").alias("actor"), F.lit("a").alias("bound"))
    return policy.governed(events, "user_id")


@query("""WITH old AS (SELECT 'Order' AS source_type, CAST(o_orderkey AS VARCHAR) AS source_id, '/customer/reference' AS json_path, 'Customer' AS target_type, CAST(o_custkey AS VARCHAR) AS target_id FROM orders)
SELECT * FROM old WHERE CAST(source_id AS BIGINT) % 4 <> 0
UNION ALL SELECT source_type, source_id, '/buyer/reference', target_type, target_id FROM old WHERE CAST(source_id AS BIGINT) % 8 = 0""")
def edge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _edges(spark, sf_dir).filter("source_type = 'Order' and json_path = '/customer/reference'")
    changed = stored.filter("cast(source_id as bigint) % 4 = 0")
    fresh = changed.filter("cast(source_id as bigint) % 8 = 0").withColumn("json_path", F.lit("/buyer/reference"))
    return graph.replaced_edges(stored, changed, fresh)[0]


@query("""SELECT 'Order' AS source_type, CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS edge_count,
sha256(CASE WHEN o_orderkey % 8 = 0 THEN '/buyer/reference|Customer|' || o_custkey ELSE '' END) AS digest FROM orders WHERE o_orderkey % 4 = 0""")
def edge_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _edges(spark, sf_dir).filter("source_type = 'Order' and json_path = '/customer/reference'")
    changed = stored.filter("cast(source_id as bigint) % 4 = 0")
    fresh = changed.filter("cast(source_id as bigint) % 8 = 0").withColumn("json_path", F.lit("/buyer/reference"))
    return graph.replaced_edges(stored, changed, fresh)[1]


@query("""WITH r AS (SELECT * FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10), c AS (SELECT DISTINCT c_custkey, c_nationkey FROM r JOIN customer ON c_custkey = o_custkey)
SELECT 1 AS depth, 'Order/' || o_orderkey AS source, '/customer/reference' AS json_path, 'Customer' AS target_type, CAST(o_custkey AS VARCHAR) AS target_id, CASE WHEN o_custkey % 2 = 0 THEN 'missing' ELSE 'resolved' END AS status FROM r
UNION ALL SELECT 2, 'Customer/' || c_custkey, '/nation/reference', 'Nation', CAST(c_nationkey AS VARCHAR), 'resolved' FROM c WHERE c_custkey % 2 <> 0""")
def reference_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _read(spark, sf_dir, "orders").select(F.lit("Order").alias("type"), F.col("o_orderkey").cast("string").alias("id")).orderBy("id").limit(10)
    customers = _read(spark, sf_dir, "customer").filter("c_custkey % 2 <> 0").select(F.lit("Customer").alias("type"), F.col("c_custkey").cast("string").alias("id"))
    targets = customers.unionAll(_read(spark, sf_dir, "nation").select(F.lit("Nation"), F.col("n_nationkey").cast("string")))
    profile = [("Order", "^/customer/reference$", "Customer"), ("Customer", "^/nation/reference$", "Nation")]
    return graph.citations(roots, _edges(spark, sf_dir), targets, profile, depth=2)[0].drop("root", "target_version")


@query("""WITH t AS (SELECT o_custkey, '[' || n || '] Order/' || o_orderkey || ' @2024-01-01T00:00:00.000Z v1' || chr(10) || '  status: "' || o_orderstatus || '"' || chr(10) || '  priority: "' || o_orderpriority || '"' AS g, n
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)),
d AS (SELECT o_custkey AS customer, 'CCP v1 audit="a' || o_custkey || '"' || chr(10) || CASE WHEN o_custkey % 2 = 0 THEN 'excludedByPolicy: "Group"("no ' || chr(92) || '"rule' || chr(92) || '"")' || chr(10) ELSE '' END || string_agg(g, chr(10) ORDER BY n) || chr(10) || 'raw FHIR escape hatch: read fhir_resources by (resourceType, id)' AS text FROM t GROUP BY o_custkey)
SELECT customer, text, sha256(text) AS digest FROM d""")
def context_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(p).alias("json_path"), F.concat(F.lit('"'), F.col(c), F.lit('"')).alias("value")) for p, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))])
    groups = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("place"), F.lit("Order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit("2024-01-01T00:00:00.000Z").alias("last_updated"), F.lit(1).alias("version_id"), spans.alias("spans")
    )
    withheld = F.when(F.col("customer") % 2 == 0, F.array(F.struct(F.lit("Group").alias("resource_type"), F.lit('no "rule"').alias("reason")))).otherwise(F.array().cast("array<struct<resource_type:string,reason:string>>"))
    return context.document_text(groups, ["customer"], F.concat(F.lit("a"), F.col("customer")), withheld)


@query("""WITH a AS (SELECT o_custkey AS request, o_custkey % 10 <> 0 AS ok, o_orderkey % 9 = 0 AS gone, o_orderkey % 8 = 0 AS wrong, o_orderkey % 7 = 0 AS outside FROM orders),
c AS (SELECT request, bool_and(ok) AS ok, count(*) FILTER (WHERE gone) AS m, count(*) FILTER (WHERE NOT gone AND wrong) AS w, count(*) FILTER (WHERE NOT gone AND outside) AS x FROM a GROUP BY request)
SELECT request, CASE WHEN NOT ok THEN 'RECEIPT_MISMATCH' WHEN m > 0 THEN 'UNRESOLVED_RESULT' WHEN w > 0 THEN 'TYPE_MISMATCH' WHEN x > 0 THEN 'SCOPE_EXCLUDED_TYPE' ELSE 'ok' END AS outcome,
CAST(CASE WHEN NOT ok THEN 0 WHEN m > 0 THEN m WHEN w > 0 THEN w ELSE x END AS BIGINT) AS n FROM c""")
def context_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 7 == 0, "Group").otherwise("Observation")
    label = F.when(F.col("o_orderkey") % 8 == 0, "Patient").otherwise(kind)
    asked = orders.select(F.col("o_custkey").alias("request"), (F.col("o_custkey") % 10 != 0).alias("receipt_ok"), F.col("o_orderkey").alias("resource_id"), label.alias("resource_type"))
    resources = orders.filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), kind.alias("type"))
    return context.guarded(asked, resources, list(policy.CLINICAL_TYPES))


@query("""SELECT c_custkey AS id, '/a/0/name' AS pointer, 'changed' AS kind, '"' || c_name || '" != "' || c_name || '!"' AS detail FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, '/a/1', 'missing', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, '/x~1y', 'unexpected', 'true' FROM customer WHERE c_custkey % 5 = 0""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    old = F.concat(F.lit('{"a":[{"name":"'), "c_name", F.lit('"},'), F.col("c_nationkey").cast("string"), F.lit('],"same":[1,{"k":null}]}'))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    second = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(","), F.col("c_nationkey").cast("string")))
    extra = F.when(F.col("c_custkey") % 5 == 0, ',"x/y":true').otherwise("")
    new = F.concat(F.lit('{"same":[1,{"k":null}],"a":[{"name":"'), name, F.lit('"}'), second, F.lit("]"), extra, F.lit("}"))
    return diff.json_differences(customer.select(F.col("c_custkey").alias("id"), old.alias("expected"), new.alias("actual")), "id", "expected", "actual")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, '/q/value' AS pointer, 'decimal-scale' AS kind, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0 → ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS detail FROM lineitem WHERE l_linenumber = 1 AND l_quantity = CAST(l_quantity AS INTEGER)""")
def decimal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_quantity = cast(l_quantity as int)")
    raw = F.concat(F.lit('{"q":{"value":'), F.col("l_quantity").cast("int").cast("string"), F.lit('.0,"n":[1,1.5]}}'))
    return diff.decimal_differences(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), raw.alias("raw")), "id", "raw")


@query("""WITH c AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 3, '0') AS a, CASE WHEN c_custkey % 2 = 0 THEN 'Smith7' ELSE 'Smith' END AS family FROM customer)
SELECT id, '/name/0/family' AS pointer, 'name-marker' AS rule, sha256(family) AS value_sha256 FROM c WHERE id % 2 <> 0
UNION ALL SELECT id, '/ssn', 'ssn-structural', sha256(a || '-12-3456') FROM c WHERE a NOT IN ('000', '666') AND a < '900'
UNION ALL SELECT id, '/telecom/0/value', 'phone-nanp', sha256('(' || a || ') 234-5678') FROM c WHERE a >= '200'
UNION ALL SELECT id, '/identifier/0/system', 'mrn-system', sha256('m' || id) FROM c WHERE id % 3 = 0
UNION ALL SELECT id, '', 'compound-identity', sha256('Mary') FROM c WHERE id % 5 = 0
UNION ALL SELECT id, '/name/0/given/0', 'name-marker', sha256('Mary') FROM c WHERE id % 5 = 0""")
def identifier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    area = F.lpad((key * 7 % 1000).cast("string"), 3, "0")
    name = F.struct(F.when(key % 2 == 0, "Smith7").otherwise("Smith").alias("family"), F.when(key % 5 == 0, F.array(F.lit("Mary"))).alias("given"))
    mrn = F.struct(F.when(key % 3 == 0, "http://hospital/MRN").otherwise("urn:other").alias("system"), F.concat(F.lit("m"), key).alias("value"))
    phone = F.struct(F.lit("phone").alias("system"), F.concat(F.lit("("), area, F.lit(") 234-5678")).alias("value"))
    doc = F.struct(F.array(name).alias("name"), F.concat(area, F.lit("-12-3456")).alias("ssn"), F.array(phone).alias("telecom"), F.array(mrn).alias("identifier"), F.lit("1970-02-03").alias("birthDate"))
    return scan.findings(_read(spark, sf_dir, "customer").select(key.alias("id"), F.to_json(doc).alias("raw")), "id", "raw")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, '/segment' AS pointer, 'segment' AS system, c_mktsegment AS code FROM customer""")
def codings_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminology.codings(_customers(spark, sf_dir).withColumn("id", F.try_variant_get("content", "$.id", "string")), ("id",))


@query("SELECT p_partkey, p_type AS code, p_type IN ('STANDARD', 'ECONOMY') AS result, CASE WHEN p_type LIKE 'PROMO%' THEN 'code-format' WHEN p_type NOT IN ('STANDARD', 'ECONOMY') THEN 'unknown-code' END AS issue, '2024' AS version FROM part")
def validate_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", F.lit("parts").alias("system"), F.col("p_type").alias("code"))
    concepts = part.filter("code in ('STANDARD', 'ECONOMY')").select("system", "code").distinct().withColumn("display", F.lower("code"))
    return terminology.validated(part, concepts, {"parts": ~F.col("code").startswith("PROMO")}, {"parts": "2024"}).drop("system", "display")
