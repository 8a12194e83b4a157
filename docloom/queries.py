"""Driver queries of the engine's operators over the flat tables, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import validators
from docloom.functions.canonical import content_hash, flat_canonical
from docloom.operators import audit, context, diff, graph, policy, search, search_params, store, terminology
from docloom.plans.views import evaluate_view
from docloom.session import bound_filter
from docloom.sources.documents import as_documents, nested

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = {"line": F.col("l_linenumber"), "part": F.col("l_partkey"), "qty": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "flag": F.col("l_returnflag")}
    fields = {"resourceType": F.lit("Order"), "id": F.col("o_orderkey").cast("string"), "customer": F.struct(F.concat(F.lit("Customer/"), F.col("o_custkey")).alias("reference")), "status": F.col("o_orderstatus"), "total": F.col("o_totalprice"), "priority": F.col("o_orderpriority")}
    built = nested(_read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "lines", ["l_linenumber"], fields, lines)
    return as_documents(built, "Order")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    doc = F.struct(F.lit("Customer").alias("resourceType"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.struct(F.lit("segment").alias("system"), F.col("c_mktsegment").alias("code")).alias("segment"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") > 0, F.lit(True)).alias("active"), F.col("c_nationkey").alias("nation"))
    return as_documents(customer.select(doc.alias("doc")), "Customer")


def _customers_with_orders(spark: SparkSession, sf_dir: str, lines: bool = False) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    fields = {"order": F.col("o_orderkey"), "price": F.col("o_totalprice")}
    if lines:
        line = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))).alias("item"))
        orders = orders.join(line, "o_orderkey", "left")
        fields["item"] = F.col("item")
    built = nested(_read(spark, sf_dir, "customer"), orders, "c_custkey", "o_custkey", "item", ["o_orderkey"], {"resourceType": F.lit("Customer"), "id": F.col("c_custkey").cast("string"), "name": F.col("c_name")}, fields)
    return as_documents(built, "Customer")


def _column(name: str, path: str, kind: str | None = None, collection: bool = False) -> dict:
    return {"name": name, "path": path} | ({"type": kind} if kind else {}) | ({"collection": True} if collection else {})


_KEY = _column("id", "getResourceKey()", "id")


def _view(resource: str, select: list, **more: object) -> dict:
    return {"resource": resource, "status": "active", "select": select, **more}


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, CASE WHEN c_acctbal > 0 THEN true END AS active, CAST(NULL AS VARCHAR) AS missing FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100")
def view_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view("Customer", [{"column": [_KEY, _column("name", "name", "string"), _column("segment", "segment.code", "code"), _column("active", "active", "boolean"), _column("missing", "nowhere.at.all", "string")]}], where=[{"path": "segment.code = %segment"}, {"path": "balance > %least"}], constant=[{"name": "segment", "valueCode": "BUILDING"}, {"name": "least", "valueInteger": 100}])
    return evaluate_view(view, _customers(spark, sf_dir))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS line, CAST(l_partkey AS INTEGER) AS part, l_returnflag AS flag, 'Customer/' || o_custkey AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def view_for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = {"forEach": "lines", "column": [_column("line", "line", "integer"), _column("part", "part", "integer"), _column("flag", "flag", "code")]}
    return evaluate_view(_view("Order", [{"column": [_KEY, _column("customer", "customer.reference", "string")]}, lines]), _orders_with_lines(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(o_orderkey AS INTEGER) AS order_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def view_for_each_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_view(_view("Customer", [{"column": [_KEY]}, {"forEachOrNull": "item", "column": [_column("order_id", "order", "integer")]}]), _customers_with_orders(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(o_orderkey AS INTEGER) AS order_id, l_linenumber AS line FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def view_nested_for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = {"forEach": "item", "column": [_column("line", "line", "integer")]}
    return evaluate_view(_view("Customer", [{"column": [_KEY]}, {"forEach": "item", "column": [_column("order_id", "order", "integer")], "select": [inner]}]), _customers_with_orders(spark, sf_dir, lines=True))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), F.col("role"), F.length("text").alias("size")))).alias("turns"))
    return as_documents(grouped.select(F.struct(F.lit("Conversation").alias("resourceType"), F.col("conv_id").cast("string").alias("id"), F.col("turns").alias("turn")).alias("doc")), "Conversation")


@query("SELECT CAST(u.conv_id AS VARCHAR) AS id, CAST(u.turn AS INTEGER) AS user_turn, CAST(a.turn AS INTEGER) AS assistant_turn FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id WHERE u.role = 'user' AND a.role = 'assistant'")
def view_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [{"forEach": f"turn.where(role = '{r}')", "column": [_column(f"{r}_turn", "turn", "integer")]} for r in ("user", "assistant")]
    return evaluate_view(_view("Conversation", [{"column": [_KEY]}, *sides]), _conversations(spark, sf_dir))


@query("SELECT CAST(conv_id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS INTEGER) AS row_index, CAST(turn AS INTEGER) AS turn, role FROM conversations")
def view_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_view(_view("Conversation", [{"column": [_KEY]}, {"forEach": "turn", "column": [_column("row_index", "%rowIndex", "integer"), _column("turn", "turn", "integer"), _column("role", "role", "code")]}]), _conversations(spark, sf_dir)).withColumn("row_index", F.col("row_index").cast("int"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'order' AS level, round(o_totalprice, 2) AS price FROM orders UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'line', round(l_extendedprice, 2) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def view_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = [{"column": [_column("level", "'order'", "string"), _column("price", "total", "decimal")]}, {"forEach": "lines", "column": [_column("level", "'line'", "string"), _column("price", "price", "decimal")]}]
    rows = evaluate_view(_view("Order", [{"column": [_KEY]}, {"unionAll": branches}]), _orders_with_lines(spark, sf_dir))
    return rows.withColumn("price", F.round(F.col("price").cast("double"), 2))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(o_orderkey AS INTEGER) AS order_id, CAST(NULL AS INTEGER) AS line FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def view_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_view(_view("Customer", [{"column": [_KEY]}, {"repeat": ["item"], "column": [_column("order_id", "order", "integer"), _column("line", "line", "integer")]}]), _customers_with_orders(spark, sf_dir, lines=True))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN count(l_orderkey) = 0 THEN '[]' ELSE '[' || string_agg('\"' || l_returnflag || '\"', ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag) || ']' END AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def view_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_view(_view("Order", [{"column": [_KEY, _column("flags", "lines.flag", "code", collection=True)]}]), _orders_with_lines(spark, sf_dir))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS line, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.05")
def view_constants_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view("Order", [{"column": [_KEY]}, {"forEach": "lines.where(discount > %least)", "column": [_column("line", "line", "integer"), _column("net", "price * (1 - discount)", "decimal")]}], constant=[{"name": "least", "valueDecimal": 0.05}])
    rows = evaluate_view(view, _orders_with_lines(spark, sf_dir))
    return rows.withColumn("net", F.round(F.col("net").cast("double"), 4))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tokens(frame: DataFrame) -> DataFrame:
        return frame.withColumn("id", F.try_variant_get("content", "$.id", "string"))

    customers = tokens(_customers(spark, sf_dir).withColumn("content", F.to_variant_object(F.struct(F.try_variant_get("content", "$.id", "string").alias("id"), F.struct(F.array(F.struct(F.try_variant_get("content", "$.segment.system", "string").alias("system"), F.try_variant_get("content", "$.segment.code", "string").alias("code"))).alias("coding")).alias("segment")))))
    orders = _read(spark, sf_dir, "orders").select(F.lit("Order").alias("type"), F.to_variant_object(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.struct(F.concat(F.lit("Customer/"), F.col("o_custkey")).alias("reference")).alias("customer"))).alias("content"))
    return search_params.search_index(customers.unionByName(tokens(orders)), ("id",), {"Customer": [("segment", "concept", "segment")], "Order": [("customer", "reference", "customer")]})


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'Customer' AS resource_type, 'segment' AS param_name, 'token' AS param_type, 'segment' AS token_system, c_mktsegment AS token_code, NULL AS ref_value FROM customer UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'Order', 'customer', 'reference', NULL, NULL, 'Customer/' || o_custkey FROM orders")
def search_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 7")
def search_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_params.lookup(_index(spark, sf_dir), "customer", reference="Customer/7").select("id")


@query("SELECT p_partkey, concat_ws(' ', p_name, p_brand, 'C' || p_size, p_type, CAST(p_size AS VARCHAR), 'cm', 'seen', p_brand, 'http://x/' || p_partkey, 'title') AS content_text FROM part")
def text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    coding = F.array(F.struct(F.col("p_brand").alias("display"), F.concat(F.lit("C"), F.col("p_size")).alias("code")))
    concept = F.struct(F.lit("seen").alias("text"), F.array(F.struct(F.col("p_brand").alias("display"), F.lit("").alias("code"))).alias("coding"))
    file = F.struct(F.struct(F.lit("title").alias("title"), F.concat(F.lit("http://x/"), F.col("p_partkey")).alias("url")).alias("attachment"))
    doc = F.struct(
        F.struct(F.col("p_name").alias("text"), coding.alias("coding")).alias("code"), F.col("p_type").alias("valueString"), F.struct(F.col("p_size").alias("value"), F.lit("cm").alias("unit")).alias("valueQuantity"),
        concept.alias("valueCodeableConcept"), F.array(file).alias("content"),
    )
    return part.select("p_partkey", search.document_text(F.to_variant_object(doc)).alias("content_text"))


_LEX = """SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
  SELECT doc_id, round(ln(1 + len(list_filter(w, lambda x: x = 'the'))) + ln(1 + len(list_filter(w, lambda x: x = 'tion'))), 12) AS score
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM documents)
  WHERE list_contains(w, 'the') AND list_contains(w, 'tion') ORDER BY score DESC, doc_id LIMIT 40)"""


@query(_LEX)
def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_arm(_read(spark, sf_dir, "documents"), "doc_id", "text", "tion the")


@query("""WITH t AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part),
h AS (SELECT p_partkey, sha256(w) AS d FROM t),
s AS (SELECT p_partkey, CAST(CAST('0x' || substr(d, 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket, sum(CASE WHEN CAST('0x' || substr(d, 9, 2) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s FROM h GROUP BY 1, 2 HAVING s <> 0)
SELECT p_partkey, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY p_partkey)), 6) AS weight FROM s""")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hashed_embedding(_read(spark, sf_dir, "part"), "p_partkey", F.col("p_name"))
    return found.withColumn("weight", F.round("weight", 6))


_VEC = """SELECT vec_id, round(dist, 6) AS dist, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank FROM (
  SELECT e.vec_id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS dist
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q ORDER BY dist, e.vec_id LIMIT 40)"""


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    target = vectors.filter("vec_id = 5").select("embedding").first()
    return search.vector_arm(vectors, "vec_id", "embedding", list(target["embedding"]))


@query(_VEC)
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir)


@query(f"""SELECT id, round(score, 9) AS score FROM (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
  SELECT doc_id AS id, rank FROM ({_LEX}) UNION ALL SELECT vec_id, rank FROM ({_VEC})) GROUP BY id ORDER BY score DESC, id LIMIT 20)""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = [lexical_top(spark, sf_dir).select(F.col("doc_id").alias("id"), "rank"), _vector(spark, sf_dir).select(F.col("vec_id").alias("id"), "rank")]
    return search.fused(arms, "id").withColumn("score", F.round("score", 9))


@query("SELECT o_orderkey, CAST(r AS INTEGER) AS r, CAST(CASE WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE n + 1 - r // 2 END AS INTEGER) AS place FROM (SELECT *, count(*) OVER () AS n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 25)")
def u_shape_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    top = _read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    ranked = top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r"))
    return context.u_shape(ranked, "r")


_EDGES = """SELECT 'Order' AS source_type, CAST(o_orderkey AS VARCHAR) AS source_id, '/customer/reference' AS json_path, 'Customer' AS target_type, CAST(o_custkey AS VARCHAR) AS target_id FROM orders
UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), '/nation/reference', 'Nation', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), '/region/reference', 'Region', CAST(n_regionkey AS VARCHAR) FROM nation"""


def _raw(frame: DataFrame, kind: str, key: str, member: str, target: str, target_key: str) -> DataFrame:
    reference = F.struct(F.struct(F.concat(F.lit(f"{target}/"), F.col(target_key)).alias("reference")).alias(member))
    return frame.select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"), F.to_json(reference).alias("raw"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _raw(_read(spark, sf_dir, "orders"), "Order", "o_orderkey", "customer", "Customer", "o_custkey")
    customers = _raw(_read(spark, sf_dir, "customer"), "Customer", "c_custkey", "nation", "Nation", "c_nationkey")
    nations = _raw(_read(spark, sf_dir, "nation"), "Nation", "n_nationkey", "region", "Region", "n_regionkey")
    return graph.extract_edges(orders.unionByName(customers).unionByName(nations)).drop("target_version")


@query(_EDGES)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


_PROFILE = [("Order", "^/customer/reference$", "Customer"), ("Customer", "^/nation/reference$", "Nation")]


@query(f"SELECT * FROM ({_EDGES}) WHERE source_type <> 'Nation'")
def reference_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.allowed_edges(_edges(spark, sf_dir), _PROFILE)


@query(f"SELECT source_type, source_id, count(*) AS edge_count, sha256(string_agg(json_path || '|' || target_type || '|' || target_id, chr(10) ORDER BY json_path || '|' || target_type || '|' || target_id)) AS digest FROM ({_EDGES}) GROUP BY 1, 2")
def reference_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_digests(_edges(spark, sf_dir))


@query("""WITH r AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10))
SELECT DISTINCT 'Customer' AS target_type, CAST(o_custkey AS VARCHAR) AS target_id, 1 AS depth FROM r
UNION SELECT 'Nation', CAST(c_nationkey AS VARCHAR), 2 FROM r JOIN customer ON c_custkey = o_custkey
UNION SELECT 'Region', CAST(n_regionkey AS VARCHAR), 3 FROM r JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def reference_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _read(spark, sf_dir, "orders").select(F.lit("Order").alias("type"), F.col("o_orderkey").cast("string").alias("id")).orderBy("id").limit(10)
    return graph.walk(roots, _edges(spark, sf_dir), depth=3).drop("via")


_SPANS = "SELECT CAST(c_custkey AS VARCHAR) AS id, 0 AS place, 'name' AS json_path, '\"' || c_name || '\"' AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 'segment.code', '\"' || c_mktsegment || '\"' FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 3, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer"
_LEAVES = {"Customer": ["name", "segment.code", "segment", "nation", "nowhere.0"]}


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.spans(_customers(spark, sf_dir).withColumn("id", F.try_variant_get("content", "$.id", "string")), _LEAVES)


@query(_SPANS)
def leaf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query(f"SELECT id, t AS text, sha256(t) AS digest FROM (SELECT id, '[Customer/' || id || ']' || chr(10) || string_agg('  ' || json_path || ': ' || value, chr(10) ORDER BY place) AS t FROM ({_SPANS}) GROUP BY id)")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.serialised(_spans(spark, sf_dir), ["id"], F.concat(F.lit("[Customer/"), F.col("id"), F.lit("]")))


@query("""SELECT c_custkey, sha256('{"key":' || c_custkey || ',"meta":{"tag":"t"},"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS hash FROM customer""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct(F.lit("3").alias("versionId"), F.lit("2024-01-01").alias("lastUpdated"), F.lit("t").alias("tag"))
    raw = F.to_json(F.struct(F.col("c_name").alias("name"), meta.alias("meta"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key")))
    return _read(spark, sf_dir, "customer").select("c_custkey", content_hash(raw).alias("hash"))


@query("SELECT user_id, event_id AS version, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def store_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type", "props")
    return store.heads(history, ["user_id"], "version")


@query("""WITH cur AS (SELECT user_id, max(event_id) AS v FROM events GROUP BY user_id),
inc AS (SELECT c.c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN coalesce(v, 0) - 1 ELSE coalesce(v, 0) END AS e FROM customer c LEFT JOIN cur ON cur.user_id = c_custkey)
SELECT inc.user_id, e AS expected_version, CASE WHEN v IS NULL THEN 'NOT_FOUND' WHEN v = e THEN 'updated' ELSE 'VERSION_CONFLICT' END AS outcome, CASE WHEN v = e THEN v + 1 END AS new_version FROM inc LEFT JOIN cur USING (user_id)""")
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("version_id"))
    stale = _read(spark, sf_dir, "customer").join(current, F.col("c_custkey") == F.col("user_id"), "left")
    version = F.coalesce("version_id", F.lit(0)) - F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)
    return store.update(current, stale.select(F.col("c_custkey").alias("user_id"), version.alias("expected_version")), ["user_id"])


_STATUS = "CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END"


def _audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("actor_id"), F.expr(_STATUS).alias("decision"), F.when(F.col("event_type") != "error", "v0").alias("matched_rule_id"), F.lit("2024-01-01T00:00:00.000Z").alias("occurred_at"),
        F.col("user_id").cast("string").alias("practice_id"), F.lit("TREAT").alias("purpose_of_use"), F.col("event_type").alias("reason"), F.lit("Patient").alias("resource_type"), F.col("event_id").alias("event_no"),
    )


_CHAIN = f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, {_STATUS} AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c(user_id, event_id, seq, prev_hash, row_hash) AS (
  SELECT user_id, event_id, seq, repeat('0', 64), sha256('{{"actor_id":"user-' || user_id || '","decision":"' || d || '","matched_rule_id":' || CASE WHEN d = 'allow' THEN '"v0"' ELSE 'null' END || ',"occurred_at":"2024-01-01T00:00:00.000Z","practice_id":"' || user_id || '","prev_hash":"' || repeat('0', 64) || '","purpose_of_use":"TREAT","reason":"' || event_type || '","resource_type":"Patient","seq":"' || seq || '"}}') FROM e WHERE seq = 1
  UNION ALL SELECT e.user_id, e.event_id, e.seq, c.row_hash, sha256('{{"actor_id":"user-' || e.user_id || '","decision":"' || d || '","matched_rule_id":' || CASE WHEN d = 'allow' THEN '"v0"' ELSE 'null' END || ',"occurred_at":"2024-01-01T00:00:00.000Z","practice_id":"' || e.user_id || '","prev_hash":"' || c.row_hash || '","purpose_of_use":"TREAT","reason":"' || event_type || '","resource_type":"Patient","seq":"' || e.seq || '"}}') FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
SELECT CAST(user_id AS VARCHAR) AS practice_id, event_id AS event_no, seq, prev_hash, row_hash FROM c"""


@query(_CHAIN)
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.appended(_audit_rows(spark, sf_dir)).select("practice_id", "event_no", "seq", "prev_hash", "row_hash")


@query("""SELECT CAST(user_id AS VARCHAR) AS practice_id, count(*) AS n_rows, min(CASE WHEN event_id % 50 = 0 THEN seq END) AS first_break, CASE WHEN min(CASE WHEN event_id % 50 = 0 THEN seq END) IS NOT NULL THEN 'row_hash_mismatch' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) GROUP BY user_id""")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = audit.appended(_audit_rows(spark, sf_dir))
    return audit.verified(chain.withColumn("reason", F.when(F.col("event_no") % 50 == 0, "tampered").otherwise(F.col("reason"))))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'purchase') AND user_id % 4 = 0 AND user_id % 3 = 0 THEN 'allow' ELSE 'deny' END AS decision,
CASE WHEN event_type IN ('view', 'purchase') AND user_id % 4 = 0 AND user_id % 3 = 0 THEN 'v0-clinician-treat' END AS rule FROM events""")
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in policy.ROLES]), (F.col("user_id") % 4).cast("int") + 1)
    purpose = F.when(F.col("event_type").isin("view", "purchase"), "TREAT").when(F.col("event_type") == "error", F.lit(None)).otherwise("HPAYMT")
    rule = policy.matched_rule(role, purpose, F.lit("t0"), F.lit("t0"), F.concat(F.lit("t"), F.col("user_id") % 3), F.lit("Observation"))
    return _read(spark, sf_dir, "events").select("event_id", policy.decision(rule).alias("decision"), rule.alias("rule"))


@query("SELECT user_id, CASE WHEN max(event_type = 'signup') AND max(event_type = 'purchase') THEN 'committed' WHEN max(event_type = 'signup') THEN 'approved' ELSE 'proposed' END AS state FROM events GROUP BY user_id")
def governance_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "signup", "approve").otherwise("propose")
    log = events.select("user_id", action.alias("action"))
    approved = log.filter("action = 'approve'").select("user_id").distinct().withColumn("ok", F.lit(True))
    legal = log.join(approved, "user_id", "left").filter("action <> 'commit' or ok").drop("ok")  # a legal log has no commit without an approve
    return policy.proposal_states(events, legal, "user_id")


@query("SELECT s, a, CASE WHEN s = 'proposed' AND a = 'approve' THEN 'approved' WHEN s = 'proposed' AND a = 'reject' THEN 'rejected' WHEN s = 'approved' AND a = 'commit' THEN 'committed' END AS after FROM (SELECT unnest(['proposed', 'approved', 'committed', 'rejected']) AS s), (SELECT unnest(['approve', 'commit', 'reject']) AS a)")
def governance_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.explode(F.array(*[F.lit(s) for s in ("proposed", "approved", "committed", "rejected")]))
    actions = F.explode(F.array(*[F.lit(a) for a in ("approve", "commit", "reject")]))
    grid = spark.range(1).select(states.alias("s")).select("s", actions.alias("a"))
    return grid.withColumn("after", policy.next_state(F.col("s"), F.col("a")))


@query("SELECT 'bound' AS session, count(*) AS n FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'unbound', 0")
def tenant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    counts = [bound_filter(customer, tenant, "c_nationkey").agg(F.count("*").alias("n")).select(F.lit(name).alias("session"), "n") for name, tenant in (("bound", 7), ("unbound", F.lit(None)))]
    return counts[0].unionAll(counts[1])


@query("SELECT p_partkey, 'parts' AS system, p_type AS code, CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN lower(p_type) END AS display, p_type IN ('STANDARD', 'ECONOMY') AS known, CASE WHEN p_type NOT IN ('STANDARD', 'ECONOMY') THEN 'unknown-code' END AS issue FROM part")
def terminology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    concepts = part.filter("p_type in ('STANDARD', 'ECONOMY')").select(F.lit("parts").alias("system"), F.col("p_type").alias("code")).distinct().withColumn("display", F.lower("code"))
    return terminology.checked_codes(part.select("p_partkey", F.lit("parts").alias("system"), F.col("p_type").alias("code")), concepts)


@query("""SELECT c_custkey, '/name' AS pointer, 'changed' AS kind, c_name AS expected, c_name || '!' AS actual FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey, '/segment', 'missing', c_mktsegment, NULL FROM customer WHERE c_custkey % 15 = 0
UNION ALL SELECT c_custkey, '/extra', 'unexpected', NULL, 'x' FROM customer WHERE c_custkey % 21 = 0""")
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    old = diff.flattened(customer, "c_custkey", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    altered = {"name": F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")), "segment": F.when(F.col("c_custkey") % 15 != 0, F.col("c_mktsegment")), "extra": F.when(F.col("c_custkey") % 21 == 0, "x")}
    return diff.difference(old, diff.flattened(customer, "c_custkey", altered), "c_custkey")


@query(r"""SELECT doc_id, sha256(m) AS value_sha256 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\(\d{3}\) \d{3}-\d{4}')) AS m FROM documents)
WHERE regexp_matches(regexp_replace(m, '[^0-9]', '', 'g'), '^[2-9][0-9]{2}[2-9]') AND NOT regexp_matches(regexp_replace(m, '[^0-9]', '', 'g'), '^[0-9]{3}55501')""")
def identifier_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(\d{3}\) \d{3}-\d{4}"), F.lit(0))).alias("m"))
    return found.filter(validators.nanp_valid(F.col("m")) & ~validators.fictional_phone(F.col("m"))).select("doc_id", F.sha2("m", 256).alias("value_sha256"))


@query("""WITH n AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919) % 10000000000 AS VARCHAR), 10, '0') AS npi FROM orders),
d AS (SELECT o_orderkey, npi, list_transform(range(1, 16), lambda i: CAST(substr('80840' || npi, i, 1) AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) AS x FROM n)
SELECT o_orderkey, npi, list_sum(list_transform(x, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)) % 10 = 0 AS valid FROM d""")
def npi_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    npi = F.lpad(((F.col("o_orderkey") * 7919) % 10000000000).cast("string"), 10, "0")
    return _read(spark, sf_dir, "orders").select("o_orderkey", npi.alias("npi")).withColumn("valid", validators.npi_valid(F.col("npi")))


@query("""WITH RECURSIVE d AS (SELECT [[CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN 5 + (a + b) % 5 WHEN b < 5 THEN 5 + (a - b) % 5 ELSE (a - b + 5) % 5 END FOR b IN range(0, 10)] FOR a IN range(0, 10)] AS t),
p(k, row) AS (SELECT 0, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] UNION ALL SELECT k + 1, list_transform([1, 5, 7, 6, 2, 8, 3, 0, 9, 4], lambda x: x) FROM p WHERE k < 0),
q(k, row) AS (SELECT 0, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] UNION ALL SELECT k + 1, list_transform(row, lambda x: [1, 5, 7, 6, 2, 8, 3, 0, 9, 4][x + 1]) FROM q WHERE k < 7),
perm AS (SELECT list(row ORDER BY k) AS rows FROM q),
c AS (SELECT o_orderkey, '1' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '10' || CAST(o_orderkey % 10 AS VARCHAR) AS code FROM orders)
SELECT o_orderkey, code, list_reduce(list_prepend(0, list_transform(range(0, len(code)), lambda i: perm.rows[(i % 8) + 1][CAST(reverse(code)[i + 1] AS INTEGER) + 1])), lambda a, b: d.t[a + 1][b + 1]) = 0 AS valid FROM c, d, perm""")
def verhoeff_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("1"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("10"), (F.col("o_orderkey") % 10).cast("string"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")).withColumn("valid", validators.sctid_valid(F.col("code")))


@query("""WITH r AS (SELECT sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS h FROM customer)
SELECT count(*) AS n_rows, sha256(concat_ws('|', CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 25, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 37, 12) AS BIGINT)) AS VARCHAR))) AS digest FROM r""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dump_digest(_read(spark, sf_dir, "customer"), exclude=["c_acctbal"])


@query("""SELECT c_custkey, sha256('{"name":"' || c_name || '","none":null,"segment":"' || c_mktsegment || '"}') AS hash FROM customer""")
def flat_canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", F.sha2(flat_canonical({"segment": F.col("c_mktsegment"), "name": F.col("c_name"), "none": F.lit(None).cast("string")}), 256).alias("hash"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def streaming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch result by way of a stream over the same file."""
    schema = _read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    name = f"streaming_counts_{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    counts = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    running = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)
