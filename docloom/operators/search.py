"""Hybrid retrieval: a lexical and a vector arm, each a top-k, fused by reciprocal ranks.

The lexical score of a document that holds all query words is the sum of ln(1 + occurrences) over the distinct query
words; ties go to the smaller id. Only ranks reach the fusion.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARM_LIMIT = 40
RRF_K = 60
DIMENSIONS = 384
#: Scores rank on this many places: values that differ in a last bit only, by the order of a sum, count as ties.
RANK_PLACES = 12
#: Types that search covers and fields whose concepts, notes and names make a document's text (fixed values).
SEARCHABLE = ("Patient", "Encounter", "Condition", "Observation", "MedicationRequest", "AllergyIntolerance", "Procedure", "DocumentReference")
CONCEPT_FIELDS = ("code", "medicationCodeableConcept", "type", "clinicalStatus", "category")


def document_text(content: Column) -> Column:
    """A document's searchable text: concepts (text, then display and code of each coding) of the concept fields, notes, the
    value as string, quantity or concept, names, attachments (url, title); empty strings are left out."""
    from docloom.functions.paths import bound, member

    def concept(items: Column) -> Column:
        return F.flatten(F.transform(items, lambda c: F.concat(member(F.array(c), "text"), F.flatten(F.transform(member(F.array(c), "coding"), lambda d: F.concat(member(F.array(d), "display"), member(F.array(d), "code")))))))

    def parts(root: Column) -> Column:
        quantity = member(root, "valueQuantity")
        amount = F.filter(member(quantity, "value"), lambda v: F.schema_of_variant(v).rlike("^(?!STRING|ARRAY|OBJECT|BOOLEAN)"))
        names = F.flatten(F.transform(member(root, "name"), lambda n: F.concat(member(F.array(n), "family"), member(F.array(n), "given"))))
        files = F.flatten(F.transform(member(member(root, "content"), "attachment"), lambda a: F.concat(member(F.array(a), "url"), member(F.array(a), "title"))))
        texts = F.concat(*[concept(member(root, f)) for f in CONCEPT_FIELDS], member(member(root, "note"), "text"), member(root, "valueString"))
        string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        before = F.transform(texts, string)
        middle = F.transform(amount, lambda v: F.to_json(v))
        after = F.transform(F.concat(member(quantity, "unit"), concept(member(root, "valueCodeableConcept")), names, files), string)
        return F.filter(F.concat(before, middle, after), lambda t: t.isNotNull() & (t != ""))

    return F.trim(F.concat_ws(" ", bound(F.array(content), parts)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def hashed_embedding(frame: DataFrame, key: str, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, bucket, weight: the non-zero entries of the unit vector of signed hashed word counts."""
    digest = F.sha2(F.col("w"), 256)
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    each = frame.select(key, F.explode(words(text)).alias("w")).select(key, bucket.alias("bucket"), sign.alias("s"))
    sums = each.groupBy(key, "bucket").agg(F.sum("s").alias("s")).filter("s <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return sums.join(norms, key).select(key, "bucket", (F.col("s") / F.col("norm")).alias("weight"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("__w", lambda w: w == term))


def lexical_arm(frame: DataFrame, key: str, text: str, query: str, limit: int = ARM_LIMIT) -> DataFrame:
    """key, score, rank of the best documents that hold all words of the query."""
    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    if not terms:
        return frame.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    cheap = frame
    for term in terms:  # a substring test first, so that most texts are never split
        cheap = cheap.filter(F.lower(F.col(text)).contains(term))
    counts = [_occurrences(t) for t in terms]
    counted = cheap.select(key, words(F.col(text)).alias("__w")).select(key, *[c.alias(f"__c{i}") for i, c in enumerate(counts)])
    score = sum((F.log(F.lit(1.0) + F.col(f"__c{i}")) for i in range(1, len(terms))), F.log(F.lit(1.0) + F.col("__c0")))
    found = counted.filter(" and ".join(f"__c{i} > 0" for i in range(len(terms)))).select(key, F.round(score, RANK_PLACES).alias("score"))
    return _ranked(found.orderBy(F.desc("score"), key).limit(limit), F.desc("score"), key).withColumn("score", F.round("score", 6))


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_arm(frame: DataFrame, key: str, embedding: str, query: list[float], limit: int = ARM_LIMIT) -> DataFrame:
    """key, dist, rank of the nearest vectors; a zero query vector has no arm."""
    if not any(query):
        return frame.select(key, F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    target = F.array(*[F.lit(float(x)) for x in query])
    norm = F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    products = F.zip_with(embedding, target, lambda p, q: F.struct((p.cast("double") * q).alias("d"), (p.cast("double") * p.cast("double")).alias("s")))
    sums = F.aggregate(products, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s")), lambda a, v: F.struct((a["d"] + v["d"]).alias("d"), (a["s"] + v["s"]).alias("s")))
    found = frame.select(key, sums.alias("__s")).select(key, F.round(F.lit(1.0) - F.try_divide(F.col("__s.d"), F.sqrt("__s.s") * norm), RANK_PLACES).alias("dist")).filter("dist is not null")
    return _ranked(found.orderBy("dist", key).limit(limit), F.asc("dist"), key).withColumn("dist", F.round("dist", 6))


def _ranked(top: DataFrame, order: Column, key: str) -> DataFrame:
    """Ranks of an arm; the single window partition holds at most the arm's limit."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(order, F.col(key))))


def fused(arms: list[DataFrame], key: str, limit: int = 20) -> DataFrame:
    """key, score: the sum of 1 / (60 + rank) over the arms, best first."""
    union = arms[0].select(key, "rank")
    for arm in arms[1:]:
        union = union.unionAll(arm.select(key, "rank"))
    scored = union.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("rank"))).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(min(100, max(1, limit)))


def search(frame: DataFrame, key: str, text: str, embedding: str, query: str, vector: list[float], allowed: list[str], type_column: str, limit: int = 20) -> DataFrame:
    """Scope first: without an allowed type nothing is read."""
    if not allowed:
        return frame.select(key, F.lit(0.0).alias("score")).limit(0)
    inside = frame.filter(F.col(type_column).isin(*allowed))
    return fused([lexical_arm(inside, key, text, query), vector_arm(inside, key, embedding, vector)], key, limit)


def web_query(query: str) -> list[tuple[list[str], list[str]]]:
    """A web search: alternatives ("or"), each with phrases that must stand in a text and phrases that must not ("-").
    Unquoted words are phrases of one word."""
    out: list[tuple[list[str], list[str]]] = [([], [])]
    for minus, quoted, plain in re.findall(r'(-?)"([^"]*)"?|(\S+)', query.lower()):
        if plain == "or":
            out.append(([], []))
            continue
        negative = bool(minus) or plain.startswith("-")
        phrase = " ".join(re.findall("[a-z0-9]+", quoted or plain))
        if phrase:
            out[-1][negative].append(phrase)
    return [(must, must_not) for must, must_not in out if must or must_not]


def matches_web(text: Column, query: str) -> Column:
    """Whether a text answers the web search; a query without words answers nothing."""
    padded = F.concat(F.lit(" "), F.concat_ws(" ", words(text)), F.lit(" "))
    hit = F.lit(False)
    for must, must_not in web_query(query):
        own = F.lit(True)
        for phrase in must:
            own = own & padded.contains(f" {phrase} ")
        for phrase in must_not:
            own = own & ~padded.contains(f" {phrase} ")
        hit = hit | own
    return hit


def hits(found: DataFrame, documents: DataFrame, key: str, columns: list[str], model_id: str | None = None) -> DataFrame:
    """found (key, score) with the documents' columns; only documents indexed by the model, where one is named."""
    kept = documents if model_id is None else documents.filter(F.col("model_id").eqNullSafe(model_id))
    return found.join(kept.select(key, *columns), key)


def first_seen(found: DataFrame, key: str, rank: str) -> DataFrame:
    """The best-ranked row of each key."""
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(key, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def page(frame: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, bool]:
    """The first rows in order and whether there are more; one row more than the limit is read."""
    probe = frame.orderBy(*order).limit(limit + 1)
    return probe.limit(limit), probe.count() > limit


def unresolved(asked: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Asked keys that the table doesn't hold."""
    return asked.select(*key).distinct().join(table.select(*key), key, "left_anti")


def reindexed(index: DataFrame, changed: DataFrame, model_id: str, key: list[str]) -> DataFrame:
    """The search table (key, resource_type, content_text, model_id, source_version_id) after changed documents (key, type,
    version_id, content) were indexed anew; a document of an older version than the indexed one changes nothing."""
    fresh = changed.filter(F.col("type").isin(*SEARCHABLE)).select(*key, F.col("type").alias("resource_type"), document_text(F.col("content")).alias("content_text"), F.lit(model_id).alias("model_id"), F.col("version_id").alias("source_version_id"))
    both = index.unionByName(fresh)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "source_version_id").alias("__r")).select(*key, *[F.col(f"__r.`{c}`").alias(c) for c in rest])
