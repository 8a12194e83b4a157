"""Plug-ins: embedding, rerank, token counting and terminology, each a plain function over a batch of values.

A provider runs inside Arrow batches on the executors, so it must be picklable; it never sees a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import policy, search
from docloom.operators.context import token_count


@dataclass(frozen=True)
class EmbeddingProvider:
    """embed: texts -> vectors of `dimensions` numbers; model_id names the space they live in."""

    model_id: str
    dimensions: int
    embed: Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class RerankProvider:
    """score: (query, texts) -> a number for each text, larger is better."""

    score: Callable[[str, list[str]], list[float]]


@dataclass(frozen=True)
class Providers:
    embedding: EmbeddingProvider | None = None
    rerank: RerankProvider | None = None
    tokens: Callable[[Column], Column] = token_count
    terminology: Callable[[DataFrame], DataFrame] | None = None


def _with_batches(frame: DataFrame, name: str, kind: str, make: Callable[[pa.RecordBatch], list], arrow: pa.DataType) -> DataFrame:
    columns = frame.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + f", `{name}` {kind}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(make(batch), arrow)], names=[*columns, name])

    return frame.mapInArrow(work, schema)


def embedded(frame: DataFrame, text: str, provider: EmbeddingProvider, name: str = "embedding") -> DataFrame:
    """frame with the text's vector and model_id; a vector of another length fails."""
    place = frame.columns.index(text)

    def make(batch: pa.RecordBatch) -> list:
        found = provider.embed([t or "" for t in batch.column(place).to_pylist()])
        if any(len(v) != provider.dimensions for v in found):
            raise ValueError("EMBEDDING_DIMENSIONS_INVALID")
        return found

    return _with_batches(frame, name, "array<double>", make, pa.list_(pa.float64())).withColumn("model_id", F.lit(provider.model_id))


def reranked(found: DataFrame, key: str, text: str, query: str, provider: RerankProvider | None, limit: int = 20) -> DataFrame:
    """found (key, score, text) in the provider's order, or as it is without one. found is an arm's few rows."""
    if provider is None:
        return found
    place = found.columns.index(text)
    scored = _with_batches(found, "__s", "double", lambda b: [float(x) for x in provider.score(query, [t or "" for t in b.column(place).to_pylist()])], pa.float64())
    return scored.orderBy(F.desc("__s"), key).limit(limit).withColumnRenamed("__s", "rerank_score")


def search_clinical(documents: DataFrame, key: str, query: str, vector: list[float], request: dict[str, str], model_id: str, occurred_at: str, providers: Providers | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The hits of one search and its audit receipt (one row).

    documents: key, practice_id, resource_type, content_text, embedding, model_id. request: actor_id, role, purpose,
    practice_id. The scope is derived first: without an allowed type nothing is read, and the receipt says deny."""
    spark, providers = documents.sparkSession, providers or Providers()
    allowed = list(policy.CLINICAL_TYPES) if request["role"] == "clinician" and request["purpose"] == "TREAT" else []
    inside = documents.filter((F.col("practice_id") == request["practice_id"]) & F.col("model_id").eqNullSafe(model_id))
    best = search.search(inside, key, "content_text", "embedding", query, vector, allowed, "resource_type", limit)
    found = search.hits(best, inside, key, ["resource_type", "content_text"], model_id)
    found = reranked(found, key, "content_text", query, providers.rerank, limit)
    texts = {"decision": "allow" if allowed else "deny", "reason": f"search types={len(allowed)} limit={limit}"}
    lit = F.lit
    row = policy.receipt(lit(texts["decision"]), lit(request["actor_id"]), lit(request["practice_id"]), lit(request["purpose"]), lit(texts["reason"]), lit(occurred_at), lit("v0-clinician-treat") if allowed else None)
    return found, spark.range(1).select(row.alias("r")).select("r.*")
