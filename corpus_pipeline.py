"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to the documents table, each written
as Parquet to the shared folder and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from docloom.llm.common import prepare, remove_folder, scratch, shared_dir, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject."""
    prepare(spark)
    chain = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, chain)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; a document that loses all its text goes."""
    found = line_dedup.line_deduplicated(docs, prefix="__lines_").filter("__lines_n_removed = 0 or length(trim(text)) > 0")
    size = F.when(F.col("__lines_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (four-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows equal in doc_id and text are one document, of which one row stays; of two texts under one doc_id only the one that
    is a near copy of a smaller doc_id goes, or of two copies one. Rows without doc_id stay. A text without words has no
    copies."""
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    single = marked.filter("doc_id is not null").dropDuplicates(["doc_id", "__mark"])
    gone = near_dedup.near_duplicates(docs).filter("not first and doc_id is not null").select("doc_id", F.col("mark").alias("__mark")).distinct()
    return single.join(gone.hint("merge"), ["doc_id", "__mark"], "left_anti").unionByName(marked.filter("doc_id is null")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from the texts."""
    found = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", into_sequences),
]

#: The classifier, the line chunks and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
        if k:
            remove_folder(spark, f"{root}/{k - 1}")
    return docs
