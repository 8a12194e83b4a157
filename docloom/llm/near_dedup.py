"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the distinct word shingles of its whole text: bytes A-Z lower-cased, words between ASCII
white space; a text of fewer words is one shingle; a null, empty or blank text has no set and links with nothing.
One 64-bit hash orders all shingles, and a document retains its k smallest. Documents with equal sets form one
class before anything is compared. Inverted lists of retained values generate candidates: two sets of similarity
0.8 share at least `least_overlap` retained values (all but about 1e-5 of borderline pairs of large sets, always for
sets within the sketch), so by the pigeonhole principle they share one of the `k - least + 1` rarest, and only those
lists are read; common passages are among a document's frequent values and rarely make a list. A set that fits the
sketch reads at least the lists that its exact prefix asks for.
Inside a list sets of at most EXACT shingles are compared whole; of larger ones the EXACT smallest shingles estimate
the similarity on the bottom of the union. The exact Jaccard similarity of the full sets confirms each link.
Null ids: the row is kept and belongs to no component. Rows with equal doc_id count as copies of one id when their
texts link. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Cuts, column, hashed_words, prepare, rows, shingle_set, signed, split_join
from docloom.llm.linkage import linked

EXACT = 512
_SKETCHED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("retained", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("items", pa.binary()), ("sketch", pa.binary())])


def least_overlap(k: int, percent: int = 80) -> int:
    """Values that the k-sketches of large sets of that similarity share: the mean less 4.4 standard deviations."""
    p = percent / 100
    return max(1, math.floor(k * p - 4.4 * math.sqrt(k * p * (1 - p))))


def least_overlap_of(n: Column, k: int, percent: int) -> Column:
    """The same for a set of n > 0.8 k items, whose union with a linked set has at most n / 0.8: a finite population."""
    p = percent / 100
    union = n / F.lit(p)
    deviation = F.sqrt(F.lit(k * p * (1 - p)) * F.greatest(union - F.lit(k), F.lit(0.0)) / F.greatest(union - F.lit(1), F.lit(1.0)))
    return F.floor(F.lit(k * p) - F.lit(4.4) * deviation)


def node_of(items: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(items.tobytes()))


def sketched(docs: DataFrame, k: int, words: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, nodes, retained = [], [], []
            hashes, starts = hashed_words(column(batch, "text"))
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                items = shingle_set(hashes[a:b], words)
                ns.append(len(items))
                nodes.append(node_of(items))
                retained.append(items[:k].view(np.int64))
            yield rows(_SKETCHED, doc_id=column(batch, "doc_id"), mark=column(batch, "mark"), n=ns, node=nodes, retained=retained)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(work, "doc_id long, mark long, n long, node long, retained array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ns, sets, sketches = [], [], [], []
            hashes, starts = hashed_words(column(batch, "text"))
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                items = shingle_set(hashes[a:b], words)
                nodes.append(node_of(items))
                ns.append(len(items))
                sets.append(items.tobytes())
                sketches.append((items[:EXACT] >> np.uint64(32)).astype("<u4").tobytes())
            yield rows(_SETS, node=nodes, n=ns, items=sets, sketch=sketches)

    return docs.select("text").mapInArrow(work, "node long, n long, items binary, sketch binary")


def near_duplicates(docs: DataFrame, k: int = 96, words: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept; and mark (a hash of the text)
    and first, which is true for one doc_id and mark of each component, and for rows that can't be linked."""
    spark = prepare(docs.sparkSession)
    cuts = Cuts(spark, "near-dedup")
    sketches = cuts.cut(sketched(docs, k, words))
    grouped = sketches.filter("n > 0 and doc_id is not null").groupBy("node")
    reps = cuts.cut(grouped.agg(F.min("doc_id").alias("rep"), F.min_by("mark", "doc_id").alias("mark"), F.first("n").alias("n"), F.first("retained").alias("retained"), F.count("*").alias("copies")))
    members = cuts.cut(sketches.select("doc_id", "mark", "n", "node"))
    cuts.drop(sketches)

    held = reps.select("node", F.explode("retained").alias("key"))
    counts = cuts.cut(held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("cnt", F.col("n")))
    shared = split_join(held, counts, "key", int(counts.agg(F.sum("n")).first()[0] or 0))
    by_node = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("cnt", "key"))).alias("shared"))
    # Values that nobody else retains come first in the order by frequency, so they use up the prefix first.
    kept_values = F.least(F.col("n"), F.lit(k))
    exact_prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1
    # A whole set of up to k items meets whole sets, where only the exact prefix is safe, and sketches of larger ones.
    sketch_prefix = kept_values - least_overlap_of(F.col("n"), k, percent) + 1
    prefix = F.when(F.col("n") <= F.lit(k * percent // 100), exact_prefix).when(F.col("n") <= F.lit(k), F.greatest(exact_prefix, sketch_prefix)).otherwise(sketch_prefix)
    room = (prefix - (kept_values - F.size("shared"))).cast("int")
    listed = by_node.join(reps.select("node", "n", "rep"), "node").withColumn("room", room).filter("room > 0")
    listed = cuts.cut(listed.select("node", "rep", F.explode(F.slice("shared", F.lit(1), F.col("room"))).alias("e")).select("node", "rep", "e.key", "e.cnt"))
    lists = listed.groupBy("key").agg(F.count("*").alias("cnt")).filter("cnt > 1")
    listed = listed.drop("cnt").join(lists, "key")

    wanted = listed.select(F.col("rep").alias("doc_id")).distinct()
    sets = cuts.cut(full_sets(docs.join(wanted, "doc_id", "left_semi"), words).dropDuplicates(["node"]))
    lists = listed.select("key", "cnt", "node")
    least = least_overlap(EXACT, percent)

    def rule(n_a: np.ndarray, n_b: np.ndarray, common: np.ndarray) -> np.ndarray:
        exact = 100 * common >= percent * (n_a + n_b - common)
        size = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
        return np.where((n_a <= EXACT) & (n_b <= EXACT), exact, size & (common >= least))

    def confirm(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
        if n_a <= EXACT and n_b <= EXACT:
            return True
        both = np.sort(np.concatenate([a, b]))
        twice = both[1:] == both[:-1]
        ranks = np.arange(len(both) - 1) - np.cumsum(twice)  # one less than the distinct union values before
        return int(np.count_nonzero(twice & (ranks < EXACT - 1))) >= least

    labels = linked(lists, rule, confirm, EXACT, sets, percent, cuts)
    own = F.struct(F.col("rep").alias("component_id"), F.col("mark").alias("first_mark"))
    reach = labels.join(reps.select("node", own.alias("own")), "node")
    smallest = reach.groupBy("comp").agg(F.min("own").alias("least"))
    of_node = reps.select("node", own.alias("own"), F.col("copies").alias("n")).join(labels, "node", "left").join(smallest, "comp", "left")
    of_node = cuts.cut(of_node.select("node", "n", F.coalesce("least", "own").alias("least")).select("node", "n", "least.*"))
    cuts.drop(sets)
    linked_rows = split_join(members.filter("n > 0 and doc_id is not null").withColumnRenamed("n", "n_shingles"), of_node, "node", members.count())
    alone = members.filter("n = 0 or doc_id is null").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("mark").alias("first_mark"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked_rows.drop("node").unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "mark", (kept & (F.col("mark") == F.col("first_mark"))).alias("first"))
