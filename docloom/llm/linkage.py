"""Links of similar sets without all pairs of a group: candidate lists, verification and components.

Lists of items that share a rare key are compared inside tasks on sketches. Sets that fit the sketch are decided there,
larger ones by an estimate. A first round sends on only a spanning forest of each list, exact links before estimated ones,
so a group of n near copies yields n - 1 pairs and not n * n. A list of more than BLOCK items is dealt out in blocks, so no
task holds a whole hot list; in the first round each block is compared alone. Blocks are dealt anew for each key, and
near copies share many keys, so a family of n of them falls into one component after n * BLOCK comparisons, not n * n.
After the forests are verified on full sets, a second round compares all blocks of those lists that still hold several
components: long lists, lists with sets larger than the sketch, and lists where a pair was refused (an overlap is counted
on 32-bit halves, so a chance match could have taken a true link's place). No partner is capped. Sketches are joined to
lists only where they are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Cuts, column, in_groups

BLOCK = 512
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def blocked(lists: DataFrame, alone: bool = False) -> DataFrame:
    """(key, cnt, node, ...) to rows for each pair of blocks (i, j) of a list, or for each block with itself; cnt bounds the
    list's length."""
    blocks = F.ceil(F.col("cnt") / F.lit(BLOCK)).cast("int")
    dealt = lists.withColumn("own", F.pmod(F.xxhash64("node", "key"), blocks.cast("long")).cast("int"))
    if alone:
        return dealt.withColumn("i", F.col("own")).withColumn("j", F.col("own")).drop("cnt")
    return (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - F.lit(1))))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("other", "cnt")
    )


def _overlaps(sketches: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
    """How many sketch values each two items share."""
    values, which, times = np.unique(sketches, return_inverse=True, return_counts=True)
    keep = times[which] > 1
    _, which = np.unique(which[keep], return_inverse=True)
    owners = owners[keep]
    total = np.zeros((count, count), dtype=np.float32)
    width = int(which.max()) + 1 if len(which) else 0
    for begin in range(0, width, 4096):
        inside = (which >= begin) & (which < begin + 4096)
        part = np.zeros((count, min(4096, width - begin)), dtype=np.float32)
        part[owners[inside], which[inside] - begin] = 1
        total += part @ part.T
    return total


def _list_pairs(group: pa.Table, rule: Callable, confirm: Callable, exact_size: int) -> Iterator[tuple[int, int]]:
    nodes = group.column("node").to_numpy()
    nodes, first = np.unique(nodes, return_index=True)
    if len(nodes) < 2:
        return
    own = group.column("own").to_numpy()[first]
    sizes = group.column("n").to_numpy()[first]
    comps = group.column("comp").to_numpy()[first]
    raw = group.column("sketch").combine_chunks() if group.num_rows else []
    sketches = [np.frombuffer(raw[int(k)].as_buffer(), dtype=np.uint32) for k in first]
    i, j, every = (group.column(c)[0].as_py() for c in ("i", "j", "every"))
    if len(nodes) == 2:
        shared = np.intersect1d(sketches[0], sketches[1], assume_unique=True).size
        left, right, common = np.array([0]), np.array([1]), np.array([shared])
    else:
        owners = np.repeat(np.arange(len(nodes)), [len(s) for s in sketches])
        overlap = _overlaps(np.concatenate(sketches), owners, len(nodes))
        left, right = np.nonzero(np.triu(overlap, 1))
        common = overlap[left, right].astype(np.int64)
    fits = rule(sizes[left], sizes[right], common) & (comps[left] != comps[right])
    if i != j:
        fits &= own[left] != own[right]
    large = np.maximum(sizes[left], sizes[right]) > exact_size
    left, right, common, large = left[fits], right[fits], common[fits], large[fits]
    if every:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if confirm(sketches[a], sketches[b], sizes[a], sizes[b]):
                yield int(nodes[a]), int(nodes[b])
        return
    above = list(range(len(nodes)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    order = np.lexsort((-common / (sizes[left] + sizes[right]), large))
    for a, b in zip(left[order].tolist(), right[order].tolist(), strict=True):
        p, q = top(a), top(b)
        if p != q and confirm(sketches[a], sketches[b], sizes[a], sizes[b]):
            above[max(p, q)] = min(p, q)
            yield int(nodes[a]), int(nodes[b])


def list_pairs(lists: DataFrame, sets: DataFrame, rule: Callable, confirm: Callable, exact_size: int) -> DataFrame:
    """Candidate pairs (a < b) of blocked lists (key, i, j, own, node, comp, every); sets hold node, n and the sketch as
    little-endian uint32. A list with every yields all its pairs of different comp, another one a forest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in in_groups(batches, ["key", "i", "j"]):
            for x, y in _list_pairs(group, rule, confirm, exact_size):
                a.append(x)
                b.append(y)
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)

    entries = lists.join(sets.select("node", "n", "sketch"), "node")
    dealt = entries.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "own", "node", "n", "comp", "every", "sketch").mapInArrow(work, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets (node, items: sorted uint64 bytes) have 100 * |A and B| >= percent * |A or B|."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "items_a"), column(batch, "items_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(mask), column(batch, "b").filter(mask)], schema=_PAIRS)

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b").mapInArrow(work, "a long, b long")


def components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node of the component.

    Each round hooks a component onto its smallest neighbour, follows the hooks to their ends and contracts the
    edges, so the number of components at least halves; every step is a join, and each round is cut."""
    live = cuts.cut(edges.filter("a <> b").select("a", "b").distinct())
    labels = cuts.cut(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hooks = cuts.cut(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        while True:  # follow hooks until all point at roots; they only ever decrease
            ahead = hooks.select(F.col("c").alias("up"), F.col("up").alias("next"))
            jumped = cuts.cut(hooks.join(ahead, "up").select("c", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
            cuts.drop(hooks)
            hooks = jumped
            if hooks.filter("moved").isEmpty():
                break
        to = hooks.select(F.col("c").alias("comp"), "up")
        new_labels = cuts.cut(labels.join(to, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        ends = to.select(F.col("comp").alias("a"), F.col("up").alias("ua"))
        ends_b = to.select(F.col("comp").alias("b"), F.col("up").alias("ub"))
        contracted = live.join(ends, "a").join(ends_b, "b").filter("ua <> ub")
        new_live = cuts.cut(contracted.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        cuts.drop(live, labels, hooks)
        live, labels = new_live, new_labels
    cuts.drop(live)
    return labels


def linked(lists: DataFrame, rule: Callable, confirm: Callable, exact_size: int, sets: DataFrame, percent: int, cuts: Cuts) -> DataFrame:
    """(node, comp) of lists (key, cnt, node) and sets (node, n, items, sketch); nodes without a link may be missing.

    rule and confirm must be exact for pairs of sets of at most exact_size items, and may not refuse a linked pair."""
    first = blocked(lists, alone=True).withColumn("comp", F.col("node")).withColumn("every", F.lit(False))
    tried = cuts.cut(list_pairs(first, sets, rule, confirm, exact_size))
    edges = cuts.cut(verified(tried, sets, percent))
    labels = components(edges, cuts)
    refused = tried.join(edges, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    doubt = sets.select("node", (F.col("n") > exact_size).alias("large")).join(refused.withColumn("refused", F.lit(True)), "node", "left")
    doubt = doubt.select("node", (F.col("large") | F.coalesce("refused", F.lit(False))).alias("doubt")).filter("doubt")
    marked = lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(doubt, "node", "left")
    marked = cuts.cut(marked.withColumn("doubt", F.coalesce("doubt", F.lit(False))))
    by_key = marked.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("doubt").alias("every"), F.max("cnt").alias("longest"))
    still = by_key.filter((F.col("least") != F.col("most")) & (F.col("every") | (F.col("longest") > BLOCK))).select("key", "every")
    rest = cuts.cut(blocked(marked.drop("doubt").join(still, "key")))
    more = cuts.cut(list_pairs(rest, sets, rule, confirm, exact_size).join(tried, ["a", "b"], "left_anti"))
    more = cuts.cut(verified(more, sets, percent))
    return labels if more.isEmpty() else components(edges.union(more), cuts)
