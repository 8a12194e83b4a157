"""Benchmark passages in training documents, found by an FM-index over each shard of documents.

Words are runs of ASCII letters, digits and non-ASCII bytes after A-Z are lower-cased. Every run of `window` words of
a benchmark item is a phrase; a shorter item with words is one phrase. A shard gathers whole documents up to a number
of words. Its text is written in the phrases' alphabet (any other word is a separator, and separators stand once), a
suffix array gives the Burrows-Wheeler transform, a wavelet matrix over it gives ranks, all phrases are searched
backwards at once, and occurrences are located by stepping back to sampled suffix positions. Overlapping hits merge
to removal spans. The phrases are broadcast in blocks of bounded size.

Null texts have no words; null or blank items give no phrase; equal items count each by their item_id; an item
without an id counts as hit words but not among the items.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, prepare, rows, utf8

BLOCK_BYTES = 16 << 20
SHARD_WORDS = 400_000
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class Phrases:
    """The distinct phrases of a block of benchmark items, as symbols; symbol 0 ends a shard, 1 separates."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.symbols: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in words_of(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                owners[tuple(ids[k : k + size])].add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list]]] = {}
        for size in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == size]
            self.by_length[size] = (np.array(own, dtype=np.int64), [sorted(i for i in owners[p] if i is not None) for p in own])
        self.least = min(self.by_length, default=0)


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of queries at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int64))
            self.zeros.append(int(len(values) - bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        begin, end = np.zeros_like(ends), ends
        for k in range(self.levels):
            bit = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - begin


def suffix_array(values: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last value is the unique smallest."""
    _, rank = np.unique(values, return_inverse=True)
    rank, step, count = rank.astype(np.int64), 1, len(values)
    while True:
        ahead = np.zeros(count, dtype=np.int64)
        ahead[: count - step] = rank[step:] + 1
        key = rank * (count + 1) + ahead
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank[order] = fresh
        if fresh[-1] == count - 1 or step >= count:
            return order
        step *= 2


class FMIndex:
    def __init__(self, values: np.ndarray, sample: int = 8):
        """values end with the unique symbol 0."""
        order = suffix_array(values)
        self.last = values[order - 1]
        self.tree = WaveletMatrix(self.last, int(values.max()))
        counts = np.bincount(values, minlength=int(values.max()) + 2)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.top = int(values.max())
        self.marked = order % sample == 0
        self.samples = order[self.marked]
        self.marks = np.concatenate([[0], np.cumsum(self.marked)])
        self.size = len(values)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases of one length: numbers of those that occur, and their row ranges."""
        alive = np.flatnonzero((phrases <= self.top).all(axis=1))
        low, high = np.zeros(len(alive), dtype=np.int64), np.full(len(alive), self.size, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            symbol = phrases[alive, k]
            low = self.less[symbol] + self.tree.rank(symbol, low)
            high = self.less[symbol] + self.tree.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        place, steps, todo = np.empty(len(row), dtype=np.int64), 0, np.arange(len(row))
        while len(todo):
            known = self.marked[row]
            place[todo[known]] = self.samples[self.marks[row[known]]] + steps
            todo, row = todo[~known], row[~known]
            symbol = self.last[row]
            row = self.less[symbol] + self.tree.rank(symbol, row)
            steps += 1
        return place


def shard_hits(texts: list[np.ndarray], phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each phrase length: (start in the shard's words, phrase number, length) arrays of all occurrences."""
    if not phrases.least:
        return
    gap = np.ones(1, dtype=np.int64)
    joined = np.concatenate([x for t in texts for x in (t, gap)])
    real = joined > 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], real.astype(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    long_runs = end - begin >= phrases.least  # a shorter run of known words holds no phrase
    begin, end = begin[long_runs], end[long_runs]
    if not len(begin):
        return
    sizes = end - begin + 1  # with the separator after it
    shift = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    source = np.arange(int(sizes.sum())) + shift
    reduced = np.concatenate([joined[source], [0]])
    index = FMIndex(reduced)
    for size, (own, _) in phrases.by_length.items():
        found, low, high = index.search(own)
        if len(found):
            counts = high - low
            row = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            yield source[index.locate(row)], np.repeat(found, counts), size


_FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.list_(pa.int64())))])


def found_in(texts: list[list[bytes]], blocks: list) -> list[tuple[int, int, list[int], list[list[int]]]]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    change = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
    items: dict[int, set] = defaultdict(set)
    for block in blocks:
        phrases = block if isinstance(block, Phrases) else block.value
        get = phrases.symbols.get
        ids = [np.fromiter(map(get, t, repeat(1)), dtype=np.int64, count=len(t)) for t in texts]
        for place, which, size in shard_hits(ids, phrases):
            np.add.at(change, place, 1)
            np.add.at(change, place + size, -1)
            doc = np.searchsorted(starts, place, side="right") - 1
            owners = phrases.by_length[size][1]
            for d, p in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                items[d].update(owners[p])
    hit = np.cumsum(change)[:-1] > 0
    out = []
    counts = np.add.reduceat(np.concatenate([hit, [False]]).astype(np.int64), starts[:-1]) if len(texts) else []
    for d in range(len(texts)):
        spans = []
        if counts[d]:
            own = hit[starts[d] : starts[d] + lengths[d]].astype(np.int8)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
            spans = edges.reshape(-1, 2).tolist()
        out.append((int(lengths[d]), int(counts[d]), sorted(items.get(d, ())), spans))
    return out


def phrase_blocks(benchmark: DataFrame, window: int) -> list:
    """Broadcast blocks of phrases; each holds items of at most BLOCK_BYTES (a longer single item stands alone)."""
    spark = benchmark.sparkSession
    held: list[tuple[int | None, bytes]] = []
    size, blocks = 0, []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text is not null").toLocalIterator():
        if held and size + len(row["text"]) > BLOCK_BYTES:
            blocks.append(spark.sparkContext.broadcast(Phrases(held, window)))
            held, size = [], 0
        held.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
    return [*blocks, spark.sparkContext.broadcast(Phrases(held, window))]


def _shards(batches: Iterator[pa.RecordBatch], blocks: list) -> Iterator[tuple[pa.RecordBatch, list]]:
    held: list[pa.RecordBatch] = []
    texts: list[list[bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list]]:
        at, found = 0, found_in(texts, blocks)
        for part in held:
            yield part, found[at : at + part.num_rows]
            at += part.num_rows

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            own = [words_of(t) for t in utf8(part, "text")]
            held.append(part)
            texts += own
            size += sum(map(len, own))
            if size >= SHARD_WORDS:
                yield from flush()
                held, texts, size = [], [], 0
    if held:
        yield from flush()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans ([first word, word after]) per document."""
    prepare(docs.sparkSession)
    blocks = phrase_blocks(benchmark, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _shards(batches, blocks):
            words, hits, items, spans = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *rows(_FOUND, n_words=words, n_hit=hits, items=items, spans=spans).columns], names=["doc_id", *_FOUND.names])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_words long, n_hit long, items array<long>, spans array<array<long>>")
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def without_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the bytes from each span's first word to the end of its last."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, after in spans:
        out.append(text[at : places[first][0]])
        at = places[after - 1][1]
    return b"".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with the removal spans cut from text; all columns and rows stay."""
    prepare(docs.sparkSession)
    blocks = phrase_blocks(benchmark, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _shards(batches, blocks):
            at = part.schema.get_field_index("text")
            texts = [t if t is None or not f[3] else without_spans(t, f[3]) for t, f in zip(utf8(part, "text"), found, strict=True)]
            yield part.set_column(at, "text", pa.array([None if t is None else t.decode() for t in texts], pa.string()))

    return docs.mapInArrow(work, docs.schema)
