"""Token-id shard files compressed by Re-Pair grammars, with random access.

Documents are dealt by range of doc_id into shards of bounded size, encoded, and every document ends with id 2.
Per shard the grammar is grown in rounds: all adjacent pairs are counted, the most frequent pairs become nonterminals,
and their occurrences are replaced from the left; this goes on until no pair occurs `least` times (a rule costs three
numbers, so a pair of fewer occurrences would not pay). A round replaces many pairs, the next one counts what is left. No
rule contains the end id, so each document is a run of symbols of its own. A shard file is one binary value of a Parquet
table in the shared folder (Spark's committer writes it, so a lost executor leaves no half file). Layout, all
little-endian: "RPG1", counts (rules, symbols, documents, ids), rules as uint32 pairs, expansion lengths as uint32, symbols
as uint32, doc_ids as int64, the symbol offset of each document as int64, and the number of ids before each document as
int64.

Null texts are empty (one end id). Null doc_ids come first. Rows with equal doc_id are ordered by their text's hash. Other
columns, whatever their names, are ignored. A document longer than a shard is a shard of its own, held by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import uuid
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import column, partitions_for, prepare, rows, shared_dir, text_bytes
from docloom.llm.tokens import END_ID, default_vocabulary, word_tokens

#: Ids below this are terminals; nonterminal k is FIRST_RULE + k.
FIRST_RULE = 1 << 17
SHARD_BYTES = 6 << 20
_NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<4sQQQQ")


def ordered(docs: DataFrame, target_bytes: int) -> DataFrame:
    """doc_id and text dealt into ranges of ascending doc_id of about that many bytes, sorted within each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    return docs.repartitionByRange(partitions_for(docs, "text", target_bytes), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)


def _replaced(ids: np.ndarray, pair_of: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace the hits (positions of pairs), taking overlapping ones from the left; pair_of gives each the new symbol.
    Also the places of the new symbols. A hit that is not taken shares an id with the one before it, so it is gone too."""
    if len(hit) > 1:
        # Of runs of touching hits every second one from a run's start.
        start = np.flatnonzero(np.concatenate([[True], hit[1:] - hit[:-1] != 1]))
        odd = np.zeros(len(hit), dtype=bool)
        odd[1::2] = True
        take = np.flatnonzero(odd == np.repeat(odd[start], np.diff(start, append=len(hit))))
        hit, pair_of = hit[take], pair_of[take]
    ids[hit] = pair_of
    keep = np.ones(len(ids), dtype=bool)
    keep[hit + 1] = False
    return ids[keep], hit - np.arange(len(hit))


def sorted_pairs(left: np.ndarray, right: np.ndarray, width: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols of `width` bits (left << width | right) in ascending order, and the place of each.

    One sort of pairs with their places in the low bits is much faster than a sort of the places by their pairs."""
    keys = left.astype(np.uint64)
    keys <<= width
    keys |= right
    below = np.uint64(len(keys).bit_length())
    if 2 * width + below > 64:
        places = np.argsort(keys, kind="stable")
        return keys[places], places
    keys <<= below
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    places = (keys & ((np.uint64(1) << below) - np.uint64(1))).view(np.int64)
    keys >>= below
    return keys, places


def repair(ids: np.ndarray, least: int = 8, per_round: int = 32768) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (k, 2) of a Re-Pair grammar of ids; the end id stands in no rule.

    Two old symbols that are neighbours were neighbours before, so a round that replaced every pair worth it leaves only
    pairs with a new symbol to count: the next round looks at the places next to new symbols and nowhere else."""
    ids = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = 0
    where = None  # positions of the pairs to count; None: all
    while len(ids) > 1:
        left, right = (ids[:-1], ids[1:]) if where is None else (ids[where], ids[where + 1])
        if not len(left):
            break
        width = np.uint64(int(ids.max()).bit_length())
        low = (np.uint64(1) << width) - np.uint64(1)
        keys, places = sorted_pairs(left, right, width)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(starts, append=len(keys))
        best = np.flatnonzero(times >= least)
        pairs = keys[starts[best]]
        free = (pairs >> width != END_ID) & (pairs & low != END_ID)
        best, pairs = best[free], pairs[free]
        if not len(best):
            break
        whole = len(best) <= per_round
        order = np.argsort(-times[best], kind="stable")[:per_round]  # the most frequent, smaller pairs first
        best, pairs = best[order], pairs[order]
        number = np.zeros(len(starts), dtype=np.uint32)
        number[best] = FIRST_RULE + made + np.arange(len(best))
        symbol = np.zeros(len(left), dtype=np.uint32)
        symbol[places] = np.repeat(number, times)
        chosen = np.flatnonzero(symbol)
        ids, new = _replaced(ids, symbol[chosen], chosen if where is None else where[chosen])
        where = None
        if whole:
            mark = np.zeros(len(ids), dtype=bool)
            mark[new] = True
            mark[new[new > 0] - 1] = True
            where = np.flatnonzero(mark[:-1])
        rules.append(np.stack([pairs >> width, pairs & low], axis=1))
        made += len(best)
    table = np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.int64)
    return ids.astype("<u4"), table.astype("<u4")


def symbol_sizes(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    sizes = np.ones(len(symbols), dtype=np.int64)
    rule = symbols >= FIRST_RULE
    sizes[rule] = lengths[symbols[rule] - FIRST_RULE]
    return sizes


def rule_levels(rules: np.ndarray) -> list[np.ndarray]:
    """The rules' numbers by level: both parts of a rule are terminals or rules of lower levels."""
    of = rules.astype(np.int64) - FIRST_RULE
    done = np.zeros(len(of) + 1, dtype=bool)
    done[-1] = True  # stands for all terminals
    of[of < 0] = len(of)
    levels = []
    rest = np.arange(len(of))
    while len(rest):
        ready = done[of[rest]].all(axis=1)
        if not ready.any():
            raise ValueError("rules that contain themselves")
        levels.append(rest[ready])
        done[rest[ready]] = True
        rest = rest[~ready]
    return levels


class Grammar:
    """Expansions of all rules, for decoding any range of symbols."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray):
        self.lengths, self.starts = lengths.astype(np.int64), np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        self.flat = np.empty(int(self.starts[-1]), dtype="<u4")
        for level in rule_levels(rules):
            parts = rules[level].astype(np.int64).ravel()
            sizes = symbol_sizes(parts, self.lengths)
            to = np.repeat(self.starts[level], 2)
            to[1::2] += sizes[::2]
            rule = parts >= FIRST_RULE
            self.flat[to[~rule]] = parts[~rule]
            to, n, source = to[rule], sizes[rule], self.starts[parts[rule] - FIRST_RULE]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            self.flat[np.repeat(to, n) + within] = self.flat[np.repeat(source, n) + within]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        sizes = symbol_sizes(symbols, self.lengths)
        source = np.concatenate([self.flat, symbols.astype("<u4")])  # terminals are read from the symbols themselves
        rule = symbols >= FIRST_RULE
        begin = np.where(rule, self.starts[np.where(rule, symbols - FIRST_RULE, 0)], len(self.flat) + np.arange(len(symbols)))
        ends = np.cumsum(sizes)
        return source[np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    lengths = np.ones(len(rules), dtype=np.int64)
    for level in rule_levels(rules):
        lengths[level] = symbol_sizes(rules[level].ravel().astype(np.int64), lengths).reshape(-1, 2).sum(axis=1)
    return lengths.astype("<u4")


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """One shard file of documents' ids, of which each document has counts with its end id."""
    symbols, rules = repair(ids)
    lengths = rule_lengths(rules)
    # The tokenizer itself may give id 2, so documents are told apart by their lengths, not by the end id alone.
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    end_positions = np.cumsum(symbol_sizes(symbols.astype(np.int64), lengths))
    offsets = np.searchsorted(end_positions, starts, side="right")
    keys = np.array([_NULL_ID if d is None else d for d in doc_ids], dtype="<i8")
    head = _HEAD.pack(b"RPG1", len(rules), len(symbols), len(keys), len(ids))
    return b"".join([head, rules.tobytes(), lengths.tobytes(), symbols.tobytes(), keys.tobytes(), offsets.astype("<i8").tobytes(), starts.astype("<i8").tobytes()])


class Shard:
    """A shard file read back."""

    def __init__(self, data: bytes | memoryview):
        mark, rules, symbols, docs, self.ids = _HEAD.unpack_from(data, 0)
        if mark != b"RPG1":
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += part.nbytes
            return part

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.symbols = take("<u4", symbols)
        self.doc_ids, self.offsets, self.starts = take("<i8", docs), take("<i8", docs), take("<i8", docs)
        self.grammar = Grammar(self.rules, self.lengths)

    def document(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document, decoding nothing else."""
        stop = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else len(self.symbols)
        return self.grammar.expand(self.symbols[int(self.offsets[k]) : stop])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        ids = self.grammar.expand(self.symbols)
        stops = [*self.starts[1:].tolist(), self.ids][: len(self.starts)]
        for key, a, b in zip(self.doc_ids.tolist(), self.starts.tolist(), stops, strict=True):
            yield None if key == _NULL_ID else key, a, ids[a:b]


_FILES = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def shard_bytes(total: int) -> int:
    """A shard's size: 6 MB, more for corpora of which that would make over 100,000 shards, 64 MB at most."""
    return min(64 << 20, max(SHARD_BYTES, total // 100_000))


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, target_bytes: int | None = None) -> None:
    """Write one shard file for each range of doc_id to a Parquet table at path."""
    prepare(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    target_bytes = target_bytes or shard_bytes(text_bytes(docs, "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys: list[int | None] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                keys.extend(column(batch, "doc_id").to_pylist())
                yield column(batch, "text")

        ids, counts = word_tokens(vocabulary).stream(texts())
        if keys:
            yield rows(_FILES, shard=[TaskContext.get().partitionId()], n_docs=[len(keys)], n_ids=[len(ids)], data=[pack_shard(keys, ids, counts)])

    ordered(docs, target_bytes).mapInArrow(work, "shard long, n_docs long, n_ids long, data binary").write.parquet(path)


_READ = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(frame: DataFrame) -> DataFrame:
    """(shard, doc_id, start within the shard, n_tokens, ids_crc32) decoded from shard files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(column(batch, "shard").to_pylist(), column(batch, "data"), strict=True):
                found = [(d, a, len(ids), zlib.crc32(ids.tobytes())) for d, a, ids in Shard(data.as_buffer()).documents()]
                keys, starts, counts, sums = zip(*found, strict=True)
                yield rows(_READ, shard=[number] * len(keys), doc_id=keys, start=starts, n_tokens=counts, ids_crc32=sums)

    return frame.select("shard", "data").mapInArrow(work, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, target_bytes: int | None = None) -> DataFrame:
    """Write the shard files, read them back and return doc_id, start, n_tokens, ids_crc32 of every document."""
    spark = prepare(docs.sparkSession)
    path = path or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, vocabulary, target_bytes)
    files = spark.read.schema("shard long, n_docs long, n_ids long, data binary").parquet(path)
    # One number a shard, of which shard_bytes bounds the count; a running sum gives the ids before each shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    read = read_shards(files)
    return read.join(offsets, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
