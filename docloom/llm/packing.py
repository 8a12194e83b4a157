"""Order-preserving packing of token streams into windows of at most 4096 ids.

Documents keep the order of doc_id inside a range partition. Possible cuts are the ends of documents (free), the ends
of sentences, and inside any longer stretch every `STRIDE` ids (a truncation). A window of n ids is padded to 4096
unless n is a power of two. The cost of a partition is the sum of padding and cut penalties; dynamic programming over
the cuts finds the least, with the padded transitions taken from a monotone queue (the best predecessor within 4096)
and the unpadded ones from the predecessors a power of two before. What is left at a partition's end goes into
windows of falling powers of two, so it needs no padding. Every id lies in exactly one piece.

Null texts are empty (the end id alone); null doc_ids come first; equal doc_ids are ordered by their text's hash.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import column, prepare, rows
from docloom.llm.token_output import ordered
from docloom.llm.tokens import default_vocabulary, sentence_ends, word_tokens

WINDOW = 4096
STRIDE = 64
SENTENCE_PENALTY = 8
TRUNCATION_PENALTY = 48
#: Powers of two that a window inside a partition may have; smaller ones only at its end.
SHORT = (256, 512, 1024, 2048)
PARTITION_BYTES = 4 << 20


def cut_points(doc_ends: np.ndarray, sentence: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and the penalty of each; position 0 and the total are among them."""
    penalty = np.full(total + 1, -1, dtype=np.int32)
    penalty[sentence] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = penalty[total] = 0
    points = np.flatnonzero(penalty >= 0)
    gaps = np.diff(points)
    wide = np.flatnonzero(gaps > STRIDE)
    if len(wide):
        extra = (gaps[wide] - 1) // STRIDE
        begin = np.repeat(points[wide], extra)
        step = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        penalty[begin + step * STRIDE] = TRUNCATION_PENALTY
        points = np.flatnonzero(penalty >= 0)
    return points, penalty[points]


def best_cuts(points: np.ndarray, penalties: np.ndarray) -> list[int]:
    """Ends of the windows of least padding plus penalties; the last window may be cut further by `tail`."""
    count = len(points)
    exact: list[list[int]] = [[] for _ in range(count)]  # predecessors a power of two before
    for size in (*SHORT, WINDOW):
        at = np.searchsorted(points, points - size)
        hits = np.flatnonzero((points >= size) & (points[at] == points - size))
        for k, p in zip(hits.tolist(), at[hits].tolist(), strict=True):
            exact[k].append(p)
    place, cost = points.tolist(), penalties.tolist()
    best, back = [0.0] * count, [0] * count
    queue: deque[int] = deque([0])  # rising best + place: the front is the best predecessor for a padded window
    rank = [0] * count
    final = count - 1
    for k in range(1, count):
        here = place[k]
        while here - place[queue[0]] > WINDOW:
            queue.popleft()
        front = queue[0]
        # At the very end no padding is due, since `tail` cuts the rest into powers of two.
        value = rank[front] + (WINDOW - here if k != final else -here)
        source = front
        for p in exact[k]:
            if best[p] < value:
                value, source = best[p], p
        best[k] = value = value + cost[k]
        back[k] = source
        rank[k] = mark = value + here
        while queue and rank[queue[-1]] >= mark:
            queue.pop()
        queue.append(k)
    ends, k = [], final
    while k > 0:
        ends.append(place[k])
        k = back[k]
    return ends[::-1]


def tail(begin: int, end: int) -> list[int]:
    """Ends of windows of falling powers of two that cover begin to end."""
    out = []
    while begin < end:
        begin += 1 << ((end - begin).bit_length() - 1)
        out.append(begin)
    return out


def windows(doc_lengths: np.ndarray, ids: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Ends of all windows over a stream."""
    total = len(ids)
    if not total:
        return np.empty(0, dtype=np.int64)
    doc_ends = np.cumsum(doc_lengths)
    sentence = np.flatnonzero(is_end[np.minimum(ids, len(is_end) - 1)]) + 1
    ends = best_cuts(*cut_points(doc_ends, sentence, total))
    last = ends[-2] if len(ends) > 1 else 0
    return np.array([*ends[:-1], *tail(last, total)], dtype=np.int64)


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pieces(keys: list, lengths: np.ndarray, ids: np.ndarray, ends: np.ndarray, first_sequence: int) -> pa.RecordBatch:
    doc_ends = np.cumsum(lengths)
    stops = np.union1d(doc_ends, ends)
    begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    doc = np.searchsorted(doc_ends, begins, side="right")
    sequence = np.searchsorted(ends, begins, side="right")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    raw = memoryview(ids.tobytes())
    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
    return rows(
        _PIECES, doc_id=[keys[d] for d in doc.tolist()], start=begins - (doc_ends - lengths)[doc], length=stops - begins, ids_crc32=sums,
        doc_tokens=lengths[doc], sequence_id=sequence + first_sequence, offset=begins - starts[sequence],
    )


def packed(docs: DataFrame, vocabulary: str | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per piece. sequence_id is the partition number times 2**32 plus the window's number in it."""
    prepare(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys: list[int | None] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                keys.extend(column(batch, "doc_id").to_pylist())
                yield column(batch, "text")

        ids, lengths = word_tokens(vocabulary).stream(texts())
        if not keys:
            return
        ends = windows(lengths, ids, sentence_ends(vocabulary))
        out = pieces(keys, lengths, ids, ends, TaskContext.get().partitionId() << 32)
        for at in range(0, out.num_rows, 10_000):
            yield out.slice(at, 10_000)

    return ordered(docs, partition_bytes).mapInArrow(work, ", ".join(f"{f.name} long" for f in _PIECES))
