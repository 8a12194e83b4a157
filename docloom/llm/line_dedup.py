"""Removal of multi-line chunks that occur more than once in the corpus.

A text is split into lines at "\\n". A chunk is a run of at least two lines and `min_bytes` bytes without white space; a
line goes if it stands in a chunk whose lines all stood together at an earlier place (doc_id, line) before, in another
document or above without overlap. Chunk boundaries depend on the lines' content alone, so they resist shifts: a chunk
opens at each line and closes where its own bytes are enough, and one closes at each line that opened in the same way.
Only these shortest chunks are compared: a repeated run of any length is covered by those inside it, so it goes whole,
whatever surrounds it. (Sparser boundaries, chosen where the rolling hash is small, lose the ends of every repeat and most
repeats of a few lines; see the README.) Chunks have a hash that rolls over their lines' hashes. Those that meet inside a
batch are compared byte by byte at once and only the earliest goes on, so a chunk that a third of all documents hold is
one row a batch in the shuffle. Of the others, those whose hash occurs twice are compared by the SHA-256 of their bytes.
The earliest place of a chunk stays, unless a line of it also stands in another repeated chunk; one copy of each line
always stays. A removed line goes with the line break that joins it to its neighbour.

Null texts stay null, empty texts stay empty. Rows equal in doc_id and text are one document and are treated alike.
Null doc_ids sort first. Of tied chunks the earliest place stands. Other columns pass through, whatever their names. A
very long text is held whole by one task, with about twenty bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Cuts, column, hashed_strings, mixed, prepare, rows, utf8

MIN_BYTES = 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SOLID = np.ones(256, dtype=bool)
_SOLID[list(b" \t\n\r\x0b\x0c")] = False


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts in order, and where each text's begin; a null text has one empty line."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def spans(lines: pa.Array, starts: np.ndarray, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """First line and line after the last of the shortest chunks from each line on and up to each line, of all texts."""
    count = len(lines)
    if count < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, offsets, data = lines.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[lines.offset : lines.offset + count + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    before = np.concatenate([[0], np.cumsum(_SOLID[raw], dtype=np.int64)])[ends - ends[0]]
    at = np.arange(count)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    after = np.maximum(at + 2, np.searchsorted(before, before[at] + min_bytes, "left"))
    begin = np.minimum(at - 1, np.searchsorted(before, before[at + 1] - min_bytes, "right") - 1)
    onward, back = after <= starts[text + 1], begin >= starts[text]
    both = np.unique(np.concatenate([at[onward] * (count + 1) + after[onward], begin[back] * (count + 1) + at[back] + 1]))
    return both // (count + 1), both % (count + 1)


def span_hashes(hashes: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A polynomial over the lines' hashes for each chunk, from sums over all lines before."""
    powers, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), x, dtype=np.uint64)])) for x in (np.uint64(_BASE), np.uint64(_INVERSE)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1])])
    return mixed((total[after] - total[first]) * inverse[first] + (after - first).astype(np.uint64))


def _places(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lines of the chunks, and where each chunk's begin."""
    sizes = after - first
    begins = np.cumsum(sizes) - sizes
    return np.repeat(first - begins, sizes) + np.arange(int(sizes.sum())), begins


def earlier_in_batch(codes: np.ndarray, hashes: np.ndarray, first: np.ndarray, after: np.ndarray, text: np.ndarray, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which chunks equal, byte by byte, an earlier one of the batch; codes are equal where lines are."""
    own = first - starts[text]
    order = np.lexsort((own, marks[text], ids[text], hashes))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = hashes[order][1:] != hashes[order][:-1]
    leader = np.empty(len(order), dtype=np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    sizes = after - first
    apart = (ids[text] != ids[text[leader]]) | (marks[text] != marks[text[leader]]) | (own >= own[leader] + sizes)
    out = apart & (sizes == sizes[leader])
    rest = np.flatnonzero(out)
    if len(rest):
        here, begins = _places(first[rest], after[rest])
        there, _ = _places(first[leader[rest]], after[leader[rest]])
        out[rest] = np.logical_and.reduceat(codes[here] == codes[there], begins)
    return out


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_HASHED = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("first", _INTS), ("after", _INTS), ("h", _LONGS), ("gone", _INTS)])
_DIGESTS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("first", pa.int32()), ("after", pa.int32()), ("digest", pa.binary())])


def line_deduplicated(docs: DataFrame, prefix: str = "", min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with the repeated chunks cut from text, and columns n_lines, n_chunks (those compared), n_removed (lines) and
    bytes_removed, each after the prefix; a column of docs that has such a name stays as it is and the new one is left out."""
    spark = prepare(docs.sparkSession)
    cuts = Cuts(spark, "line-dedup")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("__id"), F.xxhash64("text").alias("__mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"), F.col("text").alias("text")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, starts = lines_of(column(batch, "text"))
            first, after = spans(lines, starts, min_bytes)
            if not len(first):
                continue
            ids, marks = (column(batch, c).to_numpy() for c in ("__id", "__mark"))
            line_hashes, codes = hashed_strings(lines)
            found = span_hashes(line_hashes, first, after)
            text = np.searchsorted(starts, first, "right") - 1
            known = earlier_in_batch(codes, found, first, after, text, ids, marks, starts)
            gone = np.zeros(len(lines), dtype=bool)
            gone[_places(first[known], after[known])[0]] = True
            lost = np.flatnonzero(gone)
            of_lost, sent = np.searchsorted(starts, lost, "right") - 1, ~known
            at_span, at_lost = (pa.array(np.searchsorted(t, np.arange(len(ids) + 1)), pa.int32()) for t in (text[sent], of_lost))
            lists = [pa.ListArray.from_arrays(at_span, pa.array((x[sent] - starts[text[sent]]).astype(np.int32))) for x in (first, after)]
            lists += [pa.ListArray.from_arrays(at_span, pa.array(found[sent].view(np.int64))), pa.ListArray.from_arrays(at_lost, pa.array((lost - starts[of_lost]).astype(np.int32)))]
            out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), *lists], schema=_HASHED)
            held = pc.or_(pc.greater(pc.list_value_length(out.column(2)), 0), pc.greater(pc.list_value_length(out.column(5)), 0))
            yield out.filter(held)

    found = cuts.cut(keyed.select("__id", "__mark", "text").mapInArrow(hashed, "id long, mark long, first array<int>, after array<int>, h array<long>, gone array<int>"))
    each = found.select("id", "mark", F.explode(F.arrays_zip("first", "after", "h")).alias("e")).select("id", "mark", "e.first", "e.after", "e.h")
    # Every table joined below grows with the corpus, so none is broadcast at any size.
    repeated = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    suspects = each.join(repeated.hint("merge"), "h", "left_semi").groupBy("id", "mark").agg(F.collect_set(F.struct("first", "after")).alias("spans"))
    suspects = cuts.cut(suspects.select("id", "mark", F.col("spans.first").alias("firsts"), F.col("spans.after").alias("afters")))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, mark, text, firsts, afters in zip(*(column(batch, c).to_pylist() for c in ("__id", "__mark")), utf8(batch, "text"), *(column(batch, c).to_pylist() for c in ("firsts", "afters")), strict=True):
                lines = text.split(b"\n")
                out += [(key, mark, a, b, hashlib.sha256(b"\n".join(lines[a:b])).digest()) for a, b in zip(firsts, afters, strict=True)]
            if out:
                ids, marks, starts, ends, made = zip(*out, strict=True)
                yield rows(_DIGESTS, id=ids, mark=marks, first=starts, after=ends, digest=made)

    # One exchange of whole rows serves the comparison and the removal, one of digests the minimum and its join.
    texts = keyed.repartition("__id", "__mark")
    asked = suspects.withColumnsRenamed({"id": "__id", "mark": "__mark"}).hint("merge")
    digest_of = texts.join(asked, ["__id", "__mark"]).mapInArrow(digests, "id long, mark long, first int, after int, digest binary").distinct().repartition("digest")
    earliest = digest_of.groupBy("digest").agg(F.min(F.struct("id", "mark", "first")).alias("place"), F.count("*").alias("n")).filter("n > 1").select("digest", "place")
    apart = (F.col("id") != F.col("place.id")) | (F.col("mark") != F.col("place.mark")) | (F.col("first") >= F.col("place.first") + F.col("after") - F.col("first"))
    later = digest_of.join(earliest.hint("merge"), "digest").filter(apart)
    numbers = later.select("id", "mark", F.explode(F.sequence("first", F.col("after") - F.lit(1))).alias("number")).union(found.select("id", "mark", F.explode("gone")))
    removals = numbers.groupBy("id", "mark").agg(F.collect_set("number").alias("numbers"))

    names = docs.columns
    out_type = "__row struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ">, text string, n_lines long, n_chunks long, n_removed long, bytes_removed long"

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_out, gone, lost = [], [], []
            for text, numbers in zip(utf8(batch, "text"), column(batch, "numbers").to_pylist(), strict=True):
                drop = set(numbers or ())
                clean = text if not drop else b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in drop)
                texts_out.append(None if clean is None else clean.decode())
                gone.append(len(drop))
                lost.append(len(text or b"") - len(clean or b""))
            lines, starts = lines_of(column(batch, "text"))
            counts = np.diff(starts) * (pc.fill_null(pc.binary_length(column(batch, "text")), 0).to_numpy(zero_copy_only=False) > 0)
            compared = np.diff(np.searchsorted(spans(lines, starts, min_bytes)[0], starts))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "__row"), pa.array(texts_out, pa.string()), *[pa.array(x, pa.int64()) for x in (counts, compared, gone, lost)]], names=["__row", "text", "n_lines", "n_chunks", "n_removed", "bytes_removed"]
            )

    joined = texts.join(removals.withColumnsRenamed({"id": "__id", "mark": "__mark"}).hint("merge"), ["__id", "__mark"], "left").select("__row", "text", "numbers")
    done = joined.mapInArrow(rebuilt, out_type)
    kept = [F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in names]
    extra = [F.col(c).alias(prefix + c) for c in ("n_lines", "n_chunks", "n_removed", "bytes_removed") if prefix + c not in names]
    return done.select(*kept, *extra)
