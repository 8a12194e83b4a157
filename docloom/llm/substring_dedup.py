"""Passages that repeat across documents, found as paragraphs by MinHash banding and verified by edit distance.

Repeated passages stand anywhere in a line, so paragraphs are not cut at line breaks: every WINDOW consecutive runs of
SEED words are a paragraph, of SEED + WINDOW - 1 words. A paragraph's signature is the minimum of its runs' hashes, one band
whose rows are the SEED - 4 five-word shingles of the smallest run. Neighbouring paragraphs share most minima, so each is
kept once with its place. Two paragraphs collide where their bands are equal, so an unedited stretch of SEED + WINDOW - 1 =
27 words that stands in two documents always gives a collision, whatever surrounds it. A pair of passages of 51 or more
words and five-word Jaccard similarity of 0.8 or more has one, or for a single edit in the middle misses it in a few
percent of cases.

Colliding paragraphs are aligned from the equal run on in both directions, over substituted, inserted and deleted words;
an alignment of at least `least` words whose edits are at most a fifth of its words (word edit distance, similarity of 0.8)
confirms a repeat. Holders of a run whose SIDE words on either side are equal too are compared with the earliest of them, in
a batch at once, so the middle of a passage that a third of all documents hold is one row a batch in the shuffle.

A run's earliest holder need not share more than the run, and two holders that both repeat it need not repeat each other, so
holders are not compared with the earliest alone. Where three or more holders meet, each brings its SIDE words on either
side, and partners are chosen on them (partners): stretches of `least` words around the run and longer ones to one side make
classes, whose members repeat each other for certain, and each holder goes with the earliest of the classes that reach
furthest on either side. Behind an edit next to the run holders meet by the four equal words after it. A holder that has no
repeat by then is tried with every earlier one it meets that way. So no group is expanded into pairs, and no holder that
repeats an earlier one stays without a partner. The repeat goes from the document of larger doc_id whole, its edited words
with it. Runs of one repeat are linked, and components of links are clusters.

Words are bytes between ASCII white space, A-Z lower-cased. Null, empty and short texts have no paragraphs. Rows equal
in doc_id are one document: no repeat is sought between them, and each text is cut for itself. Null doc_ids sort first and
are one document. Repeats inside one document are left alone. Extra columns are ignored. A very long text is held whole by
one task, with about forty bytes for each word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import _STEP, Cuts, column, hashed_words, mixed, prepare, rolled, split_join
from docloom.llm.linkage import components

WINDOW = 18
SEED = 10
#: Fewest words of a repeat.
LEAST = 20
#: Equal words after an edit that let an alignment go on.
_FIRM = 4
#: Words skipped in the one and the other text at an edit, cheapest first.
_EDITS = ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3))
_NULL = -(1 << 63)
#: Least words on either side of a run that holders bring along: every word of an unedited stretch of two documents is
#: within WINDOW - 1 of a run, and three more let an alignment of enough words be told from them.
SIDE = WINDOW + 2
#: Rows of whole groups that are compared at once.
_ROWS = 20_000


def side_of(least: int) -> int:
    return max(SIDE, least - SEED + 3)


def _surroundings(hashes: np.ndarray, places: np.ndarray, side: int) -> np.ndarray:
    """A hash of each run with the `side` words before and after it, or as many as there are."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), _STEP)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    begin, end = np.maximum(places - side, 0), np.minimum(places + SEED + side, len(hashes))
    # powers[n - begin] undoes the place of the window up to powers[n], whose inverse makes texts of any length comparable
    same = (sums[end] - sums[begin]) * powers[len(hashes) - begin] * np.uint64(pow(int(powers[-1]), -1, 1 << 64))
    return mixed(same + ((places - begin) * (1 << 32) + end - places).astype(np.uint64))


def bands(hashes: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, band keys and surroundings of the minima of all paragraphs of a text's word hashes; the first place of each
    key with each surroundings."""
    if len(hashes) < SEED:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    runs = rolled(hashes, SEED)
    width = min(WINDOW, len(runs))
    view = np.lib.stride_tricks.sliding_window_view(runs, width)
    places = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    around = _surroundings(hashes, places, side)
    first = np.sort(np.unique(mixed(runs[places]) ^ around, return_index=True)[1])
    return places[first], runs[places[first]], around[first]


def _equal_words(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many words are equal from i and j on."""
    total, size = 0, 64
    while True:
        x, y = a[i + total : i + total + size], b[j + total : j + total + size]
        n = min(len(x), len(y))
        if not n:
            return total
        differ = x[:n] != y[:n]
        at = int(differ.argmax())
        if differ[at]:
            return total + at
        total, size = total + n, 2 * size


def reach(a: np.ndarray, b: np.ndarray, i: int, j: int, sure: int) -> tuple[int, int, int]:
    """Where an alignment that goes on at i and j ends in both, and its edits; sure words before it are equal."""
    begin, edits = i, 0
    while True:
        n = _equal_words(a, b, i, j)
        i, j = i + n, j + n
        for p, q in _EDITS:
            x, y = a[i + p : i + p + _FIRM], b[j + q : j + q + _FIRM]
            if len(x) == _FIRM == len(y) and x[0] == y[0] and (x == y).all() and 5 * (edits + max(p, q)) <= sure + i - begin + _FIRM:
                i, j, edits = i + p, j + q, edits + max(p, q)
                break
        else:
            return i, j, edits


def repeats(own: np.ndarray, other: np.ndarray, places: list[int], others: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """First word and word after the last of own's passages that repeat in other; both have an equal run at places, others."""
    out: list[tuple[int, int]] = []
    done: list[tuple[int, int, int, int]] = []
    back_own, back_other = own[::-1], other[::-1]
    for k in np.argsort(places, kind="stable").tolist():
        i, j = places[k], others[k]
        if any(d[0] <= i and i + SEED <= d[1] and d[2] <= j and j + SEED <= d[3] for d in done[-8:]) or not np.array_equal(own[i : i + SEED], other[j : j + SEED]):
            continue
        end, other_end, after = reach(own, other, i + SEED, j + SEED, SEED)
        back, other_back, before = reach(back_own, back_other, len(own) - i, len(other) - j, end - i)
        begin, other_begin = len(own) - back, len(other) - other_back
        size = max(end - begin, other_end - other_begin)
        done.append((begin, end, other_begin, other_end))
        if end - begin >= least and 5 * (before + after) <= size:
            out.append((begin, end))
    return out


def _linked(found: list[tuple[int, int]], places: np.ndarray, keys: np.ndarray, edges: dict[int, set[int]]) -> list[list[int]]:
    """[first word, word after, smallest key] of each passage of a text; all keys inside are linked to the smallest."""
    out = []
    for begin, end in found:
        own = keys[(places >= begin) & (places + SEED <= end)].tolist()
        least = min(own)
        edges.setdefault(least, set()).update(own)
        out.append([begin, end, least])
    return out


_RUNS = pa.list_(pa.list_(pa.int64()))
_UNITS = pa.schema(
    [("id", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_paragraphs", pa.int64()), ("place", pa.list_(pa.int32())), ("key", pa.list_(pa.int64()))]
    + [("runs", _RUNS), ("edge_a", pa.list_(pa.int64())), ("edge_b", pa.list_(pa.int64()))]
)
_UNIT_TYPE = "id long, mark long, doc_id long, n_words long, n_paragraphs long, place array<int>, key array<long>, runs array<array<bigint>>, edge_a array<long>, edge_b array<long>"
_ALIGNED = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("runs", _RUNS), ("edge_a", pa.list_(pa.int64())), ("edge_b", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, ends: np.ndarray, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(kind)))


def _in_batch(ids: np.ndarray, marks: np.ndarray, doc_ids: pa.Array, texts: pa.Array, least: int) -> pa.RecordBatch:
    """One row a text: its paragraphs that no earlier document of the batch has in equal surroundings, and its repeats of those."""
    hashes, starts = hashed_words(texts)
    count = len(ids)
    own = [hashes[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
    found = [bands(h, side_of(least)) for h in own]
    text = np.repeat(np.arange(count), [len(f[0]) for f in found])
    place, key, around = (np.concatenate([f[k] for f in found]) if count else np.empty(0, np.int64) for k in (0, 1, 2))
    key = key.view(np.int64) if len(key) else key.astype(np.int64)
    order = np.lexsort((text, marks[text], ids[text], around, key))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (around[order][1:] != around[order][:-1])
    leader = np.empty(len(order), dtype=np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    later = np.flatnonzero(ids[text] != ids[text[leader]])
    runs: list[list] = [[] for _ in range(count)]
    edges: list[dict[int, set[int]]] = [{} for _ in range(count)]
    if len(later):
        later = later[np.lexsort((text[leader[later]], text[later]))]
        t, u = text[later], text[leader[later]]
        cuts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (u[1:] != u[:-1]), [True]])).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, x, y = later[a:b], int(t[a]), int(u[a])
            passages = repeats(own[x], own[y], place[part].tolist(), place[leader[part]].tolist(), least)
            runs[x] += [[*r, int(ids[y])] for r in _linked(passages, found[x][0], found[x][1].view(np.int64), edges[x])]
    sent = np.ones(len(text), dtype=bool)
    sent[later] = False
    ends = np.searchsorted(text[sent], np.arange(count + 1))
    pairs = [[(a, b) for a, members in e.items() for b in sorted(members)] for e in edges]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids), pa.array(marks), doc_ids, pa.array(np.diff(starts)), pa.array([len(set(f[1].tolist())) for f in found], pa.int64()), _lists(place[sent], ends, np.int32), _lists(key[sent], ends, np.int64),
            pa.array(runs, _RUNS), *[pa.array([[p[k] for p in e] for e in pairs], pa.list_(pa.int64())) for k in (0, 1)],
        ],
        schema=_UNITS,
    )


def sides(hashes: np.ndarray, places: np.ndarray, side: int) -> np.ndarray:
    """The `side` words before each run, the nearest first, and those after it, in four bytes each; 0 beyond the text."""
    away = np.arange(side)
    at = np.concatenate([places[:, None] - 1 - away, places[:, None] + SEED + away], axis=1)
    inside = (at >= 0) & (at < len(hashes))
    short = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, short[np.where(inside, at, 0)], np.uint32(0))


def _first_of(values: np.ndarray) -> np.ndarray:
    """For each value the first index that has it."""
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    return first[which]


def _prefixes(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 0, 1, ... words of each row."""
    out = [np.zeros(len(words), np.uint64)]
    for k in range(words.shape[1]):
        out.append(mixed(out[-1] * _STEP + words[:, k] + np.uint64(k + 1)))
    return out


def _exact(left: np.ndarray, right: np.ndarray, group: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the earliest row that shares `extra` words or more around the run with them, for each such stretch."""
    side = left.shape[1]
    n_left, n_right, lefts, rights = (left != 0).sum(axis=1), (right != 0).sum(axis=1), _prefixes(left), _prefixes(right)
    stretches = [(extra - r, r) for r in range(extra + 1)] + [(0, d) for d in range(extra + 1, side + 1)] + [(d, 0) for d in range(extra + 1, side + 1)]
    rows, firsts = [], []
    for before, after in stretches:
        has = np.flatnonzero((n_left >= before) & (n_right >= after))
        first = has[_first_of(mixed(lefts[before][has] * _STEP + rights[after][has]) ^ group[has])]
        rows.append(has[first < has])
        firsts.append(first[first < has])
    return np.concatenate(rows), np.concatenate(firsts)


def _meetings(words: np.ndarray, group: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that meet others behind an edit on one side: their numbers, the meeting's and that of the words up to its end.

    A meeting is the group, the equal words up to the edit and the four words after it."""
    n, prefixes = (words != 0).sum(axis=1), _prefixes(words)
    empty = np.empty(0, np.int64)
    rows, meets, ends = [empty], [empty.view(np.uint64)], [empty.view(np.uint64)]
    for same in range(extra):
        for skip in range(min(max(p for p, _ in _EDITS), words.shape[1] - same - _FIRM) + 1):
            has = np.flatnonzero(n >= same + skip + _FIRM)
            firm = _prefixes(words[has, same + skip : same + skip + _FIRM])[-1]
            rows.append(has)
            meets.append(mixed(mixed(prefixes[same][has] + np.uint64(same)) * _STEP + firm) ^ group[has])
            ends.append(prefixes[same + skip + _FIRM][has])
    row, meet, end = np.concatenate(rows), np.concatenate(meets), np.concatenate(ends)
    order = np.lexsort((row, meet))
    row, meet, end = row[order], meet[order], end[order]
    if not len(row):
        return row, row, end
    fresh = np.concatenate([[True], meet[1:] != meet[:-1]])
    number = np.cumsum(fresh) - 1
    mixed_ends = np.bincount(number, end != end[np.flatnonzero(fresh)][number]) > 0
    keep = mixed_ends[number]
    return row[keep], number[keep], end[keep]


def _alignment(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, bool]:
    """How far two rows' alignment goes on before and after the run in the first, and whether it is a repeat."""
    side = len(a) // 2
    (left_a, right_a), (left_b, right_b) = ((x[:side][x[:side] != 0], x[side:][x[side:] != 0]) for x in (a, b))
    after, _, edits = reach(right_a, right_b, 0, 0, SEED)
    before, _, more = reach(left_a, left_b, 0, 0, SEED + after)
    size = SEED + before + after
    return before, after, size >= least and 5 * (edits + more) <= size


def partners(keys: np.ndarray, ids: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (later, earlier) to align, of rows sorted by key and id; words are the sides of each row's run.

    Rows equal in all words go with the earliest of them, and only that one with others."""
    prefix = _prefixes(words)[-1] ^ mixed(keys.view(np.uint64))
    first = _first_of(prefix)
    alike = np.flatnonzero((first < np.arange(len(keys))) & (ids[first] != ids))
    alone = np.flatnonzero(first == np.arange(len(keys)))
    x, y = _unlike(keys[alone], ids[alone], words[alone], least)
    return np.concatenate([alike, alone[x]]), np.concatenate([first[alike], alone[y]])


def _unlike(keys: np.ndarray, ids: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different words."""
    extra, group = max(0, least - SEED), mixed(keys.view(np.uint64))
    left, right = np.split(words, 2, axis=1)
    row, first = _exact(left, right, group, extra)
    apart = ids[row] != ids[first]
    pairs = np.unique(np.stack([row[apart], first[apart]], axis=1), axis=0)
    row, first = pairs[:, 0], pairs[:, 1]
    chosen, far = set(), np.full((len(keys), 2), -1)
    for side, own in enumerate((left, right)):  # of each row the pair that reaches furthest, the earliest of equal ones
        same = np.cumprod((own[row] == own[first]) & (own[row] != 0), axis=1).sum(axis=1)
        best = np.lexsort((first, -same, row))
        best = best[np.concatenate([[True], row[best][1:] != row[best][:-1]])] if len(best) else best
        far[row[best], side] = same[best]
        chosen |= set(zip(row[best].tolist(), first[best].tolist(), strict=True))
    found = far[:, 0] >= 0
    met: dict[int, list[tuple]] = {}
    for side, own in enumerate((left, right)):
        row, number, end = _meetings(own, group, extra)
        if not len(row):
            continue
        begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        which = np.searchsorted(begin, np.arange(len(row)), side="right") - 1
        other = np.minimum.reduceat(np.where(end != end[begin][which], np.arange(len(row)), len(row)), begin)[which]
        at = np.where(end == end[begin][which], other, begin[which])  # the earliest row with other words up to the meeting
        good = (row[at] < row) & (ids[row[at]] != ids[row]) & (~found[row] | (far[row, side] < own.shape[1]))
        for x, y in np.unique(np.stack([row[good], row[at][good]], axis=1), axis=0).tolist():
            if (x, y) in chosen:
                continue
            before, after, confirmed = _alignment(words[x], words[y], least)
            if confirmed and (before > far[x, 0] or after > far[x, 1]):
                chosen.add((x, y))
                far[x], found[x] = np.maximum(far[x], (before, after)), True
        for k in np.flatnonzero(good & ~found[row]).tolist():
            met.setdefault(int(row[k]), []).append((row, end, int(begin[which[k]]), k))
    for x, lists in met.items():  # a row without a repeat so far is tried with all others that it meets
        for y in np.unique(np.concatenate([r[b:k][e[b:k] != e[k]] for r, e, b, k in lists])).tolist() if not found[x] else ():
            if ids[y] != ids[x] and _alignment(words[x], words[y], least)[2]:
                chosen.add((x, y))
                break
    out = np.array(sorted(chosen), dtype=np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text mark, n_words, n_paragraphs (distinct minima), n_removed (repeats found), removed_words, spans (merged,
    [first word, word after]), kept_doc_ids (the earlier documents that hold the repeats), cluster_ids (for each cluster
    of the repeats the smallest doc_id that keeps one) for every row."""
    spark = prepare(docs.sparkSession)
    cuts = Cuts(spark, "substring-dedup")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL).cast("long")).alias("id"), F.xxhash64("text").alias("mark"), "text")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _in_batch(column(batch, "id").to_numpy(), column(batch, "mark").to_numpy(), column(batch, "doc_id"), column(batch, "text"), least)

    units = cuts.cut(keyed.select("id", "mark", "doc_id", "text").mapInArrow(extracted, _UNIT_TYPE))

    # One exchange by key finds the runs of two holders, which are a pair, and of more; batches have already thinned out frequent runs.
    each = units.select("id", F.explode(F.arrays_zip("place", "key")).alias("e")).select("id", "e.place", "e.key").repartition("key").sortWithinPartitions("key", "id", "place")

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pair where a run has two rows, its rows without a partner where it has more."""
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]  # at most two rows of the last key
        many: int | None = None  # the last key, if its rows are going out already
        for part in (*batches, None):
            ids, places, keys = held if part is None else (np.concatenate([h, column(part, c).to_numpy()]) for h, c in zip(held, ("id", "place", "key"), strict=True))
            if not len(keys):
                continue
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.diff(np.append(begin, len(keys)))
            crowd = times > 2
            if many is not None and keys[0] == many:
                crowd[0] = True
            many = int(keys[-1]) if crowd[-1] else None
            stay = 0 if part is None or crowd[-1] else int(times[-1])
            held = [x[len(keys) - stay :] for x in (ids, places, keys)]
            full = np.ones(len(begin), dtype=bool)
            full[-1] = not stay
            two = begin[full & ~crowd & (times == 2)]
            two = two[ids[two] != ids[two + 1]]
            more = np.flatnonzero(np.repeat(crowd, times))
            none = np.ones(len(more), dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[two + 1], ids[more]])), pa.array(np.concatenate([ids[two], ids[more]]), mask=np.concatenate([np.zeros(len(two), bool), none])),
                    pa.array(np.concatenate([places[two + 1], places[more]])), pa.array(np.concatenate([places[two], places[more]])), pa.array(np.concatenate([keys[two], keys[more]])),
                ],
                names=["id", "kept", "place", "other", "key"],
            )

    links = cuts.cut(each.mapInArrow(later, "id long, kept long, place int, other int, key long"))

    # One exchange of texts serves the sides of frequent runs and both sides of a pair. No table is bounded, so nothing is broadcast.
    texts = keyed.select("id", "mark", "text").repartition("id")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = hashed_words(column(batch, "text"))
            docs, at, runs, words = [], [], [], []
            for k, (doc, places, keys) in enumerate(zip(column(batch, "id").to_pylist(), column(batch, "place"), column(batch, "key"), strict=True)):
                own, places, keys = hashes[starts[k] : starts[k + 1]], places.values.to_numpy().astype(np.int64), keys.values.to_numpy()
                there = rolled(own, SEED).view(np.int64)
                mine = (places < len(there)) & (there[np.minimum(places, len(there) - 1)] == keys) if len(there) else np.zeros(len(places), bool)
                if mine.any():  # of several texts of one id the one that has the run
                    docs.append(np.full(int(mine.sum()), doc, np.int64))
                    at.append(places[mine].astype(np.int32))
                    runs.append(keys[mine])
                    words += [w.tobytes() for w in sides(own, places[mine], side_of(least)).astype("<u4")]
            if words:
                arrays = [pa.array(np.concatenate(x)) for x in (docs, at, runs)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(words, pa.binary())], names=["id", "place", "key", "words"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, enough = 0, _ROWS
        for part in (*batches, None):
            if part is not None:
                held.append(part)
                count += part.num_rows
                if count < enough:
                    continue
            if not count:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            end = count if part is None else int(np.searchsorted(keys, keys[-1]))
            held, enough = table.slice(end).to_batches(), max(_ROWS, 2 * (count - end))
            count -= end
            if not end:
                continue
            ids, places = (table.column(c).to_numpy()[:end] for c in ("id", "place"))
            words = np.frombuffer(b"".join(table.column("words").slice(0, end).to_pylist()), dtype="<u4").reshape(end, 2 * side_of(least))
            x, y = partners(keys[:end], ids, words, least)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[x], ids[y], places[x], places[y])], names=["id", "kept", "place", "other"])

    crowds = links.filter("kept is null").groupBy("id").agg(F.collect_list(F.struct("place", "key")).alias("e")).select("id", F.col("e.place").alias("place"), F.col("e.key").alias("key"))
    around = crowds.hint("merge").join(texts, "id").select("id", "mark", "place", "key", "text").mapInArrow(beside, "id long, place int, key long, words binary")
    chosen = around.repartition("key").sortWithinPartitions("key", "id", "place").mapInArrow(together, "id long, kept long, place int, other int")
    pairs = chosen.unionByName(links.filter("kept is not null").drop("key"))
    seeds = pairs.groupBy("id", "kept").agg(F.collect_set(F.struct("place", "other")).alias("seeds"))
    seeds = seeds.select("id", "kept", F.col("seeds.place").alias("place"), F.col("seeds.other").alias("other"))

    holders = texts.select(F.col("id").alias("kept"), F.col("text").alias("kept_text"))
    paired = seeds.hint("merge").join(holders, "kept").hint("merge").join(texts, "id")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at_a), (b, at_b) = hashed_words(column(batch, "text")), hashed_words(column(batch, "kept_text"))
            kept, runs, edges = column(batch, "kept").to_pylist(), [], []
            for k, (place, other) in enumerate(zip(column(batch, "place").to_pylist(), column(batch, "other").to_pylist(), strict=True)):
                linked: dict[int, set[int]] = {}
                own = a[at_a[k] : at_a[k + 1]]
                passages = repeats(own, b[at_b[k] : at_b[k + 1]], place, other, least)
                places, keys, _ = bands(own, side_of(least)) if passages else (None, None, None)
                runs.append([[*r, kept[k]] for r in _linked(passages, places, keys.view(np.int64), linked)] if passages else [])
                edges.append([(x, y) for x, members in linked.items() for y in sorted(members)])
            arrays = [pa.array(runs, _RUNS), *[pa.array([[p[k] for p in e] for e in edges], pa.list_(pa.int64())) for k in (0, 1)]]
            out = pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "mark"), *arrays], schema=_ALIGNED)
            yield out.filter(pa.array([bool(r) for r in runs], pa.bool_()))

    found = paired.select("id", "mark", "kept", "place", "other", "text", "kept_text").mapInArrow(aligned, "id long, mark long, runs array<array<bigint>>, edge_a array<long>, edge_b array<long>")
    found = cuts.cut(found)
    every = found.unionByName(units.filter(F.size("runs") > 0).select(*found.columns))
    edges = every.select(F.explode(F.arrays_zip("edge_a", "edge_b")).alias("e")).select(F.col("e.edge_a").alias("a"), F.col("e.edge_b").alias("b"))
    labels = components(edges, cuts)
    passages = every.select("id", "mark", F.explode("runs").alias("r")).select("id", "mark", F.array(F.col("r")[0], F.col("r")[1]).alias("span"), F.col("r")[2].alias("node"), F.col("r")[3].alias("kept"))
    passages = cuts.cut(passages)
    nodes = cuts.cut(passages.groupBy("node").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).join(labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    names = nodes.groupBy("comp").agg(F.count("*").alias("n"), F.min("kept").alias("cluster"))
    clusters = split_join(nodes.select("node", "comp", F.col("n").alias("times")), names, "comp", nodes.count()).select("node", F.col("times").alias("n"), "cluster")
    marked = split_join(passages, clusters, "node", passages.count())
    per_doc = marked.groupBy("id", "mark").agg(F.collect_set("span").alias("runs"), F.collect_set("kept").alias("kept_ids"), F.collect_set("cluster").alias("clusters"))

    # Merge overlapping runs, sorted by their first word.
    empty = F.array().cast("array<array<bigint>>")

    def merged_with(acc: Column, run: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.array(F.element_at(last, 1), F.greatest(F.element_at(last, 2), F.element_at(run, 2)))
        touching = (F.size(acc) > 0) & (F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(2)) >= F.element_at(run, 1))
        return F.when(touching, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(run)))

    def ids_of(name: str) -> Column:
        return F.array_sort(F.transform(F.coalesce(name, F.array().cast("array<bigint>")), lambda i: F.when(i != _NULL, i)))

    spans = F.aggregate(F.array_sort(F.coalesce("runs", empty)), empty, merged_with)
    out = units.select("id", "mark", "doc_id", "n_words", "n_paragraphs").join(per_doc.hint("merge"), ["id", "mark"], "left").withColumn("spans", spans)
    return out.select(
        "doc_id", "mark", "n_words", "n_paragraphs", F.greatest(F.size("runs"), F.lit(0)).cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s[1] - s[0]).alias("removed_words"), "spans", ids_of("kept_ids").alias("kept_doc_ids"), ids_of("clusters").alias("cluster_ids"),
    )


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the bytes of each span of words."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, after in spans:
        out.append(text[at : places[first][0]])
        at = places[after - 1][1]
    return b"".join([*out, text[at:]])
