import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup, linkage, near_dedup, substring_dedup
from docloom.llm.common import Cuts, hashed_words
from docloom.llm.linkage import components
from tests.llm.conftest import prose


def shingles(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(items):
    above = {k: k for k in items}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(items[a] & items[b])
            if both and 100 * both >= 80 * len(items[a] | items[b]):
                p, q = top(a), top(b)
                above[max(p, q)] = min(p, q)
    return {k: top(k) for k in keys}


def test_near_duplicates_equal_brute_force(docs):
    items = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    expected = brute(items)
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(items[row["doc_id"]]), expected[row["doc_id"]], expected[row["doc_id"]] == row["doc_id"])


def test_near_duplicates_in_a_large_family(spark):
    random = np.random.default_rng(5)
    base = prose(20, 700).split(" ")
    rows = []
    for k in range(60):
        words = list(base)
        for at in random.choice(len(words), int(random.integers(0, 45)), replace=False):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute({k: shingles(t) for k, t in rows})
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()} == expected


def test_lists_of_several_blocks(spark, monkeypatch):
    """Lists of several blocks, of near copies and of unlike texts: equal to brute force."""
    monkeypatch.setattr(linkage, "BLOCK", 16)
    random, base, rows = np.random.default_rng(9), prose(21, 300).split(" "), []
    for k in range(400):
        words = list(base)
        for at in random.choice(len(words), int(random.integers(0, 9)), replace=False):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(base[:40] + prose(5000 + k, 60).split(" "))) for k in range(60)]  # share values, aren't alike
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute({k: shingles(t) for k, t in rows})


def test_near_duplicates_about_the_sketch_size(spark):
    """Sets of 70 to 100 shingles with a few words changed, and sets inside others."""
    texts, random = [], np.random.default_rng(3)
    for n in range(70, 101):
        words = [f"s{n}w{k}" for k in range(n + 3)]
        for changed in range(1, 6):
            own = [f"c{changed}{w}" for w in words]  # a family of its own
            near = list(own)
            at = int(random.integers(0, len(own) - changed))
            near[at : at + changed] = [f"new{n}x{changed}x{k}" for k in range(changed)]
            texts += [" ".join(own), " ".join(near)]
        for least in (-(-8 * n // 10), -(-8 * n // 10) - 1):
            texts += [" ".join(f"{least}{w}" for w in words), " ".join(f"{least}{w}" for w in words[: least + 3])]
    expected = brute({k: shingles(t) for k, t in enumerate(texts)})
    found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == expected


def test_blocks_alone_take_linear_work(spark):
    entries = spark.range(20_000).select(F.lit(5).alias("key"), F.lit(20_000).alias("cnt"), F.col("id").alias("node"))
    sizes = [r["count"] for r in linkage.blocked(entries, alone=True).groupBy("key", "i", "j").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * linkage.BLOCK


def test_texts_of_one_id_stay_apart(spark):
    import corpus_pipeline

    a, b = prose(31, 60), prose(32, 60)
    rows = [(1, a), (2, a), (2, b), (3, b + " x"), (4, None), (4, None), (5, ""), (None, a), (6, b), (6, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, a), (1, a), (2, b), (4, ""), (5, "")])


@pytest.mark.parametrize("operator", [near_dedup.near_duplicates, substring_dedup.repeated_passages, line_dedup.line_deduplicated])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    cuts = Cuts(spark, "test")
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), cuts).collect()}
    assert all(found[k] == 1 for k in range(1, 41)) and all(found[k] == 100 for k in range(100, 130)) and len(found) == 70


def test_repeated_passages_are_found_anywhere(docs, texts):
    found = {r["doc_id"]: r for r in substring_dedup.repeated_passages(docs).collect()}
    first, second = 3 * 10 + 1, 3 * 11 + 1  # the shared passage stands after 40 and after 33 words
    assert found[first]["n_removed"] == 0 and found[second]["n_removed"] > 0 and first in found[second]["kept_doc_ids"]
    for begin, end in found[second]["spans"]:
        assert 33 <= begin < end <= 103
    kept = substring_dedup.without_words(texts[11].encode(), found[second]["spans"]).decode()
    assert len(kept.split()) == len(texts[11].split()) - found[second]["removed_words"]
    assert all(found[3 * k + 1]["n_removed"] == 0 for k in range(19, 39)) and found[None]["n_removed"] == 0


def test_line_chunks(docs, texts):
    found = line_dedup.line_deduplicated(docs).collect()
    rows = {r["doc_id"]: r for r in found}
    assert len(found) == docs.count()
    for k, (removed, left) in enumerate(brute_lines([t or "" for t in texts])):
        row = rows[3 * k + 1]
        assert (row["n_removed"], row["text"]) == (removed, None if texts[k] is None else left)
        assert row["n_lines"] == (len(texts[k].split("\n")) if texts[k] else 0)
    assert rows[3 * 13 + 1]["n_removed"] > 0 and rows[1]["odd name"] == 1 and rows[1]["key"] == "k"


def test_chunk_boundaries_resist_shifts():
    lines = [prose(k, 6) for k in range(60)]

    def chunks(own):
        flat, starts = line_dedup.lines_of(pa.array(["\n".join(own)]))
        return {tuple(own[a:b]) for a, b in zip(*line_dedup.spans(flat, starts), strict=True)}

    a, b = chunks(lines), chunks(["new", *lines[:30], "other", *lines[30:]])
    assert len(a & b) >= len(a) - 3


@pytest.mark.parametrize("length", [2, 3, 5, 8, 13, 21, 40])
def test_planted_lines_go_wherever_they_stand(spark, length):
    random, rows = np.random.default_rng(length), []
    for k in range(30):
        block = [prose(90_000 + 100 * k + j, 7) for j in range(length)]
        for side in range(2):
            around = [[prose(10_000 + 1000 * side + 20 * k + 10 * part + j, 6) for j in range(int(random.integers(0, 9)))] for part in range(2)]
            rows.append((2 * k + side, "\n".join([*around[0], *block, *around[1]])))
    found = line_dedup.line_deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {k: length * (k % 2) for k in range(60)}


def brute_lines(texts):
    """Lines left of each text, by all runs of two or more lines and 32 solid bytes."""
    seen, out = {}, []
    for doc, text in enumerate(texts):
        lines = text.split("\n")
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1) if len("".join("".join(lines[a:b]).split())) >= 32]
        for a, b in runs:
            seen.setdefault(tuple(lines[a:b]), (doc, a))
        drop = set()
        for a, b in runs:
            at = seen[tuple(lines[a:b])]
            if at[0] != doc or at[1] + b - a <= a:
                drop |= set(range(a, b))
        out.append((len(drop), "\n".join(x for k, x in enumerate(lines) if k not in drop)))
    return out


def test_repeated_runs_of_lines_go_whole(spark):
    random = np.random.default_rng(8)
    blocks = [[prose(500 + 20 * k + j, int(random.integers(1, 9))) for j in range(n)] for k, n in enumerate([2, 2, 3, 4, 6, 8, 12])]
    blocks += [["ab", "cd", "", "ef", "x" * 9, "", "gh", "y" * 14, "ij"], ["again " + prose(7, 4)] * 5, ["k", "l"], ["alone " + prose(9, 12)]]
    texts = []
    for k in range(60):
        lines = []
        for j in range(4):
            lines += [prose(3000 + 50 * k + 9 * j + i, 5) for i in range(int(random.integers(0, 3)))]
            lines += blocks[int(random.integers(0, len(blocks)))]
        texts.append("\n".join(lines))
    found = line_dedup.line_deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert [(r["n_removed"], r["text"]) for r in sorted(found, key=lambda r: r["doc_id"])] == brute_lines(texts)


def test_repeated_passages_go_whole(spark):
    rows, expected = [], {}
    for k in range(12):
        shared = prose(7000 + k, 51 + 15 * k)
        rows += [(2 * k, f"{prose(7100 + k, 30 + k)} left{k} {shared} right{k} {prose(7200 + k, 25)}"), (2 * k + 1, f"{prose(7300 + k, 11 * k + 1)} {shared} {prose(7400 + k, 40)}")]
        expected |= {2 * k: [], 2 * k + 1: [[11 * k + 1, 11 * k + 1 + 51 + 15 * k]]}
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["spans"] for r in found} == expected
    assert all(r["removed_words"] == sum(b - a for a, b in r["spans"]) for r in found)


def edited(words, every, random):
    out = []
    for k, word in enumerate(words):
        kind = int(random.integers(0, 3)) if every and random.random() < 1 / every else -1
        out += {0: [f"changed{k}"], 1: [word, f"added{k}"], 2: []}.get(kind, [word])
    return out


@pytest.mark.parametrize(("length", "every"), [(35, 0), (51, 0), (150, 0), (51, 40), (100, 40), (150, 40), (80, 20), (150, 20)])
def test_edited_passages_go_wherever_they_stand(spark, length, every):
    random, rows, inside = np.random.default_rng(1000 * length + every), [], {}
    for k in range(40):
        passage = prose(100_000 + 7 * k + length, length).split(" ")
        sides = [[prose(60_000 * (1 + side) + 100 * part + k, int(random.integers(1, 90))).split(" ") for part in range(2)] for side in range(2)]
        copy = edited(passage, every, random)
        rows += [(2 * k, " ".join([*sides[0][0], *passage, *sides[0][1]])), (2 * k + 1, " ".join([*sides[1][0], *copy, *sides[1][1]]))]
        inside[2 * k + 1] = set(range(len(sides[1][0]), len(sides[1][0]) + len(copy)))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    gone = {r["doc_id"]: {w for a, b in r["spans"] for w in range(a, b)} for r in found}
    assert all(not gone[2 * k] for k in range(40))
    assert sum(len(gone[k] & inside[k]) for k in inside) >= 0.9 * sum(map(len, inside.values()))
    assert all(len(gone[k] - inside[k]) <= 6 for k in inside)


def test_passages_equal_brute_force(spark):
    random = np.random.default_rng(6)
    blocks = [prose(40_000 + k, int(random.integers(28, 80))).split(" ") for k in range(12)]
    rows, held = [], {}
    for k in range(50):
        words, at = prose(41_000 + k, int(random.integers(1, 60))).split(" "), []
        for b in random.choice(len(blocks), 3, replace=False).tolist() if k % 5 else []:
            at.append((b, len(words), len(words) + len(blocks[b])))
            words += [*blocks[b], f"end{k}x{b}", *prose(42_000 + 20 * k + b, int(random.integers(1, 40))).split(" ")]
        rows.append((k, " ".join(words)))
        held[k] = at
    words = {k: t.split(" ") for k, t in rows}

    def covered(k):
        """Words of a document in runs of 20 words that an earlier document has as well."""
        earlier = {tuple(words[j][i : i + 20]) for j in range(k) for i in range(len(words[j]) - 19)}
        return {w for i in range(len(words[k]) - 19) if tuple(words[k][i : i + 20]) in earlier for w in range(i, i + 20)}

    first = {}
    for k in sorted(held):
        for b, _, _ in held[k]:
            first.setdefault(b, k)
    for partitions in (1, 9):
        found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
        for r in found:
            k = r["doc_id"]
            assert {w for a, b in r["spans"] for w in range(a, b)} == covered(k)
            assert set(r["cluster_ids"]) == {first[b] for b, _, _ in held[k] if first[b] != k}


def by_all_pairs(rows):
    """Words of each document that repeat in any earlier one, each pair of documents aligned at all runs both hold."""
    rows = sorted(rows)
    hashes, starts = hashed_words(pa.array([t for _, t in rows]))
    own = [hashes[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    runs = [{} for _ in own]
    for k, h in enumerate(own):
        for place, key in zip(*(x.tolist() for x in substring_dedup.bands(h)[:2]), strict=True):
            runs[k].setdefault(key, []).append(place)
    out = {}
    for k, (doc, _) in enumerate(rows):
        out[doc] = set()
        for j in range(k):
            seeds = [(p, q) for key in runs[k].keys() & runs[j].keys() for p in runs[k][key] for q in runs[j][key]]
            for a, b in substring_dedup.repeats(own[k], own[j], [p for p, _ in seeds], [q for _, q in seeds]):
                out[doc] |= set(range(a, b))
    return out


@pytest.mark.parametrize(("phrase", "sure"), [(10, 3), (14, 0), (19, 0), (12, 30)])
def test_each_repeat_is_found_however_many_hold_its_run(spark, phrase, sure):
    """Phrases too short for a repeat stand in most documents; passages around one repeat in some, also with an edit beside it."""
    random, rows, planted = np.random.default_rng(100 * phrase + sure), [], {}
    phrases = [prose(210_000 + 50 * phrase + k, phrase).split(" ") for k in range(3)]
    passages = [[prose(220_000 + 100 * phrase + 2 * k + j, int(random.integers(9, 40))).split(" ") for j in range(2)] for k in range(12)]
    for k in range(150):
        words = prose(230_000 + 200 * phrase + k, int(random.integers(1, 30))).split(" ")
        for j in range(3):
            around = [prose(240_000 + 10 * k + 2 * j + i, int(random.integers(3, 30))).split(" ") for i in range(2)]
            if k % 3 and k > sure:
                before, after = passages[4 * j + int(random.integers(0, 4))]
                edits = int(random.integers(0, 4))
                before = [*before[:-2], f"edit{k}", before[-1]] if edits & 1 else before
                after = [after[0], f"edit{k}", *after[1:]] if edits & 2 else after
                around = [[*around[0], *before], [*after, *around[1]]]
            words += [*around[0], *phrases[j], *around[1]]
        rows.append((k, " ".join(words)))
    expected = by_all_pairs(rows)
    for partitions in (1, 9):
        found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
        gone = {r["doc_id"]: {w for a, b in r["spans"] for w in range(a, b)} for r in found}
        assert {k for k in gone if gone[k]} == {k for k in expected if expected[k]}
        assert sum(len(expected[k] - gone[k]) for k in gone) == 0
        assert all(r["kept_doc_ids"] and r["cluster_ids"] and max(r["kept_doc_ids"]) < r["doc_id"] for r in found if r["spans"])


def test_a_run_shared_by_chance_hides_no_repeat(spark):
    passage = [prose(250_002, 9), prose(250_003, 9)]
    for k in range(1000):  # a run that is the smallest of all runs of its passage, so the passage has no other
        run = prose(251_000 + k, 10)
        whole = f"{passage[0]} {run} {passage[1]}"
        if substring_dedup.bands(hashed_words(pa.array([whole]))[0])[0].tolist() == [9]:
            break
    rows = [(1, f"{prose(250_004, 40)} {run} {prose(250_005, 40)}"), (2, f"{prose(250_006, 15)} {whole} {prose(250_007, 9)}"), (3, f"{prose(250_008, 5)} {run} {prose(250_009, 50)} {whole}")]
    rows += [(5, None), (6, ""), (7, run), (8, run)]
    found = {r["doc_id"]: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3]["spans"] == [[65, 93]] and found[3]["kept_doc_ids"] == [2] and found[3]["cluster_ids"] == [2]
    assert all(found[k]["n_removed"] == 0 for k in (1, 2, 5, 6, 7, 8))
