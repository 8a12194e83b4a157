import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import media, packing, sharding, token_output
from docloom.llm.tokens import END_ID, WordTokens, default_vocabulary


@pytest.fixture(scope="module")
def ids_of(docs):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, END_ID] for r in docs.collect()}


def raw(ids):
    return np.asarray(ids, dtype="<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB .,!?'s\n\t\r\x0b\x0c  ́é漢İ<|endoftext|>0\x1cßÄªµſ&%*-_/")), max_size=6))
def test_word_by_word_equals_whole_texts(parts):
    tokenizer = test_word_by_word_equals_whole_texts.tokenizer
    text = " ".join(parts)
    ids, counts = test_word_by_word_equals_whole_texts.tokens.encode(pa.array([None, text, text]))
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*expected, *expected] and counts.tolist() == [0, len(expected), len(expected)]


test_word_by_word_equals_whole_texts.tokenizer = Tokenizer.from_file(default_vocabulary())
test_word_by_word_equals_whole_texts.tokens = WordTokens(default_vocabulary())


def test_token_files(docs, ids_of, tmp_path):
    found = sorted(token_output.token_files(docs, str(tmp_path / "shards"), target_bytes=20_000).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in found), key=lambda k: (k is not None, k or 0))
    at = 0
    for row in found:
        ids = ids_of[row["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([2, 5, 6, 7, 70000]), max_size=60), max_size=12))
def test_grammar_round_trip(lists):
    ids = np.array([i for x in lists for i in [*x, END_ID]], dtype="<u4")
    shard = token_output.Shard(token_output.pack_shard(list(range(len(lists))), ids, np.array([len(x) + 1 for x in lists], dtype=np.int64)))
    assert [ids.tolist() for _, _, ids in shard.documents()] == [[*x, END_ID] for x in lists]
    assert [shard.document(k).tolist() for k in range(len(lists))] == [[*x, END_ID] for x in lists]


def test_grammar_compresses():
    ids = np.tile(np.arange(10, 26, dtype=np.uint32), 500)
    symbols, rules = token_output.repair(ids)
    assert len(symbols) + 2 * len(rules) < len(ids) / 8


def test_no_pair_is_left_that_would_pay():
    ids = np.random.default_rng(4).integers(3, 60, 20_000).astype(np.uint32)
    symbols, rules = token_output.repair(ids, per_round=50)
    times, k = {}, 0
    while k + 1 < len(symbols):  # occurrences that don't overlap
        pair = (int(symbols[k]), int(symbols[k + 1]))
        if pair[0] != pair[1] or times.get("last") != (k - 1, pair):
            times[pair] = times.get(pair, 0) + 1
            times["last"] = (k, pair)
        k += 1
    times.pop("last", None)
    assert max(times.values()) < 8 and len(rules) > 100


def test_packing(docs, ids_of):
    found = packing.packed(docs, partition_bytes=60_000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for key, pieces in by_doc.items():
        times = 2 if key == 19 else 1  # one row stands twice
        assert sum(p["length"] for p in pieces) == times * len(ids_of[key])
        for p in pieces:
            assert p["doc_tokens"] == len(ids_of[key]) and p["ids_crc32"] == zlib.crc32(raw(ids_of[key][p["start"] : p["start"] + p["length"]]))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.03 * sum(len(x) for x in ids_of.values())


def test_packing_is_optimal():
    random = np.random.default_rng(3)
    points = np.unique(np.concatenate([[0], random.integers(1, 20_000, 60), [20_000], np.arange(0, 20_000, 1500)]))
    cost = random.integers(0, 50, len(points))
    cost[0] = cost[-1] = 0
    best = [0.0] + [math.inf] * (len(points) - 1)
    last = len(points) - 1
    for k in range(1, len(points)):
        for p in range(k):
            size = int(points[k] - points[p])
            if size <= 4096:
                free = k == last and True
                exact = size in (*packing.SHORT, 4096)
                padding = (-4096 if free else 0) + 4096 - size
                best[k] = min(best[k], best[p] + cost[k] + (0 if exact and not free else padding if not exact else min(0, padding)))
    ends = [0, *packing.best_cuts(points, cost)]
    assert all(b - a <= 4096 for a, b in zip(ends, ends[1:], strict=False))
    total = 0.0
    where = {int(p): k for k, p in enumerate(points)}
    for a, b in zip(ends, ends[1:], strict=False):
        size = b - a
        exact = size in (*packing.SHORT, 4096)
        total += cost[where[b]] + (-size if b == points[-1] else 0 if exact else 4096 - size)
    assert math.isclose(total, best[-1])


def test_sharding(docs):
    rows = sharding.sharded(docs, 40).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = defaultdict(set)
    for d in docs.collect():
        data = (d["text"] or "").encode()
        texts[d["doc_id"]].add((len(data) + 16, zlib.crc32(data)))
    assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] for r in rows)


def test_sharding_follows_weights_and_moves_few(spark):
    frame = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    weighted = {r["shard"]: r["count"] for r in sharding.sharded(frame, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(weighted[1] / 20_000 - 0.75) < 0.02
    moved = sharding.sharded(frame, 10).filter("grown_shard <> shard").count()
    assert abs(moved / 20_000 - 1 / 11) < 0.02


def test_media(docs):
    stored = media.stored(docs)
    rows = {r["doc_id"]: r for r in media.media_features(stored).collect()}
    for d in docs.collect():
        payload = media.padded((d["text"] or "").encode())
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((d["text"] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    clips = media.clip_rows(stored).filter("doc_id = 43").orderBy("clip").collect()
    assert clips[0]["start_ms"] == 0 and all(a["end_ms"] == b["start_ms"] for a, b in zip(clips, clips[1:], strict=False))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(data):
    payload = media.padded(data)
    frames, length, ms = media.read_avi(media.avi(payload))
    assert frames.tobytes()[:length] == payload and ms == media.FRAME_MS


def test_shots():
    dark, light = np.full((10, 64), 20, np.uint8), np.full((5, 64), 200, np.uint8)
    assert media.clips(np.concatenate([dark, light]), 40) == [(0, 400), (400, 600)]


@pytest.mark.parametrize("operator", [token_output.token_files, packing.packed, sharding.sharded, lambda d: media.media_features(media.stored(d))])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


@pytest.mark.parametrize("per_round", [3, 40, 32768])
def test_rounds_of_any_size_leave_no_pair_that_pays(per_round):
    ids = np.random.default_rng(1).integers(3, 40, 3000).astype("<u4")
    symbols, rules = token_output.repair(ids, least=3, per_round=per_round)
    assert np.array_equal(token_output.Grammar(rules, token_output.rule_lengths(rules)).expand(symbols), ids)
    left = symbols.tolist()
    assert max(Counter(zip(left, left[1:], strict=False)).values()) < 3


def test_rules_that_contain_themselves_are_refused():
    first = token_output.FIRST_RULE
    with pytest.raises(ValueError):
        token_output.rule_lengths(np.array([[first, 5]], dtype="<u4"))


def test_case_and_signs_share_what_is_remembered():
    tokens, plain = WordTokens(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    text = "Birch birch, (BIRCH) birch. \"birch\" Été, été ÉTÉ; don't 3rd"
    ids, counts = tokens.encode(pa.array([text, None, "birch!"]))
    expected = [plain.encode(t, add_special_tokens=False).ids for t in (text, "birch!")]
    assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(expected[0]), 0, len(expected[1])]
    assert set(tokens.known) == {"", "birch", "été", ",", "(", ")", ".", '"', ";", "!", "don't", "3rd"}


def test_a_full_table_begins_anew():
    tokens, plain = WordTokens(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    tokens.LIMIT = 30
    random = np.random.default_rng(8)
    words = [*("".join(random.choice(list("abÀé漢"), 3)) for _ in range(60)), "x" * 70, "(" * 65 + "A", "Ab" * 32, "Ab" * 32 + ".", "https://a.b/" + "q1" * 40, "-", "漢字" * 50]
    for _ in range(40):
        texts = [" ".join(random.choice(words, random.integers(0, 12))) for _ in range(3)]
        expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        ids, counts = tokens.encode(pa.array(texts))
        assert ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))
        assert len(tokens.known) == len(tokens.bounds) - 1 and max(map(len, tokens.known)) <= tokens.LONG and tokens.bounds[-1] == len(tokens.ids)


@pytest.mark.parametrize("width", [7, 32])
def test_pairs_are_sorted_with_their_places(width):
    left, right = np.random.default_rng(2).integers(1 << width - 1, (1 << width - 1) + 60, (2, 5000)).astype(np.uint32)
    keys, places = token_output.sorted_pairs(left, right, np.uint64(width))
    pairs = list(zip(left.tolist(), right.tolist(), strict=True))
    assert places.tolist() == sorted(range(len(pairs)), key=lambda k: (pairs[k], k))
    assert keys.tolist() == [pairs[k][0] << width | pairs[k][1] for k in places.tolist()]


def test_equal_counts_take_the_smaller_pair_first():
    ids = np.array([9, 8, 2, 5, 6, 2, 5, 6, 2, 9, 8, 2, 7, 7, 7, 7, 7, 2, 7], dtype="<u4")
    symbols, rules = token_output.repair(ids, least=2, per_round=2)
    assert rules.tolist() == [[7, 7], [5, 6], [9, 8]]
    assert np.array_equal(token_output.Grammar(rules, token_output.rule_lengths(rules)).expand(symbols), ids)
