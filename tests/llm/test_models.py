import hashlib
import itertools
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

import __spark_entry__
from docloom.llm import decontaminate, langid, toxicity
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    long_text = texts[14]
    own = long_text.split(" ")
    rows = [(1, " ".join(own[100:130])), (2, "two words"), (3, None), (4, "  "), (5, "not here at all"), (11, " ".join(own[110:125])), (12, "stop! now?"), (None, "one"), (2, "elsewhere entirely")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_equals_brute_force(docs, benchmark):
    phrases = {}
    for r in benchmark.collect():
        w = words(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add(r["item_id"])
    expected = {}
    for d in docs.collect():
        w, hit, items = words(d["text"]), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= own
        items = sorted(str(i) for i in items if i is not None)
        expected[d["doc_id"]] = (len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit))
    found = decontaminate.contamination(docs, benchmark).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == expected[r["doc_id"]]


def test_decontaminated_texts(docs, benchmark, texts):
    found = {r["doc_id"]: r for r in decontaminate.decontaminated(docs, benchmark).collect()}
    clean = found[43]["text"].split(" ")
    own = texts[14].split(" ")
    assert len(own) - len(clean) in (29, 30) and found[43]["odd name"] == 1 and found[1]["text"] is None and found[58]["text"] == texts[19]
    assert decontaminate.decontaminated(docs.limit(0), benchmark).count() == 0 and decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_fm_index():
    random = np.random.default_rng(1)
    values = np.concatenate([random.integers(1, 4, 500), [0]])
    index = decontaminate.FMIndex(values)
    for size in (1, 2, 5):
        phrases = np.array(list(itertools.product([1, 2, 3, 9], repeat=size))[:200])
        found, low, high = index.search(phrases)
        got = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(found, low, high, strict=True)}
        for k, phrase in enumerate(phrases):
            at = [i for i in range(501 - size) if (values[i : i + size] == phrase).all()]
            assert got.get(k, []) == at


def test_forward_backward_equals_enumeration():
    random = np.random.default_rng(2)
    for lengths in ([5, 1, 3], [70]):
        scores, transitions = random.normal(size=(sum(lengths), 2)), random.normal(size=(2, 2))
        marginal, counts = langid.forward_backward(scores, np.array(lengths), transitions)
        at, expected_counts = 0, np.zeros((2, 2))
        for n in lengths:
            own = scores[at : at + n]
            a, e = np.exp(transitions), np.exp(own)
            forward, backward = [e[0]], [np.ones(2)]
            for t in range(1, n):
                forward.append((forward[-1] @ a) * e[t])
                backward.append(a @ (e[n - t] * backward[-1]))
            start = np.full(2, 0.5) @ a  # the first word is entered from an even state
            forward = [start * e[0]]
            for t in range(1, n):
                forward.append((forward[-1] @ a) * e[t])
            both = np.array(forward) * np.array(backward[::-1])
            assert np.allclose(marginal[at : at + n], both / both.sum(axis=1, keepdims=True))
            entering = [np.full(2, 0.5), *forward[:-1]]
            for t in range(n):
                joint = a * np.outer(entering[t], e[t] * backward[n - 1 - t])
                expected_counts += joint / joint.sum()
            at += n
        assert np.allclose(counts, expected_counts)


def test_languages(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.language_model(table, bound=80)
    rows = {r["doc_id"]: r for r in langid.predicted(table, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    held = [k for k in rows if rows[k]["held_out"]]
    assert np.mean([rows[k]["lang_pred"] == truth[k] for k in held]) > 0.95
    odd = langid.predicted(docs, model).collect()
    assert len(odd) == docs.count() and all((r["lang_pred"] == "und") == (r["n_words"] == 0) and 0 <= r["score"] <= 1 for r in odd)
    assert langid.languages(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rows, marks = [], []
    for k in range(300):
        toxic = k % 5 == 0
        rows.append((k, prose(9000 + k, 40) + (f" you idiot{k % 3} " if toxic else " you ") + prose(k, 30)))
        if k < 200:
            marks.append((k, int(k % 3 > 0), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (250, None, 1)], "doc_id long, quality long, toxic long")
    found = {r["doc_id"]: r for r in toxicity.toxicity(table, labels).collect()}
    assert np.mean([found[k]["rejected"] == (k % 5 == 0) for k in range(200, 300)]) > 0.97
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    chain = toxicity.toxicity_model(table, labels)
    kept = toxicity.accepted(docs, chain)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_toxicity_training_stays_out_of_the_driver(spark, monkeypatch):
    random = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{w}" for w in random.integers(0, 5000, 600)) + (" idiot" if k % 4 == 0 else "")) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    labels = spark.createDataFrame([(k, k % 3, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality long, toxic long")
    table.count()
    tracemalloc.start()
    chain = toxicity.toxicity_model(table, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_000_000  # the words of all training rows take over 1.5 MB
    assert xxhash.xxh64_intdigest(b"idiot") in chain.links[1].words
    sets = [np.array(sorted(xxhash.xxh64_intdigest(w) for w in toxicity.features_of(t.encode())), dtype=np.uint64) for _, t in rows]
    bad, toxic = np.array([[k % 3 == 0, k % 4 == 0] for k in range(400)], dtype=int).T
    for size in (7, 10_000):
        monkeypatch.setattr(toxicity, "FIT_ROWS", size)
        for own, other in zip(chain.links, toxicity.fit_chain(sets, np.stack([bad, toxic, bad * toxic], axis=1)).links, strict=True):
            assert own.words.keys() == other.words.keys() and np.allclose(list(own.words.values()), list(other.words.values()))
            assert np.allclose(own.earlier, other.earlier) and np.isclose(own.intercept, other.intercept)


def test_fit_spreads_few_rows_at_once():
    docs = [np.arange(k % 4, 1600, 4, dtype=np.uint64) for k in range(4000)]
    labels = np.array([[k % 4 == 0, k % 8 < 4] for k in range(4000)], dtype=int)
    tracemalloc.start()
    chain = toxicity.fit_chain(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chain.links[0].words) == toxicity.MOST and most < 40e6  # 4000 rows of 500 numbers alone are 16 MB, copied several times


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after.cache()
    pieces = corpus_pipeline.into_sequences(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_number_signs_are_no_letters():
    assert langid.words_of("² ½ ① 7") == [] and langid.words_of("a²b É x1y") == ["a", "b", "é", "x", "y"]
