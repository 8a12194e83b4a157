"""Toxicity by a classifier chain over word presence.

The categories stand in a fixed order (low quality, toxic, severe: toxic and low in quality). Each has a logistic
regression on the words that tell it apart in the training sample, and from the second on also on the log-odds of
the categories before it. In training those come from models of the other folds, so a later model sees them as
noisy as they are on new texts. The sample is at most TRAIN_ROWS labelled rows, those of smallest hash of doc_id; one
task gathers and fits it, so the driver holds the weights alone. Prediction covers every document and its whole text.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased; a word of more than STEM bytes also counts as
its first STEM bytes, so that inflected forms share a feature. Null and empty texts have no words and get
the intercepts' probabilities. Without labels, or with one class only, a category's model is constant.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, prepare, utf8
from docloom.llm.decontaminate import words_of

CATEGORIES = ("low_quality", "toxic", "severe")
TRAIN_ROWS = 8000
FOLDS = 3
#: A word is a feature of a category if its chi-square statistic (one degree of freedom) is over this; at most MOST.
SIGNIFICANT = 15.0
MOST = 500
LEAST_DOCS = 3
STEM = 5
#: Training rows that are spread out as floating-point numbers at once.
FIT_ROWS = 512


def features_of(text: bytes | None) -> set[bytes]:
    words = set(words_of(text))
    return words | {b"^" + w[:STEM] for w in words if len(w) > STEM}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _blocks(present: np.ndarray, earlier: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The rows in blocks of numbers, with a column of ones last."""
    for begin in range(0, len(present), FIT_ROWS):
        own = slice(begin, begin + FIT_ROWS)
        yield own, np.hstack([present[own].astype(float), earlier[own], np.ones((len(earlier[own]), 1))])


def _odds(present: np.ndarray, earlier: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0), *[x @ w for _, x in _blocks(present, earlier)]])


def fit_logistic(present: np.ndarray, earlier: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of the words' presence (0 or 1), of the columns before and of the intercept, by Newton's method; the classes
    weigh the same."""
    width = present.shape[1] + earlier.shape[1] + 1
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    ridge = np.full(width, penalty)
    ridge[-1] = 1e-3
    w = np.zeros(width)
    for _ in range(steps):
        gradient, hessian = ridge * w, np.diag(ridge)
        for own, x in _blocks(present, earlier):
            p = _sigmoid(x @ w)
            gradient += x.T @ (weight[own] * (p - y[own]))
            hessian += (x * (weight[own] * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x
        move = np.linalg.solve(hessian, gradient)
        w -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-4:
            break
    return w


@dataclass
class Link:
    """One category's model: weights by word hash, of the log-odds before it, and the intercept."""

    words: dict[int, float]
    earlier: np.ndarray
    intercept: float


@dataclass
class Chain:
    links: list[Link]

    def table(self) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for k, link in enumerate(self.links):
            for word, value in link.words.items():
                out.setdefault(word, np.zeros(len(self.links)))[k] = value
        return out


def _numbered(docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct words in order, and each document's as their numbers."""
    flat = np.concatenate([np.empty(0, np.uint64), *docs])
    flat.sort()
    words = flat[np.append(True, flat[1:] != flat[:-1])[: len(flat)]]
    return words, [np.searchsorted(words, d).astype(np.int32) for d in docs]


def _holders(docs: list[np.ndarray], count: int) -> np.ndarray:
    """How many documents hold each word."""
    total = np.zeros(count)
    for d in docs:
        total[d] += 1
    return total


def _chosen(docs: list[np.ndarray], y: np.ndarray, count: int) -> np.ndarray:
    """The words (numbers under count) whose presence depends most on the category."""
    n, positive = len(docs), y.sum()
    df = _holders(docs, count)
    a = _holders([d for d, t in zip(docs, y, strict=True) if t], count)
    b, c = df - a, positive - a
    d = n - positive - b
    chi = n * (a * d - b * c) ** 2 / np.maximum(1e-9, df * (n - df) * positive * (n - positive))
    best = np.argsort(-chi, kind="stable")[:MOST]
    return np.sort(best[(chi[best] > SIGNIFICANT) & (df[best] >= LEAST_DOCS)])


def _matrix(docs: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(docs), len(words)), dtype=np.uint8)
    if len(words):
        for k, d in enumerate(docs):
            at = np.minimum(np.searchsorted(words, d), len(words) - 1)
            x[k, at[words[at] == d]] = 1
    return x


def fit_chain(docs: list[np.ndarray], labels: np.ndarray) -> Chain:
    """docs: distinct word hashes; labels: one 0/1 column for each category."""
    hashes, docs = _numbered(docs)
    earlier = np.zeros((len(docs), 0))
    links = []
    fold = np.arange(len(docs)) % FOLDS
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        if len(docs) == 0 or y.min() == y.max():
            constant = 0.0 if len(docs) == 0 else (8.0 if y[0] else -8.0)
            links.append(Link({}, np.zeros(earlier.shape[1]), constant))
            earlier = np.hstack([earlier, np.full((len(docs), 1), constant / 4)])
            continue
        words = _chosen(docs, y, len(hashes))
        w = fit_logistic(_matrix(docs, words), earlier, y)
        links.append(Link(dict(zip(hashes[words].tolist(), w[: len(words)].tolist(), strict=True)), w[len(words) : -1], float(w[-1])))
        unseen = np.zeros(len(docs))
        for f in range(FOLDS):
            train = fold != f
            if y[train].min() == y[train].max():
                continue
            seen, rest = ([d for d, t in zip(docs, train, strict=True) if t == side] for side in (True, False))
            inner = _chosen(seen, y[train], len(hashes))
            wf = fit_logistic(_matrix(seen, inner), earlier[train], y[train])
            unseen[~train] = _odds(_matrix(rest, inner), earlier[~train], wf)
        earlier = np.hstack([earlier, np.clip(unseen, -8, 8)[:, None] / 4])
    return Chain(links)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """At most `bound` labelled documents: doc_id, quality, toxic and words (the distinct hashes as uint64 bytes)."""
    known = labels.filter("quality is not null and toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.array(sorted(xxhash.xxh64_intdigest(w) for w in features_of(t)), dtype=np.uint64).tobytes() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "quality"), column(batch, "toxic"), pa.array(sets, pa.binary())], names=["doc_id", "quality", "toxic", "words"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    picked = picked.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), "text")
    return picked.mapInArrow(work, "doc_id long, quality long, toxic long, words binary")


def toxicity_model(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Chain:
    """The chain of the training rows, fitted in one task."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        marks = [np.zeros((0, 2), dtype=int)]
        for batch in batches:
            sets += [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column(batch, "words")]
            marks.append(np.stack([column(batch, "quality").to_numpy() == 0, column(batch, "toxic").to_numpy() == 1], axis=1).astype(int))
        bad, toxic = np.concatenate(marks).T
        chain = fit_chain(sets, np.stack([bad, toxic, bad * toxic], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    gathered = training_rows(docs, labels, bound).repartition(1).sortWithinPartitions("doc_id", "words")
    found = gathered.mapInArrow(work, "chain binary").collect()
    return pickle.loads(found[0]["chain"]) if found else fit_chain([], np.zeros((0, len(CATEGORIES)), dtype=int))


class _Weights(dict):
    """Rows of the weight table for a word and its stem; features without weight have row 0. Remembers a bounded number."""

    def __init__(self, numbers: dict[int, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        parts = [word, b"^" + word[:STEM]] if len(word) > STEM else [word]
        value = self[word] = tuple(filter(None, (self.numbers.get(xxhash.xxh64_intdigest(p), 0) for p in parts)))
        return value


class Scorer:
    """A chain ready to give the probabilities of texts."""

    def __init__(self, chain: Chain):
        self.links, by_word = chain.links, chain.table()
        self.table = np.vstack([np.zeros((1, len(self.links))), *[v[None, :] for v in by_word.values()]])
        self.rows_of = _Weights({w: k + 1 for k, w in enumerate(by_word)})

    def chances(self, texts: list[bytes | None]) -> np.ndarray:
        base = np.zeros((len(texts), len(self.links)))
        for k, text in enumerate(texts):
            used = {n for w in set(words_of(text)) for n in self.rows_of[w]}
            base[k] = self.table[sorted(used)].sum(axis=0) if used else 0
        odds = np.zeros_like(base)
        for k, link in enumerate(self.links):
            odds[:, k] = base[:, k] + link.intercept + (np.clip(odds[:, :k], -8, 8) / 4) @ link.earlier
        return _sigmoid(odds)


def accepted(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the chain does not call toxic, with all their columns."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(chain)
    toxic = CATEGORIES.index("toxic")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.chances(utf8(batch, "text"))[:, toxic] < threshold))

    return docs.mapInArrow(work, docs.schema)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> for each category."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in CATEGORIES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, links = Scorer(held.value), held.value.links
        for batch in batches:
            chances = scorer.chances(utf8(batch, "text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(chances[:, k], pa.float64()) for k in range(len(links))]], names=[*batch.schema.names, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *[f"{n} double" for n in names]])
    return docs.mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, the categories' probabilities and rejected (p_toxic at the threshold; p_severe is given but
    decides nothing), per document."""
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), toxicity_model(docs, labels, bound))
    return found.select("doc_id", *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= threshold).alias("rejected"))
