"""Languages of words in code-switched text by a linear-chain conditional random field.

A word's emission scores add up weights of its affixes and character n-grams (byte 2-, 3- and 4-grams of the word with
edge marks, so those with a mark are its prefixes and suffixes) and of the word itself as a lexicon entry; learned
transitions join neighbours. Training maximises the conditional likelihood by gradient steps, with the marginals of
forward-backward, on sequences spliced from runs of words of labelled documents, so that switches occur. Labelled
documents are at most TRAIN_DOCS, of smallest hash of doc_id in each language, with their whole texts.
Prediction labels every word of every whole text; a document's language is the one with the largest mean marginal.

Texts that are null or without a letter are "und" with score 0. A text's doc_id, source and lang have no influence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, prepare

TRAIN_DOCS = 600
BITS = 17
STEPS = 40
BLOCK = 32
#: Mean length in words of the runs that training sequences are spliced from.
RUN = 30
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L); number signs such as a superscript two are none."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and the start of each word's run among them."""
    marked = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(words)), sizes)
    numbers, owners = [], []
    for n in (2, 3, 4):
        if len(data) < n:
            continue
        gram = np.zeros(len(data) - n + 1, dtype=np.uint64)
        for k in range(n):
            gram = gram * np.uint64(257) + data[k : len(data) - n + 1 + k] + np.uint64(1)
        inside = owner[: len(gram)] == owner[n - 1 :]
        numbers.append(((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))[inside])
        owners.append(owner[: len(gram)][inside])
    lexicon = np.array([xxhash.xxh32_intdigest(m) & ((1 << BITS) - 1) for m in marked], dtype=np.uint64)
    numbers.append(lexicon)
    owners.append(np.arange(len(words)))
    owner, number = np.concatenate(owners), np.concatenate(numbers).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return number[order], np.concatenate([[0], np.cumsum(counts)])[:-1]


@dataclass
class Field:
    """Weights (features, labels), transitions (labels, labels) and the label names."""

    weights: np.ndarray
    transitions: np.ndarray
    labels: list[str]

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        number, starts = features(words)
        return np.add.reduceat(self.weights[number], starts, axis=0).astype(np.float64)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (words, labels) of sequences of the given lengths (over 0), and expected transition counts.

    Sequences are cut into blocks; products of the step matrices of all blocks are formed at once, chained per
    sequence, and then words inside blocks get their forward and backward vectors at once."""
    k = scores.shape[1]
    a = np.exp(transitions - transitions.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    per = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    blocks = int(first[-1])
    begin = np.cumsum(lengths) - lengths
    rank = np.arange(len(scores)) - np.repeat(begin, lengths)
    cell = (np.repeat(first[:-1], lengths) + rank // BLOCK) * BLOCK + rank % BLOCK
    step = np.ones((blocks * BLOCK, k))
    valid = np.zeros(blocks * BLOCK, dtype=bool)
    step[cell], valid[cell] = e, True
    step, valid = step.reshape(blocks, BLOCK, k), valid.reshape(blocks, BLOCK)
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        new = (product.reshape(-1, k) @ a).reshape(blocks, k, k) * step[:, t, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        product = np.where(valid[:, t, None, None], new, product)
    ahead = np.full((blocks, k), 1 / k)  # forward vector before each block
    after = np.full((blocks, k), 1 / k)  # backward vector after each block
    order = np.argsort(-per, kind="stable")
    for depth in range(1, int(per.max()) if len(per) else 0):
        live = order[: np.searchsorted(-per[order], -depth, side="left")]
        at = first[live] + depth
        value = np.einsum("bi,bij->bj", ahead[at - 1], product[at - 1])
        ahead[at] = value / value.sum(axis=1, keepdims=True)
        back = first[live + 1] - 1 - depth
        value = np.einsum("bij,bj->bi", product[back + 1], after[back + 1])
        after[back] = value / value.sum(axis=1, keepdims=True)
    forward, entering = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK, k))
    vector = ahead
    for t in range(BLOCK):
        entering[:, t] = vector
        new = (vector @ a) * step[:, t]
        new /= new.sum(axis=1, keepdims=True)
        vector = np.where(valid[:, t, None], new, vector)
        forward[:, t] = vector
    marginal, counts = np.empty((blocks, BLOCK, k)), np.zeros((k, k))
    vector = after
    for t in range(BLOCK - 1, -1, -1):
        both = forward[:, t] * vector
        marginal[:, t] = both / both.sum(axis=1, keepdims=True)
        weighted = step[:, t] * vector
        joint_sum = np.einsum("bi,ij,bj->b", entering[:, t], a, weighted)
        use = valid[:, t] / joint_sum
        counts += a * ((entering[:, t] * use[:, None]).T @ weighted)
        new = weighted @ a.T
        new /= new.sum(axis=1, keepdims=True)
        vector = np.where(valid[:, t, None], new, vector)
    return marginal.reshape(-1, k)[cell], counts


def spliced(texts: list[list[str]], langs: list[int], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, labels and sequence lengths of training sequences with switches between documents."""
    random = np.random.default_rng(seed)
    runs = []
    for words, lang in zip(texts, langs, strict=True):
        at = 0
        while at < len(words):
            size = int(random.geometric(1 / RUN))
            runs.append((words[at : at + size], lang))
            at += size
    order = random.permutation(len(runs))
    words = [w for k in order for w in runs[k][0]]
    labels = np.concatenate([np.full(len(runs[k][0]), runs[k][1]) for k in order]) if runs else np.empty(0, int)
    lengths = [sum(len(runs[k][0]) for k in order[i : i + 8]) for i in range(0, len(order), 8)]
    return words, labels.astype(int), np.array([n for n in lengths if n], dtype=np.int64)


def fit(texts: list[list[str]], langs: list[str], steps: int = STEPS, rate: float = 0.3, decay: float = 1e-6) -> Field:
    """Adam on the conditional likelihood, summed over all sequences and divided by the number of words."""
    names = sorted(set(langs))
    k = len(names)
    field = Field(np.zeros((1 << BITS, max(k, 1)), dtype=np.float32), np.zeros((max(k, 1), max(k, 1))), names or ["und"])
    words, labels, lengths = spliced(texts, [names.index(x) for x in langs])
    if not words or k < 2:
        return field
    types, which = np.unique(np.array(words, dtype=object), return_inverse=True)
    number, starts = features(types.tolist())
    owner = np.repeat(np.arange(len(types)), np.diff([*starts, len(number)]))
    truth = np.zeros((len(words), k))
    truth[np.arange(len(words)), labels] = 1
    inner = np.ones(len(words), dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    size = (1 << BITS) * k
    state = [np.zeros(size), np.zeros(size), np.zeros((k, k)), np.zeros((k, k))]
    for step in range(1, steps + 1):
        emission = np.add.reduceat(field.weights[number], starts, axis=0).astype(np.float64)
        marginal, expected = forward_backward(emission[which], lengths, field.transitions)
        rest = truth - marginal
        by_type = np.stack([np.bincount(which, weights=rest[:, y], minlength=len(types)) for y in range(k)], axis=1)
        up = np.stack([np.bincount(number, weights=by_type[owner, y], minlength=1 << BITS) for y in range(k)], axis=1).ravel() / len(words) - decay * field.weights.ravel()
        up_t = (seen - expected) / len(words) - 1e-4 * field.transitions
        for i, gradient in ((0, up), (2, up_t)):
            state[i] = 0.9 * state[i] + 0.1 * gradient
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * gradient**2
        scale = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        field.weights += (rate * scale * state[0] / (np.sqrt(state[1]) + 1e-8)).reshape(field.weights.shape).astype(np.float32)
        field.transitions += rate * scale * state[2] / (np.sqrt(state[3]) + 1e-8)
    return field


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def language_model(docs: DataFrame, bound: int = TRAIN_DOCS) -> Field:
    """Learned from text and lang of rows that are not held out; all languages of those rows have examples."""
    prepare(docs.sparkSession)
    usable = docs.filter("lang is not null and text is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    names = usable.select("lang").distinct()
    share = max(1, bound // max(1, names.count()))
    picked = None
    for row in names.orderBy("lang").collect():  # one top-k a language: a language has few names, never the rows of one
        own = usable.filter(F.col("lang") == row["lang"]).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(share)
        picked = own if picked is None else picked.union(own)
    if picked is None:
        return fit([], [])
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(picked.distinct()), ["doc_id", "lang"]).collect()
    sample = sorted(sample, key=lambda r: (r["doc_id"], r["text"]))
    pairs = [(words_of(r["text"]), r["lang"]) for r in sample]
    pairs = [(w, x) for w, x in pairs if w]
    return fit([w for w, _ in pairs], [x for _, x in pairs])


class _Known(dict):
    LIMIT = 400_000


def predicted(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches (neighbouring words of different most likely labels)."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(own.labels)))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                split = [words_of(t) if t else [] for t in column(part, "text").to_pylist()]
                new = list(set().union(*split) - known.keys())
                if len(known) + len(new) > _Known.LIMIT:
                    known, table = {}, table[:0]
                    new = list(set().union(*split))
                if new:
                    known.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    table = _grown(table, own.emissions(new))
                lengths = np.array([len(w) for w in split], dtype=np.int64)
                full = np.flatnonzero(lengths)
                mean, switches = np.zeros((len(split), len(own.labels))), np.zeros(len(split), dtype=np.int64)
                if len(full):
                    numbers = np.fromiter((known[w] for words in split for w in words), dtype=np.int64, count=int(lengths.sum()))
                    marginal, _ = forward_backward(table[numbers], lengths[full], own.transitions)
                    starts = np.cumsum(lengths[full]) - lengths[full]
                    mean[full] = np.add.reduceat(marginal, starts, axis=0) / lengths[full, None]
                    best = marginal.argmax(axis=1)
                    changed = np.concatenate([[0], best[1:] != best[:-1]]).astype(np.int64)
                    changed[starts] = 0
                    switches[full] = np.add.reduceat(changed, starts)
                keys = column(part, "doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array([held_out(d) for d in keys], pa.bool_()), pa.array([own.labels[m.argmax()] if n else "und" for m, n in zip(mean, lengths, strict=True)], pa.string()),
                        pa.array([min(1.0, float(m.max())) if n else 0.0 for m, n in zip(mean, lengths, strict=True)], pa.float64()), pa.array(lengths, pa.int64()), pa.array(switches, pa.int64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long")


def _grown(table: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.concatenate([table, more])


def languages(docs: DataFrame) -> DataFrame:
    return predicted(docs, language_model(docs))
