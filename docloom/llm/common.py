"""What the corpus operators share: reading, shared-folder cuts, word hashing and Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of one Arrow batch; keeps a batch of ordinary documents within a few MB.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small."""
    environment = spark.sparkContext.environment
    if _REPO not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_REPO, environment.get("PYTHONPATH", "")]))
    environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where all tasks share one machine."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = os.path.join(tempfile.gettempdir(), f"docloom-{os.getpid()}")
    return set_dir.rstrip("/")


_OPEN: list[Cuts] = []


class Cuts:
    """Lineage cuts: tables written to the shared folder and read again, dropped when a later one replaces them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}
        _OPEN.append(self)

    def cut(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.made):03d}"
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        self.made[id(back)] = (path, back)
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete cut tables that no later result reads."""
        for frame in frames:
            remove_folder(self.spark, self.made[id(frame)][0])


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the cuts made inside; for callers that write an operator's result before the end."""
    before = len(_OPEN)
    try:
        yield
    finally:
        while len(_OPEN) > before:
            cuts = _OPEN.pop()
            remove_folder(cuts.spark, cuts.root)


#: At most this many keys are taken out as hot and broadcast, and none with fewer rows than the least.
HOT_KEYS, HOT_ROWS = 2048, 1000


def split_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left joined with right (one row a key, n of them in left's total rows) by key, without n.

    Keys that hold more than one in HOT_KEYS of all rows are fewer than HOT_KEYS, so their few rows of right are broadcast
    and left's stay where they are; the rest is a merge join, whose largest key is small."""
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = F.broadcast(right.filter(F.col("n") > bound).drop("n")), right.filter(F.col("n") <= bound).drop("n")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold.hint("merge"), key))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as bytes, without decoding."""
    return pc.cast(batch.column(batch.schema.get_field_index(name)), pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: One random number for each byte value; a word's hash is a polynomial over them.
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def hashed_strings(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each string's bytes, and numbers that are equal where the bytes are equal."""
    coded = strings.dictionary_encode()
    words = pc.cast(coded.dictionary, pa.large_binary())
    if not len(words):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    begins, sizes = ends[:-1], np.diff(ends)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _BASE, dtype=np.uint64)]))
    place = np.arange(len(raw)) - np.repeat(begins - ends[0], sizes)
    sums = np.concatenate([_BYTES[raw] * powers[place], [np.uint64(0)]])
    total = np.add.reduceat(sums, begins - ends[0], dtype=np.uint64)
    total[sizes == 0] = 0
    found = mixed(total + powers[sizes])
    codes = coded.indices.to_numpy()
    return found[codes], codes


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z lower-cased, and where each text's begin (one more at the end).

    Words are runs of bytes other than ASCII white space; a null text has none. All of it runs in Arrow and numpy, with
    no loop over words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return hashed_strings(words)[0][full], before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


_STEP = np.uint64(_BASE)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that polynomial sums order like random numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` consecutive word hashes; a shorter sequence is one run."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    runs = len(hashes) - size + 1
    total = hashes[:runs].copy()
    for k in range(1, size):
        total = total * _STEP + hashes[k : k + runs]
    return mixed(total + np.uint64(size))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(rolled(hashes, size))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def rows(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream, each as a table; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [column(batch, k) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for part in parts:
            values = part.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        first = tuple(p[0].as_py() for p in parts)
        change[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end and begin == 0:  # the batch starts a new run
                if held:
                    yield pa.Table.from_batches(held)
                    held = []
                continue
            if begin and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
        last = tuple(p[batch.num_rows - 1].as_py() for p in parts)
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(frame: DataFrame, text: str) -> int:
    """Bytes of a text column and 16 for each row; one pass over the lengths."""
    return int(frame.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(16)).alias("n")).first()["n"] or 0)


def partitions_for(frame: DataFrame, text: str, target_bytes: int, least: int = 1) -> int:
    """How many partitions hold `target_bytes` of text each."""
    return max(least, -(-text_bytes(frame, text) // target_bytes))
