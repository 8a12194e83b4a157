"""Structural differences of documents, by pointer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.canonical import canonical

_ABSENT = object()
#: Longest text of a value in a difference's detail (fixed value).
DETAIL = 60


class _Number(float):
    """A JSON number that remembers how it was written."""

    source: str


def _number(text: str) -> _Number:
    out = _Number(text)
    out.source = text
    return out


def _short(value: object) -> str:
    text = canonical(value)
    return text if len(text) <= DETAIL else text[:DETAIL] + "\u2026"


def _children(value: object) -> dict[str, object]:
    if isinstance(value, dict):
        return {k.replace("~", "~0").replace("/", "~1"): v for k, v in value.items()}
    return {str(k): v for k, v in enumerate(value)}


def tree_differences(expected: object, actual: object) -> Iterator[tuple[str, str, str]]:
    """(pointer, kind, detail) of the topmost nodes where two JSON values differ, in order of pointer."""
    waiting, found = [("", expected, actual)], []
    while waiting:
        pointer, a, b = waiting.pop()
        if a is _ABSENT or b is _ABSENT:
            found.append((pointer, "unexpected" if a is _ABSENT else "missing", _short(b if a is _ABSENT else a)))
        elif type(a) is type(b) and isinstance(a, (dict, list)):
            x, y = _children(a), _children(b)
            waiting += [(f"{pointer}/{k}", x.get(k, _ABSENT), y.get(k, _ABSENT)) for k in x | y]
        elif canonical(a) != canonical(b):
            found.append((pointer, "changed", f"{_short(a)} != {_short(b)}"))
    yield from sorted(found)


def scale_losses(raw: str) -> Iterator[tuple[str, str, str]]:
    """(pointer, kind, detail) of numbers whose text a canonical writer would change, such as 2.0."""
    waiting = [("", json.loads(raw, parse_float=_number, parse_int=_number))]
    while waiting:
        pointer, value = waiting.pop()
        if isinstance(value, _Number):
            plain = canonical(float(value)) if not value.source.lstrip("-").isdigit() else canonical(int(value.source))
            if plain != value.source:
                yield pointer, "decimal-scale", f"{value.source} \u2192 {plain}"
        elif isinstance(value, (dict, list)):
            waiting += [(f"{pointer}/{k}", v) for k, v in _children(value).items()]


def _walked(frame: DataFrame, key: str, texts: list[str], read: Callable[..., Iterator[tuple[str, str, str]]]) -> DataFrame:
    """key, pointer, kind, detail of what `read` finds in each row's JSON texts; rows with a null text have none."""
    kind = frame.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k + 1).to_pylist() for k in range(len(texts))]
            at, out = [], []
            for k, values in enumerate(zip(*columns, strict=True)):
                found = list(read(*values)) if None not in values else []
                at += [k] * len(found)
                out += found
            rest = [pa.array([o[c] for o in out], pa.string()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *rest], names=[key, "pointer", "kind", "detail"])

    return frame.select(key, *texts).mapInArrow(work, f"`{key}` {kind}, pointer string, kind string, detail string")


def json_differences(frame: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """key, pointer, kind, detail of the structural differences of two JSON text columns; narrow, without a shuffle."""
    return _walked(frame, key, [expected, actual], lambda a, b: tree_differences(json.loads(a), json.loads(b)))


def decimal_differences(frame: DataFrame, key: str, raw: str) -> DataFrame:
    return _walked(frame, key, [raw], scale_losses)


def flattened(documents: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """key, pointer, value of flat documents; null members are absent."""
    entries = F.array(*[F.struct(F.lit(f"/{n}").alias("pointer"), c.cast("string").alias("value")) for n, c in fields.items()])
    return documents.select(key, F.explode(entries).alias("e")).select(key, "e.*").filter("value is not null")


def difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, pointer, kind (changed, missing, unexpected), expected, actual of flattened documents."""
    on = [key, "pointer"]
    both = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), on, "full")
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") != F.col("actual"), "changed")
    return both.withColumn("kind", kind).filter("kind is not null").select(*on, "kind", "expected", "actual")


def uncovered(differences: DataFrame, ledger: DataFrame) -> DataFrame:
    """Differences whose pointer no ledger entry covers."""
    return differences.join(ledger.select("pointer").distinct(), "pointer", "left_anti")
