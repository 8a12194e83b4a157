"""Canonical JSON (RFC 8785) and content hashes of raw documents."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _number(value: float) -> str:
    if isinstance(value, int):
        return _number(float(value)) if abs(value) > 1 << 53 else str(value)
    if not math.isfinite(value):
        raise ValueError("a number must be finite")
    if value == 0:
        return "0"
    short = repr(value)
    mantissa, _, power = short.partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, fraction = mantissa.lstrip("-").partition(".")
    fraction = "" if fraction == "0" else fraction
    point = len(whole) + int(power or 0)
    text = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len(text) if whole == "0" else 0
    text = text.rstrip("0") or "0"
    n = len(text)
    if n <= point <= 21:
        return sign + text + "0" * (point - n)
    if 0 < point <= 21:
        return sign + text[:point] + "." + text[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + text
    e = point - 1
    return sign + text[0] + ("." + text[1:] if n > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"


def canonical(value: object) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"


def content_form(value: dict) -> str:
    """The canonical form without meta.versionId and meta.lastUpdated; an emptied meta vanishes."""
    value = dict(value)
    if isinstance(value.get("meta"), dict):
        meta = {k: v for k, v in value["meta"].items() if k not in ("versionId", "lastUpdated")}
        value.pop("meta")
        if meta:
            value["meta"] = meta
    return canonical(value)


@F.pandas_udf(StringType())
def canonical_json(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in raw:
        yield part.map(lambda t: None if t is None else canonical(json.loads(t)))


@F.pandas_udf(StringType())
def content_hash(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in raw:
        yield part.map(lambda t: None if t is None else hashlib.sha256(content_form(json.loads(t)).encode()).hexdigest())


def flat_canonical(fields: dict[str, Column]) -> Column:
    """Canonical JSON of a flat object of text columns, without Python: keys sorted, nulls written out."""
    parts = []
    for name in sorted(fields):
        quoted = F.regexp_extract(F.to_json(F.struct(fields[name].alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        parts.append(F.concat(F.lit(json.dumps(name) + ":"), F.when(fields[name].isNull(), F.lit("null")).otherwise(quoted)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
