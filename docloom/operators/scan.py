"""Scanner for identifiers that could belong to a person: seven rules over JSON documents and one over plain text.

Values leave the scanner as SHA-256 only."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import validators

#: The system of provider numbers and the type code of record numbers.
NPI_SYSTEM = "http://hl7.org/fhir/sid/us-npi"
MRN_TYPE_CODE = "MR"


@dataclass(frozen=True)
class Lists:
    """What is known to be synthetic, and the dictionary of common first names; all are parameters."""

    names: tuple[str, ...] = ()
    npis: tuple[str, ...] = ()
    mrn_systems: tuple[str, ...] = ()
    first_names: tuple[str, ...] = ("margaret", "james", "mary", "john")
    last_year: int = 2026


def _nodes(value: object, pointer: str) -> Iterator[tuple[str, dict]]:
    """Every object of a document with its pointer."""
    waiting = [(pointer, value)]
    while waiting:
        at, node = waiting.pop()
        if isinstance(node, dict):
            yield at, node
        if isinstance(node, (dict, list)):
            waiting += [(f"{at}/{k}", v) for k, v in (node.items() if isinstance(node, dict) else enumerate(node))]


def _name_parts(node: dict) -> list[tuple[str, str]]:
    family, given = node.get("family"), node.get("given")
    parts = [("family", family)] if isinstance(family, str) else []
    return parts + [(f"given/{k}", g) for k, g in enumerate(given if isinstance(given, list) else []) if isinstance(g, str)]


_SCHEMA = pa.schema([("pointer", pa.string()), ("rule", pa.string()), ("value", pa.string())])


def candidates(raw: str, lists: Lists) -> list[tuple[str, str, str]]:
    """(pointer, rule, value) of everything that has a rule's place or shape; validity of numbers is checked in the JVM."""
    out: list[tuple[str, str, str]] = []
    document = json.loads(raw)
    common = []
    for at, node in _nodes(document, ""):
        for place, part in _name_parts(node):
            if not re.search(r"[0-9]", part) and part.lower() not in lists.names:
                out.append((f"{at}/{place}", "name-marker", part))
            if part.lower() in lists.first_names:
                common.append((f"{at}/{place}", part))
        out += [(f"{at}/{k}", "ssn-structural", v) for k, v in node.items() if isinstance(v, str) and re.fullmatch(r"\s*[0-9]{3}-[0-9]{2}-[0-9]{4}\s*", v)]
        value, system = node.get("value"), node.get("system")
        if not isinstance(value, str):
            continue
        if system == "phone":
            out.append((f"{at}/value", "phone-nanp", value))
        if system == NPI_SYSTEM and value not in lists.npis:
            out.append((f"{at}/value", "npi-luhn", value))
        kind = node.get("type")
        codes = kind.get("coding") if isinstance(kind, dict) else None
        typed = any(isinstance(c, dict) and c.get("code") == MRN_TYPE_CODE for c in (codes if isinstance(codes, list) else []))
        if (typed or (isinstance(system, str) and "mrn" in system.lower())) and system not in lists.mrn_systems:
            out.append((f"{at}/system", "mrn-system", value))
    birth = document.get("birthDate") if isinstance(document, dict) else None
    if common and isinstance(birth, str) and re.fullmatch(r"\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*", birth) and 1900 <= int(birth.strip()[:4]) <= lists.last_year:
        out.append(("", "compound-identity", "|".join(part for _, part in sorted(common))))
    return out


def findings(frame: DataFrame, key: str, raw: str, lists: Lists | None = None) -> DataFrame:
    """key, pointer, rule, value_sha256 of each finding in a column of JSON texts."""
    lists, kind = lists or Lists(), frame.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = candidates(text, lists) if text else []
                at += [k] * len(found)
                out += found
            rest = [pa.array([o[c] for o in out], pa.string()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *rest], names=[key, *_SCHEMA.names])

    shaped = frame.select(key, raw).mapInArrow(work, f"`{key}` {kind}, pointer string, rule string, value string")
    rule, value = F.col("rule"), F.col("value")
    valid = (
        F.when(rule == "ssn-structural", validators.ssn_valid(value)).when(rule == "phone-nanp", validators.nanp_valid(value) & ~validators.fictional_phone(value))
        .when(rule == "npi-luhn", validators.npi_valid(value)).otherwise(F.lit(True))
    )
    return shaped.filter(F.coalesce(valid, F.lit(False))).select(key, "pointer", "rule", F.sha2("value", 256).alias("value_sha256"))


def ssn_in_text(frame: DataFrame, key: str, text: str) -> DataFrame:
    """key, value_sha256 of each dashed number in plain text that can have been issued."""
    found = frame.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), F.lit(0))).alias("value"))
    return found.filter(validators.ssn_valid(F.col("value"))).select(key, F.sha2("value", 256).alias("value_sha256"))


def value_sha256(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
