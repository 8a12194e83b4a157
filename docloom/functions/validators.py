"""Scalar checks and small formats, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def safe_uuid(text: Column) -> Column:
    """The lower-cased uuid, or null for anything else."""
    return F.when(text.rlike(_UUID), F.lower(text))


def pointer_escape(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_iso_millis(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn_valid(digits: Column) -> Column:
    """Luhn's check over a string of digits."""
    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * 2
        return total + F.when(pair["i"] % 2 == 0, pair["d"]).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    pairs = F.transform(F.reverse(_digits(digits)), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add) % 10 == 0


def npi_valid(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{10}$"), luhn_valid(F.concat(F.lit("80840"), trimmed))).otherwise(F.lit(False))


def _verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    """Multiplication in the dihedral group of order ten, and the powers of Verhoeff's permutation."""
    multiply = [[(a + b) % 5 if a < 5 and b < 5 else (a + b % 5) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    while len(powers) < 8:
        powers.append([first[d] for d in powers[-1]])
    return multiply, powers


def verhoeff_valid(digits: Column) -> Column:
    multiply, powers = _verhoeff_tables()
    table = F.array(*[F.lit(x) for row in multiply for x in row])
    permute = F.array(*[F.lit(x) for row in powers for x in row])
    pairs = F.transform(F.reverse(_digits(digits)), lambda d, i: F.get(permute, (i % 8) * 10 + d))
    return F.aggregate(pairs, F.lit(0), lambda c, p: F.get(table, c * 10 + p)) == 0


def sctid_valid(code: Column) -> Column:
    """Format of a concept id: 6 to 18 digits, no leading zero, partition 0, 1 or 2, check digit."""
    shape = code.rlike("^[1-9][0-9]{5,17}$")
    return F.when(shape, F.substring(code, -3, 1).isin("0", "1", "2") & verhoeff_valid(code)).otherwise(F.lit(False))


def ssn_valid(text: Column) -> Column:
    """A dashed number that can have been issued."""
    area, group, serial = (F.regexp_extract(F.trim(text), r"^(\d{3})-(\d{2})-(\d{4})$", k) for k in (1, 2, 3))
    return F.coalesce((area != "") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"), F.lit(False))


def nanp_digits(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))


def nanp_valid(text: Column) -> Column:
    return F.coalesce(nanp_digits(text).rlike("^[2-9][0-9]{2}[2-9]"), F.lit(False))


def fictional_phone(text: Column) -> Column:
    return F.coalesce(nanp_digits(text).rlike("^[0-9]{3}55501"), F.lit(False))


def plausible_birth_date(text: Column, last_year: int) -> Column:
    year = F.regexp_extract(F.trim(text), r"^(\d{4})-\d{2}-\d{2}$", 1)
    return F.when(year != "", year.cast("int").between(1900, last_year)).otherwise(F.lit(False))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based uuid (SHA-1) of a namespace uuid and a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
