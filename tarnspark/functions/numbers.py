"""Numbers out of free text, and rounding that looks at a double's exact value."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """Decimal digits of every script but ASCII, and their ASCII values."""
    found = [(chr(c), str(unicodedata.digit(chr(c)))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *_digits())


def round_exact(value: Column, places: int) -> Column:
    """Round a double by its exact binary value, ties to even; null and NaN pass through.

    The product with the power of ten is split into a double and its exact error, so a value that only looks like a
    tie in decimal goes to the side it is really on.
    """
    scale = float(10**places)
    product = value * F.lit(scale)
    big = value * F.lit(134217729.0)
    high = big - (big - value)
    error = (high * F.lit(scale) - product) + (value - high) * F.lit(scale)
    low = F.floor(product).cast("double")
    beyond = product - (low + F.lit(0.5))
    odd = F.pmod(low, F.lit(2.0)) == 1.0
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & odd)))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(product) >= 2.0**52), value).otherwise((low + up.cast("int")) / F.lit(scale) + F.lit(0.0))


def coord7(value: Column) -> Column:
    """Round half away from zero at 7 decimals."""
    return F.signum(value) * F.floor(F.abs(value) * 1e7 + F.lit(0.5)) / 1e7


def parse_elevation(text: Column) -> Column:
    """The first number of the text without its commas, to 0.1; null beyond -500 to 9000."""
    found = F.regexp_extract(F.regexp_replace(ascii_digits(text), ",", ""), r"-?[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    return F.when(found.between(-500, 9000), round_exact(found, 1))


def parse_population(text: Column) -> Column:
    """Digits with commas, spaces or a leading plus; anything else, and what exceeds a long, is null."""
    bare = F.regexp_replace(F.regexp_replace(ascii_digits(F.trim(text)), r"^\+", ""), r"[, ]", "")
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("bigint"))


def parse_number_strict(value: Column) -> Column:
    """The value of a VARIANT that is a JSON number; strings, booleans and the rest give null."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))


# The official grade names, longest first, and their grades.
GRADE_NAMES = (
    ("demanding_mountain_hiking", 3),
    ("demanding_alpine_hiking", 5),
    ("difficult_alpine_hiking", 6),
    ("mountain_hiking", 2),
    ("alpine_hiking", 4),
    ("hiking", 1),
)
# Fixed value: what separates the grades of a range.
_SEPARATORS = r"(?U)[;,/|]|\s+-\s+|-|–|—|\bto\b|\bor\b"


def _named(text: Column, test) -> Column:
    cases = None
    for name, grade in GRADE_NAMES:
        cases = F.when(test(text, name), grade) if cases is None else cases.when(test(text, name), grade)
    return cases


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _part_grade(part: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_stripped(part), r"^[()\[\]]+|[()\[\]]+$", ""), "^_+|_+$", "")
    short = F.regexp_extract(F.regexp_replace(bare, "_", ""), r"^t?\s*([1-6])\s*[+-]?$", 1)
    return F.coalesce(_named(bare, lambda t, n: t == n), short.try_cast("int"), _named(bare, lambda t, n: t.contains(n)))


def parse_grade(text: Column) -> Column:
    """A trail grade from 1 to 6 in a text: a name, a shorthand, or the hardest part of a range; else null."""
    plain = F.regexp_replace(F.lower(_stripped(text)), " ", "_")
    parts = F.transform(F.split(plain, _SEPARATORS, -1), _part_grade)
    return F.coalesce(_named(plain, lambda t, n: t == n), F.array_max(parts))


def parse_grade_number(value: Column) -> Column:
    """A trail grade from a JSON number, truncated."""
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    return F.when(whole.between(1, 6), whole.cast("int"))
