"""Keys, names and file names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# A published file's suffix and its kind, in the order they are tried.
ARTIFACT_KINDS = (
    ("-basemap.pmtiles", "basemap"),
    ("-terrain.pmtiles", "terrain"),
    ("-contours.pmtiles", "contours"),
    ("-paths.pmtiles", "paths"),
    ("-sac.pmtiles", "sac"),
    ("-terrain-features.pmtiles", "terrain-features"),
    ("-avalanche-1.pmtiles", "avalanche"),
    ("-peaks-1.pmtiles", "peaks"),
    ("-landmarks-1.pmtiles", "landmarks"),
    ("-detail-1.pmtiles", "detail"),
    ("-parking-1.pmtiles", "parking"),
    ("-places-1.sqlite", "places"),
)


def osm_key(kind: Column, ident: Column) -> Column:
    """``type/id``; null without an id."""
    return F.when(ident.isNotNull(), F.concat_ws("/", kind, ident.cast("string")))


def artifact_kind(filename: Column) -> Column:
    cases = F
    for suffix, kind in ARTIFACT_KINDS:
        cases = cases.when(filename.endswith(suffix), kind)
    return cases


def region_id_of(filename: Column) -> Column:
    """The region in a published file's name, complete or partial; null for a name of another form."""
    stem = F.regexp_extract(F.regexp_replace(filename, r"\.part$", ""), r"^(.*)\.(?:pmtiles|sqlite)$", 1)
    found = F.regexp_extract(F.regexp_replace(stem, r"-\d+$", ""), r"^(.+)-[^-]+$", 1)
    return F.when(found != "", found)


def safe_id(text: Column) -> Column:
    """Lower case, runs outside a-z, 0-9 and - as one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def clean_name(name: Column, ident: Column) -> Column:
    """Markup and doubled spaces go; a name that is the id or a path becomes its capitalised last part."""
    tidy = F.regexp_replace(F.trim(F.regexp_replace(name, r"(?U)<br\s*/?>", " ")), r"(?U)\s+", " ")
    tail = F.initcap(F.regexp_replace(F.regexp_extract(tidy, "([^/]*)$", 1), "-", " "))
    return F.when((tidy == ident) | tidy.contains("/"), tail).otherwise(tidy)


def _unmarked() -> tuple[str, str]:
    """Letters that canonical decomposition turns into a letter and combining marks, and those letters."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(c) <= 0x36F for c in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def fold_text(text: Column) -> Column:
    """Case and accents away, trimmed: the stored form of search keys.

    Marks go as canonical decomposition finds them, so letters like ł and ø, which it does not take apart, stay. Comparisons
    that need not be stored use the collation UNICODE_CI_AI instead.
    """
    bare = F.regexp_replace(F.translate(text, *_unmarked()), "[\u0300-\u036f]+", "")
    return F.trim(F.lower(bare))


def list_membership(lists: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(lists, ";"), name), F.lit(False))


def parse_latlng(text: Column) -> Column:
    """``struct<lat, lng>`` if the whole text is two numbers in range, else null."""
    form = r"^(-?\d+(?:\.\d+)?)\s*[,\s]\s*(-?\d+(?:\.\d+)?)$"
    lat = F.regexp_extract(F.trim(text), form, 1).try_cast("double")
    lng = F.regexp_extract(F.trim(text), form, 2).try_cast("double")
    return F.when(lat.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lng) <= 180), F.struct(lat.alias("lat"), lng.alias("lng")))
