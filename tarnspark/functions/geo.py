"""Geometry of points, boxes and Web Mercator tiles, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
MAX_LATITUDE = 85.0511287798066


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    return F.lit(2 * EARTH_M) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # not least(): that would skip nulls


def planar_dist2(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Squared degrees, with longitudes scaled at the first point."""
    return F.pow((lng2 - lng1) * F.cos(F.radians(lat1)), 2) + F.pow(lat2 - lat1, 2)


def compass_bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """One of eight compass points from the first to the second, ``here`` where they coincide."""
    y = F.sin(F.radians(lng2 - lng1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    step = F.pmod(F.floor(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)) / 45 + 0.5), F.lit(8)).cast("int")
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.when((lng1 == lng2) & (lat1 == lat2), "here").otherwise(F.get(names, step))


def mercator_x(lng: Column) -> Column:
    return (lng + 180) / 360


def mercator_y(lat: Column) -> Column:
    held = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return (F.lit(1.0) - F.ln(F.tan(held) + F.lit(1.0) / F.cos(held)) / math.pi) / 2


def _tile(share: Column, zoom: Column) -> Column:
    last = F.pow(F.lit(2.0), zoom) - 1
    return F.least(F.greatest(F.floor(share * F.pow(F.lit(2.0), zoom)), F.lit(0)), last).cast("bigint")


def tile_x(lng: Column, zoom: Column) -> Column:
    return _tile(mercator_x(lng), zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    return _tile(mercator_y(lat), zoom)


def global_units(share: Column, zoom: Column, extent: int) -> Column:
    """Whole units of a grid with ``extent`` units to a tile."""
    return F.floor(share * F.pow(F.lit(2.0), zoom) * extent + F.lit(0.5)).cast("bigint")


def tile_lng(x: Column, zoom: Column) -> Column:
    """Longitude of a tile's west edge; x may be fractional."""
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def tile_lat(y: Column, zoom: Column) -> Column:
    """Latitude of a tile's north edge; y may be fractional."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - y * 2 / F.pow(F.lit(2.0), zoom)))))


def box_area(w: Column, s: Column, e: Column, n: Column) -> Column:
    return (e - w) * (n - s)


def box_contains(w: Column, s: Column, e: Column, n: Column, lng: Column, lat: Column) -> Column:
    return lng.between(w, e) & lat.between(s, n)


def box_valid(w: Column, s: Column, e: Column, n: Column) -> Column:
    return (w < e) & (s < n) & (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90)


def overlap_share(a: list[Column], b: list[Column]) -> Column:
    """The part of box a that lies in box b."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((wide <= 0) | (high <= 0), 0.0).otherwise(wide * high / box_area(*a))


def quadrants(w: Column, s: Column, e: Column, n: Column) -> Column:
    """North-west, north-east, south-west, south-east."""
    x, y = (w + e) / 2, (s + n) / 2
    part = lambda *v: F.struct(*[c.alias(k) for c, k in zip(v, "wsen")])
    return F.array(part(w, y, x, n), part(x, y, e, n), part(w, s, x, y), part(x, s, e, y))


def region_min_zoom(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.ceil(F.log2(F.lit(360.0) / F.greatest(e - w, n - s))).cast("int")


def compass_label(w: Column, s: Column, e: Column, n: Column, home: list[Column]) -> Column:
    """Where a box lies from the main one: north, south-east and so on, or ``outlying`` where the centres meet."""
    dx, dy = (w + e) / 2 - (home[0] + home[2]) / 2, (s + n) / 2 - (home[1] + home[3]) / 2
    span = F.greatest(F.abs(dx), F.abs(dy))
    span = F.when(span == 0, 1.0).otherwise(span)
    sx = F.when(F.abs(dx) < span / 2, "").when(dx > 0, "east").otherwise("west")
    sy = F.when(F.abs(dy) < span / 2, "").when(dy > 0, "north").otherwise("south")
    name = F.concat_ws("-", F.when(sy != "", sy), F.when(sx != "", sx))
    return F.when(name == "", "outlying").otherwise(name)


def cell_label(w: Column, s: Column, e: Column, n: Column) -> Column:
    """A cell's name and id suffix from its centre."""
    lng, lat = (w + e) / 2, (s + n) / 2
    ns, ew = F.when(lat < 0, "S").otherwise("N"), F.when(lng < 0, "W").otherwise("E")
    a, o = F.rint(F.abs(lat)).cast("int"), F.rint(F.abs(lng)).cast("int")
    return F.struct(
        F.concat(a.cast("string"), F.lit("°"), ns, F.lit(" "), o.cast("string"), F.lit("°"), ew).alias("name"),
        F.concat(F.lower(ns), F.lpad(a.cast("string"), 2, "0"), F.lower(ew), F.lpad(o.cast("string"), 3, "0")).alias("suffix"),
    )
