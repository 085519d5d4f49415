"""Slopes, aspects, elevations and walking time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOPE_FLOOR, SLOPE_CAP = 25, 60


def quantise_slope(degrees: Column) -> Column:
    """Whole degrees; below the floor and NaN 0, above the cap the cap."""
    whole = F.floor(degrees).cast("int")
    return F.when(degrees.isNull(), None).when(F.isnan(degrees) | (degrees < SLOPE_FLOOR), 0).otherwise(F.least(whole, F.lit(SLOPE_CAP)))


def octant(aspect: Column, slope: Column) -> Column:
    """1 (north) to 8, clockwise; 0 where the slope is 0."""
    step = F.pmod(F.floor(F.pmod(aspect, F.lit(360.0)) / 45 + 0.5), F.lit(8)).cast("int") + 1
    return F.when(slope == 0, 0).when(F.isnan(aspect), 0).otherwise(step)


def aspect_name(number: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.when(number.between(1, 8), F.get(names, number.cast("int") - 1))


def slope_class(degrees: Column) -> Column:
    """The lower bound of the class: 25, 30, 35, 40, 45; null below 25."""
    return F.when(degrees >= 45, 45).when(degrees >= 25, (F.floor(degrees / 5) * 5).cast("int"))


def terrarium_m(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def naismith_s(distance_m: Column, ascent_m: Column) -> Column:
    """Walking seconds; negatives count as 0, null in gives null."""
    hours = F.greatest(distance_m, F.lit(0.0)) / 5000 + F.greatest(ascent_m, F.lit(0.0)) / 600
    return F.when(distance_m.isNotNull() & ascent_m.isNotNull(), hours * 3600)


def heading_from(compass: Column, accuracy: Column, alpha: Column, absolute: Column, screen: Column) -> Column:
    """Degrees clockwise from north: the compass if trusted, else an absolute alpha, else null."""
    return F.when(
        compass.isNotNull(), F.when(F.coalesce(accuracy, F.lit(0.0)) >= 0, F.pmod(compass + screen, F.lit(360.0)))
    ).when(absolute & alpha.isNotNull(), F.pmod(F.lit(360.0) - alpha + screen, F.lit(360.0)))
