"""Joins by place: points in boxes, nearest boxes, and neighbours within a distance, all as equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.functions.geo import EARTH_M, box_area, box_contains, haversine_m, overlap_share
from tarnspark.scratch import stored

#: Cells along one side of the largest box.
MAX_CELLS_A_SIDE = 64
BOX = ["w", "s", "e", "n"]


def cell_degrees(boxes: DataFrame, pad: float = 0.0) -> float:
    """A grid step near the median box side, wide enough that no box covers too many cells."""
    side = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    row = boxes.agg(F.percentile_approx(side, 0.5).alias("mid"), F.max(side).alias("top")).first()
    return max((row["mid"] or 1.0) + 2 * pad, ((row["top"] or 1.0) + 2 * pad) / MAX_CELLS_A_SIDE, 1e-6)


def _span(lo: Column, hi: Column, step: Column | float) -> Column:
    return F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step)))


def bbox_join(points: DataFrame, boxes: DataFrame, lng: str = "lng", lat: str = "lat", pad: float = 0.0) -> DataFrame:
    """Every point with every box (grown by ``pad`` degrees) that holds it, borders included. Null places match nothing.

    Boxes are cut into the cells of their own size class, whose step is the power of two at or above their longer side, so
    a box covers four cells at most, however large others are. A point lies in one cell of each class that occurs, of which
    there are a few dozen at most: this is an equi-join without duplicates.
    """
    side = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")) + 2 * pad
    classed = boxes.withColumn("__level", F.ceil(F.log2(F.least(F.greatest(side, F.lit(2.0**-20)), F.lit(512.0)))).cast("int"))
    levels = [r[0] for r in classed.select("__level").where("__level is not null").distinct().orderBy("__level").collect()]
    step = F.pow(F.lit(2.0), F.col("__level"))
    cells = classed.withColumn("__cx", _span(F.col("w") - pad, F.col("e") + pad, step)).withColumn("__cy", _span(F.col("s") - pad, F.col("n") + pad, step))
    placed = points.where(F.col(lng).isNotNull() & F.col(lat).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumn("__cx", F.floor(F.col(lng) / step)).withColumn("__cy", F.floor(F.col(lat) / step))
    inside = box_contains(F.col("w") - pad, F.col("s") - pad, F.col("e") + pad, F.col("n") + pad, F.col(lng), F.col(lat))
    return placed.join(cells, ["__level", "__cx", "__cy"]).where(inside).drop("__level", "__cx", "__cy")


def region_cut(points: DataFrame, regions: DataFrame, lng: str = "lon", lat: str = "lat") -> DataFrame:
    """Each point once for every region that holds it."""
    return bbox_join(points, regions.select("region_id", *BOX), lng, lat).drop(*BOX)


def region_at(points: DataFrame, key: str, regions: DataFrame, lng: str = "lng", lat: str = "lat", held: DataFrame | None = None) -> DataFrame:
    """The smallest region around each point, of the held ones if given; ties by id. Points outside all are absent."""
    pool = regions if held is None else regions.join(held, "region_id", "left_semi")
    met = bbox_join(points.select(key, lng, lat), pool.select("region_id", *BOX), lng, lat)
    return met.groupBy(key).agg(F.min_by("region_id", F.struct(box_area(*[F.col(c) for c in BOX]), "region_id")).alias("region_id"))


def box_distance2(lng: Column, lat: Column) -> Column:
    """Squared degrees to the box, longitudes scaled at the point; 0 inside."""
    dx = F.greatest(F.col("w") - lng, lng - F.col("e"), F.lit(0.0)) * F.cos(F.radians(lat))
    return dx * dx + F.pow(F.greatest(F.col("s") - lat, lat - F.col("n"), F.lit(0.0)), 2)


#: Points that one task of ``region_nearest`` ranks the regions of.
RANK_POINTS = 20_000


def region_nearest(points: DataFrame, key: str, regions: DataFrame, k: int, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """The k nearest regions of each point, ties on the smaller area, then id: ``key``, region_id, d2, pos.

    Rings of growing reach: points that find k regions surely within a ring are done, the rest try the next; the last
    ring holds the whole world. Only points far from everything get there. Points are dealt into tasks by key before they
    meet regions, as many tasks as they need, so that a task sorts the regions of ``RANK_POINTS`` points at any size.
    """
    boxes = stored(regions.select("region_id", *BOX), "boxes")  # so that the optimizer knows their size
    area = box_area(*[F.col(c) for c in BOX])
    order, whole = Window.partitionBy(key).orderBy("d2", "area", "region_id"), Window.partitionBy(key)
    left, done = stored(points.select(key, lng, lat).where(F.col(lng).isNotNull() & F.col(lat).isNotNull()), "left"), None
    count = left.count()
    for reach in (1.0, 8.0, 400.0):
        dealt = left.repartition(max(1, math.ceil(count / RANK_POINTS)), key)
        met = bbox_join(dealt, boxes, lng, lat, pad=reach).withColumn("d2", box_distance2(F.col(lng), F.col(lat)))
        # A region beyond the ring is at least ``reach`` scaled degrees away.
        sure = F.col("d2") <= F.pow(reach * F.cos(F.radians(F.col(lat))), 2)
        met = met.select(key, "region_id", "d2", area.alias("area"), sure.alias("sure"))
        ranked = met.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= k)
        if reach < 400:
            full = F.max((F.col("pos") == k) & F.col("sure")).over(whole) & F.col(key).isNotNull()
            ranked = ranked.withColumn("full", full).where("full")
        found = stored(ranked.select(key, "region_id", "d2", "pos"), "found")
        done = found if done is None else done.unionByName(found)
        if reach < 400:
            left = stored(left.join(found.where(F.col("pos") == k).select(key), key, "left_anti"), "left", after=(left,))
            count = left.count()
            if not count:
                break
    return done


def covering_region(bounds: DataFrame, key: str, regions: DataFrame, order: str = "region_ord") -> DataFrame:
    """The first region in list order that wholly contains each box of ``bounds`` (key, w, s, e, n)."""
    corners = bounds.select(key, F.col("w").alias("lng"), F.col("s").alias("lat"), F.col("e").alias("__e"), F.col("n").alias("__n"))
    met = bbox_join(corners, regions.select("region_id", order, *BOX)).where((F.col("__e") <= F.col("e")) & (F.col("__n") <= F.col("n")))
    return met.groupBy(key).agg(F.min_by("region_id", order).alias("region_id"))


def prominence_candidates(peaks: DataFrame, key: str, rasters: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Peaks within each raster's extent grown by two pixels; ``rasters`` has region_id, w, s, e, n, res."""
    row = rasters.agg(F.max("res")).first()
    pad = 2 * (row[0] or 0.0)
    met = bbox_join(peaks.select(key, lng, lat), rasters.select("region_id", "res", *BOX), lng, lat, pad)
    grown = F.col("res") * 2
    return met.where(box_contains(F.col("w") - grown, F.col("s") - grown, F.col("e") + grown, F.col("n") + grown, F.col(lng), F.col(lat))).select(key, "region_id")


def overlap_pairs(a: DataFrame, b: DataFrame, min_fraction: float) -> DataFrame:
    """Pairs of boxes (region_id, w, s, e, n) of which b covers more than the fraction of a; never a box with itself.

    Both sides are cut into cells, so only boxes that share ground meet.
    """
    step = max(cell_degrees(a), cell_degrees(b))
    cut = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ["region_id", *BOX]]).withColumn("cx", _span(F.col(p + "w"), F.col(p + "e"), step)).withColumn("cy", _span(F.col(p + "s"), F.col(p + "n"), step))
    share = overlap_share([F.col("a_" + c) for c in BOX], [F.col("b_" + c) for c in BOX])
    met = cut(a, "a_").join(cut(b, "b_"), ["cx", "cy"]).where("a_region_id <> b_region_id").drop("cx", "cy").distinct()
    return met.withColumn("fraction", share).where(F.col("fraction") > min_fraction).select(F.col("a_region_id").alias("id_a"), F.col("b_region_id").alias("id_b"), "fraction")


def same_ground(a: DataFrame, b: DataFrame, fraction: float = 0.95) -> DataFrame:
    """Pairs of boxes that cover each other by more than the fraction, both ways."""
    there, back = overlap_pairs(a, b, fraction), overlap_pairs(b, a, fraction)
    return there.select("id_a", "id_b").join(back.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")), ["id_a", "id_b"], "left_semi")


def swallowed(boxes: DataFrame, fraction: float = 0.9, least: int = 3) -> DataFrame:
    """Boxes that hold more than the fraction of ``least`` others or more: region_id, n and the sorted ids ``inside``."""
    met = overlap_pairs(boxes, boxes, fraction).groupBy(F.col("id_b").alias("region_id")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id_a")).alias("inside"))
    return met.where(F.col("n") >= least)


def tile_region_cut(tiles: DataFrame, regions: DataFrame, max_zoom: int, min_zoom: int = 0) -> DataFrame:
    """Tiles (z, x, y, w, s, e, n and any payload) that overlap each region's box, between two zooms; all but the box stays."""
    step = cell_degrees(regions)
    cut = lambda df: df.withColumn("cx", _span(F.col("w"), F.col("e"), step)).withColumn("cy", _span(F.col("s"), F.col("n"), step))
    boxes = cut(regions.select("region_id", *BOX)).select("region_id", "cx", "cy", *[F.col(c).alias("r" + c) for c in BOX])
    met = cut(tiles.where(F.col("z").between(min_zoom, max_zoom))).join(boxes, ["cx", "cy"]).where("w < re and e > rw and s < rn and n > rs")
    keys = met.select("region_id", "z", "x", "y").distinct()  # a pair may share several cells; the payload is joined once
    payload = [c for c in tiles.columns if c not in ("z", "x", "y", *BOX)]
    return keys.join(tiles.select("z", "x", "y", *payload), ["z", "x", "y"]).select("region_id", "z", "x", "y", *payload) if payload else keys


def _snap_cells(radius_m: float):
    """Row and column of places in cells as high as the radius, a column as wide as it at the row's farther latitude."""
    step = math.degrees(radius_m / EARTH_M)
    row = F.floor(F.col("lat") / step)
    wide = lambda r: F.lit(step) / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(r), F.abs(r + 1)) * step, F.lit(89.9)))), F.lit(1e-3))
    return step, row, wide


def _snap_within(spots: DataFrame, nodes: DataFrame, radius_m: float, k: int) -> DataFrame:
    """The k nearest nodes within a radius of each place (lng, lat): lng, lat, node_id, distance_m, pos."""
    step, row, wide = _snap_cells(radius_m)
    cells = nodes.select("node_id", F.col("lng").alias("nlng"), F.col("lat").alias("nlat"), row.alias("r")).withColumn("c", F.floor(F.col("nlng") / wide(F.col("r"))))
    near = spots.withColumn("r", F.explode(F.array(row - 1, row, row + 1)))
    reach = F.lit(step) / F.greatest(F.cos(F.radians(F.least((F.abs(F.col("lat")) + step), F.lit(89.9)))), F.lit(1e-3))
    near = near.withColumn("c", F.explode(F.sequence(F.floor((F.col("lng") - reach) / wide(F.col("r"))), F.floor((F.col("lng") + reach) / wide(F.col("r"))))))
    met = near.join(cells, ["r", "c"]).withColumn("distance_m", haversine_m(F.col("lng"), F.col("lat"), F.col("nlng"), F.col("nlat")))
    order = Window.partitionBy("lng", "lat").orderBy("distance_m", "node_id")
    ranked = met.where(F.col("distance_m") <= radius_m).withColumn("pos", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("pos") <= k).select("lng", "lat", "node_id", "distance_m", "pos")


def line_snap(points: DataFrame, key: str, nodes: DataFrame, radius_m: float, k: int) -> DataFrame:
    """The k nearest nodes (node_id, lng, lat) within a radius of each point: ``key``, node_id, distance_m, pos.

    Each place is asked once and holds no more than its k least nodes. Where nodes lie close, places first look around within
    a part of the radius that follows the fullest cell, and only those that find fewer than k go on, twice as far each time.
    """
    asked = points.select(key, "lng", "lat").where("lng is not null and lat is not null")
    here = Window.partitionBy("lng", "lat").orderBy("node_id")
    held = nodes.select("node_id", "lng", "lat").where("lng is not null and lat is not null").withColumn("n", F.row_number().over(here)).where(F.col("n") <= k).drop("n")
    held, left = stored(held, "nodes"), asked.select("lng", "lat").distinct()
    _, row, wide = _snap_cells(radius_m)
    full = held.groupBy(row.alias("r"), F.floor(F.col("lng") / wide(row)).alias("c")).count().agg(F.max("count")).first()[0] or 0
    doublings = max(0, math.floor(math.log2(math.sqrt(max(full, 1) / (2 * k)))))
    done = None
    for d in range(doublings, -1, -1):
        found = _snap_within(left, held, radius_m / 2**d, k)
        if d:
            left = stored(left, "left") if d == doublings else left
            found = stored(found, "found")
            settled = found.where(F.col("pos") == k).select("lng", "lat")
            found, left = found.join(settled, ["lng", "lat"], "left_semi"), stored(left.join(settled, ["lng", "lat"], "left_anti"), "left")
        done = found if done is None else done.unionByName(found)
    order = Window.partitionBy(key).orderBy("distance_m", "node_id")
    ranked = asked.join(done.drop("pos"), ["lng", "lat"]).withColumn("pos", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("pos") <= k).select(key, "node_id", "distance_m", "pos")
