"""Queries of the raster, contour and tile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.operators import raster as R
from tarnspark.operators import tiles as T
from tarnspark.plans.registry import query
from tarnspark.plans.views import view, with_views

D = lambda sql, *more: with_views(sql, "dem_cells", *more)
CELLS = 'cells AS (SELECT 10 AS z, r AS "row", c AS col, CAST(CASE WHEN z % 90 < 25 THEN 0 ELSE least(z % 90, 60) END AS INTEGER) AS slope, CAST(z % 9 AS INTEGER) AS octant FROM dem_cells)'


def up(name, src, z):
    return f"""{name} AS (SELECT {z} AS z, "row" // 2 AS "row", col // 2 AS col, arg_max(slope, slope * 10 - p) AS slope, arg_max(octant, slope * 10 - p) AS octant FROM (SELECT *, "row" % 2 * 2 + col % 2 AS p FROM {src}
  WHERE "row" < (SELECT (max("row") + 1) // 2 * 2 FROM {src}) AND col < (SELECT (max(col) + 1) // 2 * 2 FROM {src})) GROUP BY "row" // 2, col // 2)"""


PYRAMID = f"{CELLS}, {up('l9', 'cells', 9)}, {up('l8', 'l9', 8)}, pyr AS (SELECT * FROM cells UNION ALL SELECT * FROM l9 UNION ALL SELECT * FROM l8)"


def dem(spark, d):
    return view(spark, d, "dem_cells").select(F.col("r").alias("row"), F.col("c").alias("col"), "z")


def cells(spark, d):
    z = F.col("z") % 90
    return dem(spark, d).select(
        F.lit(10).alias("z"), "row", "col", F.when(z < 25, 0).otherwise(F.least(z, F.lit(60))).cast("int").alias("slope"), (F.col("z") % 9).cast("int").alias("octant")
    )


@query("block_max", D('SELECT r // 4 AS "row", c // 4 AS col, max(z) AS z FROM dem_cells WHERE r < (SELECT (max(r) + 1) // 4 * 4 FROM dem_cells) GROUP BY 1, 2'))
def _(spark, d):
    return R.block_max(dem(spark, d), 4)


@query("pyramid_max", D(f'WITH {PYRAMID} SELECT z, "row", col, slope, octant FROM pyr'))
def _(spark, d):
    return R.pyramid_max(cells(spark, d), 2)


@query("pyramid_invariant", D(f"WITH {PYRAMID} SELECT z, max(slope) AS max_slope, max(slope) = (SELECT max(slope) FROM cells) AS ok FROM pyr GROUP BY z"))
def _(spark, d):
    return R.pyramid_invariant(R.pyramid_max(cells(spark, d), 2))


@query("slope_histogram", D(f"WITH {CELLS} SELECT CASE WHEN slope < 25 THEN 0 WHEN slope >= 45 THEN 45 ELSE slope // 5 * 5 END AS class, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM cells), 4) AS pct FROM cells GROUP BY 1"))
def _(spark, d):
    return R.slope_histogram(cells(spark, d))


@query("horn_slope", D("""WITH n AS (SELECT a.r, a.c, a.z AS z0, o.dr, o.dc, coalesce(b.z, s.z, t.z, a.z) * 1e0 AS z FROM dem_cells a CROSS JOIN (SELECT i AS dr, j AS dc FROM (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)) o
 LEFT JOIN dem_cells b ON b.r = a.r + o.dr AND b.c = a.c + o.dc LEFT JOIN dem_cells s ON s.r = a.r + o.dr AND s.c = a.c LEFT JOIN dem_cells t ON t.r = a.r AND t.c = a.c + o.dc),
g AS (SELECT r, c, sum(z * dc * (2 - abs(dr))) AS gx, sum(z * dr * (2 - abs(dc))) AS gy, 1 / cosh((8000000 - (r + 0.5) * 40) / 6378137.0) AS k FROM n GROUP BY r, c)
SELECT r AS "row", c AS col, round(degrees(atan(sqrt(pow(gx / (k * 320), 2) + pow(gy / (k * 320), 2)))), 4) AS slope, CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE round((degrees(atan2(-gx, gy)) + 360) % 360, 3) % 360 END AS aspect FROM g"""))
def _(spark, d):
    out = R.horn_slope(dem(spark, d), 40.0, -40.0, 8_000_000.0)
    return out.select("row", "col", F.round("slope", 4).alias("slope"), F.when(F.col("slope") == 0, 0.0).otherwise(F.pmod(F.round("aspect", 3), F.lit(360.0))).alias("aspect"))


HIGH = "high AS (SELECT max(r) + 1 AS h FROM dem_cells)"
POINTS = f"{HIGH}, pts AS (SELECT event_id, (event_id * 13 % 1280) / 1e1 AS px, (event_id * 29 % (h * 10)) / 1e1 AS py FROM fixes, high)"


def pixel_points(spark, d):
    """One point for each fix, all over the raster."""
    e = F.col("event_id")
    high = dem(spark, d).agg((F.max("row") + 1).alias("h"))
    return view(spark, d, "fixes").crossJoin(F.broadcast(high)).select("event_id", ((e * 13 % 1280) / 10.0).alias("px"), ((e * 29 % (F.col("h") * 10)) / 10.0).alias("py"))


@query("raster_sample_nearest", D(f'WITH {CELLS}, {POINTS} SELECT event_id, slope, CASE WHEN octant BETWEEN 1 AND 8 THEN octant END AS octant FROM pts LEFT JOIN cells ON "row" = CAST(floor(py) AS INTEGER) AND col = CAST(floor(px) AS INTEGER)', "fixes"))
def _(spark, d):
    return R.raster_sample_nearest(pixel_points(spark, d), "event_id", cells(spark, d))


@query("raster_sample_bilinear", D(f"""WITH {POINTS}, b AS (SELECT event_id, floor(px - 0.5) AS x0, floor(py - 0.5) AS y0, px - 0.5 - floor(px - 0.5) AS fx, py - 0.5 - floor(py - 0.5) AS fy FROM pts),
f AS (SELECT event_id, least(greatest(y0 + dy, 0), h - 1) AS r, least(greatest(x0 + dx, 0), 127) AS c, CASE WHEN dx = 1 THEN fx ELSE 1 - fx END * CASE WHEN dy = 1 THEN fy ELSE 1 - fy END AS w FROM b, high, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dx, dy))
SELECT event_id, round(CASE WHEN count(z) = 4 THEN sum(z * w) END, 4) AS ele FROM f LEFT JOIN dem_cells d ON d.r = f.r AND d.c = f.c GROUP BY event_id""", "fixes"))
def _(spark, d):
    rows = dem(spark, d).agg(F.max("row") + 1).first()[0]
    return R.raster_sample_bilinear(pixel_points(spark, d), "event_id", dem(spark, d), rows, 128).withColumn("ele", F.round("ele", 4))


@query("raster_tile_pack", D(f'WITH {CELLS} SELECT z, CAST(col // 32 AS BIGINT) AS x, CAST("row" // 32 AS BIGINT) AS y, count(*) AS n, CAST(sum(slope) AS BIGINT) AS total FROM cells GROUP BY 1, 2, 3'))
def _(spark, d):
    packed = R.raster_tile_pack(cells(spark, d), 32)
    return packed.select("z", "x", "y", F.size("slope").cast("bigint").alias("n"), F.aggregate("slope", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query("raster_tile_bytes", D(f'WITH {CELLS} SELECT z, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, CAST(slope AS INTEGER) AS slope, CAST(octant AS INTEGER) AS octant FROM cells'))
def _(spark, d):
    """Cells written as tiles of bytes and read back."""
    tiles = R.raster_tile_bytes(cells(spark, d).withColumn("level", F.lit("slope")), 32)
    return R.raster_tile_cells(tiles, 32)


@query("raster_tile_totals", D(f'WITH {CELLS} SELECT z, count(DISTINCT (col // 32, "row" // 32)) AS tiles, count(*) AS cells, count(DISTINCT (col // 32, "row" // 32)) * 2048 AS bytes FROM cells GROUP BY z'))
def _(spark, d):
    return R.raster_tile_totals(R.raster_tile_bytes(cells(spark, d).withColumn("level", F.lit("slope")), 32))


@query("peak_snap", D("WITH high AS (SELECT max(r) + 1 AS h FROM dem_cells), p AS (SELECT event_id, CAST(trunc((event_id * 13 % 1280) / 1e1) AS INTEGER) AS c, CAST(trunc((event_id * 29 % (h * 10)) / 1e1) AS INTEGER) AS r FROM fixes, high) SELECT event_id, r AS \"row\", c AS col, z AS ele FROM (SELECT event_id, d.r, d.c, d.z, row_number() OVER (PARTITION BY event_id ORDER BY d.z DESC, d.r, d.c) AS rn FROM p JOIN dem_cells d ON d.r BETWEEN p.r - 2 AND p.r + 2 AND d.c BETWEEN p.c - 2 AND p.c + 2) WHERE rn = 1", "fixes"))
def _(spark, d):
    return R.peak_snap(pixel_points(spark, d), "event_id", dem(spark, d))


@query("contour_segments", D("""WITH s AS (SELECT a.r, a.c, a.z AS a, b.z AS b, x.z AS x, e.z AS e FROM dem_cells a JOIN dem_cells b ON b.r = a.r AND b.c = a.c + 1 JOIN dem_cells x ON x.r = a.r + 1 AND x.c = a.c + 1 JOIN dem_cells e ON e.r = a.r + 1 AND e.c = a.c),
l AS (SELECT *, unnest(generate_series(CAST(ceil(least(a, b, x, e) / 200e0) AS BIGINT), CAST(floor(greatest(a, b, x, e) / 200e0) AS BIGINT))) * 200 AS level FROM s),
k AS (SELECT level, CASE WHEN a >= level THEN 8 ELSE 0 END + CASE WHEN b >= level THEN 4 ELSE 0 END + CASE WHEN x >= level THEN 2 ELSE 0 END + CASE WHEN e >= level THEN 1 ELSE 0 END AS k FROM l)
SELECT level, CAST(sum(CASE WHEN k IN (0, 15) THEN 0 WHEN k IN (5, 10) THEN 2 ELSE 1 END) AS BIGINT) AS n, CASE WHEN level % 1000 = 0 THEN 1 ELSE 0 END AS idx FROM k GROUP BY level HAVING sum(CASE WHEN k IN (0, 15) THEN 0 ELSE 1 END) > 0"""))
def _(spark, d):
    lines = R.contour_tag(R.contour_segments(dem(spark, d), 200), 1000)
    return lines.groupBy("level", "idx").agg(F.count("*").alias("n"))


@query("contour_tag", D("SELECT r, c, CASE WHEN z % 50 = 0 THEN 1 ELSE 0 END AS idx FROM dem_cells"))
def _(spark, d):
    return R.contour_tag(view(spark, d, "dem_cells").withColumn("level", F.col("z").cast("double"))).select("r", "c", "idx")


@query("contour_cells", with_views("""WITH b AS (SELECT region_id, 100 + region_ord * 37 AS size, CAST(ceil((100 + region_ord * 37) / 256e0) AS BIGINT) AS n FROM map_regions), i AS (SELECT *, unnest(range(n)) AS i FROM b),
s AS (SELECT region_id, CASE WHEN i = 0 THEN 0 ELSE CAST(round_even(size * i / n, 0) AS INTEGER) - 1 END AS lo, CASE WHEN i = n - 1 THEN size ELSE CAST(round_even(size * (i + 1) / n, 0) AS INTEGER) + 1 END AS hi FROM i)
SELECT a.region_id, CAST(a.lo AS INTEGER) AS row_lo, CAST(a.hi AS INTEGER) AS row_hi, CAST(b.lo AS INTEGER) AS col_lo, CAST(b.hi AS INTEGER) AS col_hi FROM s a JOIN s b USING (region_id)""", "map_regions"))
def _(spark, d):
    size = (100 + F.col("region_ord") * 37).cast("int")
    return R.contour_cells(view(spark, d, "map_regions").select("region_id", size.alias("rows"), size.alias("cols")), 256)


@query("raster_grid", with_views("""WITH z AS (SELECT *, CAST(least(greatest(ceil(log2(40075016.685578488 * cos(radians((s + n) / 2)) / (512 * 30))), 9), 12) AS INTEGER) AS zmax FROM map_regions)
SELECT region_id, zmax, CAST(floor((w + 180) / 360 * pow(2, zmax)) AS BIGINT) AS x0, CAST(floor((e + 180) / 360 * pow(2, zmax)) AS BIGINT) + 1 AS x1, CAST(floor((1 - ln(tan(radians(n)) + 1 / cos(radians(n))) / pi()) / 2 * pow(2, zmax)) AS BIGINT) AS y0, CAST(floor((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2 * pow(2, zmax)) AS BIGINT) + 1 AS y1 FROM z""", "map_regions"))
def _(spark, d):
    return R.raster_grid(view(spark, d, "map_regions"))


@query("dem_mosaic", D('SELECT r AS "row", c % 64 AS col, arg_max(z, c // 64) AS z FROM dem_cells GROUP BY 1, 2'))
def _(spark, d):
    return R.dem_mosaic(dem(spark, d).select("row", (F.col("col") % 64).alias("col"), F.floor(F.col("col") / 64).alias("tile"), "z"))


@query("dem_tile_cover", with_views("SELECT region_id AS box_id, concat(CASE WHEN la < 0 THEN 'S' ELSE 'N' END, lpad(CAST(abs(la) AS VARCHAR), 2, '0'), CASE WHEN lo < 0 THEN 'W' ELSE 'E' END, lpad(CAST(abs(lo) AS VARCHAR), 3, '0')) AS tile FROM (SELECT region_id, la, unnest(generate_series(CAST(floor(w) AS BIGINT), CAST(ceil(e) AS BIGINT) - 1)) AS lo FROM (SELECT *, unnest(generate_series(CAST(floor(s) AS BIGINT), CAST(ceil(n) AS BIGINT) - 1)) AS la FROM map_regions))", "map_regions"))
def _(spark, d):
    return R.dem_tile_cover(view(spark, d, "map_regions").withColumnRenamed("region_id", "box_id"))


O = lambda sql: with_views(sql, "osm_points")  # noqa: E731, E741
MERC = "CAST(floor((lon + 180) / 360 * pow(2, z)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y"


def placed(spark, d):
    return view(spark, d, "osm_points").select("src_ord", "name", F.col("lon").alias("lng"), "lat", (10 + F.col("src_ord") % 5).cast("int").alias("minzoom"))


@query("tile_assign", O(f"SELECT src_ord, CAST(z AS INTEGER) AS z, {MERC} FROM (SELECT *, unnest(generate_series(10 + src_ord % 5, 14)) AS z FROM osm_points)"))
def _(spark, d):
    return T.tile_assign(placed(spark, d), "src_ord", 14)


@query("tile_coverage_count", O("SELECT CAST(z AS INTEGER) AS z, count(*) FILTER (WHERE src_ord % 9 > 0 OR z <> 12) AS n, count(*) AS expected, count(*) FILTER (WHERE src_ord % 9 > 0 OR z <> 12) = count(*) AS ok FROM (SELECT *, unnest(generate_series(10 + src_ord % 5, 14)) AS z FROM osm_points) GROUP BY 1"))
def _(spark, d):
    tiled = T.tile_assign(placed(spark, d), "src_ord", 14).where("src_ord % 9 > 0 or z <> 12")
    return T.tile_coverage_count(placed(spark, d), tiled, 14)


@query("tile_coverage_match", O("SELECT src_ord FROM osm_points WHERE src_ord % 6 = 2"))
def _(spark, d):
    named = placed(spark, d).withColumn("name", F.when(F.col("src_ord") % 6 == 2, F.concat(F.lit("lost"), F.col("src_ord").cast("string"))).otherwise(F.col("src_ord").cast("string")))
    return T.tile_coverage_match(named, named.where("src_ord % 6 <> 2").withColumnRenamed("src_ord", "tile_id"), 14).select("src_ord")


@query("tile_untie", O("SELECT src_ord, round(lon, 6) AS lng, round(lat, 6) AS lat FROM osm_points"))
def _(spark, d):
    return T.tile_untie(placed(spark, d), 1).select("src_ord", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))
