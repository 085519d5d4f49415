"""Rasters as long tables (region_id?, row, col, z): pyramids, slopes, sampling, packing into tiles, contours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tarnspark.functions.geo import box_area
from tarnspark.scratch import stored


def region_priority(scores: DataFrame, key: str, regions: DataFrame) -> DataFrame:
    """Each peak's value from the largest region around it; of equal areas the later region's."""
    area = regions.select("region_id", "region_ord", box_area(*[F.col(c) for c in "wsen"]).alias("area"))
    return scores.join(area, "region_id").groupBy(key).agg(F.max_by("prom", F.struct("area", "region_ord")).alias("prom"))


def dem_mosaic(tiles: DataFrame) -> DataFrame:
    """Cells that several tiles write keep the last tile's value, in tile order."""
    return tiles.groupBy("row", "col").agg(F.max_by("z", "tile").alias("z"))


def dem_tile_cover(boxes: DataFrame) -> DataFrame:
    """Names of the one-degree tiles that each box (box_id, w, s, e, n) touches."""
    cells = boxes.select("box_id", F.explode(F.sequence(F.floor("s"), F.ceil("n") - 1)).alias("lat"), "w", "e")
    cells = cells.select("box_id", "lat", F.explode(F.sequence(F.floor("w"), F.ceil("e") - 1)).alias("lng"))
    part = lambda c, pos, neg, wide: F.concat(F.when(F.col(c) < 0, neg).otherwise(pos), F.lpad(F.abs(F.col(c)).cast("string"), wide, "0"))
    return cells.select("box_id", F.concat(part("lat", "N", "S", 2), part("lng", "E", "W", 3)).alias("tile"))


def block_max(dem: DataFrame, factor: int) -> DataFrame:
    """The maximum of each full block of ``factor`` x ``factor`` cells; NaN in a block makes it NaN; rests at the edge go."""
    edge = dem.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    full = dem.crossJoin(F.broadcast(edge)).where(
        (F.col("row") < F.floor(F.col("rows") / factor) * factor) & (F.col("col") < F.floor(F.col("cols") / factor) * factor)
    )
    return full.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.max("z").alias("z"))


def pyramid_max(cells: DataFrame, levels: int) -> DataFrame:
    """``cells`` (z, row, col, slope, octant) and ``levels`` coarser zooms: the steepest of 2 x 2, first of TL, TR, BL, BR.

    A last odd row or column goes. Each level is stored, so that a coarser one reads the level below and no finer one again.
    """
    out = now = cells
    for _ in range(levels):
        edge = now.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
        even = now.crossJoin(F.broadcast(edge)).where((F.col("row") < F.floor(F.col("rows") / 2) * 2) & (F.col("col") < F.floor(F.col("cols") / 2) * 2))
        place = F.pmod("row", F.lit(2)) * 2 + F.pmod("col", F.lit(2))
        best = F.max_by(F.struct("slope", "octant"), F.struct("slope", -place))
        now = even.groupBy((F.col("z") - 1).alias("z"), F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(best.alias("b")).select("z", "row", "col", "b.*")
        now = stored(now, "level")
        out = out.unionByName(now)
    return out


def pyramid_invariant(cells: DataFrame) -> DataFrame:
    """Each zoom's steepest slope, and whether it is the finest zoom's."""
    tops = cells.groupBy("z").agg(F.max("slope").alias("max_slope"))
    finest = F.max_by("max_slope", "z").over(Window.partitionBy())
    return tops.withColumn("ok", F.col("max_slope") == finest)


def slope_histogram(cells: DataFrame) -> DataFrame:
    """Per cent of cells by class (0 for less than 25 degrees), 4 decimals."""
    group = F.when(F.col("slope") < 25, 0).when(F.col("slope") >= 45, 45).otherwise((F.floor(F.col("slope") / 5) * 5).cast("int"))
    counted = cells.groupBy(group.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def _stencil(dem: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell with its neighbours' z, null where there is none: n<row offset>_<col offset>.

    Every cell sends its value to the cells around it, and one aggregate gathers them: a single shuffle.
    """
    name = lambda r, c: f"n{r}_{c}".replace("-", "m")
    sent = F.explode(F.array(*[F.struct((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.lit(name(r, c)).alias("k"), F.col("z").cast("double").alias("z")) for r, c in offsets]))
    got = dem.select(sent.alias("s")).select("s.*").groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == name(r, c), F.col("z"))).alias(name(r, c)) for r, c in offsets])
    return got.where(F.col(name(0, 0)).isNotNull()) if (0, 0) in offsets else got


NINE = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def horn_slope(dem: DataFrame, xres: float, yres: float, north_m: float) -> DataFrame:
    """Slope and aspect in degrees by Horn's 3 x 3 stencil, edges repeated.

    A cell's ground size is its Mercator size times the cosine of its row's latitude. ``north_m`` is the northing of the
    first row's upper edge.
    """
    s = _stencil(dem, NINE)
    v = lambda r, c: F.coalesce(F.col(f"n{r}_{c}".replace("-", "m")), F.col(f"n{r}_0".replace("-", "m")), F.col(f"n0_{c}".replace("-", "m")), F.col("n0_0"))
    northing = F.lit(north_m) - (F.col("row") + 0.5) * F.lit(abs(yres))
    cell = F.lit(1.0) / F.cosh(northing / F.lit(6378137.0))
    dx = ((v(-1, 1) + v(0, 1) * 2 + v(1, 1)) - (v(-1, -1) + v(0, -1) * 2 + v(1, -1))) / (cell * 8 * abs(xres))
    dy = ((v(1, -1) + v(1, 0) * 2 + v(1, 1)) - (v(-1, -1) + v(-1, 0) * 2 + v(-1, 1))) / (cell * 8 * abs(yres))
    out = s.select("row", "col", dx.alias("dx"), dy.alias("dy"))
    return out.select(
        "row", "col", F.degrees(F.atan(F.hypot("dx", "dy"))).alias("slope"), F.pmod(F.degrees(F.atan2(-F.col("dx"), F.col("dy"))) + 360, F.lit(360.0)).alias("aspect")
    )


def raster_sample_nearest(points: DataFrame, key: str, cells: DataFrame) -> DataFrame:
    """The cell (row, col) under each point (px, py); slope over 90 and octants outside 1-8 are null, as is no cell."""
    at = points.select(key, F.floor("py").cast("int").alias("row"), F.floor("px").cast("int").alias("col"))
    ok = cells.select("row", "col", F.when(F.col("slope") <= 90, F.col("slope")).alias("slope"), F.when(F.col("octant").between(1, 8), F.col("octant")).alias("octant"))
    return at.join(ok, ["row", "col"], "left").select(key, "slope", "octant")


def raster_sample_bilinear(points: DataFrame, key: str, dem: DataFrame, rows: int, cols: int) -> DataFrame:
    """Height at each point (px, py), half a pixel shifted, from its four clamped neighbours; null if one is missing."""
    x, y = F.col("px") - 0.5, F.col("py") - 0.5
    base = points.select(key, F.floor(x).alias("x0"), F.floor(y).alias("y0"), (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"))
    hold = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    corner = lambda dx, dy: F.struct(hold(F.col("y0") + dy, rows).alias("row"), hold(F.col("x0") + dx, cols).alias("col"), ((F.col("fx") if dx else 1 - F.col("fx")) * (F.col("fy") if dy else 1 - F.col("fy"))).alias("w"))
    four = base.select(key, F.explode(F.array(*[corner(dx, dy) for dy in (0, 1) for dx in (0, 1)])).alias("c")).select(key, "c.*")
    met = four.join(dem.select("row", "col", F.col("z").cast("double").alias("z")), ["row", "col"], "left")
    return met.groupBy(key).agg(F.when(F.count("z") == 4, F.sum(F.col("z") * F.col("w"))).alias("ele"))


def raster_tile_pack(cells: DataFrame, size: int = 512) -> DataFrame:
    """Tiles (z, x, y) with their cells' slopes and octants as arrays in row-major order.

    A tile holds size x size cells at most, which bounds every group.
    """
    place = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).alias("p")
    tile = cells.groupBy("z", F.floor(F.col("col") / size).alias("x"), F.floor(F.col("row") / size).alias("y"))
    packed = tile.agg(F.array_sort(F.collect_list(F.struct(place, "slope", "octant"))).alias("c"))
    return packed.select("z", "x", "y", F.transform("c", lambda v: v["slope"]).alias("slope"), F.transform("c", lambda v: v["octant"]).alias("octant"))


#: The byte of a cell that has no value.
NO_BYTE = 255


def raster_tile_bytes(cells: DataFrame, size: int = 512) -> DataFrame:
    """Tiles (z, x, y) of ``size`` x ``size`` bytes each for slope and octant, row by row, and ``n``, the cells they hold.

    ``cells`` has level, z, row, col, slope, octant. A cell that is not there or has a null is the byte 255; values beyond 0 to
    254 raise, and so does a level whose cells lie at more than one zoom, with its name.
    """
    zooms = cells.groupBy("level").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).where("lo <> hi")
    foreign = zooms.agg(F.min(F.struct("level", "lo", "hi")).alias("bad"))  # one row
    text = F.concat(F.lit("level "), F.col("bad.level").cast("string"), F.lit(" tiles at zooms "), F.col("bad.lo").cast("string"), F.lit(" and "), F.col("bad.hi").cast("string"))
    told = cells.crossJoin(F.broadcast(foreign)).withColumn("z", F.when(F.col("bad").isNull(), F.col("z")).otherwise(F.raise_error(text).cast("int")))

    def pair(c: str) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{c} is no byte: "), F.col(c).cast("string")))
        return F.when(F.col(c).isNull(), F.lit("FF")).when(F.col(c).between(0, NO_BYTE - 1), F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0")).otherwise(wrong).alias(c)

    place = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int").alias("p")
    tile = told.groupBy("z", F.floor(F.col("col") / size).alias("x"), F.floor(F.col("row") / size).alias("y"))
    packed = tile.agg(F.array_sort(F.collect_list(F.struct(place, pair("slope"), pair("octant")))).alias("c"))
    # Before each cell come the bytes of those that are missing since the last one.
    missing = lambda i: F.get(F.col("c"), i)["p"] - F.coalesce(F.get(F.col("c"), i - 1)["p"], F.lit(-1)) - 1
    filled = lambda c: F.array_join(F.transform("c", lambda v, i: F.concat(F.repeat(F.lit("FF"), missing(i)), v[c])), "")
    whole = lambda c: F.unhex(F.rpad(filled(c), 2 * size * size, "F")).alias(c)
    return packed.select("z", "x", "y", whole("slope"), whole("octant"), F.size("c").cast("bigint").alias("n"))


def raster_tile_cells(tiles: DataFrame, size: int = 512) -> DataFrame:
    """The cells (z, row, col, slope, octant) of byte tiles; cells without either value go."""
    at = lambda c: F.transform(F.regexp_extract_all(F.hex(c), F.lit("(..)")), lambda h: F.conv(h, 16, 10).cast("int"))
    each = tiles.select("z", "x", "y", F.posexplode(F.arrays_zip(at("slope").alias("slope"), at("octant").alias("octant"))).alias("p", "v"))
    value = lambda c: F.when(F.col(f"v.{c}") != NO_BYTE, F.col(f"v.{c}")).alias(c)
    row, col = F.col("y") * size + F.floor(F.col("p") / size), F.col("x") * size + F.col("p") % size
    return each.select("z", row.cast("bigint").alias("row"), col.cast("bigint").alias("col"), value("slope"), value("octant")).where("slope is not null or octant is not null")


def raster_tile_totals(tiles: DataFrame) -> DataFrame:
    """Tiles, cells and bytes of each zoom."""
    return tiles.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("cells"), F.sum(F.octet_length("slope") + F.octet_length("octant")).alias("bytes"))


#: Cells along the side of a tile in which peaks meet the raster, and peaks of a tile that one task takes.
SNAP_TILE, SNAP_PEAKS = 128, 100_000


def _highest_around(key: str, radius: int, schema: pa.Schema):
    """The highest cell within the radius of each peak's own; cells of the tile and around it lie in one array."""

    def highest(peaks: pa.Table, cells: pa.Table) -> pa.Table:
        if not peaks.num_rows or not cells.num_rows:
            return schema.empty_table()
        r, c = (peaks.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
        row, col = (cells.column(n).to_numpy().astype(np.int64) for n in ("row", "col"))
        z = cells.column("z").to_numpy().astype(float)  # a cell without a height is below all others
        top, left = r.min() - radius, c.min() - radius
        within = (row >= top) & (row <= r.max() + radius) & (col >= left) & (col <= c.max() + radius)
        row, col, z = row[within] - top, col[within] - left, z[within]
        shape = (r.max() - r.min() + 2 * radius + 1, c.max() - c.min() + 2 * radius + 1)
        high, held = np.full(shape, -np.inf), np.zeros(shape, dtype=bool)
        np.maximum.at(high, (row, col), np.where(np.isnan(z), -np.inf, z))
        held[row, col] = True
        best, at_r, at_c = np.full(len(r), -np.inf), np.full(len(r), -1), np.full(len(r), -1)
        for dr in range(2 * radius + 1):
            for dc in range(2 * radius + 1):
                y, x = r - r.min() + dr, c - c.min() + dc
                better = held[y, x] & ((at_r < 0) | (high[y, x] > best))
                best, at_r, at_c = np.where(better, high[y, x], best), np.where(better, y, at_r), np.where(better, x, at_c)
        met = at_r >= 0
        found = [peaks.column(key).filter(pa.array(met)), pa.array(at_r[met] + top), pa.array(at_c[met] + left), pa.array(best[met], mask=np.isinf(best[met]))]
        return pa.Table.from_arrays([v.cast(f.type) for v, f in zip(found, schema)], schema=schema)

    return highest


def peak_snap(peaks: DataFrame, key: str, dem: DataFrame, radius: int = 2) -> DataFrame:
    """Each peak (px, py) on the highest cell around it, the first in row-major order: ``key``, row, col, ele.

    Positions are cut toward zero. Peaks and cells meet in tiles, a cell also in those that it is within the radius of; a
    tile's peaks are dealt into tasks of ``SNAP_PEAKS``.
    """
    at = peaks.select(key, F.col("px").cast("int").alias("c"), F.col("py").cast("int").alias("r")).where("r is not null and c is not null")
    at = stored(at, "peaks")  # read twice below
    tile = lambda c: F.floor(c / SNAP_TILE).cast("int")
    at = at.withColumn("ty", tile(F.col("r"))).withColumn("tx", tile(F.col("c")))
    parts = stored(at.groupBy("ty", "tx").agg(F.ceil(F.count(F.lit(1)) / SNAP_PEAKS).cast("int").alias("parts")), "tiles")
    at = at.join(parts, ["ty", "tx"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    reached = lambda c: F.explode(F.sequence(tile(F.col(c) - radius), tile(F.col(c) + radius)))
    cells = dem.select("row", "col", "z").where("row is not null and col is not null").withColumn("ty", reached("row")).withColumn("tx", reached("col"))
    cells = cells.join(parts, ["ty", "tx"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kinds = dict(dem.dtypes)
    out = f"`{key}` {dict(peaks.dtypes)[key]}, row {kinds['row']}, col {kinds['col']}, ele {kinds['z']}"
    named = ("ty", "tx", "part")
    found = at.groupBy(*named).cogroup(cells.groupBy(*named)).applyInArrow(_highest_around(key, radius, to_arrow_schema(T.StructType.fromDDL(out))), out)
    return found.groupBy(key).agg(F.max_by(F.struct("row", "col", "ele"), F.struct("ele", -F.col("row"), -F.col("col"))).alias("b")).select(key, "b.*")  # keys may repeat


def contour_segments(dem: DataFrame, interval: int) -> DataFrame:
    """Iso-line segments in grid coordinates, one or two per square of four cells and level: level, x0, y0, x1, y1.

    Marching squares; a corner at the level counts as above it. Saddles are cut by the mean of the corners. Each square
    belongs to its upper left cell, so seams repeat nothing.
    """
    s = _stencil(dem, [(0, 0), (0, 1), (1, 0), (1, 1)]).where("n0_1 is not null and n1_0 is not null and n1_1 is not null")
    a, b, c, d = F.col("n0_0"), F.col("n0_1"), F.col("n1_1"), F.col("n1_0")  # clockwise
    low, high = F.least(a, b, c, d), F.greatest(a, b, c, d)
    first, last = F.ceil(low / interval), F.floor(high / interval)
    sq = s.where(first <= last).withColumn("level", F.explode(F.sequence(first, last))).withColumn("level", F.col("level") * interval)
    t = F.col("level")
    cross = lambda p, q: (t - p) / (q - p)
    point = lambda x, y: F.struct((F.col("col") + x).alias("x"), (F.col("row") + y).alias("y"))
    top, right = point(cross(a, b), F.lit(0.0)), point(F.lit(1.0), cross(b, c))
    bottom, left = point(cross(d, c), F.lit(1.0)), point(F.lit(0.0), cross(a, d))
    bit = lambda v, k: F.when(v >= t, k).otherwise(0)
    case = bit(a, 8) + bit(b, 4) + bit(c, 2) + bit(d, 1)
    one = lambda p, q: F.array(F.struct(p.alias("p"), q.alias("q")))
    two = lambda p, q, r, u: F.array(F.struct(p.alias("p"), q.alias("q")), F.struct(r.alias("p"), u.alias("q")))
    full = (a + b + c + d) / 4 >= t
    k = F.col("case")
    lines = (
        F.when(k.isin(1, 14), one(left, bottom)).when(k.isin(2, 13), one(bottom, right)).when(k.isin(3, 12), one(left, right)).when(k.isin(4, 11), one(top, right))
        .when(k.isin(6, 9), one(top, bottom)).when(k.isin(7, 8), one(left, top))
        .when((k == 5) & full | (k == 10) & ~full, two(left, top, bottom, right)).when(k.isin(5, 10), two(left, bottom, top, right))
    )
    cut = sq.withColumn("case", case).where(~k.isin(0, 15)).withColumn("s", F.explode(lines))
    return cut.select("level", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))


def contour_tag(lines: DataFrame, every: int = 50) -> DataFrame:
    return lines.withColumn("idx", F.when(F.pmod(F.col("level").cast("int"), F.lit(every)) == 0, 1).otherwise(0))


def contour_cells(rasters: DataFrame, cell_px: int) -> DataFrame:
    """Windows of each raster (region_id, rows, cols): even spans, seams at half-even, one pixel past each seam."""
    def spans(size: str) -> object:
        n = F.ceil(F.col(size) / cell_px)
        seam = lambda i: F.bround(F.col(size) * i / n, 0).cast("int")
        lo = lambda i: F.when(i == 0, 0).otherwise(seam(i) - 1)
        hi = lambda i: F.when(i == n - 1, F.col(size)).otherwise(seam(i + 1) + 1)
        return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct(lo(i).cast("int").alias("lo"), hi(i).cast("int").alias("hi")))

    return rasters.select("region_id", F.explode(spans("rows")).alias("r"), F.col("cols")).select("region_id", "r", F.explode(spans("cols")).alias("c")).select(
        "region_id", F.col("r.lo").alias("row_lo"), F.col("r.hi").alias("row_hi"), F.col("c.lo").alias("col_lo"), F.col("c.hi").alias("col_hi")
    )


def raster_grid(regions: DataFrame, base_px: int = 512, metres: float = 30.0) -> DataFrame:
    """Each region's raster zoom (9 to 12, near ``metres`` a pixel at its middle) and extent in whole tiles."""
    from tarnspark.functions.geo import tile_x, tile_y

    lat = F.radians((F.col("s") + F.col("n")) / 2)
    zoom = F.ceil(F.log2(F.lit(40075016.685578488) * F.cos(lat) / (base_px * metres))).cast("int")
    z = regions.withColumn("zmax", F.least(F.greatest(zoom, F.lit(9)), F.lit(12)))
    return z.select(
        "region_id", "zmax", tile_x(F.col("w"), F.col("zmax")).alias("x0"), tile_y(F.col("n"), F.col("zmax")).alias("y0"), (tile_x(F.col("e"), F.col("zmax")) + 1).alias("x1"), (tile_y(F.col("s"), F.col("zmax")) + 1).alias("y1")
    )
