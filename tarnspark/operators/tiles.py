"""Features and map tiles: assignment per zoom, edge ties, coverage counts and matching."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.functions.geo import global_units, mercator_x, mercator_y, tile_x, tile_y
from tarnspark.operators.components import least_roots
from tarnspark.scratch import stored

WORLD_BITS = 32
#: Pairs of sources and tiles that one task settles in order.
TASK_PAIRS = 200_000


def tile_assign(features: DataFrame, key: str, max_zoom: int) -> DataFrame:
    """Each feature's own tile at every zoom from its ``minzoom`` on: ``key``, z, x, y."""
    zooms = features.where(F.col("minzoom") <= max_zoom).withColumn("z", F.explode(F.sequence(F.col("minzoom").cast("int"), F.lit(max_zoom))))
    return zooms.select(key, "z", tile_x(F.col("lng"), F.col("z")).alias("x"), tile_y(F.col("lat"), F.col("z")).alias("y"))


def tiles_for_bbox(boxes: DataFrame, zoom: int) -> DataFrame:
    """Every tile that covers a box (w, s, e, n), column by column: the columns of ``boxes``, z, x and y."""
    z = F.lit(zoom)
    wide = boxes.withColumn("z", z.cast("bigint")).withColumn("x", F.explode(F.sequence(tile_x(F.col("w"), z), tile_x(F.col("e"), z))))
    return wide.withColumn("y", F.explode(F.sequence(tile_y(F.col("n"), z), tile_y(F.col("s"), z))))


def _tied(lng, lat):
    """True if, in 32-bit world coordinates, the point lies exactly half a pixel of 4096 short of a tile edge at z 0-14."""
    world = float(1 << WORLD_BITS)
    hit = F.lit(False)
    for share in (mercator_x(lng), mercator_y(lat)):
        unit = F.floor(share * world).cast("bigint")
        for z in range(15):
            size = 1 << (WORLD_BITS - z)
            hit = hit | (F.pmod(unit, F.lit(size)) == size - (size >> 13))
    return hit


def tile_untie(points: DataFrame, rounds: int = 10) -> DataFrame:
    """Points on such a tie move 1e-7 degrees west and north, at most ``rounds`` times; then they raise."""
    moved = points
    for _ in range(rounds):
        tied = _tied(F.col("lng"), F.col("lat"))
        moved = moved.withColumns({"lng": F.when(tied, F.round(F.col("lng") - 1e-7, 7)).otherwise(F.col("lng")), "lat": F.when(tied, F.round(F.col("lat") + 1e-7, 7)).otherwise(F.col("lat"))})
        moved = moved.select("*")
    return moved.withColumn("lng", F.when(_tied(F.col("lng"), F.col("lat")), F.raise_error(F.lit("a point stays on a tile edge"))).otherwise(F.col("lng")))


def tile_coverage_count(source: DataFrame, tiled: DataFrame, max_zoom: int) -> DataFrame:
    """Per zoom: features in the tiles, features expected, and whether they agree."""
    expected = source.where(F.col("minzoom") <= max_zoom).select(F.explode(F.sequence(F.col("minzoom").cast("int"), F.lit(max_zoom))).alias("z")).groupBy("z").agg(F.count(F.lit(1)).alias("expected"))
    have = tiled.groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    both = expected.join(have, "z", "full_outer").select("z", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.withColumn("ok", F.col("n") == F.col("expected"))


def tile_coverage_match(source: DataFrame, tiled: DataFrame, zoom: int, extent: int = 4096, reach: int = 4) -> DataFrame:
    """Source points (src_ord, name, lng, lat) without a partner of their name within ``reach`` pixels in ``tiled``.

    One partner each, sources in ``src_ord`` order taking the nearest that is left (``tile_id`` breaks ties). Names that are
    null match each other; distances are Chebyshev and wrap at the antimeridian. Pairs that nobody contests stand. The others
    fall into clusters of sources and tiles that can meet; clusters are dealt into tasks that go through their sources in
    order. Only a cluster with more pairs than ``TASK_PAIRS`` is worked out by deferred acceptance, where free sources ask their
    next candidate and a candidate keeps its first source, a round for each source that pushes another on.
    """
    world = extent << zoom
    at = lambda df, k: df.select(k, F.coalesce("name", F.lit("\0")).alias("name"), F.pmod(global_units(mercator_x(F.col("lng")), F.lit(zoom), extent), F.lit(world)).alias("gx"), global_units(mercator_y(F.col("lat")), F.lit(zoom), extent).alias("gy"))
    side = reach + 1
    cells = -(-world // side)
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    s = at(source, "src_ord").withColumn("cx", F.floor(F.col("gx") / side)).withColumn("cy", F.floor(F.col("gy") / side))
    s = s.withColumn("cy", near("cy")).withColumn("cx", near("cx")).withColumn("cx", F.pmod("cx", F.lit(cells)))
    t = at(tiled, "tile_id").select("tile_id", "name", F.col("gx").alias("tx"), F.col("gy").alias("ty"), F.floor(F.col("gx") / side).alias("cx"), F.floor(F.col("gy") / side).alias("cy"))
    dx = F.abs(F.col("gx") - F.col("tx"))
    pairs = s.join(t, ["name", "cx", "cy"]).withColumn("d", F.greatest(F.least(dx, F.lit(world) - dx), F.abs(F.col("gy") - F.col("ty")))).where(F.col("d") <= reach)
    mine, theirs = Window.partitionBy("src_ord"), Window.partitionBy("tile_id")
    pairs = pairs.select("src_ord", "tile_id", "d").distinct().withColumn("wish", F.row_number().over(mine.orderBy("d", "tile_id")))
    pairs = pairs.withColumn("wishes", F.count(F.lit(1)).over(mine)).withColumn("askers", F.count(F.lit(1)).over(theirs))
    # A source whose first wish nobody else asks for has it; so has one that no other of its wishes matters to.
    pairs = stored(pairs.withColumn("sure", F.max((F.col("wish") == 1) & (F.col("askers") == 1)).over(mine)), "pairs")
    tags = (lambda k: F.concat(F.lit("s"), F.col(k).cast("string")).alias("source"), lambda k: F.concat(F.lit("t"), F.col(k).cast("string")).alias("tile"))
    contested = pairs.where("not sure")
    roots = least_roots(contested.select(tags[0]("src_ord"), tags[1]("tile_id")), "source", "tile")
    named = contested.select("src_ord", "tile_id", "wish", tags[0]("src_ord")).join(roots.select(F.col("node").alias("source"), "root"), "source", "left")
    named = named.select("src_ord", "tile_id", "wish", F.coalesce("root", "source").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("held"))
    named = named.join(sizes, "cluster")
    shelves = max(1, -(-contested.count() // TASK_PAIRS))
    kind = dict(pairs.dtypes)["src_ord"]
    small = named.where(F.col("held") <= TASK_PAIRS).groupBy(F.pmod(F.xxhash64("cluster"), F.lit(shelves)).alias("shelf")).applyInArrow(_in_order, f"src_ord {kind}")
    found = pairs.where("sure").select("src_ord").distinct().unionByName(small)
    large = stored(named.where(F.col("held") > TASK_PAIRS).select("src_ord", "tile_id", "wish"), "large")
    if large.limit(1).count():
        found = found.unionByName(_deferred(large))
    return source.join(found, "src_ord", "left_anti")


def _in_order(rows: pa.Table) -> pa.Table:
    """The sources of some whole clusters that find a partner, one by one."""
    rows = rows.take(pc.sort_indices(rows, [("src_ord", "ascending"), ("wish", "ascending")]))
    taken, matched = set(), {}
    for k, (source, tile) in enumerate(zip(rows.column("src_ord").to_pylist(), rows.column("tile_id").to_pylist())):
        if source not in matched and tile not in taken:
            taken.add(tile)
            matched[source] = k
    return rows.take(pa.array(list(matched.values()), pa.int64())).select(["src_ord"])


def _deferred(pairs: DataFrame) -> DataFrame:
    """The sources of ``pairs`` (src_ord, tile_id, wish from 1 on) that find a partner, by rounds of asking."""
    pairs = stored(pairs.withColumn("wish", F.row_number().over(Window.partitionBy("src_ord").orderBy("wish"))), "pairs")
    asking = pairs.groupBy("src_ord").agg(F.lit(1).alias("wish"))
    while True:
        offers = pairs.join(asking, ["src_ord", "wish"]).select("src_ord", "tile_id", "wish")
        best = offers.groupBy("tile_id").agg(F.min("src_ord").alias("src_ord"))
        held = stored(best.join(offers, ["tile_id", "src_ord"]), "held")
        refused = offers.join(held.select("src_ord"), "src_ord", "left_anti").select("src_ord", (F.col("wish") + 1).alias("wish"))
        still = refused.join(pairs.groupBy("src_ord").agg(F.max("wish").alias("top")), "src_ord").where("wish <= top").select("src_ord", "wish")
        if not still.limit(1).count():
            return held.select("src_ord")
        asking = stored(still.unionByName(held.select("src_ord", "wish")), "asking", after=(asking, held))
