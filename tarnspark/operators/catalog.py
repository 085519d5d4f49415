"""The download catalogue: manifests, file status, snapshots, region trees and their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.functions.naming import artifact_kind, region_id_of
from tarnspark.operators.components import tree_roots
from tarnspark.operators.ranks import positions

EARLIER = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)


def manifest_merge(built: DataFrame, base: DataFrame, keys: tuple[str, ...] = ("region_id", "kind"), catalogue: DataFrame | None = None) -> DataFrame:
    """This run's artifacts win; others are carried over with all their fields, also those that this run does not know.

    A field of one side only is null on the other's rows. With ``catalogue`` (region_id and more), its fields, such as name,
    group and box, replace those of the rows of regions that this run built; others keep what they had.
    """
    rest = [*[c for c in built.columns if c not in keys], *[c for c in base.columns if c not in keys and c not in built.columns]]
    whole = lambda df: F.struct(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in rest])
    kinds = dict(base.dtypes) | dict(built.dtypes)
    form = f"struct<{','.join(f'`{c}`:{kinds[c]}' for c in rest)}>"
    pack = lambda df, n: df.select(*keys, whole(df).cast(form).alias(n))
    out = pack(built, "__new").join(pack(base, "__old"), list(keys), "full_outer").select(*keys, F.coalesce("__new", "__old").alias("__r")).select(*keys, "__r.*")
    if catalogue is None:
        return out
    fields = [c for c in catalogue.columns if c != "region_id"]
    fresh = built.select("region_id").distinct().join(catalogue, "region_id").select("region_id", F.struct(*fields).alias("__now"))
    now = lambda c: F.when(F.col("__now").isNotNull(), F.col(f"__now.{c}"))
    joined = out.join(fresh, "region_id", "left")
    had = [c for c in out.columns if c not in fields]
    return joined.select(*had, *[(F.when(F.col("__now").isNotNull(), now(c)).otherwise(F.col(c)) if c in out.columns else now(c)).alias(c) for c in fields])


def manifest_prune(manifest: DataFrame, catalogue: DataFrame) -> DataFrame:
    return manifest.join(catalogue.select("region_id").distinct(), "region_id", "left_semi")


def unpublished(published: DataFrame, local: DataFrame) -> DataFrame:
    """Published region ids that the local manifest drops."""
    return published.select("region_id").distinct().join(local.select("region_id"), "region_id", "left_anti")


def source_pin(sources: DataFrame, snapshots: DataFrame, pins: DataFrame, as_of: str, days: int = 8) -> DataFrame:
    """Each source's recorded pin, else its newest snapshot in the days before ``as_of``; a source with neither raises."""
    fresh = snapshots.where((F.col("date") <= F.to_date(F.lit(as_of))) & (F.datediff(F.to_date(F.lit(as_of)), "date") <= days))
    newest = fresh.groupBy("source").agg(F.max_by("name", F.struct("date", "name")).alias("__newest"))
    joined = sources.select("source").join(newest, "source", "left").join(pins.select("source", F.col("name").alias("__pin")), "source", "left")
    name = F.coalesce("__pin", "__newest")
    return joined.select("source", F.when(name.isNull(), F.raise_error(F.concat(F.lit("no snapshot of "), F.col("source")))).otherwise(name).alias("name"))


def changed_artifacts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local keys that are absent remotely or differ in size."""
    there = remote.select("key", F.col("bytes").alias("__bytes"))
    return local.join(there, "key", "left").where(F.col("__bytes").isNull() | (F.col("__bytes") != F.col("bytes"))).select(*local.columns)


def digest_reuse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Known digests for files whose path, size and times are unchanged; null where one must be computed."""
    return files.join(cache.select("path", "size", "mtime", "inode", "sha256"), ["path", "size", "mtime", "inode"], "left")


def region_status(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """downloaded, partial, update or absent for each region, and its missing bytes."""
    have = files.select(F.col("filename").alias("__f")).distinct()
    whole = artifacts.join(have, F.col("filename") == F.col("__f"), "left").withColumn("__has", F.col("__f").isNotNull()).drop("__f")
    part = whole.join(have, F.concat("filename", F.lit(".part")) == F.col("__f"), "left").withColumn("__part", F.col("__f").isNotNull()).drop("__f")
    state = F.when(F.min("__has"), "downloaded").when(F.max("__part"), "partial").when(F.max("__has"), "update").otherwise("absent")
    return part.groupBy("region_id").agg(state.alias("state"), F.sum(F.when(~F.col("__has"), F.col("bytes")).otherwise(0)).alias("missing_bytes"))


def orphan_files(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files that no region claims, complete or partial, by the region in their names; other names are left alone."""
    bare = files.withColumn("__bare", F.regexp_replace("filename", r"\.part$", "")).withColumn("region_id", region_id_of(F.col("filename")))
    lost = bare.where("region_id is not null").join(artifacts.select(F.col("filename").alias("__bare")).distinct(), "__bare", "left_anti")
    return lost.groupBy("region_id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def override_merge(generated: DataFrame, existing: DataFrame, reserved: DataFrame, fields: list[str]) -> DataFrame:
    """People's decisions survive regeneration; an id that is reserved gets ``-region``."""
    taken = reserved.select("region_id", F.lit(True).alias("__taken")).distinct()
    named = generated.join(taken, "region_id", "left").withColumn(
        "region_id", F.when(F.col("__taken"), F.concat("region_id", F.lit("-region"))).otherwise(F.col("region_id"))
    ).drop("__taken")
    old = existing.select("region_id", *[F.col(f).alias(f"__{f}") for f in fields])
    out = named.join(old, "region_id", "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in generated.columns])


def manifest_totals(artifacts: DataFrame) -> DataFrame:
    """Total bytes of each region and its artifacts sorted by kind."""
    return artifacts.groupBy("region_id").agg(
        F.sum("bytes").alias("total_bytes"), F.sort_array(F.collect_list(F.struct("kind", "filename", "bytes"))).alias("artifacts")
    )


def best_zoom(points_regions: DataFrame, key: str, artifacts: DataFrame, fallback: int) -> DataFrame:
    """The greatest maxzoom over the regions around each point (key, region_id), at least the fallback."""
    tops = artifacts.groupBy("region_id").agg(F.max("maxzoom").alias("z"))
    return points_regions.join(tops, "region_id", "left").groupBy(key).agg(F.greatest(F.coalesce(F.max("z"), F.lit(fallback)), F.lit(fallback)).cast("bigint").alias("max_zoom"))


def remaining_bytes(regions: DataFrame, artifacts: DataFrame, kind: str = "basemap") -> DataFrame:
    """Gigabytes still to build: estimates of regions without the kind, with a tenth on top, cut to a whole number."""
    left = regions.join(artifacts.where(F.col("kind") == kind), "region_id", "left_anti")
    return left.agg(F.floor(F.coalesce(F.sum("estimated_bytes"), F.lit(0)) * 1.1 / 1e9).alias("gb"))


def tile_zoom_audit(tiles: DataFrame, headers: DataFrame) -> DataFrame:
    """Lowest and highest zoom that hold tiles, their number, and whether that lies in the declared range."""
    seen = tiles.groupBy("archive").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count(F.lit(1)).alias("n"))
    joined = headers.join(seen, "archive", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("archive", "min_z", "max_z", "n", F.coalesce((F.col("min_z") >= F.col("minzoom")) & (F.col("max_z") <= F.col("maxzoom")), F.lit(False)).alias("ok"))


def osm_sources(regions: DataFrame, url: str, order: str) -> DataFrame:
    """Distinct extract addresses in first-seen order."""
    return regions.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.min(order).alias("ord"))


def gap_cluster(intervals: DataFrame, key: str, lo: str, hi: str, gap: float, order: str) -> DataFrame:
    """``cluster`` numbers each key's groups of intervals; a new one starts more than ``gap`` beyond all before it."""
    w = Window.partitionBy(key).orderBy(lo, order)
    marked = intervals.withColumn("__new", F.coalesce((F.col(lo) - F.max(hi).over(EARLIER(w)) > gap).cast("int"), F.lit(0)))
    return marked.withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def effective_parent(admin: DataFrame) -> DataFrame:
    """The parent in the id's path if it has one, else the ``parent`` column."""
    path = F.regexp_extract("id", r"^(.*)/[^/]+$", 1)
    return admin.select("id", F.when(path != "", path).otherwise(F.col("parent")).alias("parent"))


def top_level(admin: DataFrame) -> DataFrame:
    """The root ancestor of every id, however deep the tree; a parent that is not in the table ends the walk, a cycle raises."""
    tree = admin.select(F.col("id").alias("node"), "parent").where("parent is not null").join(admin.select(F.col("id").alias("parent")), "parent", "left_semi")
    return admin.select("id").join(tree_roots(tree).select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def admin_walk(admin: DataFrame, cap: int) -> DataFrame:
    """Ids to publish: an area over the cap with children gives way to them, at any depth.

    The walk starts at the children of roots; a childless root stands. ``admin`` has id, parent, bytes. An area is reached if
    all areas between it and a root give way, so it looks up the highest of these by pointers; a cycle of such areas raises.
    """
    kids = admin.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    gives_way = admin.where((F.col("bytes") > cap) & F.col("parent").isNotNull()).select("id").join(kids, "id", "left_semi")
    roots = admin.where("parent is null").select("id")
    below = admin.select(F.col("id").alias("node"), "parent").join(gives_way.select(F.col("id").alias("parent")), "parent", "left_semi")
    tops = tree_roots(below.select("node", "parent")).select(F.col("node").alias("id"), F.col("root").alias("top"))
    started = admin.select(F.col("id").alias("top"), "parent").join(roots.select(F.col("id").alias("parent")), "parent", "left_semi").select("top")
    left = admin.where("parent is not null").select("id").join(gives_way, "id", "left_anti").join(tops, "id", "left").withColumn("top", F.coalesce("top", "id"))
    return left.join(started, "top", "left_semi").select("id").unionByName(roots.join(kids, "id", "left_anti"))


def region_boxes(parts: DataFrame, gap: float = 5.0) -> DataFrame:
    """Each area's boxes from its parts (id, ord, w, s, e, n): clusters by longitude, then latitude, largest first.

    Areas that are narrower across the antimeridian are measured from 0 to 360 and split there; boxes are rounded to 4
    decimals, and one that is no box raises.
    """
    shift = lambda c: F.when(F.col(c) < 0, F.col(c) + 360).otherwise(F.col(c))
    wide = parts.withColumn("__w", shift("w")).withColumn("__e", shift("e"))
    frame = wide.groupBy("id").agg(
        (F.max("e") - F.min("w")).alias("__plain"), (F.max("__e") - F.min("__w")).alias("__turned"), F.min((F.col("__w") <= F.col("__e")).cast("int")).alias("__sound")
    )
    turn = (F.col("__sound") == 1) & (F.col("__turned") < F.col("__plain")) & (F.col("__turned") > 0.01)
    placed = wide.join(frame, "id").select(
        "id", "ord", F.when(turn, F.col("__w")).otherwise(F.col("w")).alias("w"), "s", F.when(turn, F.col("__e")).otherwise(F.col("e")).alias("e"), "n"
    )
    by_lng = gap_cluster(placed, "id", "w", "e", gap, "ord").withColumn("__k", F.concat_ws("|", "id", "cluster")).drop("cluster")
    by_lat = gap_cluster(by_lng, "__k", "s", "n", gap, "ord")
    boxes = by_lat.groupBy("id", "__k", "cluster").agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))
    part = lambda w, e: F.struct(w.alias("w"), F.col("s").alias("s"), e.alias("e"), F.col("n").alias("n"))
    w, e = F.col("w"), F.col("e")
    halves = F.when((w < 180) & (e > 180), F.array(part(w, F.lit(180.0)), part(F.lit(-180.0), e - 360))).when(w >= 180, F.array(part(w - 360, e - 360))).otherwise(F.array(part(w, e)))
    flat = boxes.select("id", F.explode(halves).alias("b")).select("id", *[F.round(f"b.{c}", 4).alias(c) for c in "wsen"])
    bad = (F.col("w") >= F.col("e")) | (F.col("s") >= F.col("n"))
    flat = flat.withColumn("w", F.when(bad, F.raise_error(F.concat(F.lit("no box for "), F.col("id")))).otherwise(F.col("w")))
    size = (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))
    return flat.withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(size), "w", "s")).cast("bigint"))


def size_estimate(boxes: DataFrame, per_degree2: float, top: int, zooms: list[int], measured: DataFrame | None = None) -> DataFrame:
    """Bytes of each box (box_id, w, s, e, n) by zoom: area times a density, a quarter per zoom below the top.

    ``measured`` (box_id, zoom, bytes) overrides.
    """
    area = (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))
    rows = boxes.select("box_id", F.explode(F.array(*map(F.lit, zooms))).alias("zoom"), area.alias("__a"))
    rows = rows.select("box_id", "zoom", (F.col("__a") * per_degree2 / F.pow(F.lit(4.0), F.lit(top) - F.col("zoom"))).alias("bytes"))
    if measured is None:
        return rows
    return rows.join(measured.select("box_id", "zoom", F.col("bytes").alias("__m")), ["box_id", "zoom"], "left").select("box_id", "zoom", F.coalesce("__m", "bytes").alias("bytes"))


def zoom_ladder(sizes: DataFrame, cap: float) -> DataFrame:
    """The first zoom, from the top, at or under the cap, else the lowest: box_id, zoom, bytes."""
    fits = F.when(F.col("bytes") <= cap, -F.col("zoom"))
    return sizes.groupBy("box_id").agg(F.min_by(F.struct("zoom", "bytes"), F.struct(fits.isNull(), F.coalesce(fits, F.col("zoom")))).alias("r")).select("box_id", "r.*")


def quadtree_split(boxes: DataFrame, features: DataFrame, cap: int, depth: int = 3, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Boxes (box_id, w, s, e, n) over the cap cut into quadrants, at most ``depth`` times; empty quadrants go.

    The features (lng, lat, bytes) are summed once, by the finest quadrant; coarser sums roll up from there.
    """
    from tarnspark.operators.spatial import bbox_join

    parts = 1 << depth
    inside = bbox_join(features.select(lng, lat, "bytes"), boxes, lng, lat)
    cell = lambda v, lo, hi: F.least(F.floor((v - lo) / (hi - lo) * parts), F.lit(parts - 1)).cast("bigint")
    fine = inside.groupBy("box_id", cell(F.col(lng), F.col("w"), F.col("e")).alias("qx"), cell(F.col(lat), F.col("s"), F.col("n")).alias("qy")).agg(F.sum("bytes").alias("bytes"))
    levels = None
    for d in range(depth + 1):
        rolled = fine.groupBy("box_id", F.lit(d).alias("level"), F.shiftright("qx", depth - d).alias("x"), F.shiftright("qy", depth - d).alias("y")).agg(F.sum("bytes").alias("bytes"))
        levels = rolled if levels is None else levels.unionByName(rolled)
    # A quadrant stands if it fits (or is the finest) and every one above it does not.
    above = levels.where(F.col("bytes") > cap).select("box_id", F.col("level").alias("al"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    leaf = levels.where((F.col("bytes") <= cap) | (F.col("level") == depth))
    split_parent = leaf.join(
        above, (leaf["box_id"] == above["box_id"]) & (leaf["level"] - 1 == above["al"]) & (F.shiftright(leaf["x"], 1) == above["ax"]) & (F.shiftright(leaf["y"], 1) == above["ay"]), "left_semi"
    ).unionByName(leaf.where("level = 0"))
    side = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * k / F.pow(F.lit(2.0), F.col("level"))
    return split_parent.join(boxes, "box_id").select(
        "box_id", "level", "x", "y", "bytes", side("w", "e", F.col("x")).alias("w"), side("s", "n", F.col("y")).alias("s"),
        side("w", "e", F.col("x") + 1).alias("e"), side("s", "n", F.col("y") + 1).alias("n"),
    )


def region_ids(boxes: DataFrame, area: str, suffix: Column) -> DataFrame:
    """``region_id``: area and suffix, repeats numbered from 2 by ``ord``."""
    base = F.concat_ws("-", area, suffix)
    w = Window.partitionBy("__base").orderBy("ord")
    k = F.row_number().over(w)
    return boxes.withColumn("__base", base).withColumn("region_id", F.when(k == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", k.cast("string")))).drop("__base")


def catalog_report(regions: DataFrame) -> DataFrame:
    """Regions, projected bytes, the median (element n/2 of the sorted sizes) and the ten largest: metric, key, value.

    With a column ``source`` and a flag ``cell``: how many cells the ten most divided sources were cut into, and their bytes.
    With ``max_zoom`` (null where a region has the full zoom): how many regions are ``degraded``, and the ten largest.
    """
    ranked = positions(regions, [F.col("bytes"), F.col("region_id")], "__r")
    total = regions.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    stats = total.select(F.explode(F.array(F.struct(F.lit("regions").alias("metric"), F.lit("").alias("key"), F.col("n").alias("value")), F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"), F.col("b").alias("value")))).alias("r")).select("r.*")
    middle = ranked.join(F.broadcast(total), F.col("__r") == F.floor(F.col("n") / 2) + 1).select(F.lit("median").alias("metric"), F.lit("").alias("key"), F.col("bytes").alias("value"))
    top = regions.orderBy(F.desc("bytes"), "region_id").limit(10).select(F.lit("largest").alias("metric"), F.col("region_id").alias("key"), F.col("bytes").alias("value"))
    out = stats.unionByName(middle).unionByName(top)
    row = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("bigint").alias("value"))
    if {"source", "cell"} <= set(regions.columns):
        cut = regions.where("cell").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).orderBy(F.desc("n"), "source").limit(10)
        out = out.unionByName(cut.select(F.explode(F.array(row("cells", F.col("source"), F.col("n")), row("cell_bytes", F.col("source"), F.col("b")))).alias("r")).select("r.*"))
    if "max_zoom" in regions.columns:
        low = regions.where("max_zoom is not null")
        out = out.unionByName(low.agg(F.count(F.lit(1)).alias("n")).select(row("degraded", F.lit(""), F.col("n")).alias("r")).select("r.*"))
        out = out.unionByName(low.orderBy(F.desc("bytes"), "region_id").limit(10).select(row("degraded_zoom", F.col("region_id"), F.col("max_zoom")).alias("r")).select("r.*"))
    return out


def forecast_service(regions: DataFrame, services: DataFrame) -> DataFrame:
    """Regions with their ``service`` from ``services`` (region_id, service), null where none is known; of several the first by name."""
    known = services.groupBy("region_id").agg(F.min("service").alias("service"))
    return regions.join(known, "region_id", "left")


def artifact_rows(files: DataFrame) -> DataFrame:
    """Files with the kind and region in their names; others go."""
    return files.withColumn("kind", artifact_kind(F.col("filename"))).withColumn("region_id", region_id_of(F.col("filename"))).where("kind is not null")
