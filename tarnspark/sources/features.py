"""Feature files: line-delimited GeoJSON in, one feature a line out; the catalogue and the region index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.scratch import stored


def scan_features(spark: SparkSession, path: str | list[str], source_ord: int = 0) -> DataFrame:
    """source_ord, block, line, props (VARIANT), geom_type and coords (VARIANT) of each feature of files or folders.

    A leading 0x1e and white space go, blank lines are skipped, and a line that is no JSON object raises with its file and
    line. (source_ord, block, line) is the order of the input, however Spark splits it: paths of a list have their place in it
    added to ``source_ord``, ``block`` numbers the splits of a path from 0 by file name and place, and ``line`` counts the
    lines of the file from 1, blank ones as well. Lines are counted by a first pass that reads no values.
    """
    if not isinstance(path, str):
        return reduce(lambda a, b: a.unionByName(b), [scan_features(spark, p, source_ord + i) for i, p in enumerate(path)])
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    splits = read.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # A row a split, so the one window without a partition sees a millionth of the input.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = splits.select("file", "start", (before + 1 - F.col("first")).alias("shift"), (F.row_number().over(Window.orderBy("file", "start")) - 1).cast("bigint").alias("block"))
    lines = read.withColumn("value", F.regexp_replace("value", r"^[\x1e\s]+|\s+$", "")).where("value <> ''").join(stored(numbered, "splits"), ["file", "start"])
    parsed = lines.select("block", (F.col("at") + F.col("shift")).alias("line"), "file", "value", F.try_parse_json("value").alias("j"))
    bad = F.raise_error(F.concat(F.lit("malformed feature in "), F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.substring("value", 1, 80)))
    good = parsed.withColumn("j", F.when(F.col("j").isNull() | ~F.schema_of_variant("j").startswith("OBJECT"), F.parse_json(bad.cast("string"))).otherwise(F.col("j")))
    get = lambda p, t: F.try_variant_get("j", p, t)
    return good.select(F.lit(source_ord).alias("source_ord"), "block", "line", get("$.properties", "variant").alias("props"), get("$.geometry.type", "string").alias("geom_type"), get("$.geometry.coordinates", "variant").alias("coords"))


def concat_sources(sources: list[DataFrame]) -> DataFrame:
    """Sources one after another, each with its place in the list as ``source_ord``."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(sources)])


def tile_union(tilesets: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """All rows of the tilesets by source, each with its ``source``; a source of ``expected`` that is missing or empty raises."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.withColumn("source", F.lit(name)) for name, df in tilesets.items()])
    held = rows.groupBy(F.col("source").alias("__held")).agg(F.lit(True).alias("__any"))
    lost = [r[0] for r in expected.select("source").distinct().join(held, F.col("source") == F.col("__held"), "left_anti").orderBy("source").limit(5).collect()]
    if lost:
        raise ValueError(f"no tiles of {', '.join(lost)}")
    return rows


def _position(p: Column) -> Column:
    return F.array(F.round(p["lng"], 7), F.round(p["lat"], 7))


def _geometry(kind: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def point_geometry(lng: Column, lat: Column) -> Column:
    """GeoJSON text of a point at 7 decimals."""
    return _geometry("Point", F.array(F.round(lng, 7), F.round(lat, 7)))


def line_geometry(coords: Column) -> Column:
    """GeoJSON text of an array of <lng, lat>."""
    return _geometry("LineString", F.transform(coords, _position))


def polygon_geometry(rings: Column) -> Column:
    """GeoJSON text of an array of rings, each an array of <lng, lat>."""
    return _geometry("Polygon", F.transform(rings, lambda ring: F.transform(ring, _position)))


def sink_features(df: DataFrame, path: str, properties: list[str], lng: str = "lng", lat: str = "lat", geometry: Column | None = None) -> None:
    """Write one feature a line, with the listed properties only; null properties are left out.

    Features are the points (``lng``, ``lat``), or have the GeoJSON text ``geometry``, which may differ in kind from row to
    row; a null one is written as null.
    """
    shape = point_geometry(F.col(lng), F.col(lat)) if geometry is None else F.coalesce(geometry, F.lit("null"))
    held = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), held, F.lit("}")).alias("value")).write.text(path)


def sink_region_partitions(df: DataFrame, path: str) -> None:
    """One folder for each region_id; a rewrite removes regions that have no rows any more."""
    df.write.mode("overwrite").partitionBy("region_id").parquet(path)


def scan_regions(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's regions in list order; terrain is on unless switched off, contours and avalanche off unless on."""
    raw = spark.read.json(path, multiLine=True, schema="regions array<struct<id string, name string, bbox array<double>, terrain boolean, contours boolean, avalanche boolean, maxBytes bigint>>")
    r = raw.select(F.posexplode("regions").alias("region_ord", "r"))
    box = [F.get("r.bbox", F.lit(i)).alias(c) for i, c in enumerate("wsen")]
    flag = lambda c, d: F.coalesce(f"r.{c}", F.lit(d)).alias(c)
    return r.select("region_ord", F.col("r.id").alias("region_id"), "r.name", *box, flag("terrain", True), flag("contours", False), flag("avalanche", False), F.col("r.maxBytes").alias("max_bytes"))


def scan_admin_index(spark: SparkSession, path: str, dropped: list[str], aggregates: list[str] = ()) -> DataFrame:
    """id, parent, name and polygons of the index's areas, without the dropped ids and the aggregates.

    ``polygons`` is an array of polygons, each an array of rings of <lng, lat>; null without a geometry. Of several features
    of one id the last stands. An aggregate that is the parent of areas raises: they would hang in the air.
    """
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.parse_json("value"), "$.features", "array<variant>")).alias("f"))
    get = lambda p, kind: F.try_variant_get("f", p, kind)
    kind = get("$.geometry.type", "string")
    flat = F.when(kind == "Polygon", F.array(get("$.geometry.coordinates", "array<array<array<double>>>"))).when(kind == "MultiPolygon", get("$.geometry.coordinates", "array<array<array<array<double>>>>"))
    place = lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat"))
    polygons = F.transform(flat, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, place)))
    rows = whole.select(F.monotonically_increasing_id().alias("ord"), get("$.properties.id", "string").alias("id"), get("$.properties.parent", "string").alias("parent"), get("$.properties.name", "string").alias("name"), polygons.alias("polygons"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("parent", "name", "polygons"), "ord").alias("r")).select("id", "r.*")
    gone = [*dropped, *aggregates]
    kept = last.where(~F.col("id").isin(*gone)) if gone else last
    if not aggregates:
        return kept
    broken = F.col("parent").isin(*aggregates)
    return kept.withColumn("parent", F.when(broken, F.raise_error(F.concat("id", F.lit(" lies in an aggregate")))).otherwise(F.col("parent")))
