"""Queries of the readers and writers, over files and texts that are made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.operators import aggregates as A
from tarnspark.operators import classify as C
from tarnspark.plans.registry import query
from tarnspark.plans.views import view, with_views
from tarnspark.scratch import scratch_path as scratch
from tarnspark.scratch import stored
from tarnspark.sources import features as X
from tarnspark.sources.artifacts import artifact_audit, sink_files
from tarnspark.sources import routes as R

V = lambda sql: with_views(sql, "way_vertices")


def feature_file(spark, d):
    path = scratch(spark, "features")
    X.sink_features(view(spark, d, "osm_points").withColumn("lng", F.col("lon")), path, ["src_ord", "name", "tag_ele"])
    return path


@query("scan_features", with_views("SELECT count(*) AS n, CAST(sum(src_ord) AS BIGINT) AS total, count(name) AS named, round(sum(lon), 3) AS lng FROM osm_points", "osm_points"))
def _(spark, d):
    f = X.scan_features(spark, feature_file(spark, d))
    get = lambda c, p, t: F.try_variant_get(c, p, t)
    return f.agg(
        F.count("*").alias("n"), F.sum(get("props", "$.src_ord", "bigint")).alias("total"), F.count(get("props", "$.name", "string")).alias("named"),
        F.round(F.sum(get("coords", "$[0]", "double")), 3).alias("lng"),
    )


@query("sink_features", with_views("SELECT src_ord, tag_ele FROM osm_points", "osm_points"))
def _(spark, d):
    f = X.scan_features(spark, feature_file(spark, d))
    return f.select(F.try_variant_get("props", "$.src_ord", "bigint").alias("src_ord"), F.try_variant_get("props", "$.tag_ele", "string").alias("tag_ele"))


@query("concat_sources", with_views("SELECT CASE WHEN src_ord % 2 = 0 THEN 0 ELSE 1 END AS source_ord, count(*) AS n FROM osm_points GROUP BY 1", "osm_points"))
def _(spark, d):
    v = view(spark, d, "osm_points")
    return X.concat_sources([v.where("src_ord % 2 = 0"), v.where("src_ord % 2 <> 0")]).groupBy("source_ord").agg(F.count("*").alias("n"))


@query("tile_union", with_views("SELECT src_ord, count(*) AS n FROM (SELECT src_ord FROM osm_points UNION ALL SELECT src_ord FROM osm_points WHERE src_ord % 3 = 0) GROUP BY 1", "osm_points"))
def _(spark, d):
    v = view(spark, d, "osm_points").select("src_ord")
    tilesets = {"whole": v, "third": v.where("src_ord % 3 = 0")}
    return X.tile_union(tilesets, spark.createDataFrame([(name,) for name in tilesets], "source string")).groupBy("src_ord").agg(F.count("*").alias("n"))


@query("scan_regions", with_views("SELECT region_id, w, s, e, n, region_ord % 2 = 0 AS contours, region_ord % 3 > 0 AS terrain, false AS avalanche FROM map_regions", "map_regions"))
def _(spark, d):
    r = view(spark, d, "map_regions")
    one = F.struct(
        F.col("region_id").alias("id"), F.array("w", "s", "e", "n").alias("bbox"), F.when(F.col("region_ord") % 2 == 0, True).alias("contours"), F.when(F.col("region_ord") % 3 == 0, False).alias("terrain")
    )
    path = scratch(spark, "regions")
    r.agg(F.to_json(F.struct(F.collect_list(one).alias("regions"))).alias("value")).write.text(path)
    return X.scan_regions(spark, path).select("region_id", "w", "s", "e", "n", "contours", "terrain", "avalanche")


@query("scan_admin_index", with_views("SELECT region_id AS id, CAST(group_id AS VARCHAR) AS parent, CASE WHEN region_ord % 3 > 0 THEN round(e, 6) END AS east FROM map_regions WHERE region_id NOT IN ('NATION_3', 'NATION_5')", "map_regions"))
def _(spark, d):
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    shape = F.when(F.col("region_ord") % 3 > 0, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    one = F.struct(F.struct(F.col("region_id").alias("id"), F.col("group_id").cast("string").alias("parent"), F.col("region_id").alias("name")).alias("properties"), shape.alias("geometry"))
    path = scratch(spark, "index")
    view(spark, d, "map_regions").agg(F.to_json(F.struct(F.collect_list(one).alias("features"))).alias("value")).write.text(path)
    east = F.array_max(F.transform(F.flatten(F.flatten("polygons")), lambda p: p["lng"]))
    return X.scan_admin_index(spark, path, ["NATION_3"], ["NATION_5"]).select("id", "parent", F.round(east, 6).alias("east"))


@query("sink_region_partitions", with_views("SELECT group_id, count(*) AS n FROM map_regions WHERE group_id <> 2 GROUP BY 1", "map_regions"))
def _(spark, d):
    path = scratch(spark, "cut")
    r = view(spark, d, "map_regions").select(F.col("group_id").alias("region_id"), "w")
    X.sink_region_partitions(r, path)
    X.sink_region_partitions(r.where("region_id <> 2"), path)
    return spark.read.parquet(path).groupBy(F.col("region_id").cast("int").alias("group_id")).agg(F.count("*").alias("n"))


def routes(spark, d):
    p = F.struct("lng", "lat", F.when(F.col("seq") % 2 == 0, (F.col("gx") % 900).cast("double")).alias("ele"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", p.alias("p")))), lambda x: x["p"])
    return view(spark, d, "way_vertices").groupBy(F.pmod("way_id", F.lit(64)).alias("route_id"), "way_id").agg(line.alias("coords")).select("route_id", F.concat(F.lit("A & <b> "), F.col("way_id").cast("string")).alias("name"), "coords")


ROUTES = "SELECT concat('A & <b> ', way_id) AS name, count(*) AS n, round(sum(lng), 4) AS lng, count(CASE WHEN seq % 2 = 0 THEN 1 END) AS heights FROM way_vertices GROUP BY way_id"


def summed(scanned):
    total = F.aggregate("coords", F.lit(0.0), lambda a, p: a + p["lng"])
    return scanned.select("name", F.size("coords").cast("bigint").alias("n"), F.round(total, 4).alias("lng"), F.size(F.filter("coords", lambda p: p["ele"].isNotNull())).cast("bigint").alias("heights"))


@query("scan_route_xml", V(ROUTES))
def _(spark, d):
    path = scratch(spark, "gpx")
    R.sink_route_gpx(routes(spark, d), path)
    files = spark.read.text(path).select(F.lit("f").alias("file"), F.col("value").alias("text"))
    return summed(R.scan_route_xml(files))


@query("scan_route_geojson", V(ROUTES))
def _(spark, d):
    path = scratch(spark, "geojson")
    R.sink_route_geojson(routes(spark, d), path)
    files = spark.read.text(path).select(F.expr("uuid()").alias("file"), F.col("value").alias("text"))
    return summed(R.scan_route_geojson(stored(files, "files")))


@query("route_format_detect", V("SELECT DISTINCT way_id, CASE WHEN way_id % 3 < 2 THEN 'geojson' ELSE 'gpx' END AS fmt FROM way_vertices"))
def _(spark, d):
    k = F.col("way_id") % 3
    text = F.when(k == 0, F.lit(" \n{}")).when(k == 1, F.lit("[1]")).otherwise(F.lit(" <gpx/>"))
    return view(spark, d, "way_vertices").select("way_id").distinct().select("way_id", R.route_format_detect(text).alias("fmt"))


@query("sink_geometries", V("SELECT way_id, CASE WHEN n = 1 THEN 'Point' WHEN n < 4 THEN 'LineString' ELSE 'Polygon' END AS kind, n, round(lng, 5) AS lng FROM (SELECT way_id, count(*) AS n, sum(round(lng, 7)) AS lng FROM way_vertices GROUP BY way_id)"))
def _(spark, d):
    p = F.struct("lng", "lat")
    lines = view(spark, d, "way_vertices").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", p.alias("p")))), lambda x: x["p"]).alias("coords"))
    first = F.get("coords", F.lit(0))
    shape = F.when(F.size("coords") == 1, X.point_geometry(first["lng"], first["lat"])).when(F.size("coords") < 4, X.line_geometry(F.col("coords"))).otherwise(X.polygon_geometry(F.array("coords")))
    path = scratch(spark, "shapes")
    X.sink_features(lines, path, ["way_id"], geometry=shape)
    got = X.scan_features(spark, path)
    flat = F.when(F.col("geom_type") == "Point", F.array(F.try_variant_get("coords", "$", "array<double>"))).when(F.col("geom_type") == "LineString", F.try_variant_get("coords", "$", "array<array<double>>")).otherwise(
        F.get(F.try_variant_get("coords", "$", "array<array<array<double>>>"), F.lit(0))
    )
    out = got.select(F.try_variant_get("props", "$.way_id", "bigint").alias("way_id"), F.col("geom_type").alias("kind"), flat.alias("c"))
    return out.select("way_id", "kind", F.size("c").cast("bigint").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0))), 5).alias("lng"))


TYPED = """WITH t AS (SELECT src_ord, osm_id, name, src_ord % 3 AS k, tag_grade, tag_ele FROM osm_points),
f AS (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY src_ord) AS rn FROM t)
SELECT osm_id, name, CASE k WHEN 0 THEN CASE WHEN src_ord % 9 BETWEEN 1 AND 6 THEN src_ord % 9 END WHEN 1 THEN CASE WHEN src_ord % 9 BETWEEN 1 AND 6 THEN src_ord % 9 END END AS t,
CASE k WHEN 0 THEN round(src_ord % 900 + 0.24, 1) WHEN 1 THEN (src_ord % 900) * 1e0 END AS ele FROM f WHERE rn = 1"""


@query("typed_features", with_views(TYPED, "osm_points"))
def _(spark, d):
    """Features whose grade and height are numbers, strings or booleans by turns: written, scanned, classified, the first of each id kept."""
    k, n = F.col("src_ord") % 3, (F.col("src_ord") % 9).cast("string")
    high = F.col("src_ord") % 900
    grade = F.when(k == 0, n).when(k == 1, F.concat(F.lit('"T'), n, F.lit('"'))).otherwise("true")
    ele = F.when(k == 0, F.concat(high.cast("string"), F.lit(".24"))).when(k == 1, F.concat(F.lit('"'), high.cast("string"), F.lit(' m"'))).otherwise("[1]")
    name = F.coalesce(F.to_json(F.struct("name")), F.lit("{}"))
    props = F.concat(F.lit('{"@type":"node","@id":'), F.col("osm_id").cast("string"), F.lit(',"src_ord":'), F.col("src_ord").cast("string"), F.lit(',"sac_scale":'), grade, F.lit(',"ele":'), ele, F.lit(',"who":'), name, F.lit("}"))
    path = scratch(spark, "typed")
    view(spark, d, "osm_points").select(F.concat(F.lit('{"type":"Feature","geometry":null,"properties":'), props, F.lit("}")).alias("value")).write.text(path)
    tagged = C.feature_tags(X.scan_features(spark, path), ["sac_scale", "ele"])
    flat = tagged.select(
        F.try_variant_get("props", "$.src_ord", "bigint").alias("src_ord"), F.col("osm_id").cast("bigint").alias("osm_id"), F.try_variant_get("props", "$.who.name", "string").alias("name"),
        F.col("tag_sac_scale").alias("tag_grade"), F.col("num_sac_scale").alias("num_grade"), "tag_ele", "num_ele",
    )
    graded = C.trail_grade(C.peaks_normalize(flat))
    return A.first_by_key(graded, ["osm_id"], "src_ord").select("osm_id", "name", "t", "ele")


#: A tile archive's header of 127 bytes as hexadecimal text, over n (bytes of payload), lo and hi (zooms).
LITTLE = "concat(lpad(hex({n} % 256), 2, '0'), lpad(hex(CAST(floor({n} / 256e0) AS BIGINT) % 256), 2, '0'), lpad(hex(CAST(floor({n} / 65536e0) AS BIGINT)), 2, '0'), repeat('0', 10))".format(n="n")
SECTION = f"concat('7F', repeat('0', 14), {LITTLE})"
ARCHIVE = f"concat('504D54696C657303', repeat({SECTION}, 4), repeat('0', 56), lpad(hex(lo), 2, '0'), lpad(hex(hi), 2, '0'), repeat('0', 50), repeat('78', CAST(n AS INTEGER)))"


@query("artifact_audit", with_views(f"WITH a AS (SELECT filename, min(region_id) AS region_id, min(kind) AS kind, count(*) AS n, CAST(min(maxzoom) AS BIGINT) AS lo, CAST(max(maxzoom) AS BIGINT) AS hi FROM map_artifacts GROUP BY filename) SELECT filename, kind, region_id, 127 + n AS bytes, CAST(lo AS INTEGER) AS minzoom, CAST(hi AS INTEGER) AS maxzoom, sha256(unhex({ARCHIVE})) AS sha256 FROM a", "map_artifacts"))
def _(spark, d):
    """Archives written from the artifacts' rows, a byte of payload for each, and audited where they lie."""
    a = view(spark, d, "map_artifacts").groupBy("filename").agg(F.count("*").alias("n"), F.min("maxzoom").cast("bigint").alias("lo"), F.max("maxzoom").cast("bigint").alias("hi"))
    path = scratch(spark, "archives")
    sink_files(a.select("filename", F.unhex(F.expr(ARCHIVE)).alias("content")), path)
    return artifact_audit(spark, path).select("filename", "kind", "region_id", "bytes", "minzoom", "maxzoom", "sha256")
