"""Queries of the joins by place, the search, and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.functions.geo import overlap_share
from tarnspark.operators import catalog as K
from tarnspark.operators import search as S
from tarnspark.operators import spatial as X
from tarnspark.plans.feature_queries import DEDUPED, PLACES, ranked
from tarnspark.plans.registry import query
from tarnspark.plans.views import table, view, with_views

PR = lambda sql: with_views(sql, "osm_points", "map_regions")
RA = lambda sql: with_views(sql, "map_regions", "map_artifacts")
AREA = "(e - w) * (n - s)"


def regions(spark, d):
    return view(spark, d, "map_regions")


def points(spark, d):
    return view(spark, d, "osm_points").select("src_ord", F.col("lon").alias("lng"), "lat")


@query("region_cut", PR(f"WITH {DEDUPED} SELECT src_ord, region_id FROM deduped JOIN map_regions ON lat BETWEEN s AND n AND lon BETWEEN w AND e"))
def _(spark, d):
    from tarnspark.operators.aggregates import place_dedupe

    return X.region_cut(place_dedupe(ranked(spark, d)), regions(spark, d)).select("src_ord", "region_id")


@query("region_at", PR(f"SELECT src_ord, region_id FROM (SELECT src_ord, region_id, row_number() OVER (PARTITION BY src_ord ORDER BY {AREA}, region_id) AS rn FROM osm_points JOIN map_regions ON lat BETWEEN s AND n AND lon BETWEEN w AND e) WHERE rn = 1"))
def _(spark, d):
    return X.region_at(points(spark, d), "src_ord", regions(spark, d))


@query("region_nearest", PR(f"SELECT src_ord, region_id, pos FROM (SELECT src_ord, region_id, row_number() OVER (PARTITION BY src_ord ORDER BY pow(greatest(w - lon, lon - e, 0e0) * cos(radians(lat)), 2) + pow(greatest(s - lat, lat - n, 0e0), 2), {AREA}, region_id) AS pos FROM osm_points, map_regions) WHERE pos <= 3"))
def _(spark, d):
    return X.region_nearest(points(spark, d), "src_ord", regions(spark, d), 3).select("src_ord", "region_id", "pos")


@query("covering_region", with_views("WITH b AS (SELECT way_id, min(lng) AS bw, min(lat) AS bs, max(lng) AS be, max(lat) AS bn FROM way_vertices GROUP BY way_id) SELECT way_id, region_id FROM (SELECT way_id, region_id, row_number() OVER (PARTITION BY way_id ORDER BY region_ord) AS rn FROM b JOIN map_regions ON bw >= w AND be <= e AND bs >= s AND bn <= n) WHERE rn = 1", "way_vertices", "map_regions"))
def _(spark, d):
    from tarnspark.operators.aggregates import fold_bounds

    return X.covering_region(fold_bounds(view(spark, d, "way_vertices"), "way_id"), "way_id", regions(spark, d))


@query("prominence_candidates", PR("SELECT src_ord, region_id FROM osm_points JOIN map_regions ON lat BETWEEN s - 2 * 125e-4 AND n + 2 * 125e-4 AND lon BETWEEN w - 2 * 125e-4 AND e + 2 * 125e-4"))
def _(spark, d):
    return X.prominence_candidates(points(spark, d), "src_ord", regions(spark, d).withColumn("res", F.lit(125e-4)))


@query("overlap_pairs", with_views("SELECT id_a, id_b, round(fraction, 9) AS fraction FROM (SELECT a.region_id AS id_a, b.region_id AS id_b, (least(a.e, b.e) - greatest(a.w, b.w)) * (least(a.n, b.n) - greatest(a.s, b.s)) / ((a.e - a.w) * (a.n - a.s)) AS fraction FROM map_regions a JOIN map_regions b ON a.region_id <> b.region_id AND least(a.e, b.e) > greatest(a.w, b.w) AND least(a.n, b.n) > greatest(a.s, b.s)) WHERE fraction > 0.05", "map_regions"))
def _(spark, d):
    r = regions(spark, d)
    return X.overlap_pairs(r, r, 0.05).withColumn("fraction", F.round("fraction", 9))


@query("line_snap", PR("SELECT src_ord, node_id, pos FROM (SELECT src_ord, node_id, row_number() OVER (PARTITION BY src_ord ORDER BY m, node_id) AS pos FROM (SELECT p.src_ord, q.src_ord AS node_id, 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) AS m FROM osm_points p JOIN osm_points q ON TRUE) WHERE m <= 9000) WHERE pos <= 4"))
def _(spark, d):
    """All points against all points, each its own nearest."""
    nodes = points(spark, d).withColumnRenamed("src_ord", "node_id")
    return X.line_snap(points(spark, d), "src_ord", nodes, 9000, 4).select("src_ord", "node_id", "pos")


# Search ---------------------------------------------------------------------------------------------------------------

TOKENS = "tokens AS (SELECT DISTINCT src_ord, lower(t) AS token FROM (SELECT src_ord, unnest(regexp_split_to_array(name, '[^0-9A-Za-z]+')) AS t FROM ranked) WHERE t <> '')"


def search_rows(spark, d, k=20):
    """Every fiftieth row asks, with the name of its customer but for the last two digits."""
    found = ranked(spark, d).select(F.col("src_ord").alias("place_id"), "name", "kind", "lat", "lon", "rank")
    text = F.concat(F.lit("customer "), F.substring(F.lpad(F.col("src_ord").cast("string"), 9, "0"), 1, 7))
    ask = points(spark, d).where("src_ord % 50 = 0").select(F.col("src_ord").alias("query_id"), text.alias("text"), F.col("lng").alias("lon"), "lat")
    return S.place_search(ask, found, k)


SEARCH = f"""WITH {PLACES}, {TOKENS}, asked AS (SELECT src_ord AS query_id, lon AS qlon, lat AS qlat, substr(lpad(CAST(src_ord AS VARCHAR), 9, '0'), 1, 7) AS prefix FROM osm_points WHERE src_ord % 50 = 0),
hits AS (SELECT DISTINCT query_id, a.src_ord, qlon, qlat FROM asked JOIN tokens a ON a.token = 'customer' JOIN tokens b ON b.src_ord = a.src_ord AND starts_with(b.token, prefix)),
placed AS (SELECT query_id, h.src_ord AS place_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pow((r.lon - qlon) * cos(radians(qlat)), 2) + pow(r.lat - qlat, 2), rank DESC, h.src_ord) AS BIGINT) AS pos FROM hits h JOIN ranked r USING (src_ord))"""


@query("place_search", PR(f"{SEARCH} SELECT query_id, place_id, pos FROM placed WHERE pos <= 20"))
def _(spark, d):
    return search_rows(spark, d).select("query_id", "place_id", "pos")


@query("search_merge", PR(f"{SEARCH} SELECT query_id, place_id, pos FROM placed WHERE pos <= 10"))
def _(spark, d):
    found = search_rows(spark, d)
    return S.search_merge([found, found.where("place_id % 2 = 0")], 10).select("query_id", "place_id", "pos")


@query("fallback_cut", PR(f"WITH {PLACES} SELECT src_ord FROM (SELECT src_ord FROM ranked WHERE kind IN ('city','town') ORDER BY kind <> 'city', coalesce(population, 0) DESC, src_ord LIMIT 40) UNION ALL SELECT src_ord FROM (SELECT src_ord FROM ranked WHERE kind IN ('peak','volcano') AND notable ORDER BY ele DESC NULLS LAST, src_ord LIMIT 30)"))
def _(spark, d):
    return S.fallback_cut(ranked(spark, d), 40, 30).select("src_ord")


@query("region_search", with_views("WITH hits AS (SELECT region_id, CASE WHEN starts_with(lower(region_id), 'nation_1') THEN 0 WHEN contains(lower(region_id), 'nation_1') THEN 1 ELSE 2 END AS score FROM map_regions WHERE contains(lower(region_id), 'nation_1') OR CAST(group_id AS VARCHAR) LIKE '%nation_1%') SELECT region_id, CAST(row_number() OVER (ORDER BY score, region_id) AS BIGINT) AS pos, count(*) OVER () AS total FROM hits ORDER BY pos LIMIT 8", "map_regions"))
def _(spark, d):
    asked = spark.createDataFrame([(1, "NATÏON_1")], "query_id int, text string")
    named = regions(spark, d).select("region_id", F.col("region_id").alias("name"), F.col("group_id").cast("string").alias("group"))
    return S.region_search(asked, named, 8).select("region_id", "pos", "total")


@query("osm_sources", with_views("SELECT concat('extract-', group_id) AS url, min(region_ord) AS ord FROM map_regions WHERE group_id <> 3 GROUP BY 1", "map_regions"))
def _(spark, d):
    url = F.when(F.col("group_id") != 3, F.concat(F.lit("extract-"), F.col("group_id").cast("string")))
    return K.osm_sources(regions(spark, d).withColumn("u", url), "u", "region_ord")


# Catalogue ------------------------------------------------------------------------------------------------------------

NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id, kind ORDER BY ord DESC) AS rn FROM map_artifacts) WHERE rn = 1)"


def newest(spark, d):
    a = view(spark, d, "map_artifacts")
    whole = F.struct("filename", "bytes", "maxzoom", "ord")
    return a.groupBy("region_id", "kind").agg(F.max_by(whole, "ord").alias("r")).select("region_id", "kind", "r.*")


@query("manifest_merge", RA(f"WITH {NEWEST}, b AS (SELECT * FROM newest WHERE ord % 5 <> 0), u AS (SELECT region_id, kind, bytes + 1 AS bytes, maxzoom FROM newest WHERE ord % 3 = 0), m AS (SELECT coalesce(u.region_id, b.region_id) AS region_id, coalesce(u.kind, b.kind) AS kind, CASE WHEN u.kind IS NULL THEN b.bytes ELSE u.bytes END AS bytes, u.maxzoom, CASE WHEN u.kind IS NULL THEN b.filename END AS filename, CASE WHEN u.kind IS NULL THEN concat('old ', b.region_id) END AS was FROM u FULL JOIN b ON u.region_id = b.region_id AND u.kind = b.kind) SELECT region_id, kind, bytes, maxzoom, filename, CASE WHEN region_id IN (SELECT region_id FROM u) THEN concat('now ', region_id) ELSE was END AS name FROM m"))
def _(spark, d):
    every = newest(spark, d)
    base = every.where("ord % 5 <> 0").select("region_id", "kind", "bytes", "filename", F.concat(F.lit("old "), "region_id").alias("name"))
    built = every.where("ord % 3 = 0").select("region_id", "kind", (F.col("bytes") + 1).alias("bytes"), "maxzoom")
    named = every.select("region_id", F.concat(F.lit("now "), "region_id").alias("name")).distinct()
    return K.manifest_merge(built, base, catalogue=named)


@query("manifest_prune", RA("SELECT ord FROM map_artifacts WHERE region_id IN (SELECT region_id FROM map_regions WHERE region_ord < 10)"))
def _(spark, d):
    small = regions(spark, d).where("region_ord < 10").select(F.concat(F.lit("NATION_"), F.col("region_ord").cast("string")).alias("region_id"))
    return K.manifest_prune(view(spark, d, "map_artifacts"), small).select("ord")


@query("unpublished", RA("SELECT DISTINCT region_id FROM map_artifacts WHERE region_id NOT IN (SELECT region_id FROM map_artifacts WHERE ord % 4 = 1 AND region_id < 'NATION_3')"))
def _(spark, d):
    a = view(spark, d, "map_artifacts")
    return K.unpublished(a, a.where("ord % 4 = 1 and region_id < 'NATION_3'"))


@query("source_pin", "SELECT o_orderpriority AS source, CASE WHEN o_orderpriority LIKE '1%' THEN 'pinned' ELSE max(concat(strftime(o_orderdate, '%Y-%m-%d'), '-', lpad(CAST(o_orderkey AS VARCHAR), 9, '0'))) END AS name FROM orders WHERE o_orderdate <= DATE '1997-06-30' AND o_orderdate >= DATE '1997-03-22' GROUP BY o_orderpriority")
def _(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    shots = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("date"), name.alias("name"))
    sources = o.select(F.col("o_orderpriority").alias("source")).distinct()
    pins = sources.where("source like '1%'").withColumn("name", F.lit("pinned"))
    return K.source_pin(sources, shots, pins, "1997-06-30", 100)


@query("changed_artifacts", RA("SELECT ord FROM map_artifacts WHERE ord % 5 = 0 OR ord % 7 = 0"))
def _(spark, d):
    a = view(spark, d, "map_artifacts").select("ord", F.col("ord").alias("key"), "bytes")
    remote = a.where("ord % 5 <> 0").withColumn("bytes", F.when(F.col("ord") % 7 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return K.changed_artifacts(a, remote).select("ord")


@query("digest_reuse", RA("SELECT ord, CASE WHEN ord % 3 > 0 THEN concat('h', ord) END AS sha256 FROM map_artifacts"))
def _(spark, d):
    files = view(spark, d, "map_artifacts").select("ord", F.concat("filename", F.col("ord").cast("string")).alias("path"), F.col("bytes").alias("size"), F.col("ord").alias("mtime"), F.col("ord").alias("inode"))
    cache = files.withColumn("sha256", F.concat(F.lit("h"), F.col("ord").cast("string"))).withColumn("mtime", F.when(F.col("ord") % 3 == 0, -1).otherwise(F.col("ord")))
    return K.digest_reuse(files, cache).select("ord", "sha256")


@query("region_status", RA("SELECT region_id, CASE WHEN min(CAST(has AS INTEGER)) = 1 THEN 'downloaded' WHEN max(CAST(part AS INTEGER)) = 1 THEN 'partial' WHEN max(CAST(has AS INTEGER)) = 1 THEN 'update' ELSE 'absent' END AS state, CAST(sum(CASE WHEN has THEN 0 ELSE bytes END) AS BIGINT) AS missing_bytes FROM (SELECT *, region_id < 'NATION_2' OR ord % 4 = 0 AS has, region_id >= 'NATION_4' AND region_id < 'NATION_6' AND ord % 4 = 1 AS part FROM map_artifacts) GROUP BY region_id"))
def _(spark, d):
    a = view(spark, d, "map_artifacts").withColumn("filename", F.concat(F.col("ord").cast("string"), F.lit("-"), F.col("filename")))
    whole = a.where("region_id < 'NATION_2' or ord % 4 = 0").select("filename")
    part = a.where("region_id >= 'NATION_4' and region_id < 'NATION_6' and ord % 4 = 1").select(F.concat("filename", F.lit(".part")).alias("filename"))
    return K.region_status(a, whole.unionByName(part))


@query("orphan_files", RA("SELECT region_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM map_artifacts WHERE region_id >= 'NATION_2' GROUP BY region_id"))
def _(spark, d):
    a = view(spark, d, "map_artifacts")
    files = a.select("bytes", F.when(F.col("ord") % 2 == 0, F.concat("filename", F.lit(".part"))).otherwise(F.col("filename")).alias("filename"))
    return K.orphan_files(files.unionByName(files.limit(5).withColumn("filename", F.lit("notes.txt"))), a.where("region_id < 'NATION_2'"))


@query("override_merge", with_views("SELECT CASE WHEN region_ord % 6 = 0 THEN concat(region_id, '-region') ELSE region_id END AS region_id, CASE WHEN region_ord % 6 <> 0 AND region_ord % 4 = 1 THEN true ELSE false END AS contours, CAST(CASE WHEN region_ord % 6 <> 0 AND region_ord % 4 = 1 THEN region_ord ELSE 100 END AS BIGINT) AS max_bytes FROM map_regions", "map_regions"))
def _(spark, d):
    r = regions(spark, d)
    made = r.select("region_id", F.lit(False).alias("contours"), F.lit(100).cast("bigint").alias("max_bytes"))
    old = r.where("region_ord % 4 = 1").select("region_id", F.lit(True).alias("contours"), F.col("region_ord").cast("bigint").alias("max_bytes"))
    return K.override_merge(made, old, r.where("region_ord % 6 = 0"), ["contours", "max_bytes"])


@query("manifest_totals", RA("SELECT region_id, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS n, min(kind) AS first_kind FROM map_artifacts GROUP BY region_id"))
def _(spark, d):
    t = K.manifest_totals(view(spark, d, "map_artifacts"))
    return t.select("region_id", "total_bytes", F.size("artifacts").cast("bigint").alias("n"), F.col("artifacts")[0]["kind"].alias("first_kind"))


ZOOMS = "m AS (SELECT concat('NATION_', o) AS region_id, w, s, e, n FROM (SELECT *, region_ord AS o FROM map_regions))"


@query("best_zoom", with_views(f"WITH {ZOOMS}, z AS (SELECT region_id, max(maxzoom) AS z FROM map_artifacts GROUP BY region_id) SELECT src_ord, CAST(greatest(max(coalesce(z, 6)), 6) AS BIGINT) AS max_zoom FROM osm_points JOIN m ON lat BETWEEN s AND n AND lon BETWEEN w AND e LEFT JOIN z USING (region_id) GROUP BY src_ord", "osm_points", "map_regions", "map_artifacts"))
def _(spark, d):
    named = regions(spark, d).withColumn("region_id", F.concat(F.lit("NATION_"), F.col("region_ord").cast("string")))
    met = X.bbox_join(points(spark, d), named).select("src_ord", "region_id")
    return K.best_zoom(met, "src_ord", view(spark, d, "map_artifacts"), 6)


@query("remaining_bytes", RA("SELECT CAST(floor(coalesce(sum(CAST(region_ord AS BIGINT) * 1000000000), 0) * 1.1 / 1e9) AS BIGINT) AS gb FROM map_regions WHERE concat('NATION_', region_ord) NOT IN (SELECT region_id FROM map_artifacts WHERE kind = 'basemap')"))
def _(spark, d):
    """All artifacts."""
    r = regions(spark, d).select(F.concat(F.lit("NATION_"), F.col("region_ord").cast("string")).alias("region_id"), (F.col("region_ord") * F.lit(1_000_000_000).cast("bigint")).alias("estimated_bytes"))
    return K.remaining_bytes(r, view(spark, d, "map_artifacts"))


@query("tile_zoom_audit", RA("SELECT filename AS archive, min(maxzoom) AS min_z, max(maxzoom) AS max_z, count(*) AS n, min(maxzoom) >= 9 AND max(maxzoom) <= 14 AS ok FROM map_artifacts GROUP BY filename"))
def _(spark, d):
    tiles = view(spark, d, "map_artifacts").select(F.col("filename").alias("archive"), F.col("maxzoom").alias("z"))
    heads = tiles.select("archive").distinct().withColumns({"minzoom": F.lit(9), "maxzoom": F.lit(14)})
    return K.tile_zoom_audit(tiles, heads)


@query("gap_cluster", with_views("SELECT event_id, CAST(sum(new) OVER (PARTITION BY device ORDER BY lo, event_id) AS BIGINT) AS cluster FROM (SELECT event_id, device, lo, CASE WHEN lo - max(hi) OVER (PARTITION BY device ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3 THEN 1 ELSE 0 END AS new FROM (SELECT event_id, device, CAST(event_id * 37 % 360 AS DOUBLE) AS lo, event_id * 37 % 360 + event_id % 5 * 1e0 AS hi FROM fixes))", "fixes"))
def _(spark, d):
    lo = (F.col("event_id") * 37 % 360).cast("double")
    out = K.gap_cluster(view(spark, d, "fixes").select("event_id", "device", lo.alias("lo"), (lo + F.col("event_id") % 5).alias("hi")), "device", "lo", "hi", 3.0, "event_id")
    return out.select("event_id", "cluster")


def tree(spark, d):
    """A four-level tree over customers: each node's parent is its number without the last digit."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    parent = F.when(F.col("k") >= 10, F.floor(F.col("k") / 10).cast("string"))
    return c.where("k > 0").select(F.col("k").cast("string").alias("id"), parent.alias("parent"), (F.col("k") * 37 % 100).alias("bytes"))


TREE = "tree AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey >= 10 THEN CAST(c_custkey // 10 AS VARCHAR) END AS parent, c_custkey * 37 % 100 AS bytes FROM customer WHERE c_custkey > 0)"


@query("effective_parent", f"WITH {TREE} SELECT CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN concat('p/', id) ELSE id END AS id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'p' ELSE parent END AS parent FROM tree")
def _(spark, d):
    t = tree(spark, d)
    return K.effective_parent(t.withColumn("id", F.when(F.col("id").cast("bigint") % 2 == 0, F.concat(F.lit("p/"), F.col("id"))).otherwise(F.col("id"))))


@query("top_level", f"WITH {TREE} SELECT id, id[1:1] AS root FROM tree")
def _(spark, d):
    return K.top_level(tree(spark, d))


@query("admin_walk", f"WITH RECURSIVE {TREE}, kids AS (SELECT DISTINCT parent AS p FROM tree WHERE parent IS NOT NULL), walk AS (SELECT id, bytes, 1 AS depth FROM tree WHERE parent IN (SELECT id FROM tree WHERE parent IS NULL) UNION ALL SELECT t.id, t.bytes, depth + 1 FROM walk w JOIN tree t ON t.parent = w.id WHERE w.bytes > 60) SELECT id FROM walk LEFT JOIN kids ON p = id WHERE bytes <= 60 OR p IS NULL UNION ALL SELECT id FROM tree WHERE parent IS NULL AND id NOT IN (SELECT p FROM kids)")
def _(spark, d):
    return K.admin_walk(tree(spark, d), 60)


@query("region_boxes", with_views("WITH a AS (SELECT *, CASE WHEN w - max(e) OVER (PARTITION BY group_id ORDER BY w, region_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.3 THEN 1 ELSE 0 END AS nx FROM map_regions), b AS (SELECT *, sum(nx) OVER (PARTITION BY group_id ORDER BY w, region_ord) AS cx FROM a), c AS (SELECT *, CASE WHEN s - max(n) OVER (PARTITION BY group_id, cx ORDER BY s, region_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.3 THEN 1 ELSE 0 END AS ny FROM b), d AS (SELECT *, sum(ny) OVER (PARTITION BY group_id, cx ORDER BY s, region_ord) AS cy FROM c), g AS (SELECT group_id, round(min(w), 4) AS w, round(min(s), 4) AS s, round(max(e), 4) AS e, round(max(n), 4) AS n FROM d GROUP BY group_id, cx, cy) SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY (e - w) * (n - s) DESC, w, s) AS ord, w, s, e, n FROM g", "map_regions"))
def _(spark, d):
    parts = regions(spark, d).select(F.col("group_id").alias("id"), F.col("region_ord").alias("ord"), "w", "s", "e", "n")
    return K.region_boxes(parts, 0.3).select(F.col("id").alias("group_id"), "ord", "w", "s", "e", "n")


@query("size_estimate", with_views("SELECT region_id AS box_id, zoom, round((e - w) * (n - s) * 40e6 / pow(4, 15 - zoom), 3) AS bytes FROM map_regions, (VALUES (15), (14), (13)) t(zoom)", "map_regions"))
def _(spark, d):
    return K.size_estimate(regions(spark, d).withColumnRenamed("region_id", "box_id"), 40e6, 15, [15, 14, 13]).withColumn("bytes", F.round("bytes", 3))


@query("zoom_ladder", with_views("SELECT box_id, CASE WHEN b <= 2e7 THEN 15 WHEN b / 4 <= 2e7 THEN 14 ELSE 13 END AS zoom FROM (SELECT region_id AS box_id, (e - w) * (n - s) * 40e6 AS b FROM map_regions)", "map_regions"))
def _(spark, d):
    return K.zoom_ladder(K.size_estimate(regions(spark, d).withColumnRenamed("region_id", "box_id"), 40e6, 15, [15, 14, 13]), 2e7).select("box_id", "zoom")


@query("quadtree_split", PR("""WITH inside AS (SELECT region_id AS box_id, src_ord % 50 AS bytes, least(floor((lon - w) / (e - w) * 8), 7) AS qx, least(floor((lat - s) / (n - s) * 8), 7) AS qy FROM osm_points JOIN map_regions ON lat BETWEEN s AND n AND lon BETWEEN w AND e),
levels AS (SELECT box_id, l AS level, CAST(floor(qx / pow(2, 3 - l)) AS BIGINT) AS x, CAST(floor(qy / pow(2, 3 - l)) AS BIGINT) AS y, CAST(sum(bytes) AS BIGINT) AS bytes FROM inside, (VALUES (0), (1), (2), (3)) t(l) GROUP BY 1, 2, 3, 4),
leaf AS (SELECT * FROM levels WHERE bytes <= 400 OR level = 3) SELECT box_id, level, x, y, bytes FROM leaf WHERE level = 0 OR EXISTS (SELECT 1 FROM levels p WHERE p.box_id = leaf.box_id AND p.level = leaf.level - 1 AND p.x = leaf.x // 2 AND p.y = leaf.y // 2 AND p.bytes > 400)"""))
def _(spark, d):
    features = points(spark, d).withColumn("bytes", F.col("src_ord") % 50)
    return K.quadtree_split(regions(spark, d).select(F.col("region_id").alias("box_id"), *X.BOX), features, 400).select("box_id", "level", "x", "y", "bytes")


@query("region_ids", with_views("SELECT region_ord, CASE WHEN k = 1 THEN b ELSE concat(b, '-', k) END AS region_id FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY region_ord) AS k FROM (SELECT region_ord, concat('area', group_id, '-', CASE WHEN region_ord % 2 = 0 THEN 'n' ELSE 's' END) AS b FROM map_regions))", "map_regions"))
def _(spark, d):
    r = regions(spark, d).select("region_ord", F.col("region_ord").alias("ord"), F.concat(F.lit("area"), F.col("group_id").cast("string")).alias("area"))
    return K.region_ids(r, "area", F.when(F.col("ord") % 2 == 0, "n").otherwise("s")).select("region_ord", "region_id")


@query("catalog_report", RA("WITH t AS (SELECT region_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM map_artifacts GROUP BY region_id) SELECT 'regions' AS metric, '' AS key, count(*) AS value FROM t UNION ALL SELECT 'total', '', CAST(sum(bytes) AS BIGINT) FROM t UNION ALL SELECT 'median', '', bytes FROM (SELECT *, row_number() OVER (ORDER BY bytes, region_id) AS r, count(*) OVER () AS c FROM t) WHERE r = c // 2 + 1 UNION ALL SELECT * FROM (SELECT 'largest', region_id, bytes FROM t ORDER BY bytes DESC, region_id LIMIT 10)"))
def _(spark, d):
    return K.catalog_report(view(spark, d, "map_artifacts").groupBy("region_id").agg(F.sum("bytes").alias("bytes")))


@query("tile_region_cut", PR("WITH t AS (SELECT DISTINCT z, CAST(floor((lon + 180) / 360 * pow(2, z)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y FROM osm_points, (VALUES (8), (10), (12)) v(z)), b AS (SELECT *, x / pow(2, z) * 360 - 180 AS tw, (x + 1) / pow(2, z) * 360 - 180 AS te, degrees(atan((exp(pi() * (1 - 2 * y / pow(2, z))) - exp(-pi() * (1 - 2 * y / pow(2, z)))) / 2)) AS tn, degrees(atan((exp(pi() * (1 - 2 * (y + 1) / pow(2, z))) - exp(-pi() * (1 - 2 * (y + 1) / pow(2, z)))) / 2)) AS ts FROM t) SELECT region_id, z, x, y FROM b JOIN map_regions ON z <= 10 AND tw < e AND te > w AND ts < n AND tn > s"))
def _(spark, d):
    from tarnspark.functions import geo

    z = F.explode(F.array(F.lit(8), F.lit(10), F.lit(12)))
    t = points(spark, d).withColumn("z", z).select("z", geo.tile_x(F.col("lng"), F.col("z")).alias("x"), geo.tile_y(F.col("lat"), F.col("z")).alias("y")).distinct()
    edge = lambda k: geo.tile_lng(F.col("x") + k, F.col("z"))
    boxed = t.select("z", "x", "y", edge(0).alias("w"), geo.tile_lat(F.col("y") + 1, F.col("z")).alias("s"), edge(1).alias("e"), geo.tile_lat(F.col("y"), F.col("z")).alias("n"))
    return X.tile_region_cut(boxed, regions(spark, d), 10)


@query("scan_regions_flags", with_views("SELECT group_id, count(*) AS n, CAST(sum(CASE WHEN region_ord % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS contours FROM map_regions GROUP BY group_id", "map_regions"))
def _(spark, d):
    return regions(spark, d).groupBy("group_id").agg(F.count("*").alias("n"), F.sum((F.col("region_ord") % 2 == 0).cast("int")).alias("contours"))


@query("region_priority", PR(f"WITH met AS (SELECT src_ord, {AREA} AS area, region_ord, src_ord % 97 + region_ord AS prom FROM osm_points JOIN map_regions ON lat BETWEEN s AND n AND lon BETWEEN w AND e) SELECT src_ord, arg_max(prom, area * 1e6 + region_ord) AS prom FROM met GROUP BY src_ord"))
def _(spark, d):
    from tarnspark.operators.raster import region_priority

    met = X.bbox_join(points(spark, d), regions(spark, d)).select("src_ord", "region_id", (F.col("src_ord") % 97 + F.col("region_ord")).alias("prom"))
    return region_priority(met, "src_ord", regions(spark, d))


@query("overlap_share", with_views("SELECT a.region_id, round(sum(greatest(0, least(a.e, b.e) - greatest(a.w, b.w)) * greatest(0, least(a.n, b.n) - greatest(a.s, b.s)) / ((a.e - a.w) * (a.n - a.s))), 9) AS covered FROM map_regions a JOIN map_regions b ON a.group_id = b.group_id GROUP BY a.region_id", "map_regions"))
def _(spark, d):
    r = regions(spark, d)
    a = r.select("region_id", "group_id", *[F.col(c).alias("a" + c) for c in X.BOX])
    b = r.select("group_id", *[F.col(c).alias("b" + c) for c in X.BOX])
    share = overlap_share([F.col("a" + c) for c in X.BOX], [F.col("b" + c) for c in X.BOX])
    return a.join(b, "group_id").groupBy("region_id").agg(F.round(F.sum(share), 9).alias("covered"))



@query("same_ground", with_views("WITH o AS (SELECT a.region_id AS id_a, b.region_id AS id_b, (least(a.e, b.e) - greatest(a.w, b.w)) * (least(a.n, b.n) - greatest(a.s, b.s)) / ((a.e - a.w) * (a.n - a.s)) AS f FROM map_regions a JOIN map_regions b ON a.region_id <> b.region_id AND least(a.e, b.e) > greatest(a.w, b.w) AND least(a.n, b.n) > greatest(a.s, b.s)) SELECT x.id_a, x.id_b FROM o x JOIN o y ON x.id_a = y.id_b AND x.id_b = y.id_a WHERE x.f > 0.02 AND y.f > 0.02", "map_regions"))
def _(spark, d):
    r = regions(spark, d)
    return X.same_ground(r, r, 0.02)


@query("swallowed", with_views("WITH g AS (SELECT region_id, w, s, e, n FROM map_regions UNION ALL SELECT concat('all ', group_id), min(w), min(s), max(e), max(n) FROM map_regions GROUP BY group_id), o AS (SELECT a.region_id AS inside, b.region_id FROM g a JOIN g b ON a.region_id <> b.region_id AND least(a.e, b.e) > greatest(a.w, b.w) AND least(a.n, b.n) > greatest(a.s, b.s) WHERE (least(a.e, b.e) - greatest(a.w, b.w)) * (least(a.n, b.n) - greatest(a.s, b.s)) / ((a.e - a.w) * (a.n - a.s)) > 0.9) SELECT region_id, count(*) AS n, min(inside) AS first FROM o GROUP BY region_id HAVING count(*) >= 3", "map_regions"))
def _(spark, d):
    r = regions(spark, d)
    whole = r.groupBy(F.concat(F.lit("all "), F.col("group_id").cast("string")).alias("region_id")).agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))
    return X.swallowed(r.select("region_id", *X.BOX).unionByName(whole)).select("region_id", "n", F.get("inside", F.lit(0)).alias("first"))


@query("tiles_for_bbox", with_views("WITH b AS (SELECT region_id, unnest(range(CAST(floor((w + 180) / 360 * 4096) AS BIGINT), CAST(floor((e + 180) / 360 * 4096) AS BIGINT) + 1)) AS x, s, n FROM map_regions), m AS (SELECT region_id, x, CAST(floor((1 - ln(tan(radians(n)) + 1 / cos(radians(n))) / pi()) / 2 * 4096) AS BIGINT) AS lo, CAST(floor((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2 * 4096) AS BIGINT) AS hi FROM b) SELECT region_id, CAST(12 AS BIGINT) AS z, x, unnest(range(lo, hi + 1)) AS y FROM m", "map_regions"))
def _(spark, d):
    from tarnspark.operators.tiles import tiles_for_bbox

    return tiles_for_bbox(regions(spark, d), 12).select("region_id", "z", "x", "y")
