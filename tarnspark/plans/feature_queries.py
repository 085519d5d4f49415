"""Queries of the classifiers, scalar functions, deduplication and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.functions import geo, naming, numbers, terrain
from tarnspark.operators import aggregates as A
from tarnspark.operators import classify as C
from tarnspark.operators.catalog import forecast_service
from tarnspark.operators.ranks import positions
from tarnspark.plans.registry import query
from tarnspark.plans.views import table, view, with_views

P = lambda sql, *more: with_views(sql, "osm_points", *more)
ELE = r"CASE WHEN v BETWEEN -500 AND 9000 THEN round(v, 1) END"
ELE_OF = r"try_cast(nullif(regexp_extract(replace({0}, ',', ''), '-?[0-9]+(\.[0-9]+)?', 0), '') AS DOUBLE)"
POP = "CASE WHEN regexp_matches(replace(tag_population, ',', ''), '^[0-9]+$') THEN CAST(replace(tag_population, ',', '') AS BIGINT) END"
KIND = """CASE WHEN tag_place IN ('city','town','village','hamlet','suburb') THEN tag_place WHEN tag_natural IN ('peak','volcano','saddle') THEN tag_natural END"""
PLACES = f"""places AS (SELECT src_ord, name, kind, lat, lon,
  CASE WHEN kind IN ('city','town','village','hamlet','suburb') AND pop > 0 THEN pop END AS population,
  CASE WHEN v BETWEEN -500 AND 9000 THEN round(v, 1) END AS ele, coalesce(tag_wikidata, '') <> '' AS notable
  FROM (SELECT *, {KIND} AS kind, {POP} AS pop, {ELE_OF.format('tag_ele')} AS v FROM osm_points) x WHERE kind IS NOT NULL AND coalesce(name, '') <> ''),
ranked AS (SELECT *, CAST(CASE kind WHEN 'city' THEN 60 WHEN 'town' THEN 50 WHEN 'village' THEN 40 WHEN 'suburb' THEN 35 WHEN 'hamlet' THEN 30
  WHEN 'peak' THEN 25 WHEN 'volcano' THEN 25 ELSE 12 END + least(coalesce(population, 0) // 1000, 40) AS BIGINT) AS rank FROM places)"""
PLACE_COLUMNS = ["src_ord", "name", "kind", "lat", "lon", "population", "ele", "notable"]


def places(spark, d):
    return C.place_classify(view(spark, d, "osm_points"))


def ranked(spark, d):
    return C.place_rank(places(spark, d)).select(*PLACE_COLUMNS, "rank")


@query("tag_filter", P("SELECT src_ord FROM osm_points WHERE (osm_type = 'node' AND tag_natural IN ('peak','volcano')) OR (osm_type IN ('node','way') AND tag_man_made IS NOT NULL)"))
def _(spark, d):
    return C.tag_filter(view(spark, d, "osm_points"), ["n/natural=peak,volcano", "nw/man_made"]).select("src_ord")


@query("shared_subset", P("SELECT osm_type, count(*) AS n FROM osm_points WHERE (osm_type = 'node' AND tag_natural IN ('peak','volcano')) OR tag_man_made = 'mast' GROUP BY osm_type"))
def _(spark, d):
    union = ["n/natural=peak,volcano", "nwr/man_made=mast"]
    return C.shared_subset(view(spark, d, "osm_points"), union, {"peaks": union[:1]}).groupBy("osm_type").agg(F.count("*").alias("n"))


@query("peaks_normalize", P(f"SELECT src_ord, {ELE} AS ele FROM (SELECT src_ord, {ELE_OF.format('tag_ele')} AS v FROM osm_points)"))
def _(spark, d):
    return C.peaks_normalize(view(spark, d, "osm_points")).select("src_ord", "ele")


LANDMARK = """SELECT *, CASE WHEN kind IS NULL THEN 'unrecognized' WHEN tag_natural IN ('peak','volcano') THEN 'summit'
  WHEN kind IN ('mast','tower') AND tag_tower_type IN ('lighting') THEN 'not_a_landmark' END AS reason
  FROM (SELECT *, CASE WHEN tag_man_made IN ('mast','tower','survey_point','cairn','lighthouse') THEN tag_man_made END AS kind FROM osm_points)"""


@query("landmarks_classify", P(f"SELECT src_ord, CASE WHEN reason IS NULL THEN kind END AS kind, reason FROM ({LANDMARK})"))
def _(spark, d):
    return C.landmarks_classify(view(spark, d, "osm_points")).select("src_ord", "kind", "reason")


@query("parking_classify", P("SELECT src_ord, reason IS NULL AS keep, reason IS NULL AND coalesce(tag_access = 'customers', false) AS customers, reason FROM (SELECT *, CASE WHEN tag_man_made IS NOT NULL THEN 'unrecognized' WHEN coalesce(tag_access, '') NOT IN ('','yes','permissive','destination','public','unknown','customers') THEN 'restricted' END AS reason FROM osm_points)"))
def _(spark, d):
    lots = view(spark, d, "osm_points").withColumn("tag_amenity", F.when(F.col("tag_man_made").isNull(), "parking")).withColumn("tag_parking", F.lit(None).cast("string"))
    return C.parking_classify(lots).select("src_ord", "keep", "customers", "reason")


def detail(spark, d):
    pick = F.get(F.array(*map(F.lit, ["wall", "kissing_gate", "hedge"])), F.pmod("src_ord", F.lit(5)).cast("int"))
    return C.detail_classify(
        view(spark, d, "osm_points").withColumn("tag_barrier", pick).withColumn("tag_power", F.when(F.col("src_ord") % 3 == 0, "tower"))
        .withColumn("tag_ford", F.when(F.col("src_ord") % 7 == 0, "yes").when(F.col("src_ord") % 7 == 1, "no"))
        .withColumn("geom_type", F.when(F.col("osm_type") == "node", "Point").otherwise("LineString"))
    )


DETAIL = """detail AS (SELECT src_ord, osm_type, CASE WHEN src_ord % 5 = 0 THEN 'wall' WHEN src_ord % 5 = 1 THEN 'gate' WHEN src_ord % 3 = 0 THEN 'pylon'
  WHEN src_ord % 7 = 0 THEN 'ford' END AS kind FROM osm_points)"""


@query("detail_classify", P(f"WITH {DETAIL} SELECT src_ord, kind, CASE kind WHEN 'wall' THEN 14 WHEN 'ford' THEN 14 WHEN 'gate' THEN 15 WHEN 'pylon' THEN 15 END AS minzoom FROM detail"))
def _(spark, d):
    return detail(spark, d).select("src_ord", "kind", "minzoom")


@query("detail_shape", P(f"WITH {DETAIL} SELECT src_ord, CASE WHEN kind IS NULL THEN NULL WHEN kind <> 'wall' AND osm_type = 'node' THEN 'point' WHEN kind <> 'wall' THEN 'midpoint' WHEN osm_type = 'node' THEN 'misshapen' ELSE 'line' END AS shape FROM detail"))
def _(spark, d):
    return C.detail_shape(detail(spark, d)).select("src_ord", "shape")


@query("terrain_features_classify", P("SELECT src_ord, k AS kind, name FROM (SELECT src_ord, name, CASE WHEN tag_natural = 'peak' THEN 'scree' WHEN tag_natural = 'volcano' THEN 'rock' ELSE tag_natural END AS k FROM osm_points) WHERE k IN ('scree','shingle','rock','stone')"))
def _(spark, d):
    renamed = view(spark, d, "osm_points").withColumn("tag_natural", F.when(F.col("tag_natural") == "peak", "scree").when(F.col("tag_natural") == "volcano", "rock").otherwise(F.col("tag_natural")))
    return C.terrain_features_classify(renamed).select("src_ord", "kind", "name")


GRADE = "CASE tag_grade WHEN 'T3-T4' THEN 4 WHEN 'mountain_hiking/T3' THEN 3 WHEN 't 4+' THEN 4 WHEN 'demanding_alpine_hiking!' THEN 5 END"
TRAIL = f"""trail AS (SELECT src_ord, tag_grade, CASE WHEN tag_grade IS NULL THEN 'untagged' WHEN rn > 1 THEN 'duplicate' WHEN g IS NULL THEN 'unreadable' END AS reason, g
  FROM (SELECT *, {GRADE} AS g, row_number() OVER (PARTITION BY tag_grade IS NOT NULL, osm_id ORDER BY src_ord) AS rn FROM osm_points))"""


@query("trail_grade", P(f"WITH {TRAIL} SELECT src_ord, reason, CASE WHEN reason IS NULL THEN g END AS t FROM trail"))
def _(spark, d):
    return C.trail_grade(view(spark, d, "osm_points")).select("src_ord", "reason", "t")


@query("parse_grade", P(f"SELECT src_ord, {GRADE} AS grade FROM osm_points"))
def _(spark, d):
    return view(spark, d, "osm_points").select("src_ord", numbers.parse_grade(F.col("tag_grade")).alias("grade"))


@query("unreadable_topk", P(f"WITH {TRAIL} SELECT tag_grade AS value, count(*) AS n, min(src_ord) AS first_seen FROM trail WHERE reason = 'unreadable' GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 8"))
def _(spark, d):
    return A.unreadable_topk(C.trail_grade(view(spark, d, "osm_points")).where("reason = 'unreadable'"), "tag_grade", "src_ord")


@query("paths_reduce", with_views("SELECT way_id, seq, CASE WHEN kind = 'highway' THEN 'track' ELSE 'path' END AS kind, CASE WHEN kind = 'highway' THEN 'track' ELSE kind END AS kind_detail FROM way_vertices", "way_vertices"))
def _(spark, d):
    lines = view(spark, d, "way_vertices").withColumn("highway", F.when(F.col("kind") == "highway", "track").otherwise(F.col("kind")))
    return C.paths_reduce(lines).select("way_id", "seq", "kind", "kind_detail")


@query("place_classify", P(f"WITH {PLACES} SELECT {', '.join(PLACE_COLUMNS)} FROM places"))
def _(spark, d):
    return places(spark, d).select(*PLACE_COLUMNS)


@query("place_rank", P(f"WITH {PLACES} SELECT src_ord, rank FROM ranked"))
def _(spark, d):
    return ranked(spark, d).select("src_ord", "rank")


DEDUPED = PLACES + """, deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, kind, round(lat, 4), round(lon, 4) ORDER BY src_ord) AS rn FROM ranked) WHERE rn = 1)"""


@query("place_dedupe", P(f"WITH {DEDUPED} SELECT src_ord, name, kind, rank FROM deduped"))
def _(spark, d):
    doubled = ranked(spark, d)
    return A.place_dedupe(doubled.unionByName(doubled.withColumn("src_ord", F.col("src_ord") + 10_000_000))).select("src_ord", "name", "kind", "rank")


@query("place_report", P(f"WITH {PLACES} SELECT kind, count(*) AS n FROM places GROUP BY kind"))
def _(spark, d):
    return A.place_report(places(spark, d))


@query("first_by_key", P("SELECT src_ord, osm_id, name FROM (SELECT *, row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY src_ord) AS rn FROM osm_points) WHERE rn = 1"))
def _(spark, d):
    return A.first_by_key(view(spark, d, "osm_points").select("src_ord", "osm_type", "osm_id", "name"), ["osm_type", "osm_id"], "src_ord").select("src_ord", "osm_id", "name")


@query("source_union", P("SELECT count(*) AS n, CAST(sum(src_ord) AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY src_ord) AS rn FROM osm_points) WHERE rn = 1"))
def _(spark, d):
    one = view(spark, d, "osm_points").select("src_ord", "osm_type", "osm_id")
    both = one.where("src_ord % 3 < 2").unionByName(one.where("src_ord % 3 > 0"))
    return A.first_by_key(both, ["osm_type", "osm_id"], "src_ord").agg(F.count("*").alias("n"), F.sum("src_ord").alias("total"))


@query("normalize_report", P(f"SELECT coalesce(reason, 'kept') AS outcome, CASE WHEN reason IS NULL THEN kind ELSE '' END AS kind, count(*) AS n FROM ({LANDMARK}) GROUP BY 1, 2"))
def _(spark, d):
    return A.normalize_report(C.landmarks_classify(view(spark, d, "osm_points")))


@query("walkable_filter", with_views("SELECT way_id, seq FROM way_vertices WHERE kind IN ('path','minor_road','medium_road','major_road') AND coalesce(access, '') NOT IN ('private', 'no')", "way_vertices"))
def _(spark, d):
    return C.walkable_filter(view(spark, d, "way_vertices")).select("way_id", "seq")


@query("notability_filter", P("SELECT src_ord FROM osm_points WHERE (src_ord % 400) >= 300 OR tag_wikidata IS NOT NULL OR src_ord % 50 = 0"))
def _(spark, d):
    peaks = view(spark, d, "osm_points").withColumn("prom", (F.col("src_ord") % 400).cast("double")).withColumn("lists", F.when(F.col("src_ord") % 50 == 0, "corbett;munro"))
    return C.notability_filter(peaks, 9).select("src_ord")


@query("list_membership", P("SELECT src_ord, src_ord % 4 = 0 AS listed FROM osm_points"))
def _(spark, d):
    lists = F.when(F.col("src_ord") % 4 == 0, "munro;hump").when(F.col("src_ord") % 4 == 1, "munros")
    return view(spark, d, "osm_points").select("src_ord", naming.list_membership(lists, "munro").alias("listed"))


@query("mercator_guard", P("SELECT src_ord FROM osm_points WHERE abs(lat + 29e0) > 85.0511287798066 - 0.001"))
def _(spark, d):
    return C.mercator_guard(view(spark, d, "osm_points").withColumn("lat", F.col("lat") + 29))[1].select("src_ord")


@query("catalog_select", with_views("SELECT region_id FROM map_regions WHERE region_ord % 2 = 0 AND regexp_matches(region_id, '_1')", "map_regions"))
def _(spark, d):
    return C.catalog_select(view(spark, d, "map_regions").withColumn("contours", F.col("region_ord") % 2 == 0), "contours", "_1").select("region_id")


@query("quality_checks", P("SELECT 'rows' AS rule, count(*) >= 100 AS ok, CAST(count(*) AS DOUBLE) AS value FROM osm_points UNION ALL SELECT 'peaks', sum(CASE WHEN tag_natural = 'peak' THEN 1 ELSE 0 END) >= 1000000, CAST(sum(CASE WHEN tag_natural = 'peak' THEN 1 ELSE 0 END) AS DOUBLE) FROM osm_points UNION ALL SELECT 'north', max(lat) <= 60, max(lat) FROM osm_points"))
def _(spark, d):
    rules = [("rows", F.count("*"), ">=", 100.0), ("peaks", F.sum((F.col("tag_natural") == "peak").cast("int")), ">=", 1e6), ("north", F.max("lat"), "<=", 60.0)]
    rules[1] = ("peaks", F.sum(F.when(F.col("tag_natural") == "peak", 1).otherwise(0)), ">=", 1e6)
    return A.quality_checks(view(spark, d, "osm_points"), rules)


SUMMITS = """WITH named AS (SELECT src_ord, name, CASE WHEN src_ord % 4 > 0 THEN src_ord % 1400 + 0e0 END AS ele FROM osm_points),
rules AS (SELECT n_nationkey AS rule, concat('Customer#0000', lpad(CAST(n_nationkey AS VARCHAR(3)), 2, '0'), CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '0' END) AS prefix, n_nationkey * 55e0 AS expected, 30e0 AS tolerance FROM nation)"""


@query("name_checks", P(f"{SUMMITS}, hit AS (SELECT rule, ele, row_number() OVER (PARTITION BY rule ORDER BY src_ord) AS rn FROM named JOIN rules ON starts_with(name, prefix) WHERE ele IS NOT NULL) SELECT rule, CASE WHEN ele IS NULL THEN 'skip' WHEN abs(ele - expected) <= tolerance THEN 'ok' ELSE 'fail' END AS status, ele AS value, expected FROM rules LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h USING (rule)"))
def _(spark, d):
    """Heights of known summits, found by the beginning of their names."""
    v = view(spark, d, "osm_points")
    named = v.select("src_ord", "name", F.when(F.col("src_ord") % 4 > 0, (F.col("src_ord") % 1400).cast("double")).alias("ele"))
    k = F.col("n_nationkey")
    prefix = F.concat(F.lit("Customer#0000"), F.lpad(k.cast("string"), 2, "0"), F.when(k % 2 == 0, "").otherwise("0"))
    rules = spark.read.parquet(f"{d}/nation.parquet").select(k.alias("rule"), prefix.alias("name"), (k * 55.0).alias("expected"), F.lit(30.0).alias("tolerance"))
    return A.name_checks(named, rules, value="ele")


@query("kind_checks", P("WITH r AS (SELECT n_nationkey AS rule, CASE n_nationkey % 4 WHEN 0 THEN 'peak' WHEN 1 THEN 'volcano' WHEN 2 THEN 'cave' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 40 END AS least, CASE WHEN n_nationkey % 5 = 2 THEN n_nationkey END AS exactly, CASE WHEN n_nationkey % 7 = 1 THEN 'node' END AS shape FROM nation), c AS (SELECT rule, least, exactly, shape, count(src_ord) AS n, count(src_ord) FILTER (shape IS NOT NULL AND osm_type <> shape) AS other FROM r LEFT JOIN osm_points p ON p.tag_natural = r.kind OR r.kind IS NULL GROUP BY ALL) SELECT rule, CASE WHEN exactly IS NOT NULL AND n = 0 THEN 'skip' WHEN coalesce(n < least, FALSE) OR coalesce(n <> exactly, FALSE) OR other > 0 THEN 'fail' ELSE 'ok' END AS status, n FROM c"))
def _(spark, d):
    """Enough features of each kind, and of the right shape."""
    k = F.col("n_nationkey")
    kind = F.when(k % 4 == 0, "peak").when(k % 4 == 1, "volcano").when(k % 4 == 2, "cave")
    rules = spark.read.parquet(f"{d}/nation.parquet").select(
        k.alias("rule"), kind.alias("kind"), F.when(k % 3 == 0, k * 40).alias("least"), F.when(k % 5 == 2, k).alias("exactly"), F.when(k % 7 == 1, "node").alias("shape")
    )
    return A.kind_checks(view(spark, d, "osm_points").withColumnRenamed("tag_natural", "kind"), rules, shape="osm_type")


@query("latest_record", "SELECT user_id, count(*) AS n, max(ts) AS updated, min(ts) AS created FROM events GROUP BY user_id")
def _(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.col("ts").alias("updated"), F.col("ts").alias("created"))
    latest = A.latest_record(log, "user_id", "updated", "created", F.col("event_id").isNull())
    counts = log.groupBy("user_id").agg(F.count("*").alias("n"))
    return latest.join(counts, "user_id").select("user_id", "n", "updated", "created")


@query("fold_bounds", with_views("SELECT way_id, round(w - lp / c, 9) AS w, round(s - lp, 9) AS s, round(e + lp / c, 9) AS e, round(n + lp, 9) AS n FROM (SELECT way_id, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n, degrees(250 / 6371008.8) AS lp, greatest(0.01, cos(radians((min(lat) + max(lat)) / 2))) AS c FROM way_vertices GROUP BY way_id)", "way_vertices"))
def _(spark, d):
    out = A.fold_bounds(view(spark, d, "way_vertices"), "way_id", 250)
    return out.select("way_id", *[F.round(c, 9).alias(c) for c in "wsen"])


@query("scalars_numbers", P(rf"SELECT src_ord, {POP} AS population, CASE WHEN name IS NULL THEN NULL ELSE concat(osm_type, '/', osm_id) END AS osm_key, floor(abs(lon) * 1e7 + 0.5) / 1e7 * sign(lon) AS c7, round(lat + 3e-5, 3) AS lat3 FROM osm_points"))
def _(spark, d):
    ident = F.when(F.col("name").isNotNull(), F.col("osm_id"))
    return view(spark, d, "osm_points").select(
        "src_ord", numbers.parse_population(F.col("tag_population")).alias("population"), naming.osm_key(F.col("osm_type"), ident).alias("osm_key"),
        numbers.coord7(F.col("lon")).alias("c7"), numbers.round_exact(F.col("lat") + 3e-5, 3).alias("lat3"),
    )


@query("scalars_geo", P("""SELECT src_ord, round(2 * 6371008.8 * asin(least(1, sqrt(h))), 3) AS metres, round(pow((lon + 3) * cos(radians(lat)), 2) + pow(lat - 56, 2), 9) AS d2,
  CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y
  FROM (SELECT *, pow(sin(radians(56 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(56)) * pow(sin(radians(-3 - lon) / 2), 2) AS h FROM osm_points)"""))
def _(spark, d):
    lon, lat, x, y = F.col("lon"), F.col("lat"), F.lit(-3.0), F.lit(56.0)
    return view(spark, d, "osm_points").select(
        "src_ord", F.round(geo.haversine_m(lon, lat, x, y), 3).alias("metres"), F.round(geo.planar_dist2(lon, lat, x, y), 9).alias("d2"),
        geo.tile_x(lon, F.lit(12)).alias("x"), geo.tile_y(lat, F.lit(12)).alias("y"),
    )


@query("compass_bearing", P("SELECT src_ord, CASE WHEN dx = 0 AND dy = 0 THEN 'here' ELSE ['N','NE','E','SE','S','SW','W','NW'][1 + CAST(floor(((degrees(atan2(yy, xx)) + 360) % 360) / 45 + 0.5) AS INTEGER) % 8] END AS bearing FROM (SELECT src_ord, -3 - lon AS dx, 56.5 - lat AS dy, sin(radians(-3 - lon)) * cos(radians(56.5)) AS yy, cos(radians(lat)) * sin(radians(56.5)) - sin(radians(lat)) * cos(radians(56.5)) * cos(radians(-3 - lon)) AS xx FROM osm_points)"))
def _(spark, d):
    return view(spark, d, "osm_points").select("src_ord", geo.compass_bearing(F.col("lon"), F.col("lat"), F.lit(-3.0), F.lit(56.5)).alias("bearing"))


@query("bbox_ops", with_views("SELECT region_id, round((e - w) * (n - s), 9) AS area, w < e AND s < n AS valid, CAST(ceil(log2(360 / greatest(e - w, n - s))) AS INTEGER) AS min_zoom, lower(replace(region_id, '_', '-')) AS safe FROM map_regions", "map_regions"))
def _(spark, d):
    b = [F.col(c) for c in "wsen"]
    return view(spark, d, "map_regions").select(
        "region_id", F.round(geo.box_area(*b), 9).alias("area"), geo.box_valid(*b).alias("valid"), geo.region_min_zoom(*b).alias("min_zoom"), naming.safe_id(F.col("region_id")).alias("safe"),
    )


@query("cell_label", with_views("SELECT region_id, concat(CAST(CAST(round_even((s + n) / 2, 0) AS INTEGER) AS VARCHAR), '°N ', CAST(CAST(round_even(abs((w + e) / 2), 0) AS INTEGER) AS VARCHAR), '°', CASE WHEN (w + e) / 2 < 0 THEN 'W' ELSE 'E' END) AS name FROM map_regions", "map_regions"))
def _(spark, d):
    return view(spark, d, "map_regions").select("region_id", geo.cell_label(*[F.col(c) for c in "wsen"])["name"].alias("name"))


@query("compass_label", with_views("SELECT region_id, CASE WHEN dx = 0 AND dy = 0 THEN 'outlying' ELSE concat_ws('-', CASE WHEN abs(dy) >= sp / 2 THEN CASE WHEN dy > 0 THEN 'north' ELSE 'south' END END, CASE WHEN abs(dx) >= sp / 2 THEN CASE WHEN dx > 0 THEN 'east' ELSE 'west' END END) END AS label FROM (SELECT region_id, (w + e) / 2 + 4 AS dx, (s + n) / 2 - 56 AS dy, greatest(abs((w + e) / 2 + 4), abs((s + n) / 2 - 56)) AS sp FROM map_regions)", "map_regions"))
def _(spark, d):
    home = [F.lit(-5.0), F.lit(55.0), F.lit(-3.0), F.lit(57.0)]
    return view(spark, d, "map_regions").select("region_id", geo.compass_label(*[F.col(c) for c in "wsen"], home).alias("label"))


@query("artifact_names", with_views(r"SELECT ord, kind, region_id FROM map_artifacts", "map_artifacts"))
def _(spark, d):
    f = F.col("filename")
    return view(spark, d, "map_artifacts").select("ord", naming.artifact_kind(f).alias("kind"), naming.region_id_of(F.concat(f, F.lit(".part"))).alias("region_id"))


@query("clean_name", P("SELECT src_ord, concat('Region ', src_ord % 9) AS clean FROM osm_points"))
def _(spark, d):
    name = F.when(F.col("src_ord") % 2 == 0, F.concat(F.lit("a/region-"), (F.col("src_ord") % 9).cast("string"))).otherwise(
        F.concat(F.lit(" Region<br />  "), (F.col("src_ord") % 9).cast("string"))
    )
    return view(spark, d, "osm_points").select("src_ord", naming.clean_name(name, F.lit("x")).alias("clean"))


@query("fold_text", "SELECT doc_id, trim(lower(strip_accents(text))) AS folded FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", naming.fold_text(F.col("text")).alias("folded"))


@query("fold_text_all", "SELECT doc_id, md5(folded) AS folded_md5, CAST(length(folded) AS BIGINT) AS n FROM (SELECT doc_id, trim(translate(lower(text), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) AS folded FROM documents)")
def _(spark, d):
    """The folded texts' digests and lengths."""
    folded = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", naming.fold_text(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.md5("folded").alias("folded_md5"), F.length("folded").cast("bigint").alias("n"))


@query("parse_latlng", P("SELECT src_ord, CASE WHEN src_ord % 3 <> 2 THEN round(lat, 4) END AS lat FROM osm_points"))
def _(spark, d):
    pair = F.concat(F.round("lat", 4).cast("string"), F.when(F.col("src_ord") % 3 == 0, ", ").when(F.col("src_ord") % 3 == 1, " ").otherwise(" x "), F.round("lon", 4).cast("string"))
    return view(spark, d, "osm_points").select("src_ord", naming.parse_latlng(pair)["lat"].alias("lat"))


@query("slope_scalars", with_views("SELECT r, c, CASE WHEN z % 90 < 25 THEN 0 ELSE least(z % 90, 60) END AS slope, CASE WHEN z % 90 >= 45 THEN 45 WHEN z % 90 >= 25 THEN (z % 90) // 5 * 5 END AS class, CASE WHEN z % 90 < 25 THEN NULL ELSE ['N','NE','E','SE','S','SW','W','NW'][1 + CAST(floor((z % 360) / 45e0 + 0.5) AS INTEGER) % 8] END AS facing, z * 256 + r + c / 256e0 - 32768 AS height, (z / 5000e0 + c / 600e0) * 3600 AS seconds FROM dem_cells", "dem_cells"))
def _(spark, d):
    z = (F.col("z") % 90).cast("double")
    slope = terrain.quantise_slope(z)
    return view(spark, d, "dem_cells").select(
        "r", "c", slope.alias("slope"), terrain.slope_class(z).alias("class"), terrain.aspect_name(terrain.octant((F.col("z") % 360).cast("double"), slope)).alias("facing"),
        terrain.terrarium_m(F.col("z"), F.col("r"), F.col("c")).alias("height"), terrain.naismith_s(F.col("z").cast("double"), F.col("c").cast("double")).alias("seconds"),
    )


@query("heading_from", with_views("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (heading + 90) % 360 WHEN event_id % 3 = 1 THEN (360 - heading + 90) % 360 END AS h FROM fixes", "fixes"))
def _(spark, d):
    k, h = F.col("event_id") % 3, F.col("heading").cast("double")
    none = F.lit(None).cast("double")
    out = terrain.heading_from(F.when(k == 0, h), none, F.when(k > 0, h), k == 1, F.lit(90.0))
    return view(spark, d, "fixes").select("event_id", out.alias("h"))


@query("forecast_service", with_views("SELECT region_id, CASE WHEN r_name <> 'ASIA' THEN concat('service of ', r_name) END AS service FROM map_regions JOIN region ON group_id = r_regionkey", "map_regions"))
def _(spark, d):
    r = view(spark, d, "map_regions")
    services = r.join(table(spark, d, "region"), F.col("group_id") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select("region_id", F.concat(F.lit("service of "), "r_name").alias("service"))
    return forecast_service(r, services).select("region_id", "service")


@query("parking_order", P("SELECT src_ord, pos FROM (SELECT src_ord, row_number() OVER (ORDER BY CASE WHEN name IS NULL THEN 2 ELSE 0 END + CASE WHEN tag_access = 'customers' THEN 1 ELSE 0 END - size / (size + 500), src_ord) AS pos FROM (SELECT *, CAST(src_ord % 900 AS DOUBLE) AS size FROM osm_points))"))
def _(spark, d):
    """A position for every lot."""
    size = (F.col("src_ord") % 900).cast("double")
    order = F.when(F.col("name").isNull(), 2).otherwise(0) + F.when(F.col("tag_access") == "customers", 1).otherwise(0) - size / (size + 500)
    return positions(view(spark, d, "osm_points"), [order, F.col("src_ord")]).select("src_ord", "pos")
