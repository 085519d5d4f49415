"""Queries of the path network, prominence and the device feeds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.operators import network as N
from tarnspark.operators import paths
from tarnspark.operators import prominence as P
from tarnspark.operators import raster as R
from tarnspark.operators.lines import segments
from tarnspark.plans.line_queries import NEAR
from tarnspark.plans.raster_queries import CELLS, POINTS, cells, dem, pixel_points
from tarnspark.plans.registry import query
from tarnspark.plans.views import view, with_views
from tarnspark.scratch import stored
from tarnspark.streaming import devices as S

V = lambda sql, *more: with_views(sql, "way_vertices", *more)
NODES = "nv AS (SELECT *, gx * 100000 + gy AS node_id FROM way_vertices)"
EDGES = f"""{NODES}, st AS (SELECT way_id, seq, kind, node_id, lead(node_id) OVER w AS nxt, lng, lat, lead(lng) OVER w AS lng2, lead(lat) OVER w AS lat2 FROM nv WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
ed AS (SELECT * FROM (SELECT least(node_id, nxt) AS a, greatest(node_id, nxt) AS b, kind, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2))) AS length_m,
  row_number() OVER (PARTITION BY least(node_id, nxt), greatest(node_id, nxt) ORDER BY way_id, seq) AS rn FROM st WHERE nxt IS NOT NULL AND nxt <> node_id) WHERE rn = 1)"""


def network(spark, d, vertices=None):
    v = (vertices or view(spark, d, "way_vertices")).withColumn("node_id", F.col("gx") * 100000 + F.col("gy"))
    return v.groupBy("node_id").agg(F.first("lng").alias("lng"), F.first("lat").alias("lat")), N.edge_build(v)


@query("edge_build", V(f"WITH {EDGES} SELECT a, b, kind, round(length_m, 3) AS length_m FROM ed"))
def _(spark, d):
    return network(spark, d)[1].withColumn("length_m", F.round("length_m", 3))


@query("node_merge", V("SELECT way_id, seq, min(way_id * 100 + seq) OVER (PARTITION BY gx, gy) AS node_id FROM way_vertices"))
def _(spark, d):
    # Places are 20 units apart; ways and vertices of odd numbers lie a unit beside them, within the tolerance.
    beside = lambda c, k: (F.col(c) + F.col(k) % 2).alias(c)
    v = view(spark, d, "way_vertices").select("way_id", "seq", beside("gx", "way_id"), beside("gy", "seq"), (F.col("way_id") * 100 + F.col("seq")).alias("src_ord"))
    return N.node_merge(v).select("way_id", "seq", "node_id")


@query("connected_components", V(f"WITH RECURSIVE {EDGES}, li AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach AS (SELECT DISTINCT node_id AS n, node_id AS r FROM nv UNION SELECT reach.n, li.b FROM reach JOIN li ON li.a = reach.r) SELECT n AS node_id, min(r) AS component FROM reach GROUP BY n".replace("WITH RECURSIVE", "WITH")))
def _(spark, d):
    return N.connected_components(*network(spark, d))


@query("gap_bridge")
def _(spark, d):
    return N.gap_bridges(*network(spark, d), 150.0, 6).select("a", "b", F.round("length_m", 3).alias("length_m"))


def tapped(spark, d, vertices=None):
    """One leg for each way: from its first vertex to its last."""
    s = segments(vertices or view(spark, d, "way_vertices"), "way_id")
    return s.groupBy(F.col("way_id").alias("leg_id")).agg(
        F.min_by("lng", "seg").alias("from_lng"), F.min_by("lat", "seg").alias("from_lat"), F.max_by("lng2", "seg").alias("to_lng"), F.max_by("lat2", "seg").alias("to_lat")
    )


M = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({1} - {3}) / 2), 2) + cos(radians({3})) * cos(radians({1})) * pow(sin(radians({0} - {2}) / 2), 2))))"
WEIGHT = "CASE kind WHEN 'path' THEN 1e0 WHEN 'minor_road' THEN 1.2e0 WHEN 'medium_road' THEN 1.6e0 ELSE 1.5e0 END"
#: Every leg's search as a table keyed by (leg, node), relaxed until nothing gets cheaper.
CHEAPEST = f"""{EDGES}, nodes AS (SELECT DISTINCT node_id, gx, gy, lng, lat FROM nv),
arcs AS (SELECT a, b, {WEIGHT} * length_m AS w FROM ed UNION ALL SELECT b, a, {WEIGHT} * length_m FROM ed),
ends AS (SELECT way_id, min_by(struct_pack(gx := gx, gy := gy, lng := lng, lat := lat), seq) AS f, max_by(struct_pack(gx := gx, gy := gy, lng := lng, lat := lat), seq) AS t FROM nv GROUP BY way_id HAVING count(*) > 1),
legs AS (SELECT *, degrees(greatest(1200, 0.35 * {M.format('f.lng', 'f.lat', 't.lng', 't.lat')}) / 6371008.8) AS up FROM ends),
boxes AS (SELECT way_id AS leg, least(f.lng, t.lng) - up / cos(radians(greatest(f.lat, t.lat))) AS west, greatest(f.lng, t.lng) + up / cos(radians(greatest(f.lat, t.lat))) AS east, least(f.lat, t.lat) - up AS south, greatest(f.lat, t.lat) + up AS north FROM legs),
tips AS (SELECT way_id AS leg, 0 AS side, f AS p FROM legs UNION ALL SELECT way_id, 1, t FROM legs),
around AS (SELECT x * 20 AS dx, y * 20 AS dy FROM range(-2, 3) i(x), range(-2, 3) j(y)),
near AS (SELECT leg, side, node_id, {M.format('n.lng', 'n.lat', 'p.lng', 'p.lat')} AS m FROM tips, around JOIN nodes n ON n.gx = p.gx + dx AND n.gy = p.gy + dy),
snaps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg, side ORDER BY m, node_id) AS rn FROM near WHERE m <= 250) WHERE rn <= 8),
reached(leg, node_id, cost) USING KEY (leg, node_id) AS (
  SELECT leg, node_id, m FROM snaps WHERE side = 0
  UNION
  SELECT r.leg, c.b, min(r.cost + c.w) FROM reached r JOIN arcs c ON c.a = r.node_id JOIN nodes n ON n.node_id = c.b JOIN boxes x ON x.leg = r.leg AND n.lng BETWEEN west AND east AND n.lat BETWEEN south AND north
  LEFT JOIN recurring.reached o ON o.leg = r.leg AND o.node_id = c.b WHERE o.cost IS NULL OR r.cost + c.w < o.cost GROUP BY r.leg, c.b
)"""


@query("least_cost_path", slow=V(f"WITH {CHEAPEST}, done AS (SELECT r.leg, min(r.cost + s.m) AS cost FROM reached r JOIN snaps s ON s.leg = r.leg AND s.node_id = r.node_id AND side = 1 GROUP BY r.leg) SELECT way_id AS leg_id, round(cost, 3) AS cost, CASE WHEN cost IS NULL THEN 'no_path' END AS reason FROM ends LEFT JOIN done ON leg = way_id"))
def _(spark, d):
    # Nodes, edges and legs are read from the same vertices, which are put in order once.
    vertices = stored(view(spark, d, "way_vertices").drop("access"), "vertices")
    nodes, edges = network(spark, d, vertices)
    out = paths.least_cost_path(tapped(spark, d, vertices), nodes, edges)
    return out.select("leg_id", F.round("cost", 3).alias("cost"), "reason")


@query("leg_fallback", V("SELECT DISTINCT way_id AS leg_id, CASE WHEN way_id % 5 = 0 OR way_id % 7 = 0 OR way_id % 11 = 0 OR way_id % 13 = 0 THEN 'straight' ELSE 'path' END AS kind, CASE WHEN way_id % 5 = 0 THEN 'freehand' WHEN way_id % 7 = 0 THEN 'no_region' WHEN way_id % 11 = 0 THEN 'too_long' WHEN way_id % 13 = 0 THEN 'no_path' END AS reason FROM way_vertices"))
def _(spark, d):
    ids = view(spark, d, "way_vertices").select(F.col("way_id").alias("leg_id")).distinct()
    k = F.col("leg_id")
    legs = ids.select("leg_id", (k % 5 != 0).alias("snap"), F.when(k % 11 == 0, 5000).otherwise(3).alias("tiles"))
    paths = ids.where("leg_id % 13 <> 0").withColumn("way", F.array("leg_id"))
    return N.leg_fallback(legs, paths, ids.where("leg_id % 7 <> 0"))


@query("leg_endpoints", V("WITH b AS (SELECT way_id, count(*) AS n FROM way_vertices GROUP BY way_id HAVING count(*) > 1) SELECT way_id AS leg_id, n + CASE WHEN way_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM b"))
def _(spark, d):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("lng", "lat").alias("p")))), lambda x: x["p"])
    lines = view(spark, d, "way_vertices").groupBy(F.col("way_id").alias("leg_id")).agg(pts.alias("coords")).where(F.size("coords") > 1)
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    away = F.struct((last["lng"] + 1e-3).alias("lng"), last["lat"].alias("lat"))
    legs = lines.withColumn("from_pt", first).withColumn("to_pt", F.when(F.col("leg_id") % 2 == 0, away).otherwise(last))
    return N.leg_endpoints(legs).select("leg_id", F.size("coords").cast("bigint").alias("n"))


@query("way_names", V("SELECT way_id AS leg_id, count(*) AS n FROM (SELECT way_id, seq, name, lag(name) OVER (PARTITION BY way_id ORDER BY seq) AS p FROM (SELECT way_id, seq, concat('w', gx % 3) AS name FROM way_vertices WHERE gy % 40 <> 0)) WHERE p IS NULL OR p <> name GROUP BY way_id"))
def _(spark, d):
    named = view(spark, d, "way_vertices").select(F.col("way_id").alias("leg_id"), F.col("seq").alias("pos"), F.when(F.col("gy") % 40 != 0, F.concat(F.lit("w"), (F.col("gx") % 3).cast("string"))).alias("name"))
    return N.way_names(named).select("leg_id", F.size("names").cast("bigint").alias("n"))


# Prominence -----------------------------------------------------------------------------------------------------------


def summits(spark, d):
    """The highest cell around each point of the pixel grid, as peaks."""
    at = pixel_points(spark, d).groupBy(F.floor("px").alias("x"), F.floor("py").alias("y")).agg(F.min("event_id").alias("peak_id"), F.first("px").alias("px"), F.first("py").alias("py"))
    return R.peak_snap(at.select("peak_id", "px", "py"), "peak_id", dem(spark, d))


#: Labels of the cells at or above each threshold fall to the least cell that they reach.
FLOOD = f"""{POINTS}, p AS (SELECT min(event_id) AS peak_id, CAST(floor(px) AS INTEGER) AS c, CAST(floor(py) AS INTEGER) AS r FROM pts GROUP BY floor(px), floor(py)),
tops AS (SELECT peak_id, d.r * 128 + d.c AS cell, d.z AS ele FROM p JOIN dem_cells d ON d.r BETWEEN p.r - 2 AND p.r + 2 AND d.c BETWEEN p.c - 2 AND p.c + 2 QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY d.z DESC, d.r, d.c) = 1),
lim AS (SELECT floor(max(z) / 600e0) * 600 AS top, min(z) AS low FROM dem_cells),
th AS (SELECT top - k * 600 AS t FROM lim, range(100) g(k) WHERE top - k * 600 > greatest(0, low) - 600),
open_ AS (SELECT t, r * 128 + c AS cell, r, c FROM th JOIN dem_cells ON z >= t),
beside AS (SELECT o.t, o.cell AS a, q.cell AS b FROM open_ o, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dr, dc) JOIN open_ q ON q.t = o.t AND q.r = o.r + dr AND q.c = o.c + dc),
label(t, cell, root) USING KEY (t, cell) AS (
  SELECT t, cell, cell FROM open_
  UNION
  SELECT l.t, n.b, min(l.root) FROM label l JOIN beside n ON n.t = l.t AND n.a = l.cell JOIN recurring.label o ON o.t = l.t AND o.cell = n.b WHERE l.root < o.root GROUP BY l.t, n.b
),
met AS (SELECT peak_id, l.t, row_number() OVER (PARTITION BY l.t, root ORDER BY ele DESC, peak_id) AS rn FROM tops JOIN label l USING (cell)),
saddles AS (SELECT peak_id, max(t) AS t FROM met WHERE rn > 1 GROUP BY peak_id)"""


@query("prominence", slow=with_views(f"WITH {FLOOD} SELECT peak_id, CASE WHEN t IS NULL THEN ele - (SELECT low FROM lim) * 1e0 ELSE greatest(0e0, ele - t) END AS prom FROM tops LEFT JOIN saddles USING (peak_id)", "dem_cells", "fixes"))
def _(spark, d):
    return P.prominence(summits(spark, d), dem(spark, d), 600.0, 0.0)


@query("threshold_grid", with_views("SELECT CAST(floor(mx / 100e0) * 100 - k * 100 AS DOUBLE) AS t FROM (SELECT max(z) AS mx, min(z) AS mn FROM dem_cells), range(1000) r(k) WHERE floor(mx / 100e0) * 100 - k * 100 > greatest(0, mn) - 100", "dem_cells"))
def _(spark, d):
    low, high = dem(spark, d).agg(F.min("z"), F.max("z")).first()
    return spark.createDataFrame([(float(t),) for t in P.threshold_grid(low, high, 100.0, 0.0)], "t double")


@query("prominence_report", with_views("WITH s AS (SELECT c_custkey AS peak_id, c_custkey * 37 % 900 * 1e0 AS prom FROM customer), r AS (SELECT prom, row_number() OVER (ORDER BY prom DESC, peak_id) - 1 AS r, count(*) OVER () AS n FROM s) SELECT max(n) AS n, max(prom) AS max, max(CASE WHEN r = n // 2 THEN prom END) AS median, max(CASE WHEN r = n // 10 THEN prom END) AS p90 FROM r", "osm_points"))
def _(spark, d):
    scores = view(spark, d, "osm_points").select(F.col("src_ord").alias("peak_id"), (F.col("src_ord") * 37 % 900).cast("double").alias("prom"))
    return P.prominence_report(scores)


@query("prom_attach", with_views("SELECT src_ord AS peak_id, CASE WHEN src_ord % 3 = 0 THEN src_ord * 1e0 WHEN src_ord % 2 = 0 THEN 7e0 END AS prom FROM osm_points", "osm_points"))
def _(spark, d):
    p = view(spark, d, "osm_points").select(F.col("src_ord").alias("peak_id"), F.when(F.col("src_ord") % 2 == 0, 7.0).alias("prom"))
    return P.prom_attach(p, p.where("peak_id % 3 = 0").select("peak_id", F.col("peak_id").cast("double").alias("prom")))


# Device feeds ---------------------------------------------------------------------------------------------------------

X = lambda sql, *more: with_views(sql, "fixes", *more)


FOLLOW = NEAR.replace("1 + event_id % (SELECT max(way_id) FROM way_vertices) AS way_id", "device, epoch_us(CAST(ts AS TIMESTAMP)) + event_id AS us, 1 + device * 61 % (SELECT max(way_id) FROM way_vertices) AS way_id").replace(" OR n = 1", "")


@query("follow_route", X(FOLLOW + """, n AS (SELECT * FROM (SELECT device, way_id, us, dist, row_number() OVER (PARTITION BY event_id ORDER BY dist, segment) AS rn FROM s) WHERE rn = 1),
t AS (SELECT *, last_value(CASE WHEN dist > 60000 THEN TRUE WHEN dist <= 30000 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY device, way_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_off FROM n)
SELECT device, way_id AS route_id, count(*) AS n, CAST(count(*) FILTER (is_off) AS BIGINT) AS off, round(max(dist), 1) AS farthest_m FROM t GROUP BY 1, 2""", "way_vertices"))
def _(spark, d):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("lng", "lat").alias("p")))), lambda x: x["p"])
    routes = view(spark, d, "way_vertices").groupBy(F.col("way_id").alias("route_id")).agg(pts.alias("coords"))
    # Times repeat in this feed, so the event number goes into the time.
    ts = (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id")).alias("ts")
    last = view(spark, d, "way_vertices").agg(F.max("way_id").alias("last"))
    fixes = view(spark, d, "fixes").crossJoin(F.broadcast(last)).select("device", ts, "lng", "lat", (1 + F.col("device") * 61 % F.col("last")).alias("route_id"))
    out = S.follow_route(fixes, routes.where(F.size("coords") > 1), 60_000, 30_000)
    return out.groupBy("device", "route_id").agg(F.count("*").alias("n"), F.sum(F.col("is_off").cast("int")).alias("off"), F.round(F.max("off_m"), 1).alias("farthest_m"))


FOLD = """list_reduce(rows, lambda a, x: struct_pack(us := x.us, b := x.b,
  rate := CASE WHEN x.us - a.us >= 100000 AND x.b > a.b THEN CASE WHEN a.rate IS NULL THEN (x.b - a.b) / ((x.us - a.us) / 1e6) ELSE 0.3e0 * ((x.b - a.b) / ((x.us - a.us) / 1e6)) + 0.7e0 * a.rate END ELSE a.rate END,
  n := a.n + CASE WHEN x.us - a.us >= 100000 AND x.b > a.b THEN 1 ELSE 0 END,
  told := a.told + CASE WHEN a.n + CASE WHEN x.us - a.us >= 100000 AND x.b > a.b THEN 1 ELSE 0 END >= 3 THEN 1 ELSE 0 END,
  top := CASE WHEN a.n + CASE WHEN x.us - a.us >= 100000 AND x.b > a.b THEN 1 ELSE 0 END < 3 THEN a.top ELSE greatest(coalesce(a.top, 0e0),
    CASE WHEN x.us - a.us >= 100000 AND x.b > a.b THEN CASE WHEN a.rate IS NULL THEN (x.b - a.b) / ((x.us - a.us) / 1e6) ELSE 0.3e0 * ((x.b - a.b) / ((x.us - a.us) / 1e6)) + 0.7e0 * a.rate END ELSE a.rate END) END))"""


@query("transfer_rate", X(f"""WITH f AS (SELECT device, epoch_us(CAST(ts AS TIMESTAMP)) + event_id AS us, bytes_gained FROM fixes),
g AS (SELECT device, us, CAST(sum(bytes_gained) OVER (PARTITION BY device ORDER BY us) AS BIGINT) AS b FROM f),
l AS (SELECT device, list(struct_pack(us := us, b := b, rate := CAST(NULL AS DOUBLE), n := 0, told := CAST(0 AS BIGINT), top := CAST(NULL AS DOUBLE)) ORDER BY us) AS rows FROM g GROUP BY device),
r AS (SELECT device, {FOLD} AS r FROM l)
SELECT device AS "key", r.told AS n, round(r.top, 3) AS top FROM r"""))
def _(spark, d):
    v = view(spark, d, "fixes").withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id")))
    so_far = F.sum("bytes_gained").over(Window.partitionBy("device").orderBy("ts", "event_id"))
    out = S.transfer_rate(v.select(F.col("device").alias("key"), "ts", so_far.alias("bytes"), F.lit(10_000_000).cast("bigint").alias("total")))
    return out.groupBy("key").agg(F.count("rate").alias("n"), F.round(F.max("rate"), 3).alias("top"))


@query("heading_changes", X("SELECT device, count(*) AS n FROM (SELECT device, h, lag(h) OVER w AS p, row_number() OVER w AS rn FROM (SELECT device, ts, event_id, CASE WHEN event_id % 10 > 0 THEN floor(event_id * 37 % 3600 / 900e0 + 0.5) END AS h FROM fixes) WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)) WHERE coalesce(h, -1) <> coalesce(p, -1) GROUP BY device"))
def _(spark, d):
    v = view(spark, d, "fixes")
    h = F.when(F.col("event_id") % 10 > 0, F.col("event_id") * 37 % 3600 / F.lit(900.0))
    # Times repeat in this feed, so the event number goes into the time.
    ts = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id")).alias("ts")
    return S.heading_changes(v.select("device", ts, h.alias("heading"))).groupBy("device").agg(F.count("*").alias("n"))


@query("latest_fix", X("SELECT device, ts, lng, lat FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts DESC, lng DESC, lat DESC) AS rn FROM fixes) WHERE rn = 1"))
def _(spark, d):
    return S.latest_fix(view(spark, d, "fixes"))


@query("fix_slope_alert", with_views(f'WITH {CELLS}, r AS (SELECT event_id, region_id, row_number() OVER (PARTITION BY event_id ORDER BY region_ord) AS rn FROM fixes JOIN map_regions ON lng BETWEEN w AND e AND lat BETWEEN s AND n) SELECT CAST(count(*) AS BIGINT) AS n, count(region_id) AS in_region, count(slope) AS on_cell FROM fixes f LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (event_id) LEFT JOIN (SELECT "row" + 1100 AS rr, col - 120 AS cc, slope FROM cells) c ON rr = floor(f.lat * 20) AND cc = floor(f.lng * 20)', "fixes", "map_regions", "dem_cells"))
def _(spark, d):
    grid = cells(spark, d).select((F.col("row") + 1100).alias("row"), (F.col("col") - 120).alias("col"), "slope", "octant")
    out = S.fix_slope_alert(view(spark, d, "fixes").select("device", "ts", "lng", "lat"), view(spark, d, "map_regions"), grid, 20.0)
    return out.agg(F.count("*").alias("n"), F.count("region_id").alias("in_region"), F.count("slope").alias("on_cell"))
