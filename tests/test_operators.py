"""Operators that SQL cannot express, and edge cases, against plain Python."""

import heapq
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import naming, numbers
from tarnspark.scratch import stored
from tarnspark.operators import aggregates, catalog, classify, lines, network, paths, prominence, raster, search, spatial, tiles
from tarnspark.operators.components import least_roots
from tarnspark.operators.ranks import positions
from tarnspark.sources.artifacts import artifact_audit
from tarnspark.sources.features import scan_features, tile_union
from tarnspark.sources.routes import scan_route_geojson, scan_route_xml, sink_route_geojson, sink_route_gpx
from tarnspark.streaming import devices


def test_round_exact(spark):
    rng = random.Random(1)
    values = [2.675, 2.665, 0.125, 0.375, -0.125, -2.675, 1e-9, 0.0, 8848.85, 0.05, 0.15, 0.25] + [rng.uniform(-9000, 9000) for _ in range(300)] + [rng.randint(-9000, 9000) / 20 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for places in (0, 1, 2, 4, 7):
        got = [r[0] for r in df.select(numbers.round_exact(F.col("v"), places)).collect()]
        assert got == [round(v, places) + 0.0 for v in values] + [None]


GRADES = {
    "T1": 1, "t6+": 6, "T 3": 3, "4": 4, "hiking": 1, "demanding_mountain_hiking": 3, "T3-T4": 4, "T2/T6": 6, "mountain_hiking/T3": 3, "demanding_alpine_hiking!": 5,
    "t2 to t4": None,  # blanks become underscores first, and those join words
    "T2\tor\tT5": 5, "[t4]": 4, "T8": None, "unmarked": None, "": None, "difficult alpine hiking": 6, "T4–T5": 5, "tor": None,
}


def test_parse_grade(spark):
    df = spark.createDataFrame([(k,) for k in GRADES], "g string")
    assert {r[0]: r[1] for r in df.select("g", numbers.parse_grade(F.col("g"))).collect()} == GRADES


def test_parse_numbers(spark):
    eles = {"~415": 415.0, "2207m": 2207.0, "2,108": 2108.0, "377.8m": 377.8, "none": None, "15000": None, "-0": 0.0, "٣٤٠": 340.0}
    pops = {"54,321": 54321, "7 300": 7300, "+7": 7, "1.5": None, "-3": None, "many": None, "99999999999999999999": None, "": None}
    got = spark.createDataFrame([(k,) for k in eles], "t string").select("t", numbers.parse_elevation(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == eles
    got = spark.createDataFrame([(k,) for k in pops], "t string").select("t", numbers.parse_population(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == pops
    js = spark.createDataFrame([("4",), ('"4"',), ("true",), ("4.5",), ("null",)], "j string").select(numbers.parse_number_strict(F.parse_json("j"))).collect()
    assert [r[0] for r in js] == [4.0, None, None, 4.5, None]


def test_shared_subset_refuses(spark):
    with pytest.raises(ValueError):
        classify.shared_subset(spark.createDataFrame([], "osm_type string, tag_ford string"), ["n/ford"], {"x": ["w/ford"]})


def test_first_by_key_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "o int, k string")
    assert sorted(r["o"] for r in aggregates.first_by_key(df, ["k"], "o").collect()) == [1, 3, 4]


def test_source_pin_without_snapshot_raises(spark):
    none = spark.createDataFrame([], "source string, date date, name string")
    with pytest.raises(Exception, match="no snapshot"):
        catalog.source_pin(spark.createDataFrame([("a",)], "source string"), none, none.select("source", "name"), "2024-01-01").collect()


def test_region_boxes_over_the_antimeridian(spark):
    parts = spark.createDataFrame([("x", 1, 178.0, 0.0, 180.0, 1.0), ("x", 2, -180.0, 0.0, -178.0, 1.0), ("y", 1, 0.0, 0.0, 1.0, 1.0), ("y", 2, 20.0, 0.0, 21.0, 1.0)], "id string, ord int, w double, s double, e double, n double")
    got = {(r["id"], r["w"], r["e"]) for r in catalog.region_boxes(parts).collect()}
    assert got == {("x", 178.0, 180.0), ("x", -180.0, -178.0), ("y", 0.0, 1.0), ("y", 20.0, 21.0)}


def test_line_clip_splits_on_return(spark):
    v = spark.createDataFrame([(1, 1, -6.0, 56.0), (1, 2, -5.0, 56.2), (1, 3, -3.0, 56.2), (1, 4, -4.5, 56.3)], "way_id long, seq long, lng double, lat double")
    got = [(r["piece"], r["pos"], r["lng"]) for r in lines.line_clip(v, "way_id", -5.5, 55.5, -4.0, 57.0).orderBy("piece", "pos").collect()]
    assert got == [(0, 0, -5.5), (0, 1, -5.0), (0, 2, -4.0), (1, 0, -4.0), (1, 1, -4.5)]


def test_network(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.002, 0.0), (4, 0.0021, 0.0), (5, 0.003, 0.0), (6, 0.001, 0.001)], "node_id long, lng double, lat double")
    edges = spark.createDataFrame([(1, 2, 100.0, "path"), (2, 3, 100.0, "major_road"), (2, 6, 60.0, "path"), (3, 6, 60.0, "path"), (4, 5, 90.0, "path")], "a long, b long, length_m double, kind string")
    assert {(r["node_id"], r["component"]) for r in network.connected_components(nodes, edges).collect()} == {(1, 1), (2, 1), (3, 1), (6, 1), (4, 4), (5, 4)}
    joined = network.gap_bridge(nodes, edges, 20.0)
    assert [(r["a"], r["b"]) for r in joined.where("kind = 'gap'").collect()] == [(3, 4)]
    legs = spark.createDataFrame([(1, 0.0, 0.0, 0.003, 0.0), (2, 0.0, 0.0, 9.0, 9.0)], "leg_id long, from_lng double, from_lat double, to_lng double, to_lat double")
    got = {r["leg_id"]: r["way"] for r in paths.least_cost_path(legs, nodes, joined, 5.0, 1).collect()}
    assert got == {1: [1, 2, 6, 3, 4, 5], 2: None}


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    from tarnspark.operators import components

    rounds = []
    kept = components.stored
    monkeypatch.setattr(components, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(components, "stored", lambda *a, **k: rounds.append(1) or kept(*a, **k))
    ids = [0, *range(10_000, 0, -1)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    roots = least_roots(edges, "a", "b")
    assert roots.count() == 10_000 and {r["root"] for r in roots.select("root").distinct().collect()} == {0} and len(rounds) <= 25  # all writes: two rounds and their jumps


def test_components_of_names_and_pointers_that_lead_back(spark, monkeypatch):
    from tarnspark.operators import components

    edges = spark.createDataFrame([("b", "c"), ("c", "ä"), ("z", "z"), ("x", None), ("y", "b")], "a string, b string")
    for rows in (1_000_000, 0):
        monkeypatch.setattr(components, "ONE_TASK_ROWS", rows)
        assert {r["node"]: r["root"] for r in least_roots(edges, "a", "b").collect()} == {"c": "b", "ä": "b", "y": "b"}
        for loop in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (7, 8)], [(5, 5)]):
            with pytest.raises(Exception, match="lead back"):
                components.tree_roots(spark.createDataFrame(loop, "node long, parent long")).count()


def test_region_trees_of_any_depth(spark, monkeypatch):
    from tarnspark.operators import components

    chain = [(n, n - 1 if n else None, 100 if n < 9_990 else 1) for n in range(10_000)]
    deep = spark.createDataFrame(chain + [(20_000, 19_999, 5), (30_000, None, 500)], "id long, parent long, bytes long")
    for rows in (1_000_000, 0):
        monkeypatch.setattr(components, "ONE_TASK_ROWS", rows)
        roots = {r["id"]: r["root"] for r in catalog.top_level(deep).collect()}
        assert roots == {n: 0 for n in range(10_000)} | {20_000: 20_000, 30_000: 30_000}
        assert sorted(r["id"] for r in catalog.admin_walk(deep, 60).collect()) == [9_990, 30_000]
        with pytest.raises(Exception, match="lead back"):
            catalog.top_level(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long")).count()


def test_admin_walk_equals_the_walk(spark):
    rng = random.Random(6)
    rows = [(n, rng.choice([None, *range(max(0, n - 6), n)]) if n else None, rng.choice([1, 100, None])) for n in range(300)]
    kids = {}
    for n, up, _ in rows:
        kids.setdefault(up, []).append(n)
    size, want = {n: b for n, _, b in rows}, [n for n in kids[None] if n not in kids]
    level = [k for n in kids[None] for k in kids.get(n, ())]
    while level:
        over = [n for n in level if (size[n] or 0) > 60 and n in kids]
        want += sorted(set(level) - set(over))
        level = [k for n in over for k in kids[n]]
    got = catalog.admin_walk(spark.createDataFrame(rows, "id long, parent long, bytes long"), 60)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def merged_in_order(vertices, tol):
    """Vertices one by one: the first node in reach, by cell and age, else a node of one's own."""
    cells, found = {}, {}
    for n, x, y in sorted(vertices):
        cx, cy = x // tol, y // tol
        near = [p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in cells.get((cx + dx, cy + dy), ()) if math.hypot(p[1] - x, p[2] - y) <= tol]
        found[n] = near[0][0] if near else n
        if not near:
            cells.setdefault((cx, cy), []).append((n, x, y))
    return found


@pytest.mark.parametrize("side", [5, 16, 1024])
def test_node_merge_equals_the_order_of_input(spark, side):
    rng = random.Random(side)
    line = [(k, 2 * k, 0) for k in range(60)]  # each in reach of the one before
    shuffled = [(100 + n, x, 40) for n, x in enumerate(rng.sample(range(120), 90))]
    cloud = [(1000 + n, rng.randrange(40), 60 + rng.randrange(30)) for n in range(700)]
    rows = line + shuffled + cloud + [(5000 + n, x - 7, y + 300) for n, x, y in cloud[:50]]
    df = spark.createDataFrame([(n, x, y, "v") for n, x, y in rows], "src_ord long, gx long, gy long, name string").repartition(3)
    got = {r["src_ord"]: r["node_id"] for r in network.node_merge(df, side=side).collect()}
    assert got == merged_in_order(rows, 2) and [got[k] for k in range(5)] == [0, 0, 2, 2, 4]


def one_by_one(nodes, edges, max_m, k):
    """Dead ends in order, each to the first of its nearest nodes that is still apart."""
    part, links = {n: n for n in nodes}, {n: 0 for n in nodes}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b in edges:
        part[root(a)] = root(b)
        links[a] += 1
        links[b] += 1
    away = lambda a, b: 6371008.8 * math.hypot(math.radians(nodes[a][0] - nodes[b][0]), math.radians(nodes[a][1] - nodes[b][1]))
    found = []
    for end in sorted(n for n in nodes if links[n] == 1):
        near = sorted((away(end, n), n) for n in nodes if away(end, n) <= max_m)[:k]
        to = next((n for _, n in near if root(n) != root(end)), None)
        if links[end] == 1 and to is not None:
            part[root(end)] = root(to)
            links[end] += 1
            links[to] += 1
            found.append((min(end, to), max(end, to)))
    return sorted(found)


def test_gap_bridge_takes_a_thousand_stubs_at_once(spark):
    nodes, edges = {}, []
    for k in range(1000):  # a line along the equator, and a stub of two nodes ten metres beside each vertex
        nodes[k] = (k * 1e-3, 0.0)
        nodes[5000 + 2 * k], nodes[5001 + 2 * k] = (k * 1e-3, 9e-5), (k * 1e-3, 9e-4)
        edges += [(5000 + 2 * k, 5001 + 2 * k)] + ([(k - 1, k)] if k else [])
    for k in range(4):  # dashes in a row, each a gap from the next
        nodes[9000 + 2 * k], nodes[9001 + 2 * k] = (k * 1e-3, 1.0), (k * 1e-3 + 9e-4, 1.0)
        edges.append((9000 + 2 * k, 9001 + 2 * k))
    n = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node_id long, lng double, lat double")
    e = spark.createDataFrame([(a, b, 1.0, "path") for a, b in edges], "a long, b long, length_m double, kind string")
    got = sorted((r["a"], r["b"]) for r in network.gap_bridge(n, e).where("kind = 'gap'").collect())
    assert got == one_by_one(nodes, edges, 20.0, 6) and len(got) == 1003


@pytest.mark.parametrize("settle", [500_000, 40, 0])
def test_gap_bridge_equals_the_sequential_way(spark, monkeypatch, settle):
    monkeypatch.setattr(network, "SETTLE_ROWS", settle)
    for seed, spread in ((12, 60), (13, 25), (14, 90)) if settle else ((12, 40),):
        rng = random.Random(seed)
        nodes = {n: (rng.random() * spread * 1e-4, rng.random() * spread * 1e-4) for n in range(120)}
        edges = [(n, n + 1) for n in range(0, 120, 2)] + [(n, n + 2) for n in range(0, 40, 8)]
        n = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node_id long, lng double, lat double")
        e = spark.createDataFrame([(a, b, 1.0, "path") for a, b in edges], "a long, b long, length_m double, kind string")
        got = sorted((r["a"], r["b"]) for r in network.gap_bridge(n, e, 40.0).where("kind = 'gap'").collect())
        assert got == one_by_one(nodes, edges, 40.0, 6)


def cheapest(nodes, edges, start, goal):
    """Dijkstra over (a, b, metres, weight) with the cost of the snaps at both ends."""
    best, heap = {}, [(d, n, 0.0, (n,)) for n, d in start.items()]
    heapq.heapify(heap)
    ends = []
    while heap:
        cost, n, metres, way = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = cost
        if n in goal:
            ends.append((cost + goal[n], metres, way))
        for a, b, m, w in edges.get(n, ()):
            heapq.heappush(heap, (cost + w, b, metres + m, (*way, b)))
    return min(ends, default=None)


@pytest.mark.parametrize("square_nodes", [100_000, 0])
def test_least_cost_paths_equal_dijkstra(spark, square_nodes):
    rng = random.Random(21)
    nodes = {n: (rng.random() * 0.2, rng.random() * 0.2) for n in range(250)}
    metres = lambda a, b: 6371008.8 * 2 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2))
    rows, out_of = [], {}
    for a in nodes:
        for b in sorted(nodes, key=lambda b: math.dist(nodes[a], nodes[b]))[1:4]:
            kind = rng.choice(["path", "steps", "medium_road", "other"])
            if a < b and a % 17:
                m = metres(nodes[a], nodes[b])
                rows.append((a, b, m, kind))
                w = m * network.WALKING_COST.get(kind, 1.5)
                out_of.setdefault(a, []).append((a, b, m, w))
                out_of.setdefault(b, []).append((b, a, m, w))
    places = [(rng.random() * 0.2, rng.random() * 0.2) for _ in range(24)] + [(50.0, 50.0), (0.1, 0.1)]
    legs = [(i, *places[i], *places[i + 1]) for i in range(len(places) - 1)]
    got = paths.least_cost_path(
        spark.createDataFrame(legs, "leg_id long, from_lng double, from_lat double, to_lng double, to_lat double"),
        spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node_id long, lng double, lat double"),
        spark.createDataFrame(rows, "a long, b long, length_m double, kind string"), 2500.0, 3, pad_share=100.0, square_nodes=square_nodes,
    ).collect()
    seen = set()
    for r in got:
        _, *ends = legs[r["leg_id"]]
        snap = lambda p: dict(sorted(((n, metres(p, nodes[n])) for n in nodes if metres(p, nodes[n]) <= 2500), key=lambda x: x[1])[:3])
        start, goal = snap(ends[:2]), snap(ends[2:])
        want = cheapest(nodes, out_of, start, goal) if start and goal else None
        if want is None:
            assert (r["cost"], r["way"], r["reason"]) == (None, None, "no_path" if start and goal else "no_snap")
        else:
            assert (r["cost"], r["length"]) == (pytest.approx(want[0]), pytest.approx(want[1])) and r["way"] == list(want[2]) and r["reason"] is None
        seen.add(r["reason"])
    assert seen == {None, "no_path", "no_snap"} and len(got) == len(legs)


@pytest.mark.parametrize("square_nodes", [100_000, 0])
def test_a_leg_of_two_thousand_hops(spark, square_nodes):
    nodes = [(k, k * 2e-4, 0.0) for k in range(2001)]
    legs = [(1, 0.0, 0.0, 0.4, 0.0), (2, 0.4, 0.0, 0.399, 0.0)]
    got = {r["leg_id"]: r["way"] for r in paths.least_cost_path(
        spark.createDataFrame(legs, "leg_id long, from_lng double, from_lat double, to_lng double, to_lat double"),
        spark.createDataFrame(nodes, "node_id long, lng double, lat double"),
        spark.createDataFrame([(k, k + 1, 22.24, "path") for k in range(2000)], "a long, b long, length_m double, kind string"), 1.0, 1, square_nodes=square_nodes,
    ).collect()}
    assert got == {1: list(range(2001)), 2: list(range(2000, 1994, -1))}


def naive_prominence(peaks, z, step, floor):
    out, low, high = {}, min(z.values()), max(z.values())
    better = lambda p, q: (peaks[q][2], -q) > (peaks[p][2], -p)
    for p, (r, c, ele) in peaks.items():
        out[p] = round(ele - low, 1)
        for t in prominence.threshold_grid(low, high, step, floor):
            if z[r, c] < t:
                continue
            seen, todo = {(r, c)}, [(r, c)]
            while todo:
                a, b = todo.pop()
                for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if n not in seen and z.get(n, -1e9) >= t:
                        seen.add(n)
                        todo.append(n)
            if any(q != p and better(p, q) and peaks[q][:2] in seen for q in peaks):
                out[p] = round(max(0.0, ele - t), 1)
                break
    return out


def test_prominence_of_a_long_ridge_and_of_random_terrain(spark):
    z = {(r, c): 40 if c in (0, 20) or r == 79 else 0 for r in range(80) for c in range(21)}  # a U
    z[0, 0], z[0, 20] = 100, 90
    peaks = {1: (0, 0, 100.0), 2: (0, 20, 90.0)}
    rng = random.Random(5)
    rough = {(r, c): rng.randrange(0, 60) for r in range(12) for c in range(13) if rng.random() < 0.9}
    spots = rng.choices(sorted(rough), k=14)
    many = {i: (*p, float(rough[p])) for i, p in enumerate(spots)}
    for heights, tops, step, floor in ((z, peaks, 20.0, 0.0), (rough, many, 7.0, 20.0)):
        dem = spark.createDataFrame([(r, c, v) for (r, c), v in heights.items()], "row int, col int, z int")
        snapped = spark.createDataFrame([(i, r, c, e) for i, (r, c, e) in tops.items()], "peak_id long, row int, col int, ele double")
        for block in (4, 256):
            assert {r["peak_id"]: r["prom"] for r in prominence.prominence(snapped, dem, step, floor, block).collect()} == naive_prominence(tops, heights, step, floor)


def test_prominence_of_a_thousand_peaks_that_wait_for_each_other(spark, monkeypatch):
    written = []
    monkeypatch.setattr(prominence, "stored", lambda df, name, **more: written.append(name) or stored(df, name, **more))
    z = [5000 - c if c % 2 == 0 else 1000 + c for c in range(2001)]  # falling peaks, rising saddles
    dem = spark.createDataFrame([(0, c, v) for c, v in enumerate(z)], "row int, col int, z int")
    snapped = spark.createDataFrame([(c, 0, c, float(z[c])) for c in range(0, 2001, 2)], "peak_id long, row int, col int, ele double")
    got = {r["peak_id"]: r["prom"] for r in prominence.prominence(snapped, dem, 1.0, 0.0, 64).collect()}
    assert got == {c: (5000.0 - 1001 if c == 0 else float(z[c] - z[c - 1])) for c in range(0, 2001, 2)}
    assert written.count("blocks") == 4  # 64, 256, 1024, 4096 columns


def test_tile_untie_moves_ties_only(spark):
    lng = (1 << 31) / (1 << 32) * 360 - 180 - 360 / (1 << 13)
    df = spark.createDataFrame([(1, lng, 10.0), (2, 3.3, 10.0)], "k int, lng double, lat double")
    got = {r["k"]: r["lng"] for r in tiles.tile_untie(df).collect()}
    assert got[2] == 3.3 and abs(got[1] - lng) < 2e-6


def test_follow_and_rate(spark):
    fixes = spark.createDataFrame([("a", 1, t, 0.0005 * t, lat) for t, lat in enumerate([0.0, 0.0006, 0.0004, 0.0002, 0.0])], "device string, route_id long, ts long, lng double, lat double")
    routes = spark.createDataFrame([(1, [(0.0, 0.0), (0.01, 0.0)])], "route_id long, coords array<struct<lng double, lat double>>")
    got = [r["is_off"] for r in devices.follow_route(fixes, routes).orderBy("ts").collect()]
    assert got == [False, True, True, False, False]
    rows = [("k", 1_000_000_000 * t, b, 100) for t, b in enumerate([0, 10, 20, 20, 40, 70])]
    df = spark.createDataFrame(rows, "key string, ts long, bytes long, total long").withColumn("ts", F.timestamp_seconds(F.col("ts") / 1_000_000_000))
    got = [r["rate"] for r in devices.transfer_rate(df).orderBy("ts").collect()]
    assert got[:4] == [None] * 4 and got[4] == pytest.approx(0.3 * 20 + 0.7 * 10) and got[5] == pytest.approx(0.3 * 30 + 0.7 * 13)


def test_heading_stream(spark, tmp_path):
    rows = [("a", 1, 10.2), ("a", 2, 10.4), ("a", 3, 11.0), ("b", 1, None), ("b", 2, 5.0)]
    spark.createDataFrame(rows, "device string, ts long, heading double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device string, ts long, heading double").parquet(str(tmp_path / "in"))
    q = devices.heading_changes(stream).writeStream.format("memory").queryName("headings").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["device"], r["ts"]) for r in spark.table("headings").collect()} == {("a", 1), ("a", 3), ("b", 2)}


def test_scan_features_refuses_malformed_lines(spark, tmp_path):
    (tmp_path / "f.geojsonl").write_text('\x1e{"type":"Feature","properties":{"ele":4},"geometry":{"type":"Point","coordinates":[1,2]}}\n\n  \n')
    good = scan_features(spark, f"file://{tmp_path}/f.geojsonl").collect()
    assert len(good) == 1 and good[0]["geom_type"] == "Point"
    (tmp_path / "g.geojsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="malformed feature"):
        scan_features(spark, f"file://{tmp_path}/g.geojsonl").collect()


@pytest.mark.parametrize("split", ["128m", "700"])
def test_scan_features_keeps_the_order_of_files_and_lines(spark, tmp_path, split):
    line = lambda n: f'{{"type":"Feature","properties":{{"n":{n}}},"geometry":null}}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a b.geojsonl").write_text("".join(map(line, range(5))))
    (tmp_path / "in/b.geojsonl").write_text("\n" + "".join(map(line, range(5, 400))))
    (tmp_path / "in/c.geojsonl").write_text("")
    (tmp_path / "z.geojsonl").write_text("".join(map(line, range(900, 903))))
    bad = tmp_path / "bad.geojsonl"
    bad.write_text("".join(map(line, range(50))) + "\n[1]\n" + line(3))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        n = F.try_variant_get("props", "$.n", "int").alias("n")
        got = scan_features(spark, [f"file://{tmp_path}/z.geojsonl", f"file://{tmp_path}/in"]).orderBy("source_ord", "block", "line").select(n, "line").collect()
        assert [r["n"] for r in got] == [900, 901, 902, *range(400)]
        assert [r["line"] for r in got] == [1, 2, 3, *range(1, 6), *range(2, 397)]
        with pytest.raises(Exception, match=r"bad.geojsonl, line 52: \[1\]"):
            scan_features(spark, f"file://{bad}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_route_readers(spark):
    gpx = '<g:gpx xmlns:g="x"><g:metadata><g:name>M</g:name></g:metadata><g:rte><g:rtept lat="1" lon="2"/><g:rtept lat="" lon="3"/><g:rtept lat="95" lon="3"/></g:rte><g:wpt lat="5" lon="6"/></g:gpx>'
    row = scan_route_xml(spark.createDataFrame([("f", gpx)], "file string, text string")).first()
    assert (row["name"], [(p["lng"], p["lat"]) for p in row["coords"]], len(row["waypoints"])) == ("M", [(2.0, 1.0)], 1)
    geo = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":{"name":"N"},"geometry":{"type":"MultiLineString","coordinates":[[[1,2,3]],[[4,5]]]}}]}'
    row = scan_route_geojson(spark.createDataFrame([("f", geo)], "file string, text string")).first()
    assert (row["name"], [(p["lng"], p["ele"]) for p in row["coords"]], len(row["waypoints"])) == ("N", [(1.0, 3.0), (4.0, None)], 1)


def test_artifact_audit(spark, tmp_path):
    header = bytearray(127)
    header[:8] = b"PMTiles\x03"
    for at in (8, 24, 40, 56):
        header[at : at + 16] = struct.pack("<QQ", 127, 10)
    header[100], header[101] = 3, 12
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "far-n40-basemap.pmtiles").write_bytes(bytes(header) + b"x" * 10)
    row = artifact_audit(spark, f"file://{tmp_path}/a").first()
    assert (row["kind"], row["region_id"], row["bytes"], row["minzoom"], row["maxzoom"]) == ("basemap", "far-n40", 137, 3, 12)
    (tmp_path / "a" / "b-paths.pmtiles").write_bytes(bytes(header))
    with pytest.raises(Exception, match="runs past the end"):
        artifact_audit(spark, f"file://{tmp_path}/a").collect()


def test_positions_rank_all_rows_in_many_tasks(spark, monkeypatch):
    from tarnspark.operators import ranks

    monkeypatch.setattr(ranks, "RANGE_ROWS", 500)
    rng = random.Random(9)
    rows = [(n, rng.choice([None, 0.5, 0.5, 0.5, rng.random()])) for n in range(6000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    got = [r["id"] for r in positions(df, [F.col("v"), F.col("id")]).orderBy("pos").collect()]
    assert got == [n for n, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))]
    ranked = positions(df, [F.col("v"), F.col("id")])
    assert ranked.select("pos").distinct().count() == 6000 and "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    for few in (0, 1, 21):
        assert sorted(r["pos"] for r in positions(df.where(F.col("id") < few), [F.col("id")]).collect()) == list(range(1, few + 1))


def test_reports_rank_in_many_tasks(spark):
    scores = spark.createDataFrame([(n, float(n * 37 % 90)) for n in range(3000)], "peak_id long, prom double")
    regions = spark.createDataFrame([(f"r{n}", n * 37 % 90) for n in range(3000)], "region_id string, bytes long")
    out = prominence.prominence_report(scores), catalog.catalog_report(regions)
    for df in out:
        ranks = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number" in line]
        assert ranks and all("windowspecdefinition(__range" in line for line in ranks)
    want = sorted((float(n * 37 % 90) for n in range(3000)), reverse=True)
    assert tuple(out[0].select("n", "max", "median", "p90").first()) == (3000, 89.0, want[1500], want[300])
    assert {r["metric"]: r["value"] for r in out[1].collect()}["median"] == want[::-1][1500]


def test_common_words_are_asked_for_in_rings(spark, monkeypatch):
    rng = random.Random(3)
    places = [(n, rng.choice(["Peak", "Peak of Ash", "Ashes"]) + rng.choice(["", " North"]), "peak", rng.uniform(40, 60), rng.uniform(-5, 5), n % 4) for n in range(300)]
    places += [(900, "Peak far", "peak", -70.0, 170.0, 1)]
    asks = [(1, "peak", 0.0, 50.0), (2, "peak ash", 1.0, 45.0), (3, "north pe", -2.0, 55.0), (4, "ashes", 0.0, 50.0), (5, "none", 0.0, 0.0), (6, "", 0.0, 0.0), (7, "peak far", 0.0, 50.0), (8, "p", 179.0, -75.0)]
    monkeypatch.setattr(search, "COMMON", 5)
    q = spark.createDataFrame(asks, "query_id long, text string, lon double, lat double")
    p = spark.createDataFrame(places, "place_id long, name string, kind string, lat double, lon double, rank long")
    got = sorted((r["query_id"], r["pos"], r["place_id"]) for r in search.place_search(q, p, 7).collect())
    want = []
    for qid, text, lon, lat in asks:
        words = text.lower().split()
        d2 = lambda r: ((r[4] - lon) * math.cos(math.radians(lat))) ** 2 + (r[3] - lat) ** 2
        hits = [r for r in places if words and set(words[:-1]) <= set(r[1].lower().split()) and any(w.startswith(words[-1]) for w in r[1].lower().split())]
        want += [(qid, i + 1, r[0]) for i, r in enumerate(sorted(hits, key=lambda r: (d2(r), -r[5], r[0]))[:7])]
    assert got == sorted(want)


def phrase_search(places, asks, k):
    """Place search word by word, over all places."""
    import re

    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    found = []
    for qid, text, lon, lat in asks:
        parts = [p for p in map(cut, re.sub(r'["*()\-:^]', " ", text).split()) if p]
        held = lambda w, p, last: any(w[i : i + len(p) - 1] == p[:-1] and (w[i + len(p) - 1].startswith(p[-1]) if last else w[i + len(p) - 1] == p[-1]) for i in range(len(w) - len(p) + 1))
        hits = [r for r in places if parts and all(held(cut(r[1]), p, p is parts[-1]) for p in parts)]
        near = sorted(hits, key=lambda r: (((r[4] - lon) * math.cos(math.radians(lat))) ** 2 + (r[3] - lat) ** 2, -r[5], r[0]))
        found += [(qid, i + 1, r[0]) for i, r in enumerate(near[:k])]
    return sorted(found)


@pytest.mark.parametrize("common", [2_000, 3, 0])
def test_phrases_are_searched_by_cells(spark, monkeypatch, common):
    monkeypatch.setattr(search, "COMMON", common)
    rng = random.Random(8)
    names = ["St Fillan's Bridge", "Bridge Fillan s", "s bridge Fillan", "Fillans", "Ben Nevis", "Nevis Ben", "Ben-Nevis North Top", "Lochbridge-upon-Water", "a.b.c", "Ben"]
    places = [(n, rng.choice(names) + rng.choice(["", " Hut", " 2"]), "peak", rng.uniform(-60, 70), rng.uniform(-170, 170), n % 4) for n in range(400)]
    places += [(900 + n, "Ben far Rare", "peak", -89.0, 179.0, 1) for n in range(3)] + [(950, None, "peak", 1.0, 1.0, 1), (951, "", "peak", 1.0, 1.0, 1)]
    texts = ["fillan's", "bridge fillan's", "fillan's bridge", "ben nevis", "nevis ben", "Ben:Nevis nor", "ben far", "far ben", "lochbridge-up", "a.b", "b.c a.b.c", "'", "ben '", "", "b", "rare", "be ne", "ben hut"]
    asks = [(i, t, rng.uniform(-180, 180), rng.uniform(-80, 80)) for i, t in enumerate(texts)]
    q = spark.createDataFrame(asks, "query_id long, text string, lon double, lat double")
    p = spark.createDataFrame(places, "place_id long, name string, kind string, lat double, lon double, rank long")
    want = phrase_search([(*r[:1], r[1] or "", *r[2:]) for r in places], asks, 7)
    assert sorted((r["query_id"], r["pos"], r["place_id"]) for r in search.place_search(q, p, 7).collect()) == want
    assert {w[0] for w in want} >= {0, 1, 3, 5, 6, 7, 8, 9, 14, 15, 17} and not {w[0] for w in want} & {11, 13}


def test_boxes_of_all_sizes(spark):
    rng = random.Random(2)
    boxes = [(f"b{n}", x, y, x + w, y + h) for n in range(60) for x, y, w, h in [(rng.uniform(-9, 9), rng.uniform(-9, 9), 10 ** rng.uniform(-6, 1), 10 ** rng.uniform(-6, 1))]]
    boxes += [("world", -180.0, -90.0, 180.0, 90.0), ("point", 1.0, 1.0, 1.0, 1.0)]
    points = [(n, rng.uniform(-10, 10), rng.uniform(-10, 10)) for n in range(300)] + [(900, 1.0, 1.0), (901, None, 2.0), (902, 180.0, 90.0)] + [(1000 + n, b[1], b[2]) for n, b in enumerate(boxes)]
    p, b = spark.createDataFrame(points, "k long, lng double, lat double"), spark.createDataFrame(boxes, "region_id string, w double, s double, e double, n double")
    for pad in (0.0, 0.5):
        got = sorted((r["k"], r["region_id"]) for r in spatial.bbox_join(p, b, pad=pad).collect())
        assert got == sorted((k, i) for k, x, y in points if x is not None for i, w, s, e, n in boxes if w - pad <= x <= e + pad and s - pad <= y <= n + pad)


def test_a_missing_source_fails_the_union(spark):
    one = spark.range(2)
    expected = spark.createDataFrame([("a",), ("b",)], "source string")
    with pytest.raises(ValueError, match="no tiles of b"):
        tile_union({"a": one, "b": one.limit(0)}, expected)
    assert sorted((r["source"], r["id"]) for r in tile_union({"a": one, "b": one}, expected).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_routes_keep_waypoints_and_legs(spark, tmp_path):
    row = (1, "A & B", [(1.0, 2.0, 3.04), (1.5, 2.5, None)], [(5.0, 6.0, 7.06, "W <1>"), (8.0, 9.0, None, None)], [("straight", 0, 1)])
    df = spark.createDataFrame([row], "route_id int, name string, coords array<struct<lng double, lat double, ele double>>, waypoints array<struct<lng double, lat double, ele double, name string>>, spans array<struct<kind string, start bigint, end bigint>>")
    sink_route_gpx(df, str(tmp_path / "gpx"))
    text = spark.read.text(str(tmp_path / "gpx"), wholetext=True).select(F.lit("f").alias("file"), F.col("value").alias("text"))
    got = scan_route_xml(text).first()
    assert [(p["lng"], p["lat"], p["ele"]) for p in got["waypoints"]] == [(5.0, 6.0, 7.1), (8.0, 9.0, None)] and len(got["coords"]) == 2
    assert '<legs:leg kind="straight" start="0" end="1"/>' in text.first()["text"] and "W &lt;1&gt;" in text.first()["text"]
    sink_route_geojson(df, str(tmp_path / "json"))
    text = spark.read.text(str(tmp_path / "json"), wholetext=True).select(F.lit("f").alias("file"), F.col("value").alias("text"))
    got = scan_route_geojson(text).first()
    assert (got["name"], [p["lng"] for p in got["waypoints"]], got["coords"][0]["ele"]) == ("A & B", [5.0, 8.0], 3.0)
    assert '"legs":[{"kind":"straight","start":0,"end":1}]' in text.first()["text"] and "Waypoint 2" in text.first()["text"]


def test_fold_text_takes_marks_off(spark):
    texts = {"Štrbské Pleso": "strbske pleso", "Łódź": "łodz", "Ångström ": "angstrom", "e\u0301": "e", "İzmir": "izmir", "Ệ": "e", None: None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", naming.fold_text(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in got} == texts


def test_catalogue_report_tells_cells_and_degraded_regions(spark):
    rows = [("a", 10, "x", True, None), ("b", 30, "x", True, 11), ("c", 20, "y", True, None), ("d", 5, "y", False, 9)]
    out = catalog.catalog_report(spark.createDataFrame(rows, "region_id string, bytes long, source string, cell boolean, max_zoom int"))
    got = {(r["metric"], r["key"]): r["value"] for r in out.collect()}
    assert got["cells", "x"] == 2 and got["cell_bytes", "x"] == 40 and got["cells", "y"] == 1 and got["degraded", ""] == 2 and got["degraded_zoom", "b"] == 11


@pytest.fixture(params=["HDFSBackedStateStoreProvider", "RocksDBStateStoreProvider"])
def store(spark, request):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, f"org.apache.spark.sql.execution.streaming.state.{request.param}")
    yield request.param
    spark.conf.set(name, before)


def test_state_expires_behind_the_watermark(spark, tmp_path, monkeypatch, store):
    monkeypatch.setattr(devices, "TTL_MS", 1000)
    schema = "device string, ts timestamp, heading double"
    for n, (t, device, heading) in enumerate([(0, "a", 5.0), (1, "a", 5.2), (500, "b", 1.0), (1000, "b", 1.2), (1001, "a", 5.1)]):
        one = spark.createDataFrame([(device, t, heading)], "device string, t long, heading double")
        one.select("device", F.timestamp_seconds("t").alias("ts"), "heading").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    assert "spark.watermarkDelayMs" in feed.schema["ts"].metadata
    q = devices.heading_changes(feed).writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    told = sorted((r["device"], r["ts"].timestamp()) for r in spark.table("expiring").collect())
    assert [d for d, _ in told] == ["a", "a", "b"]  # the second "a" tells its old heading again, for its state was gone


def test_rates_are_the_same_on_a_stream(spark, tmp_path, store):
    rows = [(k, n, n * n * 40, 90_000) for k in ("a", "b") for n in range(20)]
    for part in range(4):  # a file a batch, in the order of time
        some = spark.createDataFrame([r for r in rows if r[1] // 5 == part], "key string, s long, bytes long, total long").select("key", F.timestamp_seconds("s").alias("ts"), "bytes", "total")
        some.coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    schema = "key string, ts timestamp, bytes long, total long"
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = devices.transfer_rate(feed).writeStream.format("memory").queryName(f"rates_{store}").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    table = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    key = lambda df: sorted((r["key"], r["ts"], r["rate"] and round(r["rate"], 6), r["eta"] and round(r["eta"], 6)) for r in df.collect())
    assert key(spark.table(f"rates_{store}")) == key(devices.transfer_rate(table)) and len(key(spark.table(f"rates_{store}"))) == 40


def test_follow_route_is_the_same_on_a_stream(spark, tmp_path, store):
    rng = random.Random(7)
    rows = [(d, 1, t, 0.0005 * t, rng.uniform(0, 0.001)) for d in ("a", "b") for t in range(15)]
    schema = "device string, route_id long, ts long, lng double, lat double"
    routes = spark.createDataFrame([(1, [(0.0, 0.0), (0.01, 0.0)])], "route_id long, coords array<struct<lng double, lat double>>")
    table = spark.createDataFrame(rows, schema)
    table.write.parquet(str(tmp_path / "in"))
    q = devices.follow_route(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), routes).writeStream.format("memory").queryName("follows").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["device"], r["ts"], r["is_off"], r["remaining_m"], r["fraction"]) for r in df.collect())
    assert key(spark.table("follows")) == key(devices.follow_route(table, routes)) and {r["is_off"] for r in spark.table("follows").collect()} == {True, False}


def matched_in_order(source, tiled, zoom, reach=4):
    """Sources one by one, each with the nearest tile of its name that is left; the sources without one."""
    world = 4096 << zoom
    place = lambda lng, lat: (math.floor((lng + 180) / 360 * world + 0.5) % world, math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * world + 0.5))
    left, lost = {k: (n, *place(x, y)) for k, n, x, y in tiled}, []
    for k, n, x, y in sorted(source, key=lambda r: r[0]):
        gx, gy = place(x, y)
        away = lambda t: max(min(abs(gx - t[1]), world - abs(gx - t[1])), abs(gy - t[2]))
        near = min(((away(t), i) for i, t in left.items() if t[0] == n and away(t) <= reach), default=None)
        if near is None:
            lost.append(k)
        else:
            left.pop(near[1])
    return sorted(lost)


@pytest.mark.parametrize("pairs", [200_000, 30])
def test_tile_matching_by_clusters_equals_the_order_of_sources(spark, monkeypatch, pairs):
    monkeypatch.setattr(tiles, "TASK_PAIRS", pairs)
    rng, pixel = random.Random(4), 360 / (4096 << 14)
    spot = lambda: (10 + rng.uniform(0, 60) * pixel, 50 + rng.uniform(0, 40) * pixel * 0.6)
    source = [(n, rng.choice(["a", "b", None]), *spot()) for n in range(150)]
    tiled = [(n, rng.choice(["a", "b", None]), *spot()) for n in range(130)] + [(500, "edge", 180 - pixel / 2, 1.0)]
    source.append((900, "edge", -180 + pixel / 2, 1.0))
    s, t = (spark.createDataFrame(rows, f"{k} long, name string, lng double, lat double") for rows, k in ((source, "src_ord"), (tiled, "tile_id")))
    got = sorted(r["src_ord"] for r in tiles.tile_coverage_match(s, t, 14).collect())
    assert got == matched_in_order(source, tiled, 14) and 20 < len(got) < 120 and 900 not in got


def test_a_thousand_sources_that_push_each_other_on(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tiles, "stored", lambda df, name, **more: written.append(name) or stored(df, name, **more))
    pixel = 360 / (4096 << 14)
    # Each source is nearest to the tile that the one before it takes.
    source = [(n, "x", 10 + (3 * n + 0.5) * pixel, 0.0) for n in range(1000)]
    tiled = [(n, "x", 10 + (3 * n - 0.5 + (1 if n == 0 else 0)) * pixel, 0.0) for n in range(1000)]
    s, t = (spark.createDataFrame(rows, f"{k} long, name string, lng double, lat double") for rows, k in ((source, "src_ord"), (tiled, "tile_id")))
    got = sorted(r["src_ord"] for r in tiles.tile_coverage_match(s, t, 14).collect())
    assert got == matched_in_order(source, tiled, 14) and len(written) <= 5


def test_name_and_kind_checks(spark):
    data = [(1, "Ben Nevis / Nevis", 1344.0, "peak", "Point"), (2, "Ben Nevis", 99.0, "peak", "Point"), (3, "Ben", 5.0, "peak", "Line"), (4, "Zla Kolata", None, "cave", "Point"), (5, None, 7.0, None, None)]
    df = spark.createDataFrame(data, "src_ord long, name string, value double, kind string, geom_type string")
    rules = spark.createDataFrame([("a", "Ben Nevis", 1345.0, 2.0), ("b", "Zla", 2535.0, 2.0), ("c", "Ben", 1.0, 2.0), ("d", "", 1344.0, 0.0)], "rule string, name string, expected double, tolerance double")
    first = lambda **more: {r["rule"]: (r["status"], r["value"]) for r in aggregates.name_checks(df, rules, **more).collect()}
    assert first() == {"a": ("ok", 1344.0), "b": ("skip", None), "c": ("fail", 1344.0), "d": ("ok", 1344.0)}
    assert first(prefix=False, pick="max") == {"a": ("fail", 99.0), "b": ("skip", None), "c": ("fail", 5.0), "d": ("skip", None)}
    kinds = spark.createDataFrame([("a", "peak", 3, None, None), ("b", "peak", 4, None, None), ("c", "peak", None, 3, "Point"), ("d", "munro", None, 282, None), ("e", None, 5, 5, None), ("f", "cave", 1, None, "Point"), ("g", "munro", 1, None, None)], "rule string, kind string, least int, exactly int, shape string")
    got = {r["rule"]: (r["status"], r["n"]) for r in aggregates.kind_checks(df, kinds).collect()}
    assert got == {"a": ("ok", 3), "b": ("fail", 3), "c": ("fail", 3), "d": ("skip", 0), "e": ("ok", 5), "f": ("ok", 1), "g": ("fail", 0)}


def test_byte_tiles_come_back_and_refuse_foreign_zooms(spark):
    rng = random.Random(3)
    cells = [("s", 9, r, c, rng.choice([None, 0, 30, 254]), rng.choice([None, 0, 7])) for r in range(20) for c in range(30) if rng.random() < 0.7]
    df = spark.createDataFrame(cells, "level string, z int, row int, col int, slope int, octant int")
    made = raster.raster_tile_bytes(df, 8)
    assert {(len(r["slope"]), len(r["octant"])) for r in made.collect()} == {(64, 64)}
    back = {tuple(r) for r in raster.raster_tile_cells(made, 8).collect()}
    assert back == {(z, r, c, s, o) for _, z, r, c, s, o in cells if s is not None or o is not None}
    total = raster.raster_tile_totals(made).first()
    assert (total["z"], total["cells"], total["bytes"]) == (9, len(cells), 128 * total["tiles"])
    with pytest.raises(Exception, match="level s tiles at zooms 9 and 10"):
        raster.raster_tile_bytes(df.unionByName(df.limit(1).withColumn("z", F.lit(10))), 8).collect()
    with pytest.raises(Exception, match="slope is no byte: 255"):
        raster.raster_tile_bytes(df.limit(1).withColumn("slope", F.lit(255)), 8).collect()
    assert raster.raster_tile_bytes(df.where("false"), 8).count() == 0


def test_grades_of_samples_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lines, "TILE_SAMPLES", 40)
    rng = random.Random(6)
    place = lambda: (rng.uniform(9.99, 10.01), rng.uniform(59.995, 60.005))
    ways = [(n, k, *place(), n % 6 + 1) for n in range(40) for k in range(3)] + [(90, 0, 9.0, 60.0, 5), (90, 1, 11.0, 60.0005, 5), (91, 0, 10.0, 60.0, None), (91, 1, 10.01, 60.0, None), (92, 0, 10.0, 59.0, 2), (92, 1, 10.0, 61.0, 2)]
    samples = [(n // 5, n % 5, *place()) for n in range(300)] + [(900, 0, 10.0, 60.0), (901, 0, -170.0, -80.0)]
    w = spark.createDataFrame(ways, "way_id long, seq long, lng double, lat double, grade int")
    s = spark.createDataFrame(samples, "track long, pos long, lng double, lat double")
    got = {(r["track"], r["pos"]): r["grade"] for r in lines.grade_match(s, "track", w, 25.0, 40.0).collect()}
    at, tracks, by_way = math.radians(1) * 6371008.8, {}, {}
    for t, p, *q in samples:
        tracks.setdefault(t, []).append(q)
    for n, _, x, y, g in ways:
        by_way.setdefault(n, []).append((x, y, g))
    want = {}
    for t, points in tracks.items():
        for p, (lng, lat) in enumerate(points):
            flat = lambda q, lng=lng, lat=lat: ((q[0] - lng) * math.cos(math.radians(lat)) * at, (q[1] - lat) * at)
            (bx, by), (fx, fy) = flat(points[max(p - 1, 0)]), flat(points[min(p + 1, len(points) - 1)])
            heading, met = (None if (bx, by) == (fx, fy) else math.atan2(fy - by, fx - bx)), []
            for n, line in by_way.items():
                for a, b in zip(line, line[1:]):
                    (ax, ay), (cx, cy) = flat(a), flat(b)
                    dx, dy = cx - ax, cy - ay
                    f = min(max(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0), 1)
                    turn = 0 if heading is None else abs(heading - math.atan2(dy, dx)) % math.pi
                    away = math.hypot(ax + dx * f, ay + dy * f)
                    if away <= 25 and min(turn, math.pi - turn) <= math.radians(40):
                        met.append((round(away, 6), -(a[2] or -1)))
            want[t, p] = (None if -min(met)[1] < 0 else -min(met)[1]) if met else None
    assert got == want and len({v for v in want.values()}) >= 5


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_transfer_rates_equal_the_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(devices, "CHUNK_ROWS", chunk)
    rng, rows, want = random.Random(5), [], {}
    for key in ("a", "b", None, "one"):
        at, had, rate, n = None, 0, None, 0
        now, so_far = 1_700_000_000_000_000, 0
        for _ in range(1 if key == "one" else 120):
            now += rng.choice([1, 50_000, 300_000, 2_000_000, 60_000_000])
            so_far += rng.choice([0, 10, 5000, -20])
            rows.append((key, now, so_far, 100_000))
            if at is not None and (now - at) / 1e6 >= 0.1 and so_far > had:
                s = (so_far - had) / ((now - at) / 1e6)
                rate, n = (s if rate is None else 0.3 * s + 0.7 * rate), n + 1
            at, had = now, so_far
            known = rate if n >= 3 else None
            want[key, now] = (known, (100_000 - so_far) / known if known and so_far < 100_000 else None)
    df = spark.createDataFrame(rows, "key string, us long, bytes long, total long").select("key", F.timestamp_micros("us").alias("ts"), "bytes", "total").repartition(3)
    out = devices.transfer_rate(df)
    got = {(r["key"], r["us"]): (r["rate"], r["eta"]) for r in out.withColumn("us", F.unix_micros("ts")).collect()}
    assert set(got) == set(want) and all(got[k] == (w if w[0] is None else (pytest.approx(w[0], rel=1e-12), w[1] and pytest.approx(w[1], rel=1e-9))) for k, w in want.items())
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_line_clip_tells_a_touch_by_its_share(spark):
    # Way 1 meets the corner with a share of one rounding step, as the arithmetic has it; way 2 ends on the border.
    v = spark.createDataFrame([(1, 1, -5.464, 55.49), (1, 2, -5.608, 55.53), (2, 1, -5.75, 56.0), (2, 2, -5.5, 56.0)], "way_id long, seq long, lng double, lat double")
    got = [(r["way_id"], r["pos"], r["moved"]) for r in lines.line_clip(v, "way_id", -5.5, 55.5, -4.0, 57.0).orderBy("way_id", "pos").collect()]
    assert got == [(1, 0, False), (1, 1, True)]


def test_nearest_on_path_tells_ties_as_a_root_of_squares_does(spark):
    ways = [[(-5.996, 55.044), (-5.944, 55.074), (-5.958, 55.0), (-5.944, 55.074), (-5.998, 55.042)], [(-5.944, 55.014), (-5.928, 55.036), (-5.982, 55.016), (-5.928, 55.036), (-5.942, 55.01)]]
    v = spark.createDataFrame([(k, n, *p) for k, way in enumerate(ways) for n, p in enumerate(way)], "way long, seq long, lng double, lat double")
    p = spark.createDataFrame([(1, 0, -5.952, 55.062), (2, 1, -5.997, 55.046)], "p long, way long, qlng double, qlat double")
    assert {r["p"]: (r["segment"], round(r["along_m"], 2)) for r in lines.nearest_on_path(v, "way", p, "p").collect()} == {1: (1, 6081.78), 2: (2, 7755.03)}


def test_nearest_leg_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lines, "ROUTE_POINTS", 20)
    monkeypatch.setattr(lines, "ROUTE_SEGMENTS", 90)
    rng = random.Random(31)
    spot = lambda: (-6 + rng.randrange(12) * 2e-3, 55 + rng.randrange(12) * 2e-3)
    ways = {(route, leg): [spot() for _ in range(rng.choice([1, 2, 3, 5]))] for route in (1, 2) for leg in range(60)}
    legs = spark.createDataFrame([(*k, n, *p) for k, way in ways.items() for n, p in enumerate(way)], "route long, leg long, seq long, lng double, lat double")
    points = [(k, k % 3 + 1, -6 + rng.random() * 0.05, 55 + rng.random() * 0.05) for k in range(150)]
    got = {r["p"]: r["leg"] for r in lines.nearest_leg(spark.createDataFrame(points, "p long, route long, qlng double, qlat double"), "p", legs).collect()}
    want = {}
    for p, route, x, y in points:
        met = []
        for (r, leg), way in ways.items():
            flat = [((a - x) * math.cos(math.radians(y)) * 6371008.8 * math.pi / 180, (b - y) * 6371008.8 * math.pi / 180) for a, b in way]
            for (ax, ay), (bx, by) in zip(flat, flat[1:] or flat):
                dx, dy = bx - ax, by - ay
                n = math.sqrt(dx * dx + dy * dy)
                t = min(max(-(ax * dx + ay * dy) / (n * n), 0), 1) if n else 0
                u, w = ax + dx * t, ay + dy * t
                met += [(math.sqrt(u * u + w * w), leg)] if r == route else []
        if met:
            want[p] = min(met)[1]
    assert got == want and len(got) == 100


def test_line_snap_among_crowds_equals_all_pairs(spark):
    rng = random.Random(17)
    spots = [(rng.random() * 0.004, 50 + rng.random() * 0.004) for _ in range(120)] + [(rng.random(), 50 + rng.random()) for _ in range(40)]
    nodes = [(k, *spots[k % len(spots)]) for k in range(400)] + [(k, 0.001, 50.001) for k in range(400, 500)]
    frame = spark.createDataFrame(nodes, "node_id long, lng double, lat double")
    got = {}
    for r in spatial.line_snap(frame.withColumnRenamed("node_id", "p"), "p", frame, 9000.0, 3).collect():
        got.setdefault(r["p"], {})[r["pos"]] = r["node_id"]
    metres = lambda a, b: 0.0 if a == b else 2 * 6371008.8 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2))
    for p, *at in nodes:
        near = sorted((m, n) for n, *to in nodes if (m := metres(at, to)) <= 9000)[:3]
        assert got[p] == {pos + 1: n for pos, (_, n) in enumerate(near)}


def test_line_snap_does_not_meet_a_crowd_in_pairs(spark):
    # 4,000 places in one cell: all pairs would be 16 million.
    crowd = spark.range(4000).selectExpr("id as node_id", "id % 64 * 1e-3 as lng", "50 + floor(id / 64) * 1e-3 as lat")
    met = spark.sparkContext.accumulator(0)
    sound = spatial._snap_within

    def counted(*args):
        out = sound(*args)
        met.add(args[0].count() * int(args[1].count() * (args[2] / 9000.0) ** 2))
        return out

    spatial._snap_within = counted
    try:
        assert spatial.line_snap(crowd.withColumnRenamed("node_id", "p"), "p", crowd, 9000.0, 4).where("pos = 1 and p = node_id").count() == 4000
    finally:
        spatial._snap_within = sound
    assert met.value < 1_000_000


def test_follow_route_on_tables_measures_segments_in_bulk(spark, monkeypatch):
    monkeypatch.setattr(devices, "VERTICES_AT_ONCE", 16)
    rng = random.Random(41)
    lines_ = [(k, [(rng.random() * 0.05, 50 + rng.random() * 0.05) for _ in range(k % 6)]) for k in range(12)]
    routes = spark.createDataFrame(lines_, "route_id long, coords array<struct<lng: double, lat: double>>")
    rows = [(k, k % 14, k, rng.random() * 0.05, 50 + rng.random() * 0.05) for k in range(200)] + [(200, 3, 200, None, 50.0)]
    fixes = spark.createDataFrame(rows, "device long, route_id long, ts long, lng double, lat double")
    out = devices.follow_route(fixes, routes)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["ts"]: r for r in out.collect()}
    want = fixes.join(routes, "route_id").withColumn("n", devices.nearest_expr(F.col("coords"), F.col("lng"), F.col("lat"))).where("n is not null").select("ts", "n.*", devices.length_expr(F.col("coords")).alias("total")).collect()
    assert len(got) == len(want) and got[200]["off_m"] is None
    for r in want:
        if r["distance_m"] is not None:
            assert got[r["ts"]]["off_m"] == pytest.approx(r["distance_m"], abs=1e-6) and got[r["ts"]]["along_m"] == pytest.approx(min(r["along_m"], r["total"]), abs=1e-5)


def test_peak_snap_sends_cells_to_tiles_and_not_to_peaks(spark, monkeypatch):
    monkeypatch.setattr(raster, "SNAP_TILE", 5)
    monkeypatch.setattr(raster, "SNAP_PEAKS", 3)
    rng = random.Random(43)
    dem = {(r, c): rng.randrange(9) for r in range(17) for c in range(13) if rng.random() < 0.8}
    peaks = [(k, rng.random() * 16 - 1, rng.random() * 21 - 1) for k in range(300)]
    out = raster.peak_snap(spark.createDataFrame(peaks, "peak long, px double, py double"), "peak", spark.createDataFrame([(*k, z) for k, z in dem.items()], "row int, col int, z int"))
    want = {}
    for k, x, y in peaks:
        near = [(-dem[p], *p) for dr in range(-2, 3) for dc in range(-2, 3) if (p := (int(y) + dr, int(x) + dc)) in dem]
        if near:
            want[k] = (*min(near)[1:], -min(near)[0])
    assert {r["peak"]: (r["row"], r["col"], r["ele"]) for r in out.collect()} == want and len(want) < 300
