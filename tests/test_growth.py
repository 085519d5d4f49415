"""Operators whose work has to grow no faster than their input, against plain code, with counts of what they meet."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnspark.operators import lines, network, paths, prominence, raster, spatial
from tarnspark.scratch import stored


def test_grades_of_a_crowd_are_measured_by_place(spark, monkeypatch):
    """Samples of few places against pieces that cross them: a place meets a segment once, and each heading gets its own."""
    rng, met = random.Random(8), []
    monkeypatch.setattr(lines, "SEGMENTS_AT_ONCE", 50)
    place = lambda: (10 + rng.randrange(5) * 2e-3, 60 + rng.randrange(5) * 1e-3)
    schema = to_arrow_schema(T.StructType.fromDDL("track long, pos long, grade int"))
    ways = [(n % 4 + 1, *place(), *place()) for n in range(300)] + [(None, *place(), *place())]
    samples = [(n, 0, *place(), None if n % 50 == 0 else rng.choice([rng.uniform(-math.pi, math.pi), -math.pi, math.pi, 0.0, math.pi / 2])) for n in range(3000)]
    asked = pa.table(dict(zip(("track", "pos", "lng", "lat", "heading"), zip(*samples))))
    drawn = pa.table(dict(zip(("grade", "lng1", "lat1", "lng2", "lat2"), zip(*ways))))
    hypot = np.hypot
    monkeypatch.setattr(lines.np, "hypot", lambda x, y: met.append(len(x)) or hypot(x, y))
    lng, lat, heading = (asked.column(c).to_numpy() for c in ("lng", "lat", "heading"))
    x1, y1, x2, y2 = (drawn.column(c).to_numpy()[None, :] for c in ("lng1", "lat1", "lng2", "lat2"))
    scale = np.cos(np.radians(lat)) * lines.DEGREE_M
    for degrees in (0.0, 40.0, 89.9999999, 90.0):
        met.clear()
        got = lines._graded("track", schema, 60.0, degrees)(asked, drawn).column("grade").to_pylist()
        assert sum(met) <= 25 * len(ways)
        ax, ay = (x1 - lng[:, None]) * scale[:, None], (y1 - lat[:, None]) * lines.DEGREE_M
        dx, dy = (x2 - lng[:, None]) * scale[:, None] - ax, (y2 - lat[:, None]) * lines.DEGREE_M - ay
        square = dx * dx + dy * dy
        t = np.clip(np.divide(-(ax * dx + ay * dy), square, out=np.zeros_like(square), where=square != 0), 0, 1)
        away = np.round(hypot(ax + dx * t, ay + dy * t), 6)
        turn = np.abs(heading[:, None] - np.arctan2(dy, dx)) % math.pi
        agrees = (away <= 60) & (np.isnan(heading)[:, None] | (np.minimum(turn, math.pi - turn) <= math.radians(degrees)))
        hard = np.tile([-(w[0] or 0) for w in ways], (len(samples), 1))
        first = np.lexsort((hard, np.where(agrees, away, np.inf)), axis=1)[:, 0]
        want = [ways[k][0] if some else None for k, some in zip(first, agrees.any(axis=1))]
        assert got == want
        assert degrees > 40 or len(set(got)) > 2


def test_legs_of_equal_ends_are_searched_once_and_arcs_follow_legs(spark, monkeypatch):
    rng, seen, stored = random.Random(9), {}, paths.stored
    monkeypatch.setattr(paths, "SQUARE_LEGS", 1)
    monkeypatch.setattr(paths, "stored", lambda df, name, **more: seen.setdefault(name, stored(df, name, **more)))
    at = {n: (n % 8 * 1e-3, n // 8 * 1e-3) for n in range(64)}
    pairs = {tuple(sorted(rng.sample(range(64), 2))) for _ in range(260)}
    rows = [(a, b, paths._away(*at[a], *at[b]) * rng.uniform(1, 1.3), "path") for a, b in pairs]
    ends = [(*at[a], *at[b]) for a, b in (rng.sample(range(64), 2) for _ in range(30))]
    legs = [(k, *ends[k % 30]) for k in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "leg_id long, from_lng double, from_lat double, to_lng double, to_lat double")
    nodes, edges = spark.createDataFrame([(n, *p) for n, p in at.items()], "node_id long, lng double, lat double"), spark.createDataFrame(rows, "a long, b long, length_m double, kind string")
    got = {r["leg_id"]: r for r in paths.least_cost_path(frame(legs), nodes, edges, 1.0, 1).collect()}
    assert seen["linked"].count() == len(set(ends)) and len(got) == 300
    sent = seen["squares"].selectExpr("sum(tasks * arcs) AS sent", "sum(arcs + legs) AS held").first()
    assert sent["sent"] <= sent["held"]
    known = {a: {a: 0.0} for a in at}
    for a in at:  # relaxed until nothing gets cheaper
        while True:
            new = {b: c for u, v, m, _ in rows for x, b in ((u, v), (v, u)) if x in known[a] and (c := known[a][x] + m) < known[a].get(b, math.inf) - 1e-9}
            if not new:
                break
            for b, c in new.items():
                known[a][b] = min(c, known[a].get(b, math.inf))
    name = {p: n for n, p in at.items()}
    for k, *p in legs:
        want = known[name[tuple(p[:2])]].get(name[tuple(p[2:])])
        assert (got[k]["cost"] is None) == (want is None) and (want is None or abs(got[k]["cost"] - want) < 1e-6)
        assert want is None or (got[k]["way"][0], got[k]["way"][-1]) == (name[tuple(p[:2])], name[tuple(p[2:])])


def test_edges_and_snaps_are_sent_once_to_a_square_whatever_boxes_it_has(spark, monkeypatch):
    """Legs of three lengths need no squares of three sides, and a place's snaps do not come with each of its legs."""
    sent, search = spark.sparkContext.accumulator(0), paths._search_square

    def counted(schema):
        found = search(schema)

        def told(legs, given):
            sent.add(given.num_rows)
            return found(legs, given)

        return told

    monkeypatch.setattr(paths, "_search_square", counted)
    at = {r * 26 + c: (c * 0.02, r * 0.02) for r in range(26) for c in range(26)}
    rows = [(n, m, paths._away(*at[n], *at[m]), "path") for n in at for m in (n + 1, n + 26) if m in at and (m == n + 26 or m % 26)]
    legs = [(k, r * 26 + c, r * 26 + c + far) for k, (r, c, far) in enumerate((r, c, far) for r in range(26) for c in range(0, 20, 2) for far in (1, 2, 5))]
    got = {r["leg_id"]: r for r in paths.least_cost_path(
        spark.createDataFrame([(k, *at[a], *at[b]) for k, a, b in legs], "leg_id long, from_lng double, from_lat double, to_lng double, to_lat double"),
        spark.createDataFrame([(n, *p) for n, p in at.items()], "node_id long, lng double, lat double"),
        spark.createDataFrame(rows, "a long, b long, length_m double, kind string"), 1.0, 1,
    ).collect()}
    assert all(got[k]["way"] == list(range(a, b + 1)) and abs(got[k]["cost"] - sum(paths._away(*at[n], *at[n + 1]) for n in range(a, b))) < 1e-6 for k, a, b in legs)
    assert sent.value <= 4 * (len(rows) + len(at) + len({n for _, a, b in legs for n in (a, b)}))


def test_batches_of_legs_in_a_dense_square_equal_dijkstra(monkeypatch):
    """Many arcs to a node, ends of several snaps, boxes that leave ways out; a batch has room for some legs only."""
    monkeypatch.setattr(paths, "BATCH_LEGS", 40)
    monkeypatch.setattr(paths, "BATCH_LABELS", 400)
    rng = random.Random(17)
    at = {n: (rng.uniform(0, 0.1), rng.uniform(50, 50.1)) for n in range(60)}
    edges = {(a, b): paths._away(*at[a], *at[b]) for a, b in {tuple(sorted(rng.sample(range(55), 2))) for _ in range(700)}}
    rates = {e: rng.choice((1.0, 1.2, 1.5, 2.2)) for e in edges}
    weights = {e: m * rates[e] for e, m in edges.items()}
    snaps = {p: [(n, paths._away(*p, *at[n]), 0 if n < 55 else n) for n in rng.sample(range(60), rng.randint(1, 3))] for p in ((rng.uniform(0, 0.1), rng.uniform(50, 50.1)) for _ in range(30))}
    legs = [(*p, *q, *(rng.choice((lo, mid)) for lo, mid in ((0.0, 0.02), (50.0, 50.02))), *(rng.choice((hi, mid)) for hi, mid in ((0.1, 0.09), (50.1, 50.09)))) for p, q in (rng.sample([*snaps, (99.0, 50.0)], 2) for _ in range(150))]
    given = [{"a": a, "b": b, "x": edges[a, b], "y": rates[a, b]} for a, b in edges] + [{"a": n, "x": x, "y": y} for n, (x, y) in at.items()]
    given += [{"a": n, "b": part, "x": p[0], "y": p[1], "m": m} for p, rows in snaps.items() for n, m, part in rows]
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("m", pa.float64())]
    schema = pa.schema([*((c, pa.float64()) for c in (*paths._ENDS, "cost", "length")), ("way", pa.list_(pa.int64())), ("reason", pa.string())])
    asked = pa.table(dict(zip((*paths._ENDS, "west", "south", "east", "north"), map(list, zip(*legs)))))
    got = {tuple(r[c] for c in paths._ENDS): r for r in paths._search_square(schema)(asked, pa.Table.from_pylist(given, schema=pa.schema(kinds))).to_pylist()}
    lost = 0
    for *ends, west, south, east, north in {leg[:4]: leg for leg in legs}.values():
        if (99.0, 50.0) in (p := tuple(ends[:2]), q := tuple(ends[2:])):
            assert tuple(ends) not in got
            continue
        best = {n: m for n, m, _ in snaps[p]}
        while True:  # relaxed until nothing gets cheaper
            new = {v: c for e, w in weights.items() for u, v in (e, e[::-1]) if u in best and west <= at[v][0] <= east and south <= at[v][1] <= north and (c := best[u] + w) < best.get(v, math.inf) - 1e-9}
            if not new:
                break
            for v, c in new.items():
                best[v] = min(c, best.get(v, math.inf))
        want = min((best[n] + m for n, m, _ in snaps[q] if n in best), default=None)
        row = got[tuple(ends)]
        if want is None:
            assert (row["cost"], row["way"], row["reason"]) == (None, None, "no_path")
            lost += 1
            continue
        steps = [tuple(sorted(e)) for e in zip(row["way"], row["way"][1:])]
        first, last = ({n: m for n, m, _ in snaps[x]}[row["way"][k]] for x, k in ((p, 0), (q, -1)))
        assert row["reason"] is None and abs(row["cost"] - want) < 1e-6 and abs(first + last + sum(weights[e] for e in steps) - want) < 1e-6
        assert abs(row["length"] - sum(edges[e] for e in steps)) < 1e-6
    assert 0 < lost < len(got) / 2


def test_segments_sort_their_lines_once(spark):
    rows = [(w, k, 10 + w * 1e-3 + k * k * 1e-3, 50.0) for w in range(3) for k in range(4)]
    out = lines.segments(spark.createDataFrame(rows[::-1], "way long, seq long, lng double, lat double"), "way")
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window") and out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [") == 1
    for way in range(3):
        mine = out.where(f"way = {way}").orderBy("seg").collect()
        assert [r["seg"] for r in mine] == [0, 1, 2] and [r["before"] for r in mine] == [0.0, mine[0]["m"], mine[0]["m"] + mine[1]["m"]]


def test_regions_of_many_points_are_ranked_in_tasks_of_few(spark, monkeypatch):
    """Points near regions, some degrees off and far from all get their nearest; a task ranks those of some points only."""
    rng, held = random.Random(13), []

    def kept(df, name, **more):
        out = stored(df, name, **more)
        if name == "found":
            held.append(max((r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("id").alias("n")).collect()), default=0))
        return out

    monkeypatch.setattr(spatial, "RANK_POINTS", 100)
    monkeypatch.setattr(spatial, "stored", kept)
    boxes = [(f"r{n}", w, s, w + 0.3, s + 0.2 + n % 3 * 0.1) for n in range(12) for w, s in [(rng.uniform(-6, -3), rng.uniform(55, 57))]]
    spots = {n: (rng.uniform(-6, -3), rng.uniform(55, 57)) for n in range(1500)} | {1500: (-12.0, 56.0), 1501: (2.0, 50.0), 1502: (100.0, -40.0)}
    points = spark.createDataFrame([(n, *p) for n, p in spots.items()] + [(9000, None, 56.0)], "id long, lng double, lat double")
    regions = spark.createDataFrame(boxes, "region_id string, w double, s double, e double, n double")
    got = {(r["id"], r["pos"]): r["region_id"] for r in spatial.region_nearest(points, "id", regions, 3).collect()}
    away = lambda x, y, b: (max(b[1] - x, x - b[3], 0.0) * math.cos(math.radians(y))) ** 2 + max(b[2] - y, y - b[4], 0.0) ** 2
    near = lambda x, y: sorted(boxes, key=lambda b: (away(x, y, b), (b[3] - b[1]) * (b[4] - b[2]), b[0]))[:3]
    assert got == {(n, k + 1): b[0] for n, p in spots.items() for k, b in enumerate(near(*p))}
    assert len(held) == 3 and max(held) < 200


def test_merge_trees_keep_no_cell_of_the_rasters_own_border(spark, monkeypatch):
    """A raster no wider than a block leaves the two rows at a seam, not its whole left side, and reads each peak's place once."""
    written = {}

    def kept(df, name, **more):
        out = stored(df, name, **more)
        written.setdefault(name, []).append(out.where(F.col("kind") == prominence.NODE).count() if name == "blocks" else out.count())
        return out

    monkeypatch.setattr(prominence, "stored", kept)
    monkeypatch.setattr(raster, "stored", kept)
    rng = random.Random(10)
    dem = spark.createDataFrame([(r, c, rng.randrange(1000)) for r in range(256) for c in range(8)], "row int, col int, z int")
    peaks = spark.createDataFrame([(n, rng.uniform(0, 8), rng.uniform(0, 256)) for n in range(50)], "peak_id long, px double, py double")
    snapped = raster.peak_snap(peaks, "peak_id", dem)
    monkeypatch.setattr(raster, "stored", stored)
    whole = {r["peak_id"]: r["prom"] for r in prominence.prominence(snapped, dem, 50.0, 0.0, 256).collect()}
    written["blocks"].clear()
    assert {r["peak_id"]: r["prom"] for r in prominence.prominence(snapped, dem, 50.0, 0.0, 16).collect()} == whole
    seams, open_ = 30 * 8, 50
    assert written["peaks"][0] == 50 and written["blocks"][0] <= seams + open_ and written["blocks"][1] <= 6 * 8 + open_


def test_bridges_read_nodes_and_edges_once(spark):
    """Dashes in a row get their bridges from one pass through the nodes and one through the edges."""
    read = {"nodes": spark.sparkContext.accumulator(0), "edges": spark.sparkContext.accumulator(0)}

    def told(df, name):
        seen = read[name]

        def through(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(through, df.schema)

    nodes = spark.createDataFrame([(n, n // 2 * 1e-3 + n % 2 * 9e-4, 0.0) for n in range(40)], "node_id long, lng double, lat double")
    edges = spark.createDataFrame([(n, n + 1, 100.0, "path") for n in range(0, 40, 2)], "a long, b long, length_m double, kind string")
    got = network.gap_bridges(told(nodes, "nodes"), told(edges, "edges")).orderBy("a").collect()
    assert [(r["a"], r["b"], r["kind"]) for r in got] == [(n, n + 1, "gap") for n in range(1, 39, 2)]
    assert {k: v.value for k, v in read.items()} == {"nodes": 40, "edges": 20}
    whole = network.gap_bridge(nodes, edges)
    assert whole.count() == 39 and whole.where("kind = 'gap'").orderBy("a").collect() == got
