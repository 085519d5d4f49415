"""Every query of the reference's operators that has SQL, against DuckDB on the smallest tables."""

import decimal
import hashlib
import math
import os
import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tarnspark.plans import ORACLES, QUERIES, SLOW_SQL
from tarnspark.plans.views import view

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return f"{v + 0.0:.6f}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES | SLOW_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    found = db.execute((ORACLES | SLOW_SQL)[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall())


def test_every_query_is_named_once():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def graded(ways, key, k, tol_m, max_deg):
    """The grade at vertex ``k`` of a way: all segments of all ways, one by one."""
    (lng, lat), at = ways[key][k], math.radians(1) * 6371008.8
    flat = lambda q: ((q[0] - lng) * math.cos(math.radians(lat)) * at, (q[1] - lat) * at)
    (bx, by), (fx, fy) = flat(ways[key][max(k - 1, 0)]), flat(ways[key][min(k + 1, len(ways[key]) - 1)])
    heading = None if (bx, by) == (fx, fy) else math.atan2(fy - by, fx - bx)
    met = []
    for way, points in ways.items():
        for (ax, ay), (cx, cy) in zip(map(flat, points), map(flat, points[1:])):
            dx, dy = cx - ax, cy - ay
            t = 0 if dx == dy == 0 else min(max(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0), 1)
            turn = 0 if heading is None else abs(heading - math.atan2(dy, dx)) % math.pi
            if math.hypot(ax + dx * t, ay + dy * t) <= tol_m and min(turn, math.pi - turn) <= math.radians(max_deg):
                met.append((round(math.hypot(ax + dx * t, ay + dy * t), 6), -(way % 6 + 1)))
    return -min(met)[1] if met else None


def test_grade_match_all_asks_all_vertices_of_all_ways(spark, tmp_path):
    rng = random.Random(4)
    day = pd.Timestamp("2020-01-01")
    rows = [(k, n, rng.randrange(1, 12), rng.randrange(1, 12), float(n), day) for base in (1, 3601) for k in range(base, base + 14) for n in range(1, 5)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    ways = {}
    for r in view(spark, str(tmp_path), "way_vertices").orderBy("way_id", "seq").collect():
        ways.setdefault(r["way_id"], []).append((r["lng"], r["lat"]))
    got = {(r["way_id"], r["pos"]): r["grade"] for r in QUERIES["grade_match_all"](spark, str(tmp_path)).collect()}
    assert got == {(way, k): graded(ways, way, k, 60, 40) for way in ways for k in range(len(ways[way]))}
    assert len(got) == 28 * 4 and len(set(got.values())) > 3


def test_fold_text_all_folds_whole_texts(spark, tmp_path):
    texts = {1: "x" * 39 + "ÉÀ end ÿ ", 2: "Ä" * 5000, 3: "", 4: None, 5: " short "}
    pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}).to_parquet(tmp_path / "documents.parquet")
    plain_texts = {1: "x" * 39 + "ea end y", 2: "a" * 5000, 3: "", 4: None, 5: "short"}
    want = {i: (t if t is None else hashlib.md5(t.encode()).hexdigest(), t if t is None else len(t)) for i, t in plain_texts.items()}
    assert {r["doc_id"]: (r["folded_md5"], r["n"]) for r in QUERIES["fold_text_all"](spark, str(tmp_path)).collect()} == want


def test_parking_order_all_numbers_every_lot(spark, tmp_path):
    pd.DataFrame({"c_custkey": range(1, 1201), "c_name": [f"Customer#{k:09}" for k in range(1, 1201)]}).to_parquet(tmp_path / "customer.parquet")
    key = lambda k: ((2 if k % 5 == 0 else 0) + (1 if k % 6 == 1 else 0) - (k % 900) / (k % 900 + 500), k)
    got = [r["src_ord"] for r in QUERIES["parking_order_all"](spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == sorted(range(1, 1201), key=key)


def test_place_queries_take_all_rows(spark):
    con = duckdb.connect()
    n = con.execute(f"SELECT count(*), count(*) FILTER (c_custkey % 50 = 0) FROM '{FOLDER}/customer.parquet'").fetchone()
    snapped = QUERIES["line_snap_all"](spark, FOLDER).where("pos = 1").collect()
    assert len(snapped) == n[0] and all(r["src_ord"] == r["node_id"] for r in snapped)
    asked = {name: QUERIES[name](spark, FOLDER).select("query_id").distinct().count() for name in ("place_search_all", "search_merge_all")}
    assert asked == {"place_search_all": n[1], "search_merge_all": n[1]}
    built = con.execute(f"SELECT count(DISTINCT p_partkey % 25) FROM '{FOLDER}/part.parquet' WHERE p_partkey % 4 = 0").fetchone()[0]
    left = QUERIES["remaining_bytes_all"](spark, FOLDER).first()["gb"]
    assert (left == 0) == (built == 25) and left == QUERIES["remaining_bytes"](spark, FOLDER).first()["gb"]
