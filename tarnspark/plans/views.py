"""Map-shaped views over the given tables: plain SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "osm_points": """
SELECT c_custkey AS src_ord,
       CASE CAST(floor(c_custkey / 7e0) AS BIGINT) % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type,
       CASE WHEN c_custkey % 7 = 1 THEN c_custkey - 1 ELSE c_custkey END AS osm_id,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name,
       CASE c_custkey % 4 WHEN 0 THEN 'peak' WHEN 1 THEN 'volcano' WHEN 2 THEN 'saddle' ELSE NULL END AS tag_natural,
       CASE c_custkey % 8 WHEN 3 THEN 'village' WHEN 7 THEN 'town' ELSE NULL END AS tag_place,
       CASE c_custkey % 9 WHEN 0 THEN 'mast' WHEN 1 THEN 'tower' WHEN 2 THEN 'cairn' WHEN 3 THEN 'survey_point' WHEN 4 THEN 'water_tower' ELSE NULL END AS tag_man_made,
       CASE c_custkey % 10 WHEN 0 THEN 'lighting' WHEN 1 THEN 'communication' ELSE NULL END AS tag_tower_type,
       CASE c_custkey % 6 WHEN 0 THEN 'private' WHEN 1 THEN 'customers' WHEN 2 THEN 'yes' ELSE NULL END AS tag_access,
       CASE c_custkey % 6
            WHEN 0 THEN concat('~', CAST(c_custkey % 1400 AS VARCHAR(10)))
            WHEN 1 THEN concat(CAST(c_custkey % 1400 AS VARCHAR(10)), '.46m')
            WHEN 2 THEN concat('1,', lpad(CAST(c_custkey % 1000 AS VARCHAR(10)), 3, '0'))
            WHEN 3 THEN 'unknown' WHEN 4 THEN '99999'
            ELSE CAST(c_custkey % 1400 AS VARCHAR(10)) END AS tag_ele,
       CASE c_custkey % 3 WHEN 0 THEN '12,345' WHEN 1 THEN CAST(c_custkey * 37 AS VARCHAR(12)) ELSE 'many' END AS tag_population,
       CASE c_custkey % 12 WHEN 0 THEN 'T3-T4' WHEN 1 THEN 'mountain_hiking/T3' WHEN 2 THEN 'unmarked' WHEN 3 THEN 't 4+' WHEN 4 THEN 'demanding_alpine_hiking!' ELSE NULL END AS tag_grade,
       CASE WHEN c_custkey % 11 = 0 THEN 'Q1' ELSE NULL END AS tag_wikidata,
       -6e0 + (c_custkey * 7919 % 40000) / 1e4 AS lon,
       55e0 + (c_custkey * 104729 % 30000) / 1e4 AS lat
FROM customer
""",
    "way_vertices": """
SELECT way_id, seq, kind, access, gx, gy,
       -6e0 + gx * 1e-4 AS lng, 55e0 + gy * 1e-4 AS lat
FROM (SELECT l_orderkey AS way_id,
             CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS seq,
             CASE l_orderkey % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'minor_road' WHEN 2 THEN 'medium_road' ELSE 'highway' END AS kind,
             CASE WHEN l_orderkey % 13 = 0 THEN 'private' ELSE NULL END AS access,
             (l_orderkey % 60) * 400 + (l_partkey % 40) * 20 AS gx,
             (CAST(floor(l_orderkey / 60e0) AS BIGINT) % 60) * 400 + (l_suppkey % 40) * 20 AS gy
      FROM lineitem) v
""",
    "dem_cells": """
SELECT CAST(floor(o_orderkey / 128e0) AS INTEGER) AS r,
       CAST(o_orderkey % 128 AS INTEGER) AS c,
       CAST(floor(o_totalprice / 250e0) AS INTEGER) AS z
FROM orders
WHERE o_orderkey < CAST(floor((SELECT count(*) FROM orders) / 128e0) AS BIGINT) * 128
""",
    "map_regions": """
SELECT n_nationkey AS region_ord, n_name AS region_id, n_regionkey AS group_id,
       -6e0 + (n_nationkey % 5) * 8e-1 AS w, 55e0 + floor(n_nationkey / 5e0) * 6e-1 AS s,
       -6e0 + (n_nationkey % 5) * 8e-1 + 7e-1 + (n_nationkey % 3) * 2e-1 AS e,
       55e0 + floor(n_nationkey / 5e0) * 6e-1 + 5e-1 + (n_nationkey % 4) * 1e-1 AS n
FROM nation
""",
    "map_artifacts": """
SELECT concat('NATION_', CAST(p_partkey % 25 AS VARCHAR(4))) AS region_id,
       CASE p_partkey % 4 WHEN 0 THEN 'basemap' WHEN 1 THEN 'terrain' WHEN 2 THEN 'sac' ELSE 'paths' END AS kind,
       concat('NATION_', CAST(p_partkey % 25 AS VARCHAR(4)), '-', CASE p_partkey % 4 WHEN 0 THEN 'basemap' WHEN 1 THEN 'terrain' WHEN 2 THEN 'sac' ELSE 'paths' END, '.pmtiles') AS filename,
       CAST(floor(p_retailprice * 1e3) AS BIGINT) AS bytes,
       9 + p_size % 7 AS maxzoom, p_partkey AS ord
FROM part
""",
    "fixes": """
SELECT event_id, ts, user_id AS device,
       -6e0 + (user_id % 60) * 4e-2 + (event_id * 13 % 90) * 1e-3 AS lng,
       55e0 + (user_id % 40) * 4e-2 + (event_id * 29 % 90) * 1e-3 AS lat,
       CAST(floor(value * 1e2) AS BIGINT) AS bytes_gained,
       event_id * 37 % 3600 / 1e1 AS heading
FROM events
""",
}

SOURCES = {"osm_points": ["customer"], "way_vertices": ["lineitem"], "dem_cells": ["orders"], "map_regions": ["nation"], "map_artifacts": ["part"], "fixes": ["events"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables in ``sf_dir``."""
    for source in SOURCES[name]:
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views as common table expressions before ``sql``."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH RECURSIVE {head}" + (", " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else " " + sql)
