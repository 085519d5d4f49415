"""The path network: nodes, edges, components, gap bridges and least-cost legs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.functions.geo import haversine_m
from tarnspark.operators.components import least_roots
from tarnspark.operators.spatial import line_snap
from tarnspark.scratch import stored

# How much longer a metre of each kind counts on foot; other kinds 1.5.
WALKING_COST = {
    "path": 1.0, "footway": 1.0, "track": 1.0, "bridleway": 1.0, "cycleway": 1.05, "steps": 1.35, "minor_road": 1.2, "medium_road": 1.6, "major_road": 2.2,
}


def edge_build(vertices: DataFrame) -> DataFrame:
    """Edges between consecutive vertices of a way: a < b, length_m, kind; of the same pair the first by (way, seq).

    ``vertices`` has way_id, seq, node_id, lng, lat, kind. Steps within one node go.
    """
    w = Window.partitionBy("way_id").orderBy("seq")
    s = vertices.select("way_id", "seq", "kind", "node_id", "lng", "lat", F.lead("node_id").over(w).alias("to"), F.lead("lng").over(w).alias("lng2"), F.lead("lat").over(w).alias("lat2"))
    s = s.where("to is not null and to <> node_id").withColumn("length_m", haversine_m(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2")))
    return s.groupBy(F.least("node_id", "to").alias("a"), F.greatest("node_id", "to").alias("b")).agg(F.min_by(F.struct("length_m", "kind"), F.struct("way_id", "seq")).alias("r")).select("a", "b", "r.*")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id`` and component, the least node it reaches; nodes without edges are their own."""
    roots = least_roots(edges, "a", "b")
    return nodes.select("node_id").distinct().join(roots, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("root", "node_id").alias("component"))


def _cover(tol: int, side: int) -> Callable[[pa.Table], pa.Table]:
    """One block's round of ``node_merge``: spots in the order of their lead, each a node unless one before it is in reach.

    A spot waits if a spot of another block before it, in reach, is open. Rows come back for the block's own spots: new nodes,
    and those that still wait.
    """
    reach = [(dx, dy) for dx in range(-tol, tol + 1) for dy in range(-tol, tol + 1) if 0 < dx * dx + dy * dy <= tol * tol]

    def cover(block: pa.Table) -> pa.Table:
        bx, by = (block.column(c)[0].as_py() for c in ("bx", "by"))
        gx, gy, lead, node = (block.column(c).to_numpy() for c in ("gx", "gy", "lead", "node"))
        own = (gx // side == bx) & (gy // side == by)
        state = dict(zip(zip(gx.tolist(), gy.tolist()), np.where(node, 1, 0).tolist()))  # 0 open, 1 node, 2 covered
        leads = dict(zip(zip(gx.tolist(), gy.tolist()), lead.tolist()))
        made, wait = [], []
        for k in np.argsort(lead, kind="stable").tolist():
            x, y = int(gx[k]), int(gy[k])
            if node[k] or not own[k]:
                continue
            near = [(x + dx, y + dy) for dx, dy in reach]
            near = [state[p] for p in near if p in state and leads[p] < lead[k]]
            if 1 in near:
                state[x, y] = 2
            elif 0 in near:
                wait.append(k)
            else:
                state[x, y] = 1
                made.append(k)
        at = np.array(made + wait, dtype=np.int64)
        return pa.table({"gx": gx[at], "gy": gy[at], "lead": lead[at], "node": np.repeat([True, False], [len(made), len(wait)])})

    return cover


def node_merge(vertices: DataFrame, tol: int = 2, side: int = 1024) -> DataFrame:
    """``node_id`` for every vertex (src_ord, gx, gy), as if they came one by one in the order of src_ord.

    A vertex takes a node within ``tol`` units that an earlier vertex made, of several the one in the least cell of that side
    (by column, then row), then the earliest; without one it makes a node of its own, named by its src_ord, which has to be
    unique. Blocks of ``side`` units settle their spots in order, each in a task; a spot waits for a block beside it only
    where an open spot there comes before it, so the rounds follow how often such chains change blocks.
    """
    spots = vertices.groupBy(F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy")).agg(F.min("src_ord").alias("lead")).withColumn("node", F.lit(False))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spots.schema.fields)
    around = lambda c: F.explode(F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-tol, 0, tol)]), lambda d: F.floor((F.col(c) + d) / side))))
    open_, nodes = spots, []
    while True:
        blocks = open_.withColumn("bx", around("gx")).withColumn("by", around("gy"))
        done = stored(blocks.groupBy("bx", "by").applyInArrow(_cover(tol, side), kinds), "spots")
        nodes.append(done.where("node").select("gx", "gy", "lead"))
        if not done.where("not node").limit(1).count():
            break
        # Only new nodes near another block can tell it something; a block without open spots makes none.
        border = (F.pmod(F.col("gx"), F.lit(side)) < tol) | (F.pmod(F.col("gx"), F.lit(side)) >= side - tol) | (F.pmod(F.col("gy"), F.lit(side)) < tol) | (F.pmod(F.col("gy"), F.lit(side)) >= side - tol)
        open_ = done.where(~F.col("node") | border)
    made = reduce(lambda a, b: a.unionByName(b), nodes)
    cell = lambda c: F.floor(F.col(c) / tol).cast("bigint")
    offered = made.select(F.col("gx").alias("nx"), F.col("gy").alias("ny"), cell("gx").alias("cx"), cell("gy").alias("cy"), "lead")
    near = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    # A node's own spot has no other node in reach, so only covered spots look around.
    covered = spots.select("gx", "gy").join(made.select("gx", "gy"), ["gx", "gy"], "left_anti").withColumn("cx", near("gx")).withColumn("cy", near("gy"))
    met = covered.join(offered, ["cx", "cy"]).where(F.pow(F.col("gx") - F.col("nx"), 2) + F.pow(F.col("gy") - F.col("ny"), 2) <= tol * tol)
    choices = met.groupBy("gx", "gy").agg(F.sort_array(F.collect_list(F.struct("cx", "cy", "lead"))).alias("choices"))  # few: nodes are farther apart than the tolerance
    choices = choices.unionByName(made.select("gx", "gy", F.array(F.struct(cell("gx").alias("cx"), cell("gy").alias("cy"), "lead")).alias("choices")))
    found = vertices.join(choices, ["gx", "gy"])
    return found.withColumn("node_id", F.filter("choices", lambda n: n["lead"] <= F.col("src_ord"))[0]["lead"]).drop("choices")


#: Open ends and their candidates that one task settles in order.
SETTLE_ROWS = 500_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All open ends one by one: each to its first candidate that is still in another component."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    rows = rows.take(pc.sort_indices(rows, [("end_id", "ascending"), ("pos", "ascending")]))
    end, node, ce, cn = (rows.column(c).to_pylist() for c in ("end_id", "node_id", "ce", "cn"))
    root: dict = {}

    def find(c):
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    done, taken = set(), []
    for k, (e, n, a, b) in enumerate(zip(end, node, ce, cn)):
        if e not in done and (a := find(a)) != (b := find(b)):
            root[a] = b
            done |= {e, n}
            taken.append(k)
    yield from rows.take(pa.array(taken, pa.int64())).to_batches()


def gap_bridge(nodes: DataFrame, edges: DataFrame, max_m: float = 20.0, k: int = 6) -> DataFrame:
    """The edges, and the bridges that ``gap_bridges`` finds."""
    return edges.select("a", "b", "length_m", "kind").unionByName(gap_bridges(nodes, edges, max_m, k))


def gap_bridges(nodes: DataFrame, edges: DataFrame, max_m: float = 20.0, k: int = 6) -> DataFrame:
    """Bridges (a, b, length_m) of kind ``gap``: each dead end to its nearest node, of the ``k`` nearest, in another component.

    Nodes and the ends of edges are read once. The bridges are those of going through the dead ends one by one in the order of
    their ids, a bridge joining components and ending both its nodes' search. Ends are taken at once where that cannot change what they get: one that is the least of all
    that touch its own component or its candidate's, while no lesser end aims at it or is its candidate, meets what it would
    meet in its turn. The others go on in the next round, and what is left is settled in order in one task when it has no more
    rows than ``SETTLE_ROWS``.
    """
    nodes, links = stored(nodes.select("node_id", "lng", "lat"), "nodes"), stored(edges.select("a", "b"), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").count().where("count = 1").select("node_id")
    loose = ends.join(nodes, "node_id").select(F.col("node_id").alias("end_id"), "lng", "lat")
    near = stored(line_snap(loose, "end_id", nodes, max_m, k).where("end_id <> node_id"), "near")
    parts = least_roots(links, "a", "b")
    part = lambda c, name: parts.select(F.col("node").alias(c), F.col("root").alias(name))
    near = near.join(part("node_id", "cn"), "node_id", "left").join(part("end_id", "ce"), "end_id", "left")
    near = near.select("end_id", "node_id", "distance_m", "pos", F.coalesce("ce", "end_id").alias("ce"), F.coalesce("cn", "node_id").alias("cn"))
    open_ = stored(near.where("cn <> ce"), "open")
    taken = []
    while open_.count() > SETTLE_ROWS:
        first = open_.groupBy("end_id").agg(F.min_by(F.struct("node_id", "distance_m", "ce", "cn"), "pos").alias("r")).select("end_id", "r.*")
        touch = open_.select("end_id", F.explode(F.array("ce", "cn")).alias("c")).groupBy("c").agg(F.min("end_id").alias("least"))
        aimed = open_.groupBy(F.col("node_id").alias("end_id")).agg(F.min("end_id").alias("by"))
        still = open_.select(F.col("end_id").alias("node_id"), F.col("end_id").alias("also")).distinct()
        least = lambda c: touch.select(F.col("c").alias(c), F.col("least").alias(f"least_{c}"))
        judged = first.join(least("ce"), "ce").join(least("cn"), "cn").join(aimed, "end_id", "left").join(still, "node_id", "left")
        sure = ((F.col("least_ce") == F.col("end_id")) | (F.col("least_cn") == F.col("end_id"))) & F.coalesce(F.col("by") > F.col("end_id"), F.lit(True)) & F.coalesce(F.col("also") > F.col("end_id"), F.lit(True))
        bridges = stored(judged.where(sure).select("end_id", "node_id", "distance_m", "ce", "cn"), "bridges")
        taken.append(bridges)
        joined = least_roots(bridges, "ce", "cn")
        root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        done = bridges.select(F.explode(F.array("end_id", "node_id")).alias("end_id")).distinct()
        rest = open_.join(done, "end_id", "left_anti").join(root("ce"), "ce", "left").join(root("cn"), "cn", "left")
        rest = rest.select("end_id", "node_id", "distance_m", "pos", F.coalesce("rce", "ce").alias("ce"), F.coalesce("rcn", "cn").alias("cn")).where("cn <> ce")
        open_ = stored(rest, "open", after=(open_,))
    taken.append(stored(open_.coalesce(1).mapInArrow(_in_order, open_.schema), "bridges", after=(open_, near, nodes, links)))
    found = reduce(lambda x, y: x.unionByName(y), [bridges.select("end_id", "node_id", "distance_m") for bridges in taken])
    return found.select(F.least("end_id", "node_id").alias("a"), F.greatest("end_id", "node_id").alias("b"), F.col("distance_m").alias("length_m"), F.lit("gap").alias("kind"))


def leg_fallback(legs: DataFrame, paths: DataFrame, covered: DataFrame, max_tiles: int = 1024) -> DataFrame:
    """kind, freehand and reason of each leg (leg_id, snap, tiles): a path, or straight because freehand, no_region, too_long or no_path."""
    j = legs.join(paths.select("leg_id", "way"), "leg_id", "left").join(covered.select("leg_id", F.lit(True).alias("__in")).distinct(), "leg_id", "left")
    reason = (
        F.when(~F.col("snap"), "freehand").when(F.col("__in").isNull(), "no_region").when(F.col("tiles") > max_tiles, "too_long").when(F.col("way").isNull(), "no_path")
    )
    return j.select("leg_id", F.when(reason.isNull(), "path").otherwise("straight").alias("kind"), reason.alias("reason"))


def leg_endpoints(legs: DataFrame) -> DataFrame:
    """Coordinates with the tapped points (from_pt, to_pt) put before and after where they are over a metre off the path."""
    pt = lambda c: (F.col(c)["lng"], F.col(c)["lat"])
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    far = lambda c, p: haversine_m(*pt(c), p["lng"], p["lat"]) > 1
    head = F.when(far("from_pt", first), F.array_prepend("coords", F.col("from_pt"))).otherwise(F.col("coords"))
    return legs.withColumn("__last", last).withColumn("coords", head).withColumn(
        "coords", F.when(haversine_m(*pt("to_pt"), F.col("__last")["lng"], F.col("__last")["lat"]) > 1, F.array_append("coords", F.col("to_pt"))).otherwise(F.col("coords"))
    ).drop("__last")


def way_names(path_edges: DataFrame) -> DataFrame:
    """Names along each leg (leg_id, pos, name), repeats in a row and nameless edges left out."""
    named = path_edges.where("name is not null")
    new = F.coalesce(F.lag("name").over(Window.partitionBy("leg_id").orderBy("pos")) != F.col("name"), F.lit(True))
    kept = named.withColumn("__new", new).where("__new")
    return kept.groupBy("leg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
