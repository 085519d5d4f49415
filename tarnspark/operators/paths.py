"""Least-cost legs over the path network.

A leg keeps to a box around its ends. Legs whose boxes lie in one square of the network, of a side that follows the box, are
searched together in one task that holds the square, many at a time in NumPy: one round of tasks for all of them. A task gets
its square's edges, nodes and the nodes near each place that a leg starts or ends at once, so a leg is no more than its ends
and its box there. Where a square has too many nodes for that,
its legs are searched block by block: a leg's search holds one row per node it has reached, a block in which it has new
arrivals is searched to the end in one task, and what leaves the block arrives in the next block in the next round. Those
rounds follow the number of blocks that a leg crosses, not its edges; rows point back to the node before them, and legs that
have settled leave the loop. Ends that no end on the other side is connected with are dropped before any search.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnspark.functions.geo import EARTH_M, haversine_m
from tarnspark.operators.classify import lookup
from tarnspark.operators.components import least_roots
from tarnspark.operators.network import WALKING_COST
from tarnspark.operators.spatial import line_snap
from tarnspark.scratch import forget, stored

#: Side of a block in degrees, and legs that are searched in one block by one task.
BLOCK_DEGREES, LEGS_A_TASK = 0.1, 256
#: Side of the smallest squares in degrees, nodes that a square may hold, and legs that one task searches in it at least.
SQUARE_DEGREES, SQUARE_NODES, SQUARE_LEGS = 0.05, 100_000, 1024
#: Doublings of that side which small boxes go up where no square is too full for it: an edge then lies in fewer squares.
RAISED = 2
#: Legs that a task searches at a time, places that it keeps for legs and nodes together, and the side in degrees by which it sorts legs.
BATCH_LEGS, BATCH_LABELS, BATCH_DEGREES = 512, 4_000_000, 0.04
#: Open nodes of a leg are searched on together up to this share of its distance beyond the best of them.
STEP_SHARE, STEP_LEAST_M = 0.05, 50.0
_ENDS = ["from_lng", "from_lat", "to_lng", "to_lat"]
_REACHED = "leg_id {leg}, node_id {node}, block long, cost double, length double, prev {node}, came boolean"


def _block(lng, lat):
    return (F.floor(F.col(lng) / BLOCK_DEGREES) * 100_000 + F.floor(F.col(lat) / BLOCK_DEGREES)).cast("bigint")


def _rows(table: pa.Table, *names: str):
    return zip(*(table.column(n).to_pylist() for n in names))


def _search(schema: pa.Schema):
    """All improvements that a block's arrivals lead to: nodes of the block, and their neighbours outside."""

    def search(reached: pa.Table, arcs: pa.Table) -> pa.Table:
        ways: dict = {}
        for a, *arc in _rows(arcs, "a", "b", "b_block", "w", "length_m", "b_lng", "b_lat"):
            ways.setdefault(a, []).append(arc)
        best, fresh, boxes = {}, {}, {}
        for leg, node, cost, metres, came, *box in _rows(reached, "leg_id", "node_id", "cost", "length", "came", "west", "south", "east", "north", "block"):
            best.setdefault(leg, {})[node] = (cost, metres, None)
            boxes[leg] = box
            if came:
                fresh.setdefault(leg, []).append((cost, node))
        out = []
        for leg, heap in fresh.items():
            (west, south, east, north, block), known, found = boxes[leg], best[leg], {}
            heapq.heapify(heap)
            while heap:
                cost, node = heapq.heappop(heap)
                if cost > known[node][0]:
                    continue
                for b, home, w, m, lng, lat in ways.get(node, ()):
                    if west <= lng <= east and south <= lat <= north and (b not in known or cost + w < known[b][0]):
                        known[b] = (cost + w, known[node][1] + m, node)
                        found[b] = home
                        if home == block:
                            heapq.heappush(heap, (cost + w, b))
            out += [(leg, n, home, *known[n], home != block) for n, home in found.items()]
        columns = zip(*out) if out else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return search


def _walk(schema: pa.Schema):
    """From each leg's place in a block back to where it entered the block: those nodes, and the next place if any."""

    def walk(rows: pa.Table) -> pa.Table:
        before, places = {}, {}
        for leg, at, node, prev in _rows(rows, "leg_id", "at", "node_id", "prev"):
            before.setdefault(leg, {})[node] = prev
            places[leg] = at
        out = []
        for leg, node in places.items():
            way = []
            while node is not None and node in before[leg]:
                way.append(node)
                node = before[leg][node]
            out.append((leg, way, node))
        columns = zip(*out) if out else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return walk


def _away(lng: float, lat: float, to_lng: float, to_lat: float) -> float:
    p, q = math.radians(lat), math.radians(to_lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(to_lng - lng) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def _space(lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in space, in metres. A straight line there is no longer than the way over the ground."""
    p, q = np.radians(lng), np.radians(lat)
    return EARTH_M * np.cos(q) * np.cos(p), EARTH_M * np.cos(q) * np.sin(p), EARTH_M * np.sin(q)


def _straight(a: tuple, b: tuple) -> np.ndarray:
    return np.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def _plane(lng: float, lat: float) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """Directions east and north at a place, in space."""
    p, q = math.radians(lng), math.radians(lat)
    return (-math.sin(p), math.cos(p), 0.0), (-math.sin(q) * math.cos(p), -math.sin(q) * math.sin(p), math.cos(q))


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs of ``count`` that begin at ``first``, and the run that each is of."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) + np.repeat(first - np.cumsum(count) + count, count), of


def _codes(*columns) -> tuple[pa.Array, list[np.ndarray]]:
    """The values of like columns in order, and each column as their numbers."""
    ids = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ids.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return ids.dictionary.take(pa.array(order)), np.split(rank[ids.indices.to_numpy()], np.cumsum([len(c) for c in columns])[:-1])


def _search_square(schema: pa.Schema):
    """The best way of each leg of a square, from all its starts until no better end can come; legs that have no snap go.

    A node counts with the least that the rest of its way can cost: the straight line to the leg's end, by the cheapest metre
    of the square's arcs. Each turn searches on from the best open nodes of every leg of a batch, along the arcs that are no
    heavier than what the best way found so far leaves; a node that is reached for less later on is searched again.

    ``given`` has edges (a, b, x metres, y what a metre costs), nodes (a, x lng, y lat) and snaps (node a, its part b, the
    place's x lng and y lat, m metres away): few columns, as its rows are many.
    """

    def search(legs: pa.Table, given: pa.Table) -> pa.Table:
        some = lambda name: pc.is_valid(given.column(name))
        edges, snaps, nodes = given.filter(pc.and_not(some("b"), some("m"))), given.filter(some("m")), given.filter(pc.invert(some("b")))
        if not legs.num_rows or not snaps.num_rows:
            return schema.empty_table()
        column = lambda t, *names: [t.column(c).to_numpy() for c in names]
        spot = lambda lng, lat: lng + 1j * lat
        snaps = snaps.take(pc.sort_indices(snaps, [("x", "ascending"), ("y", "ascending"), ("m", "ascending")]))
        ids, (a, b, held, snap) = _codes(edges.column("a"), edges.column("b"), nodes.column("a"), snaps.column("a"))
        _, (part,) = _codes(snaps.column("b"))
        (snap_m,), parts = column(snaps, "m"), int(part.max()) + 1
        spots, first, count = np.unique(spot(*column(snaps, "x", "y")), return_index=True, return_counts=True)

        def snapped(end: str) -> np.ndarray:
            asked = spot(*column(legs, f"{end}_lng", f"{end}_lat"))
            at = np.minimum(np.searchsorted(spots, asked), len(spots) - 1)
            return np.where(spots[at] == asked, at, -1)

        starts, ends = snapped("from"), snapped("to")
        both = np.flatnonzero((starts >= 0) & (ends >= 0))
        legs, starts, ends = legs.take(pa.array(both)), starts[both], ends[both]
        lng, lat = np.full(len(ids), np.nan), np.full(len(ids), np.nan)
        lng[held], lat[held] = column(nodes, "x", "y")
        space = _space(lng, lat)
        come, to = np.concatenate((a, b)), np.concatenate((b, a))
        metres, w = (np.tile(c, 2) for c in column(edges, "x", "y"))
        w = metres * w
        order = np.lexsort((w, come))
        come, to, w, metres = come[order], to[order], w[order], metres[order]
        out_of = np.searchsorted(come, np.arange(len(ids) + 1))
        line = _straight([c[come] for c in space], [c[to] for c in space])
        # A little less than the least, so that rounding never leaves out a way.
        least = min(1.0, float(np.min(np.divide(w, line, out=np.ones(len(line)), where=line > 0), initial=1.0))) * (1 - 1e-9)
        boxes = column(legs, "west", "south", "east", "north")
        goals = _space(*column(legs, "to_lng", "to_lat"))
        steps = np.maximum(STEP_SHARE * _straight(_space(*column(legs, "from_lng", "from_lat")), goals), STEP_LEAST_M)
        row, col = (np.floor((boxes[k] + boxes[k + 2]) / 2 / BATCH_DEGREES) for k in (1, 0))
        turn, done = np.lexsort((col, row)), 0
        costs, lengths, ways = np.full(len(turn), np.inf), np.zeros(len(turn)), []
        cost = came = np.empty(0)
        new = np.full(len(ids), -1)
        while done < len(turn):
            size = BATCH_LEGS
            while True:  # nodes in reach of a batch that its labels have room for
                k = turn[done : done + size]
                (s, sl), (g, gl) = (_runs(first[c[k]], count[c[k]]) for c in (starts, ends))
                # Ends that no end on the other side is connected with are left out.
                from_, to_ = sl * parts + part[s], gl * parts + part[g]
                linked, also = np.isin(from_, to_), np.isin(to_, from_)
                s, sl, g, gl = s[linked], sl[linked], g[also], gl[also]
                west, south, east, north = (c[k] for c in boxes)
                inside = (lng >= west.min()) & (lng <= east.max()) & (lat >= south.min()) & (lat <= north.max())
                inside[snap[s]] = inside[snap[g]] = True
                here = np.flatnonzero(inside)
                n = len(here)
                if len(k) == 1 or len(k) * n <= BATCH_LABELS:
                    break
                size = max(1, min(size // 2, BATCH_LABELS // n))
            done += len(k)
            new[here] = np.arange(n)
            arc, tail = _runs(out_of[here], out_of[here + 1] - out_of[here])
            head = new[to[arc]]
            arc, tail, head = arc[head >= 0], tail[head >= 0], head[head >= 0]
            weight, stop = w[arc], np.searchsorted(tail, np.arange(n + 1))
            # Seen on a plane, where no line is longer than in space.
            goal_at, (east_, north_) = [c[k] for c in goals], _plane(boxes[0][k[0]], boxes[1][k[0]])
            flat = lambda at: (sum(c * d for c, d in zip(at, east_)), sum(c * d for c, d in zip(at, north_)))
            (x, y), (gx, gy) = flat([c[here] for c in space]), flat(goal_at)
            x, y, mine, hers = x[head], y[head], lng[here], lat[here]
            if len(k) * n > len(cost):
                cost, came = np.full(len(k) * n, np.inf), np.empty(len(k) * n, np.int64)
            best, step = np.full(len(k), np.inf), steps[k]
            leg, label, so_far, goal = sl, sl * n + new[snap[s]], snap_m[s], gl * n + new[snap[g]]
            bound = so_far + np.nan_to_num(_straight([c[snap[s]] for c in space], [c[sl] for c in goal_at]) * least)
            cost[label], came[label], touched = so_far, -1, [label]
            np.minimum.at(best, gl, cost[goal] + snap_m[g])
            while len(label):
                low = np.full(len(k), np.inf)
                np.minimum.at(low, leg, bound)
                now = bound <= (low + step)[leg]
                l, at, c = leg[now], label[now], so_far[now]
                leg, label, so_far, bound = (v[~now] for v in (leg, label, so_far, bound))
                left, u = best[l] - c, at - l * n
                low, high = stop[u], stop[u + 1]
                while (open_ := low < high).any():
                    middle = (low + high) // 2
                    light = open_ & (weight[np.where(open_, middle, 0)] < left)
                    low, high = np.where(light, middle + 1, low), np.where(open_ & ~light, middle, high)
                e, of = _runs(stop[u], low - stop[u])
                run = low - stop[u]
                dx, dy = x[e], y[e]
                dx -= np.repeat(gx[l], run)
                dy -= np.repeat(gy[l], run)
                dx *= dx
                dy *= dy
                dx += dy
                ahead = np.sqrt(dx, out=dx)
                ahead *= least
                ahead -= 1e-3
                ok = np.flatnonzero(weight[e] + ahead < np.repeat(left, run))
                e, of, ahead = e[ok], of[ok], ahead[ok]
                v, l = head[e], l[of]
                at, c = l * n + v, c[of] + weight[e]
                ok = np.flatnonzero(c < cost[at])
                v, of = v[ok], l[ok]
                ok = ok[(mine[v] >= west[of]) & (mine[v] <= east[of]) & (hers[v] >= south[of]) & (hers[v] <= north[of])]
                e, l, at, c, ahead = e[ok], l[ok], at[ok], c[ok], ahead[ok]
                np.minimum.at(cost, at, c)
                won = np.flatnonzero(c == cost[at])
                came[at[won]] = e[won]
                won = won[came[at[won]] == e[won]]
                touched.append(at[won])
                np.minimum.at(best, gl, cost[goal] + snap_m[g])
                leg, label, so_far, bound = (np.concatenate(v) for v in ((leg, l[won]), (label, at[won]), (so_far, c[won]), (bound, c[won] + ahead[won])))
                ok = (bound < best[leg]) & (so_far <= cost[label])
                leg, label, so_far, bound = leg[ok], label[ok], so_far[ok], bound[ok]
            costs[k] = best
            # Back from the best end, of several the least node.
            last = np.full(len(k), n)
            ended = np.isfinite(best[gl]) & (cost[goal] + snap_m[g] == best[gl])
            np.minimum.at(last, gl[ended], new[snap[g[ended]]])
            l, back = np.flatnonzero(last < n), []
            u = last[l]
            while len(l):
                e = came[l * n + u]
                back.append((k[l], here[u], np.where(e >= 0, metres[arc[e]] if len(arc) else 0.0, 0.0)))
                l, u = l[e >= 0], tail[e[e >= 0]]
            ways += [tuple(np.concatenate(v) for v in zip(*back[::-1]))] if back else []
            cost[np.concatenate(touched)] = np.inf
            new[here] = -1
        of, at, m = (np.concatenate(v) for v in zip(*ways)) if ways else (np.empty(0, np.int64),) * 3
        np.add.at(lengths, of, m)
        order = np.argsort(of, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(turn)))))
        none = ~np.isfinite(costs)
        way = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(at[order])), type=schema.field("way").type, mask=pa.array(none))
        reason = pa.array(np.where(none, "no_path", None), pa.string())
        answers = [*(legs.column(c) for c in _ENDS), pa.array(costs, mask=none), pa.array(lengths, mask=none), way, reason]
        return pa.Table.from_arrays(answers, schema=schema)

    return search


def least_cost_path(
    legs: DataFrame, nodes: DataFrame, edges: DataFrame, snap_m: float = 250.0, snaps: int = 8, pad_m: float = 1200.0, pad_share: float = 0.35, square_nodes: int = SQUARE_NODES
) -> DataFrame:
    """For each leg (leg_id, from_lng, from_lat, to_lng, to_lat): cost, length in metres, the nodes in order, and a reason.

    Both ends snap to their nearest nodes, and cost is snap, weighted edges, snap. The search keeps to the box of both ends
    grown by ``pad_m`` metres or ``pad_share`` of their distance, whichever is more. A leg without a way has nulls and the
    reason ``no_snap`` or ``no_path``; others have no reason. Legs of equal keys are one leg. Legs of equal ends are searched
    once. A task that searches a square has no fewer legs than edges, unless it has them all, so that what is sent out follows
    the legs and the edges and not their product.
    """
    legs = stored(legs.dropDuplicates(["leg_id"]).select("leg_id", *_ENDS), "legs")
    found = _searched(legs, nodes, edges, snap_m, snaps, pad_m, pad_share, square_nodes)
    return legs.join(found, _ENDS, "left").select("leg_id", "cost", "length", "way", F.when(F.col("way").isNull(), F.coalesce("reason", F.lit("no_snap"))).alias("reason"))


def _searched(legs: DataFrame, nodes: DataFrame, edges: DataFrame, snap_m: float, snaps: int, pad_m: float, pad_share: float, square_nodes: int) -> DataFrame:
    """Ends, cost, length, way and reason of all pairs of ends that have snaps."""
    kinds = dict(legs.dtypes)["leg_id"], dict(nodes.dtypes)["node_id"]
    here = stored(nodes.select("node_id", "lng", "lat"), "here")
    weight = F.coalesce(lookup(F.col("kind"), WALKING_COST), F.lit(1.5))
    arcs = edges.select("a", "b", "length_m", weight.alias("rate"))
    for end in "ab":
        arcs = arcs.join(here.select(F.col("node_id").alias(end), F.col("lng").alias(f"{end}_lng"), F.col("lat").alias(f"{end}_lat")), end)
    arcs = stored(arcs, "arcs")
    parts = least_roots(arcs, "a", "b").select(F.col("node").alias("node_id"), "root")
    asked = legs.dropna(subset=_ENDS)
    places = asked.select(F.explode(F.array(*[F.struct(F.col(f"{p}_lng").alias("lng"), F.col(f"{p}_lat").alias("lat")) for p in ("from", "to")])).alias("place")).distinct()
    near = line_snap(places.select("place", "place.lng", "place.lat"), "place", here, snap_m, snaps).join(parts, "node_id", "left")
    near = stored(near.select("place.lng", "place.lat", "node_id", F.col("distance_m").alias("m"), F.coalesce("root", "node_id").alias("part")), "near")
    pad = F.greatest(F.lit(float(pad_m)), haversine_m(F.col("from_lng"), F.col("from_lat"), F.col("to_lng"), F.col("to_lat")) * pad_share)
    steep = F.greatest(F.cos(F.radians(F.greatest(F.abs("from_lat"), F.abs("to_lat")))), F.lit(0.01))

    def boxed(df: DataFrame, pad) -> DataFrame:
        up = F.degrees(pad / EARTH_M)
        return df.select(
            "*", (F.least("from_lng", "to_lng") - up / steep).alias("west"), (F.least("from_lat", "to_lat") - up).alias("south"),
            (F.greatest("from_lng", "to_lng") + up / steep).alias("east"), (F.greatest("from_lat", "to_lat") + up).alias("north"),
        )

    # A square holds a leg's box and its snaps, which may lie outside the box. It is no smaller than its cells, so two by two of them hold it.
    held = boxed(asked.groupBy(*_ENDS).agg(F.min("leg_id").alias("leg_id")), F.greatest(pad, F.lit(1.01 * snap_m)))
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")) / SQUARE_DEGREES)), F.lit(0)).cast("int")
    linked = stored(held.select("leg_id", *_ENDS, level.alias("level"), F.col("west").alias("left"), F.col("south").alias("below")), "linked")
    cell = lambda c: F.floor(F.col(c) / (SQUARE_DEGREES * F.pow(F.lit(2.0), F.col("level")))).cast("bigint")
    square = ["level", "cx", "cy"]
    levels = {r[0] for r in linked.select("level").distinct().collect()} | set(range(RAISED + 1))
    placed = lambda df, lng, lat, levels: df.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumn("cx", cell(lng)).withColumn("cy", cell(lat))
    squares = lambda df: df.withColumn("cx", F.explode(F.array(F.col("cx") - 1, F.col("cx")))).withColumn("cy", F.explode(F.array(F.col("cy") - 1, F.col("cy"))))
    summed = lambda df, lng, lat, levels, name: squares(placed(df, lng, lat, levels).groupBy(*square).count()).groupBy(*square).agg(F.sum("count").alias(name))
    full = stored(summed(here, "lng", "lat", levels, "held"), "full")
    fullest = {r[0]: r[1] for r in full.groupBy("level").agg(F.max("held")).collect()}
    base = max((k for k in range(RAISED + 1) if fullest.get(k, 0) <= square_nodes), default=0)
    levels = {max(k, base) for k in levels}
    linked = linked.withColumn("level", F.greatest("level", F.lit(base))).withColumn("cx", cell("left")).withColumn("cy", cell("below")).drop("left", "below")
    counted = linked.groupBy(*square).agg(F.count(F.lit(1)).alias("legs")).join(full, square, "left").join(summed(arcs, "a_lng", "a_lat", levels, "arcs"), square, "left")
    tasks = F.ceil(F.col("legs") / F.greatest(F.lit(SQUARE_LEGS), F.coalesce("arcs", F.lit(0)))).cast("int")
    counted = stored(counted.select(*square, "legs", "arcs", tasks.alias("tasks"), (F.coalesce("held", F.lit(0)) <= square_nodes).alias("near")), "squares")
    mine = linked.join(counted.where("near"), square).withColumn("task", F.pmod(F.xxhash64("leg_id"), F.col("tasks")).cast("int"))
    # One number for a square and a task, as rows sort by it; two of one number would only be searched together.
    number = (((F.col("level") * 2**16 + F.col("cx") + 2**15) * 2**16 + F.col("cy") + 2**15) * 2**16 + F.col("task")).alias("number")
    mine = boxed(mine, pad).select(number, *_ENDS, "west", "south", "east", "north")
    # Of an edge's squares those that hold both its ends.
    joint = placed(arcs, "a_lng", "a_lat", levels).withColumnsRenamed({"cx": "ax", "cy": "ay"}).withColumn("cx", cell("b_lng")).withColumn("cy", cell("b_lat")).where("abs(ax - cx) <= 1 and abs(ay - cy) <= 1")
    both = lambda a, b: F.explode(F.sequence(F.greatest(a, b) - 1, F.least(a, b)))
    joint = joint.withColumn("cx", both("ax", "cx")).withColumn("cy", both("ay", "cy"))
    each = counted.where("near").select(*square, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    dealt = lambda df, *columns: df.join(each, square).select(number, *columns)
    given = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        dealt(joint, "a", "b", F.col("length_m").alias("x"), F.col("rate").alias("y")),
        dealt(squares(placed(here, "lng", "lat", levels)), F.col("node_id").alias("a"), F.col("lng").alias("x"), F.col("lat").alias("y")),
        dealt(squares(placed(near, "lng", "lat", levels)), F.col("node_id").alias("a"), F.col("part").alias("b"), F.col("lng").alias("x"), F.col("lat").alias("y"), "m"),
    ])
    ways = f"from_lng double, from_lat double, to_lng double, to_lat double, cost double, length double, way array<{kinds[1]}>, reason string"
    shelves = min(4000, 2 * (counted.where("near").agg(F.sum("tasks")).first()[0] or 1))
    laid = lambda df: df.repartition(shelves, "number").groupBy("number")
    found = laid(mine).cogroup(laid(given)).applyInArrow(_search_square(to_arrow_schema(T.StructType.fromDDL(ways))), ways)
    far = linked.join(counted.where("not near"), square, "left_semi").select("leg_id", *_ENDS)
    ends = near.groupBy("lng", "lat").agg(F.collect_list(F.struct("node_id", "m", "part")).alias("near"))
    at = lambda p: ends.select(F.col("lng").alias(f"{p}_lng"), F.col("lat").alias(f"{p}_lat"), F.col("near").alias(p))
    far = stored(far.join(at("from"), [*_ENDS[:2]]).join(at("to"), [*_ENDS[2:]]), "far")
    if far.limit(1).count():
        meets = lambda mine, other: F.filter(mine, lambda x: F.exists(other, lambda y: x["part"] == y["part"]))
        joined = boxed(far.withColumn("starts", meets("from", "to")).withColumn("goals", meets("to", "from")).where(F.size("starts") > 0), pad)
        arcs = arcs.withColumn("w", F.col("length_m") * F.col("rate")).drop("rate")
        back = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "length_m", "w", F.col("b_lng").alias("a_lng"), F.col("b_lat").alias("a_lat"), F.col("a_lng").alias("b_lng"), F.col("a_lat").alias("b_lat"))
        walked = _by_blocks(joined.select("leg_id", "starts", "goals", "west", "south", "east", "north"), here, arcs.unionByName(back), kinds)
        walked = far.select("leg_id", *_ENDS).join(walked, "leg_id", "left").withColumn("reason", F.when(F.col("way").isNull(), "no_path"))
        found = found.unionByName(walked.drop("leg_id"))
    return found


def _by_blocks(far: DataFrame, here: DataFrame, arcs: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """leg_id, cost, length, way of legs (leg_id, starts, goals, box) whose squares are too full for one task."""
    schema = _REACHED.format(leg=kinds[0], node=kinds[1])
    form = T.StructType.fromDDL(schema)
    here = here.select("node_id", _block("lng", "lat").alias("block"))
    arcs = stored(arcs.withColumn("block", _block("a_lng", "a_lat")).withColumn("b_block", _block("b_lng", "b_lat")), "blocks")
    boxes = far.select("leg_id", "west", "south", "east", "north")
    goals = stored(far.select("leg_id", F.explode("goals").alias("g")).select("leg_id", "g.node_id", F.col("g.m").alias("last")), "goals")
    start = far.select("leg_id", F.explode("starts").alias("s")).select("leg_id", "s.node_id", F.col("s.m").alias("cost")).join(here, "node_id")
    reached = start.select("leg_id", "node_id", "block", "cost", F.lit(0.0).alias("length"), F.lit(None).cast(kinds[1]).alias("prev"), F.lit(True).alias("came"))
    reached, settled = stored(reached.dropDuplicates(["leg_id", "node_id"]), "reached"), []
    while reached.limit(1).count():
        at = reached.where("came").select("leg_id", "block").distinct()
        parts = at.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / LEGS_A_TASK).cast("int").alias("parts"))
        asked = reached.join(at, ["leg_id", "block"], "left_semi").join(boxes, "leg_id").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("leg_id"), F.col("parts")).cast("int")).drop("parts")
        dealt = arcs.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select(F.col("block").alias("of_block"), F.col("part").alias("of_part"), "a", "b", "b_block", "w", "length_m", "b_lng", "b_lat")
        found = asked.groupBy("block", "part").cogroup(dealt.groupBy("of_block", "of_part")).applyInArrow(_search(to_arrow_schema(form)), schema)
        both = reached.withColumn("came", F.lit(False)).unionByName(found)
        best = both.groupBy("leg_id", "node_id").agg(F.min_by(F.struct("block", "cost", "length", "prev", "came"), F.struct("cost", "came", "prev")).alias("r")).select("leg_id", "node_id", "r.*")
        bound = best.join(goals, ["leg_id", "node_id"]).groupBy("leg_id").agg(F.min(F.col("cost") + F.col("last")).alias("bound"))
        best = best.join(bound, "leg_id", "left").withColumn("came", F.col("came") & (F.col("bound").isNull() | (F.col("cost") < F.col("bound")))).drop("bound")
        # Legs on which nothing new has come are done; their rows are not carried on.
        best = stored(best, "best", after=(reached,))
        going = best.where("came").select("leg_id").distinct()
        settled.append(stored(best.join(going, "leg_id", "left_anti"), "settled"))
        reached = stored(best.join(going, "leg_id", "left_semi"), "reached", after=(best,))
    reached = reduce(lambda a, b: a.unionByName(b), settled)
    done = goals.join(reached, ["leg_id", "node_id"]).groupBy("leg_id").agg(
        F.min_by(F.struct((F.col("cost") + F.col("last")).alias("cost"), "length", "node_id"), F.struct(F.col("cost") + F.col("last"), "node_id")).alias("r")
    ).select("leg_id", "r.*")
    done = stored(done, "done")
    walked, shelves = f"leg_id {kinds[0]}, way array<{kinds[1]}>, at {kinds[1]}", max(1, -(-done.count() // LEGS_A_TASK))
    ways, walking = [], stored(done.select("leg_id", F.col("node_id").alias("at")), "walking")
    while walking.limit(1).count():
        block = reached.select("leg_id", F.col("node_id").alias("at"), "block")
        rows = walking.join(block, ["leg_id", "at"]).join(reached.select("leg_id", "block", "node_id", "prev"), ["leg_id", "block"])
        step = rows.groupBy(F.pmod(F.xxhash64("leg_id"), F.lit(shelves)).alias("shelf")).applyInArrow(_walk(to_arrow_schema(T.StructType.fromDDL(walked))), walked)
        step = stored(step.withColumn("turn", F.lit(len(ways))), "step")
        forget(walking)
        ways.append(step)
        walking = stored(step.where("at is not null").select("leg_id", "at"), "walking")
    way = reduce(lambda a, b: a.unionByName(b), ways, done.select("leg_id", F.array().cast(f"array<{kinds[1]}>").alias("way"), F.lit(None).cast(kinds[1]).alias("at"), F.lit(-1).alias("turn")))
    ordered = F.reverse(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "way"))), lambda x: x["way"])))
    return done.drop("node_id").join(way.groupBy("leg_id").agg(ordered.alias("way")), "leg_id").select("leg_id", "cost", "length", "way")
