"""Prominence of summits from a raster.

A peak's key saddle is the best of all ways to any better-ranked peak, a way counting by its lowest cell. Cells join in
steps of a threshold grid, so only the first threshold at or below the saddle matters. The raster is cut into square blocks.
A task reduces its block to a merge tree over the block's edge cells and the peaks that are still open, which keeps how well
each of them reaches each other; a peak that meets a better one before it reaches the edge is settled there. Then four by
four trees merge in one task, cells on the seams link up, and so on until one tree covers the raster: the rounds follow the
logarithm of its width, and a task holds some times the edge of its block, whatever the terrain.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.operators.ranks import positions
from tarnspark.scratch import stored

NO_DATA = -1000
#: Cells along a block's side, and by how many times the side grows from round to round.
BLOCK, GROWTH = 128, 4
NODE, LINK, PEAK, SETTLED = range(4)
#: Rows of the reduction: a cell (u, t its band), a link (u, v, t), an open peak on a cell (u, peak, ele), a settled one (peak, t).
_ROWS = "kind int, u long, v long, t double, peak long, ele double"


def threshold_grid(low: float, high: float, step: float, floor: float) -> list[float]:
    """Thresholds from the highest multiple of the step down to above ``max(floor, low) - step``."""
    start, stop = math.floor(high / step) * step, max(floor, low) - step
    return [start - k * step for k in range(max(0, math.ceil((start - stop) / step)))]


def _order(*fields: np.ndarray) -> np.ndarray:
    """Places in the order of the fields (whole numbers from 0), the first before the others; by one packed key where that fits."""
    bits = [int(f.max(initial=0)).bit_length() for f in fields]
    if sum(bits) > 62:
        return np.lexsort(fields[::-1])
    key = fields[0].astype(np.int64)
    for f, b in zip(fields[1:], bits[1:]):
        key = (key << b) | f
    return np.argsort(key, kind="stable")


def contracted(n: int, u: np.ndarray, v: np.ndarray, depth: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between fixed nodes that keep how well these reach each other (``depth`` is a rank, 0 the best link).

    A node that is not fixed joins the neighbour of its best link: no way through it is worse by that neighbour. Each round
    all such nodes join at once; links have an order without ties, so only two of them can choose each other.
    """
    while True:
        apart = u != v
        u, v, depth = np.minimum(u, v)[apart], np.maximum(u, v)[apart], depth[apart]
        by = _order(u, v, depth)
        u, v, depth = u[by], v[by], depth[by]
        first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])) if len(u) else np.zeros(0, dtype=bool)
        u, v, depth = u[first], v[first], depth[first]
        x, y, link = np.concatenate((u, v)), np.concatenate((v, u)), np.tile(np.arange(len(u)), 2)
        moving = ~fixed[x]
        if not moving.any():
            return u, v, depth
        x, y, link = x[moving], y[moving], link[moving]
        by = _order(x, depth[link], link)
        x, y = x[by], y[by]
        first = np.append(True, x[1:] != x[:-1])
        onto = np.arange(n)
        onto[x[first]] = y[first]
        both = np.flatnonzero((onto[onto] == np.arange(n)) & (onto > np.arange(n)))
        onto[both] = both
        while (further := onto[onto]).tobytes() != onto.tobytes():
            onto = further
        u, v = onto[u], onto[v]


def settled(n: int, u: np.ndarray, v: np.ndarray, t: np.ndarray, edge: np.ndarray, rank: np.ndarray):
    """(links kept, peaks settled): u, v, t between edge nodes and open peaks, and (node, saddle) of the others.

    ``rank`` is a node's rank as a peak, -1 without one. Links are taken from the best on; where two areas meet, the lower
    of their peaks is settled if its area does not touch the edge.
    """
    heights, depth = np.unique(-t, return_inverse=True)
    a, b, depth = contracted(n, u, v, depth, edge | (rank >= 0))
    root, touches, top = list(range(n)), edge.tolist(), rank.tolist()
    node_of, kept, done = {r: k for k, r in enumerate(top) if r >= 0}, [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by = np.argsort(depth, kind="stable")
    for x, y, d in zip(a[by].tolist(), b[by].tolist(), depth[by].tolist()):
        low, high = find(x), find(y)
        if low == high:
            continue
        kept.append((x, y, d))
        if top[low] > top[high]:
            low, high = high, low
        if top[low] >= 0 and not touches[low]:
            done.append((node_of[top[low]], -heights[d]))
        root[low] = high
        touches[high] = touches[high] or touches[low]
    found = np.array(kept, dtype=np.int64).reshape(-1, 3)
    still = edge | (rank >= 0)
    still[[k for k, _ in done]] = edge[[k for k, _ in done]]
    a, b, depth = contracted(n, *found.T, still)
    return (a, b, -heights[depth]), done


def _reduce(width: int, height: int, side: int, last: bool, least: float) -> Callable[[pa.Table], pa.Table]:
    def reduce(block: pa.Table) -> pa.Table:
        kind, u, v, t, peak, ele = (block.column(n).to_numpy() for n in ("kind", "u", "v", "t", "peak", "ele"))
        at = np.flatnonzero(kind == NODE)
        at = at[np.lexsort((-t[at], u[at]))]
        cells, first = np.unique(u[at], return_index=True)
        band = t[at][first]
        row, col = cells // width, cells % width
        place = lambda c: np.searchsorted(cells, c)
        links = [(place(u[kind == LINK]), place(v[kind == LINK]), t[kind == LINK])]
        for step in (1, width):
            beside = np.minimum(place(cells + step), len(cells) - 1)
            met = (cells[beside] == cells + step) & ((step > 1) | (col < width - 1) | (width == 1))
            links.append((np.flatnonzero(met), beside[met], np.minimum(band[met], band[beside[met]])))
        a, b, depth = (np.concatenate(x) for x in zip(*links))
        near = depth > least
        # A cell on the raster's own border has no neighbour in another block.
        beyond = lambda at, size: (at % side == 0) & (at > 0) | (at % side == side - 1) & (at < size - 1)
        edge = beyond(row, height) | beyond(col, width)
        tops = np.flatnonzero(kind == PEAK)
        tops = tops[np.lexsort((-peak[tops], ele[tops]))]
        rank, owner = np.full(len(cells), -1), np.zeros(len(cells), dtype=np.int64)
        rank[place(u[tops])], owner[place(u[tops])] = np.arange(len(tops)), tops
        (a, b, depth), done = settled(len(cells), a[near], b[near], depth[near], edge, rank)
        gone = np.array([k for k, _ in done], dtype=np.int64)
        rank[gone], open_ = -1, np.zeros(0, dtype=np.int64)
        if not last:
            open_ = np.flatnonzero(rank >= 0)
        stay = np.flatnonzero(edge | ((rank >= 0) & (not last)))
        sizes = [len(stay), len(a), len(open_), len(gone)]
        none, blank = (lambda m: np.zeros(m, dtype=np.int64)), (lambda m: np.zeros(m))
        if last:
            a, b, depth, sizes[1] = a[:0], b[:0], depth[:0], 0
        return pa.table({
            "kind": np.repeat(np.arange(4, dtype=np.int32), sizes),
            "u": np.concatenate((cells[stay], cells[a], cells[open_], none(sizes[3]))),
            "v": np.concatenate((none(sizes[0]), cells[b], none(sizes[2] + sizes[3]))),
            "t": np.concatenate((band[stay], depth, blank(sizes[2]), np.array([s for _, s in done]))),
            "peak": np.concatenate((none(sizes[0] + sizes[1]), peak[owner[open_]], peak[owner[gone]])),
            "ele": np.concatenate((blank(sizes[0] + sizes[1]), ele[owner[open_]], blank(sizes[3]))),
        })

    return reduce


def prominence(snapped: DataFrame, dem: DataFrame, step: float = 20.0, floor: float = 0.0, block: int = BLOCK) -> DataFrame:
    """peak_id and prom for peaks (peak_id, row, col, ele) on a raster (row, col, z); the rank is height, then peak_id.

    A peak that never meets a better one has its height over the lowest cell; so has a peak outside the raster. Of peaks on
    one cell all but the best meet it at the cell's own threshold. A raster without heights gives nulls. Rows and columns
    count from 0 or more; of repeated cells the highest counts.
    """
    cells = dem.where(F.col("z") > NO_DATA)
    low, width, height = cells.agg(F.min("z"), F.max("col") + 1, F.max("row") + 1).first()
    if low is None:
        return snapped.select("peak_id", F.lit(None).cast("double").alias("prom"))
    ident = F.col("row").cast("bigint") * width + F.col("col")
    least = max(floor, float(low)) - step
    nothing, blank = F.lit(0).cast("bigint"), F.lit(0.0)
    band = (F.floor(F.col("z") / step) * step).cast("double")
    nodes = cells.select(F.lit(NODE).alias("kind"), ident.alias("u"), nothing.alias("v"), band.alias("t"), nothing.alias("peak"), blank.alias("ele"))
    inside = F.col("row").isNotNull() & F.col("col").between(0, width - 1)
    peaks = snapped.select("peak_id", F.col("ele").cast("double").alias("ele"), F.when(inside, ident).alias("u"))
    peaks = stored(peaks.join(nodes.groupBy("u").agg(F.max("t").alias("band")), "u", "left"), "peaks")
    rank = F.struct(F.col("ele").alias("ele"), (-F.col("peak_id")).alias("tie"))
    tops = stored(peaks.where("band is not null").groupBy("u").agg(F.max(rank).alias("top")), "tops")
    beside = peaks.where("band is not null").join(tops, "u").where(rank < F.col("top")).select("peak_id", F.col("band").alias("saddle")).where(F.col("saddle") > least)
    top = tops.select(F.lit(PEAK).alias("kind"), "u", nothing.alias("v"), blank.alias("t"), (-F.col("top.tie")).cast("bigint").alias("peak"), F.col("top.ele").alias("ele"))
    rows, saddles, side = nodes.unionByName(top), beside, block
    while True:
        last = side >= max(width, height)
        at = (F.floor(F.floor(F.col("u") / width) / side), F.floor(F.col("u") % width / side))
        rows = stored(rows.groupBy(at[0].alias("block_row"), at[1].alias("block_col")).applyInArrow(_reduce(width, height, side, last, least), _ROWS), "blocks")
        saddles = saddles.unionByName(rows.where(F.col("kind") == SETTLED).select(F.col("peak").alias("peak_id"), F.col("t").alias("saddle")))
        if last:
            break
        rows, side = rows.where(F.col("kind") < SETTLED), side * GROWTH
    height = F.when(F.col("saddle").isNull(), F.col("ele") - float(low)).otherwise(F.greatest(F.lit(0.0), F.col("ele") - F.col("saddle")))
    return peaks.join(saddles, "peak_id", "left").select("peak_id", F.round(height, 1).alias("prom"))


def prominence_report(scores: DataFrame) -> DataFrame:
    """Scored peaks, the highest, and the elements n/2 and n/10 of the descending list."""
    total = scores.agg(F.count(F.lit(1)).alias("n"), F.max("prom").alias("max"))
    ranked = positions(scores, [F.col("prom").isNull(), -F.col("prom"), F.col("peak_id")], "r").withColumn("r", F.col("r") - 1)
    picked = ranked.crossJoin(F.broadcast(total)).groupBy("n", "max").agg(
        F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("prom"))).alias("median"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 10), F.col("prom"))).alias("p90")
    )
    return picked


def prom_attach(peaks: DataFrame, scores: DataFrame) -> DataFrame:
    """Peaks with ``prom`` where scored; an older value stays otherwise."""
    new = scores.select("peak_id", F.col("prom").alias("__new"))
    had = F.col("prom") if "prom" in peaks.columns else F.lit(None).cast("double")
    return peaks.join(new, "peak_id", "left").withColumn("prom", F.coalesce("__new", had)).drop("__new")
