"""Connected components and pointer forests, in rounds that follow the logarithm of the longest path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.scratch import forget, stored

#: What is left of a loop is settled in one task once it has no more rows than this (some tens of megabytes there).
ONE_TASK_ROWS = 1_000_000


def least_roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the least node it reaches, for every node that reaches a lesser one.

    In each round every node that has a lesser neighbour joins the least of them; these pointers only fall, so they form
    trees, and each tree becomes its least node. A node that nobody joins in one round joins a lesser one in the next, for
    all its neighbours have done so: what is left at least halves in two rounds, and so do the edges between it. Self-loops
    and rows with a null end are ignored; an empty table gives an empty result. Every round is written to the shared
    folder; ``ONE_TASK_ROWS`` edges or fewer are settled at once. Hubs cost rows, not tasks: their neighbours are only
    aggregated.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    rounds = []
    while now.count() > ONE_TASK_ROWS:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joins = both.groupBy("u").agg(F.min("v").alias("parent")).where("parent < u").select(F.col("u").alias("node"), "parent")
        trees = tree_roots(joins)
        rounds.append(trees)
        name = lambda c: trees.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = now.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("u_root", "u").alias("x"), F.coalesce("v_root", "v").alias("y"))
        now = stored(moved.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v").distinct(), "links", after=(now,))
    found = stored(at_once(now, _components, ("node", "root")), "roots", after=(now,))
    while rounds:  # from the last round to the first, so that each is joined with what its roots became
        trees = rounds.pop()
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        became = trees.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        found = stored(became.unionByName(found.select("node", "root")), "roots", after=(trees, found))
    return found.select("node", "root")


def tree_roots(parents: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every row (node, parent) of a forest; roots have no row. A pointer that leads back raises.

    Pointers jump to their parent's parent until a round moves none; the last rounds are taken at once. In a forest each round
    has fewer to move, as those of the least depth have arrived; where none arrives, a cycle is left.
    """
    now = stored(parents.select("node", F.col("parent").alias("root"), F.lit(True).alias("moved")), "pointers")
    left, before = now.count(), -1
    if left <= ONE_TASK_ROWS:
        found = stored(at_once(now.select("node", "root"), _roots, ("node", "root")), "pointers")
        forget(now)
        return found
    while left:
        if left == before:
            raise RuntimeError(_BACK)
        up = now.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = now.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        now = stored(jumped, "pointers", after=(now,))
        left, before = now.where("moved").count(), left
    return now


_BACK = "pointers lead back to where they began"


def at_once(pairs: DataFrame, settle, names: tuple[str, str]) -> DataFrame:
    """``settle(u, v)`` over the codes of a small table of two like columns, in one task; it returns pairs of codes.

    Codes follow the order of the values, so the least code is the least value.
    """
    kind = pairs.schema.fields[0].dataType

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        read = lambda k: np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held])
        u, v = read(0), read(1)
        values, codes = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = settle(codes[: len(u)], codes[len(u) :], len(values))
        yield pa.record_batch([pa.array(values[a], held[0].schema.field(0).type), pa.array(values[b], held[0].schema.field(0).type)], names=list(names))

    return pairs.coalesce(1).mapInArrow(whole, T.StructType([T.StructField(n, kind) for n in names]))


def jumped(up: np.ndarray) -> np.ndarray:
    """The roots of a forest of pointers, in which a root points to itself."""
    for _ in range(len(up).bit_length() + 1):
        further = up[up]
        if np.array_equal(further, up):
            return up
        up = further
    raise RuntimeError(_BACK)


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least of ``n`` nodes that each one reaches."""
    label = np.arange(n)
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        u, v = low[low < high], high[low < high]
        np.minimum.at(label, v, u)
        label = jumped(label)
    return label


def _components(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    label = least_labels(u, v, n)
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def _roots(node: np.ndarray, parent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.arange(n)
    up[node] = parent
    root = jumped(up)
    if (up[root] != root).any() or (node == parent).any():
        raise RuntimeError(_BACK)
    return node, root[node]
