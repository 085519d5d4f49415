"""Small helpers shared by the operators: column hygiene, distributed ranks, sieves."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one group of a distributed rank may hold, about.
RANK_CHUNK_ROWS = 20_000
#: Bits of a sieve, per value and at most.
SIEVE_BITS, SIEVE_MOST = 32, 1 << 27


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add, whatever their case, so that names never clash."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that the table does not have, whatever its case, for columns of an operator's own."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def put_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the named columns under fresh names, and how to rename them back."""
    aside = dict(zip(names, fresh(df, *(f"aside_{n}" for n in names))))
    return df.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in df.columns]), {new: old for old, new in aside.items()}


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator name its own columns with two underscores: the caller's columns of such names step aside meanwhile."""
    signature = inspect.signature(operator)

    @functools.wraps(operator)
    def run(*args, **more) -> DataFrame:
        bound = signature.bind(*args, **more)
        docs, taken = bound.arguments["docs"], [c for c in bound.arguments["docs"].columns if c.startswith("__")]
        if not taken:
            return operator(*bound.args, **bound.kwargs)
        bound.apply_defaults()
        bound.arguments["docs"], back = put_aside(docs, taken)
        renamed = {old: new for new, old in back.items()}
        for name in ("key", "text"):
            if name in bound.arguments:
                bound.arguments[name] = renamed.get(bound.arguments[name], bound.arguments[name])
        return operator(*bound.args, **bound.kwargs).withColumnsRenamed(back)

    return run


def gapless_slots(df: DataFrame, group: str, order: str, rows: int, name: str) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, and without gathering a group in one task.

    Rows are dealt into chunks by a hash of ``order``; a chunk is ranked on its own and shifted by the rows that
    the group has in earlier chunks. A chunk grows neither with the table nor with a hot group. Rows that share
    one value of ``order`` share a chunk, so ``order`` should be a key. The caller keeps columns of two underscores free.
    """
    chunks = max(1, -(-rows // RANK_CHUNK_ROWS))
    df = df.withColumn("__chunk", F.pmod(F.xxhash64(F.col(order)), F.lit(chunks)))
    before = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(group, "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .drop("__rows")
    )
    within = Window.partitionBy(group, "__chunk").orderBy(order)
    ranked = df.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, [group, "__chunk"]).withColumn(
        name, (F.col("__rank") + F.col("__offset")).cast("long")
    ).drop("__chunk", "__rank", "__offset")


def least_hashed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, those with the least key hashes: a sample of bounded size that does not depend on partitions.

    Rows are thinned to twice as many before they are ordered, so no task sends more than its share.
    """
    total = df.count()
    h = F.xxhash64(F.col(key))
    thin = df.where(F.pmod(h, F.lit(max(1, total))) < 2 * rows)
    return thin.orderBy(F.pmod(h, F.lit(max(1, total))), key).limit(rows)


def sieve(df: DataFrame, column: str) -> np.ndarray:
    """A bit table in which the places of all values of a long column are set: of bounded size, whatever their number."""
    bits = 1 << 16
    while bits < min(SIEVE_MOST, SIEVE_BITS * df.count()):
        bits <<= 1
    at, bit = F.shiftright(F.pmod(F.col(column), F.lit(bits)), 5), F.pmod(F.col(column), F.lit(32)).cast("int")
    words = df.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("mask")).toArrow()
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[words.column("at").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return table
