"""Positions in a total order, without sending all rows through one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.scratch import stored

#: Rows of a range, about: a task ranks one range, so the ranges follow the rows.
RANGE_ROWS = 250_000


def positions(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``rows`` with their position from 1 in ascending ``order``, which has to tell all rows apart; nulls come first.

    Rows are dealt into ranges of the order and stored with the number of their range, so that what is counted holds however
    often they are read; each range is ranked by itself, on from the counts of those before it.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__at", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = stored(keyed.repartitionByRange(ranges, "__at").withColumn("__range", F.spark_partition_id()), "ranges")
    counts = {r["__range"]: r["count"] for r in dealt.groupBy("__range").count().collect()}  # a row a range
    before = accumulate((counts.get(k, 0) for k in range(ranges)), initial=0)
    offsets = spark.createDataFrame(list(zip(range(ranges), before)), "__of int, __before bigint")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__at"))
    ranked = dealt.withColumn("__rank", rank).join(offsets, F.col("__range") == F.col("__of"))
    return ranked.withColumn(name, F.col("__rank") + F.col("__before")).drop("__at", "__range", "__of", "__before", "__rank")
