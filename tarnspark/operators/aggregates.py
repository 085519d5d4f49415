"""First-wins deduplication, reports and small aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.geo import EARTH_M


def mark_first(df: DataFrame, keys: list[str], order: str, when: Column | None = None) -> DataFrame:
    """``is_first`` is true for the first row of each key by ``order``, and for rows with a null key or where ``when`` is false.

    Firsts are an aggregate that is joined back, so a key that many rows share is not gathered. ``order`` tells rows apart.
    """
    test = F.coalesce(F.lit(True) if when is None else when, F.lit(False))
    for k in keys:
        test = test & F.col(k).isNotNull()
    firsts = df.where(test).groupBy(*keys).agg(F.min(order).alias("__first"))
    open_ = df.where(test).join(firsts, keys).withColumn("is_first", F.col(order) == F.col("__first"))
    return open_.select(*df.columns, "is_first").unionByName(df.where(~test).select(*df.columns, F.lit(True).alias("is_first")))


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; rows with a null in the key are all kept.

    The first row is the least (order, row) struct of an aggregate, which combines before the shuffle, so a key that
    many rows share never gathers them in one task.
    """
    whole = F.struct(F.col(order).alias("__order"), *[F.col(f"`{c}`") for c in df.columns])
    known = [F.col(k).isNotNull() for k in keys]
    test = known[0]
    for k in known[1:]:
        test = test & k
    firsts = df.where(test).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, F.col(order)).alias("__row"))
    return firsts.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns]).unionByName(df.where(~test))


def place_dedupe(places: DataFrame) -> DataFrame:
    """One place per name, kind and position to 4 decimals: the first."""
    near = places.withColumn("__lat", F.round("lat", 4)).withColumn("__lon", F.round("lon", 4))
    return first_by_key(near, ["name", "kind", "__lat", "__lon"], "src_ord").drop("__lat", "__lon")


def normalize_report(classified: DataFrame) -> DataFrame:
    """Rows per outcome: kept by kind, dropped by reason."""
    return classified.groupBy(
        F.coalesce("reason", F.lit("kept")).alias("outcome"), F.coalesce("kind", F.lit("")).alias("kind")
    ).agg(F.count(F.lit(1)).alias("n"))


def unreadable_topk(rejected: DataFrame, value: str, order: str, k: int = 8) -> DataFrame:
    """The most frequent unreadable values, ties by first seen."""
    counted = rejected.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(k)


def place_report(places: DataFrame) -> DataFrame:
    return places.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def latest_record(log: DataFrame, key: str, updated: str, created: str, empty: Column) -> DataFrame:
    """The newest record of each key with its first creation time; records without content are refused."""
    whole = F.struct(*[F.col(c) for c in log.columns if c not in (key, created)])
    newest = log.where(~empty).groupBy(key).agg(F.max_by(whole, F.struct(updated, *[c for c in log.columns if c not in (key, updated)])).alias("r"), F.min(created).alias(created))
    return newest.select(key, "r.*", created)


def fold_bounds(points: DataFrame, key: str, pad_m: float = 0.0) -> DataFrame:
    """Each key's bounding box, grown by ``pad_m`` metres on every side."""
    box = points.groupBy(key).agg(F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"))
    if not pad_m:
        return box
    up = math.degrees(pad_m / EARTH_M)
    side = F.lit(up) / F.greatest(F.lit(0.01), F.cos(F.radians((F.col("s") + F.col("n")) / 2)))
    return box.select(key, (F.col("w") - side).alias("w"), (F.col("s") - up).alias("s"), (F.col("e") + side).alias("e"), (F.col("n") + up).alias("n"))


def quality_checks(data: DataFrame, rules: list[tuple[str, Column, str, float]]) -> DataFrame:
    """One row per rule (name, aggregate, relation, bound): its value and whether it holds. One pass over the data."""
    row = data.agg(*[value.cast("double").alias(f"v{i}") for i, (_, value, _, _) in enumerate(rules)])
    holds = {">=": lambda v, b: v >= b, "<=": lambda v, b: v <= b, "=": lambda v, b: v == b}
    checks = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(holds[rel](F.col(f"v{i}"), F.lit(bound)), F.lit(False)).alias("ok"), F.col(f"v{i}").alias("value"))
        for i, (name, _, rel, bound) in enumerate(rules)
    ]
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def name_checks(data: DataFrame, rules: DataFrame, name: str = "name", value: str = "value", order: str = "src_ord", prefix: bool = True, pick: str = "first") -> DataFrame:
    """rule, status, value and expected: known things found by name, held against what is known of them.

    ``rules`` has rule, name, expected and tolerance. A row answers every rule whose name its own begins with, or equals if not
    ``prefix``; rows without a value answer none. Of a rule's answers the first by ``order`` counts, or with ``pick="max"`` the
    greatest. ``status`` is ``ok`` within the tolerance, ``fail`` beyond it, and ``skip`` where nothing answers. Names are cut at
    the lengths that occur among the rules and joined on equal text, so a name meets only rules that it answers.
    """
    known = rules.select("rule", F.col("name").alias("__name"), "expected", "tolerance")
    held = data.where(F.col(value).isNotNull() & F.col(name).isNotNull()).select(F.col(name).alias("__full"), F.col(value).cast("double").alias("__value"), F.col(order).alias("__at"))
    if prefix:
        lengths = known.agg(F.sort_array(F.collect_set(F.length("__name"))).alias("__lengths"))  # one row, no longer than a name
        cut = F.transform(F.filter("__lengths", lambda n: n <= F.length("__full")), lambda n: F.left("__full", n))
        held = held.crossJoin(F.broadcast(lengths)).select(F.explode(cut).alias("__name"), "__value", "__at")
    else:
        held = held.withColumnRenamed("__full", "__name")
    best = F.max("__value") if pick == "max" else F.min_by("__value", "__at")
    found = held.join(known.select("rule", "__name"), "__name").groupBy("rule").agg(best.alias("value"))
    near = F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance")
    status = F.when(F.col("value").isNull(), "skip").when(near, "ok").otherwise("fail")
    return known.join(found, "rule", "left").select("rule", status.alias("status"), "value", F.col("expected").cast("double").alias("expected"))


def kind_checks(data: DataFrame, rules: DataFrame, kind: str = "kind", shape: str = "geom_type") -> DataFrame:
    """rule, status and n, the rows of the rule's kind: enough of them, or just as many, and all of the shape asked for.

    ``rules`` has rule, kind, least, exactly and shape; a null asks for nothing, a null kind means all rows. Where ``exactly``
    is asked for and there is no row at all, the rule is skipped: the extract does not hold the kind.
    """
    per = data.groupBy(F.col(kind).alias("kind"), F.col(shape).alias("__shape")).agg(F.count(F.lit(1)).alias("__n"))
    per = per.withColumn("kind", F.explode(F.array_distinct(F.array(F.col("kind"), F.lit(None)))))  # null stands for all
    asked = rules.select("rule", F.col("kind").alias("__kind"), "least", "exactly", "shape")
    met = asked.join(per, F.col("__kind").eqNullSafe(F.col("kind")), "left")
    n = met.groupBy("rule", "least", "exactly", "shape").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("__shape").eqNullSafe(F.col("shape")), F.col("__n"))), F.lit(0)).alias("__other")
    )
    fails = (F.col("n") < F.col("least")) | (F.col("n") != F.col("exactly")) | (F.col("shape").isNotNull() & (F.col("__other") > 0))
    status = F.when(F.col("exactly").isNotNull() & (F.col("n") == 0), "skip").when(F.coalesce(fails, F.lit(False)), "fail").otherwise("ok")
    return n.select("rule", status.alias("status"), "n")
