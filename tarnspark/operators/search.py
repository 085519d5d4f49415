"""Place and region search as joins on a token table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.functions.geo import planar_dist2
from tarnspark.functions.naming import fold_text
from tarnspark.scratch import stored

#: Prefixes are keys of up to so many characters, what is longer is compared; region names are cut into pieces of up to PIECE.
PREFIX, PIECE = 8, 3
#: A key that more places hold is asked for by cells, in rings of growing reach (in degrees; the last one holds the world).
COMMON, RINGS = 2_000, (0.25, 2.0, 16.0, 400.0)
#: Degrees along the side of a cell in which the index counts its keys.
CELL = 0.25

_WORDS = r"(?U)[^\p{Alnum}]+"


def words(text: Column) -> Column:
    """The folded words of a text, in order."""
    return F.filter(F.split(fold_text(text), _WORDS, -1), lambda t: t != "")


def phrases(text: Column) -> Column:
    """A query's phrases, each an array of words: what stands between blanks and ``"*()-:^``; ``fillan's`` is two words in a row."""
    parts = F.split(F.regexp_replace(text, r'["*()\-:^]', " "), r"(?U)\s+", -1)
    return F.filter(F.transform(parts, words), lambda p: F.size(p) > 0)


def place_index(places: DataFrame) -> DataFrame:
    """The positional index of ``places`` (place_id, name, lat, lon), stored: key, place_id, words, lat, lon, cx, cy.

    A place has a row for each of its words, marked with "=", and for each of their first 1 to ``PREFIX`` characters, marked
    with "^". ``words`` are all its words in order, and cx, cy its cell.
    """
    named = places.select("place_id", words(F.col("name")).alias("words"), "lat", "lon", *[F.floor(F.col(c) / CELL).cast("int").alias(n) for c, n in (("lon", "cx"), ("lat", "cy"))])
    heads = F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.lit(PREFIX))), lambda i: F.concat(F.lit("^"), F.left(w, i)))))
    keys = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("="), w)), heads))
    return stored(named.select(F.explode(keys).alias("key"), "place_id", "words", "lat", "lon", "cx", "cy"), "place-index")


def _matches(met: DataFrame) -> DataFrame:
    """Rows of queries and places in whose words all phrases occur, the last one with its last word as a prefix."""
    at = "sequence(0, size(words) - size(p))"
    whole = f"forall(rest, p -> size(words) >= size(p) AND exists({at}, i -> slice(words, i + 1, size(p)) = p))"
    begun = f"""exists(transform(array(last), p -> p), p -> size(words) >= size(p) AND exists({at}, i ->
      slice(words, i + 1, size(p) - 1) = slice(p, 1, size(p) - 1) AND startswith(get(words, i + size(p) - 1), element_at(p, -1))))"""
    distance2 = planar_dist2(F.col("qlon"), F.col("qlat"), F.col("lon"), F.col("lat"))
    return met.where(F.expr(begun) & F.expr(whole)).select("query_id", "place_id", distance2.alias("distance2"))


def place_search(queries: DataFrame, places: DataFrame, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """The k best places for each query: all its phrases occur, the last as a prefix; near ones first, then by rank.

    ``queries`` has query_id, text, lon, lat; ``places`` has place_id, name, kind, lat, lon, rank; ``index`` is their
    ``place_index``, made here if it is not given. A query without words finds nothing. A query meets the places that hold the
    rarest of its keys, if these are ``COMMON`` at most. Otherwise it goes out in rings, and in a ring only into cells that
    hold all its keys, where it meets the holders of the key that is rarest there.
    """
    index = place_index(places) if index is None else index
    asked = queries.select("query_id", phrases(F.col("text")).alias("all"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat")).where(F.size("all") > 0)
    asked = asked.select("query_id", "qlon", "qlat", F.get("all", F.size("all") - 1).alias("last"), F.slice("all", 1, F.greatest(F.size("all") - 1, F.lit(0))).alias("rest"))
    exact = F.concat(F.flatten("rest"), F.slice("last", 1, F.greatest(F.size("last") - 1, F.lit(0))))
    keys = F.array_append(F.transform(exact, lambda w: F.concat(F.lit("="), w)), F.concat(F.lit("^"), F.left(F.get("last", F.size("last") - 1), F.lit(PREFIX))))
    asked = stored(asked.withColumn("keys", F.array_sort(F.array_distinct(keys))), "asked")
    wanted = asked.select("query_id", F.explode("keys").alias("key"))
    held = index.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(held, "key", "left").groupBy("query_id").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    asked = stored(asked.join(rarest, "query_id").where("n > 0"), "asked")
    found = _matches(asked.where(F.col("n") <= COMMON).join(index.drop("cx", "cy"), "key"))
    left = asked.where(F.col("n") > COMMON).drop("key")
    if left.limit(1).count():
        common = left.select(F.explode("keys").alias("key")).distinct()
        counts = stored(index.join(common, "key", "left_semi").groupBy("key", "cx", "cy").agg(F.count(F.lit(1)).alias("m")), "cells")
        for reach in RINGS:
            last = reach == RINGS[-1]
            near = left.select("query_id", "keys", F.explode("keys").alias("key"), "qlon", "qlat")
            if last:
                met = near.join(counts, "key")
            else:
                # A ring's cells are as wide in scaled degrees as they are high; the poles have one cell all around.
                scale, wide = F.greatest(F.cos(F.radians(F.least(F.abs("qlat") + reach, F.lit(89.0)))), F.lit(0.02)), int(reach / CELL)
                span = lambda v, r, step: F.explode(F.sequence(F.floor((F.col(v) - r) / step).cast("int"), F.floor((F.col(v) + r) / step).cast("int")))
                near = near.withColumn("ry", span("qlat", F.lit(reach), reach)).withColumn("rx", span("qlon", F.lit(reach) / scale, reach))
                ringed = counts.withColumn("rx", F.floor(F.col("cx") / wide).cast("int")).withColumn("ry", F.floor(F.col("cy") / wide).cast("int"))
                met = near.join(ringed, ["key", "rx", "ry"])
            cells = met.groupBy("query_id", "cx", "cy").agg(F.count(F.lit(1)).alias("has"), F.first(F.size("keys")).alias("of"), F.min_by("key", F.struct("m", "key")).alias("key")).where("has = of")
            hits = stored(_matches(cells.select("query_id", "cx", "cy", "key").join(left.drop("keys", "n"), "query_id").join(index, ["key", "cx", "cy"])), "ring")
            full = hits.where(F.col("distance2") <= reach * reach).groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
            done = left.select("query_id") if last else full
            found = found.unionByName(hits.join(done, "query_id", "left_semi"))
            left = stored(left.join(done, "query_id", "left_anti"), "left")
            if not left.limit(1).count():
                break
    order = Window.partitionBy("query_id").orderBy("distance2", F.desc("rank"), "place_id")
    full = found.join(places, "place_id")
    return full.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= k)


def search_merge(results: list[DataFrame], k: int) -> DataFrame:
    """Several indexes' results as one: the same place counts once, the first k stay."""
    both = reduce(lambda a, b: a.unionByName(b), results).drop("pos")
    same = Window.partitionBy("query_id", "name", "kind", F.round("lat", 4), F.round("lon", 4)).orderBy("distance2", F.desc("rank"), "place_id")
    order = Window.partitionBy("query_id").orderBy("distance2", F.desc("rank"), "place_id")
    once = both.withColumn("__k", F.row_number().over(same)).where("__k = 1").drop("__k")
    return once.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= k)


def fallback_cut(places: DataFrame, n_places: int = 30_000, n_summits: int = 20_000) -> DataFrame:
    """The largest cities and towns, cities first, and the highest notable summits."""
    towns = places.where(F.col("kind").isin("city", "town")).orderBy(F.col("kind") != "city", F.desc(F.coalesce("population", F.lit(0))), "src_ord").limit(n_places)
    tops = places.where(F.col("kind").isin("peak", "volcano") & F.col("notable")).orderBy(F.desc_nulls_last("ele"), "src_ord").limit(n_summits)
    return towns.unionByName(tops)


def region_search(queries: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """Regions whose name starts with the text, then contains it, then whose group does; then by name.

    ``total`` counts all matches. Case and accents do not matter. Regions meet the texts whose first characters lie somewhere
    in their name or group; an empty text finds nothing.
    """
    pieces = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.array(*[F.substring(c, i, n) for n in range(1, PIECE + 1)]))
    folded = regions.withColumn("__name", fold_text(F.col("name"))).withColumn("__group", fold_text(F.coalesce("group", F.lit(""))))
    index = folded.select("region_id", "__name", "__group", F.explode(F.array_distinct(F.flatten(F.concat(pieces(F.col("__name")), pieces(F.col("__group")))))).alias("__head"))
    asked = queries.select("query_id", fold_text(F.col("text")).alias("__text")).where("__text <> ''").withColumn("__head", F.substring("__text", 1, PIECE))
    name, group, text = F.col("__name"), F.col("__group"), F.col("__text")
    score = F.when(name.startswith(text), 0).when(name.contains(text), 1).when(group.contains(text), 2)
    met = index.join(asked, "__head").withColumn("score", score).where("score is not null").select("query_id", "region_id", "score")
    met = met.join(queries.select("query_id", "text"), "query_id").join(regions, "region_id")
    order = Window.partitionBy("query_id").orderBy("score", "name", "region_id")
    ranked = met.withColumn("pos", F.row_number().over(order).cast("bigint")).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return ranked.where(F.col("pos") <= k)
