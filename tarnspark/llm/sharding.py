"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.columns import gapless_slots, keeps_names, without


#: Jumps that every key takes without a second look.
MOST_JUMPS = 64


def jump_state(key: Column, shards: int) -> Column:
    """The last jump below ``shards`` and the first at or beyond it, as ``struct<at, next>``.

    A key walks through shard numbers in growing jumps. Jump i draws a number r in (0, 1] from a hash of the
    key and i, and leads from b to floor((b + 1) / r). The key lives where its last jump below the shard count
    landed, so one more shard moves a key only if its next jump lands exactly there.
    """
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def jump(state: Column, i: Column) -> Column:
        r = (F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1) / F.lit(float(1 << 31))
        beyond = F.floor((state["next"] + 1) / r).cast("long")
        return F.when(
            state["next"] < shards, F.struct(state["next"].alias("at"), beyond.alias("next"))
        ).otherwise(state)

    # Some ln(shards) jumps are needed; the few keys that need more than MOST_JUMPS go on from there.
    few = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, jump)
    if shards <= MOST_JUMPS:
        return few
    more = F.sequence(F.lit(MOST_JUMPS + 1), F.lit(shards))
    on = lambda s: F.when(s["next"] < shards, F.aggregate(more, s, jump)).otherwise(s)
    return F.get(F.transform(F.array(few), on), F.lit(0))


@keeps_names
def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard; columns of these names are replaced, and the text is left out.

    The key and the shard count alone decide the shard (law ``key``). ``slot`` numbers a shard's rows from 0
    without gaps; ``grown_shard`` is the shard with one more of them. A null text counts as empty. A null key
    is a key like any other. Repeated rows share a shard and get slots of their own. An empty table gives an
    empty result.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rows = docs.count()
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = without(docs, *added)
    placed = kept.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_state(F.col(key), shards).alias("__jump"),
    )
    if text in placed.columns:
        placed = placed.drop(text)
    at, beyond = F.col("__jump.at"), F.col("__jump.next")
    placed = placed.select(
        *[F.col(f"`{c}`") for c in placed.columns if c != "__jump"],
        at.cast("int").alias("shard"),
        F.when(beyond == shards, F.lit(shards)).otherwise(at).cast("int").alias("grown_shard"),
    )
    return gapless_slots(placed, "shard", key, rows, "slot")
