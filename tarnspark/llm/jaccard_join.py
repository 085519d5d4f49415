"""Exact Jaccard join of documents' word-shingle sets as a metric-space join.

Jaccard distance is a metric, and a link is a distance of at most r = 1 - threshold. The join runs in levels:

1. Equal sets collapse to one representative.
2. A shingle that no other set holds lies in the difference to every other set, so a set whose private share
   exceeds r has no partner. This bound is taken first over a fixed slice of the hash range, then over whole sets.
3. Shingles are ranked by hash, but those that many sets hold come last. Sets that share one of their lowest
   floor(r * n) + 1 shingles meet in a cell: a linked pair always does.
4. A cell that is too large for one task is cut by pivots, documents drawn from it. Every member goes to the region of its
   nearest pivot, and also to the region of each pivot that is farther by 2r at most: by the triangle inequality no other
   region can hold a partner of it at home there. Members within r of a pivot are linked to it and so to each other. What
   is left of a region are members outside that ball, and those inside that are near enough to the border to have a partner
   outside; such a region is a cell of the next level, with pivots of its own. A cell that pivots do not make smaller is
   cut into blocks, and each pair of blocks is joined.
5. In a cell of one task documents are pivots, the most central one first, and a member outside is only held against
   members whose distances to all earlier pivots differ from its own by at most r.

Groups of thousands of near copies thus cost a few distances per member, and no pair of them is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.llm.columns import keeps_names, sieve, without
from tarnspark.llm.kernels import Run, gram_hashes, in_sieve, mix, range_hashes, runs, signed, windows
from tarnspark.operators.components import least_roots
from tarnspark.scratch import forget, stored

#: Share of the hash range in the first private-shingle bound, in 1/1000.
SLICE = 400
#: Hashes that one bucket of the bound, and one cell of the join, may hold in a task, about.
BUCKET_HASHES, CELL_HASHES = 250_000, 200_000
#: Pivots that cut a large cell, and the share of it that its largest part may keep; beyond that, blocks are taken instead.
PIVOTS, SHRINKS_TO = 16, 0.8
#: Sets beyond which a shingle counts as held by many.
MANY = 200
#: Hashes that a task gathers before it deals them out by bucket, and holders whose counts are summed in one task.
DEAL_HASHES, PART_HOLDERS = 500_000, 20_000


def shingle_sets(run: Run, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, flat, and the texts' bounds in them."""
    _, _, bounds, words = run.words(lower=True)
    starts, of = windows(bounds, size)
    grams = gram_hashes(words, starts, size) if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(bounds)
    whole = range_hashes(words, bounds[:-1], bounds[1:]) if len(words) else np.zeros(run.n, np.uint64)
    sets = [
        np.unique(grams[of[i] : of[i + 1]]) if counts[i] >= size else whole[i : i + (counts[i] > 0)] for i in range(run.n)
    ]
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _limit(slice_: int) -> np.uint64:
    return np.uint64(min((1 << 64) - 1, (1 << 64) * slice_ // 1000))


def _profile(size: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(2)):
                flat, bounds = shingle_sets(run, size)
                yield pa.record_batch(
                    [
                        batch.column(0)[at : at + run.n], batch.column(1)[at : at + run.n], pa.array(np.diff(bounds)),
                        pa.array(_sums((flat <= _limit(SLICE)).astype(np.int64), bounds)),
                        pa.array(signed(_sums(mix(flat), bounds))), pa.array(signed(_sums(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), bounds))),
                    ],
                    names=["__id", "__tk", "__n", "__in_slice", "__k1", "__k2"],
                )

    return profile


def _dealt(flat: np.ndarray, keys: np.ndarray, slice_: int, buckets: int, count: bool = False) -> Iterator[dict]:
    """Hashes with their holders, at most two holders a hash, by bucket; further holders are counted here, all with ``count``."""
    order = np.lexsort((keys, flat))
    flat, keys = flat[order], keys[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (flat[1:] != flat[:-1]) | (keys[1:] != keys[:-1])
    flat, keys = flat[new], keys[new]
    head = np.ones(len(flat), dtype=bool)
    head[1:] = flat[1:] != flat[:-1]
    tail = np.append(head[1:], True)
    done, times = np.unique(keys[~(head | tail)], return_counts=True)
    edge = head | tail
    first = np.flatnonzero(head)
    holders = np.zeros(len(flat), np.int32)
    holders[first] = np.diff(np.append(first, len(flat)))
    flat, keys, holders = flat[edge], keys[edge], holders[edge]
    step = int(_limit(slice_) >> np.uint64(20)) // buckets + 1
    bucket = (flat >> np.uint64(20)) // np.uint64(step)
    cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
    for k, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(flat)))):
        first = k == 0
        yield {
            "__bucket": int(bucket[a]), "__hashes": flat[a:b].tobytes(), "__keys": keys[a:b].tobytes(), "__holders": holders[a:b].tobytes() if count else b"",
            "__done": done.tobytes() if first else b"", "__times": times.astype(np.int64).tobytes() if first else b"",
        }


_DEALT = "__bucket long, __hashes binary, __keys binary, __holders binary, __done binary, __times binary"
_DEALT_ARROW = pa.schema(
    [("__bucket", pa.int64()), ("__hashes", pa.binary()), ("__keys", pa.binary()), ("__holders", pa.binary()), ("__done", pa.binary()), ("__times", pa.binary())]
)


def _deal_texts(size: int, slice_: int, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys = [], []

        def dealt() -> Iterator[pa.RecordBatch]:
            if sum(map(len, hashes)):
                rows = list(_dealt(np.concatenate(hashes), np.concatenate(keys), slice_, buckets))
                hashes.clear(), keys.clear()
                yield pa.RecordBatch.from_pylist(rows, schema=_DEALT_ARROW)

        for batch in batches:
            for _, run in runs(batch.column(0)):
                flat, bounds = shingle_sets(run, size)
                held = np.repeat(signed(_sums(mix(flat), bounds)), np.diff(bounds))
                low = flat <= _limit(slice_)
                hashes.append(flat[low])
                keys.append(held[low])
                if sum(map(len, hashes)) >= DEAL_HASHES:
                    yield from dealt()
        yield from dealt()

    return deal


def _deal_sets(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [np.frombuffer(s, np.uint64) for s in batch.column(1).to_pylist()]
                keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
                yield pa.RecordBatch.from_pylist(list(_dealt(np.concatenate(sets), keys, 1000, buckets, count=True)), schema=_DEALT_ARROW)

    return deal


def _count_shared(parts: int):
    """How many of a bucket's hashes each holder shares with another holder, packed by a part of the holders."""

    def count(dealt: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(dealt.column(c).to_pylist()), t)
        flat, keys = join("__hashes", np.uint64), join("__keys", np.int64)
        order = np.argsort(flat, kind="stable")
        flat, keys = flat[order], keys[order]
        heads = np.flatnonzero(np.diff(flat, prepend=~flat[:1]))
        holders = join("__holders", np.int32)
        many = flat[heads][np.add.reduceat(holders[order], heads) > MANY] if len(holders) else flat[:0]
        shared = np.minimum.reduceat(keys, heads) != np.maximum.reduceat(keys, heads)
        pick = np.repeat(shared, np.diff(np.append(heads, len(flat))))
        flat, keys = flat[pick], keys[pick]
        order = np.lexsort((flat, keys))
        flat, keys = flat[order], keys[order]
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[1:] != flat[:-1]) | (keys[1:] != keys[:-1])
        held, counts = np.unique(keys[new], return_counts=True)
        held, counts = np.concatenate((held, join("__done", np.int64))), np.concatenate((counts.astype(np.int64), join("__times", np.int64)))
        part = (mix(held.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, held, counts = part[order], held[order], counts[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cuts[1:], len(part))
        return pa.table(
            {
                "__part": pa.array(part[cuts]), "__keys": pa.array([held[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                "__counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                "__many": pa.array([signed(many).tolist() if i == 0 else [] for i in range(len(cuts))], pa.list_(pa.int64())),
            }
        )

    return count


def _sum_shared(packed: pa.Table) -> pa.Table:
    join = lambda c: np.frombuffer(b"".join(packed.column(c).to_pylist()), np.int64)
    held, back = np.unique(join("__keys"), return_inverse=True)
    return pa.table({"__key": held, "__shared": np.bincount(back, weights=join("__counts"), minlength=len(held)).astype(np.int64)})


def _shared_counts(dealt: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Shared hashes per holder, and the hashes that many hold; ``rows`` holders at most, which sets the number of parts they are summed in."""
    parts = max(1, -(-rows // PART_HOLDERS))
    counted = stored(dealt.groupBy("__bucket").applyInArrow(_count_shared(parts), "__part long, __keys binary, __counts binary, __many array<long>"), "counted")
    summed = counted.select("__part", "__keys", "__counts").groupBy("__part").applyInArrow(_sum_shared, "__key long, __shared long")
    return summed, counted.select(F.explode("__many").alias("__hash"))


def _pack_sets(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(2)):
                flat, bounds = shingle_sets(run, size)
                sets = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                here = slice(at, at + run.n)
                yield pa.record_batch(
                    [batch.column(0)[here], batch.column(1)[here], pa.array(signed(_sums(mix(flat), bounds))), pa.array(np.diff(bounds)), pa.array(sets, pa.binary())],
                    names=["__id", "__tk", "__s", "__n", "__set"],
                )

    return pack


def _window_rows(percent: int, many):
    def lowest(s: np.ndarray) -> np.ndarray:
        late = in_sieve(many.value, s)
        return np.concatenate((s[~late], s[late]))[: len(s) - (percent * len(s) + 99) // 100 + 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s, np.uint64) for s in batch.column(1).to_pylist()]
            lows = [lowest(s) for s in sets]
            names = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in lows])
            flat = np.concatenate(lows) if lows else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(signed(flat)), pa.array(names)], names=["__shingle", "__s"])

    return rows


def link_cell(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect a cell's members exactly as all its pairs at the threshold would."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    values, code = np.unique(flat, return_inverse=True)
    by_value = np.argsort(code, kind="stable")
    posts, post_of = owner[by_value], np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(values)))))
    code_of = np.concatenate(([0], np.cumsum(n)))
    root = np.arange(len(sets))
    links = []
    outside = np.ones(len(sets), dtype=bool)  # members that are neither pivots yet nor inside the first ball
    frequency = np.diff(post_of)[code]
    central = int(np.argmax(np.add.reduceat(frequency, code_of[:-1]) / n))
    distances: list[np.ndarray] = []
    radius = 1 - percent / 100 + 1e-9
    pivot = central
    while True:
        mine = code[code_of[pivot] : code_of[pivot + 1]]
        sizes = post_of[mine + 1] - post_of[mine]
        places = np.repeat(post_of[mine] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        both = np.bincount(posts[places], minlength=len(sets))
        union = n + n[pivot] - both
        for m in np.flatnonzero((100 * both >= percent * union) & (root != root[pivot])):
            old, new = root[m], root[pivot]
            if old != new:
                links.append((int(ids[pivot]), int(ids[m])))
                root[root == old] = new
        outside[pivot] = False
        if not distances:
            outside &= root != root[pivot]
        if len(distances) < PIVOTS:
            distances.append(1 - both / union)
        # A member outside matters only while some member of another component is within r of it by the windows.
        rest = np.flatnonzero(outside)
        pivot = -1
        for m in rest:
            near = (root != root[m]) & (100 * np.minimum(n, n[m]) >= percent * np.maximum(n, n[m]))
            for to_pivot in distances:
                near &= np.abs(to_pivot - to_pivot[m]) <= radius
            if near.any():
                pivot = int(m)
                break
            outside[m] = False
        if pivot < 0:
            return links


def _join_cells(percent: int):
    def join(cell: pa.Table) -> pa.Table:
        names = cell.column("__s").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in cell.column("__set").to_pylist()]
        links = link_cell(names, sets, percent) if len(names) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return join


_PLACED = "__cell long, __region int, __s long, __n long, __d double, __inside boolean, __pivot long"


def _place(percent: int):
    """Each member in the regions of its window, with its distance to their pivots."""

    def place(members: pa.Table, pivots: pa.Table) -> pa.Table:
        names, n = members.column("__s").to_numpy(), members.column("__n").to_numpy()
        if not len(names):
            return pa.table({c: [] for c in ("__cell", "__region", "__s", "__n", "__d", "__inside", "__pivot")}, schema=_PLACED_ARROW)
        if not pivots.num_rows:  # the draw may be empty: the cell stays whole
            return pa.table({"__cell": members.column("__cell"), "__region": np.zeros(len(n), np.int32), "__s": names, "__n": n, "__d": np.ones(len(n)), "__inside": np.zeros(len(n), bool), "__pivot": names}, schema=_PLACED_ARROW)
        flat = np.concatenate([np.frombuffer(s, np.uint64) for s in members.column("__set").to_pylist()])
        bounds = np.concatenate(([0], np.cumsum(n)))
        order = np.argsort(pivots.column("__of__s").to_numpy(), kind="stable")
        chosen = pivots.column("__of__s").to_numpy()[order]
        both, union = np.zeros((len(chosen), len(n)), np.int64), np.zeros((len(chosen), len(n)), np.int64)
        raw = pivots.column("__of__set").to_pylist()
        for k, o in enumerate(order):
            pivot = np.frombuffer(raw[o], np.uint64)
            at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
            both[k] = _sums((pivot[at] == flat).astype(np.int64), bounds)
            union[k] = n + len(pivot) - both[k]
        far = 1 - both / union
        region, member = np.nonzero(far <= far.min(axis=0) + 2 * (1 - percent / 100) + 1e-9)
        return pa.table(
            {
                "__cell": np.full(len(member), members.column("__cell")[0].as_py()), "__region": region.astype(np.int32), "__s": names[member], "__n": n[member],
                "__d": far[region, member], "__inside": (100 * both >= percent * union)[region, member], "__pivot": chosen[region],
            },
            schema=_PLACED_ARROW,
        )

    return place


_PLACED_ARROW = pa.schema(
    [("__cell", pa.int64()), ("__region", pa.int32()), ("__s", pa.int64()), ("__n", pa.int64()), ("__d", pa.float64()), ("__inside", pa.bool_()), ("__pivot", pa.int64())]
)


def _blocks(members: DataFrame, sets: DataFrame, loads: DataFrame, percent: int) -> DataFrame:
    """Links of cells, each joined in one task or, beyond ``CELL_HASHES``, by pairs of blocks."""
    placed = members.join(loads, "__cell").withColumn("__b", F.pmod(F.xxhash64("__s"), F.col("__blocks")).cast("int"))
    placed = placed.select("__cell", "__s", "__b", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other"))
    placed = placed.select("__cell", "__s", F.least("__b", "__other").alias("__i"), F.greatest("__b", "__other").alias("__j"))
    return placed.join(sets.select("__s", "__set"), "__s").groupBy("__cell", "__i", "__j").applyInArrow(_join_cells(percent), "a long, b long")


def _cut(members: DataFrame, sets: DataFrame, loads: DataFrame, percent: int, level: int) -> DataFrame:
    """Members of large cells in the regions of their cell's pivots (``_PLACED``)."""
    drawn = F.xxhash64("__s", F.lit(level))
    thin = members.join(loads.select("__cell", "__members"), "__cell").where(F.pmod(drawn, F.col("__members")) < 2 * PIVOTS)
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy(drawn, "__s"))
    pivots = thin.withColumn("__rank", rank).where(F.col("__rank") <= PIVOTS).select("__cell", "__s").join(sets.select("__s", "__set"), "__s")
    pivots = pivots.join(loads.select("__cell", "__blocks"), "__cell").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = members.join(loads.select("__cell", "__blocks"), "__cell").withColumn("__part", F.pmod(F.xxhash64("__s"), F.col("__blocks")).cast("int")).drop("__blocks")
    dealt = dealt.join(sets.select("__s", "__n", "__set"), "__s")
    pivots = pivots.select(*[F.col(c).alias(f"__of{c}") for c in ("__cell", "__part", "__s", "__set")])  # own names, as both sides read the same tables
    return dealt.groupBy("__cell", "__part").cogroup(pivots.groupBy("__of__cell", "__of__part")).applyInArrow(_place(percent), _PLACED)


def _links(sets: DataFrame, percent: int, many: DataFrame) -> DataFrame:
    """Edges between sets; ``sets`` has ``__s`` (a name), ``__n`` and ``__set``, all distinct, and ``many`` the hashes that many hold.

    The sieve of those has a bounded size; what falls into it by chance is late for all sets alike, so no pair is lost.
    """
    late = sets.sparkSession.sparkContext.broadcast(sieve(many, "__hash"))
    window = stored(sets.select("__s", "__set").mapInArrow(_window_rows(percent, late), "__shingle long, __s long"), "window")
    least = window.groupBy("__shingle").agg(F.min("__s").alias("__least"), F.max("__s").alias("__most")).where("__least < __most").drop("__most")
    least = stored(least, "least")
    shared = stored(window.join(least, "__shingle"), "regions", after=(window,))
    # A shingle's sets meet in the cell of its least set: the set that is the least for most of that one's shingles.
    votes = shared.groupBy("__s", "__least").agg(F.count(F.lit(1)).alias("__votes"))
    home = votes.groupBy("__s").agg(F.max_by("__least", F.struct("__votes", -F.col("__least"))).alias("__cell"))
    cell_of = least.join(home.withColumnRenamed("__s", "__least"), "__least").select("__shingle", "__cell")
    members = stored(shared.select("__shingle", "__s").join(cell_of, "__shingle").select("__cell", "__s").distinct(), "members", after=(shared,))
    sizes, radius = sets.select("__s", "__n"), 1 - percent / 100 + 1e-9
    found, level = [], 0
    while True:
        loads = members.join(sizes, "__s").groupBy("__cell").agg(
            F.sum("__n").alias("__load"), F.ceil(F.sum("__n") / F.lit(CELL_HASHES)).cast("int").alias("__blocks"), F.count(F.lit(1)).alias("__members")
        )
        loads = stored(loads.where("__members > 1"), "loads")
        found.append(stored(_blocks(members, sets, loads.where("__blocks = 1"), percent), "links"))
        large = loads.where("__blocks > 1")
        if not large.limit(1).count():
            forget(members, loads)
            return reduce(DataFrame.unionByName, found)
        placed = stored(_cut(members.join(large.select("__cell"), "__cell", "left_semi"), sets, large, percent, level), "placed")
        border = placed.where("not __inside").groupBy("__cell", "__region").agg(F.min("__d").alias("__border"))
        kept = stored(placed.join(border, ["__cell", "__region"]).where(~F.col("__inside") | (F.col("__d") >= F.col("__border") - radius)), "kept")
        parts = kept.groupBy("__cell", "__region").agg(F.sum("__n").alias("__part")).groupBy("__cell").agg(F.max("__part").alias("__most"), F.sum("__part").alias("__all"))
        worse = (F.col("__most") > F.col("__load") * SHRINKS_TO) | (F.col("__all") > F.col("__load") * F.col("__blocks") / 2)
        worse = stored(large.join(parts, "__cell").where(worse).select(*large.columns), "worse")
        found.append(stored(_blocks(members, sets, worse, percent), "links"))
        found.append(placed.where("__inside and __s <> __pivot").select(F.col("__pivot").alias("a"), F.col("__s").alias("b")))
        onward = kept.join(worse.select("__cell"), "__cell", "left_anti").select(F.xxhash64("__cell", "__region", F.lit(level)).alias("__cell"), "__s")
        members = stored(onward.distinct(), "members", after=(members,))
        forget(kept, loads)
        level += 1


@keeps_names
def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id, the least key reachable over links, for every row of ``docs``.

    Two documents link when their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more
    (whole-number comparison). A shorter text is one shingle of all its words; a null, empty or blank text has none
    and links with nothing. Rows with a null key get a null component. Rows that share a key are one document: what one of
    their texts links to, all do, but for rows without words. Other columns are not carried. An empty table gives an empty
    result. Sets are told apart by hashes of 128 bits, and by their first key and its text's hash of 64.
    """
    rows = docs.select(F.col(key).cast("long").alias("__id"), F.xxhash64(text).alias("__tk"), F.col(text).alias("__text"))
    profile = stored(rows.mapInArrow(_profile(size), "__id long, __tk long, __n long, __in_slice long, __k1 long, __k2 long"), "profile")
    known = profile.where("__id is not null and __n > 0")
    firsts = known.groupBy("__k1", "__k2", "__n", "__in_slice").agg(F.min(F.struct("__id", "__tk")).alias("__f"))
    firsts = stored(firsts.select("__k1", "__k2", "__n", "__in_slice", F.col("__f.__id").alias("__first"), F.col("__f.__tk").alias("__tk")), "firsts")
    total, holders = known.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, total * SLICE // 1000 // BUCKET_HASHES)
    shared, _ = _shared_counts(rows.where("__id is not null").select("__text").mapInArrow(_deal_texts(size, SLICE, buckets), _DEALT), holders)
    private = F.col("__in_slice") - F.coalesce("__shared", F.lit(0))
    maybe = (
        firsts.join(shared, firsts["__k1"] == shared["__key"], "left")
        .where(private * 100 <= F.col("__n") * (100 - percent)).select(F.col("__first").alias("__id"), "__tk")
    )
    sets = stored(
        rows.join(maybe, ["__id", "__tk"], "left_semi").select("__id", "__tk", "__text").mapInArrow(_pack_sets(size), "__id long, __tk long, __s long, __n long, __set binary")
        .dropDuplicates(["__id", "__tk"]).drop("__id", "__tk"),
        "sets", codec="uncompressed",
    )
    held, holders = sets.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
    shared, many = _shared_counts(sets.select("__s", "__set").mapInArrow(_deal_sets(max(1, held // BUCKET_HASHES)), _DEALT), holders)
    private = F.col("__n") - F.coalesce("__shared", F.lit(0))
    close = (
        sets.select("__s", "__n").join(shared, F.col("__s") == F.col("__key"), "left")
        .where(private * 100 <= F.col("__n") * (100 - percent)).select("__s")
    )
    near = stored(sets.join(close, "__s", "left_semi"), "near", codec="uncompressed", after=(sets,))
    links = _links(near, percent, many)
    named = lambda c, to: firsts.select(F.col("__k1").alias(c), F.col("__first").alias(to))
    edges = links.join(named("a", "u"), "a").join(named("b", "v"), "b").select("u", "v")
    # A key with several texts joins what each of them belongs to.
    several = known.groupBy("__id").agg(F.min("__k1").alias("__lo"), F.max("__k1").alias("__hi")).where("__lo <> __hi").select("__id")
    own = known.join(several, "__id", "left_semi").join(firsts.select("__k1", "__k2", "__first"), ["__k1", "__k2"])
    roots = least_roots(edges.unionByName(own.select(F.col("__id").alias("u"), F.col("__first").alias("v"))), "u", "v")
    forget(near)
    reps = firsts.join(roots, firsts["__first"] == roots["node"], "left").select(
        F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__n").alias("n"), F.col("__in_slice").alias("s"),
        F.coalesce("root", "__first").alias("__root"),
    )
    met = (profile["__k1"] == reps["k1"]) & (profile["__k2"] == reps["k2"]) & (profile["__n"] == reps["n"]) & (profile["__in_slice"] == reps["s"])
    return profile.join(reps, met, "left").select(
        F.col("__id").alias(key), F.col("__n").alias("n_shingles"),
        F.when(F.col("__id").isNotNull(), F.coalesce("__root", "__id")).alias("component_id"),
    )


@keeps_names
def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the least key of their component; rows with a null key stay."""
    roots = jaccard_components(docs, size, percent, key, text).where("component_id = " + key).select(F.col(key).alias("__keep")).distinct()
    return docs.join(roots, F.col(key) == F.col("__keep"), "left").where(F.col("__keep").isNotNull() | F.col(key).isNull()).drop("__keep")
