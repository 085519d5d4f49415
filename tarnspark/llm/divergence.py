"""Source divergence audit: how far the sources of a language lie apart in their terms, from a K-squared quadtree.

The matrix of a language has a row for each source and a column for each kept term. It is cut into tiles of some sources and
some terms; a task takes two tiles of the same terms, keeps each as a quadtree (a sorted list of the nonzero quadrants of each
size) and walks both at once, for all pairs of their sources together. Where both quadrants are all zero the walk ends: what
such terms add follows from the two sources' totals alone. What is left are cells in which either source has the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.llm.columns import gapless_slots
from tarnspark.llm.kernels import LOWER, runs
from tarnspark.scratch import stored

#: Sources and (about) terms of a tile.
TILE_SOURCES, TILE_TERMS = 64, 512
#: Bytes of text whose terms are counted together before they leave a task.
COUNT_BYTES = 4 << 20
SCALE = 1_000_000_000

IS_GAP = np.arange(256) < 128
IS_GAP[[*range(65, 91), *range(97, 123)]] = False
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), added up over some megabytes of text."""
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(k), "").dictionary_encode() for k in (0, 1))
        width = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
        for at, run in runs(batch.column(2), COUNT_BYTES):
            gap = IS_GAP[run.data]
            starts, ends, bounds = run.spans(gap)
            if not len(starts):
                continue
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            letters = LOWER[run.data][~gap]
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
            many = len(terms.dictionary)
            doc = np.repeat(np.arange(run.n), np.diff(bounds))
            held, times = np.unique(doc * many + terms.indices.to_numpy(), return_counts=True)
            keys, at_key, docs = np.unique(group[at + held // many] * many + held % many, return_inverse=True, return_counts=True)
            n = np.zeros(len(keys), dtype=np.int64)
            np.add.at(n, at_key, times)
            owner = keys // many
            yield pa.record_batch(
                [
                    lang.dictionary.take(pa.array(owner // width)).cast(pa.string()), source.dictionary.take(pa.array(owner % width)).cast(pa.string()),
                    terms.dictionary.take(pa.array(keys % many)).cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def smoothed(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), exact; null without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", ((whole(count) + 2) * F.lit(SCALE)).cast("decimal(38,0)"), whole(total) + whole(kept) * 2)
    return F.when(kept > 0, share + 1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class QuadTree:
    """A count matrix as the sorted codes of its nonzero quadrants, from single cells up to the whole square."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, height: int, values: np.ndarray) -> None:
        self.codes = [np.unique(((rows >> k) << (height - k)) + (columns >> k)) for k in range(height + 1)]
        self.height = height
        self.values = values[np.argsort((rows << height) + columns)]

    def find(self, level: int, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each quadrant of side 2^level has a nonzero cell, and its place in the list."""
        codes, asked = self.codes[level], (rows << (self.height - level)) + columns
        if not len(codes):
            return np.zeros(len(asked), dtype=bool), np.zeros(len(asked), dtype=np.int64)
        at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        return codes[at] == asked, at


def walk(a: QuadTree, b: QuadTree, zero_a: np.ndarray, zero_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` and each of ``b``: the gaps of the columns in which either has a cell, added up, and their number.

    ``zero_a`` and ``zero_b`` are what a cell without a count is worth. With ``same`` only pairs with the row of ``a`` first.
    """
    r1 = r2 = c = np.zeros(1, dtype=np.int64)
    for level in range(a.height, -1, -1):
        (in_a, at_a), (in_b, at_b) = a.find(level, r1, c), b.find(level, r2, c)
        go = in_a | in_b
        r1, r2, c = r1[go], r2[go], c[go]
        if level:
            k = np.arange(8)
            r1, r2, c = (np.ravel(2 * x[:, None] + bit) for x, bit in ((r1, k >> 2), (r2, (k >> 1) & 1), (c, k & 1)))
            inside = (r1 << (level - 1) < len(zero_a)) & (r2 << (level - 1) < len(zero_b))
            if same:
                inside &= r1 <= r2
            r1, r2, c = r1[inside], r2[inside], c[inside]
    in_a, at_a, in_b, at_b = in_a[go], at_a[go], in_b[go], at_b[go]
    p, q = zero_a[r1], zero_b[r2]
    p[in_a], q[in_b] = a.values[at_a[in_a]], b.values[at_b[in_b]]
    value = np.zeros((len(zero_a), len(zero_b)), dtype=np.int64)
    met = np.zeros_like(value)
    np.add.at(value, (r1, r2), (p - q) * (p - q) // (p + q))
    np.add.at(met, (r1, r2), 1)
    return value, met


_TILES = "lang string, a long, b long, value long, met long"


def _price(wide: int):
    def price(tile: pa.Table) -> pa.Table:
        """Pairs of sources (by slot) of two tiles of the same terms, with what the terms that either has add up to."""
        i, j, block = (tile.column(k)[0].as_py() for k in ("i", "j", "block"))
        slot, p = tile.column("slot").to_numpy(), tile.column("p").to_numpy()
        codes = tile.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
        head = codes < 0
        # Common terms and full sources come first, so that zeros lie together.
        held = np.bincount(codes[~head], minlength=1)
        rank = np.empty(len(held), dtype=np.int64)
        rank[np.argsort(-held, kind="stable")] = np.arange(len(held))
        sides = []
        for side in dict.fromkeys((i, j)):
            mine = slot // wide == side
            slots, full = np.unique(slot[mine], return_counts=True)
            slots = slots[np.argsort(-full, kind="stable")]
            row_of = np.empty(wide, dtype=np.int64)
            row_of[slots % wide] = np.arange(len(slots))
            zero = np.empty(len(slots), dtype=np.int64)
            zero[row_of[slot[mine & head] % wide]] = p[mine & head]
            cells = mine & ~head
            sides.append((slots, zero, row_of[slot[cells] % wide], rank[codes[cells]], p[cells]))
        height = int(max(len(held), *(len(s[0]) for s in sides)) - 1).bit_length()
        trees = [QuadTree(rows, columns, height, values) for _, _, rows, columns, values in sides]
        a, b = sides[0], sides[-1]
        value, met = walk(trees[0], trees[-1], a[1], b[1], i == j)
        x, y = np.nonzero(np.triu(np.ones_like(met), 1) if i == j else np.ones_like(met))
        if block:
            seen = met[x, y] > 0
            x, y = x[seen], y[seen]
        lang, one, two = pa.array([tile.column("lang")[0].as_py()] * len(x), pa.string()), a[0][x].astype(np.int64), b[0][y].astype(np.int64)
        return pa.table({"lang": lang, "a": np.minimum(one, two), "b": np.maximum(one, two), "value": value[x, y], "met": met[x, y]})

    return price


def source_divergence(
    docs: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language and from the language.

    Part ``pair`` has every other source with the gaps of all kept terms added up, part ``term`` the ``top`` kept terms that
    the source has more of than the language, by gap. A language keeps the terms of at least ``min_docs`` documents. Gaps are
    whole numbers of smoothed shares in parts of 10^9; nothing is rounded on the way. Terms are runs of letters and
    non-ASCII characters, A-Z folded. Null is the empty text, language or source; a source without terms still has its rows,
    of value 0 where its language keeps no term. Repeated rows are documents of their own; equal values are ranked by item.
    Other columns, whatever their names, are not read. An empty table gives no rows. Counts have 64 bits.
    """
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = plain.mapInArrow(_count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = stored(counted, "term-counts")
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= min_docs).drop("docs")
    cells = stored(counted.drop("docs").join(terms, ["lang", "term"]), "kept-terms", after=(counted,))
    # A term's cells all carry its sum over the language, so one cell stands for the term.
    kept = cells.groupBy("lang", "term").agg(F.first("whole").alias("whole")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    groups = stored(groups, "groups")
    groups = stored(gapless_slots(groups, "lang", "source", groups.count(), "slot"), "groups", after=(groups,))
    last = groups.groupBy("lang").agg(F.floor(F.max("slot") / TILE_SOURCES).cast("long").alias("last"))
    sized = groups.join(last, "lang")
    blocks = F.ceil(F.greatest(F.col("kept"), F.lit(1)) / TILE_TERMS).cast("long")
    nothing = F.lit(0).cast("long")
    heads = sized.select("lang", "slot", "last", F.lit(None).cast("string").alias("term"), smoothed(nothing, F.col("total"), F.col("kept")).alias("p"), F.explode(F.sequence(nothing, blocks - 1)).alias("block"))
    filled = cells.join(sized, ["lang", "source"]).select("lang", "slot", "last", "term", smoothed(F.col("n"), F.col("total"), F.col("kept")).alias("p"), F.pmod(F.xxhash64("term"), blocks).alias("block"))
    mine = F.floor(F.col("slot") / TILE_SOURCES).cast("long")
    tiles = heads.unionByName(filled).withColumn("other", F.explode(F.sequence(nothing, F.col("last"))))
    tiles = tiles.select("lang", "block", F.least(mine, "other").alias("i"), F.greatest(mine, "other").alias("j"), "slot", "term", F.coalesce("p", nothing + 1).alias("p"))
    priced = tiles.groupBy("lang", "block", "i", "j").applyInArrow(_price(TILE_SOURCES), _TILES).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    named = lambda s: groups.select("lang", F.col("slot").alias(s), F.col("source").alias(f"{s}_source"), "kept" if s == "a" else F.lit(0).alias("none"), smoothed(nothing, F.col("total"), F.col("kept")).alias(f"{s}_zero"))
    both = priced.join(named("a"), ["lang", "a"]).join(named("b"), ["lang", "b"])
    value = F.when(F.col("kept") > 0, F.col("value") + (F.col("kept") - F.col("met")) * gap(F.col("a_zero"), F.col("b_zero"))).otherwise(0).cast("long")
    ways = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    pairs = both.select("lang", value.alias("value"), ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    p, q = smoothed(F.col("n"), F.col("total"), F.col("kept")), smoothed(F.col("whole"), F.col("lang_total"), F.col("kept"))
    above = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    tops = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(tops.withColumn("rank", rank).where(F.col("rank") <= top))
