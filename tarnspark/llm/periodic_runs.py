"""Periodic runs: stretches of words that repeat with a period, found by an enhanced suffix array.

Some texts at a time get one array of suffixes and of longest common prefixes (LCP), in which texts never meet. Every LCP
boundary of depth d parts an interval of suffixes in two; each suffix i of the smaller part asks whether the suffix d words
after or before it lies in the other part, by its place in the array. If so, two equal stretches of d words meet there and
the word after them differs: a square that ends where a run ends. Squares are rotated to the left as far as their period
lasts, and those of one run merge. No tree is built, and the smaller parts sum to n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.llm.columns import without
from tarnspark.llm.kernels import gram_hashes, mix, runs, windows

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def least_depth(min_words: int, exponent: int) -> int:
    """Every run of at least ``min_words`` words and ``exponent`` periods ends in a square whose half is no shorter than this.

    A run of length n and period q ends in squares of halves q, 2 q, … up to n / 2; the largest of them counts.
    """
    return min(max(min_words, exponent * q) // (2 * q) * q for q in range(1, min_words + 1))


def _first_of(flags: np.ndarray) -> np.ndarray:
    """For each place, the last flagged place up to it."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def suffix_ranks(items: np.ndarray, text: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, … words, texts apart; the last ranks all differ.

    A rank is the place of the first suffix that is equal so far. Only suffixes that are still tied are sorted again.
    """
    n = len(items)
    levels, rank, tied, step = [], np.zeros(n, dtype=np.int64), np.arange(n), 0
    keys = text * n + np.unique(items, return_inverse=True)[1]
    while len(tied):
        if step:
            after = tied + step
            inside = after < stop[tied]
            keys = rank[tied] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        order = np.argsort(keys, kind="stable")
        tied, keys = tied[order], keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        old = np.append(True, rank[tied][1:] != rank[tied][:-1])
        rank[tied] += _first_of(new) - _first_of(old)
        levels.append(rank.astype(np.int32))
        tied = tied[~(new & np.append(new[1:], True))]
        step = 2 * step or 1
    return levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Common words of each suffix and the one before it in the order; 0 for the first and behind the last."""
    n = len(order)
    a, b, same = order[:-1].copy(), order[1:].copy(), text[order[:-1]] == text[order[1:]]
    depth = np.zeros(n + 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = same & (a < stop[order[:-1]]) & (b < stop[order[1:]])
        equal = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        shift = equal * (1 << k)
        a, b = a + shift, b + shift
        depth[1:n] += shift
    return depth


def squares(items: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and halves of all squares of at least ``least`` words a half whose next word breaks the period."""
    sizes = np.diff(bounds)
    text, stop, head = np.repeat(np.arange(len(sizes)), sizes), np.repeat(bounds[1:], sizes), np.repeat(bounds[:-1], sizes)
    levels = suffix_ranks(items, text, stop)
    place = levels[-1].astype(np.int64)
    order = np.empty(len(items), dtype=np.int64)
    order[place] = np.arange(len(items))
    depth = common_prefixes(order, levels, text, stop)
    depth[depth < least] = 0
    cuts = np.flatnonzero(depth)
    # The part before a boundary goes back to the last one as shallow, the part after it to the next shallower one.
    low, high = np.arange(-1, len(depth) - 1), np.arange(1, len(depth) + 1)
    rest = cuts
    while len(rest := rest[depth[low[rest]] > depth[rest]]):
        low[rest] = low[low[rest]]
    rest = cuts
    while len(rest := rest[depth[high[rest]] >= depth[rest]]):
        high[rest] = high[high[rest]]
    low, high, d = low[cuts], high[cuts], depth[cuts]
    left = cuts - low <= high - cuts
    first, count = np.where(left, low, cuts), np.where(left, cuts - low, high - cuts)
    away, until = np.where(left, cuts, low), np.where(left, high, cuts)
    member = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    i, d, away, until = order[member], np.repeat(d, count), np.repeat(away, count), np.repeat(until, count)
    found = []
    for j, start, inside in ((i + d, i, i + d < stop[i]), (i - d, i - d, i - d >= head[i])):
        at = place[np.where(inside, j, 0)]
        hit = inside & (at >= away) & (at < until)
        found.append((start[hit], d[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rotated(items: np.ndarray, start: int, period: int, head: int) -> int:
    """How far to the left the period lasts."""
    width = 64
    while start > head:
        low = max(head, start - width)
        differ = np.flatnonzero(items[low:start] != items[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, width = low, 2 * width
    return start


def merged_runs(items: np.ndarray, head: int, starts: np.ndarray, halves: np.ndarray, min_words: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one text from its squares, by start and period.

    A square's smallest period divides its half. All squares of a run end where it ends, so each end is settled by itself,
    from the shortest half on; a square within a run found there, by a multiple of its period, is that run's.
    """
    found, ends = [], starts + 2 * halves
    by = np.lexsort((halves, ends))
    starts, halves, ends = starts[by], halves[by], ends[by]
    for a, b in zip(*(lambda x: (x[:-1], x[1:]))(np.append(np.flatnonzero(np.diff(ends, prepend=-1)), len(ends)))):
        s, d, end = starts[a:b], halves[a:b], int(ends[a])
        while len(s):
            start, half = int(s[0]), int(d[0])
            small = [k for k in range(1, int(half**0.5) + 1) if half % k == 0]
            period = next(
                q for q in sorted({*small, *(half // k for k in small)}) if np.array_equal(items[start : end - q], items[start + q : end])
            )
            start = _rotated(items, start, period, head)
            if end - start >= max(min_words, exponent * period):
                found.append((start - head, end - start, period))
            left = (d % period != 0) | (s < start)
            s, d = s[left], d[left]
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_texts(items: np.ndarray, bounds: np.ndarray, min_words: int, exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each text that has any, from the hashes of all words and the texts' bounds in them."""
    least = least_depth(min_words, exponent)
    at, gram_bounds = windows(bounds, least)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(gram_bounds))
    keys = gram_hashes(items, at, least) ^ mix(text.astype(np.uint64))
    order = np.argsort(keys)
    # A text in which no piece of the least half occurs twice has no square of that half.
    texts = np.unique(text[order[1:][keys[order[1:]] == keys[order[:-1]]]])
    if not len(texts):
        return {}
    sizes = np.diff(bounds)[texts]
    held = np.concatenate(([0], np.cumsum(sizes)))
    mine = items[np.repeat(bounds[:-1][texts] - held[:-1], sizes) + np.arange(held[-1])]
    starts, halves = squares(mine, held, least)
    owner = np.searchsorted(held, starts, side="right") - 1
    by = np.argsort(owner, kind="stable")
    starts, halves, cuts = starts[by], halves[by], np.searchsorted(owner[by], np.arange(len(texts) + 1))
    found = {}
    for k, t in enumerate(texts):
        part = slice(cuts[k], cuts[k + 1])
        if runs_here := merged_runs(mine, int(held[k]), starts[part], halves[part], min_words, exponent):
            found[int(t)] = runs_here
    return found


def _collapse(min_words: int, exponent: int):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(1)):
                _, _, bounds, hashes = run.words(lower=False)
                found = runs_of_texts(hashes, bounds, min_words, exponent)
                texts = []
                for k in range(run.n):
                    words = run.text(k).split()
                    if k in found:
                        keep = np.ones(len(words), dtype=bool)
                        for start, length, period in found[k]:
                            keep[start + period : start + length] = False
                        words = compress(words, keep)
                    texts.append(b" ".join(words))
                listed = [[dict(zip(("start", "length", "period"), r)) for r in found.get(k, ())] for k in range(run.n)]
                yield pa.record_batch(
                    [
                        batch.column(0)[at : at + run.n], pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(np.diff(bounds).astype(np.int64)), pa.array(listed, _ARROW_RUN),
                    ],
                    names=["row", "text", "n_words", "runs"],
                )

    return collapse


def collapse_runs(docs: DataFrame, min_words: int = 24, exponent: int = 3, text: str = "text") -> DataFrame:
    """Add n_words and runs (start, length, period in words, by start and period), and collapse each run in the text.

    A run is a stretch of words with smallest period q, at least ``min_words`` words and ``exponent`` periods long, that no
    neighbouring word extends. Words ``[^\\x20\\x09-\\x0D]+`` are compared by 64-bit hashes. The text becomes its words joined
    by one space, without those that a run holds after its first period; runs may overlap, and each drops its own. A null or
    empty text has no words and becomes empty. Columns named n_words or runs are replaced, others stay, whatever their
    names. Rows are judged one by one: null keys and repeated rows are rows like others, an empty table stays empty, and
    nothing is shuffled. A text is held by one task, which needs some 4 bytes a word for each doubling of its longest repeat.
    """
    if min_words < 1 or exponent < 2:
        raise ValueError("a run has at least one word and two periods")
    docs = without(docs, "n_words", "runs")
    rest = [f for f in docs.schema.fields if f.name != text]
    row = F.struct(*[F.col(f"`{f.name}`") for f in rest]) if rest else F.struct(F.lit(0).alias("none"))
    carried = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([carried.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN))])
    out = carried.mapInArrow(_collapse(min_words, exponent), schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns], "n_words", "runs")
