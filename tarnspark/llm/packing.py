"""Packing by cutting-stock column generation.

Documents are cut at every ``size`` tokens; the remainders are the items, by length class. A linear program over
patterns (how many items of each class share a sequence) is solved by column generation: the simplex multipliers price
the classes and a knapsack dynamic program finds the best new pattern. Patterns are rounded down, what is left over is
packed largest first into further patterns, and the n-th copy of a pattern takes the documents ranked next in each class.
The driver sees the histogram only, which has ``size / grain`` numbers at any corpus size.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.llm.columns import gapless_slots
from tarnspark.scratch import stored
from tarnspark.llm.token_ids import encoded


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack dynamic program: the dearest multiset of sizes within the capacity."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, room, side="right"))
        worth[room] = worth[room - 1]
        if fit:
            tried = values[:fit] + worth[room - sizes[:fit]]
            k = int(tried.argmax())
            if tried[k] > worth[room] + 1e-12:
                worth[room], last[room] = tried[k], k
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(worth[capacity]), counts


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (as columns) and how often each is used, optimal within ``gap`` unless ``max_columns`` come first."""
    m = len(sizes)
    fill = capacity // sizes
    basis, inverse = np.diag(fill.astype(float)), np.diag(1 / fill)
    used = inverse @ demand
    for _ in range(max_columns):
        price = inverse.sum(axis=0)
        value, column = best_pattern(sizes, price, capacity)
        if value <= 1 + 1e-9 or used.sum() <= (1 + gap) * (demand @ price) / value:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, used / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        inverse[out] /= step[out]
        rest = np.arange(m) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
        basis[:, out] = column
        used = np.maximum(inverse @ demand, 0)
    else:
        warnings.warn(f"column generation stopped after {max_columns} columns; the packing is whole but may hold more padding", stacklevel=3)
    return basis, used


def plan_patterns(histogram: dict[int, int], capacity: int, max_columns: int = 6000, gap: float = 1e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{size: items}`` with their numbers of copies; together they hold the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[int(s)] for s in sizes], dtype=float)
    columns, used = relaxed(sizes, demand, capacity, max_columns, gap)
    left = demand.astype(np.int64)
    plans: Counter = Counter()
    for k in np.argsort(-used):
        pattern = columns[:, k].astype(np.int64)
        held = pattern > 0
        copies = min(int(used[k] + 1e-9), int((left[held] // pattern[held]).min()))
        if copies > 0:
            left -= copies * pattern
            plans[tuple(zip(sizes[held].tolist(), pattern[held].tolist()))] += copies
    while left.any():  # largest first, each sequence filled with the largest that fit
        room, pattern = capacity, Counter()
        for k in range(len(sizes) - 1, -1, -1):
            take = min(int(left[k]), room // int(sizes[k]))
            if take:
                pattern[int(sizes[k])] += take
                room -= take * int(sizes[k])
        copies = min(int(left[k]) // pattern[int(s)] for k, s in enumerate(sizes) if int(s) in pattern)
        for k, s in enumerate(sizes):
            left[k] -= copies * pattern.get(int(s), 0)
        plans[tuple(sorted(pattern.items()))] += copies
    return [(dict(p), n) for p, n in plans.items()]


def _measure(tokenizer: str, size: int, end: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, flat, bounds in encoded(batch.column(1), tokenizer, end=end):
                sums = [
                    [zlib.crc32(flat[c : min(c + size, b)].astype("<u4").tobytes()) for c in range(a, b, size)]
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                yield pa.record_batch(
                    [batch.column(0)[at : at + len(bounds) - 1], pa.array(np.diff(bounds)), pa.array(sums, pa.list_(pa.int64()))],
                    names=["__key", "doc_tokens", "__sums"],
                )

    return measure


def _assign(plans, grain: int):
    """Sequence and place of the items by class and rank: one table per class, searched by rank."""
    tables: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for pattern, copies in plans:
        place = 0
        for size in sorted(pattern, reverse=True):
            tables.setdefault(size, []).append((taken[size], base, pattern[size], place))
            taken[size] += pattern[size] * copies
            place += pattern[size]
        base += copies
    arrays = {s: np.array(t, dtype=np.int64) for s, t in tables.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(batch.schema.get_field_index("__class")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank_in_class")).to_numpy()
            seq, place = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for s in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == s)
                row = arrays[s][np.searchsorted(arrays[s][:, 0], rank[mine], side="right") - 1]
                seq[mine] = row[:, 1] + (rank[mine] - row[:, 0]) // row[:, 2]
                place[mine] = row[:, 3] + (rank[mine] - row[:, 0]) % row[:, 2]
            yield batch.append_column("sequence_id", pa.array(seq)).append_column("__place", pa.array(place))

    return assign, base


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 0, grain: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and the ``end`` id; a null or empty text is the ``end`` id alone. Each id lies in one
    piece and each sequence holds at most ``size`` ids, gapless from offset 0. Repeated rows are packed each for itself; a
    null key is carried. An empty table gives an empty result. ``grain`` is the width of a length class, from 1 to ``size``.
    """
    if not 1 <= grain <= size:
        raise ValueError(f"grain has to lie between 1 and size, not at {grain}")
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    sized = stored(rows.mapInArrow(_measure(tokenizer, size, end), "__key long, doc_tokens long, __sums array<long>"), "measured")
    pieces = sized.select("__key", "doc_tokens", F.posexplode("__sums").alias("__pos", "ids_crc32")).select(
        "__key", (F.col("__pos") * F.lit(size)).cast("long").alias("start"),
        F.least(F.lit(size).cast("long"), F.col("doc_tokens") - F.col("__pos") * F.lit(size)).alias("length"), "ids_crc32", "doc_tokens",
    )
    pieces = pieces.withColumn("__class", F.ceil(F.col("length") / F.lit(grain)).cast("long")).withColumn("__order", F.xxhash64("__key", "start"))
    counts = {r[0]: r[1] for r in pieces.groupBy("__class").count().collect()}
    capacity = size // grain
    whole = {s: counts.pop(s) for s in sorted(counts) if s >= capacity}  # these fill a sequence by themselves
    plans = plan_patterns(counts, capacity) + [({s: 1}, n) for s, n in whole.items()]
    assign, _ = _assign(plans, grain)
    ranked = gapless_slots(pieces, "__class", "__order", sum(counts.values()) + sum(whole.values()), "__rank_in_class")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields) + ", sequence_id long, __place long"
    before = Window.partitionBy("sequence_id").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(assign, out).select(
        F.col("__key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )
