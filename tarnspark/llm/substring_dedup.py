"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``window`` consecutive words, the ``gram``-word piece with the least hash.
Equal windows select equal anchors at equal offsets, so a window can repeat only if its anchor occurs in another
text. Each shared anchor is then extended both ways: every split of the remaining words over its left and right
side is one window, compared by the hash of all its words. Hashes meet the smallest document key per window in an
aggregate, so a passage that a third of all documents share costs one row per holder and never a pair of them.
Overlapping repeated windows merge into maximal repeats, and these go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.llm.columns import keeps_names, without
from tarnspark.llm.kernels import Run, gram_hashes, range_hashes, runs, signed, windows
from tarnspark.scratch import stored

_POSITION_BITS = np.uint64((1 << 24) - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return least


def anchors(run: Run, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Word hashes, their bounds, window starts, their bounds, and the position of each window's anchor."""
    _, _, bounds, words = run.words(lower=False)
    starts, of = windows(bounds, window)
    if not len(starts):
        return words, bounds, starts, of, starts
    grams = gram_hashes(words, np.arange(len(words) - gram + 1), gram)
    place = np.arange(len(grams), dtype=np.uint64) & _POSITION_BITS
    ranked = (grams & ~_POSITION_BITS) | (_POSITION_BITS - place)  # ties go to the rightmost
    least = _sliding_least(ranked, window - gram + 1)[starts]
    back = (_POSITION_BITS - (least & _POSITION_BITS)).astype(np.int64)
    chosen = starts + ((back - starts) & int(_POSITION_BITS))
    return words, bounds, starts, of, chosen


def _sketch(window: int, gram: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(2)):
                words, bounds, starts, of, chosen = anchors(run, window, gram)
                texts = np.repeat(np.arange(run.n), np.diff(of))
                new = np.flatnonzero(np.diff(chosen, prepend=-1) != 0)
                places, holders = chosen[new], texts[new]
                hashes = gram_hashes(words, places, gram) if len(places) else np.zeros(0, np.uint64)
                cuts = pa.array(np.searchsorted(holders, np.arange(run.n + 1)).astype(np.int32))
                counts = np.diff(bounds)
                s1 = range_hashes(words, bounds[:-1], bounds[1:]) if len(words) else np.zeros(run.n, np.uint64)
                s2 = range_hashes(words ^ (words >> np.uint64(7)), bounds[:-1], bounds[1:]) if len(words) else s1
                here = slice(at, at + run.n)
                yield pa.record_batch(
                    [
                        batch.column(0)[here], batch.column(1)[here], pa.array(counts), pa.array(signed(s1)), pa.array(signed(s2)),
                        pa.ListArray.from_arrays(cuts, pa.array(signed(hashes))),
                        pa.ListArray.from_arrays(cuts, pa.array((places - bounds[holders]).astype(np.int32))),
                    ],
                    names=["__id", "__tk", "__words", "__s1", "__s2", "__anchors", "__places"],
                )

    return sketch


def _extend(window: int, gram: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, shared = (batch.column(i) for i in (0, 1, 3))
            ids, keys = ids.to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False)
            for at, run in runs(batch.column(2)):
                words, bounds, starts, of, chosen = anchors(run, window, gram)
                if not len(starts):
                    continue
                hit = np.zeros(len(words), dtype=bool)
                part = shared.slice(at, run.n)
                per_text = np.diff(part.offsets.to_numpy())
                hit[part.flatten().to_numpy(zero_copy_only=False) + np.repeat(bounds[:-1], per_text)] = True
                go = hit[chosen]
                first = starts[go]
                texts = np.repeat(np.arange(run.n), np.diff(of))[go]
                yield pa.record_batch(
                    [
                        pa.array(signed(gram_hashes(words, first, window))), pa.array(ids[at + texts]), pa.array(keys[at + texts]),
                        pa.array((first - bounds[texts]).astype(np.int32)),
                    ],
                    names=["__window", "__id", "__tk", "__start"],
                )

    return extend


def _cut(text: str, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            kept, n_words, n_removed = [], [], []
            for body, starts, copy in zip(col(text).to_pylist(), col("__starts"), col("__copy").to_pylist()):
                words = (body or "").encode().split()  # bytes split on exactly [\x20\x09-\x0D]
                n_words.append(len(words))
                if copy and len(words) >= window:
                    n_removed.append(len(words))
                    kept.append("")
                    continue
                if starts.is_valid and len(starts):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    begin = np.unique(starts.values.to_numpy())
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + window, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    n_removed.append(int(len(words) - stays.sum()))
                    words = [words[i] for i in np.flatnonzero(stays)]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            rest = [n for n in batch.schema.names if n not in (text, "__starts", "__copy")]
            yield pa.record_batch(
                [col(n) for n in rest] + [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=[*rest, text, "n_words", "n_removed"],
            )

    return cut


@keeps_names
def dedup_substrings(docs: DataFrame, window: int = 50, gram: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word in a run of ``window`` words that also starts in a document with a smaller key.

    Anchors have ``gram`` words, half a window if not given; one that is longer than the window raises.

    Adds n_words and n_removed and replaces the text by its kept words, joined by one space; other columns stay.
    A null or empty text has no words. Rows with a null key keep all words. Rows that share a key never remove
    each other's words. An empty table stays empty. Windows are judged on the input; copies of a whole text are
    settled by the text's hash alone and never reach the window stage.
    """
    gram = (window + 1) // 2 if gram is None else gram
    if not 0 < gram <= window:
        raise ValueError("an anchor has at least one word and no more than a window")
    docs = without(docs, "n_words", "n_removed")
    rows = docs.select(F.col(key).alias("__id"), F.hash(text).alias("__tk"), F.col(text).alias("__text")).where("__id is not null")
    sketches = stored(
        rows.mapInArrow(
            _sketch(window, gram),
            "__id long, __tk int, __words long, __s1 long, __s2 long, __anchors array<long>, __places array<int>",
        ),
        "sketches",
    )
    firsts = sketches.groupBy("__s1", "__s2").agg(F.min("__id").alias("__first"))
    seeds = sketches.select("__id", "__tk", "__s1", F.explode(F.arrays_zip("__anchors", "__places")).alias("__a"))
    seeds = seeds.select("__id", "__tk", "__s1", F.col("__a.__anchors").alias("__anchor"), F.col("__a.__places").alias("__place"))
    # Stored, so that both sides of the join are plain shuffles and a hot anchor's rows can be split over tasks.
    shared = stored(
        seeds.groupBy("__anchor").agg(F.min("__s1").alias("__lo"), F.max("__s1").alias("__hi"))
        .where("__lo < __hi").select("__anchor"),
        "shared",
    )
    hits = seeds.join(shared, "__anchor", "left_semi").groupBy("__id", "__tk").agg(F.collect_set("__place").alias("__shared"))
    plan = (
        sketches.select("__id", "__tk", "__words", "__s1", "__s2").join(firsts, ["__s1", "__s2"])
        .select("__id", "__tk", ((F.col("__id") > F.col("__first")) & (F.col("__words") >= window)).alias("__copy"))
        .distinct()
    )
    plan = stored(plan.join(hits, ["__id", "__tk"], "left").where("__copy or __shared is not null"), "plan")
    open_rows = plan.where("not __copy").select("__id", "__tk", "__shared")
    found = stored(
        rows.join(open_rows, ["__id", "__tk"]).select("__id", "__tk", "__text", "__shared")
        .mapInArrow(_extend(window, gram), "__window long, __id long, __tk int, __start int"),
        "windows",
    )
    least = stored(
        found.groupBy("__window").agg(F.min("__id").alias("__lo"), F.max("__id").alias("__hi")).where("__lo < __hi"), "least"
    )
    gone = (
        found.join(least.select("__window", "__lo"), "__window").where("__id > __lo")
        .groupBy("__id", "__tk").agg(F.collect_set("__start").alias("__starts"))
    )
    marks = (
        plan.where("__copy").select("__id", "__tk", F.lit(True).alias("__copy"), F.lit(None).cast("array<int>").alias("__starts"))
        .unionByName(gone.select("__id", "__tk", F.lit(False).alias("__copy"), "__starts"))
    )
    tagged = docs.join(marks, (F.col(key) == F.col("__id")) & (F.hash(text) == F.col("__tk")), "left").drop("__id", "__tk")
    rest = [f for f in docs.schema.fields if f.name != text]
    out = T.StructType(
        [*rest, T.StructField(text, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )
    return tagged.mapInArrow(_cut(text, window), out).select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", "n_removed")
