"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores the pairs.

Items are cut into parts. Seeds of a part are its ``gram``-word pieces and its pieces of five words without the middle one,
which also outlast a copy in which every third word is replaced. A seed that few parts hold is rare and joins by itself; a
part's few rarest seeds do so in any case, so that an item of nothing but common phrases is not lost. A piece that many parts
hold, such as the opening of a question, joins only together with another such piece a few words on, if few parts hold the
two. So a phrase that is common among items brings nobody together, and a document's word meets a bounded number of parts.
Documents are read once for pieces that may be seeds, which join the seed table, however large it is; what meets names a part
and a stretch of the document. A second reading aligns those stretches, after ruling out by the words that they share with the
part, which bound the score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.llm.columns import keeps_names, sieve
from tarnspark.llm.kernels import Run, gram_hashes, in_sieve, mix, runs, signed, windows
from tarnspark.scratch import stored

#: Items over so many words are compared in parts of this length, each beginning half a part after the one before.
PART_WORDS = 256
#: Parts that one row of the second reading may carry, and stretches that are aligned at once (in words).
PARTS_A_ROW, GRID_WORDS = 256, 1 << 20
MATCH, MISMATCH, GAP = 2, -1, 1
#: Parts that may hold a seed that joins by itself, a part's seeds that do so in any case, and words within which commoner ones pair.
RARE_PARTS, SURE_SEEDS, PAIR_REACH = 8, 4, 8

IS_BREAK = np.ones(256, dtype=bool)
IS_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain_words(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, A-Z folded, and each text's bounds in them."""
    starts, ends, bounds = run.spans(IS_BREAK[run.data])
    return run.hashes(starts, ends, lower=True), bounds


def part_bounds(words: int) -> list[tuple[int, int]]:
    """Where an item's parts lie: any run of up to half a part's words is whole in one of them, wherever it begins."""
    if words <= PART_WORDS:
        return [(0, words)]
    step = PART_WORDS // 2
    starts = [*range(0, words - PART_WORDS, step), words - PART_WORDS]
    return [(a, a + PART_WORDS) for a in starts]


def _parts(gram: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(1)):
                words, bounds = plain_words(run)
                found = [
                    (i, words[a:b])
                    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                    for a, b in ((lo + x, lo + y) for x, y in part_bounds(hi - lo))
                    if b - a >= gram
                ]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array([at + i for i, _ in found], pa.int64())), pa.array([w.tobytes() for _, w in found], pa.binary())], names=["item", "words"]
                )

    return parts


def spaced_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the words 0, 1, 3 and 4 from each place on."""
    return mix(gram_hashes(words, at, 2) * np.uint64(0x9FB21C651E98DF25) + gram_hashes(words, at + 3, 2))


def pair_hashes(first: np.ndarray, second: np.ndarray, apart: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xD1B54A32D192ED03) + mix(second) + apart.astype(np.uint64))


def _seeds(gram: int):
    """All pieces of each part: seed, whether it is whole (not spaced), part, offset and the part's size."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(raw, np.uint64)
                at, spaced = np.arange(len(words) - gram + 1), np.arange(max(0, len(words) - 4))
                n = len(at) + len(spaced)
                yield pa.record_batch(
                    [
                        pa.array(signed(np.concatenate((gram_hashes(words, at, gram), spaced_hashes(words, spaced))))), pa.array(np.arange(n) < len(at)),
                        pa.array(np.full(n, part)), pa.array(np.concatenate((at, spaced)).astype(np.int32)), pa.array(np.full(n, len(words), dtype=np.int32)),
                    ],
                    names=["seed", "whole", "part", "offset", "size"],
                )

    return seeds


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two pieces of a part, named by both and their distance."""
    for batch in batches:
        one, two, apart = (batch.column(k).to_numpy() for k in range(3))
        yield pa.record_batch([pa.array(signed(pair_hashes(one.view(np.uint64), two.view(np.uint64), apart))), *batch.columns[3:]], names=["seed", "part", "offset", "size"])


def _chosen(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seed, part, offset, size) of the seeds that join, and the pieces that do so only in pairs."""
    held = pieces.groupBy("seed").agg(F.countDistinct("part").alias("parts"))
    rarest = F.row_number().over(Window.partitionBy("part").orderBy("parts", "seed", "offset"))
    judged = stored(pieces.join(held, "seed").withColumn("alone", (F.col("parts") <= RARE_PARTS) | (rarest <= SURE_SEEDS)), "pieces")
    common = judged.where("not alone and whole").select("seed", "part", "offset", "size")
    one, two = common.alias("one"), common.select(F.col("seed").alias("other"), F.col("part").alias("of"), F.col("offset").alias("at"))
    apart = F.col("at") - F.col("offset")
    both = one.join(two, (F.col("part") == F.col("of")) & apart.between(1, PAIR_REACH)).select("seed", "other", apart.cast("int").alias("apart"), "part", "offset", "size")
    pairs = stored(both.mapInArrow(_pair, "seed long, part long, offset int, size int"), "seed-pairs")
    few = pairs.groupBy("seed").agg(F.countDistinct("part").alias("parts")).where(F.col("parts") <= RARE_PARTS).select("seed")
    alone = judged.where("alone").select("seed", "part", "offset", "size")
    return alone.unionByName(pairs.join(few, "seed", "left_semi").select("seed", "part", "offset", "size")), common.select("seed").distinct()


def _hits(sent, gram: int):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, common = sent.value
        for batch in batches:
            for at, run in runs(batch.column(2)):
                words, bounds = plain_words(run)
                starts, of = windows(bounds, gram)
                if not len(starts):
                    continue
                grams = gram_hashes(words, starts, gram)
                text = np.repeat(np.arange(run.n), np.diff(of))
                spaced, spaced_of = windows(bounds, 5)
                seeds, places, texts = [grams, spaced_hashes(words, spaced)], [starts, spaced], [text, np.repeat(np.arange(run.n), np.diff(spaced_of))]
                first = np.flatnonzero(in_sieve(common, grams))
                for apart in range(1, PAIR_REACH + 1):
                    one = first[first + apart < len(grams)]
                    one = one[text[one] == text[np.minimum(one + apart, len(text) - 1)]]
                    one = one[in_sieve(common, grams[one + apart])]
                    seeds.append(pair_hashes(grams[one], grams[one + apart], np.full(len(one), apart)))
                    places.append(starts[one])
                    texts.append(text[one])
                seeds, places, texts = (np.concatenate(x) for x in (seeds, places, texts))
                maybe = np.flatnonzero(in_sieve(table, seeds))
                rows = pa.array(at + texts[maybe])
                yield pa.record_batch(
                    [pa.array(signed(seeds[maybe])), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((places[maybe] - bounds[texts[maybe]]).astype(np.int32))],
                    names=["seed", "doc", "tk", "place"],
                )

    return hits


def smith_waterman(part: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``part`` in each row of ``passages``, and the column where it ends."""
    rows, width = passages.shape
    slope = GAP * np.arange(width, dtype=np.int32)
    above = np.zeros((rows, width), dtype=np.int32)
    best, end = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int64)
    for word in part:
        now = np.where(passages == word, MATCH, MISMATCH).astype(np.int32)
        now[:, 1:] += above[:, :-1]
        np.maximum(now, above - GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.argmax(axis=1)
        score = now[np.arange(rows), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
        above = now
    return best, end


def reach(size: int, least: float) -> int:
    """Words by which an alignment that scores ``least`` can leave the diagonal of a seed in it: it affords no more gaps."""
    return max(0, int((1 - least) * MATCH * size / GAP))


def shared_words(part: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """How many words of ``part`` each row of ``passages`` holds, with multiplicity: no alignment matches more."""
    vocabulary, needed = np.unique(part, return_counts=True)
    at = np.minimum(np.searchsorted(vocabulary, passages), len(vocabulary) - 1)
    row, col = np.nonzero(vocabulary[at] == passages)
    held = np.bincount(row * len(vocabulary) + at[row, col], minlength=len(passages) * len(vocabulary))
    return np.minimum(held.reshape(len(passages), -1), needed).sum(axis=1)


def aligned(words: np.ndarray, bounds: np.ndarray, part: np.ndarray, tries: list[tuple[int, int]], least: float) -> Iterator[tuple[int, float, int]]:
    """(text, score, word where the passage ends) for each stretch (text, cell) in which ``part`` reaches ``least``."""
    size, step = len(part), max(4, len(part) // 2)
    beyond = reach(size, least)
    width = size + step + 2 * beyond
    at_once = max(1, GRID_WORDS // width)
    for a in range(0, len(tries), at_once):
        some = tries[a : a + at_once]
        grid = np.zeros((len(some), width), dtype=np.uint64)
        begin = []
        for r, (text, cell) in enumerate(some):
            lo = max(int(bounds[text]), int(bounds[text]) + cell * step - beyond)
            piece = words[lo : min(lo + width, int(bounds[text + 1]))]
            grid[r, : len(piece)] = piece
            begin.append(lo - int(bounds[text]))
        able = np.flatnonzero(shared_words(part, grid) >= least * size)
        points, end = smith_waterman(part, grid[able])
        for k in np.flatnonzero(points >= least * MATCH * size):
            r = able[k]
            yield some[r][0], float(points[k] / (MATCH * size)), begin[r] + int(end[k])


def _align(least: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(3).to_pylist()
            for at, run in runs(batch.column(2)):
                words, bounds = plain_words(run)
                wanted: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
                items: dict[bytes, set] = defaultdict(set)
                for text in range(run.n):
                    for one in asked[at + text]:
                        wanted[one["words"]] += [(text, c) for c in one["cells"]]
                        items[one["words"]].add((text, one["item"]))
                best: dict[tuple, tuple[float, int]] = {}
                for raw, tries in wanted.items():
                    owners = defaultdict(list)
                    for text, item in items[raw]:
                        owners[text].append(item)
                    for text, score, end in aligned(words, bounds, np.frombuffer(raw, np.uint64), sorted(set(tries)), least):
                        for item in owners[text]:
                            best[text, item] = max(best.get((text, item), (0.0, 0)), (score, end))
                found = [(t, i, *b) for (t, i), b in best.items()]
                rows = pa.array([at + t for t, *_ in found], pa.int64())
                yield pa.record_batch(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array([i for _, i, *_ in found], pa.int64()),
                        pa.array([s for *_, s, _ in found], pa.float64()), pa.array([e for *_, e in found], pa.int64()),
                    ],
                    names=["doc", "tk", "item", "score", "end_word"],
                )

    return align


def _matches(docs: DataFrame, bench: DataFrame, gram: int, least: float, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """doc, tk (the text's hash), item, score, end_word for every row of ``docs`` and item that it matches."""
    spark = docs.sparkSession
    items = bench.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("body")).distinct()
    parts = stored(items.mapInArrow(_parts(gram), "item long, words binary").withColumn("part", F.xxhash64("words")), "parts")
    pieces = parts.select("part", "words").distinct().mapInArrow(_seeds(gram), "seed long, whole boolean, part long, offset int, size int")
    seeds, common = _chosen(pieces)
    seeds = stored(seeds, "seeds")
    sent = spark.sparkContext.broadcast((sieve(seeds, "seed"), sieve(common, "seed")))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("tk"), F.col(text).alias("body"))
    hits = rows.mapInArrow(_hits(sent, gram), "seed long, doc long, tk long, place int").join(seeds, "seed")
    step = F.greatest(F.lit(4), F.floor(F.col("size") / 2))
    cells = hits.select("doc", "tk", "part", F.floor((F.col("place") - F.col("offset")) / step).cast("int").alias("cell"))
    pairs = stored(cells.groupBy("doc", "tk", "part").agg(F.collect_set("cell").alias("cells")), "pairs")
    shelves = max(1, -(-parts.count() // PARTS_A_ROW))
    asked = pairs.join(parts, "part").groupBy("doc", "tk", F.pmod("part", F.lit(shelves)).alias("shelf")).agg(F.collect_list(F.struct("item", "words", "cells")).alias("asked"))
    asked = asked.select(F.col("doc").alias("a_doc"), F.col("tk").alias("a_tk"), "asked")
    met = rows.join(asked, F.col("doc").eqNullSafe(F.col("a_doc")) & (F.col("tk") == F.col("a_tk"))).select("doc", "tk", "body", "asked")
    return met.mapInArrow(_align(least), "doc long, tk long, item long, score double, end_word long")


@keeps_names
def contamination(
    docs: DataFrame, bench: DataFrame, gram: int = 3, least: float = 0.5,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and test item that a passage matches: ``key``, ``item_key``, score, end_word.

    The score is the best local alignment of the item's words in the document, as a share of the item's full score;
    pairs from ``least`` on are returned. Words are runs of letters and digits, A-Z folded. A pair is aligned if it shares a seed:
    a ``gram``-word piece, or five words but for the middle one, that at most ``RARE_PARTS`` parts hold or that is among
    the part's ``SURE_SEEDS`` rarest, or two commoner pieces within ``PAIR_REACH`` words that few parts hold together. How many
    documents hold a seed does not matter. An item with fewer than ``gram`` words matches nothing. An item of over ``PART_WORDS`` words is compared in parts that overlap by half and scores as
    its best part, so 128 of its words in a row are found wherever they begin. Null texts match nothing; null keys are
    carried. Repeated documents give repeated results, repeated items one. Empty tables give an empty result.
    """
    found = _matches(docs, bench, gram, least, key, text, item_key, item_text)
    best = found.groupBy("doc", "tk", "item").agg(F.max(F.struct("score", "end_word")).alias("b"))
    # Shelves of parts give a pair several rows, and repeated documents as many rows each.
    rows = docs.select(F.col(key).cast("long").alias("__doc"), F.xxhash64(text).alias("__tk")).groupBy("__doc", "__tk").agg(F.count(F.lit(1)).alias("__times"))
    out = best.join(rows, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("tk") == F.col("__tk")))
    out = out.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("b.score").alias("score"), F.col("b.end_word").alias("end_word"))


@keeps_names
def decontaminate(
    docs: DataFrame, bench: DataFrame, gram: int = 3, least: float = 0.5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that match no test item (see ``contamination``), with all their columns."""
    found = _matches(docs, bench, gram, least, key, text, item_key, item_text)
    gone = stored(found.select(F.col("doc").alias("__doc"), F.col("tk").alias("__tk")).distinct(), "gone")
    return docs.join(gone, F.col(key).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__tk")), "left_anti")
