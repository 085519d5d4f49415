"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer NumPy network.

Each word slot owns a sparse random index vector. A slot's word vector is the sum of the index vectors met within two
places of it, over all documents. The table of vectors has a fixed size, so it can be broadcast at any corpus size.
Documents are the mean of their words' vectors; a small network, fitted on a bounded sample of labelled rows, turns
that into a probability whose temperature is set on rows that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.columns import least_hashed
from tarnspark.llm.kernels import IS_SPACE, Run, runs

SLOTS, WIDTH, NONZERO, REACH = 1 << 13, 32, 4, 2
#: The network is fitted on so many labelled rows at most, those with the least hashes of their keys.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, BATCH = 48, 60, 256

_rng = np.random.default_rng(7)
INDEX_PLACE = np.argsort(_rng.random((SLOTS, WIDTH)), axis=1)[:, :NONZERO]
INDEX_SIGN = np.where(_rng.random((SLOTS, NONZERO)) < 0.5, -1.0, 1.0)

_KIND = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 letters and digits, 2 other marks
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[IS_SPACE] = 0


def slots(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a run's words (stretches of letters and digits, or of other marks), and the texts' bounds in them."""
    if not len(run.data):
        return np.zeros(0, np.int64), np.zeros(run.n + 1, np.int64)
    kind = _KIND[run.data]
    edge = np.ones(len(kind) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[run.bounds] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return (run.hashes(starts, ends, lower=False) >> np.uint64(40)).astype(np.int64) % SLOTS, np.searchsorted(starts, run.bounds)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(SLOTS * WIDTH)
    left, right, waiting = [], [], 0

    def flush() -> None:
        nonlocal waiting
        if waiting:
            a, b = np.concatenate(left), np.concatenate(right)
            for one, two in ((a, b), (b, a)):
                for k in range(NONZERO):
                    table[:] += np.bincount(one * WIDTH + INDEX_PLACE[two, k], weights=INDEX_SIGN[two, k], minlength=SLOTS * WIDTH)
            left.clear(), right.clear()
            waiting = 0

    for batch in batches:
        for _, run in runs(batch.column(0)):
            words, bounds = slots(run)
            text = np.repeat(np.arange(run.n), np.diff(bounds))
            for reach in range(1, REACH + 1):
                same = text[reach:] == text[:-reach]
                left.append(words[:-reach][same])
                right.append(words[reach:][same])
                waiting += int(same.sum())
            if waiting > 2_000_000:
                flush()
    flush()
    table = table.reshape(SLOTS, WIDTH)
    some = np.flatnonzero(np.abs(table).sum(axis=1))
    yield pa.record_batch(
        [pa.array(some.astype(np.int32)), *(pa.array(table[some, k]) for k in range(WIDTH))], names=["slot", *(f"v{k}" for k in range(WIDTH))]
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of unit word vectors, counted over all of ``docs``; slots without neighbours are zero."""
    columns = [f"v{k}" for k in range(WIDTH)]
    parts = docs.select(text).mapInArrow(_tally, "slot int, " + ", ".join(f"{c} double" for c in columns))
    summed = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    table = np.zeros((SLOTS, WIDTH))
    table[summed["slot"].to_numpy()] = summed[columns].to_numpy()
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(run: Run, vectors: np.ndarray) -> np.ndarray:
    """Each text's mean word vector, and that vector's length; zero for a text without words."""
    words, bounds = slots(run)
    sums = np.zeros((len(words) + 1, WIDTH))
    np.cumsum(vectors[words], axis=0, out=sums[1:], dtype=np.float64)
    mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
    return np.hstack((mean, np.linalg.norm(mean, axis=1, keepdims=True)))


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on the log loss, with the weights that do best on a tenth of the rows; their temperature is set on another tenth.

    With fewer than two classes the network is constant at the share of ones (one half without rows).
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2 or len(y) < 10:
        return net
    order = rng.permutation(len(y))
    tenth = max(1, len(y) // 10)
    check, unseen, train = order[:tenth], order[tenth : 2 * tenth], order[2 * tenth :]
    net.center, net.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    z = (x - net.center) / net.scale
    net.w1 = rng.normal(0, np.sqrt(2 / width), (width, HIDDEN))
    net.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    best, kept, t = np.inf, None, 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(train)
        for a in range(0, len(mixed), BATCH):
            xb, yb = z[mixed[a : a + BATCH]], y[mixed[a : a + BATCH]]
            hidden = np.maximum(xb @ weights[0] + weights[1], 0)
            off = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3][0]))) - yb) / len(yb)
            back = np.outer(off, weights[2]) * (hidden > 0)
            slopes = [xb.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ off, np.array([off.sum()])]
            t += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = _loss(np.maximum(z[check] @ weights[0] + weights[1], 0) @ weights[2] + weights[3][0], y[check])
        if loss < best:
            best, kept = loss, [w.copy() for w in weights]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    logits = net.logits(x[unseen])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    net.temperature = float(grid[np.argmin([_loss(logits / t, y[unseen]) for t in grid])])
    return net


def _pool(vectors):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(1)):
                x = pooled(run, vectors.value)
                yield pa.record_batch([batch.column(0)[at : at + run.n], pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    return pool


def _apply(sent):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        for batch in batches:
            for at, run in runs(batch.column(2)):
                p = net.probability(pooled(run, vectors))
                yield pa.record_batch(
                    [batch.column(0)[at : at + run.n], batch.column(1)[at : at + run.n], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["key", "held_out", "score", "predicted"],
                )

    return apply


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted for every row of ``docs``.

    Rows whose crc32 of the key modulo 3 is 1 are held out: their labels are never read. Word vectors count all texts;
    the network is fitted on at most ``SAMPLE_ROWS`` labelled rows. A null or empty text scores as a text without words.
    Rows with a null key are scored and never used for fitting; repeated rows score alike. A key counts once in the fit, with
    one of its texts and its greatest label. An empty table stays empty.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text)
    sent = spark.sparkContext.broadcast(vectors)
    open_ = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    sample = least_hashed(open_.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("double")).alias("__y")), "__key", SAMPLE_ROWS)
    known = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sample), F.col("__id") == F.col("__key"))
    known = known.groupBy("__key").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("__t"), F.max("__y").alias("__y")).select("__y", "__t.__text")
    rows = known.select("__y", "__text").mapInArrow(_pool(sent), "y double, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), WIDTH + 1)
    order = np.lexsort((*x.T, rows["y"].to_numpy()))  # the fit must not depend on the order of arrival
    net = fit(x[order], rows["y"].to_numpy()[order])
    sent = spark.sparkContext.broadcast((vectors, net))
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("__key"), held_out(key).alias("__held"), F.col(text).alias("__text"))
    return plain.mapInArrow(_apply(sent), f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)
