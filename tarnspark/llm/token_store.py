"""Token-id store: documents' ids in ascending key order, each compressed by itself under one shared dictionary.

The store is a folder of two Parquet tables. ``blocks`` has one row per run of documents: their keys, token counts,
the offset index of their frames, the dictionary's hash, and the frames one after another; a short document is read
by its offset without touching its neighbours' frames. ``dictionary`` has the zstandard dictionary and its hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.llm.columns import least_hashed
from tarnspark.llm.token_ids import encoded

#: The dictionary is fitted on so many documents at most (those with the least key hashes), so many ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 1 << 16
LEVEL = 3
_BLOCKS = "part int, block int, width int, dictionary string, keys array<long>, tokens array<long>, offsets array<long>, frames binary"


def _first_ids(tokenizer: str, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, flat, bounds in encoded(batch.column(1), tokenizer, end=end):
                ids = [flat[a : min(b, a + SAMPLE_IDS)].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.record_batch([batch.column(0)[at : at + len(ids)], pa.array(ids, pa.binary())], names=["key", "ids"])

    return cut


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, key: str, text: str) -> bytes:
    """The dictionary from a sample whose ids are cut where they are made: at most ``SAMPLE_DOCS`` times ``SAMPLE_IDS`` reach the driver."""
    sample = least_hashed(docs.select(key, text), key, SAMPLE_DOCS)
    ids = [bytes(r["ids"]) for r in sample.mapInArrow(_first_ids(tokenizer, end), f"key {docs.schema[key].dataType.simpleString()}, ids binary").orderBy("key", "ids").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the sample itself is the dictionary
        return b"".join(ids)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _write(tokenizer: str, end: int, dictionary):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        name = hashlib.sha256(known).hexdigest()
        packer = zstandard.ZstdCompressor(level=LEVEL, **_codec(known))
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, flat, bounds in encoded(batch.column(1), tokenizer, end=end):
                frames = [packer.compress(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "block": block, "width": flat.itemsize, "dictionary": name,
                    "keys": batch.column(0)[at : at + len(frames)].to_pylist(), "tokens": np.diff(bounds).tolist(),
                    "offsets": offsets.tolist(), "frames": b"".join(frames),
                }], schema=pa.schema([
                    ("part", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("dictionary", pa.string()),
                    ("keys", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary()),
                ]))
                block += 1

    return write


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Write all documents' ids, each with ``end`` after it, in ascending key order.

    A null or empty text is the ``end`` id alone; null keys come first; rows that share a key are neighbours in any
    order. An empty table makes a store without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    dictionary = train_dictionary(rows, tokenizer, end, "__key", "__text")
    spark.createDataFrame(
        [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "dictionary string, content binary"
    ).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)
    rows.repartitionByRange("__key").sortWithinPartitions("__key").mapInArrow(_write(tokenizer, end, sent), _BLOCKS).write.option(
        "compression", "uncompressed"
    ).parquet(f"{path}/blocks")


def frame_ids(frames: bytes, offsets: list[int], k: int, width: int, dictionary: bytes) -> np.ndarray:
    """The ids of the k-th document of a block, from its own frame alone."""
    packed = memoryview(frames)[offsets[k] : offsets[k + 1]]
    raw = zstandard.ZstdDecompressor(**_codec(dictionary)).decompress(packed)
    return np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")


def _read(dictionary):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        name, opener = hashlib.sha256(known).hexdigest(), zstandard.ZstdDecompressor(**_codec(known))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"block {row['part']}/{row['block']} was written with another dictionary")
                sums = []
                for a, b in zip(row["offsets"], row["offsets"][1:]):
                    ids = np.frombuffer(opener.decompress(row["frames"][a:b]), dtype=f"<u{row['width']}")
                    sums.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                counts = np.array([n for n, _ in sums], dtype=np.int64)
                n = len(sums)
                yield pa.record_batch(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["keys"], pa.int64()),
                        pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array([c for _, c in sums], pa.int64()),
                    ],
                    names=["part", "block", "key", "inner", "n_tokens", "ids_crc32"],
                )

    return read


def read_token_store(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    dictionary = spark.read.parquet(f"{path}/dictionary").first()["content"]
    blocks = spark.read.parquet(f"{path}/blocks")
    sent = spark.sparkContext.broadcast(bytes(dictionary))
    docs = blocks.mapInArrow(_read(sent), "part int, block int, key long, inner long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside")).join(parts, "part")
    return docs.join(starts, ["part", "block"]).select(
        F.col("key").alias(key), (F.col("before") + F.col("inside") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
