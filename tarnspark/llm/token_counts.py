"""Token counts by a separator scan over flat, unindexed token files.

A token file is a stream of ids in which one id ends each document, cut into blocks of a fixed number of ids without
regard to documents. Each block is searched for the end id by one vectorised comparison; a prefix scan over a file's
blocks (ids so far, separators so far, place of the last separator) then stitches the documents that span blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.llm.token_ids import encoded
from tarnspark.scratch import stored

BLOCK_IDS = 1 << 18
#: Blocks of a file whose numbers one task scans in a row.
SCAN_BLOCKS = 4096
_FILES = "file int, block int, width int, ids binary, keys array<long>"
_ARROW = pa.schema(
    [("file", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("keys", pa.list_(pa.int64()))]
)


def _write(tokenizer: str, end: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, rest, chapter = TaskContext.get().partitionId(), 0, None, 0
        row = lambda **x: pa.RecordBatch.from_pylist([dict.fromkeys(_ARROW.names) | {"file": file} | x], schema=_ARROW)
        for batch in batches:
            for at, flat, bounds in encoded(batch.column(1), tokenizer, plain=True, end=end):
                yield row(block=chapter, keys=batch.column(0)[at : at + len(bounds) - 1].to_pylist())
                chapter += 1
                rest = flat if rest is None else np.concatenate((rest, flat))
                while len(rest) >= block_ids:
                    yield row(block=block, width=rest.itemsize, ids=rest[:block_ids].tobytes())
                    rest, block = rest[block_ids:], block + 1
        if rest is not None and len(rest):
            yield row(block=block, width=rest.itemsize, ids=rest.tobytes())

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 50256, block_ids: int = BLOCK_IDS, key: str = "doc_id", text: str = "text") -> None:
    """One token file per input partition under ``path``, and beside them the keys in the files' order.

    Strings of special tokens are ordinary text, so the end id occurs at documents' ends only.
    """
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    rows.mapInArrow(_write(tokenizer, end, block_ids), _FILES).write.option("compression", "zstd").parquet(path)


def read_flat_files(spark: SparkSession, files: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of plain binary token files (little-endian ids of ``width`` bytes), in the table form of this module.

    Spark lists the files; each block is a range of bytes that its own task opens and reads, from any store that
    ``pyarrow.fs`` knows, so a file may be larger than a task's memory. A file that ends within an id raises.
    """
    step = block_ids * width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size % width:
                    raise ValueError(f"{name} has {size} bytes, which are no whole ids of {width}")
                store, path = FileSystem.from_uri(name)
                with store.open_input_file(path) as opened:
                    content = opened.read_at(min(step, size - block * step), block * step)
                yield pa.record_batch(
                    [pa.array([name]), pa.array([block], pa.int32()), pa.array([width], pa.int32()), pa.array([content], pa.binary())],
                    names=["file", "block", "width", "ids"],
                )

    listed = spark.read.format("binaryFile").load(files).select("path", "length").where("length > 0")
    last = F.floor((F.col("length") - 1) / step)
    ranges = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "length")
    dealt = ranges.withColumn("block", F.col("block").cast("int")).repartition("path", "block")
    return dealt.mapInArrow(read, "file string, block int, width int, ids binary")


def _scan(end: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes = [], []
            for width, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                places.append(np.flatnonzero(ids == end))
                sizes.append(len(ids))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64()))],
                names=["file", "block", "size", "ends"],
            )

    return scan


def count_tokens(blocks: DataFrame, end: int = 50256) -> DataFrame:
    """file, ordinal (the document's number in its file), start and n_tokens (both without and before its end id).

    ``blocks`` has file, block, width and ids. Ids after a file's last end id are no document. An empty file has none;
    two end ids in a row enclose an empty document.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = stored(blocks.select("file", "block", "width", "ids").mapInArrow(_scan(end), f"file {kind}, block int, size long, ends array<long>"), "ends")
    # The scan takes three numbers a block: within chunks of blocks, then over a file's chunks.
    chunk = F.floor(F.col("block") / SCAN_BLOCKS).alias("chunk")
    sizes = found.select("file", "block", chunk, "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    so_far = lambda w, c: F.coalesce(F.sum(c).over(w), F.lit(0))
    within = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("base", so_far(within, "size")).withColumn("earlier", so_far(within, "n")).withColumn("last", F.col("base") + F.col("last")).withColumn("open", F.max("last").over(within))
    across = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.select("file", "chunk", "block", "size", "n").groupBy("file", "chunk").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    chunks = chunks.join(inner.groupBy("file", "chunk").agg(F.max("last").alias("last")), ["file", "chunk"]).withColumn("gone", so_far(across, "size")).withColumn("told", so_far(across, "n"))
    chunks = chunks.withColumn("left", F.max(F.col("last") + F.col("gone")).over(across)).select("file", "chunk", "gone", "told", "left")
    scanned = inner.where("n > 0").join(chunks, ["file", "chunk"]).select(
        "file", "block", (F.col("base") + F.col("gone")).alias("base"), (F.col("earlier") + F.col("told")).alias("earlier"),
        F.coalesce(F.col("open") + F.col("gone"), "left", F.lit(-1)).alias("open"),
    )
    stitched = found.where(F.size("ends") > 0).join(scanned, ["file", "block"]).select("file", "base", "ends", "earlier", "open")
    spans = stitched.select(
        "file", "earlier",
        F.posexplode(
            F.transform(
                "ends",
                lambda e, i: F.struct(
                    F.when(i == 0, F.col("open")).otherwise(F.get("ends", i - 1) + F.col("base")).alias("from"), (e + F.col("base")).alias("to")
                ),
            )
        ).alias("i", "span"),
    )
    return spans.select(
        "file", (F.col("earlier") + F.col("i")).alias("ordinal"), (F.col("span.from") + 1).alias("start"),
        (F.col("span.to") - F.col("span.from") - 1).alias("n_tokens"),
    )


def document_token_counts(docs: DataFrame, path: str, tokenizer: str, end: int = 50256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and n_tokens of every document, read back from token files written under ``path``.

    A null or empty text has 0 tokens; null keys and repeated rows each get a row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    write_token_files(docs, path, tokenizer, end, key=key, text=text)
    files = spark.read.schema(_FILES).parquet(path)
    counts = count_tokens(files.where("ids is not null"), end)
    lists = files.where("keys is not null").select("file", "block", "keys")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = lists.withColumn("earlier", F.coalesce(F.sum(F.size("keys")).over(before), F.lit(0))).select(
        "file", "earlier", F.posexplode("keys").alias("i", "key")
    ).select("file", (F.col("earlier") + F.col("i")).alias("ordinal"), "key")
    return names.join(counts, ["file", "ordinal"]).select(F.col("key").alias(key), "n_tokens")
