"""Published files: kinds, sizes, header checks and digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.functions.naming import artifact_kind, region_id_of
from tarnspark.scratch import stored

HEADER_BYTES, CHUNK_BYTES = 127, 8 << 20
# Where the header keeps each section's offset; its length is the next 8 bytes.
SECTIONS = {"root directory": 8, "metadata": 24, "leaf directories": 40, "tile data": 56}


def _little(header: Column, at: int) -> Column:
    """An unsigned little-endian 64-bit number as a decimal."""
    return F.conv(F.hex(_reversed(header, at)), 16, 10).cast("decimal(20,0)")


def _reversed(header: Column, at: int) -> Column:
    return F.concat(*[F.substring(header, at + 8 - k, 1) for k in range(8)])


def _open(path: str):
    store, inside = FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            with _open(path) as opened:
                found.append(opened.read(HEADER_BYTES))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["path", "bytes", "h"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with _open(path) as opened:
                while piece := opened.read(CHUNK_BYTES):
                    digest.update(piece)
            yield pa.record_batch([pa.array([path]), pa.array([digest.hexdigest()])], names=["path", "sha256"])


def _store(path: str):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, root = FileSystem.from_uri(path)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with home.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.record_batch([batch.column(0), pa.array([len(c.as_buffer()) for c in batch.column(1)], pa.int64())], names=["filename", "bytes"])

    return store


def sink_files(files: DataFrame, path: str) -> int:
    """Write each row (filename, content) as a file under ``path``, from its own task; how many there are. A task that runs again writes the same."""
    home, root = FileSystem.from_uri(path)
    home.create_dir(root, recursive=True)
    return files.select("filename", "content").mapInArrow(_store(path), "filename string, bytes long").count()


def artifact_audit(spark: SparkSession, path: str) -> DataFrame:
    """filename, kind, region_id, bytes, minzoom, maxzoom, sha256 of the tile archives under ``path``; other files go.

    A file whose header lacks the magic number, has another version, or points beyond the file raises, before any digest is
    begun. Spark lists the files; headers and digests are read in tasks, a file in pieces of ``CHUNK_BYTES``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    filename = F.regexp_extract("path", "([^/]+)$", 1)
    listed = files.where(artifact_kind(filename).isNotNull() & filename.like("%.pmtiles")).repartition("path")
    named = listed.mapInArrow(_headers, "path string, bytes long, h binary").withColumn("filename", filename)
    size = F.col("bytes").cast("decimal(20,0)")
    wrong = F.when((F.length("h") < HEADER_BYTES) | (F.substring("h", 1, 7) != F.lit("PMTiles").cast("binary")), "no magic number").when(
        F.hex(F.substring("h", 8, 1)) != "03", "another version"
    )
    for name, at in SECTIONS.items():
        wrong = wrong.when(_little(F.col("h"), at) + _little(F.col("h"), at + 8) > size, f"{name} runs past the end")
    fail = F.raise_error(F.concat("filename", F.lit(": "), F.col("wrong")))
    checked = named.withColumn("wrong", wrong).withColumn("filename", F.when(F.col("wrong").isNotNull(), fail).otherwise(F.col("filename")))
    byte = lambda at: F.conv(F.hex(F.substring("h", at + 1, 1)), 16, 10).cast("int")
    passed = stored(
        checked.select("path", "filename", artifact_kind(F.col("filename")).alias("kind"), region_id_of(F.col("filename")).alias("region_id"), "bytes", byte(100).alias("minzoom"), byte(101).alias("maxzoom")), "headers"
    )
    digests = passed.select("path").repartition("path").mapInArrow(_digests, "path string, sha256 string")
    return passed.join(digests, "path").drop("path")
