"""Line dedup: hash normalised lines, count documents per hash, drop shared lines, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.llm.columns import keeps_names, without
from tarnspark.llm.kernels import IS_SPACE, runs, signed
from tarnspark.scratch import stored

_LINES = "__id long, __text_key long, __pos int, __k1 long, __k2 long"


def _line_keys(least: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            text_keys = batch.column(1).to_numpy(zero_copy_only=False)
            for at, run in runs(batch.column(2)):
                # A line's start is its text's start or follows a newline; stripping shrinks it to its words.
                newline = run.data == 10
                breaks = np.flatnonzero(newline)
                lines_of = np.searchsorted(breaks, run.bounds)
                starts, ends, _ = run.spans(IS_SPACE[run.data])
                if not len(starts):
                    continue
                text_of = np.searchsorted(run.bounds, starts, side="right") - 1
                line_of = np.searchsorted(breaks, starts) + text_of  # distinct over texts as well
                first = np.flatnonzero(np.diff(line_of, prepend=-1))
                last = np.append(first[1:], len(starts)) - 1
                a, b, texts = starts[first], ends[last], text_of[first]
                points = np.concatenate(([0], np.cumsum((run.data & 0xC0) != 0x80)))
                long = points[b] - points[a] >= least
                a, b, texts = a[long], b[long], texts[long]
                pos = np.searchsorted(breaks, a) - lines_of[texts]
                yield pa.record_batch(
                    [
                        pa.array(ids[at + texts]), pa.array(text_keys[at + texts]), pa.array(pos.astype(np.int32)),
                        pa.array(signed(run.hashes(a, b, lower=True, which=0))),
                        pa.array(signed(run.hashes(a, b, lower=True, which=1))),
                    ],
                    names=["__id", "__text_key", "__pos", "__k1", "__k2"],
                )

    return keys


def _reassemble(text: str):
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            dropped = batch.column(batch.schema.get_field_index("__dropped")).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for body, gone in zip(texts, dropped):
                body = body or ""
                n_lines.append(body.count("\n") + 1)
                n_dropped.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    body = "\n".join(x for i, x in enumerate(body.split("\n")) if i not in out)
                kept.append(body)
            rest = [n for n in batch.schema.names if n not in (text, "__dropped")]
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index(n)) for n in rest]
                + [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*rest, text, "n_lines", "n_dropped"],
            )

    return rebuild


@keeps_names
def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop lines that ``min_docs`` or more documents hold, except in the document with the smallest key.

    Adds n_lines (before dropping) and n_dropped, and replaces the text; other columns stay. A null or empty
    text is one empty line. Lines shorter than ``min_chars`` code points after stripping always stay. A line
    repeated within one document counts once for it, and stays or goes there as a whole. Rows with a null key
    neither count nor lose lines; repeated rows count once and are treated alike. An empty table stays empty.
    The hash has 128 bits.
    """
    docs = without(docs, "n_lines", "n_dropped")
    keyed = docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__text_key"), F.col(text).alias("__text"))
    lines = keyed.where("__id is not null").mapInArrow(_line_keys(min_chars), _LINES)
    if min_docs == 2:
        seen = lines.groupBy("__k1", "__k2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
        shared = seen.where("__first < __last").drop("__last")
    else:
        per_doc = lines.groupBy("__k1", "__k2", "__id").agg(F.lit(1).alias("__one"))
        seen = per_doc.groupBy("__k1", "__k2").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__docs"))
        shared = seen.where(F.col("__docs") >= min_docs).drop("__docs")
    shared = stored(shared, "shared")  # so that both sides of the join are plain shuffles and a hot line can be split
    dropped = (
        lines.join(shared, ["__k1", "__k2"]).where("__id > __first")
        .groupBy(F.col("__id").alias("__gone_id"), F.col("__text_key").alias("__gone_key"))
        .agg(F.collect_set("__pos").alias("__dropped"))
    )
    tagged = docs.join(
        dropped, (F.col(key) == F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_key")), "left"
    ).drop("__gone_id", "__gone_key")
    rest = [f for f in docs.schema.fields if f.name != text]
    out = T.StructType([*rest, T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return tagged.mapInArrow(_reassemble(text), out).select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")
