"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. In one local JVM, as in tests, a folder is made and set where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarnspark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tarnspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd", after: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors lose nothing.

    Tables in ``after`` that this function made are removed once ``df`` is written; nothing may read them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    forget(*after)
    return found


def forget(*tables: DataFrame | None) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
