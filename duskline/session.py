"""Session helpers: read tables, find the shared checkpoint folder, cut lineage.

Executors of a cluster see neither the driver's nor each other's local disk. Whatever an iterative job materialises
therefore goes through ``DataFrame.checkpoint()`` into ``spark.checkpoint.dir`` (a folder all executors share). Only a
local session without that setting, as in tests, gets a folder of its own; on a cluster its absence is an error.
"""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

_TEST_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, whole; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local session that has none."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _TEST_DIR:
            _TEST_DIR.append(tempfile.mkdtemp(prefix="duskline-checkpoint-"))
        shared = _TEST_DIR[0]
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that nothing refers to any more, and their checkpoint files where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
