"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_batches(spark: SparkSession) -> None:
    """Have rows sent to Python in batches of at most 1,000: a batch of long texts is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= 1_000:
        spark.conf.set(name, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only on one machine, as in tests, a temporary folder stands in for it."""
    sc = spark.sparkContext
    context = sc._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="loomlog-checkpoint-")
        sc.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def frozen(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """Tables written to the shared folder, compressed, and read from there; ``drop`` removes them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.folder = shared_folder(spark)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the tables written so far; frames that read them can't be used any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths.clear()


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished work removed: Spark does so when the driver's garbage is collected.

    Python's references to the JVM are given up by another thread: its garbage is collected once that had time to run.
    """
    gc.collect()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


#: What workers keep from task to task, by kind of work: how to forget it.
_KEPT: dict[str, Callable[[], None]] = {}


def keep(kind: str, forget: Callable[[], None]) -> None:
    """Say how a worker forgets what this kind of work keeps for its next task."""
    _KEPT[kind] = forget


def make_room() -> None:
    """Forget what other kinds of work have kept in this worker: called at the start of a task that needs memory itself."""
    if _KEPT:
        for forget in _KEPT.values():
            forget()
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Return a Python worker's freed memory to the system; called at the end of a task, as workers are kept for other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds`` (null keys hash as the text ``null``)."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)).cast("int")


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions of the session: the number of groups that bucketed stages deal out at least."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
