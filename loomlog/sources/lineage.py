"""Where a plan is cut: a reliable checkpoint that any executor can read."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def frozen(df: DataFrame) -> DataFrame:
    """The rows of df, written to the cluster's shared folder (``spark.checkpoint.dir``) and read from there.

    Where that setting is unset, a temporary folder serves on one machine, as in tests; a cluster has to set it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomlog-checkpoint-"))
    return df.checkpoint(eager=True)


def frozen_logs(lines: DataFrame) -> DataFrame:
    """Frozen lines, each log in one partition and in order; under ``fixed_plans`` later windows over logs know that and shuffle nothing."""
    return frozen(lines.repartition("log_id").sortWithinPartitions("log_id", "line_no"))


@contextmanager
def fixed_plans(spark: SparkSession) -> Iterator[None]:
    """What is frozen in this block is planned once: an adaptive plan's checkpoint forgets how its rows are dealt out and sorted."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
