"""Gaps and islands: consecutive lines with one key, as runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lines import by_log


def mark_runs(lines: DataFrame, key: Column, joins: Column | None = None) -> DataFrame:
    """Add ``key`` and ``run``: a run goes on while the key stays the same; where ``joins`` is false, a line stands alone."""
    marked = lines.withColumn("key", key).withColumn("joins", F.lit(True) if joins is None else joins)
    before = F.lag(F.struct("key", "joins")).over(by_log())
    goes_on = F.col("joins") & before["joins"] & before["key"].eqNullSafe(F.col("key"))
    return marked.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(by_log())).drop("joins")


def runs_of(marked: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per run: log_id, run, key, line_no (of its first line), n, and the aggregates."""
    return marked.groupBy("log_id", "run").agg(F.first("key").alias("key"), F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"), *aggregates)


def in_order(*columns: str) -> Column:
    """The columns of a group's rows as an array, by line_no."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", *columns)))
    return rows if len(columns) > 1 else F.transform(rows, lambda x: x[columns[0]])
