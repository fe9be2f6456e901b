"""Logs as streams: the per-line reductions as they are, and level counts by time window.

Reductions that need a line's neighbours or its whole log run on what a micro-batch holds (``reduce_batches``), log by log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import scrub
from ..plans.reduction import reduce_lines


def scrub_stream(lines: DataFrame) -> DataFrame:
    """URLs, time stamps, script locations and access lines of a stream with a column ``line``; no state is kept."""
    line = scrub.compact_access(scrub.strip_locations(scrub.simplify_stamps(scrub.shorten_urls(F.col("line")))))
    return lines.withColumn("line", line)


def level_counts(lines: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, level, n) per tumbling window; lines later than ``late`` behind the newest are left out.

    State is one row per window and level until the watermark passes the window's end.
    """
    rows = lines.withWatermark(at, late).withColumn("level", scrub.level(F.col("line"))).where("level is not null")
    return rows.groupBy(F.window(at, width), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "level", "n")


def reduce_batches(lines: DataFrame, sink: Callable[[DataFrame, int], None], switches: dict[str, bool] | None = None) -> DataStreamWriter:
    """Reduce each micro-batch of (log_id, line_no, line) and hand it to ``sink(lines, batch_id)``."""
    return lines.writeStream.foreachBatch(lambda batch, number: sink(reduce_lines(batch, switches), number))
