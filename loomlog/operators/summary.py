"""Structural summaries of logs: aggregates per log, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scrub
from ..sources.lines import split_lines

#: Levels in the order in which a summary shows them.
LEVEL_ORDER = ("FATAL", "CRITICAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG")
MOST_ERRORS, MOST_WARNINGS, MOST_FREQUENT = 20, 10, 5


def described(lines: DataFrame) -> DataFrame:
    """lines with time, level, message (null if shorter than 3), norm and component (null beside a short message)."""
    line = F.col("line")
    text = scrub.message(line)
    short = F.coalesce(F.char_length(text) < 3, F.lit(False))
    return lines.select(
        "log_id", "line_no",
        scrub.clock(line).alias("time"), scrub.level(line).alias("level"),
        F.when(~short, text).alias("message"), F.when(~short, scrub.normal_message(text)).alias("norm"),
        F.when(~short, scrub.component(line)).alias("component"),
    )


def _at(what: Column, by: Column, pick) -> Column:  # noqa: ANN001
    """The value of the first or last line that has one."""
    return pick(what, F.when(what.isNotNull(), by))


def time_spans(rows: DataFrame) -> DataFrame:
    """(log_id, lines, first_time, last_time): times as they are first and last seen."""
    time, at = F.col("time"), F.col("line_no")
    return rows.groupBy("log_id").agg(F.count(F.lit(1)).alias("lines"), _at(time, at, F.min_by).alias("first_time"), _at(time, at, F.max_by).alias("last_time"))


def level_stats(rows: DataFrame) -> DataFrame:
    """(log_id, level, n, first_time, last_time)."""
    time, at = F.col("time"), F.col("line_no")
    return rows.where("level is not null").groupBy("log_id", "level").agg(F.count(F.lit(1)).alias("n"), _at(time, at, F.min_by).alias("first_time"), _at(time, at, F.max_by).alias("last_time"))


def unique_messages(rows: DataFrame) -> DataFrame:
    """(log_id, kind, norm, display, n, first_line, first_time, last_time), kind being error, warning or other.

    first_time is that of the first occurrence, which may have none; last_time the last one seen.
    """
    rank = scrub.rank(F.col("level"))
    kind = F.when(rank >= 3, "error").when(rank >= 2, "warning").otherwise("other")
    time, at = F.col("time"), F.col("line_no")
    said = rows.where("level is not null and message is not null")
    return said.groupBy("log_id", kind.alias("kind"), "norm").agg(
        F.min_by("message", "line_no").alias("display"), F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"),
        F.get(F.min_by(F.array("time"), "line_no"), F.lit(0)).alias("first_time"), _at(time, at, F.max_by).alias("last_time"),
    )


def frequent_messages(rows: DataFrame, most: int = MOST_FREQUENT) -> DataFrame:
    """(log_id, place, display, n): a log's most frequent messages of any level; ties by first appearance."""
    said = rows.where("level is not null and message is not null")
    counts = said.groupBy("log_id", "norm").agg(F.min_by("message", "line_no").alias("display"), F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    w = Window.partitionBy("log_id").orderBy(F.desc("n"), "first_line")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("log_id", "place", "display", "n")


def components(rows: DataFrame) -> DataFrame:
    """(log_id, components): distinct names, in order."""
    return rows.where("component is not null").groupBy("log_id").agg(F.array_sort(F.collect_set("component")).alias("components"))


def _capped(messages: DataFrame, kind: str, most: int) -> DataFrame:
    """(log_id, block): the messages of a kind in order of appearance, at most ``most``, and how many more there are."""
    w = Window.partitionBy("log_id").orderBy("first_line")
    mine = messages.where(F.col("kind") == kind).withColumns({"r": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy("log_id"))}).where(F.col("r") <= most)
    when = F.when(F.col("first_time").isNull(), "at ?").when(F.col("first_time") == F.col("last_time"), F.concat(F.lit("at "), "first_time")).otherwise(F.concat("first_time", F.lit("—"), "last_time"))
    times = F.when(F.col("n") > 1, F.concat(F.lit("[x"), F.col("n").cast("string"), F.lit("] "))).otherwise("")
    text = F.concat(F.lit("  "), times, F.lit("("), when, F.lit(") "), F.substring("display", 1, 120))
    block = F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("text")))), lambda x: x["text"])
    more = F.when(F.max("total") > most, F.concat(F.lit("  ... and "), (F.max("total") - most).cast("string"), F.lit(f" more unique {kind}s")))
    heading = "Errors:" if kind == "error" else "Warnings:"
    return mine.groupBy("log_id").agg(F.concat(F.array(F.lit(""), F.lit(heading)), block, F.array_compact(F.array(more))).alias(kind))


def summaries(lines: DataFrame) -> DataFrame:
    """(log_id, text): one summary per log. Its lists are capped, so a log's summary has a bounded size."""
    rows = described(lines)
    messages = unique_messages(rows)
    rank = F.array_position(F.array(*map(F.lit, LEVEL_ORDER)), F.col("level"))
    span = F.when(F.col("first_time").isNull(), "").when(F.col("first_time") == F.col("last_time"), F.concat(F.lit(" (at "), "first_time", F.lit(")"))).otherwise(F.concat(F.lit(" ("), "first_time", F.lit(" — "), "last_time", F.lit(")")))
    stat = F.concat(F.lit("  "), "level", F.lit(": "), F.col("n").cast("string"), span)
    levels = level_stats(rows).groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), stat.alias("text")))), lambda x: x["text"]).alias("levels"))
    top = F.concat(F.lit("  [x"), F.col("n").cast("string"), F.lit("] "), F.substring("display", 1, 100))
    frequent = frequent_messages(rows).groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", top.alias("text")))), lambda x: x["text"]).alias("frequent"))
    out = time_spans(rows)
    for more in (levels, _capped(messages, "error", MOST_ERRORS), _capped(messages, "warning", MOST_WARNINGS), frequent, components(rows)):
        out = out.join(more, "log_id", "left")
    none = F.array().cast("array<string>")
    troubled = F.col("error").isNotNull() | F.col("warning").isNotNull()
    # The texts of hints and headings.
    hints = F.array_compact(F.array(
        F.when(troubled, '  level: "error"                  — all errors with context'),
        F.lit('  grep: "pattern"                 — regex search'),
        F.when(F.col("first_time").isNotNull(), '  time_range: "HH:MM:SS-HH:MM:SS" — zoom into a period'),
        F.when(F.size("components") > 1, '  component: "name"               — filter by module'),
        F.lit("  break_threshold: true           — bypass gate, return full output"),
    ))
    parts = F.concat(
        F.array(F.concat(F.lit("SUMMARY ("), F.col("lines").cast("string"), F.lit(" lines)"))),
        F.when(F.col("first_time").isNotNull(), F.array(F.concat(F.lit("Time span: "), "first_time", F.lit(" — "), "last_time"))).otherwise(none),
        F.when(F.col("levels").isNotNull(), F.concat(F.array(F.lit("Levels:")), "levels")).otherwise(none),
        F.coalesce("error", none),
        F.coalesce("warning", none),
        F.when(~troubled & F.col("frequent").isNotNull(), F.concat(F.array(F.lit(""), F.lit("Frequent patterns:")), "frequent")).otherwise(none),
        F.when(F.size("components") > 0, F.array(F.lit(""), F.concat(F.lit("Components: "), F.array_join("components", ", ")))).otherwise(none),
        F.array(F.lit(""), F.lit("Narrow with:")),
        hints,
    )
    return out.select("log_id", F.array_join(parts, "\n").alias("text"))


def render_summary(lines: DataFrame) -> DataFrame:
    return split_lines(summaries(lines))
