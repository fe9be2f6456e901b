"""Focus queries: predicates, pages, context, gaps and footers over a log's lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scrub
from ..functions.text import blank
from ..sources.lines import by_log, renumber
from .runs import mark_runs

_RANGE = re.compile(r"(\d{1,2}:\d{2}(?::\d{2})?)\s*-\s*(\d{1,2}:\d{2}(?::\d{2})?)", re.ASCII)


@dataclass(frozen=True)
class Focus:
    """What to look for. level, grep, contains and component are alternatives, within time_range; not_grep takes away."""

    level: str | None = None
    grep: str | None = None
    contains: str | None = None
    component: str | None = None
    time_range: str | None = None
    not_grep: str | None = None
    context: int | None = None
    before: int | None = None
    after: int | None = None
    context_level: str | None = None
    limit: int | None = None
    skip: int | None = None
    summary: bool = False

    @property
    def active(self) -> bool:
        """not_grep, context and pages alone aren't a query."""
        return bool(self.level or self.grep or self.contains or self.component or self.time_range or self.summary)

    def without_summary(self) -> Focus:
        return replace(self, summary=False)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


def parse_range(text: str | None) -> tuple[int, int] | None:
    """Seconds of the day at both ends of HH:MM[:SS]-HH:MM[:SS]; null if it can't be read."""
    m = _RANGE.fullmatch(text or "")
    if not m:
        return None

    def seconds(time: str) -> int:
        h, minute, *s = map(int, time.split(":"))
        return h * 3600 + minute * 60 + (s[0] if s else 0)

    return seconds(m[1]), seconds(m[2])


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine takes the pattern: an invalid one would fail the query, where it should match nothing."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def min_rank(level: str) -> int:
    return scrub.LEVELS.get(level, 1)


def level_at_least(line: Column, level: str) -> Column:
    return F.coalesce(scrub.rank(scrub.level(line)) >= min_rank(level), F.lit(False))


def in_time_range(line: Column, low: int, high: int) -> Column:
    return F.coalesce(scrub.seconds(scrub.clock(line)).between(low, high), F.lit(False))


def matches(spark: SparkSession, focus: Focus, line: Column) -> Column:
    """The predicate of a focus on a line."""
    wanted = []
    if focus.level:
        wanted.append(level_at_least(line, focus.level))
    if focus.grep:
        wanted.append(line.rlike(f"(?i){focus.grep}") if valid_pattern(spark, focus.grep) else F.lit(False))
    if focus.contains:
        wanted.append(line.contains(focus.contains))
    if focus.component:
        wanted.append(F.lower(line).contains(focus.component.lower()))
    span = parse_range(focus.time_range)
    out = F.lit(span is not None)
    if wanted:
        out = wanted[0]
        for more in wanted[1:]:
            out = out | more
    if span:
        out = out & in_time_range(line, *span)
    if focus.not_grep and valid_pattern(spark, focus.not_grep):
        out = out & ~line.rlike(f"(?i){focus.not_grep}")
    return out


def annotate(lines: DataFrame, focus: Focus) -> DataFrame:
    """lines with hit (matches), total (hits of the log), nth (of a hit), page (a hit that is shown) and visible.

    Two windows over one partitioning by log: counts, and a frame of ``after`` rows before to ``before`` rows after a line.
    """
    spark = lines.sparkSession
    before, after = (n if n is not None else focus.context if focus.context is not None else 3 for n in (focus.before, focus.after))
    skip = focus.skip or 0
    marked = lines.withColumn("hit", F.coalesce(matches(spark, focus, F.col("line")), F.lit(False)))
    marked = marked.withColumns({"nth": F.count_if("hit").over(by_log().rowsBetween(Window.unboundedPreceding, 0)), "total": F.count_if("hit").over(Window.partitionBy("log_id"))})
    page = F.col("hit") & (F.col("nth") > skip)
    if focus.limit is not None:
        page = page & (F.col("nth") <= skip + focus.limit)
    marked = marked.withColumn("page", page)
    near = F.max(F.col("page").cast("int")).over(by_log().rowsBetween(-after, before)) == 1
    if focus.context_level:
        rank = scrub.rank(scrub.level(F.col("line")))
        near = near & (rank.isNull() | (rank >= min_rank(focus.context_level)))
    return marked.withColumn("visible", F.col("page") | near)


def with_gaps(marked: DataFrame) -> DataFrame:
    """The visible lines with notes of how many were left out between them, and after them unless the log ends in a blank."""
    everything = Window.partitionBy("log_id")
    place = F.row_number().over(by_log())
    rows = marked.withColumns({"place": place, "size": F.count(F.lit(1)).over(everything), "final": F.max_by("line", "line_no").over(everything)}).where("visible")
    rows = rows.withColumns({"gap": F.col("place") - F.lag("place").over(by_log()) - 1, "rest": F.when(F.lead("place").over(by_log()).isNull(), F.col("size") - F.col("place"))})

    def note(n: str) -> Column:
        return F.concat(F.lit("[... "), F.col(n).cast("string"), F.when(F.col(n) == 1, " line").otherwise(" lines"), F.lit(" omitted ...]"))

    texts = F.array(F.when(F.col("gap") > 0, note("gap")), F.col("line"), F.when((F.col("rest") > 0) & ~blank(F.col("final")), note("rest")))
    out = rows.select("log_id", "line_no", F.posexplode(F.array_compact(texts)).alias("sub", "text"))
    return renumber(out, "line_no", "sub").select("log_id", "line_no", F.col("text").alias("line"))


def drop_similar(lines: DataFrame) -> DataFrame:
    """Runs of lines that tell one error: a single line as it is, of two the first one twice, of more the first and a note."""
    key = scrub.error_signature(F.col("line"))
    runs = mark_runs(lines, key, key != "").groupBy("log_id", "run").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line"), F.count(F.lit(1)).alias("n"))
    note = F.concat(F.lit("[... "), (F.col("n") - 1).cast("string"), F.lit(" similar lines omitted ...]"))
    texts = F.array(F.col("line"), F.when(F.col("n") == 2, F.col("line")).when(F.col("n") > 2, note))
    out = runs.select("log_id", "line_no", F.posexplode(F.array_compact(texts)).alias("sub", "text"))
    return renumber(out, "line_no", "sub").select("log_id", "line_no", F.col("text").alias("line"))


_FOOTER_LEVELS = ("debug", "info", "warning", "error", "critical", "fatal")


def hidden_levels(marked: DataFrame) -> DataFrame:
    """(log_id, level, n) of lines that aren't visible."""
    word = F.lower(scrub.level(F.col("line")))
    return marked.where(~F.col("visible")).select("log_id", F.when(word == "warn", "warning").otherwise(word).alias("level")).where("level is not null").groupBy("log_id", "level").agg(F.count(F.lit(1)).alias("n"))


def footers(marked: DataFrame) -> DataFrame:
    counts = hidden_levels(marked).groupBy("log_id").pivot("level", list(_FOOTER_LEVELS)).agg(F.first("n"))
    parts = F.array_compact(F.array(*[F.when(F.col(f"`{x}`").isNotNull(), F.concat(F.col(f"`{x}`").cast("string"), F.lit(f" {x}"))) for x in _FOOTER_LEVELS]))
    return counts.select("log_id", F.concat(F.lit("\n[filtered: "), F.array_join(parts, ", "), F.lit("]")).alias("footer"))


def apply_focus(lines: DataFrame, focus: Focus) -> DataFrame:
    """The answer to a focus query: lines per log, with a header for a page and a footer of hidden levels."""
    if focus.summary:
        from .summary import render_summary

        return render_summary(lines)
    skip = focus.skip or 0
    marked = annotate(lines, focus)
    # what each log shows, without its lines: one row a log
    states = marked.groupBy("log_id").agg(F.count_if("hit").alias("hits"), F.count_if("page").alias("shown"), F.min("line_no").alias("start"))
    body = drop_similar(with_gaps(marked)).select("log_id", F.lit(1).alias("part"), "line_no", "line")
    limit = F.lit(focus.limit) if focus.limit is not None else F.col("hits")
    paged = (F.col("shown") > 0) & ((F.lit(skip) > 0) | (F.lit(skip) + limit < F.col("hits")))
    told = (
        F.when(F.col("hits") == 0, F.lit("[no lines matched the focus filters]"))
        .when(F.col("shown") == 0, F.concat(F.lit("["), F.col("hits").cast("string"), F.lit(f" matches found, but skip={skip} exceeds match count]")))
        .when(paged, F.concat(F.lit(f"[showing matches {skip + 1}-"), (F.lit(skip) + F.col("shown")).cast("string"), F.lit(" of "), F.col("hits").cast("string"), F.lit(" total]")))
    )
    out = body.unionByName(states.select("log_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("line_no"), told.alias("line")).where("line is not null"))
    if focus.level:
        # a footer stands in a line of its own
        feet = footers(marked).join(states.where("shown > 0").select("log_id"), "log_id", "left_semi")
        out = out.unionByName(feet.select("log_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("line_no"), F.substr("footer", F.lit(2)).alias("line")))
    return renumber(out, "part", "line_no").select("log_id", "line_no", "line")
