"""The whole reduction, step by step, and its measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import char_count, token_count
from ..operators import line_rules, sequential, whole_log
from ..operators.focus import Focus, apply_focus
from ..sources.lineage import fixed_plans, frozen, frozen_logs
from ..sources.lines import renumber


@dataclass(frozen=True)
class Step:
    """A named reduction of lines; the name is also its switch. ``rereads``: its plan reads its input more than once."""

    name: str
    title: str
    apply: Callable[[DataFrame], DataFrame]
    rereads: bool = False

    def __call__(self, lines: DataFrame) -> DataFrame:
        """Apply it; what is read more than once is cut first, or all steps before would run as often."""
        return self.apply(frozen(lines) if self.rereads else lines)


#: All reductions, in the order in which they are applied.
STEPS = (
    Step("stripAnsi", "Strip ANSI", line_rules.strip_ansi),
    Step("normalizeWhitespace", "Normalize Whitespace", line_rules.normalize_whitespace),
    Step("shortenIds", "Shorten IDs", whole_log.shorten_ids, rereads=True),
    Step("shortenUrls", "Shorten URLs", line_rules.shorten_urls),
    Step("simplifyTimestamps", "Simplify Timestamps", line_rules.simplify_timestamps),
    Step("stripEnvelope", "Strip Envelope", whole_log.strip_envelope, rereads=True),
    Step("filterNoise", "Filter Noise", line_rules.filter_noise),
    Step("stripSourceLocations", "Strip Source Locations", line_rules.strip_source_locations),
    Step("collapseTestStatus", "Collapse Test Status", line_rules.collapse_test_status),
    Step("collapsePipOutput", "Collapse Pip Output", sequential.collapse_pip_output),
    Step("collapseDockerLayers", "Collapse Docker Layers", line_rules.collapse_docker_layers),
    Step("compactAccessLogs", "Compact HTTP Access Logs", line_rules.compact_access_logs),
    Step("compressPrefix", "Compress Prefix", line_rules.compress_prefix),
    Step("deduplicateLines", "Deduplicate Lines", whole_log.deduplicate_lines, rereads=True),
    Step("detectCycles", "Detect Cycles", sequential.collapse_cycles),
    Step("mergeScattered", "Merge Scattered Duplicates", line_rules.merge_scattered),
    Step("foldRepeatedPrefix", "Fold Repeated Prefix", sequential.fold_repeated_prefix),
    Step("foldStackTraces", "Fold Stack Traces", sequential.fold_stack_traces),
    Step("collapseRetries", "Collapse Retries", sequential.collapse_retry_sections),
)
NAMES = tuple(s.name for s in STEPS)


def chosen(switches: dict[str, bool] | None = None) -> list[Step]:
    """The steps that are on: all but those switched off."""
    unknown = set(switches or ()) - set(NAMES)
    if unknown:
        raise ValueError(f"no such step: {', '.join(sorted(unknown))}")
    return [s for s in STEPS if (switches or {}).get(s.name, True)]


def reduce_lines(lines: DataFrame, switches: dict[str, bool] | None = None, focus: Focus | None = None) -> DataFrame:
    """Apply the steps that are on, then the focus query if it asks for anything."""
    out = fold(lambda df, step: step(df), chosen(switches), lines)
    return apply_focus(frozen(out), focus) if focus and focus.active else out


def measures(lines: DataFrame) -> DataFrame:
    """(log_id, tokens, lines, chars) of each log; line feeds between lines count as characters."""
    body = lines.groupBy("log_id").agg(F.sum(token_count(F.col("line"))).alias("tokens"), F.count(F.lit(1)).alias("n"), F.sum(char_count(F.col("line"))).alias("chars"))
    return body.select("log_id", "tokens", F.when((F.col("n") == 1) & (F.col("chars") == 0), 0).otherwise(F.col("n")).cast("long").alias("lines"), (F.col("chars") + F.col("n") - 1).alias("chars"))


def step_measures(lines: DataFrame, switches: dict[str, bool] | None = None) -> DataFrame:
    """(log_id, step_no, step, tokens_before, tokens_after, lines_before, ..., tokens_saved_pct): a row per log and step.

    Step 0 of the result is the total. Saved is the share of tokens that went, in percent to one decimal; null of nothing.
    """
    steps = chosen(switches)
    with fixed_plans(lines.sparkSession):
        now = frozen_logs(lines)
        stages = [measures(now).withColumn("step_no", F.lit(0))]
        for i, step in enumerate(steps, 1):
            now = frozen_logs(step.apply(now))
            stages.append(measures(now).withColumn("step_no", F.lit(i)))
        every = frozen(fold(DataFrame.unionByName, stages))  # a few numbers a log, read four times: else all lines of all steps would be
    cols = ("tokens", "lines", "chars")
    after = every.where("step_no > 0").select("log_id", "step_no", *[F.col(c).alias(f"{c}_after") for c in cols])
    before = every.select("log_id", (F.col("step_no") + 1).alias("step_no"), *[F.col(c).alias(f"{c}_before") for c in cols])
    pairs = before.join(after, ["log_id", "step_no"])
    first = every.where("step_no = 0").select("log_id", *[F.col(c).alias(f"{c}_before") for c in cols])
    last = after.where(F.col("step_no") == len(steps)).drop("step_no")
    total = first.join(last, "log_id").withColumn("step_no", F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in [(0, "Total"), *((i, s.title) for i, s in enumerate(steps, 1))] for x in pair])
    saved = F.when(F.col("tokens_before") > 0, F.round((F.col("tokens_before") - F.col("tokens_after")) * 100.0 / F.col("tokens_before"), 1))
    return pairs.unionByName(total).withColumns({"step": names[F.col("step_no")], "tokens_saved_pct": saved})


def signal_ratio(lines: DataFrame, pattern: str) -> DataFrame:
    """(log_id, signal_tokens, tokens, ratio): tokens on lines that match the pattern, of all."""
    tokens = token_count(F.col("line"))
    sums = lines.groupBy("log_id").agg(F.sum(F.when(F.col("line").rlike(pattern), tokens).otherwise(0)).alias("signal_tokens"), F.sum(tokens).alias("tokens"))
    return sums.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("signal_tokens") / F.col("tokens")).otherwise(0.0))


def scoring_sample(lines: DataFrame, front: int = 200, back: int = 50) -> DataFrame:
    """What an outside judge is shown of a log: all of it, or its first and last lines around a note of how many are left out."""
    w = Window.partitionBy("log_id").orderBy("line_no")
    rows = lines.withColumns({"place": F.row_number().over(w), "size": F.count(F.lit(1)).over(Window.partitionBy("log_id"))})
    rows = rows.where((F.col("size") <= front + back) | (F.col("place") <= front) | (F.col("place") > F.col("size") - back))
    note = F.concat(F.lit("[... "), (F.col("size") - front - back).cast("string"), F.lit(" lines omitted ...]"))
    texts = F.array_compact(F.array(F.col("line"), F.when((F.col("place") == front) & (F.col("size") > front + back), note)))
    return renumber(rows.select("log_id", "line_no", F.posexplode(texts).alias("sub", "text")), "line_no", "sub").select("log_id", "line_no", F.col("text").alias("line"))


def render_measures(measured: DataFrame) -> DataFrame:
    """(log_id, text): the measures of a log's steps as a table, the total last."""
    cells = [F.rpad("step", 28, " ")]
    for c in ("tokens", "lines", "chars"):
        cells += [F.lpad(F.format_number(f"{c}_before", 0), 12, " "), F.lit(" → "), F.rpad(F.format_number(f"{c}_after", 0), 12, " ")]
    saved = F.coalesce(F.concat(F.format_number("tokens_saved_pct", 1), F.lit("%")), F.lit("N/A"))
    place = F.when(F.col("step_no") == 0, 1 << 20).otherwise(F.col("step_no"))
    rows = measured.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.concat(*cells, saved).alias("text")))).alias("rows"))
    return rows.select("log_id", F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("text"))
