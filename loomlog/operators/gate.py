"""The response gate: whether a log's reduction, its summary or its focus answer is returned, by token counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..plans.reduction import reduce_lines
from ..sources.lines import head, join_lines, tail
from .focus import Focus, apply_focus
from .summary import summaries

THRESHOLD, QUERY_BUDGET = 1000, 400
# The legend, and how the tips call what an extractor would need.
_LEGEND = "NOTE: $1, $2 etc. are parameterized values. [x8] = collapsed lines.\n"
_KEY = "an API key"

#: An extractor takes (text, question, budget) and returns the extracted text, or None if it can't.
Extractor = Callable[[Column, str, int], Column]


@dataclass(frozen=True)
class Request:
    """What is asked of a log: cuts, a summary, a focus, a reduction, a question, and how large an answer may be."""

    tail: int | None = None
    head: int | None = None
    summary: bool = False
    focus: Focus = Focus()
    reduce: bool = True
    query: str | None = None
    query_budget: int = QUERY_BUDGET
    threshold: int = THRESHOLD
    break_threshold: bool = False


def respond(lines: DataFrame, request: Request, extract: Extractor | None = None) -> DataFrame:
    """(log_id, text): the response to a request for each log.

    Without an extractor, a question on too large an output gets the output with a note. Summaries are made of the lines as they
    came (after tail and head), so that their counts are true.
    """
    if request.tail is not None and request.tail > 0:
        lines = tail(lines, request.tail)
    if request.head is not None and request.head > 0:
        lines = head(lines, request.head)
    if request.summary:
        return summaries(lines)
    focus = request.focus.without_summary()
    if request.reduce:
        out = reduce_lines(lines, focus=focus if focus.active else None)
    else:
        out = apply_focus(lines, focus) if focus.active else lines
    texts = join_lines(out).select("log_id", "text", token_count(F.col("text")).alias("tokens"))
    raw = lines.groupBy("log_id").agg(F.sum(token_count(F.col("line"))).alias("raw"))
    joined = texts.join(raw, "log_id")
    t, r = F.col("tokens").cast("string"), F.col("raw").cast("string")
    sized = F.concat(F.lit("["), t, F.lit(" tokens (raw: "), r, F.lit(").]\n" + _LEGEND)) if request.reduce else F.concat(F.lit("["), t, F.lit(" tokens (unreduced).]\n"))
    fits = F.concat(sized, F.lit("\n"), "text")
    if request.query:
        if extract is not None:
            found = extract(F.col("text"), request.query, request.query_budget)
            told = F.concat(F.lit("["), token_count(found).cast("string"), F.lit(" tokens extracted (mechanical: "), t, F.lit(" tokens, raw: "), r, F.lit(f'). Query: "{request.query}".]\n\n'), found)
        else:
            told = F.lit(None).cast("string")
        large = F.coalesce(told, fits) if request.break_threshold else F.coalesce(told, F.concat(sized, F.lit(f"TIP: Setting {_KEY} would enable smart extraction to fit within threshold.\n\n"), "text"))
    elif request.break_threshold:
        large = fits
    elif not focus.active:
        joined = joined.join(summaries(lines).withColumnRenamed("text", "overview"), "log_id")
        large = F.concat(F.lit("["), t, F.lit(" tokens reduced (raw: "), r, F.lit(f") exceeds {request.threshold} threshold.]\n\n"), "overview")
    else:
        over = F.concat(F.lit("["), t, F.lit(" tokens (raw: "), r, F.lit(f") exceeds {request.threshold} threshold after filtering.]\n" + _LEGEND)) if request.reduce else F.concat(F.lit("["), t, F.lit(f" tokens (unreduced) exceeds {request.threshold} threshold after filtering.]\n"))
        tip = "TIP: Narrow further with: time_range, grep, limit, context_level\n  Or break_threshold: true to bypass.\n"
        tip += f"  Setting {_KEY} would enable query-based smart extraction.\n\n" if extract is None else "\n"
        large = F.concat(over, F.lit(tip), "text")
    return joined.select("log_id", F.when(F.col("tokens") > request.threshold, large).otherwise(fits).alias("text"))
