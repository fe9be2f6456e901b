"""Reductions that look at a line, its neighbours or its run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scrub
from ..functions.text import ANY, B1, B2, NS, WS, S, blank, number_text, rtrim, sub, token_count
from ..sources.lines import by_log, renumber
from .runs import mark_runs, runs_of

# Noise that is counted when it is dropped.
NOISE = (
    rf"(?i)(?:GET|POST|HEAD){S}+{NS}*/(?:health|healthz|healthcheck|readyz|livez|ready|alive|ping|status){B2}",
    rf"(?i)health[_\-{WS}]?check",
    rf"(?i){B1}heartbeat{B2}",
    rf"(?i){B1}keepalive{B2}",
    rf"(?i){B1}keep-alive{B2}",
    rf"(?i){B1}emitting metrics{B2}",
    rf"(?i){B1}metrics? (?:sent|emitted|published|flushed){B2}",
    rf"(?i){B1}connection pool{B2}{ANY}*{B1}(?:stats|status|size){B2}",
    rf"(?i){B1}GC{B2}{ANY}*{B1}(?:pause|collected|freed){B2}",
    rf"^INFO:{S}+connection (?:open|closed){S}*\z",
    r"Download the React DevTools",
    rf"^{S}*(?:\(\w+\)|[a-zA-Z_$][\w$]*){S}+@{S}*(?:{NS}+\.\w+:\d+)?{S}*\z",
    r"[\x{2501}-\x{28ff}&&[━░▓█▒■⣿⠿]]{4,}",
    rf"\[#+{S}*\]{S}*\d+%",
    rf"=>{S}+\[internal\]{S}+load{S}+(?:build definition|\.dockerignore)",
    rf"=>{S}+=>{S}+transferring (?:dockerfile|context):",
    rf"=>{S}+\[internal\]{S}+load metadata for",
    rf"\[notice\]{S}+A new release of pip is available",
    rf"\[notice\]{S}+To update, run: pip install --upgrade pip",
)
# What a line holds wherever one of them matches, after a look at a single character.
NOISE_HINT = r"(?=[/@=\[hHkKeEmMcCgGR\x{2501}-\x{28ff}])(?:/|@|=>|\[#|\[notice\]|React DevTools|[\x{2501}-\x{28ff}]{4}|(?i:health|heartbeat|keep-?alive|emitting|metric|connection|gc))"
# Lines that go without a trace.
SILENT = (
    rf"^{S}*\d{{1,2}}:\d{{2}}:\d{{2}}{S}*\z",
    rf"^{S}*(?:\(\w+\)|[a-zA-Z_$][\w$]*){S}+@{S}*(?:{NS}+\.\w+:\d+)?{S}*\z",
    rf"^[^a-zA-Z0-9]*[=~]{{4,}}{S}*\z",
    rf"[-=] [=~]{{10,}}{S}*\z",
)
SILENT_HINT = rf"@|[=~]{{4}}|^{S}*\d{{1,2}}:\d{{2}}:\d{{2}}{S}*\z"
# Lines of passed tests.
PASSED = (rf"^PASS{S}+{NS}+(?:{S}+\([\d.]+s\))?{S}*\z", rf"^ok{S}+{NS}+{S}+[\d.]+s{S}*\z", rf"^PASSED{S}+{NS}+")
# Separators, and structured lines ([date ]time - module - level - message).
SEPARATORS = (rf"^{ANY}*{B1}(?:INFO|WARNING|ERROR|DEBUG|WARN|CRITICAL){S}*-{S}*[=\-*]{{4,}}{S}*\z", rf"^[=\-*]{{4,}}{S}*\z")
STRUCTURED = rf"^(?:(\d{{4}}-\d{{2}}-\d{{2}}){S}+)?(\d{{1,2}}:\d{{2}}:\d{{2}}){S}+-{S}+({NS}+){S}+-{S}+(INFO|WARNING|ERROR|DEBUG|WARN|CRITICAL){S}+-{S}+({ANY}*)"
LAYER = rf"^({S}*=>{S}+=>{S}+)(pushing|exporting) layer{S}+{NS}+{S}+(\d+\.?\d*)s{S}*\z"


def any_of(line: Column, patterns: tuple[str, ...], hint: str | None = None) -> Column:
    """One alternation: each pattern keeps its own flags. The hint is a cheap pattern that fits wherever one of them does."""
    found = line.rlike("|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns))
    return found if hint is None else line.rlike(hint) & found


def strip_ansi(lines: DataFrame) -> DataFrame:
    last = F.lead("line_no").over(by_log()).isNull()
    return lines.withColumn("line", scrub.strip_controls(F.col("line"), last))


def normalize_whitespace(lines: DataFrame) -> DataFrame:
    """Ends of lines trimmed; of blank lines only single ones stay, and only between others."""
    w = Window.partitionBy("log_id")
    trimmed = lines.withColumn("line", rtrim(F.col("line")))
    shown = F.col("line") != ""
    marked = trimmed.withColumns({"first": F.min(F.when(shown, F.col("line_no"))).over(w), "last": F.max(F.when(shown, F.col("line_no"))).over(w), "start": F.min("line_no").over(w), "before": F.lag("line").over(by_log())})
    inside = (F.col("line_no") > F.col("first")) & (F.col("line_no") < F.col("last"))
    # a log without any other line is one empty line
    only = F.col("first").isNull() & (F.col("line_no") == F.col("start"))
    return renumber(marked.where(shown | (inside & (F.col("before") != "")) | only).select("log_id", "line_no", "line"))


def shorten_urls(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", scrub.shorten_urls(F.col("line")))


def simplify_timestamps(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", scrub.simplify_stamps(F.col("line")))


def strip_source_locations(lines: DataFrame) -> DataFrame:
    """Script locations before a tag and at the end are dropped; a line (but the first) that is only one goes as a whole."""
    alone = F.col("line").rlike(scrub.SCRIPT) & F.col("line").rlike(rf"^{S}*{NS}+{scrub.SCRIPT}(?::\d+)?\z") & (F.col("line_no") > F.min("line_no").over(Window.partitionBy("log_id")))
    marked = lines.withColumn("alone", alone)
    # blank lines right before such a line belong to the white space that goes with it
    upwards = Window.partitionBy("log_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(~blank(F.col("line")), F.col("alone")), ignorenulls=True).over(upwards)
    kept = marked.withColumn("eaten", blank(F.col("line")) & F.coalesce(following, F.lit(False))).where(~F.col("alone") & ~F.col("eaten"))
    return renumber(kept.select("log_id", "line_no", scrub.strip_locations(F.col("line")).alias("line")))


def compact_access_logs(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", scrub.compact_access(F.col("line")))


def filter_noise(lines: DataFrame) -> DataFrame:
    """Silent lines go; a single noise line goes; of a run of them a note is left where that is shorter."""
    heard = lines.where(~any_of(F.col("line"), SILENT, SILENT_HINT)).withColumn("tokens", token_count(F.col("line")))
    noise = any_of(F.col("line"), NOISE, NOISE_HINT)
    marked = mark_runs(heard, noise, noise)
    run = Window.partitionBy("log_id", "run")
    marked = marked.withColumns({"n": F.count(F.lit(1)).over(run), "total": F.sum("tokens").over(run), "head": F.min("line_no").over(run)})
    noted = F.col("key") & (F.col("n") > 1) & (F.col("total") > 5)
    kept = marked.where(~F.col("key") | ((F.col("n") > 1) & (~noted | (F.col("line_no") == F.col("head")))))
    note = F.concat(F.lit("[... "), F.col("n").cast("string"), F.lit(" lines omitted ...]"))
    return renumber(kept.select("log_id", "line_no", F.when(noted, note).otherwise(F.col("line")).alias("line")))


def collapse_test_status(lines: DataFrame) -> DataFrame:
    """Three or more passed tests in a row as one line."""
    passed = any_of(F.col("line"), PASSED)
    marked = mark_runs(lines, passed, passed)
    run = Window.partitionBy("log_id", "run")
    marked = marked.withColumns({"n": F.count(F.lit(1)).over(run), "head": F.min("line_no").over(run)})
    folded = F.col("key") & (F.col("n") >= 3)
    text = F.concat(F.lit("PASS ["), F.col("n").cast("string"), F.lit(" suites]"))
    return renumber(marked.where(~folded | (F.col("line_no") == F.col("head"))).select("log_id", "line_no", F.when(folded, text).otherwise(F.col("line")).alias("line")))


def collapse_docker_layers(lines: DataFrame) -> DataFrame:
    """Two or more layers pushed, or exported, in a row as one line with their number and the range of their times."""
    kind = F.regexp_extract("line", LAYER, 2)
    marked = mark_runs(lines, kind, kind != "").withColumn("took", F.regexp_extract("line", LAYER, 3).try_cast("double"))
    runs = runs_of(marked, F.min_by("line", "line_no").alias("line"), F.min("took").alias("low"), F.max("took").alias("high"))
    low, high = number_text(F.col("low")), number_text(F.col("high"))
    times = F.concat(low, F.lit("s"), F.when(F.col("low") == F.col("high"), "").otherwise(F.concat(F.lit("-"), high, F.lit("s"))))
    text = F.concat(F.regexp_extract("line", LAYER, 1), F.col("key"), F.lit(" "), F.col("n").cast("string"), F.lit(" layers  "), times)
    return renumber(runs.select("log_id", "line_no", F.when((F.col("key") != "") & (F.col("n") > 1), text).otherwise(F.col("line")).alias("line")))


def compress_prefix(lines: DataFrame) -> DataFrame:
    """Dates, modules, levels and times of structured lines as headings; separators are dropped.

    Runs of one module (within a date) of three lines or more are put under the module; in them, runs of one time of three or
    more are put under the time.
    """
    part = {name: F.regexp_extract("line", STRUCTURED, i) for i, name in ((1, "date"), (2, "time"), (3, "module"), (4, "level"), (5, "message"))}
    rows = lines.where(~any_of(F.col("line"), SEPARATORS, r"[=\-*]{4}")).withColumns(part)
    # the parts of a line stand for it from here on: it would pass through every sort with them
    rows = rows.withColumn("parsed", F.col("time") != "").withColumns({"date": F.nullif("date", F.lit("")), "line": F.when(~F.col("parsed"), F.col("line"))})
    before = by_log().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("known", F.last("date", ignorenulls=True).over(before))
    rows = rows.withColumn("dated", F.col("date").isNotNull() & ~F.col("date").eqNullSafe(F.col("known")))
    # a new date ends the run of a module
    rows = rows.withColumn("era", F.sum(F.col("dated").cast("int")).over(by_log()))
    rows = mark_runs(rows, F.struct("era", "module"), F.col("parsed")).withColumnRenamed("run", "group")
    group = Window.partitionBy("log_id", "group")
    rows = rows.withColumns({"size": F.count(F.lit(1)).over(group), "one_level": F.min("level").over(group) == F.max("level").over(group), "head": F.min("line_no").over(group) == F.col("line_no")})
    rows = rows.withColumn("deep", F.col("parsed") & (F.col("size") >= 3))
    rows = mark_runs(rows, F.struct("group", "time"), F.col("deep"))
    times = Window.partitionBy("log_id", "run")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(times), "first": F.min("line_no").over(times) == F.col("line_no")})
    rows = rows.withColumn("deeper", F.col("deep") & (F.col("n") >= 3))
    said = F.when(F.col("one_level"), F.col("message")).otherwise(F.concat("level", F.lit(" - "), "message"))
    body = (
        F.when(~F.col("parsed"), F.col("line"))
        .when(~F.col("deep"), F.concat_ws(" - ", "time", "module", "level", "message"))
        .when(F.col("deeper"), F.concat(F.lit("    "), said))
        .otherwise(F.concat(F.lit("  "), "time", F.lit(" - "), said))
    )
    headings = F.array(
        F.when(F.col("dated"), F.concat(F.lit("["), "date", F.lit("]"))),
        F.when(F.col("deep") & F.col("head"), F.when(F.col("one_level"), F.concat("module", F.lit(" - "), "level", F.lit(":"))).otherwise(F.concat("module", F.lit(":")))),
        F.when(F.col("deeper") & F.col("first"), F.concat(F.lit("  "), "time", F.lit(":"))),
        body,
    )
    out = rows.select("log_id", "line_no", F.posexplode(F.array_compact(headings)).alias("sub", "text"))
    return renumber(out, "line_no", "sub").select("log_id", "line_no", F.col("text").alias("line"))


def merge_scattered(lines: DataFrame) -> DataFrame:
    """Equal lines that stand apart, on the first one: three or more plain ones, or two or more counted ones ([xN])."""
    from ..functions.text import trim
    from ..sources.lines import resplit

    line, bare = F.col("line"), trim(F.col("line"))
    counted = rf"^\[x(\d+)\]{S}+"
    usable = (bare != "") & ~bare.startswith("[...") & ~line.rlike(f"^{S}") & ~bare.rlike(rf":{S}*\z")
    is_counted = usable & bare.rlike(counted)
    body = sub(sub(line, counted, ""), rf"{S}+\|{S}+{NS}+{S}*={S}*{ANY}+\z", "")
    key = F.when(is_counted, scrub.skeleton(body)).when(usable, bare)
    marked = lines.withColumns({"counted": is_counted, "key": F.nullif(key, F.lit(""))})
    same = Window.partitionBy("log_id", "counted", "key")
    times = F.when(F.col("counted"), F.regexp_extract("line", counted, 1).try_cast("long")).otherwise(F.lit(1))
    marked = marked.withColumns({"n": F.count("key").over(same), "total": F.sum(times).over(same), "head": F.min("line_no").over(same)})
    merged = F.col("key").isNotNull() & (F.col("n") >= F.when(F.col("counted"), 2).otherwise(3))
    again = F.concat("line", F.lit("\n[... above line repeated "), (F.col("n") - 1).cast("string"), F.lit(" more times ...]"))
    text = F.when(~merged, line).when(F.col("counted"), F.concat(F.lit("[x"), F.col("total").cast("string"), F.lit("] "), sub(line, counted, ""))).otherwise(again)
    return resplit(marked.where(~merged | (F.col("line_no") == F.col("head"))).select("log_id", "line_no", text.alias("line")))
