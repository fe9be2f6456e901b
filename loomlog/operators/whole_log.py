"""Reductions that need a log's dictionary, its commonest envelope, or groups over all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scrub
from ..functions.text import ANY, B1, B2, NS, WS, B, S, blank, sub, trim
from ..sources.lineage import frozen
from ..sources.lines import resplit
from .runs import in_order, mark_runs, runs_of

# Identifiers, in the order in which they are numbered.
IDENTIFIERS = (
    rf"{B1}eyJ[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}{B}",
    rf"{B1}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{B2}",
    rf"{B1}(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{{7,}}{B2}",
    rf"{B1}(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]{{20,}}{B2}",
    rf"{B1}(?=[A-Za-z0-9_]*_)(?=[A-Za-z0-9_]*\d)(?=[A-Za-z0-9_]*[a-zA-Z])[A-Za-z0-9_]{{20,}}{B2}",
)
#: What a line holds wherever one of them matches.
_HINT = r"\p{XDigit}{7}|[\w-]{20}"
#: A private character per kind of identifier holds its place while the others are looked for.
_MASKS = tuple(chr(0xE001 + i) for i in range(len(IDENTIFIERS)))


def _located(kind: int):  # noqa: ANN202
    return lambda token, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), token.alias("token"))


def find_identifiers(lines: DataFrame) -> DataFrame:
    """lines with ``masked`` text and ``found``: (kind, ord, token) of each identifier."""
    masked, found = F.col("line"), []
    for kind, (pattern, mask) in enumerate(zip(IDENTIFIERS, _MASKS, strict=True)):
        tokens = F.regexp_extract_all(masked, F.lit(pattern), F.lit(0))
        found.append(F.transform(tokens, _located(kind)))
        masked = sub(masked, pattern, mask)
    return lines.withColumns({"masked": masked, "found": F.concat(*found)})


def id_dictionary(found: DataFrame) -> DataFrame:
    """(log_id, token, id): identifiers numbered from 1 by kind, then by where they first appear."""
    tokens = found.select("log_id", "line_no", F.explode("found").alias("f"))
    first = tokens.groupBy("log_id", F.col("f.token").alias("token")).agg(F.min(F.struct("f.kind", "line_no", "f.ord")).alias("at"))
    return first.select("log_id", "token", F.row_number().over(Window.partitionBy("log_id").orderBy("at")).alias("id"))


def shorten_ids(lines: DataFrame) -> DataFrame:
    """Identifiers as $1, $2, ... of a dictionary for the whole log.

    Only lines with identifiers are joined, token by token, with the dictionary: no log's dictionary is one value.
    """
    found = frozen(find_identifiers(lines.where(F.col("line").rlike(_HINT))))  # read three times
    plain = lines.where(~F.col("line").rlike(_HINT)).unionByName(found.where(F.size("found") == 0).select("log_id", "line_no", "line"))
    rich = found.where(F.size("found") > 0)
    tokens = rich.select("log_id", "line_no", F.explode("found").alias("f")).select("log_id", "line_no", "f.kind", "f.ord", "f.token")
    named = tokens.join(id_dictionary(found), ["log_id", "token"])
    per_line = named.groupBy("log_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("kind", "ord", F.concat(F.lit("$"), F.col("id").cast("string")).alias("name")))).alias("names"))

    def fill(text: Column, kind: int) -> Column:
        mine = F.filter("names", lambda x: x["kind"] == kind)
        parts = F.split(text, _MASKS[kind], -1)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(mine, lambda x, i: F.concat(x["name"], F.get(parts, i + 1))), ""))

    text = reduce(fill, range(len(IDENTIFIERS)), F.col("masked"))
    return plain.unionByName(rich.join(per_line, ["log_id", "line_no"]).select("log_id", "line_no", text.alias("line")))


_STAMP = r"\d{1,2}:\d{2}:\d{2}"


def _envelope(line: Column) -> Column:
    """What is before a second occurrence of the first time stamp, ten characters in or later; null without one."""
    stamps, parts = F.regexp_extract_all(line, F.lit(_STAMP), F.lit(0)), F.split(line, _STAMP, -1)

    def start(i: Column) -> Column:
        before = F.array_join(F.slice(parts, 1, i + 1), "")
        return F.char_length(before) + F.char_length(F.array_join(F.slice(stamps, 1, i), ""))

    later = F.filter(F.sequence(F.lit(0), F.size(stamps) - 1), lambda i: (i > 0) & (F.get(stamps, i) == F.get(stamps, F.lit(0))) & (start(i) >= 10))
    at = F.when(F.size(stamps) > 1, start(F.get(later, F.lit(0))))
    return sub(F.substr(line, F.lit(1), at), r"\d{4}-\d{2}-\d{2}[T ]?\z", "")


def _envelope_skeleton(envelope: Column) -> Column:
    for pattern, kept in ((_STAMP, "TS"), (r"\$\d+", r"\$X"), (rf"(?i){B1}[a-f0-9]{{12,}}{B2}", "HEX"), (rf"{B1}\d+{B2}", "N")):
        envelope = sub(envelope, pattern, kept)
    return envelope


def _envelope_pattern(sample: Column) -> Column:
    """A pattern of the sample with holes for times, short ids, long hex numbers and bracketed levels.

    Fixed values: what becomes a hole, in this order.
    """
    levels = "(?:info|error|warn(?:ing)?|debug|notice|critical)"
    text = sub(sample, r"[.*+?^${}()|\[\]\\]", r"\\$0")
    text = sub(text, _STAMP, r"\\d{1,2}:\\d{2}:\\d{2}")
    text = sub(text, r"\\\$\d+", r"\\\$\\d+")
    text = sub(text, r"(?i)[a-f0-9]{12,}", "[a-f0-9]+")
    text = sub(text, rf"(?i)\\\[{levels}\\\]", rf"\\[{levels}\\]")
    return F.concat(F.lit("^"), text)


def strip_envelope(lines: DataFrame) -> DataFrame:
    """Take off the commonest prefix that repeats a line's own time stamp, where it is common enough in its log."""
    twice = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(":"), F.lit(""))) >= 4  # colons of two stamps
    seen = lines.withColumn("envelope", F.when(twice, _envelope(F.col("line"))))
    totals = seen.groupBy("log_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~blank(F.col("line"))).alias("shown"), F.count("envelope").alias("splits"))
    kinds = seen.where("envelope is not null").groupBy("log_id", _envelope_skeleton(F.col("envelope")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "envelope")).alias("first"))
    best = kinds.groupBy("log_id").agg(F.max(F.struct("n", (-F.col("first.line_no")).alias("early"), "first.envelope")).alias("best"))
    worth = (F.col("lines") >= 4) & (F.col("splits") >= F.col("shown") * 0.3) & (F.col("best.n") >= F.col("splits") * 0.5)
    patterns = best.join(totals, "log_id").where(worth).select("log_id", _envelope_pattern(F.col("best.envelope")).alias("pattern"))
    joined = lines.join(patterns, "log_id", "left")
    off = F.coalesce(F.regexp_substr("line", "pattern"), F.lit(""))
    body = F.substr("line", F.char_length(off) + 1)
    strip = F.col("pattern").isNotNull() & ~blank(F.col("line")) & (off != "") & ~blank(body)
    return joined.select("log_id", "line_no", F.when(strip, body).otherwise(F.col("line")).alias("line"))


_TOKEN = rf"https?://{NS}+|\$\d+|\d+"


def _formatted(runs: DataFrame) -> DataFrame:
    """The lines of runs (an array ``rows``) as one: a single one, the first one and a note, or a template with its values.

    What several expressions need is a column of its own, so that it is made once.
    """
    clean = lambda t: F.when(t.rlike("^https?://"), sub(t, r"[.,;:]+\z", "")).otherwise(t)
    first = F.get("rows", F.lit(0))
    several = F.size("rows") > 1
    runs = runs.withColumns({"raw": F.when(several, F.regexp_extract_all(first, F.lit(_TOKEN), F.lit(0))), "parts": F.when(several, F.split(sub(first, r"\r\z", ""), _TOKEN, -1))})
    runs = runs.withColumn("tokens", F.when(several, F.transform("rows", lambda x: F.transform(F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0)), clean))))
    runs = runs.withColumn("own", F.get("tokens", F.lit(0)))
    places = F.transform("own", lambda _, p: p)
    runs = runs.withColumn("varying", F.filter(places, lambda p: F.exists("tokens", lambda t: F.coalesce(F.get(t, p), F.lit("")) != F.get("own", p))))
    runs = runs.withColumn("ports", F.when(several, F.regexp_extract_all(first, F.lit(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:(\d+)"), F.lit(1))))
    is_port = lambda p: F.get("own", p).rlike(r"^\d{3,5}\z") & F.array_contains("ports", F.get("own", p))
    runs = runs.withColumn("told", F.filter("varying", lambda p: ~is_port(p)))
    kind = lambda p: F.when(F.get("own", p).rlike("^https?://"), F.lit("URL")).otherwise(F.lit("N"))
    number = lambda among, p: F.when(F.size(among) == 1, F.lit("")).otherwise(F.array_position(among, p).cast("string"))

    def shown(raw: Column, p: Column) -> Column:
        hole = F.when(is_port(p), F.lit("{port}")).otherwise(F.concat(F.lit("{"), kind(p), number("varying", p), F.lit("}")))
        return F.concat(F.when(F.array_contains("varying", p), hole).otherwise(raw), F.get("parts", p + 1))

    runs = runs.withColumn("template", F.concat(F.get("parts", F.lit(0)), F.array_join(F.transform("raw", shown), "")))
    values = F.transform("told", lambda p: F.concat(F.lit(" | "), kind(p), number("told", p), F.lit(" = "), F.array_join(F.transform("tokens", lambda t: F.coalesce(F.get(t, p), F.lit(""))), ", ")))
    size = F.size("rows").cast("string")
    identical = F.concat(first, F.lit("\n[... "), (F.size("rows") - 1).cast("string"), F.lit(" identical lines omitted ...]"))
    text = F.when(~several, first).when(F.size("varying") == 0, identical).otherwise(F.concat(F.lit("[x"), size, F.lit("] "), "template", F.array_join(values, "")))
    return runs.select("log_id", "line_no", text.alias("line"))


def collapse_runs(lines: DataFrame) -> DataFrame:
    """Runs of lines with one skeleton as one line each (which may hold a line feed); line_no is the run's first."""
    lines = lines.withColumn("skeleton", scrub.skeleton(F.col("line")))
    marked = mark_runs(lines, F.col("skeleton"), F.col("skeleton") != "")
    return _formatted(runs_of(marked, in_order("line").alias("rows")))


def merge_error_suffixes(lines: DataFrame) -> DataFrame:
    """Lines that end in the same error, three or more in a log, as one line in the place of the last."""
    shape = rf"^({ANY}*?){B}((?:[A-Z][A-Za-z]*)?(?:Error|Exception|Warning|Rejection):{S}{ANY}+)\z"
    error = F.regexp_extract("line", shape, 2)
    told = F.col("line").rlike(rf"(?:Error|Exception|Warning|Rejection):{S}") & (F.char_length(error) >= 20)
    marked = lines.withColumns({"error": F.when(told, error), "before": trim(sub(F.regexp_extract("line", shape, 1), rf"[:{WS}]+\z", ""))})
    groups = marked.where("error is not null").groupBy("log_id", "error").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), in_order("before").alias("names")).where("n >= 3")
    # lines without an error aren't shuffled: all of a log would meet in one task of the join
    plain = lines.where(~F.coalesce(told, F.lit(False)))
    joined = marked.where("error is not null").join(groups, ["log_id", "error"], "left")
    names = F.when(F.forall("names", lambda x: x != ""), F.concat(F.lit(" — "), F.array_join("names", ", "))).otherwise("")
    text = F.concat(F.lit("[x"), F.col("n").cast("string"), F.lit("] "), "error", names)
    shown = joined.where("n is null or line_no = last").select("log_id", "line_no", F.when(F.col("n").isNotNull(), text).otherwise(F.col("line")).alias("line"))
    return plain.select("log_id", "line_no", "line").unionByName(shown)


def deduplicate_lines(lines: DataFrame) -> DataFrame:
    """Runs of similar lines, then of lines with one error, then of what these left, as one line each.

    Each pass is cut from the one before: the second reads its input twice, and windows over windows are planned badly.
    """
    return resplit(collapse_runs(frozen(merge_error_suffixes(frozen(collapse_runs(lines))))))
