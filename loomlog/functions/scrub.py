"""Expressions on a single log line: scrubbing, keys for near-equality, levels, times, messages, components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ANY, B1, B2, NS, WS, S, blank, replace_each, sub, trim

# Escape sequences and other control characters that logs lose.
ESCAPES = r"[\x{1b}\x{9b}][\[()#;?]*(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-ORZcf-nq-uy=><~]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_UNPRINTED = r"[\x00-\x08\x0b-\x1f\x7f\x{9b}]"

# Time stamps that are cut to their time of day, and epoch milliseconds.
ISO_STAMP = r"\d{4}-\d{2}-\d{2}T(\d{2}:\d{2}:\d{2})(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
LOG_STAMP = rf"\d{{4}}-\d{{2}}-\d{{2}}{S}+(\d{{2}}:\d{{2}}:\d{{2}})[.,]\d{{1,6}}"
EPOCH_STAMP = rf"{B1}1[5-9]\d{{11}}{B2}"
SYSLOG_STAMP = rf"(?=[ADFJMNOS])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec){S}+\d{{1,2}}{S}+(\d{{2}}:\d{{2}}:\d{{2}})"
EPOCH = "<epoch>"

URL = rf"(?:https?|wss?)://[^{WS})>\]\"']+"
SCRIPT = r"\.(?:js|jsx|ts|tsx|mjs|cjs):\d+"

# Levels and their ranks.
LEVELS = {"debug": 0, "info": 1, "warning": 2, "warn": 2, "error": 3, "critical": 4, "fatal": 4}
LEVEL = rf"(?i){B1}(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL){B2}"
TIME = rf"(?:^|[^0-9])(\d{{1,2}}):(\d{{2}}):(\d{{2}}){B2}"
COMPONENT = rf"(?i)\[([A-Za-z][\w.-]*)\]|(?:logger|module|component)[=:]{S}*([A-Za-z][\w.-]*)|(?:^|{S})([a-z]+\.[a-z]+[\w.]*){S}*-"


def strip_controls(line: Column, last: Column) -> Column:
    """Without escape sequences, carriage returns (but before a line feed: the end of any but the last line) and controls."""
    clean = sub(line, ESCAPES, "")
    clean = F.when(last, F.replace(clean, F.lit("\r"), F.lit(""))).otherwise(sub(clean, r"\r(?!\z)", ""))
    return F.when(line.rlike(_UNPRINTED), sub(clean, CONTROLS, "")).otherwise(line)


def shorten_url(url: Column) -> Column:
    """Without query and fragment; of a path of five parts or more, only the last two are kept."""
    bare = F.get(F.split(url, "[?#]", -1), F.lit(0))
    shape = rf"^((?:https?|wss?)://[^/]+)(/{NS}*)\z"
    origin = F.regexp_extract(bare, shape, 1)
    parts = F.filter(F.split(F.regexp_extract(bare, shape, 2), "/", -1), lambda p: p != "")
    return F.when(F.size(parts) >= 5, F.concat(origin, F.lit("/.../"), F.array_join(F.slice(parts, -2, 2), "/"))).otherwise(bare)


def shorten_urls(line: Column) -> Column:
    return F.when(line.contains("://"), replace_each(line, URL, shorten_url)).otherwise(line)


def simplify_stamps(line: Column) -> Column:
    for pattern, kept in ((ISO_STAMP, "$1"), (LOG_STAMP, "$1"), (EPOCH_STAMP, EPOCH), (SYSLOG_STAMP, "$1")):
        line = sub(line, pattern, kept)
    return line


def strip_locations(line: Column) -> Column:
    """Without a script location before a tag, and without one at the end."""
    cut = sub(line, rf"^({S}*){NS}+{SCRIPT}{S}+(?=\[)", "$1")
    return F.when(line.rlike(SCRIPT), sub(cut, rf"{S}+{NS}+{SCRIPT}(?::\d+)?\z", "")).otherwise(line)


# Access log entries, and words that keep one as it is.
_ACCESS = rf"^({ANY}*?)\"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS){S}+({NS}+){S}+HTTP/[\d.]+\"{S}*(\d{{3}}){B2}({ANY}*)\z"
_TROUBLE = rf"(?i){B1}(?:error|fail|exception|traceback|fatal|critical|panic|refused|timeout){B2}"
_ACCESS_TIME = rf"(?:^|[\[{WS}])(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)(?=[,\]\-{WS}]|\z)"
_TOOK = rf"(\d+\.?\d*){S}*(ms|s){B2}"


def compact_access(line: Column) -> Column:
    """``"METHOD path HTTP/x" status`` lines as ``[time ]METHOD path → status[ (duration)]``, unless an error is told before."""
    before, method, path, status, after = (F.regexp_extract(line, _ACCESS, i) for i in range(1, 6))
    trouble = before.rlike(_TROUBLE)
    time = F.regexp_extract(before, _ACCESS_TIME, 1)
    lasted = F.concat(F.regexp_extract(after, _TOOK, 1), F.regexp_extract(after, _TOOK, 2))
    compact = F.concat(F.when(time != "", F.concat(time, F.lit(" "))).otherwise(""), method, F.lit(" "), path, F.lit(" → "), status, F.when(lasted != "", F.concat(F.lit(" ("), lasted, F.lit(")"))).otherwise(""))
    return F.when(line.contains("HTTP/") & (method != "") & ~trouble, compact).otherwise(line)


# What is masked, in this order, in skeletons, messages and error signatures, and what signatures lose first.
_SKELETON_MASKS = ((r"\$\d+", "<ID>"), (rf"https?://{NS}+", "<URL>"), (r"\d+", "<N>"), (EPOCH, "<T>"))
_MESSAGE_MASKS = ((r"\$\d+", r"\$X"), (rf"(?i){B1}[0-9a-f]{{8,}}{B2}", "<id>"), (rf"{B1}\d{{4,}}{B2}", "<n>"), (rf"{B1}user_\d+", "user_X"), (rf"{B1}session_\w+", "session_X"))
_SIGNATURE_MASKS = ((r"\$\d+", "_"), (rf"(?i){B1}[0-9a-f]{{6,}}{B2}", "_"), (r"/[\w./$-]+", "/_"), (r"\d+", "_"))
_SIGNATURE_LEADS = (rf"^\[x\d+\]{S}*", rf"^[\d:T.Z{{}}-]+{S}*", rf"(?i)^(ERROR|WARN|WARNING|INFO|DEBUG|FATAL|CRITICAL){S}*", rf"^\[[\w.-]+\]{S}*")


def skeleton(line: Column) -> Column:
    """What stays equal when numbers, ids and addresses change."""
    for pattern, kept in _SKELETON_MASKS:
        line = sub(line, pattern, kept)
    return trim(line)


def level(line: Column) -> Column:
    """The first level word, in capitals; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(line, LEVEL, 1)), F.lit(""))


def rank(level_word: Column) -> Column:
    """A level's rank; null for null, 1 for unknown words."""
    table = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.when(level_word.isNotNull(), F.coalesce(table[F.lower(level_word)], F.lit(1)))


def clock(line: Column) -> Column:
    """The first time of day, as written; null if there is none."""
    h, m, s = (F.regexp_extract(line, TIME, i) for i in (1, 2, 3))
    return F.when(h != "", F.concat(h, F.lit(":"), m, F.lit(":"), s))


def seconds(time: Column) -> Column:
    h, m, s = (F.get(F.split(time, ":"), F.lit(i)).cast("int") for i in range(3))
    return h * 3600 + m * 60 + F.coalesce(s, F.lit(0))


def message(line: Column) -> Column:
    """What follows the first level word; null without one."""
    rest = F.regexp_extract(line, rf"{LEVEL}([\s\S]*)\z", 2)
    return F.when(level(line).isNotNull(), trim(sub(rest, rf"^[\-:{WS}]+", "")))


def normal_message(text: Column) -> Column:
    """A message with its variable parts masked."""
    for pattern, kept in _MESSAGE_MASKS:
        text = sub(text, pattern, kept)
    return text


def component(line: Column) -> Column:
    """The first component name, in lower case; null if there is none."""
    return F.nullif(F.lower(F.concat(*[F.regexp_extract(line, COMPONENT, i) for i in (1, 2, 3)])), F.lit(""))


def error_signature(line: Column) -> Column:
    """A coarse key of the error that a shown line tells; empty for notes and blank lines."""
    cut = sub(line, rf"{S}*\|[^|]+\z", "")
    plain = sub(cut, rf"^{S}+", "")
    for pattern in _SIGNATURE_LEADS:
        plain = sub(plain, pattern, "")
    key = F.when(F.instr(cut, "→") > 0, F.substr(cut, F.instr(cut, "→"))).otherwise(plain)
    for pattern, kept in _SIGNATURE_MASKS:
        key = sub(key, pattern, kept)
    return F.when(line.startswith("[...") | blank(line), F.lit("")).otherwise(trim(key))
