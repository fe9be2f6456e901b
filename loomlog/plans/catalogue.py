"""The registered queries over logs, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scrub
from ..functions.text import char_count, line_count, token_count
from ..operators import line_rules, sequential, summary, whole_log
from ..operators.focus import Focus, annotate, apply_focus, drop_similar, hidden_levels, with_gaps
from ..operators.gate import Request, respond
from ..operators.runs import mark_runs, runs_of
from ..sources.lines import head, join_lines, rewrite_logs, split_lines, tail
from .corpora import ALIKE_SQL, CYCLIC_SQL, DOCUMENT_SQL, EVENT_SQL, PERIODIC_SQL, RICH_SQL, SECTION_SQL, SHIPPED_SQL, TRACE_SQL, alike_lines, cyclic_lines, document_lines, event_lines, periodic_lines, rich_lines, section_lines, shipped_lines, trace_lines
from .reduction import STEPS, reduce_lines, scoring_sample, signal_ratio, step_measures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def over(name: str, corpus: Query, plan: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register a plan over a corpus of lines."""
    query(name, sql)(lambda spark, sf_dir: plan(corpus(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_lines(event_lines(spark, sf_dir), focus=Focus(level="error", limit=5, context=3))


# Shared SQL -----------------------------------------------------------------------------------------------------------

_LEVEL = r"nullif(upper(regexp_extract(line, '(?i)\b(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\b', 1)), '')"
_RANK = f"CASE {_LEVEL} WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 WHEN 'FATAL' THEN 4 END"
_TIME = r"nullif(regexp_extract(line, '(?:^|[^0-9])(\d{1,2}:\d{2}:\d{2})\b', 1), '')"
_SECONDS = f"(CAST(string_split({_TIME}, ':')[1] AS INT) * 3600 + CAST(string_split({_TIME}, ':')[2] AS INT) * 60 + CAST(string_split({_TIME}, ':')[3] AS INT))"
_MESSAGE = r"CASE WHEN regexp_matches(line, '(?i)\b(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\b') THEN trim(regexp_replace(regexp_extract(line, '(?i)\b(?:DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\b(.*)$', 1), '^[\s\-:]+', '')) END"


def _norm(text: str) -> str:
    for pattern, kept in ((r"\$\d+", "$X"), (r"(?i)\b[0-9a-f]{8,}\b", "<id>"), (r"\b\d{4,}\b", "<n>"), (r"\buser_\d+", "user_X"), (r"\bsession_\w+", "session_X")):
        text = f"regexp_replace({text}, '{pattern}', '{kept}', 'g')"
    return text


_SKELETON = r"trim(regexp_replace(regexp_replace(regexp_replace(line, '\$\d+', '<ID>', 'g'), 'https?://\S+', '<URL>', 'g'), '\d+', '<N>', 'g'))"
_TOKENS = r"len(regexp_extract_all(line, '\S+'))"
_DESCRIBED = f"(SELECT log_id, line_no, time, level, rank, CASE WHEN length(message) >= 3 THEN message END AS message, CASE WHEN length(message) >= 3 THEN {_norm('message')} END AS norm, CASE WHEN message IS NULL OR length(message) >= 3 THEN component END AS component FROM (SELECT log_id, line_no, {_TIME} AS time, {_LEVEL} AS level, {_RANK} AS rank, {_MESSAGE} AS message, nullif(lower(concat(regexp_extract(line, '(?i)\\[([A-Za-z][\\w.-]*)\\]|(?:logger|module|component)[=:]\\s*([A-Za-z][\\w.-]*)|(?:^|\\s)([a-z]+\\.[a-z]+[\\w.]*)\\s*-', 1), regexp_extract(line, '(?i)\\[([A-Za-z][\\w.-]*)\\]|(?:logger|module|component)[=:]\\s*([A-Za-z][\\w.-]*)|(?:^|\\s)([a-z]+\\.[a-z]+[\\w.]*)\\s*-', 2), regexp_extract(line, '(?i)\\[([A-Za-z][\\w.-]*)\\]|(?:logger|module|component)[=:]\\s*([A-Za-z][\\w.-]*)|(?:^|\\s)([a-z]+\\.[a-z]+[\\w.]*)\\s*-', 3))), '') AS component FROM {EVENT_SQL}))"


def _dense(sql: str, order: str = "line_no") -> str:
    """Number a (log_id, ..., line) query's lines from 0."""
    return f"SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY {order}) - 1 AS line_no, line FROM ({sql})"


def _runs(source: str, key: str, joins: str = "true") -> str:
    """Rows of a source with key, joins and run."""
    return f"(SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS run FROM (SELECT *, NOT coalesce(joins AND lag(joins) OVER w AND lag(key) OVER w IS NOT DISTINCT FROM key, false) AS brk FROM (SELECT *, {key} AS key, {joins} AS joins FROM {source}) WINDOW w AS (PARTITION BY log_id ORDER BY line_no)))"


# Text measures, tails and heads ---------------------------------------------------------------------------------------


@query("text_counts", r"SELECT doc_id AS log_id, len(regexp_extract_all(text, '\S+')) AS tokens, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.select(F.col("doc_id").alias("log_id"), token_count(F.col("text")).alias("tokens"), line_count(F.col("text")).alias("lines"), char_count(F.col("text")).alias("chars"))


over("tail_lines", event_lines, lambda x: tail(x, 5), _dense(f"SELECT * FROM {EVENT_SQL} QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) <= 5"))
over("head_lines", event_lines, lambda x: head(x, 5), _dense(f"SELECT * FROM {EVENT_SQL} QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_no) <= 5"))
over("tail_then_head", event_lines, lambda x: head(tail(x, 20), 5), _dense(f"SELECT * FROM {EVENT_SQL} QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) BETWEEN 20 - 4 AND 20 OR (row_number() OVER (PARTITION BY log_id ORDER BY line_no) <= 5 AND count(*) OVER (PARTITION BY log_id) < 20)"))
over("texts_round_trip", document_lines, join_lines, "SELECT doc_id AS log_id, text FROM documents WHERE text IS NOT NULL")
over("signal_ratio", event_lines, lambda x: signal_ratio(x, r"ERROR|WARNING"), f"SELECT log_id, CAST(sum(CASE WHEN regexp_matches(line, 'ERROR|WARNING') THEN {_TOKENS} ELSE 0 END) AS BIGINT) AS signal_tokens, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, sum(CASE WHEN regexp_matches(line, 'ERROR|WARNING') THEN {_TOKENS} ELSE 0 END) / sum({_TOKENS}) AS ratio FROM {EVENT_SQL} GROUP BY log_id")

over("scoring_sample", event_lines, lambda x: scoring_sample(x, 6, 3), _dense(f"SELECT log_id, line_no, sub, CASE WHEN sub = 0 THEN line ELSE '[... ' || (size - 9) || ' lines omitted ...]' END AS line FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS place, count(*) OVER (PARTITION BY log_id) AS size FROM {EVENT_SQL}), (SELECT unnest([0, 1]) AS sub) WHERE (sub = 0 AND (size <= 9 OR place <= 6 OR place > size - 3)) OR (sub = 1 AND size > 9 AND place = 6)", "line_no, sub"))

# Steps that look at a line --------------------------------------------------------------------------------------------

over("strip_ansi", rich_lines, line_rules.strip_ansi, rf"SELECT log_id, line_no, regexp_replace(regexp_replace(line, '[\x1b\x{{9b}}][\[()#;?]*(?:[0-9]{{1,4}}(?:;[0-9]{{0,4}})*)?[0-9A-ORZcf-nq-uy=><~]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS line FROM {RICH_SQL}")
over("shorten_urls", rich_lines, line_rules.shorten_urls, rf"""SELECT log_id, line_no, regexp_replace(regexp_replace(line, '((?:https?|wss?)://[^\s)>\]"''?#]*)[?#][^\s)>\]"'']*', '\1', 'g'), '((?:https?|wss?)://[^/\s)>\]"'']+)(?:/[^/\s)>\]"'']+){{3,}}/([^/\s)>\]"'']+)/([^/\s)>\]"'']+)', '\1/.../\2/\3', 'g') AS line FROM {RICH_SQL}""")
over("simplify_timestamps", rich_lines, line_rules.simplify_timestamps, rf"SELECT log_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\d{{4}}-\d{{2}}-\d{{2}}T(\d{{2}}:\d{{2}}:\d{{2}})(?:\.\d{{1,9}})?(?:Z|[+-]\d{{2}}:?\d{{2}})?', '\1', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}\s+(\d{{2}}:\d{{2}}:\d{{2}})[.,]\d{{1,6}}', '\1', 'g'), '\b1[5-9]\d{{11}}\b', '<epoch>', 'g'), '(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{{1,2}}\s+(\d{{2}}:\d{{2}}:\d{{2}})', '\1', 'g') AS line FROM {RICH_SQL}")
over("strip_source_locations", rich_lines, line_rules.strip_source_locations, _dense(rf"SELECT log_id, line_no, regexp_replace(regexp_replace(line, '^(\s*)\S+\.(?:js|jsx|ts|tsx|mjs|cjs):\d+\s+\[', '\1['), '\s+\S+\.(?:js|jsx|ts|tsx|mjs|cjs):\d+(?::\d+)?$', '') AS line FROM {RICH_SQL}"))
over("compact_access_logs", rich_lines, line_rules.compact_access_logs, rf"""SELECT log_id, line_no, CASE WHEN m <> '' AND NOT regexp_matches(pre, '(?i)\b(?:error|fail|exception|traceback|fatal|critical|panic|refused|timeout)\b') THEN CASE WHEN t <> '' THEN t || ' ' ELSE '' END || m || ' ' || p || ' → ' || s || CASE WHEN d <> '' THEN ' (' || d || u || ')' ELSE '' END ELSE line END AS line
FROM (SELECT *, regexp_extract(pre, '(?:^|[\s\[])(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)(?:[\s,\]\-]|$)', 1) AS t, regexp_extract(post, '(\d+\.?\d*)\s*(ms|s)\b', 1) AS d, regexp_extract(post, '(\d+\.?\d*)\s*(ms|s)\b', 2) AS u
FROM (SELECT *, regexp_extract(line, '{{0}}', 1) AS pre, regexp_extract(line, '{{0}}', 2) AS m, regexp_extract(line, '{{0}}', 3) AS p, regexp_extract(line, '{{0}}', 4) AS s, regexp_extract(line, '{{0}}', 5) AS post FROM {RICH_SQL}))""".replace("{0}", r'^(.*?)"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)\s+HTTP/[\d.]+"\s*(\d{3})\b(.*)$'))
over("skeletons", event_lines, lambda x: x.groupBy(scrub.skeleton(F.col("line")).alias("skeleton")).agg(F.count(F.lit(1)).alias("n")), f"SELECT {_SKELETON} AS skeleton, count(*) AS n FROM {EVENT_SQL} GROUP BY 1")

# Steps that look at neighbours ----------------------------------------------------------------------------------------

over("normalize_whitespace", document_lines, line_rules.normalize_whitespace, _dense(rf"SELECT log_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY log_id ORDER BY line_no) AS before, min(CASE WHEN line <> '' THEN line_no END) OVER (PARTITION BY log_id) AS a, max(CASE WHEN line <> '' THEN line_no END) OVER (PARTITION BY log_id) AS z FROM (SELECT log_id, line_no, regexp_replace(line, '\s+$', '') AS line FROM {DOCUMENT_SQL})) WHERE line <> '' OR (before <> '' AND line_no > a AND line_no < z) OR (a IS NULL AND line_no = 0)"))
_NOISE = r"'(?i:(?:GET|POST|HEAD)\s+\S*/(?:health|healthz|healthcheck|readyz|livez|ready|alive|ping|status)\b)|^INFO:\s+connection (?:open|closed)\s*$'"
_SILENT = r"'^\s*\d{1,2}:\d{2}:\d{2}\s*$|^[^a-zA-Z0-9]*[=~]{4,}\s*$|[-=] [=~]{10,}\s*$'"
over("filter_noise", rich_lines, line_rules.filter_noise, _dense(f"SELECT log_id, line_no, CASE WHEN key AND total > 5 THEN '[... ' || n || ' lines omitted ...]' ELSE line END AS line FROM (SELECT *, count(*) OVER r AS n, sum(tok) OVER r AS total, min(line_no) OVER r AS h FROM {_runs(f'(SELECT *, {_TOKENS} AS tok FROM {RICH_SQL} WHERE NOT regexp_matches(line, {_SILENT}))', f'regexp_matches(line, {_NOISE})', f'regexp_matches(line, {_NOISE})')} WINDOW r AS (PARTITION BY log_id, run)) WHERE NOT key OR (n > 1 AND (total <= 5 OR line_no = h))"))
_PASS = r"regexp_matches(line, '^PASS\s+\S+(?:\s+\([\d.]+s\))?\s*$|^ok\s+\S+\s+[\d.]+s\s*$|^PASSED\s+\S+')"
over("collapse_test_status", rich_lines, line_rules.collapse_test_status, _dense(f"SELECT log_id, line_no, CASE WHEN key AND n >= 3 THEN 'PASS [' || n || ' suites]' ELSE line END AS line FROM (SELECT *, count(*) OVER r AS n, min(line_no) OVER r AS h FROM {_runs(RICH_SQL, _PASS, _PASS)} WINDOW r AS (PARTITION BY log_id, run)) WHERE NOT (key AND n >= 3) OR line_no = h"))
_LAYER = r"'^(\s*=>\s+=>\s+)(pushing|exporting) layer\s+\S+\s+(\d+\.?\d*)s\s*$'"
over("collapse_docker_layers", rich_lines, line_rules.collapse_docker_layers, _dense(rf"SELECT log_id, min(line_no) AS line_no, CASE WHEN any_value(key) <> '' AND count(*) > 1 THEN regexp_extract(min_by(line, line_no), {_LAYER}, 1) || any_value(key) || ' ' || count(*) || ' layers  ' || regexp_replace(CAST(min(took) AS VARCHAR), '\.0$', '') || 's' || CASE WHEN min(took) = max(took) THEN '' ELSE '-' || regexp_replace(CAST(max(took) AS VARCHAR), '\.0$', '') || 's' END ELSE min_by(line, line_no) END AS line FROM (SELECT *, TRY_CAST(regexp_extract(line, {_LAYER}, 3) AS DOUBLE) AS took FROM {_runs(RICH_SQL, f'regexp_extract(line, {_LAYER}, 2)', f'length(regexp_extract(line, {_LAYER}, 2)) > 0')}) GROUP BY log_id, run"))
_S = r"'^(?:(\d{4}-\d{2}-\d{2})\s+)?(\d{1,2}:\d{2}:\d{2})\s+-\s+(\S+)\s+-\s+(INFO|WARNING|ERROR|DEBUG|WARN|CRITICAL)\s+-\s+(.*)'"


def _compressed(source: str) -> str:
    """A source of structured lines, with dates and modules as headings."""
    return f"""
WITH p AS (SELECT log_id, line_no, line, nullif(regexp_extract(line, {_S}, 1), '') AS d, regexp_extract(line, {_S}, 2) AS t, regexp_extract(line, {_S}, 3) AS m, regexp_extract(line, {_S}, 4) AS l, regexp_extract(line, {_S}, 5) AS msg FROM {source}),
q AS (SELECT *, d IS DISTINCT FROM lag(d) OVER (PARTITION BY log_id ORDER BY line_no) AS dated FROM p),
g AS (SELECT *, count(*) OVER x AS size, min(l) OVER x = max(l) OVER x AS one, line_no = min(line_no) OVER x AS head FROM {_runs('q', 'm || coalesce(d, chr(0))').replace(' AS run', ' AS grp')} WINDOW x AS (PARTITION BY log_id, grp)),
h AS (SELECT *, count(*) OVER y AS n, line_no = min(line_no) OVER y AS first FROM (SELECT *, sum(CASE WHEN b2 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS run FROM (SELECT *, NOT coalesce(size >= 3 AND lag(grp) OVER w = grp AND lag(t) OVER w = t, false) AS b2 FROM g WINDOW w AS (PARTITION BY log_id ORDER BY line_no))) WINDOW y AS (PARTITION BY log_id, run)),
o AS (SELECT log_id, line_no, 0 AS sub, '[' || d || ']' AS line FROM h WHERE dated
 UNION ALL SELECT log_id, line_no, 1, CASE WHEN one THEN m || ' - ' || l || ':' ELSE m || ':' END FROM h WHERE size >= 3 AND head
 UNION ALL SELECT log_id, line_no, 2, '  ' || t || ':' FROM h WHERE size >= 3 AND n >= 3 AND first
 UNION ALL SELECT log_id, line_no, 3, CASE WHEN size < 3 THEN t || ' - ' || m || ' - ' || l || ' - ' || msg WHEN n >= 3 THEN '    ' || CASE WHEN one THEN msg ELSE l || ' - ' || msg END ELSE '  ' || t || ' - ' || CASE WHEN one THEN msg ELSE l || ' - ' || msg END END FROM h)
{_dense('SELECT * FROM o', 'line_no, sub')}"""


over("compress_prefix", event_lines, line_rules.compress_prefix, _compressed(EVENT_SQL))

# Steps over a whole log -----------------------------------------------------------------------------------------------

_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_DICTIONARY = rf"""(SELECT log_id, token, row_number() OVER (PARTITION BY log_id ORDER BY min({{'k': kind, 'n': line_no, 'o': ord}})) AS id FROM (
 SELECT log_id, line_no, kind, unnest(range(1, len(toks) + 1)) AS ord, unnest(toks) AS token FROM (
  SELECT log_id, line_no, 1 AS kind, regexp_extract_all(line, '\b{_UUID}\b') AS toks FROM {RICH_SQL}
  UNION ALL SELECT log_id, line_no, 2, list_filter(regexp_extract_all(regexp_replace(line, '\b{_UUID}\b', '#', 'g'), '\b[0-9a-fA-F]{{7,}}\b'), lambda t: regexp_matches(t, '[a-fA-F]')) FROM {RICH_SQL}))
 GROUP BY log_id, token)"""
over("id_dictionary", rich_lines, lambda x: whole_log.id_dictionary(whole_log.find_identifiers(x)), f"SELECT log_id, token, CAST(id AS INT) AS id FROM {_DICTIONARY}")
over("shorten_ids", rich_lines, whole_log.shorten_ids, rf"""WITH d AS {_DICTIONARY},
u AS (SELECT r.log_id, line_no, CASE WHEN d.token IS NULL THEN line ELSE replace(line, d.token, '$' || d.id) END AS line FROM {RICH_SQL} r LEFT JOIN d ON d.log_id = r.log_id AND d.token = regexp_extract(line, '\b{_UUID}\b'))
SELECT u.log_id, line_no, CASE WHEN d.token IS NULL THEN line ELSE replace(line, d.token, '$' || d.id) END AS line FROM u LEFT JOIN d ON d.log_id = u.log_id AND d.token = list_filter(regexp_extract_all(line, '\b[0-9a-fA-F]{{7,}}\b'), lambda t: regexp_matches(t, '[a-fA-F]'))[1]""")
over("strip_envelope", shipped_lines, whole_log.strip_envelope, rf"SELECT log_id, line_no, CASE WHEN count(*) OVER (PARTITION BY log_id) >= 4 THEN regexp_replace(line, '^\d{{1,2}}:\d{{2}}:\d{{2}} app\[a1\] iad \[(?:info|error)\] ', '') ELSE line END AS line FROM {SHIPPED_SQL}")
over("skeleton_runs", event_lines, lambda x: runs_of(mark_runs(x, scrub.skeleton(F.col("line")), scrub.skeleton(F.col("line")) != ""), F.min_by("line", "line_no").alias("line")).select("log_id", "line_no", "n", "line"), f"SELECT log_id, min(line_no) AS line_no, count(*) AS n, min_by(line, line_no) AS line FROM {_runs(EVENT_SQL, _SKELETON)} GROUP BY log_id, run")
_MASKED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\$\d+', '<ID>', 'g'), 'https?://\S+', '<URL>', 'g'), '\d+', '<N>', 'g'), '<epoch>', '<T>', 'g'))"
_VALUE = r"'https?://\S+|\$\d+|\d+'"


def _templates(source: str) -> str:
    """Runs of a source's lines with one skeleton, each as one line."""
    return rf"""
WITH r AS (SELECT log_id, run, line_no, line FROM {_runs(source, _MASKED, f"{_MASKED} <> ''")}),
g AS (SELECT log_id, run, min(line_no) AS line_no, count(*) AS n, min_by(line, line_no) AS line FROM r GROUP BY log_id, run),
t AS (SELECT log_id, run, line_no, CASE WHEN raw LIKE 'http%' THEN regexp_replace(raw, '[.,;:]+$', '') ELSE raw END AS tok, raw, p FROM (SELECT log_id, run, line_no, unnest(regexp_extract_all(line, {_VALUE})) AS raw, unnest(range(1, len(regexp_extract_all(line, {_VALUE})) + 1)) AS p FROM r)),
v AS (SELECT log_id, run, p, min_by(raw, line_no) AS raw, min_by(tok, line_no) AS own, count(DISTINCT tok) > 1 AS varies, string_agg(tok, ', ' ORDER BY line_no) AS vals FROM t GROUP BY log_id, run, p),
k AS (SELECT v.*, g.line, CASE WHEN own LIKE 'http%' THEN 'URL' ELSE 'N' END AS kind, regexp_matches(own, '^\d{{3,5}}$') AND list_contains(regexp_extract_all(g.line, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}:(\d+)', 1), own) AS port FROM v JOIN g USING (log_id, run)),
w AS (SELECT *, count(*) FILTER (WHERE varies) OVER o AS nth, count(*) FILTER (WHERE varies) OVER a AS vars, count(*) FILTER (WHERE varies AND NOT port) OVER o AS told, count(*) FILTER (WHERE varies AND NOT port) OVER a AS tells FROM k WINDOW o AS (PARTITION BY log_id, run ORDER BY p), a AS (PARTITION BY log_id, run)),
s AS (SELECT log_id, run, any_value(vars) AS vars, string_agg(CASE WHEN NOT varies THEN raw WHEN port THEN '{{port}}' ELSE '{{' || kind || CASE WHEN vars = 1 THEN '' ELSE CAST(nth AS VARCHAR) END || '}}' END || string_split_regex(line, {_VALUE})[p + 1], '' ORDER BY p) AS body, coalesce(string_agg(' | ' || kind || CASE WHEN tells = 1 THEN '' ELSE CAST(told AS VARCHAR) END || ' = ' || vals, '' ORDER BY p) FILTER (WHERE varies AND NOT port), '') AS lists FROM w GROUP BY log_id, run)
SELECT g.log_id, g.line_no, CASE WHEN n = 1 THEN line WHEN coalesce(vars, 0) = 0 THEN line || chr(10) || '[... ' || (n - 1) || ' identical lines omitted ...]' ELSE '[x' || n || '] ' || string_split_regex(line, {_VALUE})[1] || body || lists END AS line FROM g LEFT JOIN s USING (log_id, run)"""


def _suffixes(source: str) -> str:
    """Lines of a source that end in one error, as one line in the place of the last."""
    return r"""
WITH e AS (SELECT *, CASE WHEN length(x) >= 20 THEN x END AS err, trim(regexp_replace(p, '[:\s]+$', '')) AS before FROM (SELECT *, regexp_extract(line, '^(.*?)\b((?:[A-Z][A-Za-z]*)?(?:Error|Exception|Warning|Rejection):\s.+)$', 2) AS x, regexp_extract(line, '^(.*?)\b((?:[A-Z][A-Za-z]*)?(?:Error|Exception|Warning|Rejection):\s.+)$', 1) AS p FROM """ + source + r""")),
g AS (SELECT log_id, err, count(*) AS n, max(line_no) AS last, string_agg(before, ', ' ORDER BY line_no) AS names, bool_and(before <> '') AS named FROM e WHERE err IS NOT NULL GROUP BY log_id, err HAVING count(*) >= 3)
SELECT e.log_id, e.line_no, CASE WHEN g.n IS NULL THEN line ELSE '[x' || n || '] ' || e.err || CASE WHEN named THEN ' — ' || names ELSE '' END END AS line FROM e LEFT JOIN g ON g.log_id = e.log_id AND g.err = e.err WHERE g.n IS NULL OR e.line_no = g.last"""


def _parted(sql: str) -> str:
    """The query's lines taken apart at line feeds, and numbered."""
    return _dense(f"SELECT log_id, line_no, unnest(range(1, len(string_split(line, chr(10))) + 1)) AS sub, unnest(string_split(line, chr(10))) AS line FROM ({sql})", "line_no, sub")


over("run_templates", event_lines, whole_log.collapse_runs, _templates(EVENT_SQL))
over("error_suffixes", rich_lines, whole_log.merge_error_suffixes, _suffixes(RICH_SQL))


def _scattered(source: str) -> str:
    """Equal lines of a source that stand apart, on the first one."""
    masked = _MASKED.replace("(line,", "(body,")
    return _parted(rf"""
SELECT log_id, line_no, CASE WHEN NOT merged THEN line WHEN counted THEN '[x' || total || '] ' || regexp_replace(line, '^\[x\d+\]\s+', '') ELSE line || chr(10) || '[... above line repeated ' || (n - 1) || ' more times ...]' END AS line
FROM (SELECT *, key IS NOT NULL AND n >= CASE WHEN counted THEN 2 ELSE 3 END AS merged
FROM (SELECT *, count(key) OVER same AS n, sum(CASE WHEN counted THEN TRY_CAST(regexp_extract(line, '^\[x(\d+)\]', 1) AS BIGINT) ELSE 1 END) OVER same AS total, min(line_no) OVER same AS head
FROM (SELECT *, nullif(CASE WHEN counted THEN {masked} WHEN usable THEN trim(line) END, '') AS key
FROM (SELECT *, usable AND regexp_matches(trim(line), '^\[x\d+\]\s') AS counted, regexp_replace(regexp_replace(line, '^\[x\d+\]\s+', ''), '\s+\|\s+\S+\s*=\s*.+$', '') AS body
FROM (SELECT *, trim(line) <> '' AND NOT starts_with(trim(line), '[...') AND NOT regexp_matches(line, '^\s') AND NOT regexp_matches(line, ':\s*$') AS usable FROM {source})))
WINDOW same AS (PARTITION BY log_id, counted, key))) WHERE NOT merged OR line_no = head""")


over("merge_scattered", document_lines, line_rules.merge_scattered, _scattered(DOCUMENT_SQL))
over("deduplicate_lines", event_lines, whole_log.deduplicate_lines, _parted(_templates(f"({_suffixes('(' + _templates(EVENT_SQL) + ')')})")))
over("deduplicate_rich_lines", rich_lines, whole_log.deduplicate_lines, _parted(_templates(f"({_suffixes('(' + _templates(RICH_SQL) + ')')})")))


def _cycles(source: str) -> str:
    """Blocks of a source that repeat at once: for each place the shortest block, then from block to block."""
    return _dense(f"""
SELECT * FROM (WITH RECURSIVE t AS MATERIALIZED (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) - 1 AS pos, line, {_MASKED} AS key FROM {source}),
m AS (SELECT a.log_id, a.pos, size, coalesce(min(CASE WHEN b.key IS DISTINCT FROM a.key THEN a.pos END) OVER (PARTITION BY a.log_id, size ORDER BY a.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), a.pos) - a.pos AS same
 FROM t a CROSS JOIN (SELECT unnest(range(2, 21)) AS size) LEFT JOIN t b ON b.log_id = a.log_id AND b.pos = a.pos + size),
c AS MATERIALIZED (SELECT log_id, pos, min(size) AS size, min_by(pos + size * (1 + same // size), size) AS stop FROM m WHERE same >= CASE WHEN size = 2 THEN 4 ELSE size END GROUP BY log_id, pos),
n AS MATERIALIZED (SELECT t.log_id, t.pos, min(c.pos) OVER (PARTITION BY t.log_id ORDER BY t.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS start FROM t LEFT JOIN c ON c.log_id = t.log_id AND c.pos = t.pos),
x AS (SELECT c.log_id, c.pos, c.size, c.stop FROM n JOIN c ON c.log_id = n.log_id AND c.pos = n.start WHERE n.pos = 0
 UNION ALL SELECT c.log_id, c.pos, c.size, c.stop FROM x JOIN n ON n.log_id = x.log_id AND n.pos = x.stop JOIN c ON c.log_id = n.log_id AND c.pos = n.start)
SELECT log_id, pos AS line_no, 0 AS sub, line FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.log_id = t.log_id AND t.pos >= x.pos + x.size AND t.pos < x.stop)
UNION ALL SELECT log_id, pos + size - 1, 1, '[... above ' || size || '-line block repeated ' || ((stop - pos) // size - 1) || ' more times ...]' FROM x)""", "line_no, sub")


over("detect_cycles", cyclic_lines, sequential.collapse_cycles, _cycles(CYCLIC_SQL))
over("detect_varied_cycles", periodic_lines, sequential.collapse_cycles, _cycles(PERIODIC_SQL))
over("collapse_pip_output", rich_lines, lambda x: rewrite_logs(x, _with_install), _dense(f"SELECT log_id, line_no, line FROM {RICH_SQL} UNION ALL SELECT log_id, i - 5, ['RUN pip install -r r.txt', 'pip: a==1.0', 'pip: +1 transitive deps (b>=2)', '#9 done'][i] FROM (SELECT DISTINCT log_id FROM {RICH_SQL}), (SELECT unnest([1, 2, 3, 4]) AS i)"))


def _start_of(a: str, b: str) -> str:
    """What two texts start with, up to its last space, if it is long enough."""
    same = f"substr({a}, 1, len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1) AND starts_with({b}, substr({a}, 1, i)))))"
    cut = rf"(CASE WHEN regexp_matches({same}, '\s$') THEN {same} ELSE regexp_replace({same}, '[^ ]*$', '') END)"
    return f"(CASE WHEN length({cut}) >= 5 AND regexp_matches({cut}, '[a-zA-Z0-9]') THEN {cut} ELSE '' END)"


def _prefixes(source: str) -> str:
    """Neighbouring lines of a source that start alike: for each place how far a prefix reaches, then from fold to fold."""
    return _dense(rf"""
SELECT * FROM (WITH RECURSIVE r AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS pos, line, regexp_extract(line, '^\s*') AS lead, regexp_replace(line, '^\s*', '') AS said, trim(line) = '' OR regexp_matches(trim(line), ':$|^\[\.\.\.\s') AS breaks FROM {source}),
t AS MATERIALIZED (SELECT *, coalesce(NOT breaks AND NOT lag(breaks) OVER w AND lag(lead) OVER w = lead, false) AS goes_on FROM r WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
e AS (SELECT a.log_id, a.pos, b.pos + 1 AS stop, {_start_of('a.said', 'b.said')} AS prefix FROM t a JOIN t b ON b.log_id = a.log_id AND b.pos = a.pos + 1 AND b.goes_on
 UNION ALL SELECT e.log_id, e.pos, e.stop + 1, {_start_of('e.prefix', 'b.said')} FROM e JOIN t b ON b.log_id = e.log_id AND b.pos = e.stop AND b.goes_on WHERE e.prefix <> ''),
f AS (SELECT log_id, pos, max(stop) AS stop, max_by(prefix, stop) AS prefix FROM e WHERE prefix <> '' GROUP BY log_id, pos),
c AS MATERIALIZED (SELECT f.log_id, f.pos, any_value(f.stop) AS stop, any_value(f.prefix) AS prefix FROM f JOIN t b ON b.log_id = f.log_id AND b.pos > f.pos AND b.pos < f.stop GROUP BY f.log_id, f.pos HAVING bool_and(trim(substr(b.said, length(f.prefix) + 1)) <> '')),
n AS MATERIALIZED (SELECT t.log_id, t.pos, min(c.pos) OVER (PARTITION BY t.log_id ORDER BY t.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS start FROM t LEFT JOIN c ON c.log_id = t.log_id AND c.pos = t.pos),
x AS (SELECT c.* FROM n JOIN c ON c.log_id = n.log_id AND c.pos = n.start WHERE n.pos = 1
 UNION ALL SELECT c.* FROM x JOIN n ON n.log_id = x.log_id AND n.pos = x.stop JOIN c ON c.log_id = n.log_id AND c.pos = n.start)
SELECT t.log_id, t.pos AS line_no, CASE WHEN x.pos IS NULL THEN t.line ELSE t.lead || '  ' || substr(t.said, length(x.prefix) + 1) END AS line FROM t LEFT JOIN x ON x.log_id = t.log_id AND t.pos > x.pos AND t.pos < x.stop)""")


over("fold_repeated_prefix", alike_lines, sequential.fold_repeated_prefix, _prefixes(ALIKE_SQL))
over("fold_event_prefixes", event_lines, sequential.fold_repeated_prefix, _prefixes(EVENT_SQL))
over("fold_stack_traces", trace_lines, sequential.fold_stack_traces, _dense(f"""
WITH t AS (SELECT *, line_no % 5 AS k, sum(CASE WHEN line_no % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS g FROM {TRACE_SQL}),
f AS (SELECT log_id, g, row_number() OVER (PARTITION BY log_id ORDER BY g) > 1 AS again FROM t GROUP BY log_id, g HAVING count(*) FILTER (WHERE k IN (2, 3)) = 2)
SELECT t.log_id, line_no, CASE WHEN coalesce(again, false) AND k = 3 THEN '  [... duplicate traceback omitted ...]' WHEN k = 1 THEN '  [... 1 framework frames (uvicorn) omitted ...]' WHEN k = 2 THEN '  File "app.py", line 2' ELSE line END AS line
FROM t LEFT JOIN f ON f.log_id = t.log_id AND f.g = t.g WHERE k NOT IN (1, 2) OR NOT coalesce(again, false)"""))
over("collapse_retries", section_lines, sequential.collapse_retry_sections, _dense(f"""
WITH t AS (SELECT *, count(*) OVER (PARTITION BY log_id, g) AS size FROM (SELECT *, sum(CASE WHEN line LIKE '==>%' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS g FROM {SECTION_SQL})),
b AS (SELECT log_id, min(g) AS base, max(g) AS last, count(DISTINCT g) - 1 AS again FROM t WHERE size >= 5 GROUP BY log_id),
e AS (SELECT t.log_id, max(line_no) AS stop, bool_or(line LIKE '==>%') AS headed, any_value(again) AS again, any_value(last) AS last FROM t JOIN b ON b.log_id = t.log_id AND b.base = t.g GROUP BY t.log_id)
SELECT t.log_id, line_no, 0 AS sub, line FROM t LEFT JOIN b ON b.log_id = t.log_id WHERE size < 5 OR g = base
UNION ALL SELECT log_id, stop, 1, '[... ' || again || CASE WHEN again = 1 THEN ' similar retry' ELSE ' similar retries' END || ' omitted ...]' FROM e WHERE again > 0
UNION ALL SELECT t.log_id, stop, 2, line FROM t JOIN e ON e.log_id = t.log_id AND t.g = e.last WHERE again > 0 AND NOT headed AND line LIKE '==>%'""", "line_no, sub"))


def _with_install(lines):  # noqa: ANN001, ANN202
    """An installer's output put before each log."""
    yield from sequential.collapse_installs(iter(["RUN pip install -r r.txt", "1.2 Collecting a==1.0 (from -r r.txt (line 1))", "  Downloading a-1.0.whl", "Collecting b>=2 (from a==1.0->-r r.txt)", "#9 done", *lines]))


# Focus ----------------------------------------------------------------------------------------------------------------


def _hits(focus: Focus) -> Callable[[DataFrame], DataFrame]:
    return lambda x: annotate(x, focus).where("hit").select("log_id", "line_no", "line")


_ALL = f"SELECT log_id, line_no, line FROM {EVENT_SQL} WHERE "
over("focus_level", event_lines, _hits(Focus(level="error")), _ALL + f"{_RANK} >= 3")
over("focus_grep", event_lines, _hits(Focus(grep=r"user_1\d VIEW")), _ALL + r"regexp_matches(line, '(?i)user_1\d VIEW')")
over("focus_contains", event_lines, _hits(Focus(contains="user_7 ")), _ALL + "contains(line, 'user_7 ')")
over("focus_component", event_lines, _hits(Focus(component="App.Sign")), _ALL + "contains(lower(line), 'app.sign')")
over("focus_time_range", event_lines, _hits(Focus(time_range="06:30-07:15:30")), _ALL + f"{_SECONDS} BETWEEN 23400 AND 26130")
over("focus_any_in_range", event_lines, _hits(Focus(level="error", contains="user_3", time_range="12:00-18:00")), _ALL + f"({_RANK} >= 3 OR contains(line, 'user_3')) AND {_SECONDS} BETWEEN 43200 AND 64800")
over("focus_not_grep", event_lines, _hits(Focus(level="warning", not_grep="value=1")), _ALL + f"{_RANK} >= 2 AND NOT regexp_matches(line, '(?i)value=1')")
over("focus_bad_pattern", event_lines, _hits(Focus(grep="(", level="error", not_grep="[")), _ALL + f"{_RANK} >= 3")
_MARKED_IN = "SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY log_id ORDER BY line_no) AS nth, count(*) FILTER (WHERE hit) OVER (PARTITION BY log_id) AS total FROM (SELECT *, coalesce(" + _RANK + " >= 3, false) AS hit, " + _RANK + " AS rank FROM "
_MARKED = f"{_MARKED_IN}{EVENT_SQL})"
_PAGE = "hit AND nth > 2 AND nth <= 7"
over("focus_pages", event_lines, lambda x: annotate(x, Focus(level="error", skip=2, limit=5)).where("page").select("log_id", "line_no", "nth", "total", "line"), f"SELECT log_id, line_no, nth, total, line FROM ({_MARKED}) WHERE {_PAGE}")
_VISIBLE = f"SELECT *, page OR coalesce(max(CASE WHEN page THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) = 1, false) AS visible FROM (SELECT *, {_PAGE} AS page FROM ({_MARKED}))"
over("focus_context", event_lines, lambda x: annotate(x, Focus(level="error", skip=2, limit=5, before=2, after=1)).where("visible").select("log_id", "line_no", "line"), f"SELECT log_id, line_no, line FROM ({_VISIBLE}) WHERE visible")
over("focus_context_level", event_lines, lambda x: annotate(x, Focus(level="error", skip=2, limit=5, before=2, after=1, context_level="info")).where("visible").select("log_id", "line_no", "line"), f"SELECT log_id, line_no, line FROM ({_VISIBLE}) WHERE visible AND (page OR rank IS NULL OR rank >= 1)")
_GAPS = f"SELECT log_id, line_no, line, pos - lag(pos) OVER w - 1 AS gap, CASE WHEN lead(pos) OVER w IS NULL THEN size - pos END AS rest FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS pos, count(*) OVER (PARTITION BY log_id) AS size FROM ({_VISIBLE})) WHERE visible WINDOW w AS (PARTITION BY log_id ORDER BY line_no)"
_NOTE = "'[... ' || {0} || CASE WHEN {0} = 1 THEN ' line' ELSE ' lines' END || ' omitted ...]'"
_SHOWN = f"SELECT log_id, line_no, 0 AS sub, {_NOTE.format('gap')} AS line FROM ({_GAPS}) WHERE gap > 0 UNION ALL SELECT log_id, line_no, 1, line FROM ({_GAPS}) UNION ALL SELECT log_id, line_no, 2, {_NOTE.format('rest')} FROM ({_GAPS}) WHERE rest > 0"
over("focus_gaps", event_lines, lambda x: with_gaps(annotate(x, Focus(level="error", skip=2, limit=5, before=2, after=1))), _dense(_SHOWN, "line_no, sub"))
over("focus_hidden_levels", event_lines, lambda x: hidden_levels(annotate(x, Focus(level="error", skip=2, limit=5, before=2, after=1))), f"SELECT log_id, lower({_LEVEL}) AS level, count(*) AS n FROM ({_VISIBLE}) WHERE NOT visible GROUP BY 1, 2")
_CUT = r"regexp_replace(line, '\s*\|[^|]+$', '')"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_CUT}, '^\s+', ''), '^\[x\d+\]\s*', ''), '^[\d:T.Z{{}}-]+\s*', ''), '(?i)^(ERROR|WARN|WARNING|INFO|DEBUG|FATAL|CRITICAL)\s*', ''), '^\[[\w.-]+\]\s*', '')"
_SIGNATURE = rf"CASE WHEN starts_with(line, '[...') OR trim(line) = '' THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains({_CUT}, '→') THEN substr({_CUT}, strpos({_CUT}, '→')) ELSE {_PLAIN} END, '\$\d+', '_', 'g'), '(?i)\b[0-9a-f]{{6,}}\b', '_', 'g'), '/[\w./$-]+', '/_', 'g'), '\d+', '_', 'g')) END"
over("post_focus_dedup", event_lines, drop_similar, _dense(f"SELECT * FROM (SELECT log_id, line_no, unnest([0, 1]) AS sub, unnest([line, CASE WHEN n = 2 THEN line WHEN n > 2 THEN '[... ' || (n - 1) || ' similar lines omitted ...]' END]) AS line FROM (SELECT log_id, min(line_no) AS line_no, min_by(line, line_no) AS line, count(*) AS n FROM {_runs(EVENT_SQL, _SIGNATURE, f'length({_SIGNATURE}) > 0')} GROUP BY log_id, run)) WHERE line IS NOT NULL", "line_no, sub"))


def _answer(skip: int, limit: int, context: int, source: str = EVENT_SQL) -> str:
    """The whole answer to level "error": header, page with context and gaps, similar lines dropped, footer."""
    return _dense(f"""
SELECT * FROM (WITH m AS ({_MARKED_IN}{source})),
v AS (SELECT *, {_LEVEL} AS level, row_number() OVER w AS pos, page OR coalesce(max(CASE WHEN page THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN {context} PRECEDING AND {context} FOLLOWING) = 1, false) AS visible, count(*) OVER (PARTITION BY log_id) AS size FROM (SELECT *, hit AND nth > {skip} AND nth <= {skip + limit} AS page FROM m) WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
x AS (SELECT log_id, line_no, line, pos - coalesce(lag(pos) OVER w, pos) - CASE WHEN lag(pos) OVER w IS NULL THEN 0 ELSE 1 END AS gap, CASE WHEN lead(pos) OVER w IS NULL THEN size - pos ELSE 0 END AS rest FROM v WHERE visible WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
y AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no, sub) AS line_no, line FROM (SELECT log_id, line_no, 0 AS sub, {_NOTE.format('gap')} AS line FROM x WHERE gap > 0 UNION ALL SELECT log_id, line_no, 1, line FROM x UNION ALL SELECT log_id, line_no, 2, {_NOTE.format('rest')} FROM x WHERE rest > 0)),
z AS (SELECT log_id, min(line_no) AS line_no, min_by(line, line_no) AS line, count(*) AS n FROM {_runs('y', _SIGNATURE, f'length({_SIGNATURE}) > 0')} GROUP BY log_id, run),
h AS (SELECT log_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE page) AS shown FROM v GROUP BY log_id),
c AS (SELECT log_id, CASE WHEN level = 'WARN' THEN 'warning' ELSE lower(level) END AS level, count(*) AS n FROM v WHERE NOT visible AND level IS NOT NULL GROUP BY 1, 2)
SELECT log_id, 0 AS part, 0 AS line_no, 0 AS sub, CASE WHEN hits = 0 THEN '[no lines matched the focus filters]' WHEN shown = 0 THEN '[' || hits || ' matches found, but skip={skip} exceeds match count]' ELSE '[showing matches {skip + 1}-' || ({skip} + shown) || ' of ' || hits || ' total]' END AS line FROM h WHERE shown = 0 OR {skip} > 0 OR {skip + limit} < hits
UNION ALL SELECT log_id, 1, line_no, 0, line FROM z
UNION ALL SELECT log_id, 1, line_no, 1, CASE WHEN n = 2 THEN line ELSE '[... ' || (n - 1) || ' similar lines omitted ...]' END FROM z WHERE n > 1
UNION ALL SELECT log_id, 2, 0, 0, '[filtered: ' || string_agg(c.n || ' ' || c.level, ', ' ORDER BY list_position(['debug', 'info', 'warning', 'error', 'critical', 'fatal'], c.level)) || ']' FROM c JOIN h USING (log_id) WHERE shown > 0 GROUP BY log_id)""", "part, line_no, sub")


over("focus_answer", event_lines, lambda x: apply_focus(x, Focus(level="error", limit=5, skip=1, context=1)), _answer(1, 5, 1))
over("focus_first_page", event_lines, lambda x: apply_focus(x, Focus(level="error", limit=2)), _answer(0, 2, 3))
over("focus_past_the_end", event_lines, lambda x: apply_focus(x, Focus(level="error", skip=60, limit=9, context=0)), _answer(60, 9, 0))
over("focus_none", event_lines, lambda x: apply_focus(x, Focus(contains="no such text")), f"SELECT DISTINCT log_id, CAST(0 AS BIGINT) AS line_no, '[no lines matched the focus filters]' AS line FROM {EVENT_SQL}")

# Summaries ------------------------------------------------------------------------------------------------------------

over("summary_time_span", event_lines, lambda x: summary.time_spans(summary.described(x)), f"SELECT log_id, count(*) AS lines, min_by(time, line_no) FILTER (WHERE time IS NOT NULL) AS first_time, max_by(time, line_no) FILTER (WHERE time IS NOT NULL) AS last_time FROM {_DESCRIBED} GROUP BY log_id")
over("summary_levels", event_lines, lambda x: summary.level_stats(summary.described(x)), f"SELECT log_id, level, count(*) AS n, min_by(time, line_no) FILTER (WHERE time IS NOT NULL) AS first_time, max_by(time, line_no) FILTER (WHERE time IS NOT NULL) AS last_time FROM {_DESCRIBED} WHERE level IS NOT NULL GROUP BY 1, 2")
over("summary_messages", event_lines, lambda x: summary.unique_messages(summary.described(x)), f"SELECT log_id, CASE WHEN rank >= 3 THEN 'error' WHEN rank >= 2 THEN 'warning' ELSE 'other' END AS kind, norm, min_by(message, line_no) AS display, count(*) AS n, min(line_no) AS first_line, min_by(time, line_no) AS first_time, max_by(time, line_no) FILTER (WHERE time IS NOT NULL) AS last_time FROM {_DESCRIBED} WHERE level IS NOT NULL AND message IS NOT NULL GROUP BY 1, 2, 3")
over("summary_frequent", event_lines, lambda x: summary.frequent_messages(summary.described(x)), f"SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY n DESC, first_line) AS INT) AS place, display, n FROM (SELECT log_id, norm, min_by(message, line_no) AS display, count(*) AS n, min(line_no) AS first_line FROM {_DESCRIBED} WHERE level IS NOT NULL AND message IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY n DESC, first_line) <= 5")
over("summary_components", event_lines, lambda x: summary.components(summary.described(x)).select("log_id", F.array_join("components", ",").alias("components")), f"SELECT log_id, string_agg(component, ',' ORDER BY component) AS components FROM (SELECT DISTINCT log_id, component FROM {_DESCRIBED} WHERE component IS NOT NULL) GROUP BY log_id")


def _listed(kind: str, low: int, high: int, most: int) -> str:
    """(log_id, block): a kind's unique messages in order of appearance, as a summary lists them."""
    return f"""SELECT log_id, chr(10) || chr(10) || '{kind.capitalize()}s:' || string_agg(chr(10) || '  ' || CASE WHEN n > 1 THEN '[x' || n || '] ' ELSE '' END || '(' || CASE WHEN first_time IS NULL THEN 'at ?' WHEN first_time = last_time THEN 'at ' || first_time ELSE first_time || '—' || last_time END || ') ' || substr(display, 1, 120), '' ORDER BY first_line) FILTER (WHERE r <= {most}) || CASE WHEN count(*) > {most} THEN chr(10) || '  ... and ' || (count(*) - {most}) || ' more unique {kind}s' ELSE '' END AS block
FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY first_line) AS r FROM (SELECT log_id, norm, min_by(message, line_no) AS display, count(*) AS n, min(line_no) AS first_line, arg_min_null(time, line_no) AS first_time, max_by(time, line_no) FILTER (WHERE time IS NOT NULL) AS last_time FROM {_DESCRIBED} WHERE message IS NOT NULL AND rank BETWEEN {low} AND {high} GROUP BY 1, 2)) GROUP BY log_id"""


over("summary_text", event_lines, summary.summaries, f"""
SELECT t.log_id, 'SUMMARY (' || t.lines || ' lines)' || coalesce(chr(10) || 'Time span: ' || t.first_time || ' — ' || t.last_time, '') || coalesce(l.block, '') || coalesce(e.block, '') || coalesce(w.block, '')
 || CASE WHEN e.block IS NULL AND w.block IS NULL THEN coalesce(f.block, '') ELSE '' END || coalesce(chr(10) || chr(10) || 'Components: ' || c.components, '') || chr(10) || chr(10) || 'Narrow with:'
 || CASE WHEN e.block IS NOT NULL OR w.block IS NOT NULL THEN chr(10) || '  level: "error"                  — all errors with context' ELSE '' END || chr(10) || '  grep: "pattern"                 — regex search'
 || CASE WHEN t.first_time IS NOT NULL THEN chr(10) || '  time_range: "HH:MM:SS-HH:MM:SS" — zoom into a period' ELSE '' END || CASE WHEN contains(c.components, ',') THEN chr(10) || '  component: "name"               — filter by module' ELSE '' END
 || chr(10) || '  break_threshold: true           — bypass gate, return full output' AS text
FROM ({ORACLES['summary_time_span']}) t
LEFT JOIN (SELECT log_id, chr(10) || 'Levels:' || string_agg(chr(10) || '  ' || level || ': ' || n || CASE WHEN first_time IS NULL THEN '' WHEN first_time = last_time THEN ' (at ' || first_time || ')' ELSE ' (' || first_time || ' — ' || last_time || ')' END, '' ORDER BY list_position(['FATAL', 'CRITICAL', 'ERROR', 'WARN', 'WARNING', 'INFO', 'DEBUG'], level)) AS block FROM ({ORACLES['summary_levels']}) GROUP BY log_id) l USING (log_id)
LEFT JOIN ({_listed('error', 3, 4, 20)}) e USING (log_id)
LEFT JOIN ({_listed('warning', 2, 2, 10)}) w USING (log_id)
LEFT JOIN (SELECT log_id, chr(10) || chr(10) || 'Frequent patterns:' || string_agg(chr(10) || '  [x' || n || '] ' || substr(display, 1, 100), '' ORDER BY place) AS block FROM ({ORACLES['summary_frequent']}) GROUP BY log_id) f USING (log_id)
LEFT JOIN (SELECT log_id, string_agg(component, ', ' ORDER BY component) AS components FROM (SELECT DISTINCT log_id, component FROM {_DESCRIBED} WHERE component IS NOT NULL) GROUP BY log_id) c USING (log_id)""")

# The whole ------------------------------------------------------------------------------------------------------------


def _inside(sql: str) -> str:
    return f"({sql})"


#: Event lines after each step that changes any: they have no ids with letters, addresses, stamps with fractions, envelopes,
#: noise, locations, test results, installs, layers, access entries, traces or sections, so the other steps leave them.
_EVENT_STAGES = {13: _inside(_compressed(EVENT_SQL))}
_EVENT_STAGES[14] = _inside(_parted(_templates(_inside(_suffixes(_inside(_templates(_EVENT_STAGES[13])))))))
_EVENT_STAGES[15] = _inside(_cycles(_EVENT_STAGES[14]))
_EVENT_STAGES[16] = _inside(_scattered(_EVENT_STAGES[15]))
_EVENT_STAGES[17] = _inside(_prefixes(_EVENT_STAGES[16]))
_REDUCED = _EVENT_STAGES[17]


@query("reduced_logs", f"SELECT * FROM {_REDUCED}")
def reduced_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_lines(event_lines(spark, sf_dir))


@query("reduced_focus", _answer(0, 5, 3, _REDUCED))
def reduced_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


_MEASURE = rf"SELECT log_id, {{0}} AS step_no, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, count(*) AS lines, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS chars FROM s{{1}} GROUP BY log_id"
_STAGES = ", ".join(f"s{n} AS MATERIALIZED (SELECT * FROM {sql})" for n, sql in {
    0: EVENT_SQL, 13: _inside(_compressed("s0")), 14: _inside(_parted(_templates(_inside(_suffixes(_inside(_templates("s13"))))))),
    15: _inside(_cycles("s14")), 16: _inside(_scattered("s15")), 17: _inside(_prefixes("s16")),
}.items())
_MEASURED = " UNION ALL ".join(_MEASURE.format(n, 0 if n < 13 else min(n, 17)) for n in range(len(STEPS) + 1))


@query("event_step_measures", f"""WITH {_STAGES}, every AS MATERIALIZED ({_MEASURED}),
pairs AS (SELECT b.log_id, a.step_no, b.tokens AS tokens_before, b.lines AS lines_before, b.chars AS chars_before, a.tokens AS tokens_after, a.lines AS lines_after, a.chars AS chars_after FROM every b JOIN every a ON a.log_id = b.log_id AND a.step_no = b.step_no + 1
 UNION ALL SELECT b.log_id, 0, b.tokens, b.lines, b.chars, a.tokens, a.lines, a.chars FROM every b JOIN every a ON a.log_id = b.log_id AND a.step_no = {len(STEPS)} AND b.step_no = 0)
SELECT *, CAST({["Total", *(x.title for x in STEPS)]}[step_no + 1] AS VARCHAR) AS step, CASE WHEN tokens_before > 0 THEN round(CAST((tokens_before - tokens_after) * 100 AS DOUBLE) / tokens_before, 1) END AS tokens_saved_pct FROM pairs""")
def measured_event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the steps saves on structured event lines."""
    return step_measures(event_lines(spark, sf_dir))


@query("step_measures")
def measured_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the steps saves, and all of them."""
    return step_measures(rich_lines(spark, sf_dir))


_LONG = "'[' || tokens || ' tokens (unreduced) exceeds 40 threshold after filtering.]' || chr(10) || 'TIP: Narrow further with: time_range, grep, limit, context_level' || chr(10) || '  Or break_threshold: true to bypass.' || chr(10) || '  Setting an API key would enable query-based smart extraction.' || chr(10) || chr(10)"
_SHORT = "'[' || tokens || ' tokens (unreduced).]' || chr(10) || chr(10)"


@query("gate_responses", rf"SELECT log_id, CASE WHEN tokens > 40 THEN {_LONG} ELSE {_SHORT} END || text AS text FROM (SELECT log_id, text, len(regexp_extract_all(text, '\S+')) AS tokens FROM (SELECT log_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ({_answer(0, 3, 3)}) GROUP BY log_id))")
def gate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return respond(event_lines(spark, sf_dir), Request(focus=Focus(level="error", limit=3), reduce=False, threshold=40))


@query("conversation_logs", r"SELECT conv_id AS log_id, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS tokens FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    return turns.groupBy(F.col("conv_id").alias("log_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(token_count(F.col("text"))).alias("tokens"))


@query("page_lines", r"SELECT page_id AS log_id, len(string_split(html, chr(10))) AS lines, len(regexp_extract_all(html, '(?:https?|wss?)://[^\s)>\]""'']+')) AS urls FROM pages WHERE html IS NOT NULL".replace('""', '"'))
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null").select(F.col("page_id").alias("log_id"), F.col("html").alias("text"))
    return split_lines(pages).groupBy("log_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.regexp_count("line", F.lit(scrub.URL)).cast("long")).alias("urls"))
