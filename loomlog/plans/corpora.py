"""Logs derived from the driver's tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import split_lines

#: A time stamp's text, in either engine.
SPARK_STAMP, DUCK_STAMP = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"
#: Two decimals of the value, in either engine.
SPARK_VALUE, DUCK_VALUE = "format_string('%.2f', value)", "printf('%.2f', value)"

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END"
_ID = "CAST(event_id AS STRING)"
_MOD = "CAST(event_id % {} AS STRING)"
_HASH = f"md5({_ID})"
_UUID = f"substr({_HASH}, 1, 8) || '-' || substr({_HASH}, 9, 4) || '-' || substr({_HASH}, 13, 4) || '-' || substr({_HASH}, 17, 4) || '-' || substr({_HASH}, 21, 12)"


def _mod(n: int) -> str:
    return _MOD.format(n)


#: One structured line per event.
EVENT_LINE = f"stamp || ' - app.' || event_type || ' - ' || {_LEVEL} || ' - user_' || CAST(user_id AS STRING) || ' ' || event_type || ' value=' || amount"

#: Four lines in a row of each of fourteen kinds.
RICH_LINE = f"""CASE CAST(floor(event_id / 4.0) AS BIGINT) % 14
 WHEN 0 THEN replace(stamp, ' ', 'T') || '.250Z INFO request ' || {_UUID} || ' token ' || {_HASH}
 WHEN 1 THEN 'GET https://api.example.com/v1/a/b/c/d/e' || {_mod(7)} || '?x=' || {_ID} || '#f done via wss://live.example.com/x/y?z'
 WHEN 2 THEN stamp || ',123 WARN slow ' || {_mod(5)}
 WHEN 3 THEN 'at 17' || lpad({_ID}, 11, '0') || ' and Jan 15 ' || substr(stamp, 12, 8) || ' tick'
 WHEN 4 THEN stamp || ' - "GET /items/' || {_mod(9)} || ' HTTP/1.1" 200 in ' || {_mod(40)} || 'ms'
 WHEN 5 THEN CASE WHEN event_id % 4 = 3 THEN 'worker idle' ELSE 'GET /api/healthz 200 OK' END
 WHEN 6 THEN 'PASS src/test' || {_mod(4)} || '.test.ts (1.' || {_mod(10)} || 's)'
 WHEN 7 THEN ' => => pushing layer sha256:' || {_HASH} || '   ' || {_mod(4)} || '.' || {_mod(10)} || 's'
 WHEN 8 THEN 'app.js:' || {_ID} || ' [Tag] hello ' || {_mod(3)} || ' index-fF.js:391:' || {_ID}
 WHEN 9 THEN 'job ' || {_ID} || ' failed: TypeError: cannot read property of undefined'
 WHEN 10 THEN chr(27) || '[31mred' || chr(27) || '[0m text' || chr(7) || ' ' || {_mod(2)}
 WHEN 11 THEN 'retry at 10.0.0.1:' || CAST(41000 + event_id % 4 AS STRING) || ' attempt ' || {_mod(4)}
 WHEN 12 THEN CASE WHEN event_id % 4 < 2 THEN '==================' ELSE 'INFO:     connection open' END
 ELSE 'plain line ' || {_mod(2)} END"""

#: Event lines that a shipper put its own time, source and level before.
SHIPPED_LINE = f"substr(stamp, 12, 8) || ' app[a1] iad [' || CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'info' END || '] ' || ({EVENT_LINE})"

#: Blocks of three lines over and over; blocks of two to eight lines, each for forty lines; traces of five lines, framework frame first; sections of six lines; three lines alike
#: and a heading.
CYCLIC_LINE = f"CASE event_id % 3 WHEN 0 THEN 'load a ' WHEN 1 THEN 'parse b ' ELSE 'store c ' END || {_ID}"
PERIODIC_LINE = f"'step ' || substr('abcdefgh', CAST(event_id % (2 + CAST(floor(event_id / 40.0) AS BIGINT) % 7) + 1 AS INT), 1) || ' ' || {_ID}"
TRACE_LINE = "CASE event_id % 5 WHEN 0 THEN 'Traceback (most recent call last):' WHEN 1 THEN '  File \"/srv/site-packages/uvicorn/run.py\", line 1' WHEN 2 THEN '  File \"/srv/src/app.py\", line 2' WHEN 3 THEN 'ValueError: bad' ELSE '' END"
SECTION_LINE = f"CASE WHEN event_id % 6 = 0 THEN '==> build ' ELSE 'step ' || substr('abcdef', CAST(event_id % 6 + 1 AS INT), 1) || ' ' END || {_ID}"
ALIKE_LINE = f"CASE WHEN event_id % 4 = 3 THEN 'next round:' ELSE 'fetch remote table t' || {_ID} END"


def _events(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", f"{SPARK_STAMP} AS stamp", f"{SPARK_VALUE} AS amount")
    return events.selectExpr("substr(stamp, 1, 10) AS log_id", "event_id AS line_no", f"{line} AS line")


def _events_sql(line: str) -> str:
    return f"(SELECT substr(stamp, 1, 10) AS log_id, event_id AS line_no, {line} AS line FROM (SELECT *, {DUCK_STAMP} AS stamp, {DUCK_VALUE} AS amount FROM events))"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, EVENT_LINE)


def rich_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, RICH_LINE)


def shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, SHIPPED_LINE)


def cyclic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, CYCLIC_LINE)


def periodic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, PERIODIC_LINE)


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, TRACE_LINE)


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, SECTION_LINE)


def alike_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, ALIKE_LINE)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return split_lines(docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("log_id"), "text"))


EVENT_SQL, RICH_SQL, SHIPPED_SQL = _events_sql(EVENT_LINE), _events_sql(RICH_LINE), _events_sql(SHIPPED_LINE)
CYCLIC_SQL, PERIODIC_SQL, TRACE_SQL, SECTION_SQL, ALIKE_SQL = (_events_sql(x) for x in (CYCLIC_LINE, PERIODIC_LINE, TRACE_LINE, SECTION_LINE, ALIKE_LINE))
DOCUMENT_SQL = "(SELECT doc_id AS log_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)))"
