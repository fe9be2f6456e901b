"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_repair import repair_conversations
from .common import table
from .crf_language import held_out, identify_languages
from .html_tree import extract_main_text
from .interpolated_lm import interpolated_scores
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .multi_index import nearest_neighbours
from .packing import pack_documents
from .rendezvous import shard_records
from .wu_manber import mark_benchmark_overlap


def tokenizer_path() -> str:
    """The public vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, docs.where(~held_out(docs)))
    return found.select("doc_id", held_out(docs).alias("held_out"), "language.lang_pred", "language.score")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_formatting,
    "op2_lm_scoring": lm_scoring,
    "op3_language_id": language_id,
    "op4_decontamination": decontamination,
    "op5_line_dedup": line_dedup,
    "op6_nearest_neighbours": nearest,
    "op7_packing": packing,
    "op8_ngram_jaccard_join": ngram_jaccard_join,
    "op9_html_extraction": html_extraction,
    "op10_sharding": sharding,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, i - 1 AS line, parts[i] AS body
           FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
t AS (SELECT doc_id, line, body, list_sort(list_distinct(regexp_extract_all(body, '[^ \t\x0b\f\r]+'))) AS w FROM l),
c AS (SELECT w, min({'d': doc_id, 'l': line}) AS f, row_number() OVER () AS c FROM t WHERE len(w) > 0 GROUP BY w),
e AS (SELECT c, f, len(w) AS n, unnest(w) AS x FROM c),
q AS (SELECT x, count(*) AS df FROM e GROUP BY x),
p AS (SELECT c, f, n, x, row_number() OVER (PARTITION BY c ORDER BY df, x) AS pos FROM e JOIN q USING (x)),
r AS (SELECT * FROM p WHERE pos <= n - CAST(ceil(n * 80 / 100.0 - 1e-9) AS BIGINT) + 1),
k AS (SELECT DISTINCT a.c AS later, b.c AS earlier FROM r a JOIN r b ON a.x = b.x AND b.f < a.f AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80),
g AS (SELECT DISTINCT later FROM (SELECT k.later, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM k JOIN c a ON a.c = k.later JOIN c b ON b.c = k.earlier) WHERE 100 * i >= 80 * (na + nb - i)),
m AS (SELECT t.doc_id, t.line, t.body, len(t.w) > 0 AND (g.later IS NOT NULL OR c.f <> {'d': t.doc_id, 'l': t.line}) AS gone
      FROM t LEFT JOIN c ON t.w = c.w LEFT JOIN g ON g.later = c.c)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(any_value(m.text), '') END AS text, CAST(coalesce(any_value(m.n), 0) AS BIGINT) AS n_lines, CAST(coalesce(any_value(m.gone), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone) AS text, count(*) AS n, count(*) FILTER (WHERE gone) AS gone FROM m GROUP BY doc_id) m ON m.doc_id = d.doc_id
GROUP BY d.doc_id, d.text
""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.y FROM reach JOIN l ON reach.b = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id,
       (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, widths WHERE len(w) >= m)),
h AS (SELECT g.doc_id, g.i, g.m, p.item FROM g JOIN p ON g.m = p.m AND g.s = p.s),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""",
}
