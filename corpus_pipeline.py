"""A training corpus from raw documents: language, repeated lines, near-duplicates, benchmark leaks, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import bounded_batches, frozen, table
from loomlog.llm.crf_language import identify_languages
from loomlog.llm.jaccard_join import jaccard_components
from loomlog.llm.line_dedup import dedup_lines, document
from loomlog.llm.packing import pack_documents
from loomlog.llm.queries import tokenizer_path
from loomlog.llm.wu_manber import overlaps

#: A document whose best language has a smaller share of its words is rejected.
LEAST_SHARE = 0.4
#: Keys that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Those without letters, and mixtures without a leading language, go."""
    bounded_batches(spark)
    found = identify_languages(docs, name="__language")
    kept = (F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LEAST_SHARE)
    return found.where(kept).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; documents that had only such lines go."""
    clean = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    return _with_length(clean.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id, one without an id only if none has any.

    A document is told by its id and text. Of rows with one id and one text, or one text and no id, one stays; rows with
    neither an id nor a word are linked with nothing and stay.
    """
    bounded_batches(spark)
    docs, columns = docs.withColumn("__doc", document("doc_id", "text")), docs.columns
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__doc").alias("row"), "text")
    found = jaccard_components(rows, key="row")
    found = frozen(found.select("row.__doc", (F.col("row") != F.col("component_id")).alias("other"), (F.col("row.unnamed") & (F.col("n_shingles") == 0)).alias("alone")))
    others = frozen(found.where("other").select("__doc").distinct())
    repeated = frozen(found.where("not other and not alone").groupBy("__doc").count().where("count > 1").select("__doc"))

    def sized(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids

    single = docs.join(sized(others), "__doc", "left_anti").join(sized(repeated), "__doc", "left_anti")
    again = docs.join(sized(repeated), "__doc", "left_semi").dropDuplicates(["__doc"])
    return single.unionByName(again).select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return docs.where(~overlaps(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences without padding."""
    bounded_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Stages learn a language model, and pack by a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each on what its predecessor kept; results are cut by reliable checkpoints."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
