import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from compare import duck, rows  # noqa: E402
from loomlog.llm.queries import ORACLES, QUERIES  # noqa: E402


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir, ORACLES[name]))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    docs = first = pipeline.table(spark, sf_dir, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        kept = pipeline.frozen(stage(spark, docs, sf_dir))
        assert kept.columns == first.columns and kept.dtypes == first.dtypes, name
        assert 0 < kept.count() <= docs.count(), name
        docs = kept
    pieces = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    whole = pipeline.run(spark, sf_dir)
    assert sorted(whole.select("doc_id", "doc_tokens").distinct().collect()) == sorted(pieces.select("doc_id", "doc_tokens").distinct().collect())
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_takes_awkward_rows(spark, sf_dir):
    import corpus_pipeline as pipeline

    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "one two three\none two three", "en", "s", 27), (2, "one two three\none two three", "en", "s", 27), (3, "one two three", None, "s", 13)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            docs = pipeline.frozen(stage(spark, docs, sf_dir))


def test_near_duplicates_keep_one_of_each_group(spark, sf_dir):
    import corpus_pipeline as pipeline

    def near(name):
        words = [f"{name}{i}" for i in range(60)]
        return " ".join(words), " ".join([*words[:59], "other"])

    (a, a2), (b, b2), (c, c2), (d, _), (e, e2) = map(near, "abcde")
    texts = [(5, a), (5, b), (3, b2), (7, a2), (9, c), (9, c2), (None, d), (None, d), (None, d), (None, "alone"), (None, "alone too"), (None, e), (12, e2), (12, e2), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    left = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    of_c = [x for x in left if x in ((9, c), (9, c2))]
    want = [(5, a), (3, b2), (None, d), (None, "alone"), (None, "alone too"), (12, e2), (None, None), (None, None)]
    assert len(of_c) == 1 and sorted(left, key=str) == sorted(want + of_c, key=str)
