"""Stages of the pipeline on rows that repeat an id or have none."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 80").persist()
    some = plain.filter("doc_id between 20 and 29")
    nameless = plain.filter("doc_id between 40 and 49").selectExpr("cast(null as long) as doc_id", "concat(text, ' and one more') as text", "lang", "source", "n_chars")
    return plain.unionByName(some).unionByName(nameless).persist()


def test_quality_judges_repeated_and_null_ids_each(spark, docs):
    kept = corpus_pipeline.quality_stage(spark, docs, FOLDER).persist()
    assert kept.filter("doc_id is null").count() > 0
    assert kept.filter("doc_id between 20 and 29").count() == 2 * kept.filter("doc_id between 20 and 29").distinct().count()


def test_near_dedup_leaves_one_row_of_a_group(spark, docs):
    kept = corpus_pipeline.near_dedup_stage(spark, docs, FOLDER).persist()
    assert kept.groupBy("text").count().filter("count > 1").count() == 0
    assert kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert kept.filter("doc_id between 20 and 29").count() > 0


def test_repeats_do_not_multiply_rows(spark, docs):
    assert corpus_pipeline.repeats_stage(spark, docs, FOLDER).count() == docs.count()


def test_stages_keep_extra_columns_and_empty_tables(spark, docs):
    wide = docs.selectExpr("*", "1 as kept", "'x' as row_key2", "2L as size")
    for stage in (corpus_pipeline.repeats_stage, corpus_pipeline.mix_stage):
        assert stage(spark, wide, FOLDER).columns == wide.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
