"""Registered queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest
from compare import difference
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from lattiq.llm import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), catalog.SQL[name], FOLDER) == ""


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 80")
    names = docs.columns
    quality, near, repeats, mixing, packing = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, FOLDER).persist()
    assert kept.columns == names and 0 < kept.count() < 80
    fewer = near(spark, kept, FOLDER).persist()
    assert fewer.columns == names and fewer.groupBy("text").count().filter("count > 1").count() == 0
    cut = repeats(spark, fewer, FOLDER).persist()
    assert cut.columns == names and cut.count() == fewer.count()
    assert cut.join(fewer.select("doc_id", F.col("text").alias("t")), "doc_id").filter("octet_length(text) > octet_length(t)").count() == 0
    mixed = mixing(spark, cut, FOLDER).persist()
    assert mixed.columns == names and mixed.groupBy("doc_id").count().filter("count > 2").count() == 0
    packed = packing(spark, mixed, FOLDER).persist()
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.filter("n <> end or n > 4096").count() == 0
    assert packed.groupBy().agg(F.sum((F.col("start") == 0).cast("int"))).first()[0] == mixed.count()
