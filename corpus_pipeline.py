"""From raw documents to packed sequences: five stages, each written and read again before the next.

Quality rules drop what they reject, near-duplicate groups keep one document, repeated
passages are cut out of the texts that hold them, sources are mixed to their budgets,
and the mix is packed.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from lattiq.llm.durable import Workspace
from lattiq.llm.minhash import near_duplicates
from lattiq.llm.mixing import mix
from lattiq.llm.packing import pack
from lattiq.llm.quality_rules import judged
from lattiq.llm.repeats import remove_repeats
from lattiq.session import table


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row's content: ids may repeat or be null, and only rows that agree in all columns share a key."""
    return docs.withColumn("row_key", F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Rows with one id, or none, are judged each; null and blank texts go, for want of words.
    Extra columns stay, and an empty table stays empty.
    """
    rows = keyed(docs)
    kept = judged(rows, id_col="row_key").filter("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    return rows.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id; null ids come last.

    Of rows that agree in all columns one stays; ties in the id go by a hash of the row. Null and
    blank texts are no duplicates of each other unless their rows agree in all columns.
    Extra columns stay, and an empty table stays empty.
    """
    rows = keyed(docs)
    groups = near_duplicates(rows, id_col="row_key", width=5, percent=80).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    least = rows.select("row_key", "doc_id").join(groups, "row_key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least"))
    kept = least.select(F.col("least.row_key").alias("kept_key"))
    return rows.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").dropDuplicates(["row_key"]).select(docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too; n_chars follows the text.

    Every row stays, whatever its id; a text that is cut away is empty and a null text stays null.
    Rows with equal texts lose all of them. Extra columns stay, and an empty table stays empty.
    """
    rows = keyed(docs)
    cut = remove_repeats(rows, id_col="row_key", span=200, texts=True).filter("n_removed > 0").select(F.col("doc_id").alias("cut_key"), "kept_text").dropDuplicates(["cut_key"])
    joined = rows.join(cut, F.col("row_key") == F.col("cut_key"), "left")
    changed = F.col("cut_key").isNotNull()
    fresh = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return joined.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights; a document comes once for each epoch that takes it, the last cut to the words that are left.

    The null source is a source; ties in the random order go by id. Null and blank texts have no
    words and are taken by nobody's budget. Extra columns stay, and an empty table stays empty.
    """
    return mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences: by ascending id, null first, repeated rows as often as they come; a null text is its end mark alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mix_stage),
    ("packing", pack_stage),
]

#: Perplexity, repeats and tokens have no SQL; tests/llm holds every stage against a plain one on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of ``documents``, through every stage."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.settle(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            space.drop(f"stage-{k - 1}")
    return docs
