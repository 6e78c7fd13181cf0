"""Mixing sources to target weights.

Every document gets a hash-random key.  A source's documents are ranged by key
into buckets; sums over the buckets before and over the documents before in the
bucket place each document on its source's line of words.  Whole turns of the line
are epochs; the last turn is cut at the exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Budgets of the sources (source, source_size): adds ``target``.

    Weights go round the sources by code point, null last.  Together the targets are ``share`` of all sizes; none is above
    ``most`` times its source's size, and what that cuts off goes to the others by
    weight until none is above.  Sources in the order of their cap per unit of weight
    are capped one after the other, so the level at which this ends is found from
    running sums over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(float(w)) for w in weights))
    known = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    known = known.withColumn("level", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("level", F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = known.withColumn("spent", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    known = known.withColumn("even", (F.col("budget") - F.col("spent")) / F.col("open"))
    known = known.withColumn("final", F.min(F.when(F.col("even") <= F.col("level"), F.struct("level", "even"))).over(everything)["even"])
    return known.select("source", "source_size", "weight", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def _lines(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, most, seed) -> tuple[DataFrame, DataFrame]:
    """(source, id, size, n, begin, turns, rest, ...) of each group of alike rows, and the sized input."""
    sized = docs.withColumn("size", word_count(F.col(text_col)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    lean = sized.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("size").alias("_size"), key.alias("_key"))
    lean = lean.groupBy("_source", F.substring("_key", 1, BUCKET_DIGITS).alias("_bucket"), "_key", "_id", "_size").agg(F.count("*").alias("_n"))
    words = F.col("_size") * F.col("_n")
    sums = lean.groupBy("_source", "_bucket").agg(F.sum(words).alias("own"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("s"), F.col("_bucket").alias("b"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
    plan = targets(lean.groupBy(F.col("_source").alias("source")).agg(F.sum(words).alias("source_size")), weights, share, most)
    plan = plan.withColumn("turns", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.select(F.col("source").alias("p"), "source_size", "target", "turns", (F.floor(F.col("target")).cast("long") - F.col("turns") * F.col("source_size")).alias("rest"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    lines = lean.withColumn("inner", F.coalesce(F.sum(words).over(within), F.lit(0)))
    lines = lines.join(sums, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("b"))).join(plan, F.col("_source").eqNullSafe(F.col("p")))
    return lines.withColumn("begin", F.col("ahead") + F.col("inner")), sized


def _cut(nth: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size, F.col("rest") - F.col("begin") - nth * size)).cast("long")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (words the mix takes of it, repeats counted).

    A row's size is its number of words; null and blank texts have none and are
    never taken.  The null source is a source like any other.  The key is a hash of
    seed and id, so reruns agree; repeated rows stand next to each other on the line
    and are taken one after the other.  A null id is an id like any other.  Other
    columns are not read, so their names do not matter.
    """
    lines, _ = _lines(docs, id_col, text_col, source_col, weights, share, most, seed)
    each = lines.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return each.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("turns") * F.col("_size") + _cut(F.col("nth"), F.col("_size"))).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """The mixed documents themselves, in the columns of the input.

    A document comes once per epoch that takes it.  The one document of a source
    where the last epoch ends is cut to its first words, joined by single spaces.
    Rows without words are no part of a mix by words and pass once, unchanged.
    """
    lines, sized = _lines(docs.select("*"), id_col, text_col, source_col, weights, share, most, seed)
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = sized.select(kept, F.col(id_col).alias("i"), F.col(source_col).alias("q"), F.col("size").alias("z"))
    joined = rows.join(lines, F.col("i").eqNullSafe(F.col("_id")) & F.col("q").eqNullSafe(F.col("_source")) & (F.col("z") == F.col("_size")))
    nth = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64(f"_row.{text_col}"))) - 1
    joined = joined.withColumn("nth", F.when(F.col("_n") > 1, nth).otherwise(F.lit(0)))
    joined = joined.withColumn("cut", _cut(F.col("nth"), F.col("_size")))
    epochs = F.when(F.col("_size") == 0, F.lit(1).cast("long")).otherwise(F.col("turns") + (F.col("cut") > 0).cast("long"))
    turned = joined.filter(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), epochs)))
    short = (F.col("_size") > 0) & (F.col("epoch") > F.col("turns")) & (F.col("cut") < F.col("_size"))
    text = F.when(short, F.array_join(F.slice(F.regexp_extract_all(F.col("_row")[text_col], F.lit(WORD), F.lit(0)), 1, F.col("cut").cast("int")), " ")).otherwise(F.col("_row")[text_col])
    return turned.select(*((text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns))
