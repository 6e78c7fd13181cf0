"""License scans by diagonal voting, in DataFrame functions alone.

All rolling pairs of a text's words meet the pairs of the templates in a broadcast
hash join (the templates are constants of this module).  Matches are counted by
diagonal, text position less template position; neighbouring diagonals are merged
over small insertions, and a span stands when enough of its template voted within
a stretch of about its length.  A base phrase stands where one diagonal has all its votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed phrases and labels: places count where their words stand one after the other.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Statements that add labels of their own, matched within ``NEAR`` words of insertion or loss.
STATEMENTS = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
NEAR = 2
ENOUGH = 0.8


def _templates() -> list[tuple[int, str, bool, int, list[str]]]:
    listed = [(label, phrase, True) for label, phrase in BASE] + [(label, phrase, False) for label, phrase in STATEMENTS]
    return [(k, label, exact, len(phrase.split()), phrase.split()) for k, (label, phrase, exact) in enumerate(listed)]


def template_pairs(spark: SparkSession) -> DataFrame:
    """Every pair of neighbouring words of every template with its position; a few hundred constant rows."""
    rows = ", ".join(f"({k}, '{label}', {exact}, {size}, {at}, '{words[at]}', '{words[at + 1]}')" for k, label, exact, size, words in _templates() for at in range(size - 1))
    return spark.sql(f"SELECT *, xxhash64(w0, w1) AS gram FROM VALUES {rows} AS t(tid, label, exact, size, at, w0, w1)")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    Words are ``[0-9a-z]`` and characters beyond ASCII, after lower-casing A-Z.  Positions
    count words from 0.  Null and empty texts have no words and no labels (empty
    strings), and null positions.  Rows are told apart by their place in the scan, so repeated rows and ids, null
    ids too, are reported each.  ``score`` is the largest share of a template's pairs
    that one reported span holds.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)).alias("words"))
    spots = rows.select("doc_id", "rid", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - 2, F.lit(-1)))).alias("pos"))
    one, two = F.get("words", F.col("pos")), F.get("words", F.col("pos") + 1)
    # Position -1 stands for the document itself: it meets no template and carries the size.
    grams = spots.select("doc_id", "rid", "pos", F.when(F.col("pos") >= 0, F.xxhash64(one, two)).alias("g"), one.alias("x0"), two.alias("x1"), F.size("words").alias("n"))
    pairs = F.broadcast(template_pairs(spark))
    met = grams.join(pairs, F.col("g") == F.col("gram"), "left").filter("pos = -1 or (x0 = w0 and x1 = w1)")
    votes = met.groupBy("rid", "doc_id", "tid", "label", "exact", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("hits"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.max(F.when(F.col("pos") == -1, F.col("n"))).alias("n"))
    # Exact phrases keep their diagonals apart; statements merge those up to NEAR words away.
    line = Window.partitionBy("rid", "tid").orderBy("diagonal")
    jump = (F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("exact"), F.lit(0)).otherwise(F.lit(NEAR))).cast("int")
    merged = votes.withColumn("jump", F.coalesce(jump, F.lit(0))).withColumn("bundle", F.sum("jump").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # A bundle of far-apart stretches is no span: its stretches are taken by neighbourhood.
    place = Window.partitionBy("rid", "tid", "bundle").orderBy("low", "high", "diagonal")
    apart = (F.col("low") - F.lag("high").over(place) > 1 + NEAR + F.when(F.col("exact"), F.lit(0)).otherwise(F.col("size"))).cast("int")
    merged = merged.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("stretch", F.sum("apart").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("rid", "doc_id", "tid", "label", "exact", "size", "bundle", "stretch").agg(F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("start"), F.max("n").alias("n"))
    share = F.least(F.lit(1.0), F.col("hits") / (F.col("size") - 1))
    full = F.col("exact") & (F.col("hits") == F.col("size") - 1)
    stands = full | (~F.col("exact") & (share >= ENOUGH) & (F.col("high") - F.col("low") + 2 <= F.col("size") + NEAR))
    found = spans.select("rid", "doc_id", "n", "label", full.alias("full"), stands.alias("stands"), "start", share.alias("share"))
    named = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("label")))), ",")
    full, stands = F.col("full"), F.col("stands")
    out = found.groupBy("rid", "doc_id").agg(F.max("n").alias("n"), F.count_if(full).alias("n_base"), F.min(F.when(full, F.col("start"))).alias("first_word"), F.max(F.when(full, F.col("start"))).alias("last_word"), named(full).alias("base_labels"), named(stands).alias("labels"), F.max(F.when(stands, F.col("share"))).alias("score"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), F.col("n_base").cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), "base_labels", "labels", F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same for DuckDB, over ``documents``."""
    rows = ", ".join(f"({k}, '{label}', {str(exact).lower()}, {size}, {at}, '{words[at]}', '{words[at + 1]}')" for k, label, exact, size, words in _templates() for at in range(size - 1))
    return rf"""
        WITH tpl(tid, label, exact, size, place, w0, w1) AS (VALUES {rows}),
        doc AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        spot AS (SELECT rid, words, unnest(range(0, greatest(len(words) - 1, 0))) AS pos FROM doc),
        votes AS (
            SELECT rid, tid, label, exact, size, pos - place AS diagonal, count(*) AS hits, min(pos) AS low, max(pos) AS high
            FROM (SELECT rid, pos, words[pos + 1] AS x0, words[pos + 2] AS x1 FROM spot) JOIN tpl ON x0 = w0 AND x1 = w1 GROUP BY ALL
        ), jumps AS (
            SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) > CASE WHEN exact THEN 0 ELSE {NEAR} END THEN 1 ELSE 0 END AS jump FROM votes
        ), bundles AS (
            SELECT *, sum(jump) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS bundle FROM jumps
        ), aparts AS (
            SELECT *, CASE WHEN low - lag(high) OVER (PARTITION BY rid, tid, bundle ORDER BY low, high, diagonal) > {1 + NEAR} + CASE WHEN exact THEN 0 ELSE size END THEN 1 ELSE 0 END AS apart FROM bundles
        ), stretches AS (
            SELECT *, sum(apart) OVER (PARTITION BY rid, tid, bundle ORDER BY low, high, diagonal) AS stretch FROM aparts
        ), spans AS (
            SELECT rid, label, exact, size, sum(hits) AS hits, min(low) AS low, max(high) AS high, min(diagonal) AS start
            FROM stretches GROUP BY rid, tid, label, exact, size, bundle, stretch
        ), found AS (
            SELECT rid, label, start, least(1.0::DOUBLE, hits::DOUBLE / (size - 1)) AS share, exact AND hits = size - 1 AS full_,
                (exact AND hits = size - 1) OR (NOT exact AND hits::DOUBLE / (size - 1) >= {ENOUGH} AND high - low + 2 <= size + {NEAR}) AS stands
            FROM spans
        ), per AS (
            SELECT rid, count(*) FILTER (full_) AS n_base, min(start) FILTER (full_) AS first_word, max(start) FILTER (full_) AS last_word,
                array_to_string(list_sort(list(DISTINCT label) FILTER (full_)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (stands)), ',') AS labels, max(share) FILTER (stands) AS score
            FROM found GROUP BY rid
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM doc LEFT JOIN per USING (rid)
    """
