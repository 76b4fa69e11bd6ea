"""Retrieval of similar cases: exact hash, fused vectors, common words, and the cascade of them.

A case table has entry_id, seq (its place in the store: "latest" and ties go by it), image_hash,
description, status, and the vectors where they are used. Queries have query_id and the same fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.functions import fixed, text, vectors
from casequarry.operators import likeness

MIN_SIMILARITY = 0.35


def latest_by_hash(cases: DataFrame) -> DataFrame:
    """The last entry of each hash, superseded ones included; summed up before it is shuffled."""
    return cases.where(F.coalesce("image_hash", F.lit("")) != "").groupBy("image_hash").agg(F.max_by("entry_id", "seq").alias("entry_id"), F.count("*").alias("n_entries"))


def exact_match(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, entry_id, score 1.0 of the queries whose hash is stored; one row a query."""
    found = queries.select("query_id", "image_hash").join(latest_by_hash(cases), "image_hash")
    return found.select("query_id", "entry_id", F.lit(1.0).alias("score"), F.lit("exact_hash").alias("match_type"))


def visible(cases: DataFrame) -> DataFrame:
    return cases.where(F.coalesce("status", F.lit("")) != "superseded")


def search(cases: DataFrame, image: Sequence[float] | None, words: Sequence[float] | None, k: int = 3, image_weight: float = 0.4, text_weight: float = 0.6, digits: int | None = None) -> DataFrame:
    """The k best entries for one query by weighted late fusion of its channels; scores over 0 only.

    ``cases`` has image_vec and text_vec, either of which may be null. Ties go by seq.
    """
    score = vectors.fused(
        None if image is None else vectors.dot(F.col("image_vec"), image), None if words is None else vectors.dot(F.col("text_vec"), words), image_weight, text_weight
    )
    score = F.round(score, digits) if digits is not None else score
    return cases.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "seq").limit(k)


def above_threshold(hits: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Hits whose raw score passes; after the top k, so fewer than k may be left."""
    return hits.where(F.col("score") >= least)


def common_words(queries: DataFrame, cases: DataFrame, least: float = 0.0) -> DataFrame:
    """query_id, entry_id, seq, score: Jaccard likeness of the distinct words, where it is over 0 and at least ``least``.

    Every pair, so as many rows as there are; ``likeness.most_alike`` gives the best of each query.
    """
    q_classes, s_classes, q_members, s_members = likeness.classes(queries, cases)
    found = likeness.scored(q_classes, s_classes, least)
    return found.join(q_members, "q_key").join(s_members, "s_key").select("query_id", "entry_id", "seq", "score")


def jaccard_search(cases: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The k entries with the most words in common with one query text; scores over 0, ties by seq."""
    import re

    words = sorted({w.lower() for w in re.findall(r"[A-Za-z]{4,}", query)})
    scored = cases.withColumn("score", text.jaccard(text.tokens(F.col("description")), text.texts(words)))
    return scored.where("score > 0").orderBy(F.desc("score"), "seq").limit(k)


def shape_score(shape: str, geometry: Sequence[str]) -> Column:
    """Score of a stored shape and geometry for a query: 3 if one shape names the other, 1 each in common."""
    stored = F.coalesce("shape_description", F.lit(""))
    alike = (stored != "") & F.lit(shape != "") & (F.contains(stored, F.lit(shape)) | F.contains(F.lit(shape), stored))
    common = F.size(F.array_intersect(F.array_distinct(F.coalesce("geometry", text.texts([]))), text.texts(geometry)))
    return F.when(alike, F.lit(3)).otherwise(F.lit(0)) + common


def shape_search(cases: DataFrame, shape: str, geometry: Sequence[str], k: int = 3) -> DataFrame:
    """The last resort where no words are in common: confidence is a tenth of the score."""
    scored = cases.withColumn("points", shape_score(shape, geometry)).where("points > 0")
    return scored.orderBy(F.desc("points"), "seq").limit(k).withColumn("confidence", F.round(F.col("points") / 10, 3))


def best_of_each(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_hits(queries: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """The k best visible entries of every query that has a vector: query_id, entry_id, score, rank.

    Ids may be of any type: entries are searched by seq and queries by a hash of their id, and both are
    named again afterwards.
    """
    asked = queries.where("image_vec IS NOT NULL OR text_vec IS NOT NULL").select(F.xxhash64("query_id").alias("id"), "query_id", F.col("image_vec").alias("image"), F.col("text_vec").alias("text"))
    stored = visible(cases).where("image_vec IS NOT NULL OR text_vec IS NOT NULL").select(F.col("seq").alias("id"), F.col("image_vec").alias("image"), F.col("text_vec").alias("text"))
    found = vectors.nearest(asked, stored, k, itself=True)
    named = found.join(asked.select(F.col("id").alias("__q"), F.col("query_id").alias("__query")), F.col("query_id") == F.col("__q"))
    named = named.join(cases.select("seq", "entry_id"), F.col("match_id") == F.col("seq"))
    return named.select(F.col("__query").alias("query_id"), "entry_id", "score", "rank")


def cascade(queries: DataFrame, cases: DataFrame, k: int = 3, least: float = MIN_SIMILARITY) -> DataFrame:
    """Hash, then vectors, then words: query_id, entry_id, rank, score, match_type.

    A query with a stored hash gets that entry alone. Of the others, those with any positive vector
    score get their k best entries that pass the threshold, even if none does; only the rest are
    compared by words, where the rounded score has to pass.
    """
    exact = exact_match(queries, cases).withColumn("rank", F.lit(1))
    rest = queries.join(exact.select("query_id"), "query_id", "left_anti")
    scored = vector_hits(rest, cases, k)
    semantic = scored.where(F.col("score") >= least).withColumn("match_type", F.lit("semantic"))
    unmet = rest.join(scored.select("query_id").distinct(), "query_id", "left_anti")
    worded = likeness.most_alike(unmet, cases, k, least - 0.0005).withColumn("score", F.round("score", 3))
    worded = worded.where(F.col("score") >= least).withColumn("match_type", F.lit("text_keyword"))
    columns = ["query_id", "entry_id", "rank", "score", "match_type"]
    return exact.select(columns).unionByName(semantic.select(columns)).unionByName(worded.select(columns))


def priors(description: Column, vocabulary: Sequence[str] = fixed.VOCABULARY) -> Column:
    """The vocabulary's terms that a description uses, in the vocabulary's order."""
    return text.let(F.lower(description), lambda lowered: text.hits(lowered, vocabulary))


def anchors(skills: Column, symbols: Column, terms: Column) -> Column:
    """Skills, then the symbols and the terms that aren't among the skills."""
    fresh = lambda more: F.filter(more, lambda x: ~F.array_contains(skills, x))
    return F.concat(skills, fresh(symbols), fresh(terms))
