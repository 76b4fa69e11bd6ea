"""Importance resampling towards a target distribution, by hashed n-grams.

A document's features (runs of words) become an array of bucket numbers inside one row, by higher-order
functions. How often each bucket occurs in all documents and in the target is counted, and only those
counts are shuffled. A bucket's gain is the smoothed logarithm of how much more often the target has it;
a document's weight is the mean gain of its buckets, looked up in one literal array of all gains, so no
row is exploded, joined or moved to be scored. Adding seeded Gumbel noise to the weights and taking the
highest scores draws documents without replacement in proportion to exp(weight / scale).

Scores are whole numbers within a known range, so documents are ranked by a histogram: how many have each
score says where a score's ranks begin, and ties are put in order among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.llm.common import cut

BUCKETS = 10_000
#: Gains and scores are thousandths.
SCALE = 1000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    """SQL for the words of a text in the lower case of A-Z; a null text has none."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), r'{WORD}', 0)"


def bucket_array(of: str, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> str:
    """SQL for the buckets of all runs of ``shortest`` to ``longest`` words in an array of words, repeats included."""
    runs = [
        of if n == 1 else f"CASE WHEN size({of}) >= {n} THEN transform(sequence(1, size({of}) - {n - 1}), i -> array_join(slice({of}, i, {n}), ' ')) ELSE cast(array() AS array<string>) END"
        for n in range(shortest, longest + 1)
    ]
    every = runs[0] if len(runs) == 1 else f"concat({', '.join(runs)})"
    return f"transform({every}, f -> int(crc32(f) % {buckets}))"


def counts(texts: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of ``texts`` (text) fall into each bucket: one row a bucket is all that is shuffled or collected."""
    found = texts.select(F.explode(F.expr(bucket_array(words("text"), shortest, longest, buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in all)) of each bucket, with one more of each."""
    n, every, aimed = len(raw), float(raw.sum()), float(target.sum())
    ratio = ((target + 1.0) * (every + n)) / ((raw + 1.0) * (aimed + n))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def literal(values: np.ndarray) -> Column:
    """Whole numbers as one array; the optimiser makes a single literal of it."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def floored(total: Column, n: Column) -> Column:
    """total / n, rounded down, in whole numbers; 0 where n is 0."""
    some = F.greatest(n, F.lit(1).cast("long"))
    return F.floor((total - F.pmod(total, some)) / some).cast("long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by a hash of the seed and the id; a null id is written as nothing."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32))))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, shortest: int = 1, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of each of ``docs`` (doc_id, text)."""
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda sum_, x: sum_ + F.element_at(literal(gain), x + 1))
    buckets = bucket_array("w", shortest, longest, len(gain))
    cut_up = F.expr(f"transform(array({words('text')}), w -> named_struct('n_words', size(w), 'b', {buckets}))")
    scored = F.transform(cut_up, lambda s: F.struct(s["n_words"].cast("long").alias("n_words"), F.size(s["b"]).cast("long").alias("n_features"), total(s["b"]).alias("total")))[0]
    found = docs.select("doc_id", scored.alias("found"))
    return found.select("doc_id", "found.n_words", "found.n_features", floored(F.col("found.total"), F.col("found.n_features")).alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words towards ``target`` (text).

    Returns one row for each of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank; rank is null for
    those not drawn. All texts of both tables are counted, and all documents scored. A null or empty text
    has no features, weight 0, and is never drawn. Ties of a score go to the smaller doc_id, null last; rows
    that repeat an id are documents of their own, and take the ranks of a tie by features and weight. An empty
    table gives no rows; an empty target has only the smoothing.

    The driver holds one count a bucket and one a distinct score. A score is a mean gain, whose size is at most
    1000 times the logarithm of the number of features, and noise between -3,131 and 22,874, so there are under
    120,000 of those at any size, and that table is broadcast.
    """
    gain = gains(counts(docs, shortest, longest, buckets), counts(target, shortest, longest, buckets))
    scored = weighted(docs, gain, shortest, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    slim = cut(scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("able")))
    by_score = slim.where("able").groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    score, n = by_score["score"].to_numpy(), by_score["n"].to_numpy()
    ahead = np.cumsum(n) - n
    draw = percent * int(n.sum()) // 100
    score, ahead = score[ahead < draw], ahead[ahead < draw]
    starts = slim.sparkSession.createDataFrame(pa.table({"score": pa.array(score, pa.int64()), "ahead": pa.array(ahead, pa.int64())}))
    lowest = int(score[-1]) if len(score) else None
    high = (F.col("able") & (F.col("score") >= lowest)) if lowest is not None else F.lit(False)
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    ranked = slim.where(high).join(F.broadcast(starts), "score").withColumn("rank", (F.col("ahead") + F.row_number().over(ties)).cast("long"))
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(columns).unionByName(slim.where(~high).withColumn("rank", F.lit(None).cast("long")).select(columns))
