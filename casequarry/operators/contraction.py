"""Connected components by contraction, for links of any number and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry.session import kept


def roots(links: DataFrame) -> DataFrame:
    """The component of every id in ``links`` (a, b, long): id, root, one of its ids. Links to itself and repeats are fine.

    In each round every id goes to that of itself and its neighbours whose hash of the round is smallest, and the links
    follow; new hashes each round leave a share of the ids however the links lie, so rounds grow with the logarithm of
    the ids. Rounds are kept in the shared folder; the way from an id to its last root is joined up at the end.
    """
    steps: list[DataFrame] = []
    left = kept(links.where("a <> b").select("a", "b").distinct())
    while not left.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = both.groupBy(F.col("a").alias("id")).agg(F.min(F.least(ranked("a"), ranked("b"))).alias("m"))
        step = kept(chosen.select("id", F.col("m.id").alias("root")))
        for side in ("a", "b"):
            left = left.join(step.select(F.col("id").alias(side), F.col("root").alias(f"__{side}")), side)
        left = kept(left.where("__a <> __b").select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct())
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = steps.pop()
    while steps:
        onwards = found.select(F.col("id").alias("root"), F.col("root").alias("__root"))
        found = steps.pop().join(onwards, "root", "left").select("id", F.coalesce("__root", "root").alias("root"))
    return found
