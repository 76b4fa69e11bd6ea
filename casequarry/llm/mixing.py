"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Each source gets a share of a total number of words in proportion to its weight, but no more than
``max_epochs`` times what it has; what a full source leaves over is shared by weight among the others
until none is above its cap. In closed form: order the sources by cap / weight, and let ``level`` of a
source be what the sources before it leave of the total at their caps, for each unit of weight from it
on. That level rises while sources are full and falls afterwards, so its maximum is the water level,
and a target is the smaller of the cap and weight times level.

A source is then repeated whole ``floor(target / size)`` times, and the rest of its target is a seeded
draw: its documents are put in the order of a hash and taken until the rest is filled, the last one
in part. That order is cut into buckets by the hash's leading digits, so that the running sum over a
source that holds most rows is a running sum over bucket totals plus one inside the single bucket in
which the rest is filled. What comes of it is one place in the order for each source, and every
document is held against that where it is read: no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.llm.common import columns_of, cut

WORD = r"[^\x20\x09-\x0D]+"
#: About so many documents of a source fall into a bucket of the draw's order.
BUCKET_ROWS = 1024
#: The table of sources is broadcast up to so many rows; beyond, it is joined by its key.
BROADCAST_SOURCES = 20_000


def words_in(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size) with its target; one row a source, so its windows are small.

    Weights go to the sources by code point, null last, repeating. An empty source's target is 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("weight", F.get(kinds, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_on", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("weight_on")).over(everything))
        .withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
        .drop("weight", "cap", "total", "before", "weight_on", "level")
    )


def _measured(docs: DataFrame, seed: int, keep: list[str]) -> DataFrame:
    """Columns row (those to keep, as a struct), key, source, size and at, the place in the draw's order, of each document."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("without an id "), F.coalesce(F.xxhash64("text"), F.lit(0)).cast("string")))
    draw, size = F.md5(F.concat(F.lit(f"{seed}:"), name)), words_in(F.col("text"))
    at = F.struct(draw.alias("draw"), F.col("doc_id").alias("doc_id"), size.alias("size"))
    row = F.struct(*columns_of(keep)) if keep else F.lit(None).cast("string")
    return docs.select(row.alias("row"), key.alias("key"), F.col("source").alias("source"), size.alias("size"), at.alias("at"))


def _drawn(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int, keep: list[str]) -> DataFrame:
    """row, size, source_size, target, taken of each document."""
    slim = cut(_measured(docs, seed, []).drop("row"))
    sources = slim.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(BUCKET_ROWS))).cast("long")
    plan = cut(targets(sources, weights, share, max_epochs).withColumn("whole", whole).withColumn("rest", rest).withColumn("buckets", buckets).drop("source", "docs"))
    small = plan.count() <= BROADCAST_SOURCES
    leading = F.conv(F.substring("at.draw", 1, 8), 16, 10).cast("long")
    bucketed = slim.join(F.broadcast(plan) if small else plan, "key").withColumn("bucket", F.floor(leading * F.col("buckets") / F.lit(float(1 << 32))))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("key", "rest", "bucket").agg(F.sum("size").alias("total")).withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0)))
    filled = totals.where((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("total"))).select("key", "bucket", "offset")
    inside = bucketed.where("size > 0").join(F.broadcast(filled) if small else filled, ["key", "bucket"])
    equal = inside.groupBy("key", "rest", "offset", "at").agg(F.count("*").alias("rows"))
    ahead = F.col("offset") + F.coalesce(F.sum(F.col("rows") * F.col("at.size")).over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = equal.withColumn("left", F.col("rest") - ahead).where((F.col("left") >= 0) & (F.col("left") < F.col("rows") * F.col("at.size")))
    ends = here.select("key", F.col("at").alias("end"), F.floor(F.col("left") / F.col("rows")).alias("part"))
    plan = cut(plan.join(ends, "key", "left").select("key", "source_size", "target", "whole", "rest", "end", "part"))
    part = (
        F.when(F.col("end").isNull(), F.when(F.col("rest") > 0, F.col("size")).otherwise(F.lit(0)))
        .when(F.col("at") < F.col("end"), F.col("size"))
        .when(F.col("at") == F.col("end"), F.col("part"))
        .otherwise(F.lit(0))
    )
    taken = (F.col("whole") * F.col("size") + part).cast("long")
    # ids are in the checkpoint already, so texts are read once more only where they are kept
    rows = slim.withColumn("row", F.struct("at.doc_id")) if keep == ["doc_id"] else _measured(docs, seed, keep)
    return rows.join(F.broadcast(plan) if small else plan, "key").select("row", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """How many words of each document of ``docs`` (doc_id, text, source) the mix takes.

    Returns one row a document: doc_id, size, source_size, target, taken. Words are counted over whole texts,
    null being empty; a document without words is taken 0 times. A source's taken words are its target,
    rounded; a document is taken whole ``floor(target / source_size)`` times and at most once more. Null
    sources are one source, the last by name. Rows that repeat an id are documents of their own; ties of
    the draw's order go by id, then size, and rows equal in all three share what is left there, rounded
    down. A document without an id is drawn by its text. The same seed gives the same draw; an empty
    table gives no rows.
    """
    return _drawn(docs, weights, share, max_epochs, seed, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix itself: every document whole, as often as it is taken, with the columns of ``docs`` and no others.

    The one document of a source that fills the rest of its target in part is given once more if that is
    nearer to the target than leaving it out. Nulls, ties and empty tables are as in ``mix``.
    """
    taken = _drawn(docs, weights, share, max_epochs, seed, docs.columns)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")).otherwise(F.lit(0))
    return taken.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
