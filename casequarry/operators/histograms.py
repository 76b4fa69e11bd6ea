"""Thresholds and medians of groups of any size, from counts that are summed up before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value that one pass decides.
PASS_BITS = 16


def otsu(pixels: DataFrame, group: str, level: str = "level", weight: str | None = None) -> DataFrame:
    """The level (0 to 255) of each group that separates dark from light best, the lowest of equals: group, threshold.

    ``weight`` is how many pixels a row stands for, else 1; rows with a null don't count. Groups of one level only have threshold 0.
    """
    of = F.col(weight) if weight else F.lit(1)
    counts = pixels.where(F.col(level).between(0, 255) & F.col(group).isNotNull()).groupBy(group, F.col(level).cast("long").alias("__level")).agg(F.sum(of).cast("long").alias("n"))
    every = Window.partitionBy(group)
    upto = every.orderBy("__level").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("__level")
    sums = counts.select(group, "__level", F.sum("n").over(upto).alias("n0"), F.sum(mass).over(upto).alias("m0"), F.sum("n").over(every).alias("n"), F.sum(mass).over(every).alias("m"))
    apart = (F.col("m0") / F.col("n0") - (F.col("m") - F.col("m0")) / (F.col("n") - F.col("n0"))) * (F.col("m0") / F.col("n0") - (F.col("m") - F.col("m0")) / (F.col("n") - F.col("n0")))
    scored = sums.withColumn("apart", F.when(F.col("n") > F.col("n0"), F.col("n0").cast("double") * (F.col("n") - F.col("n0")) * apart).otherwise(0.0))
    best = scored.groupBy(group).agg(F.max(F.struct("apart", (-F.col("__level")).alias("low"))).alias("best"))
    return best.select(group, F.when(F.col("best.apart") > 0, -F.col("best.low")).otherwise(0).alias("threshold"))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The exact median of whole numbers a group: group, n, median (the mean of the two in the middle); nulls don't count.

    Equal values are counted before anything moves. A pass counts the values by their upper bits, finds the two in
    the middle among the running sums, and goes on with what agrees with them, so a window sees at most 2 to the power of 16
    sums, whatever the group holds. The passes follow from the span of all values, which is what the driver gets.
    """
    counts = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    low, high = rows.where(F.col(group).isNotNull()).agg(F.min(F.col(value).cast("long")), F.max(F.col(value).cast("long"))).first()
    low, passes = low or 0, max(1, -(-((high or 0) - (low or 0)).bit_length() // PASS_BITS))
    counts = counts.withColumn("v", F.col("v") - F.lit(low))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    half = F.array(F.expr("(size + 1) div 2"), F.expr("size div 2 + 1"))
    wanted = sizes.select(group, "size", F.posexplode(half).alias("which", "place"), F.lit(0).cast("long").alias("above"))
    for level in reversed(range(passes)):
        bits = PASS_BITS * level
        summed = counts.groupBy(group, F.shiftright("v", bits).alias("upper")).agg(F.sum("n").alias("n")).withColumn("above", F.shiftright("upper", PASS_BITS))
        upto = Window.partitionBy(group, "above").orderBy("upper").rowsBetween(Window.unboundedPreceding, 0)
        running = summed.withColumn("upto", F.sum("n").over(upto))
        met = wanted.join(running, [group, "above"]).where((F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n")))
        wanted = met.select(group, "size", "which", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place"), F.col("upper").alias("above"))
    return wanted.groupBy(group).agg(F.first("size").alias("n"), (F.sum("above") / 2 + low).alias("median"))
