"""Evaluation: predictions against ground truth, improvement metrics, statistics of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.functions import text, vectors
from casequarry.operators import order


def codes(values: Column) -> Column:
    """Distinct codes, trimmed and in upper case, without blanks, sorted."""
    plain = F.transform(F.coalesce(values, text.texts([])), lambda v: F.upper(F.trim(v)))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda v: v != "")))


def differences(records: DataFrame) -> DataFrame:
    """``records`` (predicted, truth arrays) with missing and wrong: sorted set differences of the codes."""
    predicted, truth = codes(F.col("predicted")), codes(F.col("truth"))
    return records.withColumns({"ground_truth": truth, "missing": F.array_except(truth, predicted), "wrong": F.array_except(predicted, truth)})


def rates(records: DataFrame) -> DataFrame:
    """One row: total_records and macro averages of the missing and wrong rates, to 4 digits.

    A record without a truth, or without a prediction, counts with a rate of 0; the wrong rate is over
    the predictions as they were given, repeats included.
    """
    rate = lambda part, whole: F.coalesce(F.try_divide(F.size(part), F.size(whole)), F.lit(0.0))
    mean = lambda x: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 4)
    return records.agg(
        F.count("*").alias("total_records"), mean(rate("missing", "ground_truth")).alias("avg_missing_rate"), mean(rate("wrong", F.coalesce("predicted", text.texts([])))).alias("avg_wrong_rate")
    )


def most_common(records: DataFrame, column: str, k: int = 10, order: str = "seq") -> DataFrame:
    """code, n of the k codes that are most often in an array column; ties by where they first stand."""
    found = records.select(order, F.posexplode(column).alias("pos", "code"))
    counted = found.groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct(order, "pos")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).select("code", "n")


def listing(common: DataFrame, k: int = 5) -> DataFrame:
    """One row, ``listed``: the k most common codes in a line."""
    order = Window.orderBy(F.desc("n"), "code")
    top = common.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "n"))), lambda r: F.concat(r["code"], F.lit("（"), r["n"].cast("string"), F.lit("次）")))
    return top.agg(F.coalesce(F.nullif(F.array_join(parts, "、"), F.lit("")), F.lit("（無）")).alias("listed"))


def improvement(first: Column, second: Column, corrected: Column) -> Column:
    """Distances of two outputs from the correction, to 4 digits, and the rate of improvement.

    Of unit vectors; a missing first output is at distance 1, a missing or equal second one where the
    first is; the rate is of the rounded distances, 0 if the first is none. Null without a correction.
    """
    distance = lambda v: F.round(1.0 - vectors.dot_columns(v, corrected), 4)
    one = F.when(first.isNull(), F.lit(1.0)).otherwise(distance(first))
    two = F.when(second.isNull() | F.coalesce(second == first, F.lit(False)), one).otherwise(distance(second))
    rate = F.when(one > 0, F.round((one - two) / one, 4)).otherwise(F.lit(0.0))
    return F.when(corrected.isNotNull(), F.struct(one.alias("v1_distance"), two.alias("v2_distance"), rate.alias("improvement_rate")))


def with_ordinal(rows: DataFrame, time: str, key: str) -> DataFrame:
    """``rows`` with their ordinal by time, then key, over the whole table; rows without a time come last.

    So do rows with a time that can't be read. They are dealt by what is written there and by key, so no task gets
    all of them; see ``order.numbered``.
    """
    moment = F.col(time).try_cast("timestamp")
    hour = F.coalesce(F.date_format(moment, "yyyyMMddHH"), F.lit("~"))
    return order.numbered(rows, [hour, F.col(time), F.col(key)], "ordinal")


def mean_improvement(history: DataFrame) -> DataFrame:
    """One row: how many cases have an improvement rate, and its mean to 4 digits, null without any."""
    return history.where("improvement_rate IS NOT NULL").agg(F.count("*").alias("n"), F.round(F.avg("improvement_rate"), 4).alias("mean_improvement"))


def store_stats(cases: DataFrame) -> DataFrame:
    """One row on a store: entries, distinct hashes, mean description length, first and last time.

    An empty store has total_entries 0 and nulls.
    """
    description = text.first_filled("description", "reasoning")
    return cases.agg(
        F.count("*").alias("total_entries"),
        F.count_distinct(F.nullif(F.col("image_hash"), F.lit(""))).alias("unique_images"),
        F.bround(F.avg(F.length(description)), 0).cast("long").alias("avg_desc_length"),
        F.min(F.nullif(F.col("timestamp"), F.lit(""))).alias("earliest"),
        F.max(F.nullif(F.col("timestamp"), F.lit(""))).alias("latest"),
    )
