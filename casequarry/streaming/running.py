"""A running evaluation: what ``evaluate.rates`` and ``evaluate.most_common`` say of a log that still arrives.

Records carry an id and a revision. Whatever order they come in, and however often, the newest revision of an id
counts once: the state keeps it, a batch writes it, and it is counted as it is asked for.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from casequarry.operators import evaluate

_NEWEST = "seq long, newest struct<revision: long, missing: array<string>, wrong: array<string>, truths: long, predictions: long>"


def newest(records: DataFrame) -> DataFrame:
    """A stream of records (seq, revision, predicted, truth) as the newest revision of the ids that each batch names: seq, newest.

    The state is a row an id, dealt to all tasks by it. Revisions with one number, of which something differs, are settled alike in
    any order: the greater one counts. Records without an id or a revision are left out.
    """
    told = evaluate.differences(records.where("seq IS NOT NULL AND revision IS NOT NULL"))
    size = lambda c: F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("long").alias
    said = F.struct(F.col("revision").cast("long").alias("revision"), "missing", "wrong", size(F.col("ground_truth"))("truths"), size(F.col("predicted"))("predictions"))
    return told.groupBy(F.col("seq").cast("long").alias("seq")).agg(F.max(said).alias("newest"))


def follow(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Run through the records that are there, then stop; called again it goes on. ``folder`` and ``checkpoint`` are shared.

    A batch that is done again after a failure writes its own folder again, so it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return newest(records).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """The newest revision of every id, over all batches."""
    try:
        told = spark.read.schema(_NEWEST).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        told = spark.createDataFrame([], _NEWEST)
    return told.groupBy("seq").agg(F.max("newest").alias("newest")).select("seq", "newest.*")


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """As ``evaluate.rates`` over the newest revisions: from counts of whole numbers, so the order of batches leaves no trace."""
    sides = [F.struct(F.lit(kind).alias("kind"), F.size(kind).cast("long").alias("part"), F.col(whole).alias("whole")) for kind, whole in (("missing", "truths"), ("wrong", "predictions"))]
    counts = _read(spark, folder).select(F.inline(F.array(*sides))).groupBy("kind", "part", "whole").agg(F.count("*").alias("n"))
    share = F.col("n") * F.coalesce(F.try_divide("part", "whole"), F.lit(0.0))
    of = lambda kind: F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("kind") == kind, share)), F.sum(F.when(F.col("kind") == kind, F.col("n")))), F.lit(0.0)), 4)
    total = F.coalesce(F.sum(F.when(F.col("kind") == "missing", F.col("n"))), F.lit(0).cast("long"))
    return counts.agg(total.alias("total_records"), of("missing").alias("avg_missing_rate"), of("wrong").alias("avg_wrong_rate"))


def most_common(spark: SparkSession, folder: str, kind: str, k: int = 10) -> DataFrame:
    """As ``evaluate.most_common`` of ``missing`` or ``wrong`` over the newest revisions: code, n."""
    found = _read(spark, folder).select("seq", F.posexplode(kind).alias("pos", "code"))
    counted = found.groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).select("code", "n")
