"""Calls of a provider that are asked once: answers by the hash of what was asked, kept as they come."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.operators import providers

_ROW = "request string, answer string, error string"


def request(value: Column, asking: Column | None = None) -> Column:
    """The hash that a call is known by: of the value, and of what else decides the answer (model, system prompt)."""
    parts = [value.cast("string")] if asking is None else [asking.cast("string"), value.cast("string")]
    return F.sha2(F.to_json(F.array(*parts)).cast("binary"), 256)


class Ledger:
    """Answers and errors in a shared folder: one row a call made, written a batch at a time.

    A batch is a job that appends its rows with one commit, so a run that is killed, or an executor that is lost, costs the
    calls of the batches under way, and those only. What failed is asked again by the next round, or the next run, until it has
    failed ``tries`` times: it is then a dead letter, and is never asked again. One run at a time may ask.
    """

    def __init__(self, spark: SparkSession, folder: str, tries: int = 3):
        if tries < 1:
            raise ValueError("tries is at least 1")
        self.spark, self.folder, self.path, self.tries = spark, folder, f"{folder}/calls", tries

    def calls(self) -> DataFrame:
        """Every call made: request, answer, error."""
        try:
            return self.spark.read.schema(_ROW).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], _ROW)

    def state(self) -> DataFrame:
        """One row a request: answer, the greatest of its errors if there is no answer, tries."""
        found = self.calls().groupBy("request").agg(F.max("answer").alias("answer"), F.max("error").alias("error"), F.count("*").alias("tries"), F.bool_or(F.col("error").isNull()).alias("done"))
        return found.withColumn("error", F.when(~F.col("done"), F.col("error")))

    def pending(self, rows: DataFrame, column: str, asking: Column | None = None) -> DataFrame:
        """The requests of ``rows`` that have no answer and aren't dead: request, value; equal ones once, blank ones not at all."""
        value = F.col(column).cast("string")
        asked = rows.where(F.regexp_like(value, F.lit(r"\S"))).select(request(value, asking).alias("request"), value.alias("value"))
        closed = self.state().where(F.col("done") | (F.col("tries") >= self.tries)).select("request")
        return asked.groupBy("request").agg(F.any_value("value").alias("value")).join(closed, "request", "left_anti")

    def ask(self, rows: DataFrame, column: str, factory: providers.Factory, batch: int = 100_000, asking: Column | None = None) -> int:
        """Ask what is pending, in batches of about ``batch`` calls dealt by hash, until nothing is; how many rounds that took.

        A round writes what is pending once, by batch, and asks each request once, so a round follows another only for what
        failed, at most ``tries`` times. A run that goes on after a failure plans anew.
        """
        slots = self.spark.sparkContext.defaultParallelism
        for rounds in range(self.tries + 1):
            planned = f"{self.folder}/round-{uuid.uuid4().hex}"
            pending = self.pending(rows, column, asking)
            shares = -(-pending.count() // batch)
            if not shares:
                return rounds
            slot = F.pmod(F.xxhash64("request"), F.lit(shares * slots))
            dealt = pending.withColumns({"slot": slot, "share": (slot / slots).cast("long")})
            dealt.repartition(min(shares * slots, 10_000), "slot").drop("slot").write.partitionBy("share").parquet(planned)
            for share in range(shares):
                todo = self.spark.read.schema("request string, value string, share long").parquet(planned).where(F.col("share") == share)
                called = providers.apply(todo.repartition(slots, "request"), "value", factory, "answer", "string")
                called.select("request", "answer", "error").write.mode("append").parquet(self.path)
        return self.tries

    def dead(self) -> DataFrame:
        """The dead letters: request, error, tries."""
        return self.state().where(~F.col("done") & (F.col("tries") >= self.tries)).select("request", "error", "tries")

    def answered(self, rows: DataFrame, column: str, asking: Column | None = None) -> DataFrame:
        """``rows`` with answer, error (if there is no answer) and tries: nulls and 0 where nothing was asked."""
        known = self.state().select(F.col("request").alias("__request"), "answer", "error", "tries")
        joined = rows.withColumn("__request", request(F.col(column), asking)).join(known, "__request", "left")
        return joined.withColumn("tries", F.coalesce("tries", F.lit(0).cast("long"))).drop("__request")
