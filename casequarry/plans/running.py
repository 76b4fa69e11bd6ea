"""Queries of what runs on: an evaluation of a log that arrives in any order, and calls that are asked once; and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.operators import ledger
from casequarry.plans import queries
from casequarry.session import shared_folder, written
from casequarry.sources.tables import spread, table
from casequarry.streaming import running, shadow

_RECORD = "seq long, revision long, predicted array<string>, truth array<string>"


def _followed(spark: SparkSession, sf_dir: str) -> str:
    """The evaluation log as files: drafts that say something else, the records, and files that come twice."""
    records = written(queries._records(spark, sf_dir).select("seq", F.lit(2).cast("long").alias("revision"), "predicted", "truth"))
    draft = records.select("seq", F.lit(1).cast("long").alias("revision"), F.col("truth").alias("predicted"), F.array_append("predicted", F.lit("X9")).alias("truth"))
    late = F.pmod(F.xxhash64("seq"), F.lit(2)) == 0
    folder = f"{shared_folder(spark)}/q72-{uuid.uuid4().hex}"
    for part in (records.where(~late), draft, records, draft.where(late)):
        part.write.mode("append").parquet(f"{folder}/log")
        running.follow(shadow.read(spark, f"{folder}/log", _RECORD, 1000), f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/state"


def q72_running_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.rates(spark, _followed(spark, sf_dir))


def q72b_running_most_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.most_common(spark, _followed(spark, sf_dir), "missing")


def _answer():
    def measure(value: object) -> str:
        words = str(value).split()
        if len(words) > 1500:
            raise ValueError("too long")
        return f"{len(words)} words"

    return measure


def q73_durable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text asked of a provider that refuses very long ones: equal texts are one call, texts refused twice are dead letters."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    calls = ledger.Ledger(spark, f"{shared_folder(spark)}/q73-{uuid.uuid4().hex}", tries=2)
    calls.ask(docs, "text", _answer, batch=200_000)
    return calls.answered(docs, "text").select("doc_id", "answer", "error", "tries")


QUERIES = {f.__name__: f for f in (q72_running_rates, q72b_running_most_missed, q73_durable_calls)}

ORACLE_SQL = {
    "q72_running_rates": queries.ORACLE_SQL["q14_rates"],
    "q72b_running_most_missed": queries.ORACLE_SQL["q14b_most_missed"],
    "q73_durable_calls": r"""WITH counted AS (SELECT doc_id, trim(text, E' \t\n\r\f\x0b') = '' OR text IS NULL AS blank, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
        SELECT doc_id, CASE WHEN NOT blank AND n <= 1500 THEN n || ' words' END AS answer, CASE WHEN NOT blank AND n > 1500 THEN 'ValueError: too long' END AS error, CASE WHEN blank THEN 0 WHEN n > 1500 THEN 2 ELSE 1 END::BIGINT AS tries FROM counted""",
}
