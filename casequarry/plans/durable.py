"""Queries over versioned tables: several writers, layers over a base, and what a reader sees; and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.operators import store
from casequarry.plans.queries import documents
from casequarry.session import shared_folder
from casequarry.sources.tables import table
from casequarry.sources.versions import Change, Commit, VersionedTable

CASES = "entry_id long, seq long, image_hash string, description string, tags array<string>, timestamp string, updated_at string, version_count int, status string, superseded_by long"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def q64_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers store all documents at once, a third deletes toxic ones: every document is a version of its text.

    Documents in German or English are the batch of the first writer, who reads the store before the second one
    commits all others, and commits after it.
    """
    docs = documents(spark, sf_dir).select("entry_id", "seq", "image_hash", F.col("notes").alias("description"), "lang")
    first = F.coalesce(F.col("lang").isin("de", "en"), F.lit(False))
    one, two = docs.where(first).drop("lang"), docs.where(~first).drop("lang")
    cases = VersionedTable(spark, _folder(spark, "q64"), CASES, ["entry_id", "seq"])

    def saving(batch: DataFrame, before: DataFrame | None = None):
        def change(rows: DataFrame, at: Commit) -> Change:
            nonlocal before
            other, before = before, None
            if other is not None:
                cases.update(saving(other))
            return Change(rows=store.upserted(rows, batch, "2026-02-01T00:00:00"), reads=batch.select("image_hash").distinct())

        return change

    cases.update(saving(one, two))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("entry_id"))
    cases.update(lambda rows, at: Change(gone=rows.join(toxic, "entry_id", "left_semi").select("entry_id", "seq"), reads=toxic))
    return cases.read().select("entry_id", "image_hash", "description", "version_count")


def q65_layered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all vectors, of which some labels are changed, some go, and some of those come back; merged on the way."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("vec_id").alias("ordinal"), F.transform("embedding", lambda x: x.cast("double")).alias("text_vec"), "label")
    index = VersionedTable(spark, _folder(spark, "q65"), "entry_id long, ordinal long, text_vec array<double>", ["entry_id"])
    index.replace(rows.drop("label"))
    turned = rows.withColumns({"text_vec": F.transform("text_vec", lambda x: -x), "ordinal": F.col("ordinal") + 1_000_000})
    put = lambda part: index.update(lambda _, at: Change(rows=part.drop("label")))
    put(turned.where("label = 3"))
    index.update(lambda _, at: Change(gone=rows.where("label IN (3, 4, 5)").select("entry_id")))
    index.compact(most=2, share=2.0)
    put(turned.where("label = 4"))
    put(rows.where("label = 6").withColumn("ordinal", F.lit(-1).cast("long")))
    return index.read().select("entry_id", "ordinal", F.round(F.get("text_vec", F.lit(0)), 6).alias("first"))


QUERIES = {f.__name__: f for f in (q64_two_writers, q65_layered_index)}

ORACLE_SQL = {
    "q64_two_writers": """WITH batches AS (SELECT doc_id, source, sha256(text) AS image_hash, coalesce(lang IN ('de', 'en'), false) AS later FROM documents),
        stored AS (SELECT image_hash, coalesce(min(doc_id) FILTER (NOT later), min(doc_id)) AS entry_id, coalesce(arg_max(source, doc_id) FILTER (later), arg_max(source, doc_id)) AS description, count(*)::INT AS version_count FROM batches GROUP BY image_hash)
        SELECT * FROM stored WHERE entry_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "q65_layered_index": """SELECT vec_id AS entry_id, CASE label WHEN 4 THEN vec_id + 1000000 WHEN 6 THEN -1 ELSE vec_id END AS ordinal, round(CASE WHEN label = 4 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first
        FROM embeddings WHERE label NOT IN (3, 5)""",
}
