"""A case store in a folder, and the verbs on it, for users who want an object rather than functions.

``cases``, ``vectors``, ``corrections`` and ``shadow`` are tables of Parquet below the folder. Cases and
vectors are versioned (``sources.versions``): several users may save at once, and a save writes what it changes.
The vectors follow the cases: an index update embeds what changed since the version of the cases that the vectors
have seen, whoever changed it. Corrections and the shadow log are appended to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.functions import text
from casequarry.operators import analysis, evaluate, providers, retrieval, rules, store
from casequarry.sources import tables, versions

CASES = (
    "entry_id string, seq long, image_hash string, description string, tags array<string>, timestamp string, updated_at string, version_count int,"
    " status string, superseded_by string, reasoning string, correct_processes array<string>, bom_context string, shape_description string, geometry array<string>,"
    " rag_metrics struct<v1_distance:double,v2_distance:double,improvement_rate:double,timestamp:string>,"
    " version_history array<struct<timestamp:string,description_snapshot:string>>"
)
VECTORS = "entry_id string, ordinal long, image_vec array<double>, text_vec array<double>"
CORRECTIONS = "source_filename string, sha256 string, original_label string, corrected_label string, bbox array<int>, corrected_at string"
SHADOW = "seq long, image_path string, description string, predicted array<string>, truth array<string>, ground_truth array<string>, missing array<string>, wrong array<string>"


class CaseStore:
    def __init__(self, spark: SparkSession, folder: str, embedder: providers.Factory):
        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder
        self._cases = versions.VersionedTable(spark, f"{self.folder}/cases", CASES, ["entry_id", "seq"])
        self._vectors = versions.VersionedTable(spark, f"{self.folder}/vectors", VECTORS, ["entry_id"])
        self._adopt()

    def _adopt(self) -> None:
        """Take over a store whose states were replaced as a whole, once."""
        if self._cases.latest().version:
            return
        for name, table, schema in (("vectors", self._vectors, VECTORS), ("cases", self._cases, CASES)):
            try:
                found = tables.current(self.spark, f"{self.folder}/{name}")
            except AnalysisException as error:
                if not tables.is_missing(error):
                    raise
                continue
            empty = self.spark.createDataFrame([], schema)
            table.replace(found.select(*[F.col(c) for c in empty.columns if c in found.columns]).unionByName(empty, allowMissingColumns=True), source=1 if name == "vectors" else 0)

    def _log(self, name: str, schema: str) -> DataFrame:
        """A table that is only appended to; empty if it was never written. What can't be read is an error."""
        path, empty = f"{self.folder}/{name}", self.spark.createDataFrame([], schema)
        try:
            found = self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if tables.is_missing(error):
                return empty
            raise
        return found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])

    def cases(self) -> DataFrame:
        return self._cases.read()

    def vectors(self) -> DataFrame:
        return self._vectors.read()

    def corrections(self) -> DataFrame:
        return self._log("corrections", CORRECTIONS)

    def shadow(self) -> DataFrame:
        return self._log("shadow", SHADOW)

    def searchable(self) -> DataFrame:
        """Cases with their vectors, in the form that retrieval takes; superseded ones are kept for hashes."""
        return self.cases().join(self.vectors().select("entry_id", "image_vec", "text_vec"), "entry_id", "left")

    def save(self, batch: DataFrame, now: str) -> None:
        """Store cases (entry_id, seq, image_hash, description, tags, and any other of the store's columns), and index them."""
        given = batch.select(*[c for c in batch.columns if c in self._cases.schema.names])
        hashes = given.where(F.trim(F.coalesce("image_hash", F.lit(""))) != "").select("image_hash").distinct()

        def change(cases: DataFrame, at: versions.Commit) -> versions.Change:
            return versions.Change(rows=store.upserted(cases, given, now), reads=hashes)

        self._cases.update(change)
        self.index()

    def describe(self, patches: DataFrame, now: str) -> None:
        """New descriptions (entry_id, description) of stored cases; they are their reasoning too."""

        def change(cases: DataFrame, at: versions.Commit) -> versions.Change:
            met = cases.join(patches.select("entry_id").distinct(), "entry_id", "left_semi")
            return versions.Change(rows=store.describe(met, patches, now), reads=patches.select("entry_id"))

        self._cases.update(change)
        self.index()

    def index(self) -> None:
        """Embed the visible cases that were changed since the index was last brought up; vectors of cases that are gone or superseded go.

        All other vectors stay as they are, and image vectors stay in any case. Then both tables are compacted if it is time.
        """
        upto = self._cases.latest()

        def change(vectors: DataFrame, at: versions.Commit) -> versions.Change | None:
            if at.source >= upto.version:
                return None
            ids = self._cases.changed(at.source, upto).select("entry_id").where("entry_id IS NOT NULL").distinct()
            visible = store.indexable(self._cases.read(upto)).join(ids, "entry_id", "left_semi")
            embedded = providers.apply(visible, "description", self.embedder, "text_vec", "array<double>")
            rows = embedded.join(vectors.select("entry_id", "image_vec"), "entry_id", "left").select("entry_id", F.col("seq").alias("ordinal"), "image_vec", "text_vec")
            gone = vectors.select("entry_id").join(ids, "entry_id", "left_semi").join(visible.select("entry_id"), "entry_id", "left_anti")
            return versions.Change(rows=rows, gone=gone, source=upto.version)

        self._vectors.update(change)
        self._cases.compact()
        self._vectors.compact()

    def review(self, records: DataFrame, files: DataFrame, now: str) -> DataFrame:
        """Save reviewed cases: entry_id, seq, image_path, image_hash, corrected, bom_context, first_text, second_text.

        Returns entry_id, saved, improvement_rate. A case whose image isn't among ``files`` (path) isn't saved.
        A case with a first text is measured: how far it and the second text are from the correction.
        """
        met = store.reviewed(records, files)
        sides = ("first_text", "second_text", "description")
        for side in sides:
            met = providers.apply(met, side, self.embedder, f"__{side}", "array<double>").drop("error")
        vectors = [F.when(F.coalesce(side, F.lit("")) != "", F.col(f"__{side}")) for side in sides]
        rates = F.when(F.coalesce("first_text", F.lit("")) != "", evaluate.improvement(*vectors))
        measured = met.withColumn("rates", rates).withColumn("rag_metrics", F.when(F.col("rates").isNotNull(), F.struct("rates.*", F.lit(now).alias("timestamp"))))
        measured = analysis.kept(measured.drop(*[f"__{side}" for side in sides], "rates"))
        batch = measured.where("saved").select("entry_id", "seq", "image_hash", "description", F.col("description").alias("reasoning"), text.texts([]).alias("correct_processes"), "bom_context", "rag_metrics")
        self.save(batch, now)
        return measured.select("entry_id", "saved", F.when(F.col("saved"), F.col("rag_metrics.improvement_rate")).alias("improvement_rate"))

    def metric_history(self) -> DataFrame:
        return store.metric_history(self.cases())

    def delete(self, ids: DataFrame) -> None:
        """Delete cases (entry_id), and their vectors with them."""

        def change(cases: DataFrame, at: versions.Commit) -> versions.Change:
            return versions.Change(gone=cases.join(ids.select("entry_id").distinct(), "entry_id", "left_semi").select("entry_id", "seq"), reads=ids.select("entry_id"))

        self._cases.update(change)
        self.index()

    def rebuild(self) -> int:
        """Embed every visible case anew; image vectors that are there stay. Returns how many there are."""
        upto = self._cases.latest()
        embedded = providers.apply(store.indexable(self._cases.read(upto)), "description", self.embedder, "text_vec", "array<double>")
        images = self.vectors().select("entry_id", "image_vec")
        new = embedded.join(images, "entry_id", "left").select("entry_id", F.col("seq").alias("ordinal"), "image_vec", "text_vec")
        self._vectors.replace(new, source=upto.version)
        return self.vectors().count()

    def similar(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """The cascade for queries (query_id, image_hash, description), their descriptions embedded."""
        asked = providers.apply(queries, "description", self.embedder, "text_vec", "array<double>")
        asked = asked.withColumn("image_vec", F.lit(None).cast("array<double>"))
        return retrieval.cascade(asked, self.searchable(), k)

    def analyse(self, requests: DataFrame, catalogue: Sequence[rules.Rule], model: providers.Factory, guide: str = "") -> DataFrame:
        return analysis.analyse(requests, self.searchable(), catalogue, model, self.embedder, guide)

    def correct_view(self, records: DataFrame) -> None:
        tables.append(records.select(*self.corrections().columns), f"{self.folder}/corrections")

    def record(self, records: DataFrame) -> DataFrame:
        """Evaluate records (seq, image_path, description, predicted, truth) and append them to the log."""
        found = evaluate.differences(records).select(*self.shadow().columns)
        tables.append(found, f"{self.folder}/shadow")
        return found

    def stats(self) -> DataFrame:
        return evaluate.store_stats(self.cases())

    def vocabulary(self) -> DataFrame:
        return rules.vocabulary_use(self.cases())

    def shadow_stats(self) -> DataFrame:
        return evaluate.rates(self.shadow())

    def export(self, files: DataFrame, now: str) -> int:
        """Make cases of the log's records that have a truth and a file (path, image_hash); returns how many.

        An entry's id is its image's path, and its place is the record's.
        """
        ready = store.exported(self.shadow(), files).join(files.select(F.col("path").alias("image_path"), "image_hash"), "image_path")
        after = self.cases().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
        order = self.shadow().select("image_path", "seq").groupBy("image_path").agg(F.max("seq").alias("seq"))
        batch = ready.join(order, "image_path").select(F.col("image_path").alias("entry_id"), (F.col("seq") + after + 1).alias("seq"), "image_hash", "description", "correct_processes", "reasoning", "tags")
        n = batch.count()
        self.save(batch, now)
        return n
