"""The case store as pure transformations: each takes tables and returns the new state of one.

Plain Parquet has no MERGE; ``sources.versions`` lays the rows that change over the others, as a version that
one writer alone can take.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.functions import text
from casequarry.operators import evaluate


def superseded(cases: DataFrame) -> DataFrame:
    """entry_id, seq, image_hash, status, superseded_by: all but the last of a hash are superseded.

    The last of a hash is a maximum, so a hash that most entries share meets nowhere; the join back is
    one that Spark can split.
    """
    last = cases.where(F.coalesce("image_hash", F.lit("")) != "").groupBy("image_hash").agg(F.max_by("entry_id", "seq").alias("latest"), F.max("seq").alias("latest_seq"))
    joined = cases.select("entry_id", "seq", "image_hash").join(last, "image_hash", "left")
    old = F.col("seq") < F.col("latest_seq")
    return joined.select("entry_id", "seq", "image_hash", F.when(old, "superseded").otherwise("active").alias("status"), F.when(old, F.col("latest")).alias("superseded_by"))


def image_key(which: str) -> Column:
    """The key of a row's image: its hash, or, where that is null or blank, the row by itself."""
    own = F.concat(F.lit(f"{which}:"), F.col("entry_id").cast("string"), F.lit(":"), F.coalesce(F.col("seq").cast("string"), F.lit("")))
    return F.when(F.trim(F.coalesce("image_hash", F.lit(""))) == "", own).otherwise(F.concat(F.lit("#"), F.col("image_hash")))


def versions(cases: DataFrame) -> DataFrame:
    """The history that storing ``cases`` one after the other leaves, as one row a version.

    entry_id is the first id of the hash, whose creation time all its versions carry; a version that
    was replaced keeps the first 200 characters of its description. A row without a hash is an entry of
    its own.
    """
    keyed = cases.select("entry_id", "seq", "image_hash", "description", image_key("row").alias("__key"))
    ends = keyed.groupBy("__key").agg(F.min_by("entry_id", "seq").alias("first_id"), F.max("seq").alias("last_seq"), F.count("*").alias("version_count"))
    joined = keyed.join(ends, "__key")
    current = F.col("seq").eqNullSafe(F.col("last_seq"))
    return joined.select(
        F.coalesce("first_id", "entry_id").alias("entry_id"), "seq", current.alias("current"), "version_count", F.when(~current, F.left(F.coalesce("description", F.lit("")), F.lit(200))).alias("description_snapshot")
    )


#: Columns of an entry that the store keeps itself; every other column that a batch brings is its payload.
MANAGED = ("entry_id", "seq", "image_hash", "timestamp", "updated_at", "version_count", "version_history", "status", "superseded_by")
#: Of the payload, what stays as it is unless something new is given.
STICKY = ("tags", "rag_metrics")


def snapshot(columns: Sequence[str]) -> Column:
    """What the history keeps of a version: the first 200 characters of its description, or else of its reasoning."""
    filled = [c for c in ("description", "reasoning") if c in columns]
    return F.left(F.coalesce(text.first_filled(*filled), F.lit("")), F.lit(200))


def upsert(cases: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """Store ``batch`` (entry_id, seq, image_hash, description, tags, ...) into ``cases``.

    ``cases`` has those columns and timestamp, updated_at, version_count, status, superseded_by, and may have
    version_history (an array of timestamp and description_snapshot). If the hash is stored, its last
    entry takes the payload of the batch's last row of that hash, counts one version more for each row and
    adds what was replaced to its history; tags and metrics stay unless new ones are given; its earlier
    entries become superseded. Else the batch's first row of that hash is a new entry, and later ones are
    versions of it. A row whose hash is null or blank has an image of its own, so it is always new.
    """
    payload = [c for c in batch.columns if c in cases.columns and c not in MANAGED]
    history = "version_history" in cases.columns
    arrays = {f.name for f in batch.schema if f.dataType.typeName() == "array"}

    def latest(c: str) -> Column:
        given = F.size(F.coalesce(c, F.array().cast(batch.schema[c].dataType))) > 0 if c in arrays else F.col(c).isNotNull()
        return F.max_by(c, F.when(given, F.col("seq")) if c in STICKY else F.col("seq")).alias(f"__new_{c}")

    keyed = batch.withColumn("__key", image_key("batch"))
    snaps = F.sort_array(F.collect_list(F.struct("seq", snapshot(batch.columns).alias("text")))).alias("__snaps")
    incoming = keyed.groupBy("__key").agg(
        F.min_by("entry_id", "seq").alias("__id"), F.min("seq").alias("__seq"), F.first("image_hash").alias("__hash"), F.count("*").cast("int").alias("__n"),
        *map(latest, payload), *([snaps] if history else []),
    )
    stored = cases.withColumn("__key", image_key("case"))
    last = stored.groupBy("__key").agg(F.max("seq").alias("__last_seq"), F.max_by("entry_id", "seq").alias("__last_id"))
    met = incoming.join(last, "__key", "left")
    joined = stored.join(met.where("__last_seq IS NOT NULL"), "__key", "left")
    hit, top = F.col("__n").isNotNull(), F.col("seq") == F.col("__last_seq")
    step = lambda time, words: F.struct(time.cast("string").alias("timestamp"), words.alias("description_snapshot"))
    again = lambda time: F.transform(F.slice("__snaps", F.lit(1), F.col("__n") - 1), lambda s: step(time, s["text"]))
    taken = lambda c: F.coalesce(f"__new_{c}", c) if c in STICKY else F.col(f"__new_{c}")
    changed = {c: F.when(hit & top, taken(c)).otherwise(F.col(c)) for c in payload} | {
        "updated_at": F.when(hit & top, F.lit(now)).otherwise(F.col("updated_at")),
        "version_count": F.when(hit & top, F.col("version_count") + F.col("__n")).otherwise(F.col("version_count")),
        "status": F.when(hit & ~top, "superseded").otherwise(F.col("status")),
        "superseded_by": F.when(hit & ~top & (F.coalesce("status", F.lit("")) != "superseded"), F.col("__last_id")).otherwise(F.col("superseded_by")),
    }
    created = {"entry_id": F.col("__id"), "seq": F.col("__seq"), "image_hash": F.col("__hash"), "timestamp": F.lit(now), "updated_at": F.when(F.col("__n") > 1, F.lit(now)), "version_count": F.col("__n")}
    created |= {c: F.col(f"__new_{c}") for c in payload}
    if history:
        kind = cases.schema["version_history"].dataType
        before = F.coalesce("version_history", F.array().cast(kind))
        changed["version_history"] = F.when(hit & top, F.concat(before, F.array(step(F.col("timestamp"), snapshot(cases.columns))), again(F.col("timestamp"))).cast(kind)).otherwise(F.col("version_history"))
        created["version_history"] = again(F.lit(now)).cast(kind)
    old = joined.select(*[changed.get(c, F.col(c)).alias(c) for c in cases.columns])
    missing = {c: F.lit(None).cast(cases.schema[c].dataType) for c in cases.columns if c not in created}
    return old.unionByName(met.where("__last_seq IS NULL").select(*[(created | missing)[c].alias(c) for c in cases.columns]))


def upserted(cases: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """The rows that storing ``batch`` into ``cases`` adds or changes, and no others; see ``upsert``.

    Only entries of the batch's hashes are looked at, so what comes out follows the batch.
    """
    keys = batch.select(image_key("batch").alias("__met")).distinct()
    touched = cases.withColumn("__was", F.coalesce("status", F.lit(""))).join(keys, image_key("case") == F.col("__met"), "left_semi")
    unchanged = (F.col("__was") == "superseded") & ~F.col("updated_at").eqNullSafe(F.lit(now))
    return upsert(touched, batch, now).where(~F.coalesce(unchanged, F.lit(False))).drop("__was")


def reviewed(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Reviewed cases (image_path, corrected, ...) with whether their image is among ``files`` (path), and the text to store."""
    there = files.select(F.col("path").alias("__path")).distinct().withColumn("__there", F.lit(True))
    met = cases.join(there, F.col("image_path") == F.col("__path"), "left")
    return met.withColumns({"saved": F.coalesce("__there", F.lit(False)), "description": F.trim(F.coalesce("corrected", F.lit("")))}).drop("__path", "__there")


def metric_history(cases: DataFrame) -> DataFrame:
    """entry_id, ordinal, time, v1_distance, v2_distance, improvement_rate of the cases whose metrics have a first distance."""
    known = cases.where("rag_metrics.v1_distance IS NOT NULL").select("entry_id", F.coalesce("rag_metrics.timestamp", "timestamp").alias("time"), "rag_metrics.v1_distance", "rag_metrics.v2_distance", "rag_metrics.improvement_rate")
    return evaluate.with_ordinal(known, "time", "entry_id")


def update(cases: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """``cases`` with the columns that ``patches`` (entry_id, ...) gives; null leaves a value as it is."""
    fields = [c for c in patches.columns if c != "entry_id" and c in cases.columns]
    renamed = patches.select("entry_id", F.lit(True).alias("__met"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = cases.join(renamed, "entry_id", "left")
    new = {c: F.coalesce(f"__{c}", c) for c in fields} | {"updated_at": F.when(F.col("__met"), F.lit(now)).otherwise(F.col("updated_at"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in cases.columns])


def describe(cases: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """New descriptions (entry_id, description): they are the reasoning as well."""
    both = patches.select("entry_id", "description", F.col("description").alias("reasoning"))
    return update(cases, both, now)


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a table (entries or vectors) but those of the ids."""
    return rows.join(ids.select("entry_id").distinct(), "entry_id", "left_anti")


def reindex(vectors: DataFrame, changed: DataFrame) -> DataFrame:
    """Vectors with the text vectors of ``changed`` (entry_id, text_vec, ordinal); image vectors stay,
    and a changed row moves to the end by its new ordinal."""
    new = changed.select("entry_id", F.col("text_vec").alias("__text"), F.col("ordinal").alias("__ordinal"))
    joined = vectors.join(new, "entry_id", "left")
    return joined.select("entry_id", F.coalesce("__ordinal", "ordinal").alias("ordinal"), "image_vec", F.coalesce("__text", "text_vec").alias("text_vec"))


def indexable(cases: DataFrame) -> DataFrame:
    """What a rebuilt index holds: entries with an id that aren't superseded, with the text to embed."""
    known = cases.where("entry_id IS NOT NULL AND coalesce(status, '') <> 'superseded'")
    return known.select("entry_id", "seq", text.first_filled("description", "reasoning").alias("description"))


def corrections(log: DataFrame, new: DataFrame) -> DataFrame:
    """View corrections in a table of their own, new ones after old."""
    return log.unionByName(new, allowMissingColumns=True)


def exported(shadow: DataFrame, files: DataFrame) -> DataFrame:
    """Shadow records that become cases: with a ground truth, and an image among ``files`` (path)."""
    ready = shadow.where(F.size(F.coalesce("ground_truth", text.texts([]))) > 0).join(files.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_semi")
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    reasoning = F.concat(F.lit("[Shadow Test] ground_truth="), listed("ground_truth"), F.lit("  missing="), listed("missing"), F.lit("  wrong="), listed("wrong"))
    return ready.select("image_path", F.col("description"), F.col("ground_truth").alias("correct_processes"), reasoning.alias("reasoning"), text.texts(["shadow_test"]).alias("tags"))
