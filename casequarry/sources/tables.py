"""Sources and sinks: tables, JSON stores with explicit schemas, listings, replacement of a table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = """
    id string, timestamp string, image_rel_path string, image_hash string,
    features struct<raw_vlm_description:string,shape_description:string,detected_features:struct<geometry:array<string>>>,
    correct_processes array<string>, reasoning string, bom_context string, tags array<string>, version_count int,
    version_history array<struct<timestamp:string,description_snapshot:string>>, updated_at string, status string, superseded_by string,
    rag_metrics struct<v1_distance:double,v2_distance:double,improvement_rate:double,timestamp:string>
"""
SHADOW = """
    image_path string, vlm_description string,
    system_inferences array<struct<process_id:string,process_name:string,confidence:double,source:string,clues:array<string>>>,
    ground_truth_processes array<string>, diff_missing array<string>, diff_wrong array<string>, timestamp string
"""
RULE = "struct<name:string,trigger_vlm:array<string>,trigger_bom:array<string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to all cores where its files make fewer partitions than there are cores.

    For work that costs far more than moving its rows, such as searching texts. A large table has more
    partitions than cores and stays as it is, so nothing is shuffled at scale. ``scan`` has to be a plain
    scan: its partitions are counted from its plan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, with ``seq``, their place in it; a missing file or a broken one is empty.

    Elements are numbered as they are parsed, so the file, one JSON document, is read by one task, as
    its format asks for.
    """
    empty = spark.createDataFrame([], f"seq long, {schema}")
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    parsed = whole.select(F.posexplode(F.from_json("value", f"array<struct<{_as_struct(schema)}>>")).alias("seq", "r"))
    return parsed.select(F.col("seq").cast("long"), "r.*")


def _as_struct(schema: str) -> str:
    """A column list as the fields of a struct type."""
    depth, out = 0, []
    for part in " ".join(schema.split()).replace(", ", ",").split(","):
        if not depth:
            name, kind = part.strip().split(" ", 1)
            part = f"{name}:{kind}"
        out.append(part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """A legacy case store as entries; elements without an id, such as view corrections, are left out."""
    return json_store(spark, path, CASES).where("id IS NOT NULL").withColumnRenamed("id", "entry_id")


def shadow_log(spark: SparkSession, path: str) -> DataFrame:
    return json_store(spark, path, SHADOW)


def rule_catalogue(spark: SparkSession, path: str) -> list[tuple[str, str, list[str], list[str]]]:
    """Rules from a JSON object of process id to name and keywords; an empty or missing one is an error."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{RULE}>").alias("m"))
    rules = [(k, r["name"] or "", r["trigger_vlm"] or [], r["trigger_bom"] or []) for row in parsed.collect() for k, r in (row["m"] or {}).items()]
    if not rules:
        raise ValueError(f"no rules in {path}")
    return rules


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a JSON object as a table: rule_id, name, channel (vlm, bom), ord, keyword; one row a keyword, and none on the driver.

    ``ord`` is a keyword's place in its list. A missing file is an error; a rule without keywords has no rows.
    """
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{RULE}>")).alias("rule_id", "r"))
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"r.trigger_{c}").alias("keywords")) for c in ("vlm", "bom")])
    each = parsed.select("rule_id", F.coalesce("r.name", F.lit("")).alias("name"), F.inline(channels))
    return each.select("rule_id", "name", "channel", F.posexplode("keywords").alias("ord", "keyword"))


def listing(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("jpg", "jpeg", "png", "pdf")) -> DataFrame:
    """path, name, length of a folder's files of these suffixes, by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*suffixes)).orderBy("name")


def hashed(files: DataFrame) -> DataFrame:
    """Files (content) with the SHA-256 of their bytes."""
    return files.withColumn("image_hash", F.sha2("content", 256))


def guide(spark: SparkSession, *paths: str) -> str:
    """The first of the texts that can be read, or an empty one."""
    for path in paths:
        try:
            return spark.read.text(path, wholetext=True).first()[0]
        except (AnalysisException, TypeError):
            continue
    return ""


def replace(df: DataFrame, folder: str) -> str:
    """Write a new state of a table beside the old ones, then point to it; returns its path.

    A pointer is one small file in a folder of its own, named by the time it was written, and nothing is
    ever overwritten: a reader takes the newest pointer that is complete, so it sees the old state or the
    new one. Two writers at once: the later pointer wins, and both states stay on disk.
    """
    mark = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    path = f"{folder}/state-{mark}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(f"{mark} {path}",)], "value string").coalesce(1).write.text(f"{folder}/pointer-{mark}")
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of a table; PATH_NOT_FOUND if none was ever written."""
    newest = spark.read.text(f"{folder}/pointer-*").agg(F.max("value").alias("value")).first()["value"]
    return spark.read.parquet(newest.split(" ", 1)[1])


def is_missing(error: AnalysisException) -> bool:
    """Whether an error says that there is nothing at a path, and not that what is there can't be read."""
    return error.getCondition() == "PATH_NOT_FOUND"


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length of a library's templates, PNG files, by name."""
    return listing(spark, folder, ("png",))


def save_files(files: DataFrame, folder: str) -> list[str]:
    """Write files (name, content) into a folder that executors share; returns the saved names, sorted.

    The writing is done where the rows are; a name that is there is replaced.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for name, content in zip(part["name"], part["content"], strict=True):
                Path(folder, Path(name).name).write_bytes(content)
            yield part[["name"]]

    Path(folder).mkdir(parents=True, exist_ok=True)
    return sorted(row["name"] for row in files.select("name", "content").mapInPandas(write, "name string").collect())


def delete_file(path: str) -> bool:
    """Delete one file; False if it isn't there."""
    there = Path(path).exists()
    Path(path).unlink(missing_ok=True)
    return there


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
