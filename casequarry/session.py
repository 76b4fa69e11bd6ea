"""Session helper shared by tests, the bench and the command line."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def setting(name: str, default: str = "") -> str:
    """A setting of the library: spark.casequarry.NAME of a running session, else CASEQUARRY_NAME, else a default."""
    running = SparkSession.getActiveSession()
    found = running.conf.get(f"spark.casequarry.{name}", None) if running else None
    return found or os.environ.get(f"CASEQUARRY_{name.upper()}") or default


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries are tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("casequarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir's, or the context's.

    Without one, a local session uses a folder below its warehouse; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return shared


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that all executors share, so that a lost one repeats no work (and no request).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder: a checkpoint would compute it twice, and take more room."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shares(spark: SparkSession, rows: int, most: int, least: int = 256) -> int:
    """Into how many shares either side of a join of blocks is dealt: a few tasks a core, and up to ``most`` rows a share."""
    few = min(math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism)), math.ceil(rows / least))
    return max(1, few, math.ceil(rows / most))


def met(blocks: DataFrame, others: DataFrame, n: int, n_others: int) -> DataFrame:
    """Every block with every other one. Both are files, which a task reads in place: no block is shuffled."""
    return blocks.coalesce(n).crossJoin(others.coalesce(n_others))
