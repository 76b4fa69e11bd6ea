"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(names: list[str]) -> list[Column]:
    """Columns by name, dots and blanks in a name included."""
    return [F.col("`{}`".format(name.replace("`", "``"))) for name in names]


def hashable(df: DataFrame) -> list[Column]:
    """All columns, those that hold maps as JSON, since Spark hashes no maps."""
    return [F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column for field, column in zip(df.schema, columns_of(df.columns), strict=True)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name like each of ``names`` that no column of ``df`` has, upper or lower case."""
    taken = {column.lower() for column in df.columns}
    mark = "__"
    while any((mark + name).lower() in taken for name in names):
        mark += "_"
    return [mark + name for name in names]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or what was set on the context.

    Without either, a local session uses a folder under its warehouse; on a cluster there is none that
    all executors are known to share, and that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage by a reliable checkpoint.

    Used for slim tables (ids, hashes, counts), never for whole texts.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor
