"""A table of Parquet files that several writers change at once, by numbered commits.

A commit is a small file that lists the layers of one version: a base, and changes laid over it, each of which holds
whole rows by key, or says that a key is gone. A writer reads a version, writes its layer beside the others, and takes
the next number by making a file of that name that nobody else has made. If somebody has, what they changed is
held against what this writer read and changed: if nothing meets, the layer goes on top of theirs, else the change
is made anew from the newer state. So no update is lost, and what a change writes follows what it changes.

Readers see one version: of a key that layers hold, the newest layer counts, and the base gives the rest. Layers
are merged when there are many, and into the base when they have grown against it.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many layers over the base are merged into one; and all into the base when they hold this share of its rows.
MOST_LAYERS = 8
BASE_SHARE = 0.25


class ConflictError(RuntimeError):
    """Other writers were faster as often as a change was tried."""


@dataclass(frozen=True)
class Layer:
    """``version`` is that of the newest change in it."""

    path: str
    version: int
    rows: int
    base: bool = False


@dataclass(frozen=True)
class Commit:
    """``source`` is the version of another table that this one follows, if it follows one."""

    version: int = 0
    layers: tuple[Layer, ...] = ()
    source: int = 0


@dataclass(frozen=True)
class Change:
    """What a writer wants: rows to put, keys that go, and what the choice of these rests on.

    ``reads`` has the values of some of the table's columns: rows that others changed meanwhile and that have those
    values make the change obsolete, as do rows with the keys it changes. None: any other change does.
    """

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    reads: DataFrame | None = None
    source: int | None = None


def take(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file of this content unless there is one of that name; whether it was made.

    A local or mounted folder has links for it, which are never made twice. Elsewhere a whole file is renamed, which
    on a file system with atomic renames (HDFS and its like) fails if the name is taken.
    """
    where = urlparse(path)
    if where.scheme in ("", "file"):
        local = unquote(where.path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as file:
            file.write(content)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    files, target = _hadoop(spark, path)
    draft = target.getParent().suffix(f"/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(content.encode()))
    out.close()
    if files.rename(draft, target):
        return True
    files.delete(draft, False)
    return False


def _hadoop(spark: SparkSession, path: str):
    """The file system that a path is in, and the path, as Spark itself would open it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


class VersionedTable:
    """Rows of ``schema`` by ``key``, below a folder that the driver and all executors share.

    A key may have several rows, which are put and go together; a null is a value of a key like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), list(key)
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = spark.createDataFrame([], schema).schema.add("__gone", "boolean")

    def latest(self) -> Commit:
        """The newest version; 0 of a table that nobody has written. A commit that can't be read is an error."""
        files, path = _hadoop(self.spark, f"{self.folder}/commits")
        names = [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []
        versions = [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith(".")]
        return self.commit(max(versions)) if versions else Commit()

    def commit(self, version: int) -> Commit:
        found = json.loads(self.spark.read.text(self._name(version), wholetext=True).first()[0])
        return Commit(found["version"], tuple(Layer(**layer) for layer in found["layers"]), found["source"])

    def read(self, commit: Commit | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        commit = commit or self.latest()
        below = [layer for layer in commit.layers if layer.base]
        base = self._rows(below).drop("__gone")
        over = self._newest([layer for layer in commit.layers if not layer.base])
        if over is None:
            return base
        if not below:
            return over.where("NOT __gone").drop("__gone")
        return base.join(self._keys(over), self._same(base), "left_anti").unionByName(over.where("NOT __gone").drop("__gone"))

    def changed(self, after: int, commit: Commit) -> DataFrame:
        """Keys that changed after a version, as far as layers tell it apart: maybe some more, never fewer."""
        return self._rows([layer for layer in commit.layers if layer.version > after]).select(*self.key).distinct()

    def update(self, change: Callable[[DataFrame, Commit], Change | None], attempts: int = 20) -> Commit:
        """Make a change to the newest version; ``change`` gets its rows and commit, and is asked again after a conflict.

        Returns the commit that holds it, or the one that was read if ``change`` gives None. After ``attempts`` conflicts
        it is a ConflictError, and nothing was changed.
        """
        for _ in range(attempts):
            read = self.latest()
            wanted = change(self.read(read), read)
            if wanted is None:
                return read
            layer, on = self._write(wanted), read
            while True:
                mine = Layer(layer.path, on.version + 1, layer.rows)
                made = Commit(on.version + 1, (*on.layers, mine), on.source if wanted.source is None else wanted.source)
                if self._take(made):
                    return made
                on = self.latest()
                if wanted.reads is None or self._meets(wanted, layer, read, on):
                    break
        raise ConflictError(f"{self.folder}: {attempts} attempts met changes of others")

    def replace(self, rows: DataFrame, source: int = 0, attempts: int = 20) -> Commit:
        """A new state of the whole table, on top of whatever is newest when it is written."""
        path, count = self._save(rows.withColumn("__gone", F.lit(False)))
        for _ in range(attempts):
            version = self.latest().version + 1
            if self._take(made := Commit(version, (Layer(path, version, count, True),), source)):
                return made
        raise ConflictError(f"{self.folder}: {attempts} attempts met changes of others")

    def compact(self, most: int = MOST_LAYERS, share: float = BASE_SHARE) -> Commit:
        """Merge layers if there are many or they are large; rows stay as they are. If another writer is faster it is left to them."""
        read = self.latest()
        base, over = [x for x in read.layers if x.base], [x for x in read.layers if not x.base]
        large = sum(x.rows for x in over) > share * sum(x.rows for x in base)
        if not over or (len(over) < most and not (large and base)):
            return read
        if large:
            path, count = self._save(self.read(read).withColumn("__gone", F.lit(False)))
        else:
            path, count = self._save(self._newest(over))
        merged = Layer(path, over[-1].version, count, large)
        made = Commit(read.version + 1, (merged,) if large else (*base, merged), read.source)
        return made if self._take(made) else self.latest()

    def _name(self, version: int) -> str:
        return f"{self.folder}/commits/{version:012d}.json"

    def _take(self, commit: Commit) -> bool:
        return take(self.spark, self._name(commit.version), json.dumps(asdict(commit)))

    def _save(self, rows: DataFrame) -> tuple[str, int]:
        path = f"{self.folder}/layers/{uuid.uuid4().hex}"
        rows.select(*self.stored.names).write.parquet(path)
        return path, self.spark.read.schema(self.stored).parquet(path).count()

    def _write(self, wanted: Change) -> Layer:
        rows = self._rows([])
        if wanted.rows is not None:
            rows = rows.unionByName(wanted.rows.withColumn("__gone", F.lit(False)), allowMissingColumns=True)
        if wanted.gone is not None:
            gone = wanted.gone.select(*self.key).distinct()
            rows = rows.unionByName(gone.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
        path, count = self._save(rows)
        return Layer(path, 0, count)

    def _rows(self, layers: Sequence[Layer]) -> DataFrame:
        if not layers:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.stored])
        return self.spark.read.schema(self.stored).parquet(*[layer.path for layer in layers])

    def _newest(self, layers: Sequence[Layer]) -> DataFrame | None:
        """Of each key that layers hold, the rows of the newest one of them, gone ones too unless rows stand beside them."""
        if not layers:
            return None
        if len(layers) == 1:
            stacked = self._rows(layers).withColumn("__version", F.lit(layers[0].version))
        else:
            stacked = functools.reduce(DataFrame.unionByName, [self._rows([x]).withColumn("__version", F.lit(x.version)) for x in layers])
        top = stacked.groupBy(*self.key).agg(F.max(F.struct("__version", ~F.col("__gone"))).alias("__top"))
        named = top.select("__top", *[F.col(k).alias(f"__key_{k}") for k in self.key])
        met = stacked.join(named, self._same(stacked) & (F.struct("__version", ~F.col("__gone")) == F.col("__top")))
        return met.select(*self.stored.names)

    def _keys(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(k).alias(f"__key_{k}") for k in self.key]).distinct()

    def _same(self, rows: DataFrame) -> Column:
        return functools.reduce(Column.__and__, [rows[k].eqNullSafe(F.col(f"__key_{k}")) for k in self.key])

    def _meets(self, wanted: Change, layer: Layer, read: Commit, on: Commit) -> bool:
        """Whether what others changed since a version was read has the keys that a layer changes, or what it rests on."""
        others = [x for x in on.layers if x.version > read.version]
        if any(x.base for x in others) or on.version > read.version and not others:
            return True
        theirs = self._rows(others)
        if not theirs.join(self._keys(self._rows([layer])), self._same(theirs), "left_semi").isEmpty():
            return True
        values = wanted.reads
        named = values.select(*[F.col(c).alias(f"__read_{c}") for c in values.columns])
        same = functools.reduce(Column.__and__, [theirs[c] == F.col(f"__read_{c}") for c in values.columns])
        return not theirs.join(named, same, "left_semi").isEmpty()
