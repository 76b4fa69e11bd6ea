"""Keywords of a catalogue that is a table, found in texts by an Aho-Corasick automaton: one pass over a text, however many there are.

The distinct keywords are cut into slices of bounded size. A slice is broadcast, each worker builds its automaton once,
and texts stream through it; so texts are read once for each slice, and a catalogue of a few hundred thousand keywords
is one slice.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of keywords in a slice; an automaton takes about a hundred times as much in a worker.
SLICE_BYTES = 4_000_000


@functools.lru_cache(maxsize=1)
def _automaton(keywords: tuple[str, ...]) -> ahocorasick.Automaton:
    """Of the last slice that a worker was given."""
    automaton = ahocorasick.Automaton()
    for i, keyword in enumerate(keywords):
        automaton.add_word(keyword, i)
    automaton.make_automaton()
    return automaton


def slices(keywords: DataFrame, size: int = SLICE_BYTES) -> list[list[str]]:
    """Distinct lower-cased keywords of ``keywords`` (keyword) in slices of about ``size`` bytes by hash; null and empty ones are none.

    The driver holds the slices, which is a catalogue's text once and not the texts that are searched.
    """
    lowered = keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    total = lowered.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / size))
    found: list[list[str]] = [[] for _ in range(n)]
    for row in lowered.select(F.pmod(F.xxhash64("keyword"), F.lit(n)).alias("slice"), "keyword").toLocalIterator():
        found[row["slice"]].append(row["keyword"])
    return [sorted(part) for part in found if part]


def found(texts: DataFrame, text: str, keywords: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """The other columns of ``texts``, and each ``keyword`` (lower-cased) that the lower-cased ``text`` contains: a row for each once.

    Exactly the keywords for which ``contains`` is true, overlapping ones and parts of words too. A null text contains none.
    """
    rest = [f"`{c}`" for c in texts.columns if c != text]
    lowered = texts.where(F.col(f"`{text}`").isNotNull()).select(*rest, F.lower(f"`{text}`").alias("__lowered"))
    schema = lowered.drop("__lowered").schema.add("keywords", T.ArrayType(T.StringType()))
    spark = texts.sparkSession
    parts = []
    for part in slices(keywords, size):
        given = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            listed = given.value
            automaton = _automaton(tuple(listed))
            for batch in batches:
                values = batch.column(batch.num_columns - 1)
                hits = [sorted({i for _, i in automaton.iter(value.as_py())}) for value in values]
                kept = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([[listed[i] for i in found] for found in hits], pa.list_(pa.string()))], names=schema.names)

        parts.append(lowered.mapInArrow(search, schema))
    if not parts:
        return lowered.limit(0).withColumnRenamed("__lowered", "keyword")
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.select(*rest, F.explode("keywords").alias("keyword"))


def rules_met(texts: DataFrame, key: str, text: str, catalogue: DataFrame, clues: int = 3, size: int = SLICE_BYTES) -> DataFrame:
    """key, rule_id, n_hits, clues of the rules of ``catalogue`` (rule_id, ord, keyword) of which a text contains a keyword.

    ``n_hits`` counts the catalogue's rows, and ``clues`` are the first of them by ord, as they are written there. A key that
    stands in several rows of ``texts`` has the hits of all.
    """
    rows = catalogue.select("rule_id", "ord", F.col("keyword").alias("__written"), F.lower("keyword").alias("keyword"))
    hits = found(texts.select(key, text), text, catalogue.select("keyword"), size).distinct().join(rows, "keyword")
    first: Column = F.slice(F.array_sort(F.collect_list(F.struct("ord", "__written"))), 1, clues)
    met = hits.groupBy(key, "rule_id").agg(F.count("*").alias("n_hits"), first.alias("first"))
    return met.select(key, "rule_id", "n_hits", F.array_join(F.transform("first", lambda x: x["__written"]), "、").alias("clues"))
