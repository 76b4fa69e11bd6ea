"""SimHash near-duplicate detection with multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most
three bits differ in at most one bit in one of the segments, so it is enough to enumerate, for each
segment, the ball of radius one around its value and to fetch the fingerprints that have such a value
there; the complete distance is verified inside that join, so that only true links come out of it.
A pair is looked up from one side only: from the fingerprint whose differing bit is 0, or from the
smaller one where the segments are equal.

Equal fingerprints are one node, so exact copies are one lookup and no pair. Components are found
by star contraction on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry.llm.common import cut
from casequarry.llm.components import components

SEED = 42
SEGMENT_BITS = 32


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of UTF-8 ``text``, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a shingle is ``words`` of
    them joined by spaces, or the whole sequence if it is shorter.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in more than half of the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def simhash(text: bytes | None, words: int) -> int:
    """The fingerprint of UTF-8 ``text`` as a signed 64-bit number; 0 without words."""
    bits = majority(shingle_hashes(text, words))
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (signed long) of every whole text of ``docs``; a null text is empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(compute, "doc_id long, fp long")


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` of ``nodes`` at ``distance`` or fewer bits.

    Each is found at least once. ``distance`` is at most 3: with two segments the ball of radius one is
    then enough. A node becomes some 36 rows, so the slim table is dealt to all tasks before.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one serve distances up to 3")
    spark, mask = nodes.sparkSession, (1 << SEGMENT_BITS) - 1
    segments = [F.shiftrightunsigned("fp", SEGMENT_BITS), F.col("fp").bitwiseAND(F.lit(mask))]
    tag = [0, 1 << SEGMENT_BITS]  # keeps the keys of the two tables apart
    nodes = nodes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "fp")
    index = nodes.select(F.explode(F.array(*[s.bitwiseOR(F.lit(t).cast("long")) for s, t in zip(segments, tag, strict=True)])).alias("key"), F.col("fp").alias("b"))
    balls = []
    for segment, t in zip(segments, tag, strict=True):
        own = F.struct(segment.bitwiseOR(F.lit(t).cast("long")).alias("key"), F.lit(True).alias("same"))
        near = [
            F.when(segment.bitwiseAND(F.lit(1 << bit).cast("long")) == 0, F.struct(segment.bitwiseOR(F.lit(1 << bit | t).cast("long")).alias("key"), F.lit(False).alias("same")))
            for bit in range(SEGMENT_BITS)
        ]
        balls += [own, *near]
    probes = nodes.select("fp", F.explode(F.array_compact(F.array(*balls))).alias("probe")).select(F.col("probe.key").alias("key"), F.col("probe.same").alias("same"), F.col("fp").alias("a"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    return probes.join(index, (probes["key"] == index["key"]) & close & once).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """Fingerprint and component of every document of ``docs`` (doc_id, text).

    Returns doc_id, fp (signed long), component_id: the smallest id that chains of links reach, a
    document's own included. A null or empty text, and one of white space only, has fingerprint 0 and
    links like any other. Rows that repeat an id keep a row each; a null id takes part in chains, and
    a component of nothing but null ids has a null component_id. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = cut(placed)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(placed.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
