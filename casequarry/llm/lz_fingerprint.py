"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases (LZ78: each phrase is the longest known one
and one more byte), the phrases are hashed, and the fingerprint is the sorted list of the ``SIZE``
smallest hashes of that set. Two fingerprints are as alike as the share of phrases that is common
among the smallest hashes of their union, an estimate of the Jaccard likeness of the two phrase sets:
texts that would compress each other well have many phrases in common.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes in a fingerprint.
SIZE = 64
#: About so many documents lie in a range of the order by id. There are at most MAX_RANGES, as many as a shuffle
#: has use for tasks: beyond that ranges grow, and a task still holds two documents at a time.
RANGE_ROWS = 512
MAX_RANGES = 100_000
#: Ids that are looked at to lay a range's bounds.
SAMPLED = 20


def parse(data: bytes, phrases: set[bytes]) -> tuple[list[bytes], int]:
    """Parse ``data`` with and into the known ``phrases``.

    Returns the new phrases and where the last, unfinished one begins (the end, if there is none). The
    prefixes of a phrase are phrases, so the longest known one can be searched from any length.
    """
    new: list[bytes] = []
    start, end, length = 0, len(data), 3
    while start < end:
        stop = start + length
        phrase = data[start:stop]
        if phrase in phrases:
            while phrase in phrases and stop < end:
                stop += 1
                phrase = data[start:stop]
            if phrase in phrases:
                break
        else:
            shorter = phrase[:-1]
            while shorter and shorter not in phrases:
                phrase, shorter = shorter, shorter[:-1]
        phrases.add(phrase)
        new.append(phrase)
        length = len(phrase)
        start += length
    return new, start


def hashes(phrases: list[bytes]) -> np.ndarray:
    """Well mixed 32-bit hashes of the phrases."""
    h = np.fromiter(map(crc32, phrases), dtype=np.uint32, count=len(phrases))
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def smallest(*parts: np.ndarray) -> np.ndarray:
    """The sorted SIZE smallest of some hashes."""
    h = np.concatenate(parts)
    if len(h) > SIZE:
        h = np.partition(h, SIZE - 1)[:SIZE]
    return np.unique(h)


def fingerprint(text: str) -> np.ndarray:
    return smallest(hashes(parse(text.encode(), set())[0]))


def fingerprint_pair(text: str, edited_tail: str, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of its first ``kept`` characters with another tail.

    The common beginning is parsed and hashed once.
    """
    common, tail = text[:kept].encode(), text[kept:].encode()
    phrases: set[bytes] = set()
    new, start = parse(common, phrases)
    shared = hashes(new)
    unfinished = common[start:]
    if edited_tail == text[kept:]:
        own = smallest(shared, hashes(parse(unfinished + tail, phrases)[0]))
        return own, own
    again = set(phrases)
    own = smallest(shared, hashes(parse(unfinished + tail, phrases)[0]))
    return own, smallest(shared, hashes(parse(unfinished + edited_tail.encode(), again)[0]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, 0 to 1; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:SIZE]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, common, assume_unique=True).sum() / len(union))


def as_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(value), dtype=">u4").astype(np.uint32)


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column; a null text is empty, and its fingerprint too.

    Rows, repeats and other columns stay as they are; a column of that name is replaced.
    """

    @F.pandas_udf(T.StringType())
    def compute(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: as_text(fingerprint(value or "")))

    return docs.withColumn(name, compute(F.col(text)))


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null if either is null."""

    @F.pandas_udf(T.DoubleType())
    def compare(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right, strict=True)
        return pd.Series([None if x is None or y is None else likeness(from_text(x), from_text(y)) for x, y in pairs], dtype="float64")

    return compare(a, b)


def _bounds(ids: DataFrame) -> list[int]:
    """Where the ranges of a column ``ord`` begin, by a sample; an id that fills several ranges is there several times."""
    rows = ids.count()
    n = min(MAX_RANGES, math.ceil(rows / RANGE_ROWS))
    if n < 2:
        return []
    share = SAMPLED * n / rows
    seen = np.sort((ids.sample(share, seed=42) if share < 1 else ids).toArrow()["ord"].to_numpy())
    return seen[np.arange(1, n) * len(seen) // n].tolist() if len(seen) else []


def _in_order(docs: DataFrame) -> DataFrame:
    """``docs`` dealt by ranges of the id and sorted, each range followed by the next one's first row.

    Columns bucket, extra (1 for that copy), doc_id, text. Rows that share an id follow each other by a hash
    of the text, and by the text. An id that fills several ranges is dealt to them by that hash. One shuffle of
    the texts; the bounds and the ranges' first rows, as id and hash, are all that the driver gets.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63))
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("ord"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("tie", F.xxhash64("text"))
    bounds = _bounds(slim.select("ord"))
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def passed(is_passed: Callable[[Column], Column]) -> Column:
        """How many of the bounds are passed, by binary search."""
        climb = lambda at, step: F.when((at + step <= len(bounds)) & is_passed(F.element_at(edges, F.least(at + step, F.lit(len(bounds))))), at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), climb) if bounds else F.lit(0)

    crowded = len(set(bounds)) < len(bounds)
    slim = slim.withColumn("bucket", passed(lambda edge: edge <= F.col("ord")))
    if crowded:  # as many ranges as bounds equal the id, by the upper half of the hash, so that they are in its order
        several = F.greatest(F.col("bucket") - passed(lambda edge: edge < F.col("ord")), F.lit(1))
        upper = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 32)
        slim = slim.withColumn("bucket", (F.col("bucket") - several + 1 + F.shiftright(upper * several, 32)).cast("int"))
    # Without crowded ids the texts needn't be read to find the first rows: a few copies too many do no harm.
    found = slim.groupBy("bucket").agg(F.min(F.struct("ord", F.col("tie") if crowded else F.lit(0).cast("long").alias("tie"))).alias("first"))
    firsts = found.select("bucket", "first.ord", "first.tie").orderBy("bucket").toArrow().to_pylist()
    follows = [(firsts[(i + 1) % len(firsts)], row["bucket"]) for i, row in enumerate(firsts)]
    heads = spark.createDataFrame([(row["bucket"], row["ord"], row["tie"], before) for row, before in follows], "bucket int, head long, head_tie long, before int")
    is_head = (slim["bucket"] == heads["bucket"]) & (F.col("ord") == F.col("head"))
    if crowded:
        is_head &= F.col("tie") == F.col("head_tie")
    places = F.array_compact(F.array(F.struct(slim["bucket"], F.lit(0).alias("extra")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra")))))
    dealt = slim.join(F.broadcast(heads), is_head, "left").select("ord", "tie", "doc_id", "text", F.explode(places).alias("place"))
    return (
        dealt.select("place.bucket", "place.extra", "ord", "tie", "doc_id", "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "extra", "ord", "tie", "text")
        .select("bucket", "extra", "doc_id", "text")
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs`` (doc_id, text) and of its edited text.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all)
    of the next document by ascending id; the last is followed by the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty, an
    empty fingerprint is the empty string, and two of those have likeness 1. Null ids come first, and
    rows that share an id follow each other by XXH64 (seed 42, signed) of the text. An empty table gives no rows, and a single
    document is followed by itself.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # id and text that the next row follows
        open_row: tuple | None = None  # a finished document that lacks its next one's fingerprint
        closed = None  # the range that is done; of several copied first rows one counts
        for batch in batches:
            out: list[tuple] = []
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if extra and bucket == closed:
                    continue
                if before is not None:
                    row = _edited(*before, text)
                    if open_row is not None:
                        out.append(_settled(open_row, row[3]))
                    open_row, before = row, None
                if extra:
                    out.append(_settled(open_row, fingerprint(text)))
                    open_row, closed = None, bucket
                else:
                    before = (doc_id, text)
            if out:
                yield _rows(out, batch.column(2).type)

    schema = docs.select("doc_id").schema.add("n_chars", "long")
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, "string")
    for name in ("near_edited", "near_next"):
        schema = schema.add(name, "double")
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return _in_order(docs).mapInArrow(compare, schema)


def _edited(doc_id: int, text: str, next_text: str) -> tuple:
    """Id, length, digest of the edited text, and the two fingerprints of a document."""
    n = len(text)
    kept, tail = n - n // 4, next_text[: n // 4]
    digest = hashlib.sha256((text[:kept] + tail).encode()).hexdigest()
    return (doc_id, n, digest, *fingerprint_pair(text, tail, kept))


def _settled(row: tuple, next_print: np.ndarray) -> tuple:
    doc_id, n, digest, own, edited = row
    return doc_id, n, digest, as_text(own), as_text(edited), likeness(own, edited), likeness(own, next_print)


def _rows(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
