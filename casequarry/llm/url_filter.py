"""URL filters: a blocked Bloom filter in front of an exact hash join.

A listed entry is canonical: ``host/path-prefix`` with a lower-case host. A url is looked up under
every parent domain of its host and every prefix of its path that is as long as some entry's path,
so one set of keys serves listed pages, directories, sites and whole top-level domains. The Bloom
filter passes the keys that may be listed; the join with the list itself decides, so false
positives cost a little work and change nothing.

The filter is a row of 64-byte blocks, and all bits of a key lie in one block, so a lookup touches
one cache line. It is built by the executors in shares, ranges of blocks. A filter of few shares is
broadcast; of a longer one, no place ever holds more than a share: keys are dealt to the shares that
their blocks lie in, and each task reads a share and then its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.llm.common import columns_of

BLOCK_BITS = 512
HASHES = 8
BITS_PER_KEY = 16
#: Above this many bytes the filter is not broadcast but dealt out with the keys.
MAX_FILTER_BYTES = 64 << 20
#: Blocks of a share: 256 KB.
SHARE_BLOCKS = 4096


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substr(url, at + F.lit(3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    plain = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, plain).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.substr(url, at + F.lit(3))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def parents(host: Column) -> Column:
    """The host and every domain above it: ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def lookup_keys(host: Column, path: Column, lengths: Column) -> Column:
    """All keys under which a url can be listed; ``lengths`` are the listed paths' lengths."""
    fitting = F.filter(lengths, lambda n: n <= F.length(path))
    return F.flatten(F.transform(parents(host), lambda h: F.transform(fitting, lambda n: F.concat(h, F.lit("\n"), F.substr(path, F.lit(1), n)))))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its HASHES bits within the block, from one 64-bit hash."""
    h = hashes.astype(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    odd = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)
    low = (h & np.uint64(0xFFFFFFFF))[:, None] * odd[None, :]
    return block.astype(np.int64), ((low & np.uint64(0xFFFFFFFF)) >> np.uint64(23)).astype(np.int64)


def might_hold(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, bit = _bits(hashes, len(filter_bytes))
    return ((filter_bytes[block[:, None], bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(axis=1)


def share_of(hashes: Column, blocks: int) -> Column:
    """The share in which the block of a hash lies."""
    return F.floor((F.shiftrightunsigned(hashes, 32) % F.lit(blocks)) / F.lit(SHARE_BLOCKS))


def filter_shares(keys: DataFrame, blocks: int) -> DataFrame:
    """share, bits: a blocked Bloom filter of the column ``key``, one row a share that holds a key.

    Keys may repeat; a null key is left out; without keys there is no row.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, share = pdf["hash"].to_numpy().view(np.uint64), int(pdf["share"].iloc[0])
        block, bit = _bits(hashes, blocks)
        bits = np.zeros((SHARE_BLOCKS, BLOCK_BITS), dtype=bool)
        bits[(block - share * SHARE_BLOCKS)[:, None], bit] = True
        return pd.DataFrame({"share": [share], "bits": [np.packbits(bits, axis=1, bitorder="little").tobytes()]})

    hashed = keys.where("key IS NOT NULL").select(F.xxhash64("key").alias("hash")).distinct()
    return hashed.withColumn("share", share_of(F.col("hash"), blocks)).groupBy("share").applyInPandas(fill, "share long, bits binary")


def build_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """The whole filter as rows of bytes, for lists whose filter may be broadcast."""
    blocks = blocks_for(n_keys)
    out = np.zeros((-(-blocks // SHARE_BLOCKS) * SHARE_BLOCKS, BLOCK_BITS // 8), dtype=np.uint8)
    for row in filter_shares(keys, blocks).toLocalIterator():
        out[row["share"] * SHARE_BLOCKS : (row["share"] + 1) * SHARE_BLOCKS] = np.frombuffer(row["bits"], dtype=np.uint8).reshape(SHARE_BLOCKS, -1)
    return out[:blocks]


def blocks_for(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))


def dealt_hits(keyed: DataFrame, entries: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``keyed`` whose key the filter may hold, without the whole filter in any place.

    Shares and keys are dealt by share and sorted, each share before its keys, and read one after the other.
    """
    hashed = keyed.withColumns({"__hash": F.xxhash64("key")}).withColumn("__share", share_of(F.col("__hash"), blocks))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema]
    shares = filter_shares(entries, blocks).select(*nothing, F.lit(0).cast("long").alias("__hash"), F.col("share").alias("__share"), "bits")
    both = hashed.select(*columns_of(keyed.columns), "__hash", "__share", F.lit(None).cast("binary").alias("bits")).unionByName(shares)
    both = both.withColumn("__key", F.col("bits").isNull())

    columns = keyed.columns

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, None
        for batch in batches:
            share, hashes, held = batch.column("__share").to_numpy(), batch.column("__hash").to_numpy().view(np.uint64), batch.column("bits")
            keep = np.zeros(batch.num_rows, dtype=bool)
            begins = np.flatnonzero(np.diff(share, prepend=-1))
            for start, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                if share[start] != at:
                    at, bits = share[start], None
                if held[int(start)].is_valid:
                    bits = np.frombuffer(held[int(start)].as_py(), dtype=np.uint8).reshape(SHARE_BLOCKS, -1)
                    start += 1
                if bits is not None and start < end:
                    block, bit = _bits(hashes[start:end], blocks)
                    row = (block - int(at) * SHARE_BLOCKS)[:, None]
                    keep[start:end] = ((bits[row, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(axis=1)
            yield batch.select(columns).filter(pa.array(keep))

    sorted_ = both.repartition("__share").sortWithinPartitions("__share", "__key")
    return sorted_.mapInArrow(pass_on, keyed.schema)


def listed_hits(keyed: DataFrame, entries: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Rows of ``keyed`` (a column ``key``) joined with the ``entries`` of that key.

    The filter drops keys that are surely not listed before the join: null keys, and all keys of an empty
    list, go there too. Rows that repeat are joined each.
    """
    n_keys = entries.count()
    blocks = blocks_for(n_keys)
    if blocks * BLOCK_BITS // 8 > max_filter_bytes:
        return dealt_hits(keyed, entries, blocks).join(entries, "key")
    shared = keyed.sparkSession.sparkContext.broadcast(build_filter(entries, n_keys))

    @F.pandas_udf("boolean")
    def possible(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = shared.value
        for part in hashes:
            yield pd.Series(might_hold(bits, part.to_numpy().view(np.uint64)))

    return keyed.where(F.col("key").isNotNull() & possible(F.xxhash64("key"))).join(entries, "key")


def judge(pages: DataFrame, rules: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES, default: str = "allow") -> DataFrame:
    """A verdict for every url of ``pages`` (page_id, url) under ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with its path; the longest rule
    (host and path together) wins, and ``default`` is the verdict where none fits. Returns page_id,
    host, path, rule (``host`` + ``path``, or null), verdict. A null url, or one without ``://``, has an
    empty host and path and fits no rule; repeated rows are judged each; page ids may be null. Rules
    with a null host, path or verdict are left out; of rules given twice, ``block`` wins.
    """
    entries = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.concat("host", F.lit("\n"), "path").alias("key"), F.concat("host", "path").alias("rule"))
        .agg(F.max("verdict").alias("rule_verdict"))
    )
    lengths = [row[0] for row in rules.where("path IS NOT NULL").select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    parsed = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # the distinct (host, path) pairs are looked up, so that a much repeated url is looked up once
    places = parsed.select("host", "path").distinct()
    keyed = places.select("host", "path", F.explode(lookup_keys(F.col("host"), F.col("path"), F.array(*map(F.lit, lengths)))).alias("key"))
    hits = listed_hits(keyed, entries, max_filter_bytes)
    longest = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("won"))
    return parsed.join(longest, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict")
    )
