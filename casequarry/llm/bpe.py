"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until its parts are short; a short part is encoded directly, and the encodings of
two neighbours are joined by encoding a window around their border anew. The window grows outwards
until both its ends are places where every parse of the pre-tokenizer pattern must cut:

* after a letter that no letter follows, after a number that no number follows, and
* after anything but white space where white space follows.

No piece of the pattern spans such a place, and whether it cuts there depends on the two characters
beside it alone, so all tokens outside the window are provably those of the whole text. Where a text
has no such place, the window grows to the whole of both parts, and the result is exact again.

Decoding concatenates the bytes of neighbouring parts up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry.llm.common import columns_of, fresh

LEAF_CHARS = 1024
LEAF_IDS = 4096
#: Encoded rows leave a worker after about so many ids, so its memory doesn't grow with its batches.
FLUSH_IDS = 1 << 20

#: White space that a cut before it may rely on; others only make a window longer.
PLAIN_SPACE = " \t\n\r"


@lru_cache(maxsize=1 << 14)
def _kind(char: str) -> str:
    """L, N, blank for white space and the like, or X for anything else visible."""
    category = unicodedata.category(char)[0]
    return category if category in "LN" else "X" if category in "PSM" else " "


def must_cut(left: str, right: str) -> bool:
    """Whether every parse cuts between these two neighbouring characters."""
    kind = _kind(left)
    if kind in "LN":
        return _kind(right) != kind
    return kind == "X" and right in PLAIN_SPACE


class Codec:
    """Encoder and decoder of one vocabulary: ranks as lines of base64 token and rank, and a pattern."""

    def __init__(self, vocabulary: bytes, pattern: str, leaf_chars: int = LEAF_CHARS):
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self._leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._lengths = [0] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self._lengths[rank] = len(token)
        self.leaf_chars = leaf_chars

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self._leaf.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._span(text, start, middle), self._span(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[start:end] from those of text[start:middle] and text[middle:end]."""
        first = last = middle
        if not must_cut(text[middle - 1], text[middle]):
            first, last = middle - 1, middle + 1
            while first > start and not must_cut(text[first - 1], text[first]):
                first -= 1
            while last < end and not must_cut(text[last - 1], text[last]):
                last += 1
            self._drop_last(left, len(text[first:middle].encode()))
            left += self._leaf.encode_ordinary(text[first:last])
        left += right[self._covering(right, len(text[middle:last].encode())) :]
        return left

    def _drop_last(self, ids: list[int], size: int) -> None:
        while size > 0:
            size -= self._lengths[ids.pop()]
        if size:
            raise AssertionError("a token spans a place where every parse cuts")

    def _covering(self, ids: list[int], size: int) -> int:
        count = 0
        while size > 0:
            size -= self._lengths[ids[count]]
            count += 1
        if size:
            raise AssertionError("a token spans a place where every parse cuts")
        return count

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, neighbours concatenated up the tree."""
        parts = [self._leaf.decode_bytes(ids[i : i + LEAF_IDS]) for i in range(0, len(ids), LEAF_IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


_CODECS: dict[tuple[int, str, int], Codec] = {}


def _codec(vocabulary: bytes, pattern: str, leaf_chars: int) -> Codec:
    """One codec for each vocabulary in a Python worker, which serves many tasks."""
    key = (hash(vocabulary), pattern, leaf_chars)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary, pattern, leaf_chars)
    return _CODECS[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``tokens`` array<int>: the ids of the whole ``text``.

    A null or empty text has no tokens. No special tokens are made: their strings are ordinary text.
    Rows and repeats stay as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    (text,) = fresh(docs, "text")
    slim = docs.select(*columns_of(list(keep)), F.col("text").cast("binary").alias(text))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, leaf_chars)
        for batch in batches:
            first, offsets, parts = 0, [0], []
            for i, value in enumerate(batch.column(len(keep)), 1):
                ids = codec.encode(_text(value.as_py()))
                parts.append(np.array(ids, dtype=np.int32))
                offsets.append(offsets[-1] + len(ids))
                if offsets[-1] >= FLUSH_IDS or i == batch.num_rows:
                    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)))
                    kept = batch.slice(first, i - first).columns[: len(keep)]
                    yield pa.RecordBatch.from_arrays([*kept, tokens], names=[*keep, "tokens"])
                    first, offsets, parts = i, [0], []

    schema = slim.drop(text).schema.add("tokens", T.ArrayType(T.IntegerType()))
    return slim.mapInArrow(encode, schema)


def decode_documents(tokens: DataFrame, vocabulary: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``tokens`` and ``decoded`` binary: the bytes of ``tokens``; null is empty."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    slim = tokens.select(*columns_of(list(keep)), "tokens")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, LEAF_CHARS)
        for batch in batches:
            texts = pa.array((codec.decode(ids.as_py() or []) for ids in batch.column(len(keep))), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, "decoded"])

    return slim.mapInArrow(decode, slim.drop("tokens").schema.add("decoded", "binary"))


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Digests of encoding and decoding every whole text of ``docs`` (doc_id, text), in one pass.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the
    decoded bytes). A null text is empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, leaf_chars)
        names = [str(i) for i in range(len(codec._lengths))]
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for value in batch.column(1):
                ids = codec.encode(_text(value.as_py()))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = slim.drop("text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return slim.mapInArrow(digest, schema)
