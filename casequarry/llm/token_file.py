"""Token ids in binary files, packed by Simple-8b.

A 64-bit word holds a selector in its upper 4 bits and as many ids as fit the rest at that selector's width:
from 120 zeros, or 60 ids of one bit, to one id of 60 bits; always as many as the next ids allow. The escape,
selector 0, is a word by itself and says that the next word is one id of more than 60 bits as it is. A
document's ids are cut into blocks of ``BLOCK`` ids, each of which begins with a word of its own, so that with the
words' number of every block a reader finds any block and decodes many at once in numpy.

A file, whose numbers are little-endian 64-bit integers:

    magic, then the words of its documents in ascending order of their ids,
    each document's id, whether it has one, its number of ids, each block's number of words,
    and a tail of: number of documents, of blocks, of words, magic.

Documents are encoded where they are read, dealt by ranges of their ids as packed words, sorted, and written
by each task as it goes. A task that is run again writes under other names, and only what the table of files
(Parquet, ``files``) names counts, so nothing is lost or counted twice when executors are.
"""

from __future__ import annotations

import functools
import math
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many ids a word holds, and of how many bits, by selector; 0 is the escape. Fixed values.
COUNTS = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 4096
MAGIC = b"S8BTOKEN"

#: About so many documents lie in a range, of which there are at most MAX_RANGES; beyond that ranges grow.
RANGE_ROWS = 4096
MAX_RANGES = 100_000
#: Ids that are looked at to lay a range's bounds.
SAMPLED = 20
#: A task begins another file beyond so many words (128 MB).
FILE_WORDS = 1 << 24
#: About so many bytes of texts are encoded at once.
TEXT_BYTES = 6_000_000
#: Parts of text whose ids a task remembers in a generation, and their greatest length.
KNOWN_PARTS, KNOWN_LENGTH = 300_000, 40
#: Parts of what holds nothing but Latin letters (of one code point each), digits and ASCII marks; all parts, line ends among them.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
PARTS = re.compile(PLAIN.pattern + r"|\n|[^\n]")
#: What stands for the end of a piece and for a part that isn't plain among ids; no token has these.
STOP, ODD = b"\xff\xff\xff\xff", b"\xfe\xff\xff\xff"


def _widths(ids: np.ndarray) -> np.ndarray:
    """Number of bits of each id; 0 for 0."""
    widths, wide = np.frexp(ids.astype(np.float64))[1], ids >= np.uint64(1 << 53)
    if wide.any():  # a double might have rounded these up to the next power of 2
        widths[wide] = 32 + np.frexp((ids[wide] >> np.uint64(32)).astype(np.float64))[1]
    return widths


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of ``ids`` in blocks of the given sizes, and each block's number of words."""
    ids, n = ids.astype(np.uint64, copy=False), len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    here = np.arange(n)
    left, widths = ends - here, _widths(ids)
    least, most = int(widths.min()), int(widths.max())
    chosen = np.zeros(n, np.int8)
    for selector in range(len(COUNTS) - 1, 0, -1):
        if BITS[selector] < least:
            break
        if BITS[selector] >= most:
            run = left
        else:
            stops = np.where(widths > BITS[selector], here, n)
            run = np.minimum.accumulate(stops[::-1])[::-1] - here
        chosen[run >= np.minimum(COUNTS[selector], left)] = selector
    steps = np.minimum(np.maximum(COUNTS[chosen], 1), left).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts)
    selectors = chosen[first]
    taken = 1 + (selectors == 0)
    places = np.cumsum(taken) - taken
    words = np.zeros(int(taken.sum()), np.uint64)
    for selector in np.unique(selectors).tolist():
        mine = first[selectors == selector]
        where = places[selectors == selector]
        if selector == 0:
            words[where + 1] = ids[mine]
            continue
        packed = np.full(len(mine), np.uint64(selector) << np.uint64(60))
        for i in range(int(COUNTS[selector]) if BITS[selector] else 0):
            inside = mine + i < ends[mine]
            packed[inside] |= ids[mine[inside] + i] << np.uint64(i * BITS[selector])
        words[where] = packed
    blocks = np.repeat(np.arange(len(sizes)), sizes)[first]
    return words, np.bincount(blocks, weights=taken, minlength=len(sizes)).astype(np.int64)


def unpack(words: np.ndarray, block_words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids (uint64) of blocks that are made of so many words and hold so many ids."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # a raw word has one of its upper bits set, so it is no escape itself
    raw = np.concatenate([[False], selectors[:-1] == 0])
    counts = np.where(raw, 1, COUNTS[selectors])
    offsets = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    out[offsets[raw]] = words[raw]
    for selector in np.unique(selectors[~raw]).tolist():
        if selector and BITS[selector]:
            mine = (selectors == selector) & ~raw
            shifts = (np.arange(COUNTS[selector]) * BITS[selector]).astype(np.uint64)
            out[offsets[mine][:, None] + np.arange(COUNTS[selector])] = words[mine][:, None] >> shifts & np.uint64((1 << int(BITS[selector])) - 1)
    begin = offsets[np.cumsum(block_words) - block_words]
    sizes = np.asarray(sizes, np.int64)
    return out[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def block_sizes(lengths: np.ndarray) -> np.ndarray:
    """Sizes of the blocks of documents of these lengths, one after the other; a document without ids has none."""
    blocks = -(-lengths // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK, np.int64)
    last = np.cumsum(blocks)[blocks > 0] - 1
    sizes[last] = (lengths - (blocks - 1) * BLOCK)[blocks > 0]
    return sizes


@functools.lru_cache(maxsize=1)
def word_encoder(path: str, end: int | None) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to their ids (uint32), one text after the other, and the number of ids of each.

    ``path`` is a tokenizer file; ``end``, if given, follows every text. For tokenizers that drop white space, lower the
    case, and part letters, digits and marks before they merge, as those of ``word_bpe`` do: then a text's ids are those
    of its pieces between ASCII white space, one after the other, and those of a piece of Latin letters, digits and ASCII
    marks are those of its parts. So the distinct pieces of many texts are looked up, and their ids gathered by numpy.
    What the library encoded is remembered, in two generations so that what comes often outlasts what came once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), _Known()
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True

    def singly(texts: list[str]) -> list[bytes]:
        return [np.array(encoding.ids, "<u4").tobytes() for encoding in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(parts: list[str]) -> list[bytes]:
        """Ids of each part by one call; where a part ends, a token ends a word."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(stops) != len(parts) or stops[-1] != 4 * len(ids):
            return singly(parts)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def of_pieces(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin and how many they are."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "\n")[0]
        parts = PARTS.findall(joined.as_buffer().to_pybytes().decode(errors="replace").lower() + "\n" * (len(pieces) > 0))
        fresh = known.missing(set(parts))
        plain = [part for part in fresh if PLAIN.fullmatch(part) and "<|" not in part]
        if plain:
            known.new.update(zip(plain, each(plain), strict=True))
        known.new.update(dict.fromkeys(fresh.difference(plain), ODD))
        known.new["\n"] = STOP
        every = np.frombuffer(b"".join(map(known.new.__getitem__, parts)), "<u4")
        known.age()
        stops = np.flatnonzero(every == int.from_bytes(STOP, "little"))
        starts = np.concatenate([[0], stops[:-1] + 1])
        sizes = stops - starts
        odd = np.unique(np.searchsorted(stops, np.flatnonzero(every == int.from_bytes(ODD, "little"))))
        if len(odd):
            whole = singly([piece.decode(errors="replace") for piece in pieces.take(odd).cast(pa.binary()).to_pylist()])
            lengths = np.array([len(ids) // 4 for ids in whole])
            starts[odd], sizes[odd] = len(every) + np.cumsum(lengths) - lengths, lengths
            every = np.concatenate([every, np.frombuffer(b"".join(whole), "<u4")])
        return every, starts, sizes

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        every, starts, sizes = of_pieces(coded.dictionary)
        codes = coded.indices.to_numpy()
        taken = sizes[codes]
        stops = np.cumsum(taken)
        ids = every[np.repeat(starts[codes] - (stops - taken), taken) + np.arange(int(taken.sum()))]
        text_stops = np.concatenate([[0], stops])[np.cumsum(pc.list_value_length(split).to_numpy())]
        lengths = np.diff(text_stops, prepend=0)
        if end is not None:
            ids, lengths = np.insert(ids, text_stops, end), lengths + 1
        return ids, lengths

    return encode


class _Known:
    """Ids by part of text, in two generations: of the older one, what is asked for again is kept."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, parts: set[str]) -> set[str]:
        """Of some parts, those that aren't known; the others are in ``new`` now."""
        away = parts.difference(self.new)
        if away and self.old:
            again = {part for part in away if part in self.old}
            self.new.update((part, self.old[part]) for part in again)
            away -= again
        return away

    def age(self) -> None:
        if len(self.new) > KNOWN_PARTS:
            self.old, self.new = {part: ids for part, ids in self.new.items() if len(part) <= KNOWN_LENGTH}, {}


def location(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and path; local paths, file:, s3a: and whatever else pyarrow can open."""
    folder = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", folder))
    return fs.FileSystem.from_uri(folder)


def ranged(slim: DataFrame) -> tuple[DataFrame, int]:
    """``slim`` (ord, tie: longs) with bucket, the range of its order by ord, then tie, and the number of ranges.

    Bounds are sampled ids. An ord that fills several ranges is dealt to them by the upper half of tie, a hash.
    """
    rows = slim.count()
    n = max(1, min(MAX_RANGES, math.ceil(rows / RANGE_ROWS)))
    share = SAMPLED * n / max(rows, 1)
    seen = np.sort((slim.select("ord").sample(share, seed=42) if share < 1 else slim.select("ord")).toArrow()["ord"].to_numpy())
    bounds = seen[np.arange(1, n) * len(seen) // n].tolist() if len(seen) else []
    if not bounds:
        return slim.withColumn("bucket", F.lit(0)), 1
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def passed(is_passed: Callable[[Column], Column]) -> Column:
        """How many of the bounds are passed, by binary search."""
        climb = lambda at, step: F.when((at + step <= len(bounds)) & is_passed(F.element_at(edges, F.least(at + step, F.lit(len(bounds))))), at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), climb)

    bucket = passed(lambda edge: edge <= F.col("ord"))
    if len(set(bounds)) < len(bounds):
        several = F.greatest(bucket - passed(lambda edge: edge < F.col("ord")), F.lit(1))
        upper = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 32)
        bucket = bucket - several + 1 + F.shiftright(upper * several, 32).cast("int")
    return slim.withColumn("bucket", bucket.cast("int")), len(bounds) + 1


_PACKED = "bucket int, ord long, tie long, doc_id long, n long, words binary, block_words binary"
_FILES = "bucket int, part int, file string, docs long, ids long, bytes long, before long"


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id, text) below ``folder``, in ascending order of doc_id.

    ``tokenizer`` is a file of the tokenizers library that every executor has; no special tokens are added, and
    ``end`` follows every document. A null text is empty; a null id comes first; rows that repeat an id follow each
    other by XXH64 of their texts; an empty table makes an empty table of files. ``folder`` has to be
    one that the driver and all executors share.
    """
    lowest = F.lit(-(1 << 63))  # stands for null; an id this small counts as the next
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.select(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.greatest("doc_id", lowest + 1)), lowest).alias("ord"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    dealt, n = ranged(slim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, end)
        for batch in batches:
            texts = batch.column(4)
            bytes_before = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(bytes_before, (bytes_before[at - 1] if at else 0) + TEXT_BYTES, side="right")))
                ids, lengths = encoder(texts.slice(at, to - at))
                sizes, blocks = block_sizes(lengths), -(-lengths // BLOCK)
                words, counts = pack(ids, sizes)
                of = np.repeat(np.arange(len(lengths)), blocks)
                word_ends = np.cumsum(np.bincount(of, weights=counts, minlength=len(lengths)).astype(np.int64))
                block_ends = np.cumsum(blocks)
                piece = lambda data, ends: pa.array([data[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
                kept = [batch.column(i).slice(at, to - at) for i in range(4)]
                at = to
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths), piece(words, word_ends), piece(counts, block_ends)], names=["bucket", "ord", "tie", "doc_id", "n", "words", "block_words"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = location(folder)
        bucket, part, before, file = None, 0, 0, None
        rows = []
        for batch in batches:
            columns = [batch.column(name) for name in ("bucket", "doc_id", "n", "words", "block_words")]
            for row in range(len(batch)):
                of, doc_id, ids, words, counts = (c[row] for c in columns)
                if file is not None and (of.as_py() != bucket or file.words >= FILE_WORDS):
                    rows.append(file.close(bucket, part, before))
                    part, before, file = part + 1, before + rows[-1][4], None
                if of.as_py() != bucket:
                    bucket, part, before = of.as_py(), 0, 0
                file = file or _Writer(system, path, f"{bucket:06d}-{part:04d}-{uuid.uuid4().hex}.s8b")
                file.add(doc_id.as_py(), ids.as_py(), words.as_buffer(), counts.as_buffer())
        if file is not None:
            rows.append(file.close(bucket, part, before))
        if rows:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "part", "file", "docs", "ids", "bytes", "before"])

    system, path = location(folder)
    system.create_dir(path, recursive=True)
    packed = dealt.select("bucket", "ord", "tie", "doc_id", "text").mapInArrow(encode, _PACKED)
    ordered = packed.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ord", "doc_id", "tie", "n")
    ordered.mapInArrow(save, _FILES).write.parquet(f"{folder}/files")


class _Writer:
    """One file, written as documents come; what stands behind their words is kept until the end."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str):
        self.name, self.words, self.ids = name, 0, 0
        self.docs: list[tuple[int, int, int]] = []
        self.counts: list[bytes] = []
        self.out = system.open_output_stream(f"{folder}/{name}")
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, n: int, words: pa.Buffer, counts: pa.Buffer) -> None:
        self.out.write(words)
        self.docs.append((doc_id or 0, doc_id is not None, n))
        self.counts.append(counts.to_pybytes())
        self.words += len(words) // 8
        self.ids += n

    def close(self, bucket: int, part: int, before: int) -> tuple:
        counts = b"".join(self.counts)
        self.out.write(np.array(self.docs, "<i8").T.tobytes() + counts)
        self.out.write(np.array([len(self.docs), len(counts) // 8, self.words], "<i8").tobytes() + MAGIC)
        size = self.out.tell()
        self.out.close()
        return bucket, part, self.name, len(self.docs), self.ids, size, before


def documents(file: pa.NativeFile, size: int, piece: int = 1 << 20) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """The documents of a file of so many bytes: ids of documents, their lengths, and their token ids one after the other.

    About ``piece`` words at a time; a document is never divided between two pieces.
    """
    file.seek(size - 32)
    tail = file.read(32)
    if tail[24:] != MAGIC:
        raise ValueError("not a whole file of token ids")
    docs, blocks, words = np.frombuffer(tail[:24], "<i8").tolist()
    file.seek(8 + 8 * words)
    ids, known, lengths = np.frombuffer(file.read(24 * docs), "<i8").reshape(3, docs)
    counts = np.frombuffer(file.read(8 * blocks), "<i8")
    sizes, block_ends = block_sizes(lengths), np.cumsum(-(-lengths // BLOCK))
    word_ends = np.concatenate([[0], np.cumsum(counts)])[block_ends]
    file.seek(8)
    at = block = word = 0
    while at < docs:
        to = max(at + 1, int(np.searchsorted(word_ends, word + piece, side="right")))
        mine = slice(block, int(block_ends[to - 1]))
        data = np.frombuffer(file.read(8 * int(word_ends[to - 1] - word)), "<u8")
        names = [int(i) if k else None for i, k in zip(ids[at:to], known[at:to], strict=True)]
        yield names, lengths[at:to], unpack(data, counts[mine], sizes[mine])
        at, block, word = to, mine.stop, int(word_ends[to - 1])


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files below ``folder``: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` their ids.

    ``start`` is the number of ids of all documents before one, and ``ids_crc32`` the unsigned CRC-32 of its ids
    as little-endian unsigned 32-bit integers. The driver gets one total a range, of which there are at most
    MAX_RANGES; each file is read by one task, a piece at a time.
    """
    files = spark.read.parquet(f"{folder}/files")
    totals = files.groupBy("bucket").agg(F.sum("ids").alias("ids"), F.count("*").alias("files")).toArrow().sort_by("bucket")
    ids = totals["ids"].to_numpy()
    starts = pa.table({"bucket": totals["bucket"], "range_start": pa.array(np.cumsum(ids) - ids, pa.int64())})
    placed = files.join(F.broadcast(spark.createDataFrame(starts)), "bucket").select("file", "bytes", (F.col("range_start") + F.col("before")).alias("start"))
    many = max(1, min(MAX_RANGES, int(totals["files"].to_numpy().sum())))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = location(folder)
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{path}/{name}") as file:
                    for doc_ids, lengths, tokens in documents(file, size):
                        ends = np.cumsum(lengths)
                        narrow = tokens.astype("<u4")
                        parts = [narrow[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                        columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns, names = [*columns, pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        start += int(ends[-1])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return placed.repartition(many).mapInArrow(load, schema)
