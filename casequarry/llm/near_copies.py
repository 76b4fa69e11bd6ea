"""Near-copies by wide SimHashes: texts whose sets of word shingles have a Jaccard likeness of at least 0.8.

Three bits of 64 serve only texts that are all but equal; this likeness lies at 0.15 of the bits. So the same
SimHash is taken wider, from several mixes of the shingles' hashes, and cut into more segments:

1. multi-index hashing: in every segment a fingerprint enters the table under its own value and under each
   value that one more set bit makes, a ball of radius one; two that meet under a value differ there in at
   most two bits;
2. those that meet are verified on ``WORDS`` * 64 bits, which gives loose groups of texts;
3. inside the loose groups all are held against all, block by block, exactly on their sets of shingles.

Texts of one shingle set are one node, so copies are one lookup. Neither a table value nor a loose group gives
all its pairs: what leaves the worker that compares them is a spanning tree of the links, one row a text.
The segments grow with the logarithm of the number of documents, and their number with them, so that a
table value is shared by about as many unlike texts at any size and a pair at the likeness meets with a
probability of 0.99.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casequarry.llm.common import cut, fresh, hashable
from casequarry.llm.components import components
from casequarry.llm.simhash import SEED, majority, shingle_hashes

LIKENESS = 0.8
#: 64-bit words of a fingerprint that are compared when two meet, and bits that may differ. The likeness
#: lies at 19 of 128 bits, with a deviation of 4; texts that have nothing in common at 64, deviation 6.
WORDS, DISTANCE = 2, 28
#: Texts of a loose group that are held against each other at once.
BLOCK = 256
#: Lists of documents are broadcast up to so many rows; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 300_000


def layout(documents: int) -> tuple[int, int]:
    """Bits of a segment, and number of segments, for a table of so many documents."""
    bits = min(32, max(16, math.ceil(math.log2(max(2, documents))) - 2))
    apart = math.acos(2 * LIKENESS / (1 + LIKENESS)) / math.pi
    # of two differing bits, one has to be set on either side for the balls to meet
    meet = sum(share * math.comb(bits, n) * apart**n * (1 - apart) ** (bits - n) for n, share in ((0, 1), (1, 1), (2, 0.5)))
    return bits, math.ceil(math.log(0.01) / math.log(1 - meet))


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` numbers of 64 bits: the SimHash of the hashes, and of other mixes of them."""
    out = [majority(hashes)]
    for i in range(1, words):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        out.append(majority(mixed * np.uint64(0xD6E8FEB86659FD93)))
    return np.array(out, dtype=np.uint64)


def segments_of(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The fingerprint's first ``count`` segments of ``bits`` bits."""
    ones = np.unpackbits(words.astype(">u8").view(np.uint8))[: bits * count].reshape(count, bits)
    return ones @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, of (a hash of the text), text; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), text.cast("binary").alias("text"))


def signatures(docs: DataFrame, words: int, bits: int, count: int) -> DataFrame:
    """doc_id, of, node (a hash of the shingle set), print (WORDS longs) and segments of every text."""
    width = max(WORDS, -(-bits * count // 64))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, parts = [], [], []
            for text in batch.column("text"):
                hashes = np.unique(shingle_hashes(text.as_py(), words))
                wide = fingerprint(hashes, width)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                prints.append(wide[:WORDS].view(np.int64))
                parts.append(segments_of(wide, bits, count))
            columns = [batch.column("doc_id"), batch.column("of"), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "of", "node", "print", "segments"])

    return _keyed(docs).mapInArrow(compute, "doc_id long, of long, node long, print array<long>, segments array<long>")


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Pieces of a stream that is sorted by its first columns, each with all rows of the keys in it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        changed = np.zeros(part.num_rows, dtype=bool)
        for i in range(n_keys):
            values = part.column(i).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        last = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
        if last:
            yield part.slice(0, last)
        rest = part.slice(last)
    if rest is not None:
        yield rest


def bounds(table: pa.Table, n_keys: int) -> np.ndarray:
    """Where the keys of a sorted table begin, and its end."""
    changed = np.ones(table.num_rows + 1, dtype=bool)
    changed[1:-1] = False
    for i in range(n_keys):
        values = table.column(i).to_numpy()
        changed[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def spanning(n: int, near) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of 0 .. n-1; ``near(i, others)`` says which of ``others`` are linked to i."""
    waiting = np.arange(1, n)
    todo = [0]
    while True:
        while todo and len(waiting):
            i = todo.pop()
            hit = near(i, waiting)
            for j in waiting[hit]:
                yield i, int(j)
            todo.extend(waiting[hit].tolist())
            waiting = waiting[~hit]
        if not len(waiting):
            return
        todo, waiting = [int(waiting[0])], waiting[1:]


def loose_links(nodes: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) whose chains connect all ``nodes`` (node, print, segments) that meet and are close."""
    ball = f"filter(sequence(-1, {bits - 1}), i -> i < 0 OR shiftright(v, greatest(i, 0)) & 1 = 0)"
    keys = f"flatten(transform(segments, (v, s) -> transform({ball}, i -> shiftleft(cast(s AS bigint), 32) | v | CASE WHEN i < 0 THEN 0L ELSE shiftleft(1L, i) END)))"
    keyed = nodes.select(F.explode(F.expr(keys)).alias("key"), "node", *[F.col("print")[i].alias(f"w{i}") for i in range(WORDS)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            starts = bounds(table, 1)
            sizes = np.diff(starts)
            node = table.column(1).to_numpy()
            prints = np.stack([table.column(2 + i).to_numpy().view(np.uint64) for i in range(WORDS)], axis=1)
            out_a, out_b = [], []
            for start, size in zip(starts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                own = prints[start : start + size]
                if size <= 48:  # most: one comparison says that nothing is close
                    apart = np.bitwise_count(own[:, None, :] ^ own[None, :, :]).sum(axis=2)
                    if np.count_nonzero(apart <= DISTANCE) == size:
                        continue
                for i, j in spanning(size, lambda i, others: np.bitwise_count(own[others] ^ own[i]).sum(axis=1) <= DISTANCE):  # noqa: B023
                    out_a.append(node[start + i])
                    out_b.append(node[start + j])
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def _matches(sets: list[np.ndarray]) -> np.ndarray:
    """Whether each pair of sets has the likeness, as a matrix."""
    sizes = np.array([len(s) for s in sets])
    members, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, term, seen = np.unique(members, return_inverse=True, return_counts=True)
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    use = shared[term]
    owner, term = owner[use], number[term[use]]
    for start in range(0, int(shared.sum()), 4096):
        here = (term >= start) & (term < start + 4096)
        holds = np.zeros((len(sets), 4096), dtype=np.float32)
        holds[owner[here], term[here] - start] = 1
        common += holds @ holds.T
    np.fill_diagonal(common, sizes)
    return 9 * common >= 4 * (sizes[:, None] + sizes[None, :])  # in whole numbers: common / union >= 0.8


def exact_links(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """Links (a, b) whose chains connect all ``members`` (node, root, doc_id, of) of one root with the likeness."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    placed = members.join(sizes, "root").select("node", "root", "doc_id", "of", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks").cast("int"))
    placed = cut(placed)
    wanted = placed.select("node", "root", "block", "blocks", F.col("doc_id").alias("__id"), F.col("of").alias("__of"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    keyed = _keyed(docs)
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["of"] == F.col("__of"))).select("root", "block", "blocks", "node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.list_(pa.int64()))], names=["root", "block", "blocks", "node", "shingles"])

    sets = texts.mapInArrow(read, "root long, block int, blocks int, node long, shingles array<long>")
    # each block meets each other one, and itself where it is alone
    meets = "transform(filter(sequence(0, blocks - 1), i -> blocks = 1 OR i <> block), i -> named_struct('low', least(i, block), 'high', greatest(i, block)))"
    paired = sets.select("root", F.explode(F.expr(meets)).alias("m"), "node", "shingles").select("root", "m.low", "m.high", "node", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            out_a, out_b = [], []
            starts = bounds(table, 3)
            node, shingles = table.column("node").to_numpy(), table.column("shingles").combine_chunks()
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                names, first = np.unique(node[start:end], return_index=True)
                if len(names) < 2:
                    continue
                linked = _matches([shingles[start + int(i)].values.to_numpy() for i in first])
                for i, j in spanning(len(names), lambda i, others: linked[i, others]):  # noqa: B023
                    out_a.append(names[i])
                    out_b.append(names[j])
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    keys = ["root", "low", "high"]
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long").distinct()


def groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, of, rows, root of the distinct texts of ``docs`` (doc_id, text): texts of one root are near-copies.

    ``of`` is a hash of the text and rows how often that id has it. A null text is empty, and texts without
    a word are copies of each other. An empty table gives no rows.
    """
    bits, count = layout(docs.count())
    signed = cut(signatures(docs, words, bits, count))
    at = F.min(F.struct("doc_id", "of")).alias("at")
    nodes = cut(signed.groupBy("node").agg(at, F.first("print").alias("print"), F.first("segments").alias("segments")))
    loose = components(loose_links(nodes, bits))
    members = nodes.select("node", "at.doc_id", "at.of").join(loose, "node")
    tight = components(exact_links(docs, members, words)).withColumnRenamed("root", "near")
    keys = signed.groupBy("doc_id", "of", "node").agg(F.count("*").alias("rows"))
    return keys.join(tight, "node", "left").select("doc_id", "of", "rows", F.coalesce("near", "node").alias("root"))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) without near-copies: one row of each chain of them stays.

    It is the one with the smallest id, then the smallest hash of its text; rows without an id come last.
    Rows with different texts are told apart though they share an id. Of rows that share id and text one
    stays, chosen by a hash of all its columns.
    """
    found = cut(groups(docs, words))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of")
    kept = found.groupBy("root").agg(F.min(order).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("of") == F.col("best.of"))
    judged = cut(found.join(kept, "root").select("doc_id", "of", "rows", same.alias("stays")))
    id_, of, number = fresh(docs, "id", "of", "number")
    named = {"doc_id": id_, "of": of}

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select("doc_id", "of").withColumnsRenamed(named)
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        return df.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of)), how)

    left = among(docs, judged.where(~F.col("stays")), "left_anti")
    repeated = judged.where(F.col("stays") & (F.col("rows") > 1))
    if repeated.isEmpty():
        return left
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*hashable(docs)))
    once = among(left, repeated, "left_semi").withColumn(number, F.row_number().over(again)).where(F.col(number) == 1).drop(number)
    return among(left, repeated, "left_anti").unionByName(once)
