"""The nearest vectors of every query: exact, without scoring what can't be among them.

Vectors have length 1, so angles obey the triangle inequality: a row at angle r from a pivot and a query at
angle q from it are at least |q - r| apart. Rows are put into groups (the nearest pivot, and a ring of angles about
it), and a group is passed over if its nearest possible row can't reach a query's k-th score so far. A query first
meets the groups that promise most, until they hold some rows, which gives it that score; then the rest.
In a pair of blocks, products in single precision with room for what these may be off by bound a score from above,
and only what the bound lets through is scored in whole.

Equal vectors are one query, and no more of them than could be found are candidates, so copies cost no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casequarry.session import met, shares, written

#: Rows that the pivots and axes are fitted to, the first by a hash of the id: they steer what is passed over, not what is found.
SAMPLE = 4096
MAX_PIVOTS = 1024
RINGS = 4
#: Rows of a group, about, as far as the pivots go: a query is sent to every group that it has to meet.
GROUP_ROWS = 1024
#: Rows of a block, about, and queries that a task deals with at a time.
BLOCK_ROWS = 4096
QUERY_ROWS = 256
#: Queries with their groups that a task holds before it gives them out.
HELD_ROWS = 16_384
#: Rows of a share of blocks, at most.
SHARE_ROWS = 65_536
#: What sums of products may be off by.
SLACK = 1e-9


@dataclass(frozen=True)
class Space:
    """Principal axes, pivots along them and the bounds of rings: a table of fixed size for the tasks."""

    axes: np.ndarray
    pivots: np.ndarray
    rings: np.ndarray

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1.0, 1.0))


@dataclass(frozen=True)
class Groups:
    """The groups that have rows: pivot, smallest and largest angle, rows, and into how many blocks they are dealt."""

    group: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray

    def bounds(self, angles: np.ndarray) -> np.ndarray:
        """The most that a row of each group can score with queries at ``angles`` from the pivots."""
        at = angles[:, self.pivot]
        return np.cos(np.maximum(0.0, np.maximum(at - self.high, self.low - at)))


def fitted(sample: np.ndarray, n_pivots: int, n_rings: int = RINGS, rounds: int = 5) -> Space:
    """Axes by the sample's second moments, pivots by a few rounds of means, rings by quantiles of the angles."""
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    x = sample @ axes
    pivots = x[: max(1, min(n_pivots, len(x)))]
    for _ in range(rounds):
        near = (x @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > SLACK, sums / np.maximum(length, SLACK), pivots)
    space = Space(axes, pivots, np.zeros(0))
    return Space(axes, pivots, np.quantile(space.angles(x).min(axis=1), np.arange(1, n_rings) / n_rings))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def _usable(dims: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            part = whole.filter(pc.and_(pc.is_valid(whole["id"]), pc.fill_null(pc.equal(pc.list_value_length(whole["vector"]), dims), False)))
            x = _matrix(part["vector"], dims).astype(float)
            most = np.abs(x).max(axis=1, initial=0.0)
            fine = np.isfinite(most) & (most > 0)
            x = x[fine] / most[fine, None]
            x = x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0
            keys = [hashlib.md5(row.tobytes()).hexdigest() for row in x]
            yield pa.RecordBatch.from_arrays([part["id"].filter(pa.array(fine)), _lists(x), pa.array(keys, pa.string())], ["id", "vector", "key"])

    return run


def usable(df: DataFrame, dims: int) -> DataFrame:
    """id, vector of length 1, and a key that equal vectors share; without ids or vectors that are null, of
    another size, of length 0, or not finite."""
    slim = df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return slim.mapInArrow(_usable(dims), "id long, vector array<double>, key string")


def _placed(space: Space, dims: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                part = whole.slice(start, BLOCK_ROWS)
                x = _matrix(part["vector"], dims) @ space.axes
                angles = space.angles(x)
                pivot = angles.argmin(axis=1)
                angle = angles[np.arange(len(x)), pivot]
                group = pivot * (len(space.rings) + 1) + np.searchsorted(space.rings, angle)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(group.astype(np.int32)), pa.array(angle), _lists(x)], ["id", "group", "angle", "vector"])

    return run


def _asked(space: Space, groups: Groups, dims: int, enough: int):
    """Queries along the axes, with the groups that they meet first: those that promise most, till they hold ``enough`` rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                part = whole.slice(start, QUERY_ROWS)
                x = _matrix(part["vector"], dims) @ space.axes
                angles = space.angles(x)
                # Every group has a row, so there are never more groups to meet than rows wanted.
                promise = groups.bounds(angles) - 1e-3 * angles[:, groups.pivot]
                order = np.argpartition(-promise, min(enough, len(groups.group)) - 1, axis=1)[:, :enough]
                order = np.take_along_axis(order, np.argsort(-np.take_along_axis(promise, order, axis=1), axis=1, kind="stable"), axis=1)
                before = np.cumsum(groups.rows[order], axis=1) - groups.rows[order]
                early = [groups.group[o[b < enough]].tolist() for o, b in zip(order, before, strict=True)]
                yield pa.RecordBatch.from_arrays([part["key"], _lists(x), pa.array(early, pa.list_(pa.int32()))], ["key", "vector", "early"])

    return run


def _dealt(space: Space, groups: Groups, dims: int):
    """Queries packed by the groups that they meet first."""
    names = ["group", "blocks", "keys", "floors", "queries"]

    def packs(waiting: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for g, pieces in waiting.items():
            keys, floors, x = (np.concatenate(p) for p in zip(*pieces, strict=True))
            for start in range(0, len(keys), QUERY_ROWS):
                cut = slice(start, start + QUERY_ROWS)
                columns = [[int(groups.group[g])], [int(groups.blocks[g])], [keys[cut].tolist()], [floors[cut]], [x[cut].ravel()]]
                types = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        held = 0
        for whole in parts:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                part = whole.slice(start, QUERY_ROWS)
                x, keys = _matrix(part["vector"], dims), part["key"].to_numpy(zero_copy_only=False)
                floors = part["floor"].to_numpy(zero_copy_only=False)
                early = np.zeros((len(x), len(groups.group)), bool)
                for i, some in enumerate(part["early"].to_pylist()):
                    early[i, np.searchsorted(groups.group, some)] = True
                for g in np.flatnonzero(early.any(axis=0)).tolist():
                    who = np.flatnonzero(early[:, g])
                    waiting.setdefault(g, []).append((keys[who], floors[who], x[who]))
                    held += len(who)
                    if held >= HELD_ROWS:
                        yield from packs(waiting)
                        waiting, held = {}, 0
        yield from packs(waiting)

    return run


_MET = "key string, match_id long, score double, met long, whole long"


def _packed(dims: int):
    """Queries as they come, packed: keys, floors, vectors, and the groups that they have met, with the places of those who met them."""
    names = ["keys", "floors", "queries", "who", "had"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                part = whole.slice(start, BLOCK_ROWS)
                who, had = pc.list_parent_indices(part["early"]).to_numpy().astype(np.int32), part["early"].flatten().to_numpy()
                columns = [[part["key"].to_pylist()], [part["floor"].to_numpy()], [_matrix(part["vector"], dims).ravel()], [who], [had]]
                types = [pa.list_(x) for x in (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


class Pack:
    """Queries of a pack under way: their vectors, floors, what they have met and found."""

    def __init__(self, one: pa.RecordBatch, dims: int):
        self.keys = pa.concat_arrays([one["keys"].flatten()])
        self.x = _matrix(one["queries"], dims).copy()
        self.single = self.x.astype(np.float32)
        self.floors, self.who, self.had = (one[name].flatten().to_numpy().copy() for name in ("floors", "who", "had"))
        self.hits, self.waiting, self.met, self.whole = [], 0, 0, 0

    def add(self, hits: tuple[np.ndarray, ...], k: int) -> None:
        self.hits.append(hits)
        self.waiting += len(hits[0])
        if self.waiting > 2 * k * len(self.keys):
            self.settle(k)

    def settle(self, k: int) -> None:
        """Only the k best of each query stay, and who has as many asks for no less than the last of them."""
        i, ids, score = _firsts(*(np.concatenate(c) for c in zip(*self.hits, strict=True)), k)
        last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
        self.floors[i[last]] = np.maximum(self.floors[i[last]], score[last])
        self.hits, self.waiting = [(i, ids, score)], 0


def _late(space: Space, groups: Groups, dims: int, k: int, digits: int, slack: float):
    """Of a pair of blocks the queries that have to meet the group, and have not. What a query has found in a share of blocks raises its floor.

    A task keeps the packs and the blocks of its shares, which come once.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, Pack] = {}
        blocks: dict[int, tuple[np.ndarray, ...]] = {}
        under_way = None
        for part in parts:
            for row in range(part.num_rows):
                one = part.slice(row, 1)
                p, b = one["pack"][0].as_py(), one["block"][0].as_py()
                if one["keys"][0].is_valid:
                    packs[p] = Pack(one, dims)
                if one["ids"][0].is_valid:
                    y = _matrix(one["vectors"], dims).copy()
                    blocks[b] = y, y.astype(np.float32), one["ids"].flatten().to_numpy().copy()
                pack, (y, single, ids) = packs[p], blocks[b]
                if under_way != p:
                    under_way, angles = p, space.angles(pack.x)
                g = int(np.searchsorted(groups.group, one["group"][0].as_py()))
                at, low, high = angles[:, groups.pivot[g]], groups.low[g], groups.high[g]
                meet = np.cos(np.maximum(0.0, np.maximum(at - high, low - at))) >= pack.floors - slack
                meet[pack.who[pack.had == groups.group[g]]] = False
                places = np.flatnonzero(meet)
                for start in range(0, len(places), QUERY_ROWS):
                    cut = places[start : start + QUERY_ROWS]
                    i, j, score, whole = _found(pack.x[cut], pack.single[cut], pack.floors[cut], y, single, ids, k, digits, slack)
                    pack.met, pack.whole = pack.met + len(cut) * len(ids), pack.whole + whole
                    pack.add((cut[i], ids[j], score), k)
        for pack in packs.values():
            if pack.hits:
                pack.settle(k)
                i, ids, score = pack.hits[0]
                yield _told(pack.keys.take(pa.array(i)), ids, score, pack.met, pack.whole)

    return run


_NAMES = ["key", "match_id", "score", "met", "whole"]
_TYPES = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]


def _told(keys: pa.Array, ids: np.ndarray, score: np.ndarray, met: int, whole: int) -> pa.RecordBatch:
    """Hits, and a row that counts pairs: met, and scored in whole."""
    n = len(ids)
    columns = [keys, pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
    last = [pa.array([v], t) for v, t in zip([None, None, None, met, whole], _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c, v]) for c, v in zip(columns, last, strict=True)], _NAMES)


def _firsts(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query, an id once, ties to the smaller id."""
    order = np.lexsort((-score, ids, i))
    i, ids, score = i[order], ids[order], score[order]
    other = np.ones(len(i), bool)
    other[1:] = (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])
    i, ids, score = i[other], ids[other], score[other]
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], ids[best], score[best]


def _found(a: np.ndarray, a_single: np.ndarray, floors: np.ndarray, b: np.ndarray, b_single: np.ndarray, ids: np.ndarray, k: int, digits: int, slack: float):
    """Places i, j of the pairs of two blocks that reach the floor of their query and can be among its k best here, their scores, and how many were scored in whole."""
    dims = a.shape[1]
    room = slack + (dims + 8) * 2.0**-24
    single, least = a_single @ b_single.T, floors - room
    if np.count_nonzero(reach := single >= least.astype(np.float32)[:, None]) > 4 * k * len(a) and len(ids) > k and len(np.unique(ids)) == len(ids):
        # The k-th best in single precision may be off by the room, and so may what it is held against.
        reach &= single >= (np.partition(single, -k, axis=1)[:, -k].astype(float) - 2 * room)[:, None].astype(np.float32)
    i, j = np.divmod(np.flatnonzero(reach), len(ids))
    whole = len(i)
    if whole * 8 < len(a) * len(b):
        score = np.einsum("ij,ij->i", a[i], b[j])
    else:
        score = (a @ b.T)[i, j]
    score = np.round(score, digits)
    good = score >= floors[i]
    return i[good], j[good], score[good], whole


def _scored(dims: int, k: int, digits: int, slack: float):
    """The best k of a pair of blocks for every query that reach its floor, and a row that counts pairs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                one = part.slice(row, 1)
                a, b = _matrix(one["queries"], dims), _matrix(one["vectors"], dims)
                floors, ids = (one[name].flatten().to_numpy() for name in ("floors", "ids"))
                i, j, score, whole = _found(a, a.astype(np.float32), floors, b, b.astype(np.float32), ids, k, digits, slack)
                i, found, score = _firsts(i, ids[j], score, k)
                yield _told(one["keys"].flatten().take(pa.array(i)), found, score, len(a) * len(b), whole)

    return run


def _block(table: pa.Table) -> pa.Table:
    columns = {"group": table["group"][:1], "salt": table["salt"][:1], "ids": pa.array([table["id"].to_numpy()]), "vectors": pa.array([table["vector"].combine_chunks().flatten().to_numpy()])}
    return pa.table(columns)


def _best(hits: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "match_id")
    return hits.groupBy(by, "match_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(queries: DataFrame, rows: DataFrame, dims: int, k: int, least: float = 0.0, digits: int = 9, itself: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``nearest`` returns, and one row of counts: queries' and rows' vectors that differ (of the rows, up to k + 1
    copies each), pairs, pairs of those met in blocks, and pairs scored in whole.
    """
    slack = SLACK + 0.5 * 10.0**-digits
    stored = written(usable(rows, dims))
    asked = stored if queries is rows else written(usable(queries, dims))
    copies = Window.partitionBy("key").orderBy("id")
    candidates = written(stored.withColumn("__n", F.dense_rank().over(copies)).where(F.col("__n") <= k + 1).drop("__n", "key"))
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()["vector"]
    n = candidates.count()
    spark = rows.sparkSession
    if n == 0:
        return spark.createDataFrame([], "query_id long, match_id long, score double, rank int"), spark.createDataFrame([], "queries long, rows long, pairs long, met long, whole long")
    space = fitted(_matrix(sample, dims), min(MAX_PIVOTS, n // (RINGS * GROUP_ROWS) + 1))

    placed = written(candidates.mapInArrow(_placed(space, dims), "id long, group int, angle double, vector array<double>"))
    found = placed.groupBy("group").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("rows")).orderBy("group").collect()
    group, low, high, size = (np.array([r[c] for r in found]) for c in ("group", "low", "high", "rows"))
    groups = Groups(group, group // (len(space.rings) + 1), low - SLACK, high + SLACK, size, -(-size // BLOCK_ROWS))
    dense = np.ones(int(group.max()) + 1, np.int64)
    dense[group] = groups.blocks
    dealt = F.element_at(F.split(F.lit(",".join(map(str, dense.tolist()))), ",").cast("array<int>"), F.col("group") + 1)
    blocks = placed.withColumn("salt", F.pmod(F.xxhash64("id"), dealt).cast("int")).groupBy("group", "salt")
    blocks = written(blocks.applyInArrow(_block, "group int, salt int, ids array<long>, vectors array<double>"))

    classes = asked.groupBy("key").agg(F.first("vector").alias("vector"))
    classes = written(classes.mapInArrow(_asked(space, groups, dims, 4 * (k + 1)), "key string, vector array<double>, early array<int>"))

    packs = classes.withColumn("floor", F.lit(float(least))).mapInArrow(_dealt(space, groups, dims), "group int, blocks int, keys array<string>, floors array<double>, queries array<double>")
    packs = packs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    early = written(packs.join(blocks, ["group", "salt"]).select("keys", "floors", "queries", "ids", "vectors").mapInArrow(_scored(dims, k + 1, digits, slack), _MET))
    floors = _best(early.where("match_id IS NOT NULL"), "key", k + 1).where(F.col("rank") == k + 1).select("key", F.col("score").alias("floor"))
    asking = classes.count()
    n_asked, n_blocks = (shares(spark, some, SHARE_ROWS) for some in (asking, n))
    waiting = classes.join(floors, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(float(least))))
    waiting = written(waiting.repartition(n_asked).mapInArrow(_packed(dims), "keys array<string>, floors array<double>, queries array<double>, who array<int>, had array<int>"))
    numbered = lambda of, n, name: of.coalesce(n).withColumn(name, F.monotonically_increasing_id())
    pairs = met(numbered(waiting, n_asked, "pack"), numbered(blocks.drop("salt"), n_blocks, "block"), n_asked, n_blocks)
    # The first rows of a share, which meet all of the other one, take that one's vectors along.
    first = lambda name: F.col(name).bitwiseAND((1 << 33) - 1) == 0
    sent = [F.when(first(other), F.col(c)).alias(c) for cs, other in ((waiting.columns, "block"), (("ids", "vectors"), "pack")) for c in cs]
    late = pairs.select("pack", "block", "group", *sent).mapInArrow(_late(space, groups, dims, k + 1, digits, slack), _MET)

    told = early.unionByName(written(late))
    hits = _best(told.where("match_id IS NOT NULL"), "key", k + 1).drop("rank")
    of_query = asked.select(F.col("id").alias("query_id"), "key").distinct().join(hits, "key").drop("key")
    if not itself:
        of_query = of_query.where("query_id <> match_id")
    work = told.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("whole"), F.lit(0)).alias("whole"))
    counts = work.select(F.lit(asking).cast("long").alias("queries"), F.lit(n).cast("long").alias("rows"), F.lit(asking * n).cast("long").alias("pairs"), "met", "whole")
    return _best(of_query, "query_id", k), counts


def nearest(queries: DataFrame, rows: DataFrame, dims: int, k: int, least: float = 0.0, digits: int = 9, itself: bool = False) -> DataFrame:
    """The k rows of the highest cosine, from ``least`` on, for every query: query_id, match_id, score, rank.

    Both frames have id and vector (an array of ``dims`` numbers); other columns are ignored. Scores are rounded to
    ``digits``, then ranked, ties to the smaller id. A row is no match of its own id unless ``itself``.
    Rows without an id or a vector that can be used take no part; repeated rows count once; of an id with
    several vectors the best one counts. Empty tables give no rows. The driver holds a sample of bounded size and one
    row a group. Where vectors lie in no clusters, little can be passed over, and the work is that of all pairs.
    """
    return searched(queries, rows, dims, k, least, digits, itself)[0]
