"""Vector functions as column expressions, and a blocked exact search."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.session import met, shares, written

BLOCK_ROWS = 4096
#: Queries of a block that are multiplied at a time, and rows of a share of blocks, at most.
QUERY_ROWS = 512
SHARE_ROWS = 65_536


def dot(vector: Column, query: Sequence[float]) -> Column:
    """Inner product with a literal vector, written out so that it stays in generated code."""
    total = F.lit(0.0)
    for i, x in enumerate(query):
        total = total + F.get(vector, F.lit(i)).cast("double") * F.lit(float(x))
    return total


def dot_columns(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot_columns(vector, vector))


def unit(vector: Column) -> Column:
    """The vector over its length; null for one of length 0."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), length))


def unit_list(values: Sequence[float]) -> list[float]:
    length = math.sqrt(sum(x * x for x in values))
    return [x / length for x in values]


def clamped(score: Column) -> Column:
    return F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0))


def filled(vector: Column, dims: int) -> Column:
    """The vector, or zeros where the channel is missing."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dims))


def fused(image: Column | None, text: Column | None, image_weight: float = 0.4, text_weight: float = 0.6) -> Column:
    """Weighted score of the channels that the query has; the weights of those sum to 1."""
    weights = [(clamped(score), w) for score, w in ((image, image_weight), (text, text_weight)) if score is not None]
    total = sum(w for _, w in weights)
    out = F.lit(0.0)
    for score, w in weights:
        out = out + score * F.lit(w / total)
    return out


def _pack(rows: int):
    """Rows of (id, image vector or null, text vector or null) as blocks of matrices."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), rows):
                piece = part.iloc[start : start + rows]
                out: dict[str, list] = {"ids": [piece["id"].to_numpy(np.int64).tobytes()]}
                for channel in ("image", "text"):
                    known = [v is not None for v in piece[channel]]
                    dims = max((len(v) for v in piece[channel] if v is not None), default=0)
                    matrix = np.zeros((len(piece), dims))
                    for i, v in enumerate(piece[channel]):
                        if v is not None:
                            matrix[i, : len(v)] = v
                    out |= {f"{channel}_known": [np.array(known).tobytes()], channel: [matrix.tobytes()]}
                yield pd.DataFrame(out)

    return pack


_BLOCK = "ids binary, image_known binary, image binary, text_known binary, text binary"


def blocks(df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of (id long, image, text) packed, as they are scanned, into matrices of up to ``rows`` rows."""
    return df.where("id IS NOT NULL").select("id", "image", "text").mapInPandas(_pack(rows), _BLOCK)


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (place of the query, id, score) the k best of each query, ties to the smaller id."""
    place, ids, scores = found
    order = np.lexsort((ids, -scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    first = np.arange(len(place)) - np.searchsorted(place, place) < k
    return [place[first], ids[first], scores[first]]


def nearest(queries: DataFrame, rows: DataFrame, k: int, image_weight: float = 0.4, text_weight: float = 0.6, digits: int | None = None, itself: bool = False) -> DataFrame:
    """The k best fused scores over 0 of every query with all rows: exact, block by block.

    Both frames have id, image and text (arrays or null). Returns query_id, match_id, score, rank; ties
    to the smaller id; a row is no match of its own id unless ``itself``. The weights are those of the
    channels that the query has, and a row that lacks one scores 0 there. Blocks are files that tasks read in place. A pair of
    blocks is two matrix products, of which only what reaches the k-th score so far is looked at, and a task gives k rows a query.
    """

    def dealt(df: DataFrame) -> tuple[DataFrame, int]:
        n = shares(df.sparkSession, df.count(), SHARE_ROWS)
        return written(blocks(df.select("id", "image", "text").repartition(n))), n

    stored, n = dealt(rows)
    asked, n_asked = (stored, n) if queries is rows else dealt(queries)
    asked = asked.selectExpr("ids AS q_ids", *[f"{c} AS q_{c}" for c in ("image_known", "image", "text_known", "text")])
    pairs = met(asked, stored, n_asked, n)
    weights = (("image", image_weight), ("text", text_weight))
    slack = 0.0 if digits is None else 10.0**-digits

    def products(pair: dict, cut: slice) -> np.ndarray:
        """Scores of some queries; what is no match is 0."""
        ids, query_ids = np.frombuffer(pair["ids"], np.int64), np.frombuffer(pair["q_ids"], np.int64)[cut]
        shares_of = [weight * np.frombuffer(pair[f"q_{channel}_known"], bool)[cut] for channel, weight in weights]
        total = sum(shares_of)
        scores = None
        for (channel, _), share in zip(weights, shares_of, strict=True):
            a, b = np.frombuffer(pair[f"q_{channel}"]).reshape(len(pair["q_ids"]) // 8, -1)[cut], np.frombuffer(pair[channel]).reshape(len(ids), -1)
            if a.shape[1] and a.shape[1] == b.shape[1]:
                part = a @ b.T
                np.maximum(part, 0.0, out=part)
                part *= (share / np.where(total > 0, total, 1.0))[:, None]
                if not (np.isfinite(a).all() and np.isfinite(b).all()):
                    part[np.isnan(part)] = 0.0
                scores = part if scores is None else scores + part
        if scores is None:
            return np.zeros((len(query_ids), len(ids)))
        if not itself and len(np.intersect1d(query_ids, ids)):
            scores[query_ids[:, None] == ids[None, :]] = 0.0
        return scores

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        under_way, best, floors = None, [], np.zeros(0)

        def told() -> pd.DataFrame:
            return pd.DataFrame({"query_id": np.frombuffer(under_way, np.int64)[best[0]], "match_id": best[1], "score": best[2]})

        for part in parts:
            for pair in part.to_dict("records"):
                ids = np.frombuffer(pair["ids"], np.int64)
                if pair["q_ids"] != under_way:
                    if under_way is not None:
                        yield told()
                    under_way, best = pair["q_ids"], [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                    floors = np.zeros(len(under_way) // 8)
                fresh = [best]
                for start in range(0, len(floors), QUERY_ROWS):
                    scores, least = products(pair, slice(start, start + QUERY_ROWS)), floors[start : start + QUERY_ROWS]
                    if len(ids) > k and not least.all():
                        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                    i, j = np.nonzero(scores >= np.maximum(least - slack, np.nextafter(0.0, 1.0))[:, None])
                    found = scores[i, j] if digits is None else np.round(scores[i, j], digits)
                    fresh.append([(i + start)[found > 0], ids[j][found > 0], found[found > 0]])
                best = _best([np.concatenate(c) for c in zip(*fresh, strict=True)], k)
                full = np.bincount(best[0], minlength=len(floors)) == k
                floors = np.where(full, np.minimum.reduceat(np.append(best[2], 0.0), np.searchsorted(best[0], np.arange(len(floors)))), 0.0)
        if under_way is not None:
            yield told()

    best_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    found = pairs.mapInPandas(multiply, "query_id long, match_id long, score double")
    return found.withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k)
