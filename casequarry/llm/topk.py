"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its terms are the positions of its non-zero integer components. Rows are
packed, as they are scanned, into blocks of a few thousand; a block of candidates is turned into
postings, and every query row of a query block adds ``weight * postings`` into the block's dense
score array, term after term. Each (candidate block, query block) pair keeps its k best scores for
a query, and a ranked window merges those. Nothing of either side is ever gathered in one place:
the pairs of blocks are formed by Spark, which broadcasts the query blocks only if their size is
under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequarry.llm.common import cut

BLOCK_ROWS = 8192
QUERY_ROWS = 2048

#: A block as compressed sparse rows: ids, where each row begins, and the terms and weights of its components.
BLOCK_SCHEMA = "ids binary, begins binary, terms binary, weights binary"
HIT_SCHEMA = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as long; null if a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(wide, lambda x: F.floor(x * F.lit(scale))))


def _pack(rows_per_block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(start, rows_per_block)
                part = part.take(pa.array(np.argsort(np.asarray(part.column(0), dtype=np.int64), kind="stable")))
                lengths = np.asarray(pc.list_value_length(part.column(1)), dtype=np.int64)
                values = np.asarray(pc.fill_null(part.column(1).flatten(), 0), dtype=np.int64)
                row = np.repeat(np.arange(len(lengths)), lengths)
                term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                used = np.flatnonzero(values)
                begins = np.searchsorted(row[used], np.arange(len(lengths) + 1))
                parts = (np.asarray(part.column(0), dtype=np.int64), begins, term[used].astype(np.int32), values[used])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["ids", "begins", "terms", "weights"])

    return pack


def _unpack(ids: bytes, begins: bytes, terms: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(begins, np.int64), np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64)


def postings_of(begins: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows that hold each term of a block, and its weights there."""
    rows = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.argsort(terms, kind="stable")
    names, starts = np.unique(terms[order], return_index=True)
    ends = [*starts[1:], len(order)]
    return {int(t): (rows[order[s:e]], weights[order[s:e]]) for t, s, e in zip(names, starts, ends, strict=True)}


def block_scores(terms: np.ndarray, weights: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Dense scores of one sparse query row over a block, accumulated term after term."""
    scores = np.zeros(rows, dtype=np.int64)
    for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
        if term in postings:
            docs, others = postings[term]
            if len(docs) == rows:
                scores += weight * others
            else:
                scores[docs] += weight * others
    return scores


def best(scores: np.ndarray, names: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller name, without the query's own rows.

    ``names`` is ascending, so among equal scores the smaller position wins.
    """
    keep = np.flatnonzero(names != own)
    if len(keep) > k:
        part = scores[keep]
        least = np.partition(part, len(part) - k)[len(part) - k]
        above = keep[part > least]
        keep = np.concatenate([above, keep[part == least][: k - len(above)]])
    return keep


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                names, *packed = _unpack(pair["ids"], pair["begins"], pair["terms"], pair["weights"])
                postings = postings_of(*packed)
                query_ids, begins, terms, weights = _unpack(pair["q_ids"], pair["q_begins"], pair["q_terms"], pair["q_weights"])
                out_q, out_v, out_s = [], [], []
                for i, query_id in enumerate(query_ids):
                    own = slice(begins[i], begins[i + 1])
                    scores = block_scores(terms[own], weights[own], postings, len(names))
                    found = best(scores, names, query_id, k)
                    out_q.append(np.full(len(found), query_id))
                    out_v.append(names[found])
                    out_s.append(scores[found])
                if out_q:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": pa.array(np.concatenate(out_q), pa.int64()),
                            "vec_id": pa.array(np.concatenate(out_v), pa.int64()),
                            "score": pa.array(np.concatenate(out_s), pa.int64()),
                        }
                    )

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k highest integer inner products of every query row with the rows of ``vectors``.

    Both frames have ``vec_id`` long and ``weights`` array<long>. Returns query_id, rank (from 1),
    vec_id, score. A row is no candidate for a query of its own vec_id. Rows whose id or weights are
    null take no part; repeated rows are candidates each; a missing or null component counts as zero; ties go
    to the smaller vec_id; an empty table gives no rows. A query id that is repeated is searched once
    for each distinct vector, and those results are ranked together.
    """
    def slim(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "weights").where("vec_id IS NOT NULL AND weights IS NOT NULL")

    candidates = slim(vectors).mapInArrow(_pack(block_rows), BLOCK_SCHEMA)
    distinct = slim(queries).distinct()
    # few full blocks of queries rather than one for each small partition: every block meets every other
    parts = max(1, math.ceil(distinct.count() / query_rows))
    asked = distinct.repartition(parts).mapInArrow(_pack(query_rows), BLOCK_SCHEMA)
    if parts > 1:  # else every part of the queries would pack the candidates anew
        candidates, asked = cut(candidates), cut(asked)
    pairs = candidates.crossJoin(asked.selectExpr(*[f"{name} AS q_{name}" for name in ("ids", "begins", "terms", "weights")]))
    hits = pairs.mapInArrow(_search(k), HIT_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
