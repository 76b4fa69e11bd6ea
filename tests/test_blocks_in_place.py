"""Blocks of vectors are met where they lie: nothing of the pairs is shuffled but what each share of blocks found."""

import numpy as np
import pytest

from casequarry.functions import vectors
from casequarry.operators import neighbours
from tests.test_neighbours import by_all_pairs, told


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("itself", [False, True])
def test_products_of_small_blocks(spark, monkeypatch, itself):
    for name, n in (("QUERY_ROWS", 7), ("SHARE_ROWS", 60)):
        monkeypatch.setattr(vectors, name, n, raising=False)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)] + [(999, None, None)], "id long, image array<double>, text array<double>")
    found = vectors.nearest(df, df, k=3, digits=6, itself=itself)
    assert plan(found).count("MapInPandas") == 1
    want = []
    for q in range(150):
        scores = sorted((-round(float(x[q] @ x[i]), 6), i) for i in range(150) if (itself or i != q) and x[q] @ x[i] > 0)
        want += [(q, i, -s, rank) for rank, (s, i) in enumerate(scores[:3], 1)]
    assert told(found) == sorted(want)


def test_vectors_without_clusters_shuffle_no_queries(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 40), ("GROUP_ROWS", 10), ("QUERY_ROWS", 16), ("SHARE_ROWS", 100)):
        monkeypatch.setattr(neighbours, name, n, raising=False)
    dealt = []
    if hasattr(neighbours, "met"):
        monkeypatch.setattr(neighbours, "met", lambda *a, f=neighbours.met: dealt.append(plan(f(*a))) or f(*a))
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found, counts = neighbours.searched(df, df, 16, 3, -1.0, 6)
    assert told(found) == by_all_pairs(rows, rows, 3, -1.0, 6)
    assert counts.first()["met"] <= 400 * 400
    assert len(dealt) == 1 and "hashpartitioning" not in dealt[0] and "SortMergeJoin" not in dealt[0]


def test_few_pairs_without_clusters_are_scored_in_whole(spark, monkeypatch):
    """Single precision rules out what half of the coordinates couldn't."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 100)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found, counts = neighbours.searched(df, df, 64, 3, 0.35, 6)
    assert told(found) == by_all_pairs(rows, rows, 3, 0.35, 6)
    work = counts.first()
    assert work["whole"] < work["pairs"] / 50


def test_scores_that_single_precision_cannot_tell_apart(spark):
    """Rows that differ from each other, and from a query's floor, by less than single precision holds."""
    rows = [(i, [1.0, 1e-4 * (i % 40), 1e-9 * i]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for digits in (6, 9, 12):
        assert told(neighbours.nearest(df, df, 3, 3, 0.9999995, digits)) == by_all_pairs(rows, rows, 3, 0.9999995, digits)


def test_a_pack_and_a_block_come_once_to_a_task(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 40), ("GROUP_ROWS", 10), ("QUERY_ROWS", 16), ("SHARE_ROWS", 100)):
        monkeypatch.setattr(neighbours, name, n, raising=False)
    read = spark.sparkContext.accumulator(0)
    late = neighbours._late

    def counted(*a):
        run = late(*a)

        def tapped(parts):
            def seen():
                for part in parts:
                    read.add(sum(len(v.as_py() or ()) for v in part["vectors"]))
                    yield part

            yield from run(seen())

        return tapped

    monkeypatch.setattr(neighbours, "_late", counted)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(400)], "id long, vector array<double>")
    neighbours.nearest(df, df, 16, 3, -1.0, 6).count()
    # Each of up to 4 shares of queries takes all vectors once, and none of them anew for every pack.
    assert 400 * 16 <= read.value <= 6 * 400 * 16
