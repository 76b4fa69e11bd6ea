"""The pruned search of nearest vectors against all pairs."""

import numpy as np
import pytest

from casequarry.operators import neighbours
from casequarry.plans import search

ROWS = "id long, vector array<double>, key string, `a b` int"


def by_all_pairs(queries, rows, k, least, digits, itself=False):
    """Lists of (id, vector), each id with one usable vector, as plain products."""
    unit = lambda v: np.array(v) / np.sqrt(sum(x * x for x in v))
    out = []
    stored = [(i, unit(v)) for i, v in sorted(dict(rows).items())]
    for q, v in sorted(dict(queries).items()):
        scores = sorted((-round(float(unit(v) @ u), digits), i) for i, u in stored if itself or i != q)
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(scores[:k], 1) if -s >= least]
    return sorted(out)


def told(df):
    return sorted((r["query_id"], r["match_id"], r["score"], r["rank"]) for r in df.collect())


def clustered(n, dims, centres, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return [(i, (c[i % centres] + 0.05 * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("itself", [False, True])
def test_equals_all_pairs_and_scores_few(spark, itself, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 25)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 16)
    monkeypatch.setattr(neighbours, "HELD_ROWS", 64)
    rows = clustered(900, 8, 9) + [(1000 + i, clustered(1, 8, 9)[0][1]) for i in range(300)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], ROWS).repartition(3)
    found, counts = neighbours.searched(df, df, 8, 4, 0.2, 6, itself)
    assert told(found) == by_all_pairs(rows, rows, 4, 0.2, 6, itself)
    work = counts.first()
    # 300 copies of one vector and the first row are one query and five candidates
    assert (work["queries"], work["rows"], work["pairs"]) == (900, 904, 900 * 904)
    assert work["whole"] <= work["met"] < work["pairs"] / 3 and work["whole"] < work["pairs"] / 7


def test_vectors_without_clusters_are_exact_too(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    few = df.where("id % 7 = 0")
    assert told(neighbours.nearest(few, df, 64, 5, -1.0)) == by_all_pairs([r for r in rows if r[0] % 7 == 0], rows, 5, -1.0, 9)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(None, [1.0, 0.0]), (50, None), (51, [0.0, 0.0]), (52, [1.0]), (53, [1.0, nan]), (54, [inf, 1.0]), (55, [1.0, None]), (56, [])]
    good = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (1, [1.0, 0.0]), (5, [1e-9, 0.0])]
    df = spark.createDataFrame([(i, v, "k", 0) for i, v in bad + good], ROWS)
    assert told(neighbours.nearest(df, df, 2, 2, 0.0)) == by_all_pairs(good, good, 2, 0.0, 9)
    twice = spark.createDataFrame([(9, [1.0, 1.0]), (9, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.9])], "id long, vector array<double>")
    assert told(neighbours.nearest(twice.where("id = 3"), twice, 2, 2, 0.0, 4)) == [(3, 4, 0.669, 2), (3, 9, 1.0, 1)]
    empty, counts = neighbours.searched(df, df.where("id > 60"), 2, 2)
    assert empty.collect() == [] and counts.collect() == []
    assert neighbours.nearest(df.where("id > 60"), df, 2, 2).collect() == []


def test_bounds_hold(spark):
    """No row of a group scores more than the group's bound says."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = neighbours.fitted(x, 7)
    y = x @ space.axes
    angles = space.angles(y)
    for pivot in range(7):
        own = angles.argmin(axis=1) == pivot
        at = angles[own, pivot]
        group = neighbours.Groups(*(np.array([v]) for v in (pivot, pivot, at.min(), at.max(), own.sum(), 1)))
        assert (y @ y[own].T <= group.bounds(angles) + 1e-9).all()


def test_profiles_pass_over_most_pairs(spark, small):
    rows = search.profiles(spark, small)
    work = neighbours.searched(rows, rows, len(search.LETTERS), 3, search.MIN_LIKENESS, 6)[1].first()
    assert work["whole"] < work["pairs"] / 2


def test_letters_are_counted_as_in_sql(spark, tmp_path, monkeypatch):
    """By bytes, whatever a piece cuts: the same as replacing letter by letter."""
    monkeypatch.setattr(search, "BYTES_AT_ONCE", 5)
    texts = ["", "aAbZ zz", None, "é\u212aß İ ſ 日本 q", "x" * 23, "no\nletters 123", "🙂z🙂Z", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = search.profiles(spark, str(tmp_path))
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    low = {i: "".join(c.lower() if c.isascii() else c for c in t) for i, t in enumerate(texts) if t is not None}
    assert {r["id"]: list(r["vector"]) for r in rows.collect()} == {i: [t.count(c) for c in search.LETTERS] for i, t in low.items()}


def test_a_first_floor_doesnt_let_all_pairs_through(spark, monkeypatch):
    """Where every pair reaches the likeness asked for, only what can be among the k best is scored in whole."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 500)
    rng = np.random.default_rng(8)
    rows = [(i, (1 + 0.3 * rng.random(26)).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found, counts = neighbours.searched(df, df, 26, 3, 0.35, 6)
    assert told(found) == by_all_pairs(rows, rows, 3, 0.35, 6)
    work = counts.first()
    assert work["whole"] < work["pairs"] / 20
