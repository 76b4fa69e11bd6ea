"""The pipeline's near-duplicate stage against exact five-word likeness."""

import numpy as np

import corpus_pipeline
from casequarry.llm import near_copies


def test_edited_copies_go(spark, small):
    words = [f"word{i}" for i in range(300)]
    edited = list(words)
    for i in (50, 150, 250):  # 15 of 296 shingles change: a likeness of 0.90
        edited[i] = f"other{i}"
    far = [f"other{i}" if i % 8 == 0 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far)), (None, " ".join(words)), (7, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.deduplicate_near(spark, docs, small).collect()]
    assert sorted(kept) == [1, 3, 7]


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "one two three four five six", 1), (1, "seven eight nine ten eleven twelve", 2), (1, "one two three four five six", 3), (None, "only text without a name here", 4), (None, "only  text without a name here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __of int")
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    marks = sorted(r["__of"] for r in kept.collect())
    assert 2 in marks and len(marks) == 3 and len({1, 3} & set(marks)) == 1 and len({4, 5} & set(marks)) == 1
    assert near_copies.one_of_each(docs.limit(0)).collect() == []


def test_a_large_group_is_the_same_by_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):  # more than a block; edits leave likenesses from 0.3 to 1
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    sets = [five_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i for i in range(len(rows)) if find(i) == i}
    got = {r["doc_id"] for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a text whose only like one is missed by the segments' balls may stay beside it
    assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want))


def five_words(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def test_every_pair_of_likeness_is_linked(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r["doc_id"]: five_words(r["text"]) for r in docs.collect()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if root[j] < root[i] and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))):
                    root[i], changed = root[j], True
    kept = {r["doc_id"] for r in corpus_pipeline.deduplicate_near(spark, docs, small).collect()}
    assert kept == {i for i in root if root[i] == i}
