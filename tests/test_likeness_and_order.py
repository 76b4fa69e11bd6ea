"""Search by common words against all pairs, and the global order against a sort."""

import random
import re

import pytest
from pyspark.sql import functions as F

from casequarry.operators import evaluate, likeness, order, retrieval
from casequarry.plans.queries import documents


def words(text):
    return {w.lower() for w in re.findall("[A-Za-z]{4,}", text or "")}


def brute(queries, cases, k, least):
    found = set()
    for q, text in queries:
        scores = []
        for entry, seq, other in cases:
            a, b = words(text), words(other)
            if a and b and (score := len(a & b) / len(a | b)) > 0 and score >= least:
                scores.append((-score, seq, entry))
        found |= {(q, e, s, round(-m, 9), i + 1) for i, (m, s, e) in enumerate(sorted(scores)[:k])}
    return found


def rows(df):
    return {(r["query_id"], r["entry_id"], r["seq"], round(r["score"], 9), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("least", [0.0, 0.35, 0.8, 1.0])
def test_random_sets_copies_ties_and_unknown_words(spark, least):
    rng = random.Random(int(least * 100))
    vocabulary = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(4)]
    text = lambda extra=(): " ".join(rng.choices([*vocabulary[: rng.choice([3, 10, 32])], *extra], k=rng.randrange(0, 14)))
    cases = [(f"e{i}", i, text()) for i in range(60)] + [("null", 90, None), ("none", 91, "a b")] + [(f"c{i}", 100 + i, "worda same text again") for i in range(9)]
    queries = [(f"q{i}", text(["neverseen", "unheard"])) for i in range(40)] + [("nq", None), ("q_a", "same again worda text"), ("q_b", "worda same again text")]
    found = likeness.most_alike(spark.createDataFrame(queries, "query_id string, description string"), spark.createDataFrame(cases, "entry_id string, seq long, description string"), 3, least)
    assert rows(found) == brute(queries, cases, 3, least)


def test_every_document_as_a_query(spark, small):
    docs = documents(spark, small, searched=True).select("entry_id", "seq", "description")
    listed = [tuple(r) for r in docs.collect()]
    asked = docs.select(F.col("entry_id").alias("query_id"), "description")
    assert rows(likeness.most_alike(asked, docs, 5, 0.35)) == brute([(e, t) for e, _, t in listed], listed, 5, 0.35)
    q_classes, s_classes, _, _ = likeness.classes(asked, docs)
    assert likeness.candidates(q_classes, s_classes, 0.35).count() <= 3 * likeness.scored(q_classes, s_classes, 0.35).count()


def test_nothing_to_search(spark, small):
    docs = documents(spark, small, searched=True).select("entry_id", "seq", "description")
    asked = docs.select(F.col("entry_id").alias("query_id"), "description")
    assert likeness.most_alike(asked, docs.limit(0), 3, 0.35).count() == likeness.most_alike(asked.limit(0), docs, 3, 0.35).count() == 0
    assert retrieval.common_words(asked, docs.where("entry_id < 0")).count() == 0


def test_order_of_half_nulls_and_ties_is_dealt_evenly(spark):
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 3 = 0 THEN 'no time' ELSE concat('2026-01-0', id % 4 + 1, ' 10:00:00') END AS time", "concat('k', id * 7919 % 4000) AS key").repartition(7)
    found = evaluate.with_ordinal(df, "time", "key")
    when = lambda t: (0, t) if t and t.startswith("2026") else (1, t or "")
    want = sorted(((r["time"], r["key"]) for r in df.collect()), key=lambda r: (when(r[0])[0], "" if r[0] is None else "1" + r[0], r[1]))
    assert [(r["time"], r["key"]) for r in sorted(found.collect(), key=lambda r: r["ordinal"])] == want
    numbered = order.numbered(df, [F.col("time"), F.col("key")], "n", ranges=8)
    shares = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 8 and max(shares) < 0.25 * 4000
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 4001))


def test_order_of_nothing(spark):
    assert order.numbered(spark.range(0), [F.col("id")], "n").collect() == []
