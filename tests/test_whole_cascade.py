"""The cascade's whole job, and words found the same way by few queries and by many."""

import pytest

from casequarry.operators import likeness
from casequarry.registry import ORACLE_SQL, QUERIES
from tests.test_likeness_and_order import brute, rows


def test_alike_from_a_twentieth_on(spark, small):
    assert ORACLE_SQL["q07_cascade"].count("score >= 0.05") == 2
    found = QUERIES["q07_cascade"](spark, small).where("match_type <> 'exact_hash'")
    assert found.where("score >= 0.05 AND score < 0.35").count() and not found.where("score < 0.05").count()


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("least", [0.0, 0.05, 0.35])
def test_words_of_one_side_only(spark, monkeypatch, few, least):
    monkeypatch.setattr(likeness, "FEW_QUERIES", few)
    monkeypatch.setattr(likeness, "FEW_WORDS", few)
    cases = [("a", 1, "alpha beta gamma zeta"), ("b", 2, "alpha beta gamma iota"), ("c", 3, "alpha beta"), ("d", 4, "only here"), ("e", 5, None), ("f", 6, "beta alpha more words than the others have there")]
    queries = [("q", "alpha beta gamma kappa"), ("r", "never heard"), ("s", "beta"), ("t", "alpha beta"), ("u", "")]
    found = likeness.most_alike(spark.createDataFrame(queries, "query_id string, description string"), spark.createDataFrame(cases, "entry_id string, seq long, description string"), 3, least)
    assert rows(found) == brute(queries, cases, 3, least)
    s_classes = likeness.classes(spark.createDataFrame(queries, "query_id string, description string"), spark.createDataFrame(cases, "entry_id string, seq long, description string"))[1]
    assert s_classes.count() == 3  # a and b differ in words that no query has
