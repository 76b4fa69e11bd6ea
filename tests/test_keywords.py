"""A catalogue of keywords as a table against plain containment."""

import json
import random

from pyspark.sql import functions as F

from casequarry.operators import keywords
from casequarry.sources import tables

TEXTS = "id long, text string, `a b` string"


def test_hits_are_those_of_containment(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abÄçß中", k=rng.randrange(1, 4))) for _ in range(300)] + ["ABA", "a b", "𝒳y", "İ"]
    texts = [(i, "".join(rng.choices("abÄçß中 AB𝒳yİ", k=rng.randrange(0, 60))), "x") for i in range(80)] + [(90, None, "x"), (91, "", "x"), (1, "aba", "y")]
    df, catalogue = spark.createDataFrame(texts, TEXTS), spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "keyword string")
    lowered = df.selectExpr("id", "lower(text) AS t", "`a b`")
    known = catalogue.selectExpr("lower(keyword) AS k").where("k <> ''").distinct()
    want = {tuple(r) for r in lowered.join(known, F.expr("contains(t, k)")).select("id", "a b", "k").collect()}
    for size in (1 << 20, 200):
        found = keywords.found(df, "text", catalogue, size)
        assert found.columns == ["id", "a b", "keyword"]
        rows = [tuple(r) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(set(rows))
    assert len(keywords.slices(catalogue, 200)) > 2


def test_an_empty_catalogue_finds_nothing(spark):
    df = spark.createDataFrame([(1, "text", "x")], TEXTS)
    found = keywords.found(df, "text", spark.createDataFrame([("",)], "keyword string"))
    assert found.columns == ["id", "a b", "keyword"] and found.count() == 0


def test_rules_of_a_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"P1": {"name": "Bend", "trigger_vlm": ["Bend", "fold", "angle"], "trigger_bom": ["BR"]}, "P2": {"trigger_vlm": [], "trigger_bom": ["weld", "Seam"]}}))
    rules = tables.rule_table(spark, str(tmp_path / "rules.json"))
    assert {tuple(r) for r in rules.collect()} >= {("P1", "Bend", "vlm", 0, "Bend"), ("P2", "", "bom", 1, "Seam")} and rules.count() == 6
    texts = spark.createDataFrame([(1, "An ANGLE, bends and folds", "x"), (2, "seams", "x"), (1, "bend", "y")], TEXTS)
    found = keywords.rules_met(texts, "id", "text", rules.select("rule_id", "ord", "keyword"), clues=2)
    assert {tuple(r) for r in found.collect()} == {(1, "P1", 3, "Bend、fold"), (2, "P2", 1, "Seam")}
