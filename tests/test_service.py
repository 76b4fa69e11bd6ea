"""The store as an object: its states on disk, searching and evaluating."""

from casequarry.operators import providers
from casequarry.service import CaseStore

BATCH = "entry_id string, seq long, image_hash string, description string, tags array<string>"


def test_store(spark, tmp_path):
    box = CaseStore(spark, str(tmp_path), providers.stand_in_embedder(8))
    assert box.cases().count() == box.vectors().count() == box.shadow().count() == 0 and box.stats().first()["total_entries"] == 0
    box.save(spark.createDataFrame([("a", 1, "h1", "flange plate", ["t"]), ("b", 2, "h2", "round tube", []), ("c", 3, "h3", "", [])], BATCH), "t1")
    box.save(spark.createDataFrame([("d", 4, "h1", "flange plate, bent", [])], BATCH), "t2")
    found = {r["entry_id"]: r for r in box.cases().collect()}
    assert found["a"]["description"] == "flange plate, bent" and found["a"]["version_count"] == 2 and found["a"]["timestamp"] == "t1"
    assert {r["entry_id"]: r["text_vec"] is not None for r in box.vectors().collect()} == {"a": True, "b": True, "c": False}
    queries = spark.createDataFrame([("q1", "h2", "x"), ("q2", None, "round tube"), ("q3", None, "")], "query_id string, image_hash string, description string")
    hits = {(r["query_id"], r["entry_id"], r["match_type"]) for r in box.similar(queries).collect() if r["score"] > 0.99}
    assert hits == {("q1", "b", "exact_hash"), ("q2", "b", "semantic")}
    box.describe(spark.createDataFrame([("b", "square tube")], "entry_id string, description string"), "t3")
    assert box.cases().where("entry_id = 'b'").first()["updated_at"] == "t3"
    box.delete(spark.createDataFrame([("c",)], "entry_id string"))
    assert box.cases().count() == box.vectors().count() == 2
    assert [tuple(r) for r in box.vocabulary().collect()] == [("Flange", 1)]


def test_evaluation_and_export(spark, tmp_path):
    box = CaseStore(spark, str(tmp_path), providers.stand_in_embedder(4))
    records = "seq long, image_path string, description string, predicted array<string>, truth array<string>"
    box.record(spark.createDataFrame([(1, "p1", "one", ["a"], ["A", "B"])], records))
    box.record(spark.createDataFrame([(2, "p2", "two", ["c"], [])], records))
    assert tuple(box.shadow_stats().first()) == (2, 0.25, 0.5)
    files = spark.createDataFrame([("p1", "h1"), ("p2", "h2")], "path string, image_hash string")
    assert box.export(files, "now") == 1 and box.cases().first()["entry_id"] == "p1" and box.cases().first()["tags"] == ["shadow_test"]
    correction = spark.createDataFrame([("f", "s", "Top", "Front", [1, 2, 3, 4], "t")], box.corrections().schema)
    box.correct_view(correction)
    box.correct_view(correction)
    assert box.corrections().count() == 2


def test_analysis_of_stored_hash(spark, tmp_path):
    box = CaseStore(spark, str(tmp_path), providers.stand_in_embedder(4))
    box.save(spark.createDataFrame([("a", 1, "h1", "stored", [])], BATCH), "t1")
    requests = spark.createDataFrame([("r", "h1", "", ""), ("s", "zz", "", "")], "request_id string, image_hash string, notes string, parent_text string")
    found = {r["request_id"]: r["description"] for r in box.analyse(requests, (), providers.stand_in_model("seen {}")).collect()}
    assert found["r"] == "stored" and found["s"].startswith("seen")
