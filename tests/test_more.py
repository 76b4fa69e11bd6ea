"""Stores that keep all their rows and history, providers that are asked again, reports, files, verbs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from casequarry import cli, session
from casequarry.operators import analysis, boxes, evaluate, providers, reports, retrieval, store
from casequarry.plans.more import STEP
from casequarry.service import CASES, CaseStore
from casequarry.sources import tables

STATE = "entry_id string, seq long, image_hash string, description string, tags array<string>, timestamp string, updated_at string, version_count int, status string, superseded_by string"
BATCH = "entry_id string, seq long, image_hash string, description string, tags array<string>"


def test_rows_without_a_hash_are_images_of_their_own(spark):
    state = spark.createDataFrame([(i, n, h, "old", None, "0", None, 1, None, None) for n, (i, h) in enumerate([("a", ""), ("b", " "), ("c", None), ("d", "h")])], STATE)
    batch = spark.createDataFrame([("w", 10, "", "new", []), ("x", 11, None, "new", []), ("y", 12, None, "new", []), ("z", 13, "h", "new", [])], BATCH)
    found = {r["entry_id"]: r for r in store.upsert(state, batch, "now").collect()}
    assert set(found) == {"a", "b", "c", "d", "w", "x", "y"} and all(r["status"] is None for r in found.values())
    assert [found[i]["description"] for i in "abcdwxy"] == ["old", "old", "old", "new", "new", "new", "new"] and found["d"]["version_count"] == 2
    kept = {r["seq"]: (r["entry_id"], r["current"], r["version_count"]) for r in store.versions(state).collect()}
    assert kept == {i: (e, True, 1) for i, e in enumerate("abcd")}


def test_upsert_carries_payload_and_history(spark):
    empty = spark.createDataFrame([], CASES)
    first = spark.createDataFrame([("a", 1, "h", "one", "why", ["P1"], "bom", ["t"])], f"{BATCH.replace(', tags array<string>', '')}, reasoning string, correct_processes array<string>, bom_context string, tags array<string>")
    state = store.upsert(empty, first, "t1")
    again = first.withColumns({"entry_id": F.lit("b"), "seq": F.lit(2).cast("long"), "description": F.lit(None).cast("string"), "reasoning": F.lit("since"), "correct_processes": F.array(F.lit("P2")), "tags": F.array().cast("array<string>")})
    state = store.upsert(state, again, "t2")
    row = store.upsert(state, again.withColumn("seq", F.lit(3).cast("long")), "t3").first()
    assert (row["entry_id"], row["correct_processes"], row["tags"], row["timestamp"], row["updated_at"], row["version_count"]) == ("a", ["P2"], ["t"], "t1", "t3", 3)
    assert [tuple(s) for s in row["version_history"]] == [("t1", "one"), ("t1", "since")]
    assert state.schema["version_history"].dataType.simpleString() == STEP.replace(" ", "")


def test_rows_without_a_time_keep_an_ordinal(spark):
    rows = spark.createDataFrame([("2024-01-02 10:00:00", 3), (None, 2), ("2024-01-01 09:00:00", 9), ("no time", 5), (None, 1), (None, None)], "time string, key int")
    found = sorted((r["ordinal"], r["key"]) for r in evaluate.with_ordinal(rows, "time", "key").collect())
    assert [n for n, _ in found] == [1, 2, 3, 4, 5, 6] and [k for _, k in found] == [9, 3, None, 1, 2, 5]


@pytest.mark.parametrize("least", [0.0, 0.2, 0.35, 1.0])
def test_common_words_are_the_same_by_brute_force(spark, small, least):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.substring_index("text", ".", 2).alias("description"))
    rows = [(r["doc_id"], r["description"] + " shared") for r in docs.collect()] + [(900, None), (901, "a b"), (902, "shared")]
    cases = spark.createDataFrame(rows, "entry_id long, description string").withColumn("seq", F.col("entry_id"))
    queries = cases.where("entry_id > 150").select(F.col("entry_id").alias("query_id"), "description")
    import re

    words = {i: set(re.findall(r"[a-z]{4,}", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows}
    want = {(q, e) for q in words if q > 150 for e in words if words[q] & words[e] and len(words[q] & words[e]) / len(words[q] | words[e]) >= least}
    found = retrieval.common_words(queries, cases, least).collect()
    assert {(r["query_id"], r["entry_id"]) for r in found} == want and len(found) == len(want)


def test_reviewed_cases_are_measured_and_only_changes_are_embedded(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        embed = providers.stand_in_embedder(8)()

        def call(value):
            calls.add(1)
            return embed(value)

        return call

    box = CaseStore(spark, str(tmp_path), counting)
    box.save(spark.createDataFrame([(f"c{i}", i, f"h{i}", f"text {i}", []) for i in range(20)], BATCH), "t1")
    before = calls.value
    records = "entry_id string, seq long, image_path string, image_hash string, corrected string, bom_context string, first_text string, second_text string"
    rows = [("a", 100, "p1", "h1", " right ", "bom", "wrong", "right"), ("b", 101, "p2", "hb", "plain", "", "", ""), ("c", 102, "gone", "hc", "x", "", "", "")]
    found = {r["entry_id"]: (r["saved"], r["improvement_rate"]) for r in box.review(spark.createDataFrame(rows, records), spark.createDataFrame([("p1",), ("p2",)], "path string"), "t2").collect()}
    assert found == {"a": (True, 1.0), "b": (True, None), "c": (False, None)}
    assert calls.value - before <= 5 + 3 + 4  # texts of the records, and the two changed cases
    assert box.cases().where("entry_id = 'c1'").first()["description"] == "right" and box.vectors().count() == 21
    assert [(r["entry_id"], r["ordinal"]) for r in box.metric_history().collect()] == [("c1", 1)]
    assert tuple(evaluate.mean_improvement(box.metric_history()).first()) == (1, 1.0)


def test_a_state_that_can_t_be_read_is_an_error(spark, tmp_path):
    box = CaseStore(spark, str(tmp_path), providers.stand_in_embedder(4))
    assert box.cases().count() == 0
    path = tables.replace(spark.range(3), f"{tmp_path}/cases")
    second = tables.replace(spark.range(5), f"{tmp_path}/cases")
    assert tables.current(spark, f"{tmp_path}/cases").count() == 5 and path != second
    for part in (tmp_path / "cases" / second.rsplit("/", 1)[1]).glob("part-*"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception, match="footer"):  # of the reader, whatever its class
        CaseStore(spark, str(tmp_path), providers.stand_in_embedder(4)).cases().count()
    other = CaseStore(spark, str(tmp_path / "other"), providers.stand_in_embedder(4))
    other.save(spark.createDataFrame([("a", 1, "h", "text", [])], BATCH), "t1")
    for part in (tmp_path / "other" / "cases" / "layers").rglob("part-*"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception, match="footer|Parquet"):
        other.cases().count()


def test_providers_are_asked_again_and_given_up(spark):
    def flaky():
        seen = {}

        def call(value):
            seen[value] = seen.get(value, 0) + 1
            if value == "slow":
                time.sleep(1.5)
            if value == "never" or seen[value] < 3:
                raise ValueError(value)
            return value + "!"

        return call

    rows = spark.createDataFrame([("once",), ("never",), ("slow",), (" ",)], "v string").coalesce(1)
    found = {r["v"]: (r["out"], r["error"]) for r in providers.apply(rows, "v", providers.patient(flaky, tries=3, seconds=0.3), "out", "string").collect()}
    assert found["once"] == ("once!", None) and found["never"] == (None, "ValueError: never") and found["slow"][1].startswith("TimeoutError") and found[" "] == (None, None)
    assert providers.timed(lambda: 7)[0] == 7


def test_one_observation_is_classified_by_every_domain(spark):
    rows = spark.createDataFrame([("a", "part"), ("b", "fail"), ("c", "odd")], "id string, prompt string")
    agents = {"geometry": providers.stand_in_model("{}"), "surface": providers.stand_in_model("fail{}")}
    found = {r["id"]: r for r in analysis.classified(rows, "id", "prompt", providers.stand_in_model("seen {}"), agents).collect()}
    assert found["a"]["observation"] == "seen part" and found["a"]["answers"]["geometry"].startswith("[geometry] candidates: C01, C03") and set(found["a"]["answers"]) == {"geometry", "surface"}
    assert found["b"]["observation"] is None and found["b"]["answers"] == {} and "ValueError" in found["b"]["error"]


def test_records_and_texts_of_results(spark):
    kind = "path string, seconds double, description string, first_description string, symbols array<struct<name:string,type:string,confidence:double,bbox:array<int>>>, lines array<string>, warnings array<string>, errors array<string>"
    rows = spark.createDataFrame([("p", 1.2345, "d", None, [("weld", "t", 0.98765, [1, 2, 3, 4])], ["a", " "], [], None)], kind)
    record = json.loads(reports.result_record(rows).first()["record"])
    assert record["elapsed_seconds"] == 1.23 and record["symbols"][0]["confidence"] == 0.988 and record["ocr_texts"] == ["a"] and "errors" not in record
    shown = rows.select(reports.result_text(F.col("path"), F.col("seconds"), {"Seen": F.col("description"), "Before": F.col("first_description")}).alias("t")).first()["t"]
    assert shown == "=== p (1.2s) ===\n--- Seen ---\nd"
    assert rows.select(providers.normal_vector(F.array(F.lit(3.0), F.lit(4.0))).alias("v")).first()["v"] == [0.6, 0.8]


def test_files_of_a_library_and_of_views(spark, tmp_path):
    library = f"{tmp_path}/library"
    files = spark.createDataFrame([("b.png", bytearray(b"2")), ("a.png", bytearray(b"1")), ("n.txt", bytearray(b"3"))], "name string, content binary")
    assert tables.save_files(files, library) == ["a.png", "b.png", "n.txt"]
    assert [r["name"] for r in tables.templates(spark, library).collect()] == ["a.png", "b.png"]
    assert tables.delete_file(f"{library}/a.png") and not tables.delete_file(f"{library}/a.png")
    views = boxes.named_views(spark.createDataFrame([("d", "Top", 1, 0.456, 1, 2, 3, 4)], "drawing string, view string, number int, confidence double, x int, y int, w int, h int"), "drawing")
    crops = views.select("file_name", F.lit(b"png").alias("content"))
    assert boxes.save_views(crops, views, "drawing", f"{tmp_path}/views") == ["d-01_Top.png", "d-metadata.json"]
    assert json.loads((tmp_path / "views" / "d-metadata.json").read_text())["views"][0]["confidence"] == 0.46


def test_verbs_on_a_store(spark, tmp_path, capsys, monkeypatch):
    box = CaseStore(spark, f"{tmp_path}/store", providers.stand_in_embedder())
    box.save(spark.createDataFrame([("a", 1, "h1", "round tube", [])], BATCH), "t1")
    spark.createDataFrame([("r", "h1", "", ""), ("s", "zz", "", "")], "request_id string, image_hash string, notes string, parent_text string").write.parquet(f"{tmp_path}/requests")
    assert cli.main(["analyse", f"{tmp_path}/store", f"{tmp_path}/requests"]) == 0
    out = {r["request_id"]: r["description"] for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert out["r"] == "round tube" and out["s"].startswith("described")
    spark.createDataFrame([("d", [("Weld",), ("hole",)]), ("e", [("x",)])], "drawing string, symbols array<struct<name:string>>").write.parquet(f"{tmp_path}/symbols")
    cli.main(["symbols", f"{tmp_path}/symbols", "--name", "WELD"])
    assert {r["drawing"]: r["found"] for r in map(json.loads, capsys.readouterr().out.splitlines())} == {"d": True, "e": False}
    assert cli.main(["symbols", f"{tmp_path}/nothing"]) == 1 and "casequarry symbols:" in capsys.readouterr().err
    monkeypatch.setenv("CASEQUARRY_MODEL", "m:f")
    assert session.setting("model") == "m:f" and session.setting("none", "x") == "x"
