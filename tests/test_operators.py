"""Semantics that are easy to get wrong, on small rows with expectations worked out by hand."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casequarry.functions import fixed, text, vectors
from casequarry.operators import boxes, evaluate, groups, providers, reports, retrieval, rules, store
from casequarry.sources import tables
from casequarry.streaming import shadow


def one(spark, column, **values):
    """The value of a column expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def of(spark, function, value):
    return one(spark, function(F.col("t")), t=value)


CASES = "entry_id string, seq long, image_hash string, description string, status string, image_vec array<double>, text_vec array<double>"


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        ("a", 1, "h1", "Flange plate with rounded corner", "superseded", [1.0, 0.0], [1.0, 0.0]),
        ("b", 2, "h1", "other words entirely", None, [1.0, 0.0], None),
        ("c", 3, "h2", "flange plate bent twice", None, [0.0, 1.0], [0.6, 0.8]),
        ("d", 4, "", "", None, None, None),
        ("e", 5, None, "12 ab", None, [-1.0, 0.0], [0.0, -1.0]),
    ]
    return spark.createDataFrame(rows, CASES)


def test_exact_hash_takes_the_last_even_if_superseded(spark, cases):
    queries = spark.createDataFrame([("q", "h1"), ("r", ""), ("s", None), ("t", "zz")], "query_id string, image_hash string")
    assert [tuple(r) for r in retrieval.exact_match(queries, cases).collect()] == [("q", "b", 1.0, "exact_hash")]
    late = cases.union(spark.createDataFrame([("z", 9, "h1", "", "superseded", None, None)], CASES))
    assert retrieval.exact_match(queries, late).first()["entry_id"] == "z"


def test_fusion_weighs_what_the_query_has(spark, cases):
    both = {r["entry_id"]: round(r["score"], 6) for r in retrieval.search(cases, [1.0, 0.0], [1.0, 0.0], 5).collect()}
    assert both == {"a": 1.0, "b": 0.4, "c": 0.36}  # b lacks a text vector and stays at 0.4; e is clamped away
    alone = {r["entry_id"]: r["score"] for r in retrieval.search(cases, [1.0, 0.0], None, 5).collect()}
    assert alone == {"a": 1.0, "b": 1.0}
    assert [r["entry_id"] for r in retrieval.search(cases, [1.0, 0.0], None, 1).collect()] == ["a"]  # ties by seq


def test_cascade(spark, cases):
    schema = "query_id string, image_hash string, description string, image_vec array<double>, text_vec array<double>"
    rows = [
        ("hash", "h2", "flange", [1.0, 0.0], None),
        ("weak", None, "flange plate bent twice", [0.9, 0.43], None),
        ("none", None, "a flange plate, bent", [-1.0, 0.0], None),
        ("words", None, "Flange plate bent", None, None),
        ("blank", None, "", None, None),
    ]
    found = {}
    for r in retrieval.cascade(spark.createDataFrame(rows, schema), cases, k=2, least=0.95).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["entry_id"], r["match_type"]))
    assert found == {"hash": [(1, "c", "exact_hash")], "none": [(1, "e", "semantic")]}  # weak hits don't fall through
    found = retrieval.cascade(spark.createDataFrame(rows[3:], schema), cases, k=2, least=0.35)
    assert [(r["query_id"], r["entry_id"], r["score"]) for r in found.collect()] == [("words", "c", 0.75)]


def test_word_threshold_is_on_the_rounded_score(spark):
    """0.3496 passes as 0.35."""
    stored = spark.createDataFrame([("x", 1, None, "common", None, None, None)], CASES)
    wide = " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) + "xx" for i in range(300))
    query = spark.createDataFrame([("q", None, wide)], "query_id string, image_hash string, description string")
    score = retrieval.common_words(query, stored.withColumn("description", F.lit(" ".join(wide.split()[:105])))).first()["score"]
    assert score == pytest.approx(0.35)


def test_shape_fallback_needs_four_points(spark):
    rows = spark.createDataFrame([("x", 1, "long plate", ["rib", "slot"]), ("y", 2, "plate", ["rib"]), ("z", 3, "", [])], "entry_id string, seq long, shape_description string, geometry array<string>")
    found = {r["entry_id"]: (r["points"], r["confidence"]) for r in retrieval.shape_search(rows, "plate", ["rib", "slot"], 3).collect()}
    assert found == {"x": (5, 0.5), "y": (4, 0.4)}


def test_priors_and_anchors(spark):
    assert of(spark, retrieval.priors, "a FLANGE, a thru-hole and a rib") == ["Flange", "Rib", "Thru-hole"]
    a = text.texts
    assert one(spark, retrieval.anchors(a(["s"]), a(["s", "x"]), a(["x", "y", "s"]))) == ["s", "x", "x", "y"]


RULES = (("F1", "Weld", ("weld", "Seam"), ("焊接", "weld")), ("D1", "Bend", ("bend",), ("折彎",)), ("X1", "Never", (), ()))


def test_inference(spark):
    rows = [
        (1, "A weld\nBend seen\nWeld symbol detected: False", "WELD here", ["d1"]),
        (2, "Weld symbol detected: No\nbend found: false", None, None),
        (3, "bend and weld and seam", "焊接", ["WELD", "bend"]),
    ]
    docs = spark.createDataFrame(rows, "id int, description string, notes string, priors array<string>")
    found = [(r["id"], r["process_id"], r["confidence"], r["source"]) for r in rules.infer(docs, RULES, ["id"]).orderBy("id", "rank").collect()]
    assert found == [(1, "F1", 1.0, "COMBINED"), (1, "D1", 0.8, "VLM"), (3, "F1", 1.0, "COMBINED"), (3, "D1", 0.8, "VLM")]


@pytest.mark.parametrize(
    "context, want",
    [
        ("需要點焊，材料 SUS304，M6 攻牙", ["scan_weld_symbols", "scan_thread_marks"]),
        ("平板烤漆黑色，無折彎", ["scan_bend_lines", "scan_surface_marks"]),  # a negated word still counts
        ("migration of a staple", ["scan_weld_symbols", "scan_thread_marks"]),  # so does a part of a word
        ("m６ x", ["scan_thread_marks"]),  # full-width digits are digits
        ("  ", []),
        (None, []),
    ],
)
def test_skills(spark, context, want):
    assert of(spark, rules.skills, context) == want


def test_described(spark):
    assert one(spark, rules.described(text.texts(["scan_holes", "other"]))) == "孔洞掃描, other"


def test_parent_context(spark):
    rows = spark.createDataFrame([("SUS 304 for ASML in Japan, class 10, mask, CR3",), ("material only",), (None,)], "text string")
    first, second, third = rules.parent_context(rows).collect()
    assert (first["material"], first["customer"], first["cleanroom"]) == ("白鐵", "ASML", "detected")
    assert first["specials"] == ["三價鉻", "不烤漆"] and {"H26", "H32", "H33", "H34", "Q07"} <= set(first["triggered"])
    assert second["material"] == "鋁板"  # "al" is in "material"
    assert third["triggered"] == sorted(fixed.DEFAULT_PROCESSES)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("A plate 110 mm by 4-mm, about 30 wide, ±0.1, R3, M6, 45°", "A plate by , about wide, , , ,"),
        ("M8x1.25", "M8x1.25"),  # no word boundary within
        ("text [END OF REPORT] more", "text"),
        ("### 4. x\n### 5. y", "### 4. x"),
        ("a  \t b", "a b"),
    ],
)
def test_cleaning(spark, raw, want):
    assert of(spark, text.cleaned, raw) == want


def test_repeats_are_cut_in_the_third_section(spark):
    again = "### 3. This sentence is long enough. Another one that is long. <green>This sentence</green> is long enough. Tail"
    assert of(spark, text.without_repeats, again) == "### 3. This sentence is long enough. Another one that is long."
    assert of(spark, text.without_repeats, "no section here. no section here.") == "no section here. no section here."
    assert of(spark, text.without_repeats, None) is None


def test_issues(spark):
    good = "### 1. A flange of some length\n### 2. True\n### 3. " + "words " * 10
    assert of(spark, text.issues, good) == []
    assert of(spark, text.issues, "short") == [fixed.TOO_SHORT] and of(spark, text.issues, None) == [fixed.TOO_SHORT]
    bad = "1. nothing\n2. maybe\n" + "words " * 20
    assert of(spark, text.issues, bad) == ["缺少 Section 3", fixed.NO_VERDICT, fixed.NO_TERM]


def test_selections(spark):
    report = "### 4. PROCESS SELECTION\n- [D01] Fold: two flanges\n• [E-2] Weld ：seam\nno line\n### 5. x\n- [Z9] no: no"
    assert [tuple(r) for r in of(spark, text.selections, report)] == [("D01", "Fold", "two flanges"), ("E-2", "Weld", "seam")]
    assert of(spark, text.selections, "### 3. x") == []


def test_answers(spark):
    got = of(spark, text.answer, "Answer: no\nanswer: YES\nreason: a: b\nconfidence: sure")
    assert tuple(got) == (True, "a: b", "medium")
    assert tuple(of(spark, text.answer, "nothing")) == (False, "nothing", "medium")


def test_small_text_functions(spark):
    assert of(spark, text.coloured, "<red>x</red> y") == ":red[**x**] y" and of(spark, text.coloured, None) == ""
    assert of(spark, text.without_tags, "<green>a</green>b") == "ab"
    assert of(spark, text.review_count, "<orange>a</orange><red>b</red><green>c</green>") == 2
    assert of(spark, text.has_dimension, "T1.5 plate") and not of(spark, text.has_dimension, "a plain plate")
    assert of(spark, text.note_icon, "Caution") == "⚠️" and of(spark, text.is_note, "※ see") and not of(spark, text.is_note, "plain")
    assert one(spark, text.first_filled("a", "b"), a="", b="x") == "x" and one(spark, text.first_filled("a", "b"), a=None, b="") == ""
    assert one(spark, text.parent_report(F.lit(" N "), F.lit(""), F.lit("s"), text.texts(["a", "b"]))) == "零件名稱：N / 結構：s / 特徵：a, b"
    assert of(spark, text.safe_name, "a/b\\c d") == "a_b_c_d" and of(spark, text.file_name, "x/y.pdf") == "y.pdf"
    assert one(spark, text.view_context(text.texts([]))) == ""


words = st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta", "eta"]), max_size=6).map(" ".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=12))
def test_jaccard_is_symmetric_and_bounded(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    a, b = text.tokens(F.col("a")), text.tokens(F.col("b"))
    for x, y in rows.select(text.jaccard(a, b), text.jaccard(b, a)).collect():
        assert x == y and 0 <= x <= 1


def test_differences_and_rates(spark):
    rows = [(1, ["f01 ", "D01", "F01", ""], ["F01", "E02"]), (2, [], ["A1"]), (3, ["B1"], []), (4, None, None)]
    found = evaluate.differences(spark.createDataFrame(rows, "seq int, predicted array<string>, truth array<string>"))
    got = [(r["missing"], r["wrong"]) for r in found.orderBy("seq").collect()]
    assert got == [(["E02"], ["D01"]), (["A1"], []), ([], ["B1"]), ([], [])]
    rates = evaluate.rates(found).first()
    assert tuple(rates) == (4, round((0.5 + 1) / 4, 4), round((0.25 + 1) / 4, 4))  # of the raw list, repeats and blanks included
    assert [tuple(r) for r in evaluate.most_common(found, "missing").collect()] == [("E02", 1), ("A1", 1)]
    assert evaluate.listing(evaluate.most_common(found, "missing")).first()[0] == "A1（1次）、E02（1次）"
    assert evaluate.rates(found.limit(0)).first()[0] == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc "), max_size=4), st.lists(st.sampled_from("ABd"), max_size=4)), min_size=1, max_size=8))
def test_missing_and_wrong_are_disjoint(spark, pairs):
    rows = spark.createDataFrame(pairs, "predicted array<string>, truth array<string>")
    for r in evaluate.differences(rows).collect():
        assert not set(r["missing"]) & set(r["wrong"])


def test_improvement(spark):
    v = "array<double>"
    rows = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8], [0.0, 1.0]), (None, None, [0.0, 1.0]), ([0.0, 1.0], [1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0], None)], f"a {v}, b {v}, c {v}")
    got = [r[0] and tuple(r[0]) for r in rows.select(evaluate.improvement(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [(1.0, 0.2, 0.8), (1.0, 1.0, 0.0), (0.0, 1.0, 0.0), None]


def test_store_stats_of_an_empty_store(spark):
    rows = spark.createDataFrame([], "image_hash string, description string, reasoning string, timestamp string")
    assert evaluate.store_stats(rows).first()["total_entries"] == 0
    rows = spark.createDataFrame([("h", "", "abc", "2"), ("", "abcde", "", "1"), ("h", None, None, "")], rows.schema)
    assert tuple(evaluate.store_stats(rows).first()) == (3, 1, 3, "1", "2")


STATE = "entry_id string, seq long, image_hash string, description string, tags array<string>, timestamp string, updated_at string, version_count int, status string, superseded_by string"


def test_upsert(spark):
    state = spark.createDataFrame([("a", 1, "h", "old", ["t"], "0", None, 1, None, None), ("b", 2, "h", "newer", ["t"], "0", None, 3, None, None), ("c", 3, "k", "keep", None, "0", None, 1, None, None)], STATE)
    batch = spark.createDataFrame([("x", 10, "h", "one", []), ("y", 11, "h", "two", ["n"]), ("z", 12, "m", "fresh", []), ("w", 13, "m", "again", [])], "entry_id string, seq long, image_hash string, description string, tags array<string>")
    found = {r["entry_id"]: r for r in store.upsert(state, batch, "now").collect()}
    assert set(found) == {"a", "b", "c", "z"}
    assert (found["a"]["status"], found["a"]["superseded_by"], found["a"]["description"]) == ("superseded", "b", "old")
    assert (found["b"]["description"], found["b"]["version_count"], found["b"]["tags"], found["b"]["updated_at"], found["b"]["timestamp"]) == ("two", 5, ["n"], "now", "0")
    assert found["c"]["updated_at"] is None and found["z"]["version_count"] == 2 and found["z"]["description"] == "again"
    again = store.upsert(store.upsert(state, batch.limit(0), "now"), batch.limit(0), "now")
    assert sorted(map(str, again.collect())) == sorted(map(str, state.collect()))


def test_update_delete_export(spark):
    state = spark.createDataFrame([("a", "d", "r", None), ("b", "e", "s", None)], "entry_id string, description string, reasoning string, updated_at string")
    patched = {r["entry_id"]: tuple(r) for r in store.describe(state, spark.createDataFrame([("a", "new")], "entry_id string, description string"), "now").collect()}
    assert patched == {"a": ("a", "new", "new", "now"), "b": ("b", "e", "s", None)}
    assert [r["entry_id"] for r in store.delete(state, state.where("entry_id = 'a'")).collect()] == ["b"]
    log = spark.createDataFrame([("p1", "d", ["A"], [], ["B"]), ("p2", "d", [], [], []), ("gone", "d", ["A"], [], [])], "image_path string, description string, ground_truth array<string>, missing array<string>, wrong array<string>")
    out = store.exported(log, spark.createDataFrame([("p1",), ("p2",)], "path string")).collect()
    assert [r["image_path"] for r in out] == ["p1"] and out[0]["reasoning"] == "[Shadow Test] ground_truth=[A]  missing=[]  wrong=[B]"


BOX = "d int, number int, x int, y int, w int, h int"


@pytest.mark.parametrize(
    "given_boxes, want",
    [
        ([(0, 0, 5, 5)], ["Unknown"]),
        ([(0, 9, 5, 5), (0, 0, 5, 5)], ["Front", "Top"]),
        ([(0, 0, 10, 10), (0, 50, 10, 10), (50, 50, 40, 40)], ["Top", "Front", "Iso"]),
        ([(0, 0, 10, 10), (0, 50, 10, 10), (50, 0, 10, 10), (50, 50, 10, 10)], ["Top", "Front", "Side", "Iso"]),
        ([(0, 0, 10, 10), (0, 50, 10, 10), (50, 0, 10, 10), (50, 50, 10, 10), (60, 60, 20, 20)], ["Top", "Front", "Side", "Unknown", "Iso"]),
    ],
)
def test_views(spark, given_boxes, want):
    rows = spark.createDataFrame([(1, i, *b) for i, b in enumerate(given_boxes)], BOX)
    assert [r["view"] for r in boxes.labelled_views(rows, "d").orderBy("number").collect()] == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(0, 20), st.integers(1, 15), st.integers(1, 15), st.integers(0, 5)), min_size=1, max_size=25))
def test_suppression(spark, rows):
    hits = spark.createDataFrame([(d, i, x, y, w, h, float(s)) for i, (d, x, y, w, h, s) in enumerate(rows)], f"{BOX}, score double")
    found = boxes.suppressed(hits, "d", 0.5, None)
    kept = [tuple(r) for r in found.collect()]
    want = []
    for r in sorted((tuple(r) for r in hits.collect()), key=lambda r: (r[0], -r[6], r[1])):
        if all(boxes.overlap(r[2:6], k[2:6]) < 0.5 for k in want if k[0] == r[0]):
            want.append(r)
    assert sorted(k[:7] for k in kept) == sorted(want)
    assert sorted(r[:7] for r in map(tuple, boxes.suppressed(found.drop("rank"), "d", 0.5, None).collect())) == sorted(want)


def test_overlap_at_the_threshold_is_suppressed(spark):
    hits = spark.createDataFrame([(1, 1, 0, 0, 2, 1, 0.9), (1, 2, 0, 0, 1, 1, 0.8)], f"{BOX}, score double")
    assert [r["number"] for r in boxes.suppressed(hits, "d").collect()] == [1]
    assert spark.range(1).select(boxes.iou({k: F.lit(v) for k, v in zip("xywh", (0, 0, 2, 1))}, {k: F.lit(v) for k, v in zip("xywh", (0, 0, 1, 1))})).first()[0] == 0.5  # noqa: B905


def test_gaps(spark):
    ratio = [1.0] * 7 + [0.0] + [1.0] * 8 + [0.0] * 2 + [0.96] * 9
    profile = spark.createDataFrame([("r", i, r) for i, r in enumerate(ratio)], "axis string, i long, ratio double")
    found = boxes.gaps(profile, "axis")
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(8, 16), (18, 27)]
    cells = boxes.bounds(found, spark.createDataFrame([("r", 27)], "axis string, total long"), "axis")
    assert sorted((r["begin"], r["until"]) for r in cells.collect()) == [(0, 12), (12, 22), (22, 27)]


def test_box_geometry(spark):
    points = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((3, 9), (7, 2), (5, 5))])
    assert tuple(one(spark, boxes.polygon_box(points))) == (3, 2, 4, 7)
    assert one(spark, boxes.normalised(F.lit(150), F.lit(100))) == 1.0
    view, sure = boxes.verified(F.lit("Top"), F.lit(0.5), F.lit(None).cast("string"))
    assert one(spark, view) == "Top" and one(spark, sure) == 0.5
    ratios = boxes.white_ratios(spark.createDataFrame([(1, bytes([255, 0, 255, 255]))], "k int, content binary"), "k", lambda b: np.frombuffer(b, np.uint8).reshape(2, 2))
    assert sorted((r["axis"], r["i"], r["ratio"]) for r in ratios.collect()) == [("column", 0, 1.0), ("column", 1, 0.5), ("row", 0, 0.5), ("row", 1, 1.0)]


def test_groups(spark):
    names = ["A-1.pdf", "A-1-人類未加註.pdf", "A-1-人類加註.pdf", "A-10.pdf", "a-10_top.png", "A-1_front.JPG", "Lone-左側視圖.png", "Lone_ISO2.tif", "notes.txt"]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r["group_id"]: (r["parent"], r["children"]) for r in groups.discover(files).collect()}
    assert found == {"A-1": ("A-1-人類未加註.pdf", ["A-1_front.JPG"]), "A-10": ("A-10.pdf", ["a-10_top.png"]), "Lone": (None, ["Lone-左側視圖.png", "Lone_ISO2.tif"])}
    assert [tuple(r) for r in groups.groups_of_path(files, "A-10.pdf").collect()] == [("A-10", "A-10.pdf", [])]
    assert groups.groups_of_path(files, "notes.txt").collect() == []
    assert groups.longest_prefix(files, "name", files.limit(0).select(F.col("name").alias("prefix"))).where("prefix IS NOT NULL").count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([(["e"],), ([],), (None,)], "errors array<string>")
    assert tuple(reports.batch_report(rows).first()) == (3, 1, 2)
    lines = spark.createDataFrame([("d", 0, 1, "b"), ("d", 0, 0, "a"), ("d", 1, 0, "c"), ("e", 0, 0, "x")], "d string, page int, line int, text string")
    assert {r["d"]: r["text"] for r in reports.pages_joined(lines, "d").collect()} == {"d": "[page 0]\na\nb\n[page 1]\nc", "e": "x"}
    scores = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "s double")
    assert scores.where(reports.finite("s")).count() == 1


def test_providers_isolate_errors(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "fail now"), (3, " "), (4, None)], "id int, t string")
    found = {r["id"]: (r["out"], r["error"]) for r in providers.apply(rows, "t", providers.stand_in_model(), "out", "string").collect()}
    assert found[1] == ("described: ok", None) and found[3] == found[4] == (None, None)
    assert found[2] == (None, "ValueError: the stand-in was told to fail")
    vectors_ = providers.apply(rows, "t", providers.stand_in_embedder(4), "v", "array<double>")
    assert vectors_.where("id = 1").select(F.round(vectors.norm(F.col("v")), 6)).first()[0] == 1.0
    asked = providers.ask_agents(rows.where("id = 1"), "id", "t", {"a": providers.stand_in_model("A {}"), "b": providers.stand_in_model("B {}")})
    assert asked.first()["answers"] == {"a": "A ok", "b": "B ok"}


def test_json_stores(spark, tmp_path):
    path = tmp_path / "kb.json"
    path.write_text(json.dumps([{"id": "x", "image_hash": "h", "features": {"raw_vlm_description": "d"}, "tags": ["t"]}, {"_type": "view_corrections", "records": []}, {"id": "y"}]))
    found = tables.cases(spark, str(path)).select("seq", "entry_id", "features.raw_vlm_description").collect()
    assert [tuple(r) for r in found] == [(0, "x", "d"), (2, "y", None)]
    path.write_text("{broken")
    assert tables.cases(spark, str(path)).count() == 0 and tables.cases(spark, str(tmp_path / "none.json")).count() == 0
    assert tables.shadow_log(spark, str(tmp_path / "none.json")).count() == 0
    path.write_text(json.dumps({"F01": {"name": "Weld", "trigger_vlm": ["weld"]}}))
    assert tables.rule_catalogue(spark, str(path)) == [("F01", "Weld", ["weld"], [])]
    path.write_text("{}")
    with pytest.raises(ValueError):
        tables.rule_catalogue(spark, str(path))


def test_tables(spark, tmp_path):
    folder = str(tmp_path / "state")
    tables.replace(spark.range(3).toDF("n"), folder)
    tables.replace(tables.current(spark, folder).where("n > 0"), folder)
    assert tables.current(spark, folder).count() == 2
    for name in ("b.PNG", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    listed = tables.listing(spark, str(tmp_path))
    assert [r["name"] for r in listed.collect()] == ["a.pdf", "b.PNG"]
    assert tables.guide(spark, str(tmp_path / "none"), str(tmp_path / "c.txt")) == "x" and tables.guide(spark, str(tmp_path / "none")) == ""


def test_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    query = shadow.append_to(shadow.windowed(shadow.read(spark, folder, events.schema), "ts", "event_type", "value"), out, str(tmp_path / "check"))
    query.awaitTermination(120)
    closed = spark.read.parquet(out)
    whole = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    joined = closed.join(whole.select(F.col("w.start").alias("start"), "event_type", F.col("n").alias("m")), ["start", "event_type"])
    assert joined.count() == closed.count() and joined.where("n <> m").count() == 0
