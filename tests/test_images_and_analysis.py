"""Image operators on drawn images, and the analysis chain with stand-in providers."""

import json

import numpy as np
from pyspark.sql import functions as F

from casequarry.functions import text
from casequarry.operators import analysis, boxes, images, providers

SIDE = 200


def decoder():
    """A decoder made here, so that it travels to the executors by value."""

    def decode(content):
        return np.frombuffer(content, np.uint8).reshape(200, 200)

    return decode


def drawing(*ink):
    page = np.full((SIDE, SIDE), 255, np.uint8)
    for x, y, w, h in ink:
        page[y : y + h, x : x + w] = 0
    return page


def test_symbols_are_found_at_any_scale(spark):
    rng = np.random.default_rng(2)
    symbol = rng.integers(0, 255, (30, 30)).astype(float)
    page = drawing().astype(float)
    page[20:50, 100:130] = symbol
    page[150:165, 30:45] = images.shrunk(symbol, 15, 15)
    rows = spark.createDataFrame([(1, page.astype(np.uint8).tobytes()), (2, drawing().tobytes())], "k long, content binary")
    found = [(r["k"], r["name"], r["x"], r["y"], r["w"]) for r in images.match_symbols(rows, "k", {"mark": symbol}, decoder(), 0.8).orderBy("rank").collect()]
    assert found == [(1, "mark", 100, 20, 30), (1, "mark", 30, 150, 15)]


def test_correlation_is_that_of_numpy():
    rng = np.random.default_rng(3)
    target, template = rng.normal(size=(12, 15)), rng.normal(size=(4, 5))
    scores = images.correlation(target, template)
    assert scores.shape == (9, 11)
    assert np.isclose(scores[3, 4], np.corrcoef(target[3:7, 4:9].ravel(), template.ravel())[0, 1])
    assert not images.correlation(np.ones((9, 9)), template).any()


def test_views_by_white_bands_and_by_pieces(spark):
    banded = drawing((5, 5, 80, 80), (110, 5, 85, 80), (5, 110, 80, 85))
    pieces = np.zeros((SIDE, SIDE), bool)
    pieces[10:20, 10:60] = pieces[19:30, 59:70] = pieces[100:110, 5:9] = True
    assert images.component_boxes(pieces) == [(10, 10, 60, 20), (5, 100, 4, 10)]
    assert images.grown(pieces, 3)[12, 7] and not images.grown(pieces, 3)[12, 6]
    rows = spark.createDataFrame([(1, banded.tobytes())], "k long, content binary")
    found = [(r["x"], r["y"], r["w"], r["h"]) for r in images.detect_views(rows, "k", decoder()).collect()]
    assert len(found) == 4 and found[0][:2] == (0, 0)
    diagonal = drawing(*[(i, i, 30, 30) for i in range(0, 60, 5)], *[(110 + i, 190 - i - 40, 30, 30) for i in range(0, 60, 5)])
    assert len(images.view_boxes(diagonal)) >= 1
    assert images.otsu(diagonal) < 255


def test_collage():
    a, b = np.full((2, 3, 3), 7, np.uint8), np.full((4, 2, 4), 9, np.uint8)
    out = images.collage([a, b])
    assert out.shape == (8, 6, 3) and out[0, 0, 0] == 7 and out[3, 4, 0] == 9 and not out[4:].any()
    assert images.collage([a]) is a


CASES = "entry_id string, seq long, image_hash string, description string, status string, image_vec array<double>, text_vec array<double>, correct_processes array<string>"
RULES = (("F1", "Weld", ("weld",), ("焊接",)), ("D1", "Bend", ("flange",), ()))


def test_analysis(spark):
    cases = spark.createDataFrame([("a", 1, "h1", "stored words", None, None, None, ["F1"]), ("b", 2, "h2", "### 3. weld with flange near corner edges", None, None, None, ["D1"])], CASES)
    requests = spark.createDataFrame([("r1", "h1", "", ""), ("r2", "x", "weld needed", None), ("r3", "y", "", None), ("r4", None, "", "焊接 plan")], "request_id string, image_hash string, notes string, parent_text string")
    asked = []

    def model():
        def describe(prompt):
            asked.append(prompt)
            if "needed" in prompt:
                return "weld with flange near corner edges 10 mm" + (" again" if "Similar case" in prompt else "")
            if "焊接" in prompt:
                raise TimeoutError("no answer")
            return "plain"

        return describe

    def no_embedding():
        return lambda value: None

    found = {r["request_id"]: r for r in analysis.analyse(requests, cases, RULES, model, no_embedding).collect()}
    assert found["r1"]["description"] == "stored words" and found["r1"]["match_type"] == "exact_hash" and found["r1"]["warnings"] == [analysis.CACHED] and found["r1"]["inferences"] == []
    assert found["r2"]["first_description"] == "weld with flange near corner edges" and found["r2"]["description"].endswith("again")
    assert found["r2"]["match_type"] == "text_keyword" and found["r2"]["reference"] == "b"
    assert [tuple(p) for p in found["r2"]["inferences"]] == [("D1", 0.8), ("F1", 0.7)]
    assert found["r3"]["description"] == "plain" and found["r3"]["warnings"] and found["r3"]["inferences"] == []
    assert found["r4"]["error"] == "TimeoutError: no answer" and found["r4"]["description"] is None
    assert sum(map(len, analysis.AGENT_CODES.values())) == 33


def test_anchors(spark):
    row = spark.createDataFrame([("需要點焊, a hole",)], "t string")
    assert row.select(analysis.anchored(F.col("t"))).first()[0] == ["[System] Detected Weld Symbol", "[System] Detected Hole / Thru-hole"]


def test_small_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(text.title(F.lit(""), F.lit("d" * 50))) == "d" * 40 and one(text.title(F.lit(None).cast("string"), F.lit(""))) == "(untitled)"
    assert one(text.view_role(F.lit("front left"))) == "supporting" and one(text.view_role(F.lit("front left"), exact=False)) == "primary"
    assert one(text.normalised(F.lit(""), F.lit(" A "))) == "a" and one(text.short_label(F.lit("Top（上）"))) == "Top"
    assert one(text.page_labels(F.lit("n"), F.lit(2))) == ["n (page 1)", "n (page 2)"] and one(text.page_labels(F.lit("n"), F.lit(1))) == ["n"]
    assert [tuple(p) for p in one(text.paired(text.texts(["a", "b"]), text.texts(["x"])))] == [("a", "x")]
    assert one(text.data_uri(F.lit(b"x"))) == "data:image/png;base64,eA==" and one(text.entry_id(F.lit("2026-01-02 03:04:05").cast("timestamp"), F.lit("a.b.png"))) == "20260102_030405_a"
    assert one(text.doubtful(F.lit("<orange>o</orange><red>r</red>"))) == ["r", "o"]
    assert one(boxes.valid_region(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(1.0))) and not one(boxes.valid_region(F.lit(0.5), F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    assert tuple(one(boxes.page_size(F.lit(144.0), 300))) == (144.0, 2.0, 600) and one(boxes.worth_cropping(F.lit(13), F.lit(10), F.lit(0)))
    lines = spark.createDataFrame([([[3, 9], [7, 2]], 0.5), ([[0, 0]], 0.4)], "polygon array<array<int>>, confidence double")
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in boxes.moved(boxes.recognised(lines), 10, 0).collect()] == [(13, 2, 4, 7)]
    views = spark.createDataFrame([("d", 1, "Iso", 0.654, "d-01_Iso.png", 1, 2, 3, 4)], "drawing string, view_number int, view string, confidence double, file_name string, x int, y int, w int, h int")
    listed = json.loads(boxes.view_metadata(views, "drawing").first()["metadata"])
    assert listed == {"source": "d", "total_views": 1, "views": [{"index": 1, "label": "Iso", "role": "supporting", "filename": "d-01_Iso.png", "confidence": 0.65, "bbox": [1, 2, 3, 4]}]}
    assert providers.stand_in_embedder(3)()("x") == providers.stand_in_embedder(3)()("x")
