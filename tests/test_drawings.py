"""Drawings as tables, contraction and histograms, against numpy on small drawings."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from casequarry.operators import histograms, images, rasters
from casequarry.operators.contraction import roots

WIDTH, HEIGHT = 200, 150


def drawn(boxes):
    ink = np.zeros((HEIGHT, WIDTH), bool)
    for x, y, w, h in boxes:
        if None not in (x, y, w, h) and w > 0 and h > 0:
            ink[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = True
    return ink


def spiral(step=6):
    """Thin lines that wind through all tiles: one piece whose parts meet only far away."""
    x0, y0, x1, y1, out = 0, 0, WIDTH, HEIGHT, []
    while x1 - x0 > 2 * step and y1 - y0 > 2 * step:
        out += [(x0, y0, x1 - x0, 1), (x1 - 1, y0, 1, y1 - y0), (x0, y1 - 1, x1 - x0, 1), (x0, y0 + step, 1, y1 - y0 - step)]
        out.append((x0, y0 + step, step + 1, 1))
        x0, y0, x1, y1 = x0 + step, y0 + step, x1 - step, y1 - step
    return out


@pytest.fixture(scope="module")
def drawings():
    rng = random.Random(5)
    few = [(rng.randrange(-5, WIDTH), rng.randrange(-5, HEIGHT), rng.randrange(1, 30), rng.randrange(1, 20)) for _ in range(25)]
    corners = [(63, 63, 1, 1), (64, 64, 1, 1), (64, 62, 1, 1), (127, 64, 1, 1), (128, 63, 1, 1), (0, 100, 64, 1), (64, 101, 64, 1)]
    dots = [(rng.randrange(WIDTH), rng.randrange(HEIGHT), 1, 1) for _ in range(3000)]
    odd = [(10, 10, 0, 5), (10, 10, None, 5), (-9, 3, 4, 4), (190, 140, 50, 50), (190, 140, 50, 50)]
    return {1: few, 2: corners, 3: spiral(), 4: dots, 5: odd}


@pytest.fixture(scope="module")
def words(spark, drawings):
    rows = [(d, *b) for d, boxes in drawings.items() for b in boxes] + [(None, 1, 1, 5, 5)]
    df = spark.createDataFrame(rows, "d long, x long, y long, w long, h long").withColumn("rows", F.lit("clash"))
    return rasters.painted(df, "d", WIDTH, HEIGHT).cache()


def sizes(spark, drawings):
    return spark.createDataFrame([(d, WIDTH, HEIGHT) for d in [*drawings, 9]], "d long, width int, height int")


def test_pieces_meet_over_tiles(words, drawings):
    found = sorted((r["d"], r["x"], r["y"], r["w"], r["h"]) for r in rasters.components(words, "d").collect())
    assert found == sorted((d, *b) for d, boxes in drawings.items() for b in images.component_boxes(drawn(boxes)))
    assert sum(r[0] == 3 for r in found) == 1


def test_ink_in_windows(spark, words, drawings):
    rng = random.Random(6)
    windows = [(d, i, x, y, rng.randrange(0, WIDTH - x + 1), rng.randrange(0, HEIGHT - y + 1)) for d in [*drawings, 9] for i, (x, y) in enumerate([(0, 0), (64, 64), *[(rng.randrange(WIDTH), rng.randrange(HEIGHT)) for _ in range(30)]])]
    windows += [(d, 99, 0, 0, WIDTH, HEIGHT) for d in drawings]
    df = spark.createDataFrame(windows, "d long, k int, x int, y int, w int, h int")
    found = {(r["d"], r["k"]): r["ink"] for r in rasters.ink_in(df, rasters.areas(words, sizes(spark, drawings), "d"), "d", "k").collect()}
    ink = {d: drawn(boxes) for d, boxes in drawings.items()}
    assert found == {(d, k): int(ink[d][y : y + h, x : x + w].sum()) if d in ink else 0 for d, k, x, y, w, h in windows}


def test_projection_cells(spark, words, drawings):
    found = sorted((r["d"], r["x"], r["y"], r["w"], r["h"]) for r in rasters.projection_cells(words, sizes(spark, drawings), "d").collect())
    expected = [(d, *b) for d in [*drawings, 9] for b in images.projection_boxes(np.where(drawn(drawings.get(d, [])), 0, 255))]
    assert found == sorted(expected)


def test_nothing_painted(spark, words):
    none = words.limit(0)
    assert rasters.components(none, "d").collect() == []
    assert rasters.areas(none, spark.createDataFrame([], "d long, width int, height int"), "d").collect() == []


@pytest.mark.parametrize("shape", ["path", "star", "pairs", "none"])
def test_contraction(spark, shape):
    links = {"path": [(i, i + 1) for i in range(500)], "star": [(0, i) for i in range(1, 300)] * 2, "pairs": [(2 * i, 2 * i + 1) for i in range(50)] + [(7, 7)], "none": []}[shape]
    found = roots(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["id"])
    assert sorted(map(len, groups.values())) == {"path": [501], "star": [300], "pairs": [2] * 50, "none": []}[shape]
    assert all(root in ids for root, ids in groups.items()) and len(found) == len({r["id"] for r in found})


def test_otsu_and_medians(spark):
    rng = random.Random(7)
    rows = [(g, rng.randrange(256), rng.choice([-(10**12), 3, 4, rng.randrange(-(10**13), 10**13)])) for g in (1, 1, 1, 1, 2, 3) for _ in range(101)] + [(4, 9, 5), (4, 9, 8), (5, None, None), (None, 1, 1)]
    df = spark.createDataFrame(rows, "g int, level int, v long")
    by = lambda i, g: [r[i] for r in rows if r[0] == g and r[i] is not None]
    assert {r["g"]: r["threshold"] for r in histograms.otsu(df, "g").collect()} == {g: images.otsu(np.array(by(1, g))) for g in (1, 2, 3, 4)}
    assert {r["g"]: (r["n"], r["median"]) for r in histograms.medians(df, "g", "v").collect()} == {g: (len(by(2, g)), statistics.median(by(2, g))) for g in (1, 2, 3, 4)}
    assert histograms.medians(df.limit(0), "g", "v").collect() == []


def test_no_window_holds_a_drawing(spark, words, drawings):
    plan = rasters.areas(words, sizes(spark, drawings), "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan and "CartesianProduct" not in plan
    parts = [line.split("], [")[1] for line in plan.splitlines() if "Window [" in line]
    assert parts and all("ty#" in p or "tx#" in p for p in parts)
