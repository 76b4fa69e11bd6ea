"""Drawings of few boxes against numpy, and the same ones by tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casequarry.operators import images, rasters, sketches

WIDTH, HEIGHT = 200, 150


@pytest.fixture(scope="module")
def drawings():
    rng = random.Random(8)
    some = lambda n: [(rng.randrange(-5, WIDTH - 40), rng.randrange(-5, HEIGHT - 30), rng.randrange(1, 40), rng.randrange(1, 30)) for _ in range(n)]
    corners = [(10, 10, 5, 5), (15, 15, 5, 5), (21, 15, 2, 2), (63, 63, 1, 1), (64, 64, 1, 1), (64, 62, 1, 1)]
    odd = [(10, 10, 0, 5), (10, 10, None, 5), (-9, 3, 4, 4), (150, 120, 50, 30), (150, 120, 50, 30)]
    return {i: some(n) for i, n in enumerate((1, 2, 3, 4, 7, 20, 30))} | {50: corners, 51: odd, 52: [(0, 0, WIDTH, HEIGHT)]}


@pytest.fixture(scope="module")
def boxes(spark, drawings):
    rows = [(d, *b) for d, of in drawings.items() for b in of] + [(None, 1, 1, 5, 5)]
    return spark.createDataFrame(rows, "d long, x long, y long, w long, h long").cache()


@pytest.fixture(scope="module")
def ink(drawings):
    out = {}
    for d, of in drawings.items():
        out[d] = np.zeros((HEIGHT, WIDTH), bool)
        for x, y, w, h in (b for b in of if None not in b):
            out[d][max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = True
    return out


def sizes(spark, drawings):
    return spark.createDataFrame([(d, WIDTH, HEIGHT) for d in [*drawings, 99]] + [(98, 0, 9)], "d long, width int, height int")


@pytest.mark.parametrize("few", [1000, 5, 0])
def test_pieces(spark, boxes, ink, few):
    found = sorted((r["d"], r["x"], r["y"], r["w"], r["h"]) for r in sketches.components(boxes, "d", few).collect())
    assert found == sorted((d, *b) for d, drawn in ink.items() for b in images.component_boxes(drawn))


@pytest.mark.parametrize("few", [1000, 12, 0])
def test_inks(spark, boxes, drawings, ink, few):
    rng = random.Random(9)
    windows = [(d, f"w{i}", x, y, rng.randrange(0, WIDTH - x + 1), rng.randrange(0, HEIGHT - y + 1)) for d in [*drawings, 99] for i, (x, y) in enumerate([(0, 0), (64, 64), *[(rng.randrange(WIDTH), rng.randrange(HEIGHT)) for _ in range(5)]])]
    df = spark.createDataFrame(windows, "d long, k string, x int, y int, w int, h int")
    found = sorted((r["d"], r["k"], r["w"], r["h"], r["ink"]) for r in sketches.inks(df, boxes, sizes(spark, drawings), "d", "k", few).collect())
    assert found == sorted((d, k, w, h, int(ink[d][y : y + h, x : x + w].sum()) if d in ink else 0) for d, k, x, y, w, h in windows)


@pytest.mark.parametrize("few", [1000, 5, 0])
def test_cells(spark, boxes, drawings, ink, few):
    found = sorted((r["d"], r["x"], r["y"], r["w"], r["h"]) for r in sketches.projection_cells(boxes, sizes(spark, drawings), "d", few=few).collect())
    blank = np.zeros((HEIGHT, WIDTH), bool)
    assert found == sorted((d, *b) for d in [*drawings, 99] for b in images.projection_boxes(np.where(ink.get(d, blank), 0, 255)))


def test_nothing_drawn(spark, boxes, drawings):
    none = boxes.limit(0)
    assert sketches.components(none, "d").collect() == [] and len(sketches.projection_cells(none, sizes(spark, drawings), "d").collect()) == 4 * (len(drawings) + 1)
    assert sketches.inks(none.withColumn("k", F.lit(1)), none, sizes(spark, drawings), "d", "k").collect() == []


@pytest.mark.parametrize("name", ["q68_components", "q69_summed_areas", "q70_projection_cells"])
def test_ink_of_small_drawings_is_not_dealt(spark, small, name, monkeypatch):
    """No row of pixels, and no tile, of drawings of a few boxes."""
    from casequarry.plans import drawings as plans

    monkeypatch.setattr(rasters, "painted", None)
    assert "Window [" not in plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
