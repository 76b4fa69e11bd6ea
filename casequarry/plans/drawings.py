"""Queries over drawings painted from the lines of orders, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.operators import histograms, rasters, sketches
from casequarry.plans.queries import _BOXES_SQL, _boxes
from casequarry.sources.tables import table

WIDTH, HEIGHT = 152, 107


def _sizes(boxes: DataFrame) -> DataFrame:
    return boxes.select("l_orderkey").distinct().select("l_orderkey", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def q68_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ink of every order's drawing, and how many of each box."""
    found = sketches.components(_boxes(spark, sf_dir), "l_orderkey")
    return found.groupBy("l_orderkey", "x", "y", "w", "h").agg(F.count("*").alias("n"))


def q69_summed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ink about every box, 5 pixels wider on each side, and what follows from it for white and correlation."""
    boxes = _boxes(spark, sf_dir)
    left, top = F.greatest(F.col("x") - 5, F.lit(0)), F.greatest(F.col("y") - 5, F.lit(0))
    windows = boxes.select("l_orderkey", "number", left.alias("x"), top.alias("y"), (F.least(F.col("x") + F.col("w") + 5, F.lit(WIDTH)) - left).alias("w"), (F.least(F.col("y") + F.col("h") + 5, F.lit(HEIGHT)) - top).alias("h"))
    inks = sketches.inks(windows, boxes, _sizes(boxes), "l_orderkey", "number")
    found = rasters.spreads(inks, F.col("w") * F.col("h"))
    return found.select("l_orderkey", "number", "ink", F.round("white", 6).alias("white"), F.round("spread", 6).alias("spread"))


def q70_projection_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return sketches.projection_cells(boxes, _sizes(boxes), "l_orderkey")


def q71_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pixels of drawings, of which the first lines of all orders, half of all rows, are one: Otsu's level and the median price."""
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") <= 2, F.lit(0).cast("long")).otherwise(F.col("l_orderkey")).alias("drawing"), (F.col("l_partkey") % 256).alias("level"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return histograms.otsu(lines, "drawing").join(histograms.medians(lines, "drawing", "cents"), "drawing").select("drawing", "threshold", "n", F.round(F.col("median"), 1).alias("median"))


QUERIES = {f.__name__: f for f in (q68_components, q69_summed_areas, q70_projection_cells, q71_thresholds)}

_INK_SQL = f"""{_BOXES_SQL},
    rows AS (SELECT l_orderkey, x, w, unnest(range(y, y + h)) AS py FROM boxes),
    ink AS (SELECT DISTINCT l_orderkey, unnest(range(x, x + w)) AS px, py FROM rows)"""

ORACLE_SQL = {
    "q68_components": f"""WITH RECURSIVE {_BOXES_SQL},
        touching AS (SELECT a.l_orderkey, a.number AS a, b.number AS b FROM boxes a JOIN boxes b ON a.l_orderkey = b.l_orderkey AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h),
        reached AS (SELECT l_orderkey, a, b FROM touching UNION SELECT r.l_orderkey, r.a, t.b FROM reached r JOIN touching t ON r.l_orderkey = t.l_orderkey AND r.b = t.a),
        owned AS (SELECT l_orderkey, a AS number, min(b) AS root FROM reached GROUP BY l_orderkey, a),
        pieces AS (SELECT l_orderkey, root, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes JOIN owned USING (l_orderkey, number) GROUP BY l_orderkey, root)
        SELECT l_orderkey, x, y, w, h, count(*) AS n FROM pieces GROUP BY l_orderkey, x, y, w, h""",
    "q69_summed_areas": f"""WITH {_INK_SQL},
        windows AS (SELECT l_orderkey, number, greatest(x - 5, 0) AS x0, greatest(y - 5, 0) AS y0, least(x + w + 5, {WIDTH}) AS x1, least(y + h + 5, {HEIGHT}) AS y1 FROM boxes),
        counted AS (SELECT l_orderkey, number, count(*) AS ink, any_value((x1 - x0) * (y1 - y0)) AS area FROM windows JOIN ink USING (l_orderkey) WHERE px >= x0 AND px < x1 AND py >= y0 AND py < y1 GROUP BY l_orderkey, number)
        SELECT l_orderkey, number, ink, round((area - ink) / area, 6) AS white, round(ink - ink * ink / area, 6) AS spread FROM counted""",
    "q70_projection_cells": f"""WITH {_INK_SQL},
        drawings AS (SELECT DISTINCT l_orderkey FROM boxes),
        counted AS (SELECT l_orderkey, 'row' AS axis, py AS i, count(*) AS n FROM ink GROUP BY l_orderkey, py UNION ALL SELECT l_orderkey, 'column', px, count(*) FROM ink GROUP BY l_orderkey, px),
        every AS (SELECT l_orderkey, 'row' AS axis, {WIDTH} AS side, {HEIGHT} AS total, unnest(range({HEIGHT})) AS i FROM drawings UNION ALL SELECT l_orderkey, 'column', {HEIGHT}, {WIDTH}, unnest(range({WIDTH})) FROM drawings),
        white AS (SELECT e.*, e.i - row_number() OVER (PARTITION BY l_orderkey, axis ORDER BY e.i) AS run FROM every e LEFT JOIN counted c USING (l_orderkey, axis, i) WHERE (side - coalesce(n, 0)) / side >= 0.96::DOUBLE),
        runs AS (SELECT l_orderkey, axis, min(i) AS s, max(i) + 1 AS e FROM white GROUP BY l_orderkey, axis, run HAVING count(*) >= 8),
        cuts AS (SELECT l_orderkey, axis, (s + e) // 2 AS place FROM runs UNION SELECT l_orderkey, axis, unnest([0, total]) FROM every),
        cells AS (SELECT l_orderkey, axis, place, lead(place) OVER (PARTITION BY l_orderkey, axis ORDER BY place) AS until FROM cuts)
        SELECT l_orderkey, c.place AS x, r.place AS y, c.until - c.place AS w, r.until - r.place AS h FROM cells r JOIN cells c USING (l_orderkey) WHERE r.axis = 'row' AND c.axis = 'column' AND r.until IS NOT NULL AND c.until IS NOT NULL""",
    "q71_thresholds": """WITH pixels AS (SELECT CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_orderkey END AS drawing, l_partkey % 256 AS level, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
        counts AS (SELECT drawing, level, count(*)::BIGINT AS n FROM pixels GROUP BY drawing, level),
        sums AS (SELECT drawing, level, sum(n) OVER u AS n0, sum(n * level) OVER u AS m0, sum(n) OVER e AS n, sum(n * level) OVER e AS m FROM counts WINDOW u AS (PARTITION BY drawing ORDER BY level), e AS (PARTITION BY drawing)),
        scored AS (SELECT drawing, level, CASE WHEN n > n0 THEN n0::DOUBLE * (n - n0)::DOUBLE * ((m0::DOUBLE / n0::DOUBLE - (m - m0)::DOUBLE / (n - n0)::DOUBLE) * (m0::DOUBLE / n0::DOUBLE - (m - m0)::DOUBLE / (n - n0)::DOUBLE)) ELSE 0 END AS apart FROM sums),
        best AS (SELECT drawing, level, apart, row_number() OVER (PARTITION BY drawing ORDER BY apart DESC, level) AS place FROM scored),
        middle AS (SELECT drawing, count(*) AS n, median(cents) AS m FROM pixels GROUP BY drawing)
        SELECT drawing, CASE WHEN apart > 0 THEN level ELSE 0 END AS threshold, n, round(m, 1) AS median FROM best JOIN middle USING (drawing) WHERE place = 1""",
}
