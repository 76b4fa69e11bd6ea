"""Drawings as tables: a row is 64 pixels, a tile 64 rows, so no task holds a drawing.

A box table has a drawing, x, y, w, h in whole pixels; a word is the ink of 64 pixels of a row as the bits of a
long. Painting, profiles and areas are sums that are begun before they are shuffled. Null drawings, and boxes with
a null or without area, paint nothing; boxes painted twice are ink once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry.operators import boxes as plain
from casequarry.operators.contraction import roots
from casequarry.session import kept

SIDE = 64


def _below(n: Column) -> Column:
    """The bits of a word's first n pixels, n from 0 to 64."""
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(SIDE) - n).cast("int")))


def painted(boxes: DataFrame, drawing: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Words (drawing, y, tx, bits) of filled boxes, clipped at 0 and at the given size; only words with ink."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    sides = {"x0": F.greatest("x", F.lit(0)), "y0": F.greatest("y", F.lit(0)), "x1": right if width is None else F.least(right, F.lit(width)), "y1": bottom if height is None else F.least(bottom, F.lit(height))}
    clipped = boxes.dropna(subset=[drawing, "x", "y", "w", "h"]).select(drawing, *[c.cast("long").alias(n) for n, c in sides.items()]).where("x0 < x1 AND y0 < y1")
    rows = clipped.distinct().select(drawing, "x0", "x1", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    words = rows.select(drawing, "y", "x0", "x1", F.explode(F.expr(f"sequence(x0 div {SIDE}, (x1 - 1) div {SIDE})")).alias("tx"))
    start, end = F.greatest(F.col("x0") - F.col("tx") * SIDE, F.lit(0)), F.least(F.col("x1") - F.col("tx") * SIDE, F.lit(SIDE))
    return words.groupBy(drawing, "y", "tx").agg(F.bit_or(_below(end).bitwiseAND(F.bitwise_not(_below(start)))).alias("bits"))


def tiles(words: DataFrame, drawing: str) -> DataFrame:
    """Words as tiles (drawing, ty, tx, rows): up to 64 words each, with their row in the tile."""
    placed = words.select(drawing, F.expr(f"y div {SIDE}").alias("ty"), "tx", F.struct((F.col("y") % SIDE).alias("r"), "bits").alias("word"))
    return placed.groupBy(drawing, "ty", "tx").agg(F.collect_list("word").alias("rows"))


def _pixels(tiles_: pd.Series) -> np.ndarray:
    """The tiles of a batch as an array of tile, row, column."""
    bits = np.zeros((len(tiles_), SIDE), np.int64)
    for i, rows in enumerate(tiles_):
        for word in rows:
            bits[i, word["r"]] = word["bits"]
    return np.unpackbits(bits.astype("<i8").view(np.uint8), axis=1, bitorder="little").reshape(-1, SIDE, SIDE)


def _pieces(ink: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The ink of one tile as numbers of its pieces (-1: none), and their boxes: runs of a row joined to those above."""
    numbers, owner, runs, above = np.full((SIDE, SIDE), -1), [], [], []

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = i = owner[owner[i]]
        return i

    edges = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for y in np.flatnonzero(ink.any(axis=1)).tolist():
        here = []
        for start, end in zip(np.flatnonzero(edges[y] == 1).tolist(), np.flatnonzero(edges[y] == -1).tolist(), strict=True):
            me = len(owner)
            owner.append(me)
            runs.append((y, start, end))
            for other_y, a, b, other in above:
                if other_y == y - 1 and a <= end and start <= b:
                    one, two = root(me), root(other)
                    owner[max(one, two)] = min(one, two)
            here.append((y, start, end, me))
        above = here
    found: dict[int, int] = {}
    boxes: list[list[int]] = []
    for i, (y, start, end) in enumerate(runs):
        n = found.setdefault(root(i), len(boxes))
        if n == len(boxes):
            boxes.append([start, y, end, y + 1])
        box = boxes[n]
        box[:] = min(box[0], start), box[1], max(box[2], end), y + 1
        numbers[y, start:end] = n
    return numbers, boxes


_RIM = [(x, y) for y in range(SIDE) for x in range(SIDE) if x in (0, SIDE - 1) or y in (0, SIDE - 1)]


def components(words: DataFrame, drawing: str) -> DataFrame:
    """Boxes (drawing, x, y, w, h) of the pieces of ink that touch at sides or corners, over all tiles of a drawing.

    Pieces are found inside tiles; where pixels of two tiles touch, their pieces are joined, by an equal-key join of
    the rims' pixels and contraction of the links. A drawing's pieces are nowhere together.
    """
    rim_x, rim_y = (np.array(side) for side in zip(*_RIM, strict=True))

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            of, out = [], []
            for i, (ty, tx, ink) in enumerate(zip(part["ty"].tolist(), part["tx"].tolist(), _pixels(part["rows"]), strict=True)):
                numbers, boxes = _pieces(ink)
                rim = numbers[rim_y, rim_x]
                for n, (x0, y0, x1, y1) in enumerate(boxes):
                    at = np.flatnonzero(rim == n)
                    touching = (((rim_y[at] + ty * SIDE) << 32) + rim_x[at] + tx * SIDE).tolist()
                    of.append(i)
                    out.append((x0 + tx * SIDE, y0 + ty * SIDE, x1 + tx * SIDE, y1 + ty * SIDE, touching))
            found = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1", "rim"])
            found.insert(0, drawing, part[drawing].iloc[of].tolist())
            yield found

    schema = words.select(drawing).schema
    for name in ("x0", "y0", "x1", "y1"):
        schema = schema.add(name, "long")
    schema = schema.add("rim", T.ArrayType(T.LongType()))
    pieces = kept(tiles(words, drawing).mapInPandas(find, schema).withColumn("id", F.monotonically_increasing_id()))
    pixel = pieces.select(drawing, "id", F.explode("rim").alias("at")).select(drawing, "id", F.expr("at >> 32").alias("y"), F.expr("at & 4294967295").alias("x"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))]))
    near = pixel.select("*", steps.alias("s")).select(drawing, F.col("id").alias("a"), "x", "y", (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"))
    near = near.where(f"nx div {SIDE} <> x div {SIDE} OR ny div {SIDE} <> y div {SIDE}").select(drawing, "a", F.col("nx").alias("x"), F.col("ny").alias("y"))
    links = near.join(pixel.withColumnRenamed("id", "b"), [drawing, "x", "y"]).select("a", "b").distinct()
    owned = pieces.drop("rim").join(roots(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = owned.groupBy(drawing, "root").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return whole.select(drawing, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def _counted(words: DataFrame, drawing: str) -> DataFrame:
    """Tiles with the ink of each row and column."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ink = _pixels(part["rows"])
            bits = np.packbits(ink, axis=2, bitorder="little").reshape(len(part), -1).view("<i8")
            yield part[[drawing, "ty", "tx"]].assign(bits=bits.tolist(), across=ink.sum(axis=2, dtype=np.int64).tolist(), down=ink.sum(axis=1, dtype=np.int64).tolist())

    schema = words.select(drawing, F.lit(0).cast("long").alias("ty"), F.lit(0).cast("long").alias("tx")).schema
    for name in ("bits", "across", "down"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    return tiles(words, drawing).mapInPandas(count, schema)


def areas(words: DataFrame, sizes: DataFrame, drawing: str) -> DataFrame:
    """Summed areas of drawings of a size (drawing, width, height), a row a tile, tiles without ink included.

    ``corner`` is the ink of all tiles above and left, ``beside`` that of the tiles left of it by row, ``above`` that of
    the tiles above by column, each summed up from the tile's edge; ``bits`` is the tile. So the ink above and left of any
    pixel is four terms. Windows run along one row or one column of tiles.
    """
    grid = sizes.select(drawing, F.explode(F.expr(f"sequence(0L, height div {SIDE})")).alias("ty"), "width").select(drawing, "ty", F.explode(F.expr(f"sequence(0L, width div {SIDE})")).alias("tx"))
    none = F.array_repeat(F.lit(0).cast("long"), SIDE)
    full = grid.join(_counted(words, drawing), [drawing, "ty", "tx"], "left")
    full = full.select(drawing, "ty", "tx", *[F.coalesce(c, none).alias(c) for c in ("bits", "across", "down")])
    left = Window.partitionBy(drawing, "ty").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(drawing, "tx").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name, window: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))).over(window), F.lit(0).cast("long")) for i in range(SIDE)])
    rows = full.withColumn("beside", before("across", left)).withColumn("__left", F.aggregate("beside", F.lit(0).cast("long"), lambda t, x: t + x))
    summed = rows.withColumns({"above": before("down", up), "corner": F.coalesce(F.sum("__left").over(up), F.lit(0).cast("long"))})
    return summed.select(drawing, "ty", "tx", "corner", "beside", "above", "bits")


def ink_in(windows: DataFrame, areas_: DataFrame, drawing: str, key: str) -> DataFrame:
    """The ink of windows (drawing, key, x, y, w, h) from summed areas, at the same cost for any size: drawing, key, ink.

    Windows lie within the drawing; a drawing and key stand once, else their inks are added.
    """
    x, y, right, below = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    corner = lambda sign, px, py: F.struct(F.lit(sign).alias("sign"), px.cast("long").alias("px"), py.cast("long").alias("py"))
    points = windows.select(drawing, key, F.explode(F.array(corner(1, x, y), corner(-1, right, y), corner(-1, x, below), corner(1, right, below))).alias("p")).select(drawing, key, "p.*")
    points = points.withColumns({"ty": F.expr(f"py div {SIDE}"), "tx": F.expr(f"px div {SIDE}")})
    met = points.join(areas_, [drawing, "ty", "tx"])
    lx, ly = (F.col("px") % SIDE).cast("int"), (F.col("py") % SIDE).cast("int")
    total = lambda array, n: F.aggregate(F.slice(array, F.lit(1), n), F.lit(0).cast("long"), lambda t, v: t + v)
    local = F.aggregate(F.slice("bits", F.lit(1), ly), F.lit(0).cast("long"), lambda t, v: t + F.bit_count(v.bitwiseAND(_below(lx))))
    return met.withColumn("s", F.col("corner") + total("beside", ly) + total("above", lx) + local).groupBy(drawing, key).agg(F.sum(F.col("sign") * F.col("s")).alias("ink"))


def spreads(inks: DataFrame, area: Column) -> DataFrame:
    """Windows with their share of white, and the spread that correlation with a template divides by: the ink's sum of squared differences from its mean."""
    return inks.withColumns({"white": (area - F.col("ink")) / area, "spread": F.col("ink") - F.col("ink") * F.col("ink") / area})


def white_profiles(words: DataFrame, sizes: DataFrame, drawing: str) -> DataFrame:
    """Share of white of each row and column of drawings (drawing, width, height): drawing, axis (``row`` or ``column``), i, ratio."""
    down = words.groupBy(drawing, F.lit("row").alias("axis"), F.col("y").alias("i")).agg(F.sum(F.bit_count("bits")).alias("ink"))
    across = _counted(words, drawing).select(drawing, "tx", F.posexplode("down").alias("c", "n")).where("n > 0")
    across = across.groupBy(drawing, F.lit("column").alias("axis"), (F.col("tx") * SIDE + F.col("c")).alias("i")).agg(F.sum("n").alias("ink"))
    axes = F.array(F.struct(F.lit("row").alias("axis"), F.col("height").alias("n"), F.col("width").alias("of")), F.struct(F.lit("column").alias("axis"), F.col("width").alias("n"), F.col("height").alias("of")))
    every = sizes.select(drawing, F.inline(axes)).where("n > 0 AND of > 0").select(drawing, "axis", "of", F.explode(F.expr("sequence(0L, CAST(n AS BIGINT) - 1)")).alias("i"))
    joined = every.join(down.unionByName(across), [drawing, "axis", "i"], "left")
    return joined.select(drawing, "axis", "i", ((F.col("of") - F.coalesce("ink", F.lit(0))) / F.col("of")).alias("ratio"))


def projection_cells(words: DataFrame, sizes: DataFrame, drawing: str, threshold: float = 0.96, width: int = 8) -> DataFrame:
    """Cells (drawing, x, y, w, h) between the middles of the white bands of drawings; none where an axis has no size."""
    profile = white_profiles(words, sizes, drawing)
    out = []
    for axis, side in (("row", "height"), ("column", "width")):
        runs = plain.gaps(profile.where(F.col("axis") == axis), drawing, threshold=threshold, width=width)
        out.append(plain.bounds(runs, sizes.select(drawing, F.col(side).cast("long").alias("total")), drawing))
    return plain.grid(*out, drawing).select(drawing, "x", "y", "w", "h")
