"""Drawings of few boxes: a row each, by the edges of their boxes; those of many boxes go by tiles (``rasters``).

What is shuffled is the boxes and not their ink, and the cost of a small drawing doesn't depend on its size in pixels. A
drawing of more rows than ``FEW`` is never in one row or task; the results are the same both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.operators import rasters
from casequarry.session import kept

#: Drawings of up to so many rows (boxes, and what is asked of them) are gathered.
FEW = 64
#: Rows that a task gathers, about.
TASK_ROWS = 1_000_000
#: Numbers that a step of numpy holds, about.
STEP = 2_000_000

_SIDES = ("x0", "y0", "x1", "y1")


def clipped(boxes: DataFrame, drawing: str) -> DataFrame:
    """Boxes (drawing, x0, y0, x1, y1) as ``rasters.painted`` paints them: those with a drawing and ink, clipped at 0."""
    sides = {"x0": F.greatest("x", F.lit(0)), "y0": F.greatest("y", F.lit(0)), "x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")}
    return boxes.dropna(subset=[drawing, "x", "y", "w", "h"]).select(drawing, *[c.cast("long").alias(n) for n, c in sides.items()]).where("x0 < x1 AND y0 < y1")


def gathered(rows: DataFrame, drawing: str, lists: list[Column], few: int) -> tuple[DataFrame, DataFrame | None]:
    """One row a drawing with ``lists``, aggregates of its rows, and the drawings that have more than ``few`` rows, or None.

    The driver gets two numbers. A task gathers a bounded number of rows, whatever the number of drawings.
    """
    counted = rows.groupBy(drawing).agg(F.count("*").alias("n"))
    seen = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen["n"] // TASK_ROWS + 1)
    many = kept(counted.where(F.col("n") > few).select(drawing).repartition(parts)) if seen["most"] > few else None
    if many is not None:
        rows = rows.join(many, drawing, "left_anti")
    return rows.repartition(parts, drawing).groupBy(drawing).agg(*lists), many


def components(boxes: DataFrame, drawing: str, few: int = FEW) -> DataFrame:
    """``rasters.components`` of filled boxes: those that touch at sides or corners are one piece."""
    drawn = clipped(boxes, drawing)
    rows, many = gathered(drawn, drawing, [F.collect_list(F.struct(*_SIDES)).alias("boxes")], few)

    def joined(pieces: Column, box: Column) -> Column:
        near = lambda b: (b["x0"] <= box["x1"]) & (box["x0"] <= b["x1"]) & (b["y0"] <= box["y1"]) & (box["y0"] <= b["y1"])
        met = F.filter(pieces, lambda p: F.exists(p, near))
        return F.concat(F.filter(pieces, lambda p: ~F.exists(p, near)), F.array(F.concat(F.array(box), F.flatten(met))))

    none = F.array().cast("array<array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>>")
    side = lambda p, name, most: most(F.transform(p, lambda b: b[name]))
    box = lambda p: F.struct(side(p, "x0", F.array_min).alias("x"), side(p, "y0", F.array_min).alias("y"), side(p, "x1", F.array_max).alias("x1"), side(p, "y1", F.array_max).alias("y1"))
    found = rows.select(drawing, F.inline(F.transform(F.aggregate("boxes", none, joined), box)))
    found = found.select(drawing, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))
    if many is None:
        return found
    return found.unionByName(rasters.components(rasters.painted(boxes.join(many, drawing, "left_semi"), drawing), drawing))


def _padded(lists: pa.ListArray, counts: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    """Fields of lists of structs as arrays of row and place, filled up with 0."""
    there = np.arange(max(int(counts.max(initial=0)), 1)) < counts[:, None]
    flat, out = lists.flatten(), []
    for name in names:
        field = np.zeros(there.shape, np.int64)
        field[there] = flat.field(name).to_numpy(zero_copy_only=False)
        out.append(field)
    return out


def _steps(part: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A batch in steps of rows whose lists (columns ``names``) are about as long, with the lists' lengths."""
    counts = [pc.list_value_length(part[n]).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
    order = np.argsort(sum(counts), kind="stable")
    start = 0
    while start < len(order):
        end = len(order)
        while end - start > 1 and (end - start) * (2 * int(max(c[order[start:end]].max() for c in counts)) + 2) ** 2 > STEP:
            end = start + (end - start + 1) // 2
        taken = order[start:end]
        yield part.take(pa.array(taken)), [c[taken] for c in counts]
        start = end


def _covered(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted edges of the boxes of each row, across and down, and whether the cell between them has ink."""
    ex, ey = np.sort(np.concatenate([x0, x1], 1), 1), np.sort(np.concatenate([y0, y1], 1), 1)
    ink = np.zeros((len(ex), ey.shape[1] - 1, ex.shape[1] - 1), bool)
    for k in range(x0.shape[1]):
        across = (x0[:, k, None] <= ex[:, :-1]) & (ex[:, :-1] < x1[:, k, None])
        down = (y0[:, k, None] <= ey[:, :-1]) & (ey[:, :-1] < y1[:, k, None])
        ink |= down[:, :, None] & across[:, None, :]
    return ex, ey, ink.astype(np.int64)


def inks(windows: DataFrame, boxes: DataFrame, sizes: DataFrame, drawing: str, key: str, few: int = FEW) -> DataFrame:
    """The ink of windows (drawing, key, x, y, w, h) of drawings of filled boxes: drawing, key, w, h, ink.

    Windows lie within the drawing and are named once. ``sizes`` are those of drawings that go by summed areas.
    """
    asked = windows.dropna(subset=[drawing]).select(drawing, F.col(key).alias("__key"), *[c.cast("long").alias(n) for n, c in (("x0", F.col("x")), ("y0", F.col("y")), ("x1", F.col("x") + F.col("w")), ("y1", F.col("y") + F.col("h")))])
    both = clipped(boxes, drawing).withColumn("__box", F.lit(True)).unionByName(asked.withColumn("__box", F.lit(False)), allowMissingColumns=True)
    lists = [F.collect_list(F.when(F.col("__box"), F.struct(*_SIDES))).alias("__boxes"), F.collect_list(F.when(~F.col("__box"), F.struct("__key", *_SIDES))).alias("__windows")]
    rows, many = gathered(both, drawing, lists, few)

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part, (n_boxes, n_windows) in _steps(whole, ("__boxes", "__windows")):
                ex, ey, ink = _covered(*_padded(part["__boxes"], n_boxes, _SIDES))
                x0, y0, x1, y1 = (side[:, :, None] for side in _padded(part["__windows"], n_windows, _SIDES))
                across, down = np.diff(np.clip(ex[:, None, :], x0, x1)), np.diff(np.clip(ey[:, None, :], y0, y1))
                there = np.arange(x0.shape[1]) < n_windows[:, None]
                asked_ = part["__windows"].flatten()
                out = {drawing: part[drawing].take(pa.array(np.repeat(np.arange(len(part)), n_windows))), key: asked_.field("__key")}
                out |= {"w": (x1 - x0)[:, :, 0][there], "h": (y1 - y0)[:, :, 0][there], "ink": ((down @ ink) * across).sum(axis=2)[there]}
                yield pa.RecordBatch.from_pydict(out)

    schema = windows.select(drawing, key).schema.add("w", "long").add("h", "long").add("ink", "long")
    found = rows.mapInArrow(measure, schema)
    if many is None:
        return found
    only = lambda df: df.join(many, drawing, "left_semi")
    summed = rasters.areas(rasters.painted(only(boxes), drawing), only(sizes), drawing)
    tiled = rasters.ink_in(only(windows), summed, drawing, key).join(windows.select(drawing, key, F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")), [drawing, key])
    return found.unionByName(tiled)


def _cells(edges: list[int], ink: list[int], total: int, side: int, threshold: float, width: int) -> list[tuple[int, int]]:
    """Cells (from, until) of one axis of ``total`` places: cuts in the middle of runs of ``width`` places that are white enough."""
    cuts, start = {0, total}, None
    places = [(0, edges[0], 0), *zip(edges, edges[1:], ink, strict=False), (edges[-1], total, 0)]
    for at, until, n in places:
        at, until = min(max(at, 0), total), min(max(until, 0), total)
        if at >= until:
            continue
        if (side - n) / side >= threshold:
            start = at if start is None else start
        elif start is not None:
            if at - start >= width:
                cuts.add((start + at) // 2)
            start = None
    if start is not None and total - start >= width:
        cuts.add((start + total) // 2)
    ordered = sorted(cuts)
    return list(zip(ordered, ordered[1:], strict=False))


def projection_cells(boxes: DataFrame, sizes: DataFrame, drawing: str, threshold: float = 0.96, width: int = 8, few: int = FEW) -> DataFrame:
    """``rasters.projection_cells`` of drawings (drawing, width, height) of filled boxes."""
    sized = sizes.dropna(subset=[drawing]).select(drawing, F.col("width").cast("long").alias("x1"), F.col("height").cast("long").alias("y1"), F.lit(False).alias("__box"))
    both = clipped(boxes, drawing).withColumn("__box", F.lit(True)).unionByName(sized, allowMissingColumns=True)
    lists = [F.collect_list(F.when(F.col("__box"), F.struct(*_SIDES))).alias("__boxes"), *[F.max(F.when(~F.col("__box"), F.col(c))).alias(n) for c, n in (("x1", "__width"), ("y1", "__height"))]]
    rows, many = gathered(both, drawing, lists, few)
    rows = rows.where("__width > 0 AND __height > 0")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part, (n_boxes,) in _steps(whole, ("__boxes",)):
                ex, ey, ink = _covered(*_padded(part["__boxes"], n_boxes, _SIDES))
                across, down = (ink * np.diff(ex)[:, None, :]).sum(axis=2).tolist(), (ink * np.diff(ey)[:, :, None]).sum(axis=1).tolist()
                of, out = [], []
                for i, (xs, ys, wide, high) in enumerate(zip(ex.tolist(), ey.tolist(), part["__width"].to_pylist(), part["__height"].to_pylist(), strict=True)):
                    columns = _cells(xs, down[i], wide, high, threshold, width)
                    for y, below in _cells(ys, across[i], high, wide, threshold, width):
                        out += [(x, y, right - x, below - y) for x, right in columns]
                        of += [i] * len(columns)
                sides = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_pydict({drawing: part[drawing].take(pa.array(of, pa.int64())), **{n: sides[:, j] for j, n in enumerate("xywh")}})

    schema = sizes.select(drawing).schema
    for name in "xywh":
        schema = schema.add(name, "long")
    found = rows.mapInArrow(cut, schema)
    if many is None:
        return found
    # kept without their partitioning: Spark 4.1 plans unions of such joins that it then refuses
    only = lambda df: kept(df.join(many, drawing, "left_semi").repartition(rows.sparkSession.sparkContext.defaultParallelism))
    return found.unionByName(rasters.projection_cells(rasters.painted(only(boxes), drawing), only(sizes), drawing, threshold, width))
