"""Boxes and runs: overlap, suppression, views by position, gaps and the grid they cut.

A box table has a drawing id, a number within the drawing, and x, y, w, h; drawings are small groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry.functions import fixed, text
from casequarry.sources import tables


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes; 0 if their union has no area."""
    wide = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    high = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    common = wide * high
    return F.coalesce(F.try_divide(common, a["w"] * a["h"] + b["w"] * b["h"] - common), F.lit(0.0))


def box(prefix: str = "") -> dict[str, Column]:
    return {side: F.col(f"{prefix}{side}").cast("double") for side in "xywh"}


def overlap(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> float:
    """Intersection over union of two plain boxes."""
    wide = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    high = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - wide * high
    return wide * high / union if union > 0 else 0.0


def suppressed(hits: DataFrame, group: str, threshold: float = 0.5, k: int | None = 5) -> DataFrame:
    """Hits (group, number, score, x, y, w, h) that survive greedy suppression, with their rank.

    The best score first, ties by number; a hit goes if it overlaps a kept one by ``threshold`` or more;
    of the kept the first k stay. The hits of a group come sorted and are held against those kept so
    far, so a task streams over its groups and remembers k boxes.
    """

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = None
        kept: list[tuple[float, float, float, float]] = []
        for part in parts:
            chosen, ranks = [], []
            for i, (of, *place) in enumerate(zip(part[group], *(part[c].astype(float) for c in "xywh"), strict=True)):
                if of != current:
                    current, kept = of, []
                if (k is None or len(kept) < k) and all(overlap(tuple(place), other) < threshold for other in kept):
                    kept.append(tuple(place))
                    chosen.append(i)
                    ranks.append(len(kept))
            yield part.iloc[chosen].assign(rank=ranks)

    schema = T.StructType([*hits.schema.fields, T.StructField("rank", T.IntegerType())])
    dealt = hits.where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, F.desc("score"), "number")
    return dealt.mapInPandas(keep, schema)


def labelled_views(boxes: DataFrame, drawing: str, number: str = "number") -> DataFrame:
    """Boxes with view and confidence by their place in the drawing.

    One box is Unknown. Of two the upper is Top, the other Front. Of three, the largest at or right of
    the median centre is Iso, and the upper of the others Top, the lower Front. Of more, the quadrant
    about the median centre says (at the median is right, and lower), and of several boxes of a view
    the largest keeps it, the others are Unknown.
    """
    own = Window.partitionBy(drawing)
    rows = boxes.withColumns({"__n": F.count("*").over(own), "__cx": F.floor(F.col("x") + F.col("w") / 2), "__cy": F.floor(F.col("y") + F.col("h") / 2), "__area": F.col("w") * F.col("h")})
    rows = rows.withColumns({"__mx": F.median("__cx").over(own), "__my": F.median("__cy").over(own)})
    right, lower = F.col("__cx") >= F.col("__mx"), F.col("__cy") >= F.col("__my")
    by_y = F.row_number().over(own.orderBy("y", number))
    iso = F.row_number().over(own.orderBy(F.desc(right), F.desc("__area"), number)) == 1
    rows = rows.withColumns({"__by_y": by_y, "__iso": iso})
    others = F.row_number().over(own.orderBy("__iso", "__cy", number))
    quadrant = F.when(right & lower, "Iso").when(right, "Side").when(lower, "Front").otherwise("Top")
    rows = rows.withColumns({"__others": others, "__quadrant": quadrant})
    largest = F.row_number().over(Window.partitionBy(drawing, "__quadrant").orderBy(F.desc("__area"), number)) == 1
    n = F.col("__n")
    view = (
        F.when(n == 1, "Unknown")
        .when(n == 2, F.when(F.col("__by_y") == 1, "Top").otherwise("Front"))
        .when(n == 3, F.when(F.col("__iso"), "Iso").when(F.col("__others") == 1, "Top").otherwise("Front"))
        .otherwise(F.when(largest, F.col("__quadrant")).otherwise("Unknown"))
    )
    rows = rows.withColumn("view", view)
    sure = F.when(F.col("view") == "Unknown", 0.3).when(n == 3, F.when(F.col("__iso"), 0.65).otherwise(0.75)).otherwise(0.85)
    return rows.withColumn("confidence", sure).select(*boxes.columns, "view", "confidence")


def verified(view: Column, confidence: Column, seen: Column) -> tuple[Column, Column]:
    """View and confidence after a second opinion: agreement 0.95, another view 0.75, none as before."""
    return F.coalesce(seen, view), F.when(seen.isNull(), confidence).when(seen == view, F.lit(0.95)).otherwise(F.lit(0.75))


def named_views(views: DataFrame, drawing: str, number: str = "number") -> DataFrame:
    """Views with a running number by view, y, x and their former number, and a file name that shows both."""
    rank = F.coalesce(F.nullif(F.array_position(F.lit(list(fixed.VIEW_ORDER)), F.col("view")), F.lit(0)), F.lit(99))
    order = Window.partitionBy(drawing).orderBy(rank, "y", "x", number)
    rows = views.withColumn("view_number", F.row_number().over(order))
    return rows.withColumn("file_name", F.format_string("%s-%02d_%s.png", F.col(drawing).cast("string"), F.col("view_number"), F.col("view")))


def plausible(boxes: DataFrame, image_w: Column, image_h: Column, least: float = 0.05, most: float = 0.90) -> DataFrame:
    """Boxes of at least and at most these shares of the image."""
    share = F.col("w") * F.col("h") / (image_w * image_h)
    return boxes.where((share >= least) & (share <= most))


def padded(boxes: DataFrame, image_w: Column, image_h: Column, by: int = 5) -> DataFrame:
    """Boxes grown by a few pixels on each side and clipped to the image."""
    x, y = F.greatest(F.col("x") - by, F.lit(0)), F.greatest(F.col("y") - by, F.lit(0))
    right, bottom = F.least(F.col("x") + F.col("w") + by, image_w), F.least(F.col("y") + F.col("h") + by, image_h)
    return boxes.withColumns({"x": x, "y": y, "w": right - x, "h": bottom - y})


def normalised(value: Column, size: Column) -> Column:
    """Pixels to a share of the side, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / size))


def within(region: tuple[int, int, int, int]) -> Column:
    """Whether a box's upper left corner lies in a region; its far sides are outside."""
    x, y, w, h = region
    return (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)


def polygon_box(points: Column) -> Column:
    """x, y, w, h of an array of points [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def gaps(profile: DataFrame, axis: str, position: str = "i", ratio: str = "ratio", threshold: float = 0.96, width: int = 8) -> DataFrame:
    """Runs of positions whose ratio reaches the threshold, at least ``width`` long, to the very end.

    Returns the axis, start and end (exclusive). Positions of an axis are 0, 1, 2, ...; a run is where
    position less rank among the white ones is constant.
    """
    white = profile.where(F.col(ratio) >= threshold)
    rank = F.row_number().over(Window.partitionBy(axis).orderBy(position))
    runs = white.withColumn("__run", F.col(position) - rank).groupBy(axis, "__run").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= width).select(axis, "start", "end")


def bounds(runs: DataFrame, totals: DataFrame, axis: str) -> DataFrame:
    """Cuts in the middle of the runs, and 0 and ``total`` (axis, total), as consecutive cells."""
    middles = runs.select(axis, F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("at"))
    ends = totals.select(axis, F.explode(F.array(F.lit(0).cast("long"), F.col("total").cast("long"))).alias("at"))
    cuts = middles.unionByName(ends).distinct()
    following = F.lead("at").over(Window.partitionBy(axis).orderBy("at"))
    return cuts.withColumn("until", following).where("until IS NOT NULL").select(axis, F.col("at").alias("begin"), "until")


def grid(rows: DataFrame, columns: DataFrame, drawing: str) -> DataFrame:
    """Cells of a drawing from its row cells and its column cells (drawing, begin, until)."""
    down = rows.select(drawing, F.col("begin").alias("y"), (F.col("until") - F.col("begin")).alias("h"))
    across = columns.select(drawing, F.col("begin").alias("x"), (F.col("until") - F.col("begin")).alias("w"))
    return down.join(across, drawing)


def white_ratios(images: DataFrame, key: str, decode, white: int = 200) -> DataFrame:
    """Share of white pixels of each row and column of the images (key, content).

    ``decode`` makes a grey array of the content. Returns key, axis (``row`` or ``column``), i, ratio.
    """

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                bright = decode(row[1]) > white
                for axis, along in (("row", 1), ("column", 0)):
                    ratio = bright.mean(axis=along)
                    yield pd.DataFrame({key: row[0], "axis": axis, "i": range(len(ratio)), "ratio": ratio})

    schema = images.select(key).schema.add("axis", "string").add("i", "long").add("ratio", "double")
    return images.select(key, "content").mapInPandas(measure, schema)


def valid_region(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a region in shares of the sides is one: within 0 and 1, and of some size."""
    return (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1)


def page_size(points: Column, dpi: int) -> Column:
    """A page's side in points, inches and pixels at a resolution."""
    return F.struct(points.alias("points"), (points / 72).alias("inches"), F.floor(points * dpi / 72).alias("pixels"))


def moved(boxes: DataFrame, x: int, y: int) -> DataFrame:
    """Boxes found in a region, at their places in the whole image."""
    return boxes.withColumns({"x": F.col("x") + x, "y": F.col("y") + y})


def recognised(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Recognised lines (polygon, confidence, ...) of enough confidence, with their upright boxes."""
    return lines.where(F.col("confidence") >= least).withColumn("box", polygon_box(F.col("polygon"))).select("*", "box.*").drop("box")


def worth_cropping(w: Column, h: Column, n_views: Column) -> Column:
    """Whether a drawing is so wide that it may hold several views, and none were given."""
    return (w > h * 1.2) & (n_views == 0)


def view_metadata(views: DataFrame, drawing: str) -> DataFrame:
    """One JSON a drawing that lists its named views in order."""
    one = F.struct(
        F.col("view_number").alias("index"),
        F.col("view").alias("label"),
        F.when(F.col("view").isin(*fixed.PRIMARY_VIEWS), "primary").otherwise("supporting").alias("role"),
        F.col("file_name").alias("filename"),
        F.round("confidence", 2).alias("confidence"),
        F.array("x", "y", "w", "h").alias("bbox"),
    )
    listed = views.groupBy(drawing).agg(F.array_sort(F.collect_list(one)).alias("views"))
    return listed.select(drawing, F.to_json(F.struct(F.col(drawing).cast("string").alias("source"), F.size("views").alias("total_views"), "views")).alias("metadata"))


def title_block(lines: DataFrame, drawing: str, image_w: str, image_h: str, share: float = 0.25, least: float = 0.5) -> DataFrame:
    """What a drawing's lower right corner says: drawing, region, texts and the notes among them.

    ``lines`` has drawing, line (their order), text, confidence, polygon and the image's sides. Lines of enough
    confidence count whose upright box begins in the corner, whose sides are ``share`` of the image's,
    rounded down.
    """
    across, down = F.floor(F.col(image_w) * share).cast("int"), F.floor(F.col(image_h) * share).cast("int")
    placed = recognised(lines, least).withColumns({"__x": F.col(image_w) - across, "__y": F.col(image_h) - down, "__w": across, "__h": down})
    inside = (F.col("x") >= F.col("__x")) & (F.col("x") < F.col("__x") + F.col("__w")) & (F.col("y") >= F.col("__y")) & (F.col("y") < F.col("__y") + F.col("__h"))
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    listed = placed.where(inside).groupBy(drawing, F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"), F.col("__w").alias("w"), F.col("__h").alias("h")).alias("region")).agg(F.transform(ordered, lambda r: r["text"]).alias("texts"))
    return listed.withColumn("notes", F.filter("texts", lambda t: text.is_note(t)))


def save_views(crops: DataFrame, views: DataFrame, drawing: str, folder: str) -> list[str]:
    """Write cropped views (file_name, content) and one ``DRAWING-metadata.json`` a drawing into a shared folder; returns the names."""
    about = view_metadata(views, drawing).select(F.concat(F.col(drawing).cast("string"), F.lit("-metadata.json")).alias("name"), F.col("metadata").cast("binary").alias("content"))
    return tables.save_files(crops.select(F.col("file_name").alias("name"), "content").unionByName(about), folder)
