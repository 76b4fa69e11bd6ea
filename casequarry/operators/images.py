"""Image operators in numpy: template matching, view detection, collage. Decoding is given by the caller.

An image is an array of rows and columns, grey or with three or four channels (blue, green, red, alpha).
Each runs inside ``mapInPandas`` over a table of images; an image is one row and never leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from casequarry.operators.boxes import overlap

Decode = Callable[[bytes], np.ndarray]
SCALES = tuple(n / 10 for n in range(2, 11))


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image[..., :3] @ np.array([0.114, 0.587, 0.299])


def shrunk(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The image at a smaller size; a pixel is the mean of the area that it stands for."""
    for axis, size in ((0, rows), (1, columns)):
        length = image.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis=axis)], axis=axis)
        cuts = np.linspace(0, length, size + 1)
        low = np.minimum(cuts.astype(int), length - 1)
        part = (cuts - low).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
        at = np.take(sums, low, axis) * (1 - part) + np.take(sums, low + 1, axis) * part
        image = np.diff(at, axis=axis) * size / length
    return image


def correlation(target: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation coefficient of a template with every place of a target; 0 where undefined."""
    rows, columns = template.shape
    flat = template - template.mean()
    shape = [a + b - 1 for a, b in zip(target.shape, template.shape, strict=True)]
    product = np.fft.irfft2(np.fft.rfft2(target, shape) * np.fft.rfft2(flat[::-1, ::-1], shape), shape)[rows - 1 : target.shape[0], columns - 1 : target.shape[1]]

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return total[rows:, columns:] - total[:-rows, columns:] - total[rows:, :-columns] + total[:-rows, :-columns]

    spread = sums(target**2) - sums(target) ** 2 / flat.size
    bottom = np.sqrt(np.maximum(spread, 0) * (flat**2).sum())
    return np.divide(product, bottom, out=np.zeros_like(product), where=bottom > 1e-6)


def symbol_hits(target: np.ndarray, template: np.ndarray, threshold: float = 0.70, k: int = 5, scales: Sequence[float] = SCALES) -> list[tuple[float, int, int, int, int]]:
    """Score, x, y, w, h of the k best places of a template at any scale, without those they overlap."""
    found = []
    for scale in scales:
        rows, columns = max(1, int(template.shape[0] * scale)), max(1, int(template.shape[1] * scale))
        if rows < target.shape[0] and columns < target.shape[1]:
            scores = correlation(target, shrunk(template, rows, columns))
            found += [(float(scores[y, x]), int(x), int(y), columns, rows) for y, x in zip(*np.nonzero(scores >= threshold), strict=True)]
    kept: list[tuple[float, int, int, int, int]] = []
    for hit in sorted(found, key=lambda h: -h[0]):
        if len(kept) < k and all(overlap(hit[1:], other[1:]) < 0.5 for other in kept):
            kept.append(hit)
    return kept


def match_symbols(images: DataFrame, key: str, templates: dict[str, np.ndarray], decode: Decode, threshold: float = 0.70) -> DataFrame:
    """Hits of the templates (grey arrays, a stated library) in images (key, content): one row each.

    Returns key, name, rank (1 is the template's best place), score, x, y, w, h.
    """
    names = ["name", "rank", "score", "x", "y", "w", "h"]

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for of, content in zip(part[key], part["content"], strict=True):
                target = grey(decode(content))
                rows = [(name, rank, *hit) for name, template in templates.items() for rank, hit in enumerate(symbol_hits(target, template, threshold), 1)]
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, key, [of] * len(out))
                yield out

    schema = images.select(key).schema
    for name, kind in zip(names, ("string", "integer", "double", *["integer"] * 4), strict=True):
        schema = schema.add(name, kind)
    return images.select(key, "content").mapInPandas(search, schema)


def white_runs(ratio: np.ndarray, threshold: float = 0.96, width: int = 8) -> list[tuple[int, int]]:
    """Runs of values at the threshold or over, at least ``width`` long: start and end (exclusive)."""
    white = np.concatenate([[0], ratio >= threshold, [0]]).astype(int)
    starts, ends = np.flatnonzero(np.diff(white) == 1), np.flatnonzero(np.diff(white) == -1)
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= width]


def cells(ratio: np.ndarray) -> list[tuple[int, int]]:
    """Pieces between the middles of white runs."""
    cuts = sorted({0, len(ratio), *((a + b) // 2 for a, b in white_runs(ratio))})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def projection_boxes(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    bright = image > 200
    return [(x, y, right - x, bottom - y) for y, bottom in cells(bright.mean(axis=1)) for x, right in cells(bright.mean(axis=0))]


def otsu(image: np.ndarray) -> int:
    """The level that separates dark from light best: the largest variance between the two classes."""
    counts = np.bincount(image.astype(np.uint8).ravel(), minlength=256).astype(float)
    below, mass = counts.cumsum(), (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    both = (below > 0) & (above > 0)
    apart = np.zeros(256)
    apart[both] = below[both] * above[both] * (mass[both] / below[both] - (mass[-1] - mass[both]) / above[both]) ** 2
    return int(apart.argmax())


def grown(ink: np.ndarray, radius: int) -> np.ndarray:
    """Ink within ``radius`` of a pixel, as a disc, row shift by row shift."""
    rows, columns = ink.shape
    out = np.zeros_like(ink)
    for dy in range(-min(radius, rows - 1), min(radius, rows - 1) + 1):
        half = int(np.sqrt(radius**2 - dy**2))
        sums = np.pad(ink, ((0, 0), (half + 1, half))).cumsum(axis=1)
        wide = (sums[:, 2 * half + 1 :] - sums[:, : columns]) > 0
        out[max(0, dy) : rows + min(0, dy)] |= wide[max(0, -dy) : rows + min(0, -dy)]
    return out


def component_boxes(ink: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of the pieces of ink that touch at sides or corners: runs of a row joined to those above."""
    owner: list[int] = []
    box: list[list[int]] = []

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = i = owner[owner[i]]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(ink):
        steps = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for start, end in zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True):
            me = len(owner)
            owner.append(me)
            box.append([start, y, end, y + 1])
            for a, b, other in above:
                if a <= end and start <= b:
                    first, second = sorted((root(me), root(other)))
                    if first != second:
                        owner[second] = first
                        left, right = box[first], box[second]
                        box[first] = [min(left[0], right[0]), min(left[1], right[1]), max(left[2], right[2]), max(left[3], right[3])]
            here.append((start, end, me))
        above = here
    return [(b[0], b[1], b[2] - b[0], b[3] - b[1]) for i, b in enumerate(box) if owner[i] == i]


def view_boxes(image: np.ndarray, least: float = 0.05, most: float = 0.90, pad: int = 5) -> list[tuple[int, int, int, int]]:
    """Boxes of a drawing's views: cells of its white bands, or else pieces of grown ink.

    Pieces count where white bands give fewer than two cells of at least ``least`` of the image; those of
    over ``most`` of it are its frame.
    """
    plain = grey(image)
    rows, columns = plain.shape
    area = rows * columns
    found = [b for b in projection_boxes(plain) if b[2] * b[3] >= least * area]
    if len(found) >= 2:
        return found
    ink = grown(plain <= otsu(plain), max(20, min(rows, columns) // 30))
    padded = []
    for x, y, w, h in component_boxes(ink):
        if w * h <= most * area:
            left, top = max(0, x - pad), max(0, y - pad)
            padded.append((left, top, min(w + 2 * pad, columns - left), min(h + 2 * pad, rows - top)))
    return [b for b in padded if b[2] * b[3] >= least * area]


def detect_views(images: DataFrame, key: str, decode: Decode) -> DataFrame:
    """Boxes of the views of images (key, content): key, number, x, y, w, h."""

    def detect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for of, content in zip(part[key], part["content"], strict=True):
                out = pd.DataFrame([(i, *b) for i, b in enumerate(view_boxes(decode(content)))], columns=["number", "x", "y", "w", "h"])
                out.insert(0, key, [of] * len(out))
                yield out

    schema = images.select(key).schema
    for name in ("number", "x", "y", "w", "h"):
        schema = schema.add(name, "long")
    return images.select(key, "content").mapInPandas(detect, schema)


def collage(views: Sequence[np.ndarray]) -> np.ndarray:
    """One view as it is, or the first four in two rows, each padded with black to the largest."""
    if not views:
        raise ValueError("no views")
    if len(views) == 1:
        return views[0]
    rows, columns = max(v.shape[0] for v in views), max(v.shape[1] for v in views)
    out = np.zeros((2 * rows, 2 * columns, 3), dtype=np.uint8)
    for i, view in enumerate(views[:4]):
        y, x = i // 2 * rows, i % 2 * columns
        out[y : y + view.shape[0], x : x + view.shape[1]] = view[:, :, :3]
    return out
