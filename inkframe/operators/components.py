"""Connected components of masks, and what is measured on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.functions import geometry as geo
from inkframe.operators.groups import dealt


def runs_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first x, last x, run of each pixel) of horizontal runs; pixels sorted by (y, x)."""
    new = np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)]
    start = np.flatnonzero(new)
    last = np.r_[start[1:] - 1, len(x) - 1]
    return y[start], x[start], x[last], np.cumsum(new) - 1


def label_pixels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels from 0 of 8-connected pixels sorted by (y, x), numbered by each component's first pixel."""
    if not len(x):
        return np.zeros(0, np.int64)
    row, first, last, run = runs_of(x, y)
    row, first, last = row.tolist(), first.tolist(), last.tolist()
    parent = list(range(len(row)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    start = {r: k for k, r in reversed(list(enumerate(row)))}
    for k in range(len(row)):
        j = start.get(row[k] - 1)
        if j is None:
            continue
        while j < k and row[j] == row[k] - 1 and first[j] <= last[k] + 1:
            if last[j] >= first[k] - 1:
                a, b = find(j), find(k)
                parent[max(a, b)] = min(a, b)
            j += 1
    roots = np.array([find(k) for k in range(len(row))])
    return np.unique(roots, return_inverse=True)[1][run]


def label(mask: DataFrame, keys: Sequence[str] = ("image_id",), together: bool = False) -> DataFrame:
    """(keys, x, y, label) of the pixels over 0; label counts from 1 in order of each component's first pixel.

    One group is one mask (an image or a region of it), whose lit pixels fit a task. Masks that come each in one task already
    (``together``) stay there.
    """
    keys = list(keys)
    lit = mask.where("v > 0").select(*keys, "x", "y")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lit.schema.fields) + ", label bigint"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"])
        return f.assign(label=label_pixels(f["x"].to_numpy(), f["y"].to_numpy()) + 1)

    return (lit if together else dealt(lit, *keys)).groupBy(*keys).applyInPandas(run, schema)


def features(labels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, label, area, cx, cy, min_x, max_x, min_y, max_y, aspect) of each component."""
    out = labels.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).cast("double").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    )
    return out.withColumn("aspect", (F.col("max_x") - F.col("min_x") + 1) / (F.col("max_y") - F.col("min_y") + 1))


#: The areas and the widths by heights of components that may be letters, and how many of them are looked at for their shape.
AREA, ASPECT, SHAPES = (10, 5000), (0.1, 10), 10


def plausible(components: DataFrame, area: tuple[float, float] = AREA, aspect: tuple[float, float] = ASPECT) -> DataFrame:
    return components.where(F.col("area").between(*area) & F.col("aspect").between(*aspect))


def anchored(labels: DataFrame, regions: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The pixels of components that touch the band of half a region's height around its middle row, at any x.

    ``regions``: keys, y, h of one box a group.
    """
    half = F.floor(F.col("rh") / 2)
    band = regions.select(*keys, F.col("y").alias("ry"), F.col("h").alias("rh"))
    touching = labels.join(band, list(keys)).where(F.abs(F.col("y") - (F.col("ry") + half)) <= half).select(*keys, "label").distinct()
    return labels.join(touching, [*keys, "label"], "left_semi")


def _hull_area(points: np.ndarray) -> float:
    # No corner of a hull lies between two points of its row, so a chain goes down along the left ends and one along the right ends.
    x, row = points[:, 0], points[:, 1] - points[:, 1].min()
    beyond = int(x.max()) + 1
    left, right = np.full(row.max() + 1, beyond, np.int64), np.full(row.max() + 1, int(x.min()) - 1, np.int64)
    np.minimum.at(left, row, x)
    np.maximum.at(right, row, x)
    rows = np.flatnonzero(left < beyond)

    def chain(ends: np.ndarray, side: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for u, v in zip(ends[rows].tolist(), rows.tolist()):
            while len(out) > 1:
                (a, b), (c, d) = out[-2:]
                if side * ((c - a) * (v - b) - (d - b) * (u - a)) > 0:
                    break
                out.pop()
            out.append((u, v))
        return out

    ring = chain(left, -1) + chain(right, 1)[::-1]
    return abs(sum(a * d - b * c for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))) / 2


def _outline_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area enclosed by the outer border's pixel centres: Pick's theorem on the filled component."""
    w, h = x.max() - x.min() + 3, y.max() - y.min() + 3
    grid = np.zeros((h, w), bool)
    grid[y - y.min() + 1, x - x.min() + 1] = True
    # What a straight line from the edge reaches is outside, and most of it.
    reached = np.logical_or.accumulate
    outside = ~(reached(grid, 1) & reached(grid[:, ::-1], 1)[:, ::-1] & reached(grid, 0) & reached(grid[::-1], 0)[::-1])
    while True:  # the background reached from the edge by side steps
        more = outside.copy()
        more[1:] |= outside[:-1]
        more[:-1] |= outside[1:]
        more[:, 1:] |= outside[:, :-1]
        more[:, :-1] |= outside[:, 1:]
        more &= ~grid
        if (more == outside).all():
            break
        outside = more
    solid = ~outside
    # Unit squares whose four corners are filled, and triangles with three.
    corners = solid[:-1, :-1].astype(int) + solid[1:, :-1] + solid[:-1, 1:] + solid[1:, 1:]
    return float((corners == 4).sum() + 0.5 * (corners == 3).sum())


def solidity(x: np.ndarray, y: np.ndarray) -> float:
    """Outline area of one component over the area of its hull; NaN where that has none."""
    hull = _hull_area(np.stack([x, y], axis=1))
    return _outline_area(x, y) / hull if hull > 0 else np.nan


def letters(x: np.ndarray, y: np.ndarray) -> list[tuple[int, float, float, float, float]]:
    """(label, area, cx, cy, solidity) of the plausible components of one mask's lit pixels, as ``label``, ``features``, ``plausible`` and ``convexity`` have them.

    Beyond the first SHAPES the solidity is NaN.
    """
    order = np.lexsort([x, y])
    x, y = x[order], y[order]
    k = label_pixels(x, y)
    out: list[tuple[int, float, float, float, float]] = []
    for n, at in enumerate(np.split(np.argsort(k, kind="stable"), np.cumsum(np.bincount(k))[:-1]) if len(k) else [], 1):
        u, v = x[at], y[at]
        aspect = (u.max() - u.min() + 1) / (v.max() - v.min() + 1)
        if AREA[0] <= len(at) <= AREA[1] and ASPECT[0] <= aspect <= ASPECT[1]:
            out.append((n, float(len(at)), float(u.mean()), float(v.mean()), solidity(u, v) if len(out) < SHAPES else np.nan))
    return out


def convexity(labels: DataFrame, keys: Sequence[str] = ("image_id",), most: int = SHAPES, tasks: int = 0) -> DataFrame:
    """(keys, label, convexity) of the first ``most`` of the components given: outline area over the area of its hull.

    A group finds its first components itself, so ``labels`` is read once, and is dealt to ``tasks`` (``groups.dealt``).
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, own in f[f["label"].isin(np.unique(f["label"])[:most])].groupby("label"):
            out.append((*(f[c].iloc[0] for c in keys), k, solidity(own["x"].to_numpy(np.int64), own["y"].to_numpy(np.int64))))
        return pd.DataFrame(out, columns=[*keys, "label", "convexity"])

    schema = ", ".join(f"{k} {labels.schema[k].dataType.simpleString()}" for k in [*keys, "label"]) + ", convexity double"
    return dealt(labels.select(*keys, "label", "x", "y"), *keys, tasks=tasks).groupBy(*keys).applyInPandas(run, schema).where(~F.isnan("convexity"))


def component_boxes(components: DataFrame) -> DataFrame:
    return components.select("*", geo.box("min_x", "min_y", F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1).alias("box"))
