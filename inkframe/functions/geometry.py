"""Boxes and polygons: Column expressions on struct<x,y,w,h>; y grows downwards, sizes are in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x="x", y="y", w="w", h="h") -> Column:
    made = [F.col(c) if isinstance(c, str) else c for c in (x, y, w, h)]
    return F.struct(*(c.cast("long").alias(n) for c, n in zip(made, "xywh")))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def overlap_area(a: Column, b: Column) -> Column:
    """Area of the intersection; boxes that only touch have none."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("double")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, 0 where that is 0."""
    small = F.least(area(a), area(b))
    return F.when(small == 0, F.lit(0.0)).otherwise(overlap_area(a, b) / small)


def union_box(a: Column, b: Column) -> Column:
    return from_corners(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"]))


def union_all_boxes(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return from_corners(x, y, F.max(b["x"] + b["w"]), F.max(b["y"] + b["h"]))


def as_fraction(conf: Column) -> Column:
    """A confidence over 1 is a percentage; exactly 1 stays."""
    return F.when(conf > 1.0, conf / 100.0).otherwise(conf)


def noisy_or(confidences: Column) -> Column:
    """1 - the product of (1 - c); 0 for an empty array."""
    return F.aggregate(confidences, F.lit(1.0), lambda acc, c: acc * (1.0 - as_fraction(c)), lambda acc: 1.0 - acc)


def pad(b: Column, width: Column, height: Column, share: float = 0.1) -> Column:
    """Grown by ``share`` of its size on each side (truncated); the left and top stop at 0, the size at the image."""
    pw, ph = (b["w"] * share).cast("long"), (b["h"] * share).cast("long")
    x, y = F.greatest(F.lit(0), b["x"] - pw), F.greatest(F.lit(0), b["y"] - ph)
    return box(x, y, F.least(width - x, b["w"] + 2 * pw), F.least(height - y, b["h"] + 2 * ph))


def clip_forced(b: Column, width: Column, height: Column) -> Column:
    """A given box cut to the image if it leaves it; sizes follow the uncut corner, so they may not be positive."""
    cut = box(F.least(b["x"], width - 1), F.least(b["y"], height - 1), F.least(b["w"], width - b["x"]), F.least(b["h"], height - b["y"]))
    return F.when((b["x"] + b["w"] > width) | (b["y"] + b["h"] > height), cut).otherwise(b)


def clamp(b: Column, width: Column, height: Column) -> Column:
    x, y = (F.greatest(F.lit(0), F.least(b[c], n - 1)) for c, n in (("x", width), ("y", height)))
    return box(x, y, F.least(b["w"], width - x), F.least(b["h"], height - y))


def dilate(b: Column, by, width: Column | None = None, height: Column | None = None) -> Column:
    """Grown by ``by`` pixels on each side, within the image if its size is given."""
    x1, y1, x2, y2 = b["x"] - by, b["y"] - by, b["x"] + b["w"] + by, b["y"] + b["h"] + by
    if width is not None:
        x1, y1, x2, y2 = F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1), F.least(width, x2), F.least(height, y2)
    return from_corners(x1, y1, x2, y2)


def dilate_percent(b: Column, percent: float, width: Column, height: Column) -> Column:
    """Grown on each side by the mean of half ``percent`` of width and height, both truncated first."""
    by = F.floor(((b["w"] * (percent / 2)).cast("long") + (b["h"] * (percent / 2)).cast("long")) / 2)
    return dilate(b, by, width, height)


def polygon_box(points: Column) -> Column:
    """Box of an array<struct<x,y>>; corner and size are truncated one by one."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return box(x.cast("long"), y.cast("long"), (F.array_max(xs) - x).cast("long"), (F.array_max(ys) - y).cast("long"))


def unrotate(b: Column, height: Column) -> Column:
    """A box found on the image turned 90 degrees clockwise, in the coordinates of the image of that height."""
    return box(b["y"], height - b["x"] - b["w"], b["h"], b["w"])


def rotate_point(x: Column, y: Column, height: Column) -> tuple[Column, Column]:
    """Where a pixel goes when its image is turned 90 degrees clockwise."""
    return height - 1 - y, x


def baseline_boxes(width: Column, height: Column) -> Column:
    """array of two boxes: the usual places of a mark, along the bottom and the right, from the lower right corner."""
    quarter = {"w": F.floor(width / 4), "h": F.floor(height / 4)}
    thin = {"w": F.floor(width / 16), "h": F.floor(height / 16)}
    return F.array(box(width - quarter["w"], height - thin["h"], quarter["w"], thin["h"]), box(width - thin["w"], height - quarter["h"], thin["w"], quarter["h"]))


def expanded(b: Column, width: Column, height: Column, factor: float = 1.414) -> Column:
    """The region around a box that stands for its background: ``factor`` as large, centred, moved into the image."""

    def along(at: str, n: str, most: Column) -> tuple[Column, Column]:
        new = (b[n] * factor).cast("long")
        ideal = b[at] + F.floor(b[n] / 2) - F.floor(new / 2)
        start = F.greatest(F.lit(0), F.least(ideal, most - new))
        return start, F.least(new, most - start)

    (x, w), (y, h) = along("x", "w", width), along("y", "h", height)
    return box(x, y, w, h)


def holds(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x"]) & (x < b["x"] + b["w"]) & (y >= b["y"]) & (y < b["y"] + b["h"])


def label_position(b: Column, place: str, label_w: Column, label_h: Column) -> Column:
    """struct<x,y> where a box's label goes: above it, or below where the box is within 30 pixels of the top."""
    x = b["x"] + b["w"] - label_w - 5 if place == "top_right" else b["x"]
    below = b["y"] + label_h + 5 if place in ("top_left", "top_right") else b["y"] + b["h"] + 20
    return F.struct(x.alias("x"), F.when(b["y"] > 30, b["y"] - 10).otherwise(below).alias("y"))


def parse_box(text: Column) -> Column:
    """struct box of 'x,y,w,h' (whole numbers, none negative, sizes positive); null for anything else."""
    parts = F.split(text, ",")
    v = [F.try_element_at(parts, F.lit(k + 1)).try_cast("long") for k in range(4)]
    good = (F.size(parts) == 4) & (v[0] >= 0) & (v[1] >= 0) & (v[2] > 0) & (v[3] > 0)
    return F.when(good, box(*v))


def whole_box(text: str) -> tuple[int, int, int, int]:
    """``parse_box`` for one text outside of a table; blanks around numbers are allowed. Raises ValueError for anything that is no box."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError("a box is four numbers x,y,w,h")
    x, y, w, h = (int(p) for p in parts)
    if min(x, y) < 0 or min(w, h) <= 0:
        raise ValueError("a box lies at no negative place and has positive sizes")
    return x, y, w, h


def megapixels(width: Column, height: Column) -> Column:
    return width * height / 1e6
