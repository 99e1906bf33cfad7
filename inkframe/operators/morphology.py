"""Mask morphology by windows: dense masks (keys, x, y, v) with v 0 or 255, one row a pixel.

Pixels outside a mask are ignored, so a mask cut to a region never grows past it. Windows run along rows
and columns. Operations of several passes first bring each mask together (``whole``): one shuffle, after
which every pass only sorts. For masks too large for a task ``tiles.by_tiles`` runs the same chains in tiles, after one shuffle;
``together=False`` here shuffles by row or column at each change between them, unless the mask comes partitioned by image,
as when the pixels were made so: then nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.groups import dealt


def whole(mask: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``mask`` partitioned by its first key (the image), which serves windows by (keys, row) and by (keys, column).

    Dealt to a set number of tasks: by its bytes, of which a mask has few, adaptive execution would bring most of a table together,
    and each of the many sorts that follow holds the rows of a task.
    """
    return dealt(mask, keys[0])


def _along(keys: Sequence[str], line: str, at: str, reach: int):
    return Window.partitionBy(*keys, line).orderBy(at).rangeBetween(-reach, reach)


def rectangle(mask: DataFrame, reach_x: int, reach_y: int, keys: Sequence[str] = ("image_id",), grow: bool = True) -> DataFrame:
    """Dilation (or erosion) by a rectangle of 2 * reach + 1: two passes, as it is separable."""
    f = F.max if grow else F.min
    rows = mask.withColumn("v", f("v").over(_along(keys, "y", "x", reach_x)))
    return rows.withColumn("v", f("v").over(_along(keys, "x", "y", reach_y)))


def half_widths(size: int) -> list[int]:
    """Half the width of each row of a filled ellipse of ``size``, from the middle row outwards."""
    r = size // 2
    c = size - 1 - r
    return [round(c * math.sqrt(max(0.0, (r * r - dy * dy)) / (r * r))) if r else 0 for dy in range(r + 1)]


def ellipse(mask: DataFrame, size: int, keys: Sequence[str] = ("image_id",), grow: bool = True) -> DataFrame:
    """Dilation (or erosion) by a filled ellipse: one row pass for each distinct width, one column pass for each height."""
    f, pick = (F.max, F.greatest) if grow else (F.min, F.least)
    widths = half_widths(size)
    rows = mask
    for w in sorted(set(widths)):
        rows = rows.withColumn(f"_w{w}", f("v").over(_along(keys, "y", "x", w)))
    column = Window.partitionBy(*keys, "x").orderBy("y")
    parts = []
    for w in sorted(set(widths)):
        reach = max(dy for dy, own in enumerate(widths) if own >= w)
        parts.append(f(f"_w{w}").over(column.rangeBetween(-reach, reach)))
    out = parts[0] if len(parts) == 1 else pick(*parts)
    return rows.withColumn("v", out).select(*mask.columns)


def weights(size: int) -> list[float]:
    """Gaussian kernel of ``size`` whose sigma follows from it: 0.3 * ((size - 1) / 2 - 1) + 0.8."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [w / sum(raw) for w in raw]


def blur_threshold(mask: DataFrame, size: int, keys: Sequence[str] = ("image_id",), over: int = 127) -> DataFrame:
    """Gaussian blur, then 255 where it exceeds ``over``. The mask's edge mirrors without repeating itself.

    Masks are full rectangles here; a rectangle narrower than half the kernel mirrors at its own middle.
    """
    if size <= 1:
        return mask
    size += 1 - size % 2
    reach, kernel = size // 2, weights(size)
    out = mask.withColumn("_s", F.col("v").cast("double"))
    for line, at in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(*keys, line).orderBy(at)
        whole = Window.partitionBy(*keys, line)
        out = out.withColumns({"_lo": F.min(at).over(whole), "_hi": F.max(at).over(whole)})
        total = F.lit(0.0)
        named = {f"_d{d + 2 * reach}": F.lag("_s", -d).over(w) if d < 0 else F.lead("_s", d).over(w) if d > 0 else F.col("_s") for d in range(-2 * reach, 2 * reach + 1)}
        out = out.withColumns(named)
        at_offset = F.array(*(F.col(f"_d{k}") for k in range(4 * reach + 1)))
        place, lo, hi = F.col(at), F.col("_lo"), F.col("_hi")
        for k, weight in enumerate(kernel):
            to = place + (k - reach)
            mirrored = F.when(to < lo, 2 * lo - to).when(to > hi, 2 * hi - to).otherwise(to)
            held = F.greatest(lo, F.least(hi, mirrored))
            total = total + F.element_at(at_offset, (held - place + 2 * reach + 1).cast("int")) * weight
        out = out.withColumn("_t", total).drop(*named, "_lo", "_hi", "_s").withColumnRenamed("_t", "_s")
    # Rounded to whole values half up, after the noise of summing is rounded away.
    return out.withColumn("v", F.when(F.round("_s", 6) >= over + 0.5, 255).otherwise(0).cast("int")).select(*mask.columns)


def _close(mask: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    r = size // 2
    return rectangle(rectangle(mask, r, r, keys), r, r, keys, grow=False)


def close(mask: DataFrame, size: int = 11, keys: Sequence[str] = ("image_id",), together: bool = True) -> DataFrame:
    return _close(whole(mask, keys) if together else mask, size, keys)


def clean(mask: DataFrame, keys: Sequence[str] = ("image_id",), together: bool = True) -> DataFrame:
    """Close by a rectangle of 11, dilate by an ellipse of 13, smooth by a Gaussian of 9."""
    mask = whole(mask, keys) if together else mask
    return blur_threshold(ellipse(_close(mask, 11, keys), 13, keys), 9, keys)


def expand(mask: DataFrame, by: int, keys: Sequence[str] = ("image_id",), together: bool = True) -> DataFrame:
    if by <= 0:
        return mask
    return rectangle(whole(mask, keys) if together else mask, by, by, keys)


def smooth(mask: DataFrame, size: int, keys: Sequence[str] = ("image_id",), together: bool = True) -> DataFrame:
    return blur_threshold(whole(mask, keys) if together else mask, size, keys)


def open_erode_dilate(mask: DataFrame, keys: Sequence[str] = ("image_id",), times: int = 3, together: bool = True) -> DataFrame:
    """``times`` rounds of opening by an ellipse of 5, erosion by one of 3 and dilation by one of 2."""
    mask = whole(mask, keys) if together else mask
    for _ in range(times):
        mask = ellipse(ellipse(mask, 5, keys, grow=False), 5, keys)
        mask = ellipse(ellipse(mask, 3, keys, grow=False), 2, keys)
    return mask
