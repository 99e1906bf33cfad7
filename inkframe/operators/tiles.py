"""Morphology and labels of masks too large for a task: square tiles, with a border as wide as the kernels reach.

A chain of steps is told as tuples: ("rectangle", reach_x, reach_y, grow), ("ellipse", size, grow), ("blur", size, over). A tile
runs the whole chain on its own pixels and on a border; what the border's outer edge gets wrong never comes as far as the tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators import graph, morphology
from inkframe.operators.components import label_pixels
from inkframe.operators.groups import dealt
from inkframe.sources.stored import stored

#: Side of a tile in pixels.
TILE = 256

Step = tuple
CLOSE: tuple[Step, ...] = (("rectangle", 5, 5, True), ("rectangle", 5, 5, False))
CLEAN: tuple[Step, ...] = (*CLOSE, ("ellipse", 13, True), ("blur", 9, 127))
OPEN: tuple[Step, ...] = (("ellipse", 5, False), ("ellipse", 5, True), ("ellipse", 3, False), ("ellipse", 2, True))


def reach(steps: Sequence[Step]) -> tuple[int, int]:
    """How far a pixel's result depends on others, along x and along y."""
    x = y = 0
    for s in steps:
        if s[0] == "rectangle":
            x, y = x + s[1], y + s[2]
        elif s[0] == "ellipse":
            x, y = x + max(morphology.half_widths(s[1])), y + s[1] // 2
        else:
            x, y = x + (s[1] + 1) // 2, y + (s[1] + 1) // 2
    return x, y


def _line(a: np.ndarray, here: np.ndarray, by: int, axis: int, grow: bool) -> np.ndarray:
    """Largest (or smallest) of the pixels that are there within ``by`` along an axis; of several masks of one shape, if ``a`` has three axes."""
    f, none = (np.maximum, 0) if grow else (np.minimum, 255)
    out = np.where(here, a, none)
    a = out.copy() if by else out
    for d in range(1, by + 1):
        for to, of in (((slice(d, None)), slice(None, -d)), (slice(None, -d), slice(d, None))):
            to, of = ((..., to, slice(None)), (..., of, slice(None))) if axis == 0 else ((..., to), (..., of))
            f(out[to], a[of], out=out[to])
    return out


def _ellipse(a: np.ndarray, here: np.ndarray, size: int, grow: bool) -> np.ndarray:
    widths = morphology.half_widths(size)
    parts = [_line(_line(a, here, w, 1, grow), here, max(dy for dy, own in enumerate(widths) if own >= w), 0, grow) for w in set(widths)]
    return np.maximum.reduce(parts) if grow else np.minimum.reduce(parts)


def _blur(a: np.ndarray, here: np.ndarray, size: int, over: int) -> np.ndarray:
    """Gaussian blur and threshold; each line mirrors at its first and last pixel without repeating them."""
    if size <= 1:
        return a
    size += 1 - size % 2
    half, s, full = size // 2, np.where(here, a, 0).astype(np.float64), here.all()
    for axis in (1, 0):
        n = a.shape[axis]
        if full:  # every line is as long, so they are mirrored as one
            to = np.arange(-half, n + half)
            to = np.where(to < 0, -to, np.where(to > n - 1, 2 * (n - 1) - to, to))
            s, total = s.take(np.clip(to, 0, n - 1), axis), np.zeros(s.shape)
            for k, w in enumerate(morphology.weights(size)):
                total = total + (s[:, k : k + n] if axis else s[k : k + n]) * w
            s = total
            continue
        at = np.arange(n)[None, :] if axis else np.arange(n)[:, None]
        first, last = here.argmax(axis=axis), n - 1 - np.flip(here, axis).argmax(axis=axis)
        lo, hi = np.expand_dims(first, axis), np.expand_dims(last, axis)
        total = np.zeros(s.shape)
        for k, w in enumerate(morphology.weights(size)):
            to = at + (k - half)
            to = np.where(to < lo, 2 * lo - to, np.where(to > hi, 2 * hi - to, to))
            total = total + np.take_along_axis(s, np.clip(to, lo, hi), axis) * w
        s = total
    return np.where(np.round(s, 6) >= over + 0.5, 255, 0)


def run_steps(x: np.ndarray, y: np.ndarray, v: np.ndarray, steps: Sequence[Step]) -> np.ndarray:
    """``v`` of the given pixels after a chain of steps; pixels that aren't given are no part of the mask."""
    if not len(x):
        return v
    row, col = y - y.min(), x - x.min()
    a, here = np.zeros((row.max() + 1, col.max() + 1), np.int32), np.zeros((row.max() + 1, col.max() + 1), bool)
    a[row, col], here[row, col] = v, True
    for s in steps:
        if s[0] == "rectangle":
            a = _line(_line(a, here, s[1], 1, s[3]), here, s[2], 0, s[3])
        elif s[0] == "ellipse":
            a = _ellipse(a, here, s[1], s[2])
        else:
            a = _blur(a, here, s[1], s[2])
    return a[row, col]


def run_each(x: np.ndarray, y: np.ndarray, own: np.ndarray, steps: Sequence[Step], cells: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(k, which of the given pixels are lit) of each mask k, the pixels where ``own`` is k, after a chain of steps without blur.

    ``own`` may have several rows, each a partition of the pixels by numbers of its own. Masks run together as one array, as many as have ``cells`` pixels. One that a step leaves without a pixel stays so and leaves the array.
    """
    if not len(x):
        return
    row, col = y - y.min(), x - x.min()
    here = np.zeros((row.max() + 1, col.max() + 1), bool)
    here[row, col] = True
    own = np.atleast_2d(own)
    ks = np.unique(own)
    at_once = max(1, cells // here.size)
    for lo in range(0, len(ks), at_once):
        lot = ks[lo : lo + at_once]
        a = np.zeros((len(lot), *here.shape), np.uint8)
        of = np.searchsorted(lot, own).clip(0, len(lot) - 1)
        mine = lot[of] == own
        at = np.nonzero(mine)[1]
        a[of[mine], row[at], col[at]] = 255
        rest = np.arange(len(lot))
        for s in steps:
            a = _line(_line(a, here, s[1], 1, s[3]), here, s[2], 0, s[3]) if s[0] == "rectangle" else _ellipse(a, here, s[1], s[2])
            lit = np.where(here, a, 0).reshape(len(a), here.size).max(axis=1) > 0
            if not lit.all():
                a, rest = a[lit], rest[lit]
        left = dict(zip(rest.tolist(), a))
        for at, k in enumerate(lot):
            yield k, left[at][row, col] > 0 if at in left else np.zeros(len(row), bool)


def _cells(at: Column, by: int, tile: int) -> Column:
    return F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((at - by) / tile)), F.floor((at + by) / tile)))


def by_tiles(mask: DataFrame, steps: Sequence[Step], keys: Sequence[str] = ("image_id",), tile: int = TILE, tasks: int = 0) -> DataFrame:
    """``mask`` (keys, x, y, v; x and y from 0) after a chain of steps, tile by tile; columns beside these come along.

    One shuffle by tile, whatever the number of steps; a task holds one tile and its border, however large the mask. Pixels on
    borders are sent twice or more: (1 + 2 * reach / tile)^2 of all, 1.4 times for the cleaning of text at 256. The tiles are dealt to
    ``tasks`` (``groups.dealt``).
    """
    bx, by = reach(steps)
    rows = mask.select("*", _cells(F.col("x"), bx, tile).alias("_tx")).select("*", _cells(F.col("y"), by, tile).alias("_ty"))

    names = mask.columns

    def run(t: pa.Table) -> pa.Table:
        x, y, v = (t[c].to_numpy().astype(np.int64, copy=False) for c in "xyv")
        own = (x // tile == t["_tx"][0].as_py()) & (y // tile == t["_ty"][0].as_py())
        out = t.select(names)
        if not own.any():
            return out.slice(0, 0)
        at = names.index("v")
        return out.set_column(at, out.schema.field(at), pa.array(run_steps(x, y, v.astype(np.int32), steps), pa.int64()).cast(out.schema.field(at).type)).filter(pa.array(own))

    return dealt(rows, *keys, "_tx", "_ty", tasks=tasks).groupBy(*keys, "_tx", "_ty").applyInArrow(run, mask.schema)


#: A pixel as one number that orders as (y, x) does.
_SPAN = 1 << 31


def _spot(x: Column, y: Column) -> Column:
    return y.cast("long") * _SPAN + x


def label(mask: DataFrame, keys: Sequence[str] = ("image_id",), tile: int = TILE) -> DataFrame:
    """(keys, x, y, label) of the pixels over 0, as ``components.label`` has them, for masks of any size.

    Tiles are labelled by themselves, and a part is named after its first pixel. Pixels at the lines between tiles meet their
    neighbours across by a join, which links parts; ``graph.connected`` makes components of them, named after their first pixel
    too, whose rank in the mask is the label. Only the parts of a mask, not its pixels, are ever sorted together. Joins of pixels say that
    they merge: stored pixels take few bytes in a file, by which they would be broadcast, and very many in memory.
    """
    keys = list(keys)
    lit = mask.where("v > 0").select(*keys, "x", "y").withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    kinds = ", ".join(f"{c} {lit.schema[c].dataType.simpleString()}" for c in (*keys, "x", "y"))

    def own(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"])[[*keys, "x", "y"]]
        k = label_pixels(f["x"].to_numpy(), f["y"].to_numpy())
        at = f["y"].to_numpy(np.int64) * _SPAN + f["x"].to_numpy(np.int64)
        return f.assign(part=at[np.unique(k, return_index=True)[1]][k])

    parts = stored(dealt(lit, *keys, "_tx", "_ty").groupBy(*keys, "_tx", "_ty").applyInPandas(own, kinds + ", part bigint"))
    at_x, at_y = F.pmod(F.col("x"), F.lit(tile)), F.pmod(F.col("y"), F.lit(tile))
    inner, outer = (at_x == 0) | (at_y == 0), (at_x == tile - 1) | (at_y == tile - 1)
    across = F.array_union(
        F.when(at_x == 0, F.array(*(_spot(F.col("x") - 1, F.col("y") + d) for d in (-1, 0, 1)))).otherwise(F.array().cast("array<bigint>")),
        F.when(at_y == 0, F.array(*(_spot(F.col("x") + d, F.col("y") - 1) for d in (-1, 0, 1)))).otherwise(F.array().cast("array<bigint>")),
    )
    asked = parts.where(inner).select(*keys, F.col("part").alias("a"), F.explode(across).alias("spot"))
    met = parts.where(outer | inner).select(*keys, F.col("part").alias("b"), _spot(F.col("x"), F.col("y")).alias("spot"))
    links = asked.join(met.hint("merge"), [*keys, "spot"]).where("a <> b").select(*keys, "a", "b")
    joined = graph.connected(links, keys)
    names = parts.select(*keys, "part").distinct().join(joined.withColumnRenamed("node", "part").hint("merge"), [*keys, "part"], "left")
    names = names.select(*keys, "part", F.coalesce("component", "part").alias("component"))
    numbered = names.withColumn("label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("component")).cast("bigint"))
    return parts.join(numbered.hint("merge"), [*keys, "part"]).select(*keys, "x", "y", "label")
