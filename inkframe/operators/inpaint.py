"""Masks of whole images, the part of an image to repair, and repair by fast marching."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.functions import geometry as geo
from inkframe.operators import models, tiles
from inkframe.operators.groups import dealt
from inkframe.sources.stored import stored

#: Pixels of context around a mask.
CONTEXT = 64


def combine_masks(masks: DataFrame) -> DataFrame:
    """(image_id, x, y, v): the union of the masks of an image's regions, given in image coordinates."""
    return masks.groupBy("image_id", "x", "y").agg(F.max("v").cast("int").alias("v"))


def region_union(regions: DataFrame) -> DataFrame:
    return regions.groupBy("image_id").agg(geo.union_all_boxes(geo.box()).alias("b")).select("image_id", "b.*")


def has_pixels(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id").agg(F.max(F.col("v") > 0).alias("any"))


def mask_box(mask: DataFrame, compat: str = "reference") -> DataFrame:
    """(image_id, x, y, w, h, n) of the pixels over 0; images without any have no row.

    ``reference`` takes the size as largest minus smallest coordinate, ``intended`` adds the pixel missing there.
    """
    one = 0 if compat == "reference" else 1
    lit = mask.where("v > 0").groupBy("image_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("_x"), F.max("y").alias("_y"), F.count(F.lit(1)).alias("n"))
    return lit.select("image_id", "x", "y", (F.col("_x") - F.col("x") + one).alias("w"), (F.col("_y") - F.col("y") + one).alias("h"), "n")


def subregion(mask: DataFrame, sizes: DataFrame, context: int = CONTEXT, compat: str = "reference") -> DataFrame:
    """(image_id, x1, y1, x2, y2), half open: the mask's box with ``context`` pixels around it, within the image (image_id, width, height)."""
    rows = mask_box(mask, compat).join(sizes.select("image_id", "width", "height"), "image_id")
    d = rows.select("image_id", geo.dilate(geo.box(), context, F.col("width"), F.col("height")).alias("d"))
    return d.select("image_id", F.col("d.x").alias("x1"), F.col("d.y").alias("y1"), (F.col("d.x") + F.col("d.w")).alias("x2"), (F.col("d.y") + F.col("d.h")).alias("y2"))


def coverage(mask: DataFrame, sizes: DataFrame, compat: str = "reference") -> DataFrame:
    """(image_id, n, area, density, share): lit pixels, area of their box, and per cent of the box and of the image."""
    rows = mask_box(mask, compat).join(sizes.select("image_id", "width", "height"), "image_id")
    area = F.col("w") * F.col("h")
    return rows.select("image_id", "n", area.alias("area"), F.when(area > 0, F.col("n") * 100.0 / area).otherwise(0.0).alias("density"), (F.col("n") * 100.0 / (F.col("width") * F.col("height"))).alias("share"))


def _fill(image: np.ndarray, hole: np.ndarray, radius: int) -> np.ndarray:
    """Telea's fast marching: from the border inwards, each pixel from the known ones within ``radius``."""
    h, w = hole.shape
    out = image.astype(np.float64)
    far = np.where(hole, 1e6, 0.0)
    known = ~hole
    heap = []
    ring = known & (np.pad(hole, 1)[:-2, 1:-1] | np.pad(hole, 1)[2:, 1:-1] | np.pad(hole, 1)[1:-1, :-2] | np.pad(hole, 1)[1:-1, 2:])
    for y, x in zip(*np.nonzero(ring)):
        heapq.heappush(heap, (0.0, int(y), int(x)))
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]

    def solve(y: int, x: int) -> float:
        best = 1e6
        for a, b in (((-1, 0), (0, -1)), ((1, 0), (0, -1)), ((-1, 0), (0, 1)), ((1, 0), (0, 1))):
            t = []
            for dy, dx in (a, b):
                if 0 <= y + dy < h and 0 <= x + dx < w and known[y + dy, x + dx]:
                    t.append(far[y + dy, x + dx])
            if len(t) == 2 and abs(t[0] - t[1]) < 1:
                best = min(best, (t[0] + t[1] + np.sqrt(2 - (t[0] - t[1]) ** 2)) / 2)
            elif t:
                best = min(best, 1 + min(t))
        return best

    while heap:
        _, y, x = heapq.heappop(heap)
        known[y, x] = True
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            j, i = y + dy, x + dx
            if not (0 <= j < h and 0 <= i < w) or known[j, i]:
                continue
            far[j, i] = solve(j, i)
            gy = gx = 0.0
            if 0 < j < h - 1 and known[j - 1, i] and known[j + 1, i]:
                gy = (far[j + 1, i] - far[j - 1, i]) / 2
            if 0 < i < w - 1 and known[j, i - 1] and known[j, i + 1]:
                gx = (far[j, i + 1] - far[j, i - 1]) / 2
            total, weight = np.zeros(out.shape[2]), 0.0
            for oy, ox in offsets:
                b, a = j + oy, i + ox
                if 0 <= b < h and 0 <= a < w and known[b, a]:
                    d2 = oy * oy + ox * ox
                    along = abs(oy * gy + ox * gx) / np.sqrt(d2)
                    k = max(along, 1e-6) / d2 / (1 + abs(far[b, a] - far[j, i]))
                    total += k * out[b, a]
                    weight += k
            out[j, i] = total / weight if weight else out[y, x]
            known[j, i] = True
            heapq.heappush(heap, (far[j, i], j, i))
    return np.clip(np.rint(out), 0, 255).astype(np.int64)


def _part(hole: np.ndarray, context: int | None) -> tuple[slice, slice]:
    """The box of the lit pixels with ``context`` pixels around it, within the image; all of it without a context."""
    if context is None:
        return slice(None), slice(None)
    y, x = np.nonzero(hole)
    return tuple(slice(max(0, int(c.min()) - context), min(n, int(c.max()) + 1 + context)) for c, n in ((y, hole.shape[0]), (x, hole.shape[1])))


def _by_image(pixels: DataFrame, mask: DataFrame, over: int, fill: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    rows = pixels.select("image_id", "x", "y", "b", "g", "r").join(mask.select("image_id", "x", "y", "v"), ["image_id", "x", "y"], "left")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, y = (f[c].to_numpy() for c in "xy")
        x, y = x - x.min(), y - y.min()
        hole = np.zeros((y.max() + 1, x.max() + 1), bool)
        hole[y, x] = (f["v"].fillna(0) > over).to_numpy()
        image = np.zeros((*hole.shape, 3), np.int64)
        image[y, x] = f[["b", "g", "r"]].to_numpy()
        if hole.any():
            image = fill(image, hole)
        return f.drop(columns="v").assign(**{c: image[y, x, k] for k, c in enumerate("bgr")})

    return rows.groupBy("image_id").applyInPandas(run, "image_id bigint, x bigint, y bigint, b bigint, g bigint, r bigint")


def telea(pixels: DataFrame, mask: DataFrame, radius: int = 3, over: int = 0, context: int | None = None) -> DataFrame:
    """(image_id, x, y, b, g, r): pixels whose mask exceeds ``over`` filled from around them; others as they are.

    One group is one image: the marching front is sequential. With ``context`` only the mask's box and so many
    pixels around it are filled and put back. Images without such pixels pass through.
    """
    if radius <= 0:
        raise ValueError("the radius is positive")

    def fill(image: np.ndarray, hole: np.ndarray) -> np.ndarray:
        part = _part(hole, context)
        if not hole[part].all():
            image[part] = _fill(image[part], hole[part], radius)
        return image

    return _by_image(pixels, mask, over, fill)


def telea_by_hole(pixels: DataFrame, mask: DataFrame, radius: int = 3, over: int = 0, tile: int = tiles.TILE) -> DataFrame:
    """The same pixels as ``telea``, hole by hole, for images of any size: (image_id, x, y, b, g, r; x and y from 0).

    A filled pixel depends on pixels within ``radius``, and through them on holes that lie so near. So the mask is grown by one
    more (``tiles.by_tiles``) and its components (``tiles.label``) are holes, or holes near each other, with all the pixels that
    they need. Each is a group of its own; the image's other pixels stay where they are. A task holds one such group.
    """
    if radius <= 0:
        raise ValueError("the radius is positive")
    hole = F.coalesce(F.col("v") > over, F.lit(False))
    rows = pixels.select("image_id", "x", "y", "b", "g", "r").join(mask.select("image_id", "x", "y", "v"), ["image_id", "x", "y"], "left")
    rows = rows.withColumn("hole", hole).withColumn("v", F.when(F.col("hole"), 255).otherwise(0).cast("int"))
    near = stored(tiles.by_tiles(rows, (("rectangle", radius + 1, radius + 1, True),), tile=tile))
    around = near.where("v > 0").drop("v").join(tiles.label(near, tile=tile).hint("merge"), ["image_id", "x", "y"])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, y = (f[c].to_numpy() for c in "xy")
        x, y = x - x.min(), y - y.min()
        lit, image = np.zeros((y.max() + 1, x.max() + 1), bool), np.zeros((y.max() + 1, x.max() + 1, 3), np.int64)
        lit[y, x] = f["hole"].to_numpy(bool)
        image[y, x] = f[["b", "g", "r"]].to_numpy()
        if not lit[y, x].all():
            image = _fill(image, lit, radius)
        return f[["image_id", "x", "y"]].assign(**{c: image[y, x, k] for k, c in enumerate("bgr")})

    kinds = "image_id bigint, x bigint, y bigint, b bigint, g bigint, r bigint"
    filled = dealt(around, "image_id", "label").groupBy("image_id", "label").applyInPandas(run, kinds)
    return filled.unionByName(near.where("v = 0").select(*(F.col(c).cast("bigint").alias(c) for c in ("image_id", "x", "y", "b", "g", "r"))))


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """``a`` (H x W x channels) at another size, each new pixel the mean of the area that it covers."""

    def shares(n: int, m: int) -> np.ndarray:
        edge, own = np.arange(m + 1) * (n / m), np.arange(n)
        cover = np.minimum(edge[1:, None], own + 1) - np.maximum(edge[:-1, None], own)
        cover = np.clip(cover, 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return np.einsum("yi,ijc,xj->yxc", shares(a.shape[0], height), a.astype(float), shares(a.shape[1], width))


def fill_by_model(pixels: DataFrame, mask: DataFrame, name: str, load: Callable[[], Callable], over: int = 127, context: int | None = CONTEXT) -> DataFrame:
    """``pixels`` with the masked ones as a model paints them.

    The model takes (height x width x 3 in r, g, b; height x width of 0 and 255) and returns an image; it is loaded once
    a worker and, when it fails, once more. It gets the mask's box with ``context`` pixels around it (None: the
    whole image); its answer is brought to that size and put back there.
    """

    def fill(image: np.ndarray, hole: np.ndarray) -> np.ndarray:
        part = _part(hole, context)
        given, lit = np.ascontiguousarray(image[part][:, :, ::-1]).astype(np.uint8), np.where(hole[part], 255, 0).astype(np.uint8)
        found = np.asarray(models.retried(name, load, lambda model: model(given, lit)))
        if found.ndim != 3 or found.shape[2] < 3:
            raise ValueError("the model's answer is no colour image")
        found = found[:, :, :3]
        if found.shape[:2] != lit.shape:
            found = np.rint(resized(found, *lit.shape))
        image[part] = np.clip(found, 0, 255).astype(np.int64)[:, :, ::-1]
        return image

    return _by_image(pixels, mask, over, fill)
