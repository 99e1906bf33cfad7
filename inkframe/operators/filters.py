"""Filters that prepare an image for detection: local contrast, edge-preserving blur, edges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import color
from inkframe.operators.groups import dealt
from inkframe.operators.tiles import label as across_tiles
from inkframe.sources.stored import stored


def contrast(gray: np.ndarray, tiles: int = 4, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: a clipped histogram a tile, maps blended between tiles."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(full[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            spare = int(np.clip(n - limit, 0, None).sum())
            n = np.minimum(n, limit) + spare // 256
            rest = spare % 256
            if rest:
                n[:: max(1, 256 // rest)][:rest] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(n) * 255.0 / (th * tw)), 0, 255)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[np.clip(y, 0, tiles - 1)[:, None], np.clip(x, 0, tiles - 1)[None, :], gray]
    out = (at(y0, x0) * (1 - wx) + at(y0, x0 + 1) * wx) * (1 - wy) + (at(y0 + 1, x0) * (1 - wx) + at(y0 + 1, x0 + 1) * wx) * wy
    return np.clip(np.rint(out), 0, 255).astype(np.int64)


def bilateral(gray: np.ndarray, size: int = 9, sigma_color: float = 100, sigma_space: float = 75) -> np.ndarray:
    """Mean of the disc around a pixel, weighted by nearness in place and in value; the edge mirrors."""
    r = size // 2
    padded = np.pad(gray.astype(float), r, mode="reflect" if min(gray.shape) > r else "edge")
    total, weight = np.zeros(gray.shape), np.zeros(gray.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                near = padded[r + dy : r + dy + gray.shape[0], r + dx : r + dx + gray.shape[1]]
                k = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - (near - gray) ** 2 / (2 * sigma_color**2))
                total += k * near
                weight += k
    return np.rint(total / weight).astype(np.int64)


def canny(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """0 or 255: ridges of the Sobel gradient over ``high``, and those over ``low`` connected to them."""
    p = np.pad(gray.astype(float), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    ahead = {0: (q[1:-1, 2:], q[1:-1, :-2]), 45: (q[2:, 2:], q[:-2, :-2]), 90: (q[2:, 1:-1], q[:-2, 1:-1]), 135: (q[2:, :-2], q[:-2, 2:])}
    sector = (np.rint(angle / 45).astype(int) % 4) * 45
    ridge = np.zeros(m.shape, bool)
    for s, (a, b) in ahead.items():
        ridge |= (sector == s) & (m > b) & (m >= a)
    strong, weak = ridge & (m > high), ridge & (m > low)
    while True:
        n = np.pad(strong, 1)
        grown = weak & np.any([n[1 + dy : n.shape[0] - 1 + dy, 1 + dx : n.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        if (grown | strong).sum() == strong.sum():
            return strong.astype(np.int64) * 255
        strong |= grown


def contrast_table(gray: DataFrame, tiles: int = 4, clip: float = 2.0) -> DataFrame:
    """(image_id, x, y, v) as ``contrast`` has it, of gray values (image_id, x, y, v; x and y from 0) of images of any size.

    Counts a tile and value with partial sums; clipping and running sums on 256 rows a tile; the maps of all tiles of a value
    are one array, so a pixel finds the four that it blends by one join. No task ever holds an image.
    """
    size = gray.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    size = size.withColumns({"th": F.ceil(F.col("h") / tiles), "tw": F.ceil(F.col("w") / tiles)})
    rows = gray.select("image_id", "x", "y", "v").join(size, "image_id")
    spare_h, spare_w = F.col("th") * tiles - F.col("h"), F.col("tw") * tiles - F.col("w")
    mirrored = F.least("h", "w") > F.greatest(spare_h, spare_w)

    def places(at: str, n: str, spare: Column) -> Column:
        """A pixel's own place, and those beyond the image's end that show it again."""
        back = F.lit(2) * (F.col(n) - 1) - F.col(at)
        again = F.when(mirrored & (back >= F.col(n)) & (back < F.col(n) + spare), F.array(back))
        again = again.when(~mirrored & (F.col(at) == F.col(n) - 1) & (spare > 0), F.sequence(F.col(n), F.col(n) + spare - 1))
        return F.explode(F.concat(F.array(F.col(at)), F.coalesce(again, F.array().cast("array<bigint>"))))

    full = rows.select("*", places("y", "h", spare_h).alias("_y")).select("*", places("x", "w", spare_w).alias("_x"))
    own = ["image_id", "ti", "tj"]
    counts = full.groupBy("image_id", F.floor(F.col("_y") / F.col("th")).alias("ti"), F.floor(F.col("_x") / F.col("tw")).alias("tj"), "v").agg(F.count(F.lit(1)).alias("n"))
    every = size.select("image_id", (F.col("th") * F.col("tw")).alias("area"), F.explode(F.sequence(F.lit(0), F.lit(tiles * tiles * 256 - 1))).alias("_k"))
    every = every.select("image_id", F.col("area"), F.floor(F.col("_k") / (256 * tiles)).alias("ti"), F.pmod(F.floor(F.col("_k") / 256), F.lit(tiles)).alias("tj"), (F.col("_k") % 256).cast("long").alias("v"))
    limit = F.greatest(F.lit(1), F.floor(clip * F.col("area") / 256))
    n = F.coalesce("n", F.lit(0))
    bins = every.join(counts, [*own, "v"], "left").withColumns({"_n": F.least(n, limit), "_over": F.greatest(n - limit, F.lit(0))})
    tile = Window.partitionBy(*own)
    bins = bins.withColumn("_spare", F.sum("_over").over(tile))
    rest = F.col("_spare") % 256
    step = F.greatest(F.lit(1), F.floor(256 / F.greatest(rest, F.lit(1))))
    more = F.floor(F.col("_spare") / 256) + F.when((F.col("v") % step == 0) & (F.floor(F.col("v") / step) < rest), 1).otherwise(0)
    total = F.sum(F.col("_n") + more).over(tile.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    level = F.least(F.lit(255.0), F.rint(total * 255.0 / F.col("area")))
    place = (F.col("ti") * tiles + F.col("tj")).cast("int")
    maps = bins.select("image_id", "v", F.struct(place.alias("p"), level.alias("m")).alias("e")).groupBy("image_id", "v").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["m"]).alias("_m"))
    fy, fx = F.col("y") / F.col("th") - 0.5, F.col("x") / F.col("tw") - 0.5
    rows = rows.join(maps, ["image_id", "v"]).withColumns({"_y0": F.floor(fy), "_x0": F.floor(fx)}).withColumns({"_wy": fy - F.col("_y0"), "_wx": fx - F.col("_x0")})
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), c))
    at = lambda dy, dx: F.element_at("_m", (held(F.col("_y0") + dy) * tiles + held(F.col("_x0") + dx) + 1).cast("int"))
    line = lambda dy: at(dy, 0) * (1 - F.col("_wx")) + at(dy, 1) * F.col("_wx")
    out = line(0) * (1 - F.col("_wy")) + line(1) * F.col("_wy")
    return rows.select("image_id", "x", "y", F.least(F.lit(255), F.greatest(F.lit(0), F.rint(out))).cast("long").alias("v"))


def edges_table(gray: DataFrame, low: float = 50, high: float = 150, tasks: int = 0) -> DataFrame:
    """(image_id, x, y, edge) as ``canny`` has it, of gray values (image_id, x, y, v; full rectangles) of images of any size.

    Gradients and ridges by windows over the rows and columns of an image; weak ridges count where their component, across
    tiles (``tiles.label``), holds a strong one. At last pixels meet the lit ones in ``tasks`` (``groups.dealt``).
    """
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")

    def beside(c: str, w: Window, by: int, none: Column) -> Column:
        return F.coalesce((F.lag(c, -by) if by < 0 else F.lead(c, by)).over(w), none)

    own = F.col("v").cast("double")
    rows = gray.select("image_id", "x", "y", own.alias("v")).withColumn("_s", beside("v", down, -1, F.col("v")) + 2 * F.col("v") + beside("v", down, 1, F.col("v")))
    rows = rows.withColumns({"_gx": beside("_s", across, 1, F.col("_s")) - beside("_s", across, -1, F.col("_s")), "_t": beside("v", across, -1, F.col("v")) + 2 * F.col("v") + beside("v", across, 1, F.col("v"))})
    rows = rows.withColumn("_gy", beside("_t", down, 1, F.col("_t")) - beside("_t", down, -1, F.col("_t")))
    rows = rows.withColumn("_m", F.abs("_gx") + F.abs("_gy"))
    zero = F.lit(0.0)
    rows = rows.withColumns({"_u": beside("_m", down, -1, zero), "_d": beside("_m", down, 1, zero)})
    rows = rows.withColumns({f"{c}{'l' if by < 0 else 'r'}": beside(c, across, by, zero) for c in ("_u", "_m", "_d") for by in (-1, 1)})
    turn = F.degrees(F.atan2("_gy", "_gx"))
    sector = F.rint(F.when(turn < 0, turn + 180).when(turn >= 180, turn - 180).otherwise(turn) / 45).cast("int") % 4
    ahead = F.when(sector == 0, F.col("_mr")).when(sector == 1, F.col("_dr")).when(sector == 2, F.col("_d")).otherwise(F.col("_dl"))
    behind = F.when(sector == 0, F.col("_ml")).when(sector == 1, F.col("_ul")).when(sector == 2, F.col("_u")).otherwise(F.col("_ur"))
    ridge = (F.col("_m") > behind) & (F.col("_m") >= ahead)
    rows = stored(rows.select("image_id", "x", "y", F.when(ridge & (F.col("_m") > high), 2).when(ridge & (F.col("_m") > low), 1).otherwise(0).alias("v")))
    labels = across_tiles(rows)
    strong = labels.join(rows.where("v = 2").select("image_id", "x", "y").hint("merge"), ["image_id", "x", "y"]).select("image_id", "label").distinct()
    lit = labels.join(strong.hint("merge"), ["image_id", "label"], "left_semi").select("image_id", "x", "y", F.lit(255).cast("long").alias("edge"))
    return dealt(rows.select("image_id", "x", "y"), "image_id", "x", "y", tasks=tasks).join(lit.hint("merge"), ["image_id", "x", "y"], "left").na.fill(0, ["edge"])


def _per_image(rows: DataFrame, f, name: str, also: Sequence[str] = ()) -> DataFrame:
    """(image_id, x, y, also, name) of ``f`` over each image's gray values ``v``."""
    also = list(also)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        x, y = (d[c].to_numpy() for c in "xy")
        x, y = x - x.min(), y - y.min()
        image = np.zeros((y.max() + 1, x.max() + 1), np.int64)
        image[y, x] = d["v"].to_numpy()
        return d[["image_id", "x", "y", *also]].assign(**{name: f(image)[y, x]})

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in also)
    return rows.select("image_id", "x", "y", *also, "v").groupBy("image_id").applyInPandas(run, f"image_id bigint, x bigint, y bigint, {kinds}{name} bigint")


def gray_values(pixels: DataFrame, swap_rb: bool = True, also: Sequence[str] = ()) -> DataFrame:
    return pixels.select("image_id", "x", "y", *also, color.luma(F.col("b"), F.col("g"), F.col("r"), swap_rb).alias("v"))


def edges(pixels: DataFrame, low: float = 50, high: float = 150, also: Sequence[str] = ()) -> DataFrame:
    """(image_id, x, y, also, edge): columns named by ``also`` come along."""
    return _per_image(gray_values(pixels, False, also), lambda g: canny(g, low, high), "edge", also)


def prepare(pixels: DataFrame) -> DataFrame:
    """Pixels as detectors get them: gray with red and blue weights swapped, contrast raised, blurred; one value in b, g, r."""
    out = _per_image(gray_values(pixels), lambda g: bilateral(contrast(g)), "p")
    return out.select("image_id", "x", "y", *(F.col("p").alias(c) for c in "bgr"))
