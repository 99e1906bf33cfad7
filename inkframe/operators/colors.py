"""Colours of regions: counts, masks by colour, ranges, distinctive ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions import color


def distinct_colors(pixels: DataFrame, keys: Sequence[str] = ("image_id",), least: int = 1) -> DataFrame:
    """(keys, b, g, r, n) of each colour with ``least`` pixels or more."""
    out = pixels.groupBy(*keys, "b", "g", "r").agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least) if least > 1 else out


def channel_variance(b: Column, g: Column, r: Column) -> Column:
    """Population variance of a colour's three channels."""
    mean = (b + g + r) / 3.0
    return ((b - mean) * (b - mean) + (g - mean) * (g - mean) + (r - mean) * (r - mean)) / 3.0


def grayest(colors: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Of each group's colours, that of the smallest channel variance; ties to the smaller (b, g, r)."""
    at = F.struct(channel_variance(F.col("b"), F.col("g"), F.col("r")).alias("variance"), "b", "g", "r")
    return colors.groupBy(*keys).agg(F.min(at).alias("m")).select(*keys, "m.*")


#: The ranges of pixel counts, upper ends excluded; counts between them fall in none.
COUNT_RANGES = ((10, 50), (51, 100), (101, 500), (501, 1000), (1001, None))


def count_ranges(colors: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    n = F.col("n")
    hits = [(n >= lo) & (n < hi) if hi else n >= lo for lo, hi in COUNT_RANGES]
    return colors.groupBy(*keys).agg(*(F.count_if(h).alias(f"n_{lo}_{hi or 'up'}") for h, (lo, hi) in zip(hits, COUNT_RANGES)))


#: Colours of a list that may be broadcast; a longer one is shuffled.
MOST_LISTED = 10_000


def mask_exact(pixels: DataFrame, colors: DataFrame) -> DataFrame:
    """(image_id, x, y, v): 255 where the pixel's colour is one of ``colors`` (b, g, r; a list made by a user or of one image)."""
    known = colors.select("b", "g", "r", F.lit(255).alias("_v")).distinct()
    if len(known.limit(MOST_LISTED + 1).collect()) <= MOST_LISTED:
        known = F.broadcast(known)
    return pixels.join(known, ["b", "g", "r"], "left").select("image_id", "x", "y", F.coalesce("_v", F.lit(0)).cast("int").alias("v"))


def mask_near(pixels: DataFrame, colors: Sequence[color.BGR], tolerance: int = 10) -> DataFrame:
    """255 where all channels lie within ``tolerance`` of one of ``colors``; no colours: 0 everywhere.

    A given list becomes one predicate, so the range join is a projection.
    """
    hit = F.lit(False)
    for c in colors:
        hit = hit | color.near(F.col("b"), F.col("g"), F.col("r"), c, tolerance, "clamp")
    return pixels.select("image_id", "x", "y", F.when(hit, 255).otherwise(0).cast("int").alias("v"))


def mask_near_table(pixels: DataFrame, table: DataFrame, tolerance: int = 10) -> DataFrame:
    """(image_id, x, y, v) as ``mask_near``, for colours in a table (b, g, r, and image_id where each image has its own) of any length.

    A range join by the cells of a grid of the colour cube: cells are twice as wide as a colour reaches, so each colour of the table is
    in eight of them at most, in three on average, and meets the distinct colours of an image in theirs. Colours out of reach of all that an
    image spans leave before. A colour leaves the join with its first match, so no pairs are made; pixels then look their colour up. Cells and colours are
    sent as one number each.
    """
    on = ["image_id"] if "image_id" in table.columns else []
    wide = 2 * (2 * tolerance + 1)
    side = 256 // wide + 2
    number = lambda parts, base: sum((F.col(c) * base**k for k, c in enumerate(parts)), F.lit(0)).cast("int")
    code = number(["r", "g", "b"], 256).alias("_code")
    known = pixels.select(*on, "b", "g", "r").distinct()
    span = known.groupBy(*on).agg(*(f(c).cast("long").alias(f"_{n}{c}") for c in "bgr" for n, f in (("lo", F.min), ("hi", F.max))))
    asked = table.select(*on, *(F.col(c).cast("long").alias(c) for c in "bgr")).distinct()
    asked = asked.join(span, on) if on else asked.crossJoin(F.broadcast(span))
    for c in "bgr":
        asked = asked.where((F.col(c) >= F.col(f"_lo{c}") - tolerance) & (F.col(c) <= F.col(f"_hi{c}") + tolerance))
    asked = asked.select(*on, "b", "g", "r")
    for c in "bgr":
        low, high = (F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + d)) for d in (-tolerance, tolerance))
        asked = asked.select("*", F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide))).alias(f"_{c}"))
    cells = number(["_r", "_g", "_b"], side).alias("_cell")
    at = [F.floor(F.col(c) / wide).alias(f"_{c}") for c in "bgr"]
    known = known.select(*on, "b", "g", "r", *at).select(*on, "b", "g", "r", cells)
    asked = asked.select(*on, *(F.col(c).cast("short").alias(f"t_{c}") for c in "bgr"), cells)
    near = [F.abs(F.col(c) - F.col(f"t_{c}")) <= tolerance for c in "bgr"]
    asked = asked.select(*(F.col(c).alias(f"t_{c}") for c in (*on, "_cell")), *(f"t_{c}" for c in "bgr"))
    same = [F.col(c) == F.col(f"t_{c}") for c in (*on, "_cell")]
    hits = known.join(asked, [*same, *near], "left_semi").select(*on, code, F.lit(255).alias("_v"))
    rows = pixels.select("image_id", "x", "y", code)
    return rows.join(hits, [*on, "_code"], "left").select("image_id", "x", "y", F.coalesce("_v", F.lit(0)).cast("int").alias("v"))


def enhance(pixels: DataFrame, target: color.BGR, tolerance: int, compat: str = "wrap") -> DataFrame:
    """Pixels near ``target`` turned black, with ``hit`` telling which."""
    hit = color.near(F.col("b"), F.col("g"), F.col("r"), target, tolerance, compat)
    return pixels.select("image_id", "x", "y", *color.blackened(hit), hit.cast("int").alias("hit"))


def ocr_image(pixels: DataFrame, box: tuple[int, int, int, int], target: color.BGR, tolerance: int = 2) -> DataFrame:
    """(image_id, x, y, b, g, r) of images for a reader of text: within ``box`` the pixels near ``target`` black, all else white."""
    x, y, w, h = box
    low, high = [max(0, c - tolerance) for c in target], [min(255, c + tolerance) for c in target]
    hit = color.in_range([F.col(c) for c in "bgr"], low, high) & F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    v = F.when(hit, 0).otherwise(255).cast("long")
    return pixels.select("image_id", "x", "y", *(v.alias(c) for c in "bgr"))


def affected_percent(enhanced: DataFrame) -> DataFrame:
    return enhanced.groupBy("image_id").agg(F.sum("hit").alias("n_hit"), (F.avg("hit") * 100).alias("percent"))


def gray_to_black(pixels: DataFrame) -> DataFrame:
    hit = color.is_mid_gray(F.col("b"), F.col("g"), F.col("r"))
    return pixels.select("image_id", "x", "y", *color.blackened(hit))


def cluster_image(assigned: DataFrame, cluster: int, background: int = 192) -> DataFrame:
    """Gray image of one cluster: its pixels black, all others ``background``."""
    return assigned.select("image_id", "x", "y", F.when(F.col("k") == cluster, 0).otherwise(background).cast("int").alias("v"))
