"""The order in which regions of an image are looked for, and the plan from images to masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.functions import color
from inkframe.functions import geometry as geo
from inkframe.operators import colors, consensus, filters, inpaint, models, quantize, tfidf
from inkframe.sources import images as files
from inkframe.sources.stored import stored

#: The ways of finding regions, in the order in which they are tried.
ORDER = ("target_color", "none", "rotation", "gray_enhancement", "white_enhancement", "watermark")


def padded(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Regions grown by a tenth on each side within their image (image_id, width, height)."""
    rows = regions.join(images.select("image_id", "width", "height"), "image_id")
    return rows.withColumn("_p", geo.pad(geo.box(), F.col("width"), F.col("height"))).select("image_id", "_p.*", "width", "height")


def baselines(images: DataFrame) -> DataFrame:
    return images.select("image_id", "width", "height", F.explode(geo.baseline_boxes(F.col("width"), F.col("height"))).alias("_b")).select("image_id", "_b.*", "width", "height")


def first_found(images: DataFrame, branches: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(image_id, x, y, w, h, failover_type) of the first branch that has regions for an image.

    ``branches``: (type, regions) in order of preference. All branches are one plan: rows carry the place of
    their branch, and an image keeps those of its smallest place, found with one partial aggregation and
    one shuffle, however many branches there are.
    """
    parts = [r.select("image_id", "x", "y", "w", "h", F.lit(t).alias("failover_type"), F.lit(k).alias("_k")) for k, (t, r) in enumerate(branches)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.groupBy("image_id").agg(F.min("_k").alias("_best"))
    known = images.select("image_id").join(best, "image_id")
    return rows.join(known, "image_id").where("_k = _best").drop("_k", "_best")


def staged(images: DataFrame, branches: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``first_found``, where a branch is costly: each sees only the images that have no regions yet.

    ``keep`` stores a branch's regions (a written table or checkpoint()), so that it runs once.
    """
    left, out = images, None
    for kind, find in branches:
        regions = keep(find(left)).select("image_id", "x", "y", "w", "h").withColumn("failover_type", F.lit(kind))
        out = regions if out is None else out.unionByName(regions)
        left = left.join(regions.select("image_id").distinct(), "image_id", "left_anti")
    return out


def enhanced_pixels(pixels: DataFrame, target: color.BGR, tolerance: int = 3, compat: str = "wrap") -> DataFrame:
    """Pixels for another try at detection: those near ``target`` black, then prepared as always."""
    return filters.prepare(colors.enhance(pixels, target, tolerance, compat))


def regions_of(images: DataFrame, detections: DataFrame, rotated: DataFrame | None = None, forced: DataFrame | None = None, compat_conf: float = 0.1) -> DataFrame:
    """(image_id, x, y, w, h, failover_type): forced boxes, else consensus, else consensus on the turned image, else baselines.

    ``rotated`` are detections on images turned 90 degrees clockwise.
    """
    branches = []
    if forced is not None:
        cut = forced.join(images.select("image_id", "width", "height"), "image_id").withColumn("_c", geo.clip_forced(geo.box(), F.col("width"), F.col("height")))
        branches.append(("none", cut.select("image_id", "_c.*")))
    branches.append(("none", padded(consensus.consensus(detections, compat_conf), images)))
    if rotated is not None:
        turned = images.select("image_id", F.col("height").alias("width"), F.col("width").alias("height"))
        found = padded(consensus.consensus(rotated, compat_conf), turned).select("image_id", "x", "y", "w", "h").join(images.select("image_id", "height"), "image_id")
        back = found.withColumn("_u", geo.unrotate(geo.box(), F.col("height"))).select("image_id", "_u.*")
        branches.append(("rotation", back))
    branches.append(("watermark", baselines(images).select("image_id", "x", "y", "w", "h")))
    return first_found(images, branches)


#: Colours that detection is tried on again with, gray and white, and how far pixels may be off them.
GRAY, WHITE, SENSITIVITY = (128, 128, 128), (255, 255, 255), 3


def detected_regions(images: DataFrame, detectors: dict[str, Callable[[], models.Detector]], threshold: float = 0.3, target: color.BGR | None = None, sensitivity: int = SENSITIVITY, compat: str = "wrap", failed: list[DataFrame] | None = None) -> DataFrame:
    """(image_id, x, y, w, h, failover_type) of ``images`` (image_id, width, height, channels, data), with detectors as plug-ins.

    Tried in turn: pixels of the ``target`` colour turned black, if one is given; the prepared image; the image
    turned by 90 degrees; gray and then white pixels turned black; at last the usual places. Each way sees only
    the images on which those before found nothing, and its regions are stored, so no detector runs twice. ``failed`` is given a
    table (image_id, stage, message) of each way's failures.
    """
    sizes = images.select("image_id", F.col("width").cast("long"), F.col("height").cast("long"))

    def pixels(left: DataFrame) -> DataFrame:
        return files.to_pixels(images.join(left.select("image_id"), "image_id", "left_semi"))

    def agreed(prepared: DataFrame) -> DataFrame:
        found, errors = models.detect_all(files.from_pixels(prepared), detectors, threshold)
        if failed is not None:
            failed.append(errors)
        return consensus.consensus(found)

    def turned(left: DataFrame) -> DataFrame:
        x, y = geo.rotate_point(F.col("x"), F.col("y"), F.col("height"))
        rows = pixels(left).join(left.select("image_id", "height"), "image_id").select("image_id", x.alias("x"), y.alias("y"), "b", "g", "r")
        found = padded(agreed(filters.prepare(rows)), left.select("image_id", F.col("height").alias("width"), F.col("width").alias("height"))).select("image_id", "x", "y", "w", "h")
        return found.join(left.select("image_id", "height"), "image_id").withColumn("_u", geo.unrotate(geo.box(), F.col("height"))).select("image_id", "_u.*")

    def coloured(one: color.BGR) -> Callable[[DataFrame], DataFrame]:
        return lambda left: padded(agreed(enhanced_pixels(pixels(left), one, sensitivity, compat)), left)

    ways = [("none", lambda left: padded(agreed(filters.prepare(pixels(left))), left)), ("rotation", turned), ("gray_enhancement", coloured(GRAY)), ("white_enhancement", coloured(WHITE)), ("watermark", baselines)]
    if target is not None:
        ways.insert(0, ("target_color", coloured(target)))
    return staged(sizes, ways, stored)


def masks_of(pixels: DataFrame, images: DataFrame, regions: DataFrame, target=None, clusters: int = tfidf.CLUSTERS, rounds: int = tfidf.ROUNDS, starts: int = quantize.STARTS) -> DataFrame:
    """(image_id, x, y, v): the union of the text masks of each image's regions."""
    from pyspark.sql import Window

    order = Window.partitionBy("image_id").orderBy("x", "y", "w", "h")
    numbered = regions.withColumn("region_id", F.row_number().over(order)).join(images.select("image_id", "width", "height"), "image_id")
    return inpaint.combine_masks(tfidf.text_mask(pixels, numbered, clusters, rounds, target, starts=starts))


def repair(pixels: DataFrame, mask: DataFrame, method: str | Callable[[DataFrame, DataFrame], DataFrame] = "telea") -> DataFrame:
    """Pixels with the masked ones filled, by fast marching or by a function on (pixels, mask), such as one that calls a model."""
    if callable(method):
        return method(pixels, mask)
    if method != "telea":
        raise ValueError(f"unknown method {method}")
    return inpaint.telea(pixels, mask)
