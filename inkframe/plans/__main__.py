"""python -m inkframe.plans -i IMAGES -o OUT: cleans the images of a folder of text that was laid over them."""

from __future__ import annotations

import argparse
import importlib
import logging
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import color
from inkframe.functions import geometry as geo
from inkframe.operators import detections, inpaint, models
from inkframe.plans import cascade, report
from inkframe.sources import images as files
from inkframe.sources.png_files import write_files
from inkframe.sources.stored import stored

log = logging.getLogger("inkframe")


def set_up_logging(path: str | None = None, verbose: bool = False) -> logging.Logger:
    """The library's logger: to the screen, and to a file where one is named."""
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    log.handlers = [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]
    for h in log.handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    return log


def plug_in(text: str, device: str) -> Callable[[], object]:
    """What loads the model that ``module:function`` makes; the function is given the device."""
    module, _, name = text.partition(":")
    return lambda: getattr(importlib.import_module(module), name or "load")(models.pick_device(device))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-i", "--input", required=True, help="folder of images, or one image")
    p.add_argument("-o", "--output", required=True, help="folder for the image files (clean, and mask with -k) and the tables png, masks, errors and timings")
    p.add_argument("-c", "--color", help="#RRGGBB or a name: detection is tried on it first, and pixels close to it count as text")
    p.add_argument("--confidence-threshold", type=float, default=0.3, help="least confidence of a detection (0.3)")
    p.add_argument("--granularity", "--clusters", type=int, default=24, help="colour clusters of a region, 4 to 256 (24)")
    p.add_argument("-m", "--maskfile", help="image of a mask for all images, in place of those found")
    p.add_argument("-p", "--paint", choices=["lama", "telea"], default="telea", help="how masked pixels are filled; lama is the model that --inpainter names")
    p.add_argument("-k", "--keep-masks", action="store_true", help="keep the masks as PNG, and the errors by name of the image's text file")
    p.add_argument("-t", "--timing", action="store_true", help="write the timing report")
    p.add_argument("-l", "--logfile")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--device", choices=["cuda", "cpu"], default="cuda")
    p.add_argument("-f", "--force-bbox", "--box", help="x,y,w,h of the region in every image")
    p.add_argument("--detections", help="Parquet of detections by image name (schemas.DETECTIONS with name)")
    p.add_argument("--detector", action="append", default=[], help="east, doctr or easyocr = module:function that loads it; may be repeated")
    p.add_argument("--inpainter", help="module:function that loads a model from (image, mask) to an image")
    a = p.parse_args(argv)
    if not 4 <= a.granularity <= 256:
        p.error("clusters lie between 4 and 256")
    if not 0 <= a.confidence_threshold <= 1:
        p.error("the confidence threshold lies between 0 and 1")
    if a.paint == "lama" and not a.inpainter:
        p.error("lama needs --inpainter")
    if any(d.partition("=")[0] not in detections.DETECTORS or "=" not in d for d in a.detector):
        p.error("a detector is east, doctr or easyocr = module:function")
    try:
        a.force_bbox = geo.whole_box(a.force_bbox) if a.force_bbox is not None else None
    except ValueError as e:
        p.exit(1, f"{p.prog}: --force-bbox: {e}\n")
    return a


#: Pixels of a mask that is sent whole to every task (24 bytes each); a larger one is joined by shuffle.
MASK_PIXELS = 2_000_000


def given_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, x, y, v): one mask (x, y, v) for every image; pixels that it hasn't have no row. Pixels stay where they are if it is small."""
    small = F.broadcast(mask) if mask.count() <= MASK_PIXELS else mask
    return pixels.select("image_id", "x", "y").join(small.select("x", "y", "v"), ["x", "y"]).select("image_id", "x", "y", "v")


def as_png(images: DataFrame) -> DataFrame:
    """The names of ``images`` (file) with the suffix of what they hold, whatever the image was read from."""
    return images.withColumn("file", F.regexp_replace("file", r"\.[^.]*$", ".png"))


def find_regions(spark: SparkSession, a: argparse.Namespace, found: DataFrame, sizes: DataFrame, failed: list[DataFrame] | None = None) -> DataFrame:
    """(image_id, x, y, w, h, failover_type) by the box given, else by detections given, else by detectors, else at the usual places."""
    forced = None
    if a.force_bbox:
        forced = sizes.select("image_id", *(F.lit(v).cast("long").alias(c) for c, v in zip("xywh", a.force_bbox)))
    if a.detections:
        boxes = spark.read.parquet(a.detections).drop("image_id").join(found.select("name", "image_id"), "name")
        return cascade.regions_of(sizes, detections.confident(boxes, a.confidence_threshold), forced=forced)
    if forced is not None:
        return cascade.regions_of(sizes, spark.createDataFrame([], "image_id long, det_id long, detector string, detector_rank int, x long, y long, w long, h long, conf double"), forced=forced)
    if a.detector:
        loads = {d.partition("=")[0]: plug_in(d.partition("=")[2], a.device) for d in a.detector}
        return cascade.detected_regions(found, loads, a.confidence_threshold, color.parse(a.color) if a.color else None, failed=failed)
    return cascade.first_found(sizes, [("watermark", cascade.baselines(sizes))])


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    set_up_logging(a.logfile, a.verbose)
    target = color.parse(a.color) if a.color else None
    spark = SparkSession.builder.getOrCreate()
    began = time.monotonic()
    took: dict[str, float] = {}

    def done(stage: str) -> None:
        took[stage] = time.monotonic() - began - sum(took.values())
        log.info("%s: %.1f s", stage, took[stage])

    found, errors = files.read_images(spark, a.input)
    found = found.withColumn("image_id", F.xxhash64("name"))
    names = found.select("image_id", "name")
    sizes = found.select("image_id", F.col("width").cast("long"), F.col("height").cast("long"))
    failed: list[DataFrame] = []
    find_regions(spark, a, found, sizes, failed).write.parquet(f"{a.output}/regions")
    regions = spark.read.parquet(f"{a.output}/regions")
    done("detection_time")
    pixels = files.to_pixels(found)
    if a.maskfile:
        given, bad = files.read_masks(spark, a.maskfile)
        errors = errors.unionByName(bad)
        mask = given_mask(pixels, stored(given))
    else:
        mask = cascade.masks_of(pixels, sizes, regions, target, a.granularity)
    mask.write.parquet(f"{a.output}/masks")
    mask = spark.read.parquet(f"{a.output}/masks")
    done("mask_time")
    if a.paint == "lama":
        clean = inpaint.fill_by_model(pixels, mask, "lama", plug_in(a.inpainter, a.device))
    else:
        clean = inpaint.telea_by_hole(pixels, mask, over=127)
    named = files.encode_png(clean).join(names, "image_id")
    named.withColumn("file", files.output_names(F.col("name"))["clean"]).write.parquet(f"{a.output}/png")
    write_files(as_png(spark.read.parquet(f"{a.output}/png")), f"{a.output}/clean")
    done("inpaint_time")
    for e in failed:
        errors = errors.unionByName(e.join(names, "image_id").select(errors.columns))
    if a.keep_masks:
        whole = pixels.select("image_id", "x", "y").join(mask, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *(F.coalesce("v", F.lit(0)).cast("long").alias(c) for c in "bgr"))
        files.encode_png(whole).join(names, "image_id").withColumn("file", files.output_names(F.col("name"))["mask"]).write.parquet(f"{a.output}/mask_png")
        write_files(spark.read.parquet(f"{a.output}/mask_png"), f"{a.output}/mask")
        errors = errors.withColumn("file", files.output_names(F.col("name"))["error"])
    errors.write.parquet(f"{a.output}/errors")
    n = max(1, names.count())
    log.info("%d images in %.1f s", n, time.monotonic() - began)
    if a.timing:
        # A stage is one plan over all images, so an image's time in it is its share of the stage's.
        each = regions.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("consensus_boxes_count"), F.sum(F.col("w") * F.col("h")).alias("total_bbox_area"), F.first("failover_type").alias("failover_type"))
        times = {s: F.lit(t / n) for s, t in took.items()} | {"color_time": F.lit(None).cast("double"), "total_time": F.lit((time.monotonic() - began) / n)}
        mp = sizes.select("image_id", geo.megapixels(F.col("width"), F.col("height")).alias("image_mp"))
        timings = names.join(mp, "image_id").join(each, "image_id", "left").na.fill({"consensus_boxes_count": 0, "failover_type": "none"}).withColumns(times)
        timings = timings.withColumn("image_id", F.element_at(F.split("name", "/"), -1))
        timings.write.parquet(f"{a.output}/timings")
        settings = {"least confidence": a.confidence_threshold, "clusters": a.granularity, "painted by": a.paint} | ({"colour": a.color} if a.color else {}) | ({"box": a.force_bbox} if a.force_bbox else {})
        lines = report.timing_report(spark.read.parquet(f"{a.output}/timings"), time.monotonic() - began, settings).orderBy("part", "place").select("value")
        lines.write.text(f"{a.output}/timing_report")
        if a.logfile:
            with open(Path(a.logfile).with_suffix(".timing.txt"), "w") as f:
                f.writelines(r["value"] + "\n" for r in lines.toLocalIterator())


if __name__ == "__main__":
    main()
