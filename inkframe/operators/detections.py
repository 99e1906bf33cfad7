"""What follows a detector: filters, decoding of score maps, suppression, merging of lines, summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import geometry as geo

DETECTORS = ("east", "doctr", "easyocr")


def validate(min_confidence: float, min_size: int) -> None:
    if not 0 <= min_confidence <= 1:
        raise ValueError("the confidence threshold lies between 0 and 1")
    if min_size <= 0:
        raise ValueError("the least size is positive")


def confident(boxes: DataFrame, threshold: float, col: str = "conf") -> DataFrame:
    return boxes.where(F.col(col) >= threshold)


def large_enough(boxes: DataFrame, least: int = 10) -> DataFrame:
    return boxes.where((F.col("w") >= least) & (F.col("h") >= least))


def of_detector(boxes: DataFrame, detector: str) -> DataFrame:
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector}")
    return boxes.where(F.col("detector") == detector)


def words_to_boxes(words: DataFrame, threshold: float) -> DataFrame:
    """Boxes of words given as (image_id, x1, y1, x2, y2 in 0 to 1, confidence, width, height)."""
    scaled = {"x1": "width", "x2": "width", "y1": "height", "y2": "height"}
    rows = words.where(F.col("confidence") >= threshold).withColumns({c: (F.col(c) * F.col(n)).cast("float") for c, n in scaled.items()})
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    return rows.select("image_id", corners.alias("geometry"), F.col("confidence").cast("double"))


def polygons_to_boxes(polygons: DataFrame) -> DataFrame:
    """Adds x, y, w, h of ``geometry``; polygons of under three points are dropped."""
    return polygons.where(F.size("geometry") >= 3).withColumn("_b", geo.polygon_box(F.col("geometry"))).select("*", "_b.*").drop("_b")


def decode_cells(cells: DataFrame, threshold: float) -> DataFrame:
    """Boxes of the cells of a score map: (image_id, cx, cy, score, d0..d3 to top, right, bottom, left, angle)."""
    ox, oy = F.col("cx") * 4.0, F.col("cy") * 4.0
    h, w = F.col("d0") + F.col("d2"), F.col("d1") + F.col("d3")
    cos, sin = F.cos("angle"), F.sin("angle")
    end_x = (ox + cos * F.col("d1") + sin * F.col("d2")).cast("long")
    end_y = (oy - sin * F.col("d1") + cos * F.col("d2")).cast("long")
    rows = cells.where(F.col("score") >= threshold).withColumns({"_ex": end_x, "_ey": end_y})
    return rows.select("image_id", "cx", "cy", (F.col("_ex") - w).cast("long").alias("x"), (F.col("_ey") - h).cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"), F.col("score").alias("conf"))


def rescale(boxes: DataFrame, from_size: int, width: Column, height: Column) -> DataFrame:
    """Boxes found on a square of ``from_size``, on the image itself; each number is truncated."""
    x, y = width / from_size, height / from_size
    return boxes.withColumns({c: (F.col(c) * k).cast("long") for c, k in (("x", x), ("w", x), ("y", y), ("h", y))})


def suppress(boxes: DataFrame, threshold: float = 0.4, min_confidence: float = 0.0, compat: str = "reference", keep: str = "det_id") -> DataFrame:
    """Greedy non-maximum suppression within each image, most confident first, ties by ``keep``.

    ``reference`` hands the far corner over as if it were the size, so boxes count as larger than they
    are; ``intended`` uses the sizes. The result depends on the order, so each image is one group; its
    boxes are as many as one detector finds in one image.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["conf"] >= min_confidence].sort_values(["conf", keep], ascending=[False, True])
        x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
        w, h = f["w"].to_numpy(float), f["h"].to_numpy(float)
        if compat == "reference":
            w, h = w + x, h + y
        left = np.ones(len(f), bool)
        for i in range(len(f)):
            if left[i]:
                iw = np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x)
                ih = np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y)
                both = np.clip(iw, 0, None) * np.clip(ih, 0, None)
                all_ = w[i] * h[i] + w * h - both
                drop = np.divide(both, all_, out=np.zeros(len(f)), where=all_ > 0) > threshold
                drop[: i + 1] = False
                left &= ~drop
        return f[left]

    return boxes.groupBy("image_id").applyInPandas(run, boxes.schema)


def merge_line(boxes: DataFrame, order: str = "det_id") -> DataFrame:
    """Per image the largest box (first on ties) united with all boxes across its middle line.

    Two passes of partial aggregation; images are never gathered.
    """
    b = geo.box()
    top = boxes.groupBy("image_id").agg(F.max(F.struct(geo.area(b).alias("area"), (-F.col(order)).alias("first"), b.alias("b"))).alias("top"))
    top = top.select("image_id", F.col("top.b").alias("big"))
    middle = F.col("big.y") + F.floor(F.col("big.h") / 2)
    on_line = boxes.join(top, "image_id").where(middle.between(F.col("y"), F.col("y") + F.col("h")))
    merged = on_line.groupBy("image_id").agg(geo.union_all_boxes(b).alias("m"), F.countDistinct("x", "y", "w", "h").alias("n_merged"))
    return merged.select("image_id", "m.*", "n_merged")


def summarize(boxes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per detector of ``dimension`` (detector, detector_rank): count, mean, largest and smallest confidence; zeros if none."""
    found = boxes.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("avg_conf"), F.max("conf").alias("max_conf"), F.min("conf").alias("min_conf"))
    return F.broadcast(dimension).join(found, "detector", "left").na.fill(0)


def roll_up(boxes: DataFrame) -> DataFrame:
    """Counts per image and detector side by side, with a row of totals (image_id null)."""
    counts = {d: F.count_if(F.col("detector") == d) for d in DETECTORS}
    return boxes.rollup("image_id").agg(*(c.alias(f"n_{d}") for d, c in counts.items()), F.count(F.lit(1)).alias("n_all"), F.grouping("image_id").cast("int").alias("is_total"))


def coverage(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region (image_id, region_id, rx, ry, rw, rh): boxes that meet it, their mean confidence, and the
    sum of their whole areas over the region's, at most 100 per cent."""
    meets = (F.col("x") < F.col("rx") + F.col("rw")) & (F.col("x") + F.col("w") > F.col("rx")) & (F.col("y") < F.col("ry") + F.col("rh")) & (F.col("y") + F.col("h") > F.col("ry"))
    joined = regions.join(boxes, "image_id", "left").withColumn("_m", F.coalesce(meets, F.lit(False)))
    mine = F.when(F.col("_m"), F.col("w") * F.col("h"))
    out = joined.groupBy("image_id", "region_id", "rw", "rh").agg(
        F.count_if("_m").alias("n_boxes"), F.coalesce(F.max(F.when(F.col("_m"), F.col("conf"))), F.lit(0.0)).alias("max_conf"),
        F.coalesce(F.avg(F.when(F.col("_m"), F.col("conf"))), F.lit(0.0)).alias("mean_conf"), F.coalesce(F.sum(mine), F.lit(0)).alias("_a"),
    )
    size = F.col("rw") * F.col("rh")
    return out.select("image_id", "region_id", "n_boxes", "max_conf", "mean_conf", F.when(size > 0, F.least(F.lit(100.0), F.col("_a") * 100.0 / size)).otherwise(0.0).alias("coverage"))


def ranked(boxes: DataFrame) -> DataFrame:
    """Adds ``seq``: place by detector, then by id, within the image."""
    return boxes.withColumn("seq", F.row_number().over(Window.partitionBy("image_id").orderBy("detector_rank", "det_id")))
