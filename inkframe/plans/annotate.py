"""What a viewer draws over an image, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.functions import geometry as geo

#: Outline colour (#RRGGBB) of each detector, and of regions on which two and three agree.
OUTLINES = {"east": "#FF0000", "doctr": "#0000FF", "easyocr": "#00FF00", "consensus_2": "#FF00FF", "consensus_3": "#00FFFF"}


def annotations(boxes: DataFrame, label_width: int = 120, label_height: int = 14) -> DataFrame:
    """(image_id, det_id, kind, x, y, w, h, outline, label, label_x, label_y) of boxes with ``detector`` and ``conf``."""
    outline = F.create_map(*(F.lit(v) for pair in OUTLINES.items() for v in pair))
    label = F.format_string("%s %.1f%%", F.col("detector"), geo.as_fraction(F.col("conf")) * 100)
    b = geo.box()
    at = geo.label_position(b, "top", F.lit(label_width), F.lit(label_height))
    return boxes.select("image_id", "det_id", F.lit("box").alias("kind"), "x", "y", "w", "h", outline[F.col("detector")].alias("outline"), label.alias("label"), at["x"].alias("label_x"), at["y"].alias("label_y"))
