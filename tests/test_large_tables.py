"""What keeps the pixels of large tables within a task."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from inkframe import fixtures, queries
from inkframe.operators import morphology

SF = "/root/testdata/sf0.01"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_images_are_dealt_before_their_pixels_are_made(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "IMAGES", 5)
    rows = fixtures.load(spark, SF, "pixels").withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() >= 6
    assert rows.groupBy("image_id").agg(F.countDistinct("task").alias("n")).where("n > 1").isEmpty()
    assert rows.count() == 40 * 3072


@pytest.mark.parametrize("name", ["distinct_color_counts", "grayest", "darkest_color", "morph_open_erode_dilate", "morph_clean", "morph_smooth", "morph_dilate_ellipse", "kmeans_rgb"])
def test_pixels_are_not_shuffled(spark, monkeypatch, name):
    monkeypatch.setattr(fixtures, "IMAGES", 5)
    text = plan(queries.queries()[name](spark, SF))
    made = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len([x for x in made if "p_partkey" in x]) == 1
    assert len(made) <= (2 if name == "kmeans_rgb" else 1)  # the means of clusters are added up


def test_masks_brought_together_keep_their_number_of_tasks(spark):
    mask = spark.range(64).select(F.lit(1).alias("image_id"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), F.lit(255).alias("v"))
    assert "REPARTITION_BY_NUM" in plan(morphology.whole(mask))
