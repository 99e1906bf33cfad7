"""Tiles of masks, components across them, and exact ranks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import components, graph, morphology, ranks, tiles
from inkframe.plans import report


def table(spark, masks):
    rows = [(k, x, y, int(a[y, x])) for k, a in masks.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x long, y long, v int")


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.fixture(scope="module")
def masks(spark):
    r = np.random.default_rng(2)
    return table(spark, {k: (r.random((20 + 7 * k, 45 - 5 * k)) < 0.2 + 0.1 * k) * 255 for k in range(4)}).cache()


@pytest.mark.parametrize("steps, plain", [(tiles.CLOSE, morphology.close), (tiles.CLEAN, morphology.clean), (tiles.OPEN * 3, morphology.open_erode_dilate), ((("rectangle", 3, 0, True), ("blur", 5, 127)), None)])
@pytest.mark.parametrize("tile", [8, 64])
def test_tiles_equal_the_whole(spark, masks, steps, plain, tile):
    whole = plain(masks) if plain else morphology.blur_threshold(morphology.rectangle(masks, 3, 0), 5)
    assert same(tiles.by_tiles(masks, steps, tile=tile), whole)


def test_tiles_keep_more_columns_and_take_no_rows(spark, masks):
    rows = masks.withColumn("note", F.lit("a")).select("note", "image_id", "y", "x", "v")
    out = tiles.by_tiles(rows, tiles.CLOSE, tile=16)
    assert out.columns == rows.columns and out.count() == rows.count() and out.where("note <> 'a'").isEmpty()
    assert tiles.by_tiles(masks.where("false"), tiles.CLEAN).isEmpty() and tiles.label(masks.where("v < 0")).isEmpty()


@pytest.mark.parametrize("tile", [1, 5, 16])
def test_labels_across_tiles(spark, masks, tile):
    assert same(tiles.label(masks, tile=tile), components.label(masks))


def spiral(n, gap):
    """Lit pixels (x, y) of a one-pixel spiral in a square of n, its arms ``gap`` apart."""
    x = y = 0
    out, dx, dy, lo_x, lo_y, hi_x, hi_y = [(0, 0)], 1, 0, 0, gap, n - 1, n - 1
    while True:
        end = {(1, 0): hi_x - x, (0, 1): hi_y - y, (-1, 0): x - lo_x, (0, -1): y - lo_y}[dx, dy]
        if end <= 0:
            return out
        for _ in range(end):
            x, y = x + dx, y + dy
            out.append((x, y))
        if dx == 1:
            hi_x -= gap
        elif dy == 1:
            hi_y -= gap
        elif dx == -1:
            lo_x += gap
        else:
            lo_y += gap
        dx, dy = -dy, dx


def test_a_spiral_is_one_component(spark):
    points = spiral(4000, 80)
    rows = [(1, x, y, 255) for x, y in points] + [(1, 40, 40, 255), (2, 300, 300, 255), (2, 299, 301, 255)]
    import pandas as pd

    mask = spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "x", "y", "v"]))
    got = {tuple(r) for r in tiles.label(mask).groupBy("image_id", "label").count().collect()}
    assert got == {(1, 1, len(points)), (1, 2, 1), (2, 1, 2)}


def test_connected_graphs_by_key(spark):
    r = random.Random(4)
    edges = [(k, r.randrange(60), r.randrange(60)) for k in range(3) for _ in range(35)] + [(9, n, n + 1) for n in range(200)] + [(8, 0, n) for n in range(1, 100)] + [(7, 5, 5)]
    got = {(x.image_id, x.node): x.component for x in graph.connected(spark.createDataFrame(edges, "image_id long, a long, b long")).collect()}
    want = {(k, n): n for k, a, b in edges if a != b for n in (a, b)}
    moved = True
    while moved:
        moved = False
        for k, a, b in edges:
            if a != b and (low := min(want[k, a], want[k, b])) != max(want[k, a], want[k, b]):
                want[k, a] = want[k, b] = low
                moved = True
    assert got == want


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_ranks_are_exact(spark, buckets):
    r = random.Random(buckets)
    groups = {
        "a": [r.gauss(0, 1) for _ in range(301)], "b": [r.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(100)], "c": [1e-300, 5e-324, -1e308, 1e308, 0.0, -0.0, 1.0], "d": [4.0], "e": [],
    }
    rows = [(g, v) for g, x in groups.items() for v in [*x, None, math.nan, math.inf, -math.inf]]
    df = spark.createDataFrame(rows, "g string, t double")
    wanted = {(g,): [k for k in (0, 1, len(x) // 2, len(x) - 1, len(x) + 5) if k >= 0] for g, x in groups.items()}
    got = ranks.at_ranks(df, "t", wanted, ["g"], buckets)
    assert got == {(g,): {k: sorted(x)[k] for k in wanted[g,] if k < len(x)} for g, x in groups.items()}


def test_no_task_gathers_the_values(spark):
    """After the first pass only rows near a wanted rank are left, and no pass has a task with all of them."""
    df = spark.range(0, 200_000, 1, 8).select((F.hash("id") / 7.0).alias("t"))
    n, (low, middle, high) = ranks.percentiles(df, "t", [0.0, 0.5, 1.0])[()]
    values = np.sort(df.toPandas()["t"].to_numpy())
    assert n == 200_000 and low == values[0] and high == values[-1] and math.isclose(middle, np.median(values))


def test_reports_without_values(spark):
    none = spark.createDataFrame([], "score double")
    assert tuple(report.score_moments(none).first()) == (0, None, None, None, None, None)
    assert [r.value for r in report.score_percentiles(none, 3).collect()] == [None] * 3
    times = spark.createDataFrame([(None, 1.0), (None, 3.0)], "load_time double, total_time double")
    assert {tuple(r) for r in report.timing_stats(times).collect()} == {("load_time", 0, 0.0, 0.0), ("total_time", 2, 2.0, 2.0)}


def test_the_whole_report(spark):
    rows = [("b.png", 2.0, 1.5, None, 0.5, 4.0, 2, "rotation"), ("a.png", 1.0, 0.5, 0.25, 1.5, 2.0, 0, "none"), ("c.png", 1.0, None, None, None, 9.0, 1, "watermark")]
    t = spark.createDataFrame(rows, "image_id string, image_mp double, detection_time double, color_time double, inpaint_time double, total_time double, consensus_boxes_count int, failover_type string")
    lines = [r.value for r in report.timing_report(t, 12.0, {"clusters": 24}).orderBy("part", "place").collect()]
    at = lines.index(next(x for x in lines if x.startswith("image ")))
    assert lines[1] == "clusters: 24" and lines[at].split() == ["image", "MP", "detect", "colour", "paint", "total", "boxes", "way"]
    assert [x.split() for x in lines[at + 2 : at + 5]] == [["a.png", "1.00", "0.50", "0.25", "1.50", "2.00", "0"], ["b.png", "2.00", "1.50", "-", "0.50", "4.00", "2", "R"], ["c.png", "1.00", "-", "-", "-", "9.00", "1", "B"]]
    assert [x.split() for x in lines[at + 6 : at + 8]] == [["median", "1.00", "0.25", "1.00", "4.00", "1.0"], ["mean", "1.00", "0.25", "1.00", "5.00", "1.0"]]
    assert "all images: 12.0 s, 4.00 s each, 2 of 3 with a time" in lines and "regions agreed on: 3, in 2 images (66.7 %)" in lines and lines[-1] == "  watermark (B): 1"
    none = report.timing_report(t.where("false"), 0.0).orderBy("part", "place").collect()
    assert any("0 of 0" in r.value for r in none)
