"""Steps whose tasks grow in number, not in size, with the table."""

import contextlib
import io

import numpy as np

from inkframe import fixtures, queries
from inkframe.operators import textlike, tiles

SF = "/root/testdata/sf0.01"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.queries()[name](spark, SF).explain()
    return out.getvalue()


def exchanges(text):
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_lloyd_leaves_colours_where_they_were_made(spark):
    assert not [line for line in exchanges(plan(spark, "kmeans_lloyd")) if "p_partkey" not in line]


def test_tiles_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "IMAGES", 5)
    assert [line for line in exchanges(plan(spark, "morph_clean_tiles")) if "_ty" in line and ", 8)" in line]


def test_blur_of_a_full_mask_equals_that_of_any():
    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (2, 9), (3, 4), (30, 41)):
        a = rng.choice([0, 255], (h, w)).astype(np.int32)
        here = np.ones((h, w), bool)
        wide, there = np.pad(a, ((0, 1), (0, 1))), np.pad(here, ((0, 1), (0, 1)))  # a line and a column that aren't there
        assert (tiles._blur(a, here, 9, 127) == tiles._blur(wide, there, 9, 127)[:h, :w]).all()


def test_edgy_colors_finds_edges_once(spark):
    assert plan(spark, "edgy_colors").count("FlatMapGroupsInPandas") == 2  # edges, regression


def test_equal_weights_rank_by_cluster_in_any_order_of_tiles(spark):
    rng = np.random.default_rng(3)
    share = rng.permutation(64) % 7 / 14
    rows = [(1, float(0.1 + 0.3 * s), float(s), float(s), float(1 - 2 * s)) for s in share]
    for seed in range(5):
        t = spark.createDataFrame([rows[i] for i in np.random.default_rng(seed).permutation(64)], "image_id bigint, edge_density double, share_0 double, share_1 double, share_2 double").coalesce(1)
        got = [(r["k"], r["rank"]) for r in textlike.edgy_clusters(t, 3).orderBy("rank").collect()]
        assert got[:2] == [(0, 1), (1, 2)]


def test_convexity_labels_once(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "IMAGES", 5)
    text = plan(spark, "convexity")
    assert text.count("FlatMapGroupsInPandas") == 2  # labels, hulls
    assert [line for line in exchanges(text) if "image_id" in line and ", 8)" in line]


def test_edges_meet_their_pixels_in_tasks_by_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "IMAGES", 5)
    assert [line for line in exchanges(plan(spark, "edges")) if ", 8), REPARTITION_BY_NUM" in line and "image_id" in line]
