"""Filters as table plans, and colours against tables of colours, beside their plain versions."""

import numpy as np
import pytest

from inkframe.operators import colors, filters, inpaint, quantize, tiles


def images(spark, sizes, seed=1):
    r = np.random.default_rng(seed)
    made = {}
    for k, (h, w) in enumerate(sizes):
        a = (np.add.outer(np.arange(h) * 5, np.arange(w) * 3) % 200 + r.integers(0, 56, (h, w))).astype(int)
        a[h // 3 : h // 2, w // 4 : w // 2] = 250 if k % 2 else 5
        made[k] = a
    rows = [(k, x, y, int(a[y, x])) for k, a in made.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return made, spark.createDataFrame(rows, "image_id long, x long, y long, v long").repartition(3)


def back(df, made, col):
    out = {k: np.full(a.shape, -1) for k, a in made.items()}
    for r in df.collect():
        out[r.image_id][r.y, r.x] = r[col]
    return out


SIZES = [(24, 32), (37, 51), (10, 13), (3, 5), (9, 2), (1, 1), (65, 40)]


def test_contrast_as_a_table_equals_contrast(spark):
    made, rows = images(spark, SIZES)
    got = back(filters.contrast_table(rows), made, "v")
    assert all((got[k] == filters.contrast(a)).all() for k, a in made.items())
    got = back(filters.contrast_table(rows, 3, 1.2), made, "v")
    assert all((got[k] == filters.contrast(a, 3, 1.2)).all() for k, a in made.items())


@pytest.mark.parametrize("low, high", [(50, 150), (20, 600)])
def test_edges_as_a_table_equal_edges(spark, low, high):
    made, rows = images(spark, SIZES, 2)
    got = back(filters.edges_table(rows, low, high), made, "edge")
    assert all((got[k] == filters.canny(a, low, high)).all() for k, a in made.items())
    assert any(0 < (g > 0).mean() < 1 for g in got.values())


def test_bilateral_equals_a_plain_version():
    r = np.random.default_rng(3)
    a = r.integers(0, 256, (14, 17))

    def at(n, k):
        return -k if k < 0 else 2 * (n - 1) - k if k >= n else k

    want = np.zeros(a.shape)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            near = [(dy, dx, a[at(14, y + dy), at(17, x + dx)]) for dy in range(-4, 5) for dx in range(-4, 5) if dy * dy + dx * dx <= 16]
            w = [np.exp(-(dy * dy + dx * dx) / (2 * 75**2) - (v - a[y, x]) ** 2 / (2 * 100**2)) for dy, dx, v in near]
            want[y, x] = sum(k * v for k, (_, _, v) in zip(w, near)) / sum(w)
    assert (filters.bilateral(a) == np.rint(want)).all()


@pytest.mark.parametrize("tolerance", [0, 3, 10])
def test_colours_near_a_table(spark, tolerance):
    r = np.random.default_rng(tolerance)
    pixels = [(int(i), k, 0, *map(int, r.integers(0, 256, 3))) for i in (1, 2) for k in range(400)]
    own = [(i, *(min(255, max(0, v + int(d))) for v, d in zip(p, r.integers(-2 * tolerance - 1, 2 * tolerance + 2, 3)))) for i, _, _, *p in pixels[::3]]
    p = spark.createDataFrame(pixels, "image_id long, x long, y long, b long, g long, r long")
    t = spark.createDataFrame([*own, *own[:5]], "image_id long, b long, g long, r long")
    want = {(i, x): any(j == i and all(abs(a - b) <= tolerance for a, b in zip(c, d)) for j, *d in own) for i, x, _, *c in pixels}
    assert {(r.image_id, r.x): r.v == 255 for r in colors.mask_near_table(p, t, tolerance).collect()} == want
    whole = colors.mask_near_table(p, t.drop("image_id"), tolerance)
    listed = colors.mask_near(p, list({tuple(c) for _, *c in own}), tolerance)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, listed.collect()))
    assert colors.mask_near_table(p, t.where("false"), tolerance).where("v > 0").isEmpty()


def test_nearest_clusters_equal_one_target_at_a_time(spark):
    centres = spark.createDataFrame([(i, k, 10.0 * k + i, 20.0 * k, 250.0 - 30 * k) for i in (1, 2) for k in range(6)], "image_id long, k int, b double, g double, r double")
    targets = [(5, 5, 240), (40, 70, 100), (15, 20, 220), (30, 60, 170)]
    t = spark.createDataFrame([(i, *c) for i in (1, 2) for c in targets], "image_id long, b long, g long, r long")
    got = {(r.image_id, r.b, r.g, r.r): r.k for r in quantize.nearest_clusters(centres, t).collect()}
    assert got == {(r.image_id, *c): r.k for c in targets for r in quantize.nearest_cluster(centres, c).collect()}


def painted(spark, sizes, holes, seed):
    r = np.random.default_rng(seed)
    pixels, mask = [], []
    for k, (h, w) in enumerate(sizes):
        lit = holes(k, h, w, r)
        a = r.integers(0, 256, (h, w, 3))
        pixels += [(k, x, y, *map(int, a[y, x])) for y in range(h) for x in range(w)]
        mask += [(k, x, y, 255 if lit[y, x] else 0) for y in range(h) for x in range(w) if lit[y, x] or (x + y) % 3]
    return spark.createDataFrame(pixels, "image_id long, x long, y long, b long, g long, r long"), spark.createDataFrame(mask, "image_id long, x long, y long, v int")


def some_holes(k, h, w, r):
    lit = np.zeros((h, w), bool)
    for _ in range(4):
        y, x = r.integers(0, h), r.integers(0, w)
        lit[y : y + r.integers(1, 5), x : x + r.integers(1, 6)] = True
    if k == 1:
        lit[:] = True
    return lit & (k != 2)


@pytest.mark.parametrize("radius", [1, 3])
def test_filling_by_hole_equals_filling_by_image(spark, radius):
    pixels, mask = painted(spark, [(30, 41), (4, 5), (6, 6), (25, 12)], some_holes, radius)
    whole = inpaint.telea(pixels, mask, radius)
    key = lambda d: sorted(map(tuple, d.select("image_id", "x", "y", "b", "g", "r").collect()))
    assert key(inpaint.telea_by_hole(pixels, mask, radius, tile=8)) == key(whole)
    assert inpaint.telea_by_hole(pixels, mask.where("false"), radius).count() == pixels.count()


def test_a_hundred_holes_are_a_hundred_groups(spark):
    def spots(k, h, w, r):
        return (np.arange(h)[:, None] % 12 == 5) & (np.arange(w)[None, :] % 12 == 5)

    pixels, mask = painted(spark, [(120, 120)], spots, 5)
    dense = pixels.select("image_id", "x", "y").join(mask, ["image_id", "x", "y"], "left").na.fill(0, ["v"])
    near = tiles.by_tiles(dense, (("rectangle", 4, 4, True),), tile=32)
    assert tiles.label(near, tile=32).select("label").distinct().count() == 100
    got = {(r.x, r.y): (r.b, r.g, r.r) for r in inpaint.telea_by_hole(pixels, mask, tile=32).collect()}
    want = {(r.x, r.y): (r.b, r.g, r.r) for r in inpaint.telea(pixels, mask).collect()}
    assert got == want
