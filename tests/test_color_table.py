"""Colours against tables of colours."""

import numpy as np
import pytest

from inkframe.operators import colors


@pytest.mark.parametrize("each", [True, False])
@pytest.mark.parametrize("tolerance", [0, 3, 10])
def test_color_table_equals_all_pairs_and_sends_little(spark, each, tolerance):
    rng = np.random.default_rng(tolerance)
    pixels = [(int(i), k, 0, *map(int, rng.integers(0, 256, 3))) for i in (1, 2) for k in range(250)] + [(1, 250, 0, 255, 255, 255), (2, 250, 0, 0, 0, 0)]
    table = [(int(i), *map(int, rng.integers(-5, 262, 3))) for i in (1, 2) for _ in range(200)] + [(1, 255 + tolerance, 255, 255), (2, -tolerance, 0, 0)]
    given = spark.createDataFrame(table, "image_id long, b long, g long, r long")
    rows = spark.createDataFrame(pixels, "image_id long, x long, y long, b long, g long, r long")
    got = {(r.image_id, r.x): r.v for r in colors.mask_near_table(rows, given if each else given.drop("image_id"), tolerance).collect()}
    want = {(i, x): 255 if any((not each or i == t[0]) and max(abs(b - t[1]), abs(g - t[2]), abs(r - t[3])) <= tolerance for t in table) else 0 for i, x, _, b, g, r in pixels}
    assert got == want
