"""Joins of stored pixels."""

import contextlib
import io

from inkframe import fixtures, queries
from inkframe.operators import inpaint


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_stored_pixels_are_not_broadcast(spark):
    pixels = fixtures.load(spark, "/root/testdata/sf0.001", "pixels")
    text = plan(inpaint.telea_by_hole(pixels, queries._mask(pixels)))
    joins = [line for line in text.splitlines() if "HashJoin" in line or "SortMergeJoin" in line]
    assert joins and not [line for line in joins if "BroadcastHashJoin" in line and "part" in line]
    assert [line for line in joins if "SortMergeJoin" in line and "part" in line]
