"""The long colour search with a detector that runs in the tasks of the images."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from inkframe import fixtures, queries
from inkframe.operators import components, quantize, search, tiles

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_a_detector_in_tasks_finds_what_one_over_rows_finds(spark):
    r = np.random.default_rng(12)
    rows = []
    for key, (w, h) in ((1, (48, 30)), (2, (24, 52))):
        for x in range(w):
            for y in range(h):
                letter = x % 12 < 7 and y % 13 < 8
                if r.random() < 0.98:  # regions needn't be whole
                    rows.append((key, x + 3, y + 5, *((int(v) for v in r.integers(10, 40, 3)) if letter else (int(v) for v in r.integers(120, 250, 3)))))
    p = spark.createDataFrame([*rows, (3, 0, 0, 9, 8, 7)], "image_id long, x long, y long, b long, g long, r long")
    share = F.avg((F.col("v") == 0).cast("int"))
    for top in (0.9, 1.0):  # nothing is sure; an even split is
        want = search.exhaustive_search(p, lambda t, top=top: t.groupBy("image_id", "k").agg((4 * share * (1 - share) * top).alias("conf")), range(2, 7), 20)
        got = search.exhaustive_search(p, None, range(2, 7), 20, detector=lambda x, y, v, top=top: queries._evenness(x, y, v) * top)
        assert got.schema.simpleString() == want.schema.simpleString()
        want, got = ({q.image_id: q for q in d.collect()} for d in (want, got))
        assert set(got) == set(want) == {1, 2, 3} and got[1].n_components > 1
        for key, q in want.items():
            assert tuple(got[key])[:5] == tuple(q)[:5]
            assert [v is None or abs(v - u) < 1e-12 for u, v in zip(q[5:], got[key][5:])] == [True] * 5


def test_the_search_shuffles_no_pixels(spark):
    pixels = fixtures.load(spark, SF, "pixels").select("image_id", "x", "y", "b", "g", "r")
    left = pixels.select("image_id").distinct().where("image_id > 50")
    for own in (pixels, pixels.join(F.broadcast(left), "image_id", "left_semi")):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            search._tried(quantize.with_lab(own), [2, 3], 5, 1, queries._evenness).explain()
        assert not [line for line in out.getvalue().splitlines() if "Exchange hashpartitioning" in line and "p_partkey" not in line]
    images = fixtures.load(spark, SMALL, "images").count()
    assert queries.queries()["exhaustive_search"](spark, SMALL).count() == images > 1


def test_masks_of_several_partitions_are_those_of_each():
    r = np.random.default_rng(5)
    x, y = (c.ravel() for c in np.meshgrid(np.arange(40), np.arange(30)))
    owns = np.stack([1000 + (x // 11 + y // 9) % 3, np.where(r.random(x.size) < 0.1, 2003, 2000 + x // 20)])
    for cells in (1, 1 << 22):
        got = dict(tiles.run_each(x, y, owns, tiles.OPEN * 3, cells))
        assert sorted(got) == sorted(set(owns.ravel().tolist())) and not got[2003].any()
        for own in owns:
            for k, lit in tiles.run_each(x, y, own, tiles.OPEN * 3):
                assert (got[k] == lit).all()


def test_hull_areas_equal_the_chain_over_all_points():
    def plain(points):
        def half(order):
            out = []
            for p in order:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        points = sorted(set(points))
        ring = half(points) + half(points[::-1])
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if len(ring) > 2 else 0.0

    r = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 40, 400):
        for w in (1, 2, 9, 30):
            for at in (7, -50):
                p = r.integers(0, w, (n, 2)) * (1, r.integers(1, 3)) + at
                assert components._hull_area(p) == plain([tuple(q) for q in p.tolist()])
