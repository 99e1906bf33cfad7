"""The long colour search, k-means from several starts, and the command line's boxes and errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import components, quantize, search

PIXELS = "image_id long, x long, y long, b long, g long, r long"


def drawn(spark, grid, ink, key=1):
    """Pixels of a text grid: a character an ink."""
    return spark.createDataFrame([(key, x, y, *ink[c]) for y, row in enumerate(grid) for x, c in enumerate(row)], PIXELS)


def test_the_search_goes_on_until_its_lead_is_sure(spark, monkeypatch):
    """A sure cluster that doesn't lead ends nothing; a sure lead does."""
    monkeypatch.setattr(search, "candidate_scores", lambda assigned, confidence: confidence(assigned))
    p = drawn(spark, ["aabbccdd"] * 4, {"a": (0, 0, 0), "b": (90, 90, 90), "c": (180, 180, 180), "d": (250, 250, 250)})
    seen = []

    def scores(sure):
        def confidence(assigned):
            out = []
            for n in sorted(r.n for r in assigned.select((F.col("k") / search.SPAN).cast("int").alias("n")).distinct().collect()):
                seen.append(n)
                out += [(1, n * search.SPAN + k, sure if n == 3 and k == 0 else (0.98 if k == 1 else 0.8), 2, 1.0 if k == 0 else 0.0) for k in range(min(n, 4))]
            rows = spark.createDataFrame(out, "image_id long, k int, conf double, n_components long, likelihood double")
            return rows.withColumn("combined", F.col("conf") * (1 + 0.5 * F.col("likelihood")) + F.when(F.col("k") >= 4 * search.SPAN, 1.0).otherwise(0.0))

        return confidence

    got = search.exhaustive_search(p, scores(0.99), range(2, 7), 5).collect()
    assert seen == [2, 3, 4] and [(r.clusters, r.k, r.conf) for r in got] == [(3, 0, 0.99)]
    seen.clear()
    got = search.exhaustive_search(p, scores(0.8), range(2, 7), 5).collect()
    assert seen == [2, 3, 4, 5, 6] and [(r.clusters, r.k, r.conf) for r in got] == [(4, 0, 0.8)]


def test_shapes_are_the_first_of_those_given(spark):
    """Twelve specks above four letters: the letters are the first plausible components, whatever their labels."""
    rows = [(1, 3 * k, 0, 255) for k in range(12)] + [(1, 10 * k + x, 10 + y, 255) for k in range(4) for x in range(4) for y in range(6)]
    labels = components.label(spark.createDataFrame(rows, "image_id long, x long, y long, v int"))
    letters = components.plausible(components.features(labels)).select("image_id", "label")
    shapes = components.convexity(labels.join(letters, ["image_id", "label"], "left_semi")).collect()
    assert sorted(r.label for r in shapes) == [13, 14, 15, 16] and all(r.convexity == 1.0 for r in shapes)
    assert sorted(r.label for r in components.convexity(labels.where("label > 12"), most=2).collect()) == [13, 14]


def test_letters_of_a_mask_equal_the_table_version(spark):
    r = np.random.default_rng(8)
    a = (r.random((40, 60)) < 0.35) | (np.add.outer(np.arange(40) // 8 % 2, np.arange(60) // 9 % 2) == 0)
    y, x = np.nonzero(a)
    mask = spark.createDataFrame([(1, int(u), int(v), 255) for u, v in zip(x, y)], "image_id long, x long, y long, v int")
    labels = components.label(mask)
    found = {q.label: q for q in components.plausible(components.features(labels)).collect()}
    shapes = {q.label: q.convexity for q in components.convexity(labels.join(spark.createDataFrame([(1, k) for k in found], "image_id long, label long"), ["image_id", "label"], "left_semi")).collect()}
    got = components.letters(x, y)
    assert {k: (n, cx, cy) for k, n, cx, cy, _ in got} == {k: (q.area, pytest.approx(q.cx), pytest.approx(q.cy)) for k, q in found.items()}
    assert {k: s for k, *_, s in got if not np.isnan(s)} == pytest.approx(shapes) and components.letters(x[:0], y[:0]) == []


@pytest.mark.parametrize("upright", [False, True])
def test_text_in_a_tall_region_runs_downwards(spark, upright, monkeypatch):
    monkeypatch.setattr(search.tiles, "OPEN", ())
    place = (lambda a, b: (b, a)) if upright else (lambda a, b: (a, b))
    ink = {(7 + 12 * k + u, 6 + v) for k in range(4) for u in range(6) for v in range(6)}
    rows = [(1, *place(a, b), 1 if (a, b) in ink else 0) for a in range(60) for b in range(18)]
    assigned = spark.createDataFrame(rows, "image_id long, x long, y long, k int")
    got = {r.k: r for r in search.candidate_scores(assigned, lambda t: t.groupBy("image_id", "k").agg(F.lit(0.5).alias("conf"))).collect()}
    # Even sizes and even spacing along the line; by x alone an upright line has no spacing, and under 0.45.
    assert got[1].n_components >= 4 and got[1].likelihood > 0.55


def test_ten_starts_are_never_less_compact(spark):
    r = np.random.default_rng(9)
    points = r.integers(0, 256, (300, 3)).astype(float)
    weight = r.integers(1, 9, 300).astype(float)
    codes = (points @ np.array([65536, 256, 1])).astype(np.int64)
    found = [quantize.compactness(points, weight, quantize.best_fit(points, weight, codes, 8, 20, s)[1]) for s in (1, 3, 10)]
    assert found[0] >= found[1] >= found[2] and found[2] < found[0]
    assert (quantize.best_fit(points, weight, codes, 8, 20, 1)[1] == quantize.fit(points, weight, 8, 20)).all()
    plain = sum(weight[k] * ((points[k] - np.average(points[at == at[k]], axis=0, weights=weight[at == at[k]])) ** 2).sum() for at in [quantize.fit(points, weight, 8, 20)] for k in range(300))
    assert np.isclose(plain, found[0])


@pytest.mark.parametrize("box", ["10,10,-5,4", "10,10,5", "a,b,c,d", "10,10,0,4", "-1,0,5,5", ""])
def test_a_bad_box_ends_the_command_line(box, capsys):
    from inkframe.plans.__main__ import arguments

    with pytest.raises(SystemExit) as e:
        arguments(["-i", "a", "-o", "b", f"--force-bbox={box}"])
    assert e.value.code == 1 and "force-bbox" in capsys.readouterr().err
    assert arguments(["-i", "a", "-o", "b", "-f", "1, 2,3,4"]).force_bbox == (1, 2, 3, 4)


def broken(device):
    def detect(image):
        raise ValueError("no weights")

    return detect


def test_detector_failures_and_masks_of_any_size(spark, tmp_path, monkeypatch):
    from inkframe.plans import __main__ as command
    from inkframe.sources import images

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png(np.full((20, 30, 3), 120, np.uint8)))
    out = str(tmp_path / "out")
    command.main(["-i", str(tmp_path / "in"), "-o", out, "--detector", "east=tests.test_search_and_starts:broken", "--device", "cpu", "--granularity", "4"])
    errors = spark.read.parquet(f"{out}/errors").collect()
    assert errors and all(r.stage == "detect east" and "no weights" in r.message and r.name.endswith("a.png") for r in errors)
    assert {r.failover_type for r in spark.read.parquet(f"{out}/regions").collect()} == {"watermark"}
    found, bad = images.read_images(spark, f"{out}/clean")
    assert [(r.name.rsplit("/", 1)[-1], r.width, r.height) for r in found.collect()] == [("a_clean.png", 30, 20)] and bad.isEmpty()
    pixels = spark.createDataFrame([(i, x, y, 0, 0, 0) for i in (1, 2) for x in range(3) for y in range(2)], PIXELS)
    mask = spark.createDataFrame([("m", 0, 0, 255), ("m", 9, 9, 255)], "name string, x long, y long, v int")
    small = sorted(map(tuple, command.given_mask(pixels, mask).collect()))
    monkeypatch.setattr(command, "MASK_PIXELS", 0)
    assert small == sorted(map(tuple, command.given_mask(pixels, mask).collect())) == [(1, 0, 0, 255), (2, 0, 0, 255)]


def traced(cells):
    """The outer border of one 8-connected component, pixel by pixel: clockwise around each pixel from where the last one was entered."""
    turn = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]  # from the left, upwards
    start = min(cells, key=lambda p: (p[1], p[0]))
    ring, at, back, seen = [], start, 0, set()
    while (at, back) not in seen:
        seen.add((at, back))
        ring.append(at)
        for k in range(1, 9):
            d = turn[(back + k) % 8]
            if (at[0] + d[0], at[1] + d[1]) in cells:
                before = turn[(back + k - 1) % 8]
                empty = (at[0] + before[0], at[1] + before[1])
                at = (at[0] + d[0], at[1] + d[1])
                back = turn.index((empty[0] - at[0], empty[1] - at[1]))
                break
        else:
            return ring
    return ring


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


DRAWN = {
    "ring with a hole": ["#####", "#...#", "#...#", "#####"], "diagonal ring": ["..#..", ".#.#.", "#...#", ".#.#.", "..#.."], "arms": ["#....#", "######", "..#...", "..#..."],
    "diagonal": ["#...", ".#..", "..#.", "...#"], "bay": ["####", "#...", "####"], "one": ["#"], "line": ["#####"], "stairs": ["##...", ".##..", "..##.", "...##"], "two holes": ["#####", "#.#.#", "#####", "..#..", ".###.", ".#.#.", ".###."],
}


@pytest.mark.parametrize("name", DRAWN)
def test_outline_areas_equal_a_traced_border(name):
    cells = {(x, y) for y, row in enumerate(DRAWN[name]) for x, c in enumerate(row) if c == "#"}
    x, y = (np.array([p[k] for p in sorted(cells)]) for k in (0, 1))
    assert components._outline_area(x, y) == shoelace(traced(cells))


def test_outline_areas_of_random_shapes_equal_a_traced_border():
    r = np.random.default_rng(11)
    n = 0
    for share in (0.3, 0.45, 0.6, 0.8):
        for _ in range(12):
            y, x = np.nonzero(r.random((14, 17)) < share)
            k = components.label_pixels(x, y)
            for one in range(k.max() + 1):
                u, v = x[k == one], y[k == one]
                assert components._outline_area(u, v) == shoelace(traced(set(zip(u.tolist(), v.tolist()))))
                n += 1
    assert n > 200
