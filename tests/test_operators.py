"""Operators against hand-worked cases and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.functions import color
from inkframe.functions import geometry as geo
from inkframe.operators import colors, components, consensus, detections, filters, inpaint, models, morphology, quantize, search, textlike, tfidf
from inkframe.plans import cascade, report
from inkframe.sources import images
from inkframe.streaming import batches

DETECTION = "image_id long, det_id long, detector string, detector_rank int, x long, y long, w long, h long, conf double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def B(x, y, w, h):
    return geo.box(*(F.lit(v) for v in (x, y, w, h)))


def test_overlap_and_noisy_or(spark):
    r = one(
        spark, geo.overlap_area(B(0, 0, 10, 10), B(5, 5, 10, 10)).alias("a"), geo.overlap_area(B(0, 0, 10, 10), B(10, 0, 5, 5)).alias("touch"), geo.overlap_ratio(B(0, 0, 10, 10), B(0, 0, 0, 5)).alias("none"),
        geo.noisy_or(F.array(F.lit(0.8), F.lit(0.9), F.lit(75.0))).alias("c"), geo.noisy_or(F.array().cast("array<double>")).alias("empty"), geo.as_fraction(F.lit(1.0)).alias("whole"),
    )
    assert (r.a, r.touch, r.none, r.empty, r.whole) == (25.0, 0.0, 0.0, 0.0, 1.0) and math.isclose(r.c, 0.995)


def test_boxes(spark):
    r = one(
        spark, geo.pad(B(5, 5, 100, 50), F.lit(120), F.lit(60)).alias("pad"), geo.clip_forced(B(150, 10, 30, 30), F.lit(100), F.lit(100)).alias("clip"), geo.unrotate(B(2, 3, 4, 5), F.lit(20)).alias("back"),
        geo.expanded(B(0, 0, 32, 16), F.lit(64), F.lit(48)).alias("e"), geo.parse_box(F.lit("1,2,3,4")).alias("p"), geo.parse_box(F.lit("1,2,0,4")).alias("bad"), geo.parse_box(F.lit("1,2,x,4")).alias("word"),
        geo.dilate_percent(B(10, 10, 50, 31), 0.2, F.lit(100), F.lit(100)).alias("d"), geo.clamp(B(150, -5, 30, 30), F.lit(100), F.lit(100)).alias("c"),
    )
    assert tuple(r.pad) == (0, 0, 120, 60) and tuple(r.clip) == (99, 10, -50, 30) and tuple(r.back) == (3, 14, 5, 4)
    assert tuple(r.e) == (0, 0, 45, 22) and tuple(r.p) == (1, 2, 3, 4) and r.bad is None and r.word is None
    assert tuple(r.d) == (6, 6, 58, 39) and tuple(r.c) == (99, 0, 1, 30)


def test_colors(spark):
    r = one(
        spark, color.to_hex(F.lit(1), F.lit(2), F.lit(255)).alias("h"), color.from_hex(F.lit("ff0201")).alias("c"), color.named(F.lit("Teal")).alias("n"), color.named(F.lit("no")).alias("none"),
        color.near(F.lit(255), F.lit(255), F.lit(255), (255, 255, 255), 3).alias("wrap"), color.near(F.lit(255), F.lit(255), F.lit(255), (255, 255, 255), 3, "clamp").alias("clamp"),
        color.is_strict_hex(F.lit("808080")).alias("a"), color.is_strict_hex(F.lit("#GGGGGG")).alias("b"), color.is_strict_hex(F.lit("#80")).alias("d"),
        color.luma(F.lit(255), F.lit(0), F.lit(0), True).alias("swapped"), color.luma(F.lit(255), F.lit(255), F.lit(255)).alias("white"),
    )
    assert r.h == "#FF0201" and tuple(r.c) == (1, 2, 255) and tuple(r.n) == (128, 128, 0) and r.none is None
    assert not r.wrap and r.clamp and not (r.a or r.b or r.d) and r.swapped == 76 and r.white == 255
    assert color.parse("#0000FF") == (255, 0, 0) and color.parse("red") == (0, 0, 255)
    with pytest.raises(Exception, match="not a colour"):
        spark.range(1).select(color.strict_hex(F.lit("808080"))).collect()


MOCK = [("doctr", 100, 100, 50, 20, 0.9), ("doctr", 200, 150, 60, 25, 0.7), ("easyocr", 98, 102, 52, 22, 0.8), ("easyocr", 300, 200, 40, 15, 0.6), ("east", 101, 101, 48, 19, 0.75), ("east", 202, 148, 58, 28, 0.65)]


def boxes(spark, rows, order):
    return spark.createDataFrame([(1, k, d, order.index(d), *b) for k, (d, *b) in enumerate(rows)], DETECTION)


def test_consensus_of_three(spark):
    got = consensus.consensus(boxes(spark, MOCK, ["doctr", "easyocr", "east"])).orderBy("region_id").collect()
    assert [((r.x, r.y, r.w, r.h), r.detectors) for r in got] == [((98, 100, 52, 24), ["doctr", "easyocr", "east"]), ((200, 148, 60, 28), ["doctr", "east"])]
    assert [round(r.confidence, 6) for r in got] == [0.995, 0.895]


def test_consensus_may_repeat_a_detector(spark):
    rows = [("east", 0, 0, 100, 100, 0.5), ("doctr", 0, 0, 20, 20, 0.5), ("doctr", 50, 50, 20, 20, 0.5)]
    got = consensus.consensus(boxes(spark, rows, ["east", "doctr"])).collect()
    assert len(got) == 1 and got[0].detectors == ["east", "doctr", "doctr"] and got[0].confidence == 0.875 and got[0].detector_count == 3
    assert consensus.consensus(boxes(spark, rows, ["east", "doctr"]).where("false")).collect() == []


def test_overlap_pairs_by_tiles_equal_those_by_image(spark):
    r = random.Random(4)
    rows = [(r.randrange(3), k, r.choice(detections.DETECTORS), 0, r.randrange(-20, 300), r.randrange(300), r.randrange(0, 150), r.randrange(0, 150), r.random()) for k in range(300)]
    d = spark.createDataFrame(rows, DETECTION)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(consensus.overlap_pairs(d, tile=32)) == key(consensus.overlap_pairs(d, tile=None))


def test_suppression(spark):
    rows = [("east", 0, 0, 10, 10, 0.9), ("east", 1, 1, 10, 10, 0.8), ("east", 100, 100, 10, 10, 0.7), ("east", 50, 0, 10, 10, 0.05)]
    d = boxes(spark, rows, ["east"])
    ids = lambda c: sorted(r.det_id for r in detections.suppress(d, 0.4, 0.1, c).collect())
    assert ids("intended") == [0, 2] and ids("reference") == [0, 2]
    assert [r.det_id for r in detections.large_enough(detections.confident(d, 0.75), 10).collect()] == [0, 1]
    with pytest.raises(ValueError):
        detections.validate(1.5, 3)


def dense(spark, a):
    return spark.createDataFrame([(1, x, y, int(v)) for y, row in enumerate(a) for x, v in enumerate(row)], "image_id long, x long, y long, v int")


def back(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def test_morphology_matches_numpy(spark):
    r = np.random.default_rng(2)
    a = np.where(r.random((14, 17)) < 0.15, 255, 0)

    def plain(a, offsets, grow):
        out = np.zeros_like(a)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                near = [a[y + dy, x + dx] for dx, dy in offsets if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]
                out[y, x] = max(near) if grow else min(near)
        return out

    rect = [(dx, dy) for dx in range(-1, 2) for dy in range(-2, 3)]
    assert (back(morphology.rectangle(dense(spark, a), 1, 2), a.shape) == plain(a, rect, True)).all()
    half = morphology.half_widths(5)
    disc = [(dx, dy) for dy in range(-2, 3) for dx in range(-half[abs(dy)], half[abs(dy)] + 1)]
    assert (back(morphology.ellipse(dense(spark, a), 5, grow=False), a.shape) == plain(a, disc, False)).all()
    closed = back(morphology.close(dense(spark, a), 3), a.shape)
    assert (closed >= a).all() and (back(morphology.close(dense(spark, closed), 3), a.shape) == closed).all()
    assert (back(morphology.clean(dense(spark, np.zeros((5, 4)))), (5, 4)) == 0).all()
    k = np.array(morphology.weights(5))
    soft = a.astype(float)
    for axis in (0, 1):
        p = np.pad(soft, [(2, 2) if ax == axis else (0, 0) for ax in (0, 1)], mode="reflect")
        soft = sum(w * np.take(p, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    assert (back(morphology.smooth(dense(spark, a), 4), a.shape) == np.where(np.round(soft, 6) >= 127.5, 255, 0)).all()


def test_components_match_a_flood_fill(spark):
    r = np.random.default_rng(3)
    a = np.where(r.random((20, 23)) < 0.35, 255, 0)
    seen, want = {}, []
    for y in range(20):
        for x in range(23):
            if a[y, x] and (x, y) not in seen:
                todo = [(x, y)]
                seen[x, y] = len(want) + 1
                for cx, cy in todo:
                    for dx in (-1, 0, 1):
                        for dy in (-1, 0, 1):
                            n = (cx + dx, cy + dy)
                            if 0 <= n[0] < 23 and 0 <= n[1] < 20 and a[n[1], n[0]] and n not in seen:
                                seen[n] = len(want) + 1
                                todo.append(n)
                want.append(len(todo))
    labels = components.label(dense(spark, a))
    assert {(r.x, r.y): r.label for r in labels.collect()} == seen
    assert [r.area for r in components.features(labels).orderBy("label").collect()] == want
    square = components.label(dense(spark, np.pad(np.full((4, 6), 255), 1)))
    assert components.convexity(square).first().convexity == 1.0


def test_kmeans_by_group_equals_the_table_version(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(256), r.randrange(256), r.randrange(256), r.randrange(1, 9)) for i in range(3) for _ in range(60)] + [(9, 1, 2, 3, 4)]
    d = spark.createDataFrame(rows, "image_id long, b long, g long, r long, n long").dropDuplicates(["image_id", "b", "g", "r"])
    get = lambda df: sorted((x.image_id, x.b, x.g, x.r, x.n, x.k) for x in df.collect())
    assert get(quantize.lloyd(d, 5, 3)) == get(quantize.lloyd_by_group(d, 5, 3))
    assert quantize.lloyd_lab(d, 4, 5).count() == d.count()


def test_scores_without_a_corpus_are_even(spark):
    d = spark.createDataFrame([(1, 1, 0, True), (1, 1, 1, True), (2, 1, 0, True), (2, 1, 0, False), (2, 1, 1, False)], "image_id long, region_id int, k int, in_doc boolean")
    got = {(r.image_id, r.k): (r.norm, r.tf) for r in tfidf.cluster_scores(d).collect()}
    assert got[1, 0] == (128, 0.5) and got[2, 1][1] == 0.0
    assert {r.image_id: r.s for r in tfidf.cluster_scores(d).groupBy("image_id").agg(F.sum("tf").alias("s")).collect()} == {1: 1.0, 2: 1.0}


def test_line_of_text(spark):
    line = [(1, 10.0 * k, 5.0, 20.0) for k in range(5)]
    up = [(2, 5.0, 10.0 * k, 20.0) for k in range(5)]
    d = spark.createDataFrame([*line, *up, (3, 1.0, 1.0, 1.0), (4, 0.0, 0.0, 9.0), (4, 1.0, 1.0, 9.0)], "image_id long, cx double, cy double, area double")
    got = {r.image_id: r for r in textlike.likelihood(d).collect()}
    assert got[1].likelihood == pytest.approx(0.3 + 0.25 + 0.25 + 0.075 + 0.05) and got[2].colinearity == 0 and got[3].likelihood == 0 and got[4].count_score == 1.0
    vertical = spark.createDataFrame([(2,)], "image_id long")
    assert {r.image_id: r.spacing_uniformity for r in textlike.likelihood(d, vertical=vertical).collect()}[2] == 1.0


def test_inpainting(spark):
    pixels = spark.createDataFrame([(i, x, y, 100, 150, 200 if x < 6 else 40) for i in (1, 2) for y in range(9) for x in range(12)], "image_id long, x long, y long, b long, g long, r long")
    mask = pixels.select("image_id", "x", "y", F.when((F.col("image_id") == 1) & F.col("x").between(2, 4) & F.col("y").between(3, 5), 255).otherwise(0).alias("v"))
    hurt = pixels.join(mask, ["image_id", "x", "y"]).select("image_id", "x", "y", *(F.when(F.col("v") > 0, 0).otherwise(F.col(c)).alias(c) for c in "bgr"))
    out = inpaint.telea(hurt, mask)
    key = lambda df: {(r.image_id, r.x, r.y): (r.b, r.g, r.r) for r in df.collect()}
    got, want = key(out), key(pixels)
    assert all(got[k] == want[k] for k in want if k[0] == 2 or not (2 <= k[1] <= 4 and 3 <= k[2] <= 5))
    assert all(abs(a - b) <= 60 for k in want for a, b in zip(got[k], want[k])) and abs(got[1, 2, 4][2] - 200) <= 2
    assert tuple(inpaint.mask_box(mask).first())[1:] == (2, 3, 2, 2, 9)
    assert tuple(inpaint.mask_box(mask, "intended").first())[1:] == (2, 3, 3, 3, 9)
    sizes = spark.createDataFrame([(1, 12, 9), (2, 12, 9)], "image_id long, width long, height long")
    assert tuple(inpaint.subregion(mask, sizes, 1).first()) == (1, 1, 2, 5, 6)
    with pytest.raises(ValueError):
        inpaint.telea(pixels, mask, 0)


def test_filters_keep_flat_images_and_find_edges():
    flat = np.full((20, 30), 90)
    assert (filters.bilateral(flat) == 90).all() and (filters.canny(flat) == 0).all() and len(np.unique(filters.contrast(flat))) == 1
    step = np.where(np.arange(30)[None, :] < 15, 20, 220).repeat(20, axis=0)
    edge = filters.canny(step)
    assert set(np.flatnonzero(edge.any(axis=0))) <= {14, 15} and (edge.any(axis=1)).all()


def test_cascade_takes_the_first_branch(spark):
    sizes = spark.createDataFrame([(k, 64, 48) for k in (1, 2, 3)], "image_id long, width long, height long")
    region = "image_id long, x long, y long, w long, h long"
    first, second = spark.createDataFrame([(1, 0, 0, 5, 5), (1, 9, 9, 5, 5)], region), spark.createDataFrame([(1, 1, 1, 1, 1), (2, 2, 2, 2, 2)], region)
    branches = [("none", first), ("rotation", second), ("watermark", cascade.baselines(sizes))]
    want = {(1, 0, "none"), (1, 9, "none"), (2, 2, "rotation"), (3, 48, "watermark"), (3, 60, "watermark")}
    assert {(r.image_id, r.x, r.failover_type) for r in cascade.first_found(sizes, branches).collect()} == want
    lazy = [(k, lambda left, r=r: r.join(left.select("image_id"), "image_id", "left_semi")) for k, r in branches]
    assert {(r.image_id, r.x, r.failover_type) for r in cascade.staged(sizes, lazy, lambda d: d.persist()).collect()} == want
    got = cascade.regions_of(sizes, boxes(spark, MOCK, ["doctr", "easyocr", "east"]).where("false"), forced=spark.createDataFrame([(2, 60, 40, 20, 20)], region))
    assert sorted((r.image_id, r.x, r.w) for r in got.collect()) == [(1, 48, 16), (1, 60, 4), (2, 60, 4), (3, 48, 16), (3, 60, 4)]


def test_images_round_trip(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (7, 5, 3))
    (tmp_path / "b.PNG").write_bytes(images.png(a))
    (tmp_path / "gray.png").write_bytes(images.png(a[:, :, 0]))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "note.txt").write_bytes(b"text")
    assert [r.path.rsplit("/", 1)[1] for r in images.list_images(spark, str(tmp_path)).collect()] == ["b.PNG", "bad.jpg", "gray.png"]
    found, errors = images.read_images(spark, str(tmp_path))
    assert [r.name.rsplit("/", 1)[1] for r in errors.collect()] == ["bad.jpg"]
    pixels = images.to_pixels(found.withColumn("image_id", F.when(F.lower("name").contains("gray"), 2).otherwise(1).cast("long")))
    got = {(r.image_id, r.x, r.y): (r.r, r.g, r.b) for r in pixels.collect()}
    assert all(got[1, x, y] == tuple(a[y, x]) and got[2, x, y] == (a[y, x, 0],) * 3 for y in range(7) for x in range(5))
    made = {r.image_id: bytes(r.png) for r in images.encode_png(pixels).collect()}
    assert made[1] == images.png(a)
    assert tuple(one(spark, images.output_names(F.lit("/d.x/a.b.jpg")).alias("n")).n) == ("a.b_clean.jpg", "a.b_mask.png", "a.b.txt")


def test_reports_of_nothing(spark):
    t = spark.createDataFrame([], "image_id long, failover_type string, detection_time double, color_time double, inpaint_time double, consensus_boxes_count int")
    assert {r.n for r in report.failover_counts(t).collect()} == {0} and all(r.mean == 0 for r in report.timing_stats(t).collect())


def test_stream_runs_the_same_plan(spark, tmp_path):
    d = boxes(spark, MOCK, ["doctr", "easyocr", "east"]).coalesce(1)
    d.write.parquet(str(tmp_path / "in"))
    batches.watch(spark, str(tmp_path / "in"), DETECTION, consensus.consensus, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_exact_and_near_masks(spark):
    p = spark.createDataFrame([(1, 0, 0, 10, 20, 30), (1, 1, 0, 12, 22, 32), (1, 2, 0, 200, 200, 200)], "image_id long, x long, y long, b long, g long, r long")
    c = spark.createDataFrame([(10, 20, 30)], "b long, g long, r long")
    assert [r.v for r in colors.mask_exact(p, c).orderBy("x").collect()] == [255, 0, 0]
    assert [r.v for r in colors.mask_near(p, [(10, 20, 30)]).orderBy("x").collect()] == [255, 255, 0]
    assert [r.v for r in colors.mask_near(p, []).orderBy("x").collect()] == [0, 0, 0]


def test_detectors_are_plugged_in(spark):
    made = spark.createDataFrame([(1, 4, 3, 3, bytes(36)), (2, 4, 3, 1, bytes(12)), (3, 4, 3, 3, bytes(5))], "image_id long, width int, height int, channels int, data binary")

    def load():
        return lambda image: [(0, 0, image.shape[1], image.shape[0], 0.9), (0, 0, 1, 1, 0.9), (0, 0, 4, 4, 0.1)]

    found, errors = models.detect_all(made, {"doctr": load}, 0.5)
    assert sorted((r.image_id, r.w, r.h, r.detector_rank) for r in found.collect()) == [(1, 4, 3, 1), (2, 4, 3, 1)]
    assert [(r.image_id, r.stage) for r in errors.collect()] == [(3, "detect doctr")]


def test_text_colors(spark):
    rows = [(1, x, y, *((30, 30, 30) if x < 4 else (200, 40, 90))) for x in range(8) for y in range(8)] + [(1, 9, 9, 31, 30, 30)]
    p = spark.createDataFrame(rows, "image_id long, x long, y long, b long, g long, r long")
    assert [(r.b, r.g, r.r, r.n) for r in search.find_text_colors(p, clusters=2).collect()] == [(30, 30, 30, 32)]
    assert [(r.b, r.g, r.r, r.n) for r in search.find_text_colors(p, (190, 50, 80), clusters=2).collect()] == [(200, 40, 90, 32)]


def test_exhaustive_search_stops_at_a_sure_cluster(spark):
    rows = [(1, x, y, *((10, 10, 10) if x // 5 % 2 and 5 <= y < 15 else (220, 220, 220))) for x in range(40) for y in range(20)]
    p = spark.createDataFrame(rows, "image_id long, x long, y long, b long, g long, r long")

    def confidence(tests):
        return tests.groupBy("image_id", "k").agg(F.when(F.avg((F.col("v") == 0).cast("int")) < 0.5, 0.99).otherwise(0.2).alias("conf"))

    got = search.exhaustive_search(p, confidence, range(2, 5), 5).collect()
    assert len(got) == 1 and got[0].clusters == 2 and got[0].conf == 0.99


@pytest.mark.parametrize("target", [None, (150, 140, 160)])
def test_text_mask_equals_the_table_version(spark, target):
    r = random.Random(6)
    ink = lambda x, y: (30, 32, 34) if 8 <= y < 16 and x % 5 < 2 else (r.randrange(100, 200, 20), r.randrange(90, 180, 20), r.randrange(110, 200, 20))
    p = spark.createDataFrame([(i, x, y, *ink(x, y)) for i in (1, 2) for x in range(32) for y in range(24)], "image_id long, x long, y long, b long, g long, r long")
    regions = spark.createDataFrame([(1, 1, 6, 6, 14, 12, 32, 24), (1, 2, 0, 0, 6, 6, 32, 24), (2, 1, 0, 0, 32, 24, 32, 24), (2, 2, 3, 3, 2, 2, 32, 24)], "image_id long, region_id int, x long, y long, w long, h long, width long, height long")
    keys = ["image_id", "region_id"]
    near = tfidf.region_pixels(p, regions)
    k = quantize.lloyd(colors.distinct_colors(near, keys), 6, 4, keys)
    own = near.join(k.drop("n"), [*keys, "b", "g", "r"])
    forced = quantize.nearest_cluster(quantize.centres_of(k, keys), target, keys) if target else None
    want = tfidf.score_map(own, tfidf.cluster_scores(own, keys, clusters=6), keys, target=forced)
    get = lambda d: sorted((a.image_id, a.region_id, a.x, a.y, a.v) for a in d.collect())
    got = get(tfidf.text_mask(p, regions, 6, 4, target, clean=False))
    assert got == [a for a in get(want) if (a[0], a[1]) != (2, 2) or near.where("image_id = 2 AND region_id = 2").count() >= 6] and any(a[4] for a in got)


def test_every_css_colour_has_its_name(spark):
    assert len(color.NAMES) == 148 and color.parse("Orange") == (0, 165, 255) and color.parse("rebeccapurple") == (153, 51, 102)
    assert all(color.NAMES[k] == color.NAMES[k.replace("grey", "gray")] for k in color.NAMES)
    got = spark.range(1).select(color.named(F.lit("LightSlateGrey")).alias("c")).first().c
    assert (got.b, got.g, got.r) == (0x99, 0x88, 0x77)


def test_clusters_without_pixels_count_with_score_zero(spark):
    rows = [(1, 1, 0, True)] * 6 + [(1, 1, 1, True)] * 4 + [(1, 1, 0, False)] + [(1, 1, 1, False)] * 3 + [(1, 1, 1, False)] * 4
    d = spark.createDataFrame(rows, "image_id long, region_id int, k int, in_doc boolean")
    got = {r.k: (r.n_doc, r.n_corpus, r.norm) for r in tfidf.cluster_scores(d, clusters=3).collect()}
    assert got[2][:2] == (0, 0) and got[0][2] == 255
    high, low = 0.6 * math.log(8 / 2), 0.4 * math.log(8 / 8)
    assert got[2][2] == 0 and got[1][2] == int((low - min(low, 0)) / (high - min(low, 0)) * 255)


def plain_groups(boxes, names, threshold):
    """Seeds in order; for each box that a seed takes, later boxes of new detectors that meet any member."""

    def meet(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        small = min(a[2] * a[3], b[2] * b[3])
        return w > 0 and h > 0 and small > 0 and w * h / small >= threshold

    used, out = set(), []
    for s in range(len(boxes)):
        if s in used:
            continue
        own = [s]
        used.add(s)
        for j in range(s + 1, len(boxes)):
            if j in used or names[j] == names[s] or not meet(boxes[s], boxes[j]):
                continue
            own.append(j)
            used.add(j)
            for k in range(j + 1, len(boxes)):
                if k not in used and names[k] not in {names[m] for m in own} and any(meet(boxes[m], boxes[k]) for m in own):
                    own.append(k)
                    used.add(k)
        out.append(own)
    return out


def test_consensus_by_neighbours_equals_all_pairs(spark):
    r = random.Random(2)
    rows, want = [], []
    for i in range(25):
        boxes = [(r.randrange(300), r.randrange(200), r.randrange(5, 140), r.randrange(5, 90)) for _ in range(r.randrange(1, 40))]
        rank = sorted(r.randrange(3) for _ in boxes)
        names = [detections.DETECTORS[k] for k in rank]
        rows += [(i, r.choice([n, n]), names[n], rank[n], *b, r.random()) for n, b in enumerate(boxes)]
        for own in plain_groups(boxes, names, 0.1):
            if len(own) >= 2:
                want.append((i, min(boxes[m][0] for m in own), min(boxes[m][1] for m in own), [names[m] for m in own]))
    d = spark.createDataFrame(rows, "image_id long, det_id long, detector string, detector_rank int, x long, y long, w long, h long, conf double").repartition(3)
    got = [(x.image_id, x.x, x.y, x.detectors) for x in consensus.consensus(d).collect()]
    assert sorted(got) == sorted(want) and want


def test_search_folds_candidates_in_order(spark):
    rows = [(1, 2, 0, 0.5, 3), (1, 2, 1, 0.505, 2), (1, 3, 0, 0.502, 9), (1, 3, 1, 0.49, 50), (1, 3, 2, 0.4951, 60), (2, 2, 0, 0.0, 0), (3, 2, 0, 0.0, 4)]
    d = spark.createDataFrame([(i, n, k, c, m, 0.0, c, 1.0, 2.0, 3.0) for i, n, k, c, m in rows], "image_id long, clusters int, k int, conf double, n_components long, likelihood double, combined double, b double, g double, r double")
    got = {x.image_id: (x.clusters, x.k) for x in search.best_of(d).collect()}
    best, want = {}, {}
    for i, n, k, c, m in rows:
        lead = best.get(i, (0.0, 0))
        if c > lead[0] or abs(c - lead[0]) < 0.01 and m > lead[1]:
            best[i], want[i] = (c, m), (n, k)
    assert got == want and 2 not in got


def test_search_falls_back_to_the_darkest_pixel(spark):
    p = spark.createDataFrame([(1, x, y, 50 + x + y, 60, 70) for x in range(12) for y in range(12)], "image_id long, x long, y long, b long, g long, r long")
    got = search.exhaustive_search(p, lambda t: t.groupBy("image_id", "k").agg(F.lit(0.0).alias("conf")), range(2, 3), 5).collect()
    assert [(x.clusters, x.b, x.g, x.r) for x in got if x.clusters is None] in ([], [(None, 50.0, 60.0, 70.0)]) and len(got) == 1
    assert [tuple(x) for x in search.darkest(p).collect()] == [(1, 50, 60, 70)]


def folder_of_images(path):
    path.mkdir()
    r = np.random.default_rng(0)
    for k in range(2):
        a = np.clip(r.normal(150, 4, (40, 60, 3)), 0, 255).astype(np.uint8)
        a[14:22, 20:40:4] = 20
        a[14:22, 21:40:4] = 20
        (path / f"im{k}.png").write_bytes(images.png(a))
    (path / "bad.png").write_bytes(b"no image")
    return str(path)


def test_command_line(spark, tmp_path):
    from inkframe.plans.__main__ import arguments, main

    folder = folder_of_images(tmp_path / "in")
    out = str(tmp_path / "out")
    main(["-i", folder, "-o", out, "-f", "16,10,30,16", "-k", "-t", "-l", str(tmp_path / "log"), "--granularity", "8", "--device", "cpu"])
    png = spark.read.parquet(f"{out}/png").collect()
    assert sorted(r.file for r in png) == ["im0_clean.png", "im1_clean.png"] and all(bytes(r.png).startswith(b"\x89PNG") for r in png)
    assert [(r.stage, r.file) for r in spark.read.parquet(f"{out}/errors").collect()] == [("load", "bad.txt")]
    assert sorted(r.file for r in spark.read.parquet(f"{out}/mask_png").collect()) == ["im0_mask.png", "im1_mask.png"]
    lines = [r.value for r in spark.read.text(f"{out}/timing_report").collect()]
    assert [x.split()[0].rsplit("/")[-1] for x in lines if ".png" in x] == ["im0.png", "im1.png"] and "inpaint_time" in (tmp_path / "log").read_text()
    assert {"clusters: 8", "painted by: telea", "  none: 2", "  watermark (B): 0"} <= set(lines) and any(x.startswith("median") for x in lines)
    assert (tmp_path / "log.timing.txt").read_text().splitlines() == lines
    times = spark.read.parquet(f"{out}/timings").collect()
    assert all(r.failover_type == "none" and r.consensus_boxes_count == 1 and r.image_mp == 0.0024 for r in times)
    mask = str(tmp_path / "mask.png")
    m = np.zeros((40, 60), np.uint8)
    m[10:12, 10:12] = 255
    (tmp_path / "mask.png").write_bytes(images.png(m))
    main(["-i", folder, "-o", f"{out}2", "-m", mask])
    assert spark.read.parquet(f"{out}2/masks").where("v > 0").count() == 8
    for bad in (["--granularity", "3"], ["--confidence-threshold", "2"], ["-p", "lama"], ["--detector", "other=x:y"]):
        with pytest.raises(SystemExit):
            arguments(["-i", "a", "-o", "b", *bad])


def test_detection_is_tried_in_turn(spark, tmp_path):
    rows = []
    for i, ink in enumerate([(200, 120, 20), (128, 128, 128), (0, 0, 0)], 1):
        a = np.full((30, 50, 3), 200, np.uint8)
        a[10:16, 12:30] = ink
        rows.append((i, 50, 30, 3, bytearray(a.tobytes())))
    table = spark.createDataFrame(rows, "image_id long, width int, height int, channels int, data binary")

    def load():
        def find(image):  # sees a patch only if it is as dark as black
            y, x = np.nonzero(image[:, :, 0] < 30)
            return [(int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1), 0.9)] if len(x) > 20 and image.shape[1] == 50 else []

        return find

    loads = {"east": load, "doctr": load}
    got = {r.image_id: r.failover_type for r in cascade.detected_regions(table, loads).collect()}
    assert got[3] == "none" and got[2] == "gray_enhancement" and got[1] == "watermark"
    got = {r.image_id: r.failover_type for r in cascade.detected_regions(table, loads, target=(200, 120, 20)).collect()}
    assert got[1] == "target_color" and got[3] == "target_color" and got[2] == "gray_enhancement"


def test_models_paint_the_box_of_the_mask(spark):
    p = spark.createDataFrame([(1, x, y, 10, 20, 30) for x in range(40) for y in range(30)], "image_id long, x long, y long, b long, g long, r long")
    mask = p.select("image_id", "x", "y", F.when((F.col("x").between(10, 12)) & (F.col("y") == 7), 255).otherwise(0).cast("int").alias("v"))

    def load():
        calls = []

        def paint(image, lit):
            calls.append(image.shape)
            if len(calls) == 1 and load.__name__ == "load" and not models.status("probe")["loaded"]:
                models.instance("probe", lambda: 1)
                raise ValueError("not yet")
            assert image[0, 0].tolist() == [30, 20, 10] and lit.shape == image.shape[:2] and (lit > 0).sum() == 3
            return np.full((image.shape[0] + 3, image.shape[1] + 5, 3), (1, 2, 3), np.uint8)

        return paint

    got = {(r.x, r.y): (r.b, r.g, r.r) for r in inpaint.fill_by_model(p, mask, "painter", load, context=2).collect()}
    assert {k for k, v in got.items() if v == (3, 2, 1)} == {(x, y) for x in range(8, 15) for y in range(5, 10)} and got[0, 0] == (10, 20, 30)
    cut = {(r.x, r.y): r.b for r in inpaint.telea(p, mask, context=2).collect()}
    assert set(cut.values()) == {10}


def test_model_of_a_process():
    made = []

    def load():
        made.append(1)
        return len(made)

    models.reset()
    assert models.status("m") == {"loaded": False, "healthy": False}
    assert models.instance("m", load) == 1 and models.instance("m", load) == 1

    def call(model):
        if model == 1:
            raise ValueError("worn out")
        return model

    assert models.retried("m", load, call) == 2 and models.status("m", lambda m: m)["healthy"] and not models.status("m", lambda m: 1 / 0)["healthy"]
    with pytest.raises(RuntimeError):
        models.retried("m", load, lambda m: 1 / 0)
    models.reset()
    assert models.pick_device("cpu") == "cpu" and models.pick_device("cuda") in ("cpu", "cuda")


def test_image_for_a_reader_of_text(spark):
    p = spark.createDataFrame([(1, x, 0, 100 + x, 50, 50) for x in range(8)], "image_id long, x long, y long, b long, g long, r long")
    got = [r.b for r in colors.ocr_image(p, (1, 0, 6, 1), (103, 50, 50)).orderBy("x").collect()]
    assert got == [255, 0, 0, 0, 0, 0, 255, 255]


def test_library_names():
    import inkframe

    assert all(callable(getattr(inkframe, n)) for n in inkframe.__all__) and "main" in inkframe.__all__
