"""The registered queries: each operator over its fixture, and the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe import fixtures
from inkframe.functions import color
from inkframe.functions import geometry as geo
from inkframe.operators import colors, components, consensus, detections, filters, inpaint, morphology, quantize, search, textlike, tfidf, tiles
from inkframe.plans import annotate, cascade, report
from inkframe.sources import images as files

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Size of the images that the detections lie on.
WIDTH, HEIGHT = 480, 340


def _add(name: str, table: str, plan: Callable[..., DataFrame], tail: str | None, recursive: bool = False, sized: bool = False) -> None:
    """``sized``: the plan is also told in how many tasks the pixels are made."""
    _queries[name] = lambda spark, sf_dir: plan(fixtures.load(spark, sf_dir, table), **({"tasks": fixtures.tasks(spark, sf_dir)} if sized else {}))
    if tail is not None:
        _sql[name] = fixtures.sql(table, tail, recursive)


def _mask(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "x", "y", F.when(F.col("is_text"), 255).otherwise(0).cast("int").alias("v"))


def _regions(pixels: DataFrame) -> DataFrame:
    rows = pixels.select("image_id", "bx", "by_", "bw", "bh", "width", "height").distinct()
    return rows.select("image_id", F.lit(1).alias("region_id"), F.col("bx").alias("x"), F.col("by_").alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h"), "width", "height")




def _bgr() -> tuple[Column, Column, Column]:
    return F.col("b"), F.col("g"), F.col("r")


MASK_SQL = ", mask AS (SELECT image_id, x, y, CASE WHEN is_text THEN 255 ELSE 0 END AS v FROM pixels)"

# --- images and colours ---------------------------------------------------------------------------------
_add("image_catalog", "images", lambda d: d.select("image_id", "width", "height", geo.megapixels(F.col("width"), F.col("height")).alias("megapixels")), "SELECT image_id, width, height, width * height / 1e6 AS megapixels FROM images")
_add(
    "pixel_stats", "pixels",
    lambda d: d.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("sum_b"), F.sum("g").alias("sum_g"), F.sum("r").alias("sum_r"), F.min("b").alias("min_b"), F.max("r").alias("max_r")),
    "SELECT image_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS sum_b, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(r) AS BIGINT) AS sum_r, min(b) AS min_b, max(r) AS max_r FROM pixels GROUP BY image_id",
)
_add(
    "color_hex_roundtrip", "pixels",
    lambda d: d.select(color.to_hex(*_bgr()).alias("hex")).groupBy("hex").agg(F.count(F.lit(1)).alias("n")).withColumn("c", color.strict_hex(F.col("hex"))).select("hex", "n", "c.*"),
    "SELECT printf('#%02X%02X%02X', r, g, b) AS hex, count(*) AS n, CAST(b AS INT) AS b, CAST(g AS INT) AS g, CAST(r AS INT) AS r FROM pixels GROUP BY b, g, r",
)
for _name, _swap, _wb, _wr in (("luma_swapped", True, 9798, 3735), ("luma_standard", False, 3735, 9798)):
    _add(
        _name, "pixels", lambda d, s=_swap: d.groupBy("image_id", color.luma(*_bgr(), s).alias("gray")).agg(F.count(F.lit(1)).alias("n")),
        f"SELECT image_id, CAST(floor((b*{_wb} + g*19235 + r*{_wr} + 16384) / 32768) AS BIGINT) AS gray, count(*) AS n FROM pixels GROUP BY 1, 2",
    )
_TARGETS = {"enhance_wrap": ("wrap", (140, 130, 150), 12), "enhance_clamp": ("clamp", (250, 240, 252), 90), "enhance_wrap_white": ("wrap", (255, 255, 255), 3)}
for _name, (_compat, _target, _tol) in _TARGETS.items():
    _lo, _hi = ([(t + d * _tol) % 256 if _compat == "wrap" else min(255, max(0, t + d * _tol)) for t in _target] for d in (-1, 1))
    _hit = " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, lo, hi in zip("bgr", _lo, _hi))
    _add(
        _name, "pixels",
        lambda d, t=_target, n=_tol, c=_compat: colors.enhance(d, t, n, c).groupBy("image_id").agg(F.sum("hit").alias("n_hit"), (F.avg("hit") * 100).alias("percent"), F.sum("b").alias("sum_b"), F.sum("r").alias("sum_r")),
        f"SELECT image_id, CAST(sum(CASE WHEN {_hit} THEN 1 ELSE 0 END) AS BIGINT) AS n_hit, avg(CASE WHEN {_hit} THEN 1 ELSE 0 END) * 100 AS percent, CAST(sum(CASE WHEN {_hit} THEN 0 ELSE b END) AS BIGINT) AS sum_b, CAST(sum(CASE WHEN {_hit} THEN 0 ELSE r END) AS BIGINT) AS sum_r FROM pixels GROUP BY image_id",
    )
_add(
    "gray_to_black", "pixels", lambda d: colors.gray_to_black(d).where("b = 0 AND g = 0 AND r = 0").groupBy("image_id").agg(F.count(F.lit(1)).alias("n_black")),
    "SELECT image_id, count(*) AS n_black FROM pixels WHERE b BETWEEN 124 AND 132 AND g BETWEEN 124 AND 132 AND r BETWEEN 124 AND 132 GROUP BY image_id",
)
_add(
    "color_distance_topk", "pixels",
    lambda d: colors.distinct_colors(d, []).withColumn("distance", color.distance(*_bgr(), (128, 128, 128))).orderBy("distance", "b", "g", "r").limit(10),
    "SELECT b, g, r, count(*) AS n, sqrt((b-128)*(b-128) + (g-128)*(g-128) + (r-128)*(r-128)) AS distance FROM pixels GROUP BY b, g, r ORDER BY distance, b, g, r LIMIT 10",
)
_add(
    "mask_exact_colors", "pixels",
    lambda d: colors.mask_exact(d, d.sparkSession.createDataFrame([(b, b + 2, b + 4) for b in range(20, 26)], "b long, g long, r long")).groupBy("image_id").agg(F.count_if(F.col("v") == 255).alias("n_text")),
    "SELECT image_id, count(*) FILTER (WHERE b BETWEEN 20 AND 25 AND g = b + 2 AND r = b + 4) AS n_text FROM pixels GROUP BY image_id",
)
_add(
    "mask_tolerance_colors", "pixels", lambda d: colors.mask_near(d, [(24, 26, 28), (150, 140, 160)]).groupBy("image_id").agg(F.count_if(F.col("v") == 255).alias("n_text")),
    "SELECT image_id, count(*) FILTER (WHERE (abs(b-24) <= 10 AND abs(g-26) <= 10 AND abs(r-28) <= 10) OR (abs(b-150) <= 10 AND abs(g-140) <= 10 AND abs(r-160) <= 10)) AS n_text FROM pixels GROUP BY image_id",
)
_add("distinct_color_counts", "pixels", lambda d: colors.distinct_colors(d, least=4), "SELECT image_id, b, g, r, count(*) AS n FROM pixels GROUP BY image_id, b, g, r HAVING count(*) >= 4")
_add(
    "grayest", "pixels", lambda d: colors.grayest(colors.distinct_colors(d)),
    """, v AS (SELECT DISTINCT image_id, b, g, r, ((b-(b+g+r)/3.0)*(b-(b+g+r)/3.0) + (g-(b+g+r)/3.0)*(g-(b+g+r)/3.0) + (r-(b+g+r)/3.0)*(r-(b+g+r)/3.0)) / 3.0 AS variance FROM pixels)
    SELECT image_id, variance, b, g, r FROM v QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY variance, b, g, r) = 1""",
)
_add(
    "count_ranges", "pixels", lambda d: colors.count_ranges(colors.distinct_colors(d.select("image_id", F.floor(F.col("b") / 16).alias("b"), F.floor(F.col("g") / 16).alias("g"), F.floor(F.col("r") / 16).alias("r")))),
    """, c AS (SELECT image_id, count(*) AS n FROM pixels GROUP BY image_id, floor(b/16), floor(g/16), floor(r/16))
    SELECT image_id, count(*) FILTER (WHERE n >= 10 AND n < 50) AS n_10_50, count(*) FILTER (WHERE n >= 51 AND n < 100) AS n_51_100, count(*) FILTER (WHERE n >= 101 AND n < 500) AS n_101_500,
    count(*) FILTER (WHERE n >= 501 AND n < 1000) AS n_501_1000, count(*) FILTER (WHERE n >= 1001) AS n_1001_up FROM c GROUP BY image_id""",
)
_add(
    "rotate_pixels", "pixels",
    lambda d: (lambda p: d.select("image_id", p[0].alias("x"), p[1].alias("y"), "b"))(geo.rotate_point(F.col("x"), F.col("y"), F.col("height"))),
    "SELECT image_id, height - 1 - y AS x, x AS y, b FROM pixels",
)

# --- boxes ----------------------------------------------------------------------------------------------
_add("detections_conf_filter", "detections", lambda d: detections.confident(d, 0.7).select("image_id", "det_id", "conf"), "SELECT image_id, det_id, conf FROM detections WHERE conf >= 0.7")
_add("min_size", "detections", lambda d: detections.large_enough(d, 25).select("image_id", "det_id", "w", "h"), "SELECT image_id, det_id, w, h FROM detections WHERE w >= 25 AND h >= 25")


def _polygons(d: DataFrame) -> DataFrame:
    at = lambda x, y: F.struct((F.col("x") + x).cast("float").alias("x"), (F.col("y") + y).cast("float").alias("y"))
    points = F.array(at(F.lit(0.25), F.lit(0.5)), at(F.col("w"), F.lit(0.0)), at(F.col("w") + 0.5, F.col("h") + 0.75), at(F.lit(-0.5), F.col("h")))
    return detections.polygons_to_boxes(d.select("image_id", "det_id", points.alias("geometry"))).select("image_id", "det_id", "x", "y", "w", "h")


_add(
    "polygon_to_bbox", "detections", _polygons,
    "SELECT image_id, det_id, CAST(trunc(x - 0.5) AS BIGINT) AS x, y, CAST(trunc(w + 0.5 + 0.5) AS BIGINT) AS w, CAST(trunc(h + 0.75) AS BIGINT) AS h FROM detections",
)


def _boxed(d: DataFrame, made) -> DataFrame:
    return d.withColumn("_b", made).select("image_id", "det_id", "_b.*")




def _wide() -> Column:
    return F.lit(WIDTH).cast("long")


def _high() -> Column:
    return F.lit(HEIGHT).cast("long")


_ID = "SELECT image_id, det_id, "
_add(
    "pad_boxes", "detections", lambda d: _boxed(d, geo.pad(geo.box(), _wide(), _high())),
    f"""{_ID} greatest(0, x - CAST(trunc(w*0.1) AS BIGINT)) AS x, greatest(0, y - CAST(trunc(h*0.1) AS BIGINT)) AS y, least({WIDTH} - greatest(0, x - CAST(trunc(w*0.1) AS BIGINT)), w + 2*CAST(trunc(w*0.1) AS BIGINT)) AS w,
    least({HEIGHT} - greatest(0, y - CAST(trunc(h*0.1) AS BIGINT)), h + 2*CAST(trunc(h*0.1) AS BIGINT)) AS h FROM detections""",
)
_add(
    "clip_forced", "detections", lambda d: _boxed(d, geo.clip_forced(geo.box(), F.lit(300).cast("long"), F.lit(200).cast("long"))),
    f"""{_ID} CASE WHEN o THEN least(x, 299) ELSE x END AS x, CASE WHEN o THEN least(y, 199) ELSE y END AS y, CASE WHEN o THEN least(w, 300 - x) ELSE w END AS w, CASE WHEN o THEN least(h, 200 - y) ELSE h END AS h
    FROM (SELECT *, x + w > 300 OR y + h > 200 AS o FROM detections)""",
)
_add(
    "clamp_boxes", "detections", lambda d: _boxed(d, geo.clamp(geo.box(), F.lit(300).cast("long"), F.lit(200).cast("long"))),
    f"{_ID} least(x, 299) AS x, least(y, 199) AS y, least(w, 300 - least(x, 299)) AS w, least(h, 200 - least(y, 199)) AS h FROM detections",
)
_add(
    "dilate_px", "detections", lambda d: _boxed(d, geo.dilate(geo.box(), 10, _wide(), _high())),
    f"{_ID} greatest(0, x-10) AS x, greatest(0, y-10) AS y, least({WIDTH}, x+w+10) - greatest(0, x-10) AS w, least({HEIGHT}, y+h+10) - greatest(0, y-10) AS h FROM detections",
)
_add(
    "dilate_pct", "detections", lambda d: _boxed(d, geo.dilate_percent(geo.box(), 0.25, _wide(), _high())),
    f"""{_ID} greatest(0, x-p) AS x, greatest(0, y-p) AS y, least({WIDTH}, x+w+p) - greatest(0, x-p) AS w, least({HEIGHT}, y+h+p) - greatest(0, y-p) AS h
    FROM (SELECT *, CAST(floor((CAST(trunc(w*0.125) AS BIGINT) + CAST(trunc(h*0.125) AS BIGINT)) / 2) AS BIGINT) AS p FROM detections)""",
)
_add("unrotate_boxes", "detections", lambda d: _boxed(d, geo.unrotate(geo.box(), _wide())), f"{_ID} y AS x, {WIDTH} - x - w AS y, h AS w, w AS h FROM detections")
_add(
    "baseline_boxes", "images", lambda d: cascade.baselines(d).select("image_id", "x", "y", "w", "h"),
    "SELECT image_id, width - width//4 AS x, height - height//16 AS y, width//4 AS w, height//16 AS h FROM images UNION ALL SELECT image_id, width - width//16, height - height//4, width//16, height//4 FROM images",
)
_add(
    "label_positions", "detections",
    lambda d: d.select("image_id", "det_id", *(geo.label_position(geo.box(), p, F.lit(40), F.lit(12))[c].alias(f"{p}_{c}") for p in ("top", "top_left", "top_right") for c in "xy")),
    f"""{_ID} x AS top_x, CASE WHEN y > 30 THEN y-10 ELSE y+h+20 END AS top_y, x AS top_left_x, CASE WHEN y > 30 THEN y-10 ELSE y+17 END AS top_left_y, x+w-45 AS top_right_x, CASE WHEN y > 30 THEN y-10 ELSE y+17 END AS top_right_y FROM detections""",
)
_PAIRS_SQL = """, pairs AS (
    SELECT a.image_id, a.det_id AS id_a, b.det_id AS id_b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh, a.conf AS ca, b.conf AS cb,
           CAST(greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) AS DOUBLE) AS overlap, least(a.w*a.h, b.w*b.h) AS small
    FROM detections a JOIN detections b ON a.image_id = b.image_id AND a.det_id < b.det_id AND a.detector <> b.detector),
near AS (SELECT *, overlap / small AS ratio FROM pairs WHERE overlap / small >= 0.1)"""
_add("overlap_pairs", "detections", consensus.overlap_pairs, _PAIRS_SQL + "SELECT image_id, id_a, id_b, overlap, ratio FROM near")
_REGION_SQL = "least(ax, bx) AS x, least(ay, by_) AS y, greatest(ax+aw, bx+bw) - least(ax, bx) AS w, greatest(ay+ah, by_+bh) - least(ay, by_) AS h"
_add("pair_consensus", "detections", consensus.pair_regions, _PAIRS_SQL + f"SELECT image_id, id_a, id_b, {_REGION_SQL}, 1 - (1-ca)*(1-cb) AS confidence FROM near")
#: The greedy walk as lists: each seed in turn, its later neighbours in order, and after each of those all later boxes that a member
#: overlaps and whose detector is new. Members come as lists of one, which is what a fold over lists of lists takes.
_GREEDY_SQL = """, seq AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY detector_rank, det_id) AS i FROM detections),
met AS (
    SELECT a.image_id, a.i AS a, b.i AS b FROM seq a JOIN seq b ON a.image_id = b.image_id AND a.i <> b.i AND a.detector <> b.detector
    WHERE CAST(greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) AS DOUBLE) / least(a.w*a.h, b.w*b.h) >= 0.1),
near AS (SELECT image_id, a, list(b ORDER BY b) AS js FROM met GROUP BY 1, 2),
boxes AS (SELECT s.image_id, list(detector ORDER BY i) AS det, list(coalesce(js, []::BIGINT[]) ORDER BY i) AS near, count(*) AS n, list(i ORDER BY i) FILTER (WHERE js IS NOT NULL) AS seeds FROM seq s LEFT JOIN near n ON n.image_id = s.image_id AND a = i GROUP BY 1),
walk(image_id, k, used, members) AS (
    SELECT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM boxes UNION ALL
    SELECT image_id, k + 1, list_concat(used, grown), grown FROM (
        SELECT w.image_id, w.k, w.used, CASE WHEN list_contains(w.used, b.seeds[w.k + 1]) THEN []::BIGINT[] ELSE
            list_reduce(list_prepend([b.seeds[w.k + 1]], list_transform(list_filter(b.near[b.seeds[w.k + 1]], lambda j: j > b.seeds[w.k + 1] AND NOT list_contains(w.used, j)), lambda j: [j])),
                lambda got, one: CASE WHEN list_contains(got, one[1]) THEN got ELSE
                    list_reduce(list_prepend(list_append(got, one[1]), list_transform(range(one[1] + 1, b.n + 1), lambda m: [m])),
                        lambda now, m: CASE WHEN list_contains(now, m[1]) OR list_contains(w.used, m[1]) OR list_contains(list_transform(now, lambda q: b.det[q]), b.det[m[1]]) OR NOT list_has_any(b.near[m[1]], now) THEN now ELSE list_append(now, m[1]) END) END) END AS grown
        FROM walk w JOIN boxes b ON b.image_id = w.image_id AND w.k < len(b.seeds))), groups AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY k) - 1 AS region_id, members FROM walk WHERE len(members) >= 2),
each AS (SELECT image_id, region_id, unnest(members) AS i, generate_subscripts(members, 1) AS place FROM groups)
SELECT e.image_id, CAST(e.region_id AS INT) AS region_id, min(x) AS x, min(y) AS y, max(x+w) - min(x) AS w, max(y+h) - min(y) AS h, 1 - product(1 - conf) AS confidence, string_agg(detector, ',' ORDER BY place) AS detectors, CAST(count(*) AS INT) AS detector_count, string_agg(printf('%.2f', conf), ',' ORDER BY place) AS confidences
FROM each e JOIN seq s ON s.image_id = e.image_id AND s.i = e.i GROUP BY 1, 2"""


def _agreed(d: DataFrame) -> DataFrame:
    rows = consensus.consensus(d)
    shown = F.array_join(F.transform("original_confidences", lambda c: F.format_string("%.2f", c)), ",")
    return rows.select("image_id", "region_id", "x", "y", "w", "h", "confidence", F.array_join("detectors", ",").alias("detectors"), "detector_count", shown.alias("confidences"))


_add("consensus_greedy", "detections", _agreed, _GREEDY_SQL, recursive=True)
_add(
    "largest_line_merge", "detections", detections.merge_line,
    """, top AS (SELECT image_id, y + h // 2 AS m FROM detections QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w*h DESC, det_id) = 1)
    SELECT d.image_id, min(x) AS x, min(y) AS y, max(x+w) - min(x) AS w, max(y+h) - min(y) AS h, count(DISTINCT (x, y, w, h)) AS n_merged FROM detections d JOIN top t ON d.image_id = t.image_id AND m BETWEEN y AND y+h GROUP BY d.image_id""",
)
_add(
    "detector_summary", "detections",
    lambda d: detections.summarize(d.where("conf >= 0.5 AND detector <> 'doctr'"), d.sparkSession.createDataFrame(list(zip(detections.DETECTORS, range(3))), "detector string, detector_rank int")),
    """SELECT k.detector, k.detector_rank, count(d.conf) AS n, coalesce(avg(conf), 0) AS avg_conf, coalesce(max(conf), 0) AS max_conf, coalesce(min(conf), 0) AS min_conf
    FROM (VALUES ('east', 0), ('doctr', 1), ('easyocr', 2)) AS k(detector, detector_rank) LEFT JOIN detections d ON d.detector = k.detector AND conf >= 0.5 AND d.detector <> 'doctr' GROUP BY 1, 2""",
)
_add(
    "batch_rollup", "detections", detections.roll_up,
    """SELECT image_id, count(*) FILTER (WHERE detector='east') AS n_east, count(*) FILTER (WHERE detector='doctr') AS n_doctr, count(*) FILTER (WHERE detector='easyocr') AS n_easyocr, count(*) AS n_all, CAST(grouping(image_id) AS INT) AS is_total
    FROM detections GROUP BY ROLLUP (image_id)""",
)
_add(
    "ocr_coverage", "detections",
    lambda d: detections.coverage(d, d.select("image_id").distinct().select("image_id", F.lit(1).alias("region_id"), *(F.lit(v).cast("long").alias(c) for c, v in (("rx", 100), ("ry", 80), ("rw", 150), ("rh", 100))))),
    """, hit AS (SELECT *, x < 250 AND x+w > 100 AND y < 180 AND y+h > 80 AS m FROM detections)
    SELECT image_id, 1 AS region_id, count(*) FILTER (WHERE m) AS n_boxes, coalesce(max(conf) FILTER (WHERE m), 0) AS max_conf, coalesce(avg(conf) FILTER (WHERE m), 0) AS mean_conf,
    least(100.0, coalesce(sum(w*h) FILTER (WHERE m), 0) * 100.0 / 15000) AS coverage FROM hit GROUP BY image_id""",
)
_add(
    "east_decode", "cells",
    lambda d: detections.rescale(detections.decode_cells(d, 0.4), 320, _wide(), _high()).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "xywh"), F.sum("conf").alias("sum_conf")),
    f""", e AS (SELECT *, trunc(cx*4.0 + cos(angle)*d1 + sin(angle)*d2) AS ex, trunc(cy*4.0 - sin(angle)*d1 + cos(angle)*d2) AS ey FROM cells WHERE score >= 0.4),
    b AS (SELECT image_id, score, trunc(ex - (d1+d3)) AS x, trunc(ey - (d0+d2)) AS y, trunc(d1+d3) AS w, trunc(d0+d2) AS h FROM e)
    SELECT image_id, count(*) AS n, CAST(sum(trunc(x*({WIDTH}/320))) AS BIGINT) AS sum_x, CAST(sum(trunc(y*({HEIGHT}/320))) AS BIGINT) AS sum_y, CAST(sum(trunc(w*({WIDTH}/320))) AS BIGINT) AS sum_w,
    CAST(sum(trunc(h*({HEIGHT}/320))) AS BIGINT) AS sum_h, sum(score) AS sum_conf FROM b GROUP BY image_id""",
)
_add(
    "annotations", "detections", annotate.annotations,
    """SELECT image_id, det_id, 'box' AS kind, x, y, w, h, CASE detector WHEN 'east' THEN '#FF0000' WHEN 'doctr' THEN '#0000FF' ELSE '#00FF00' END AS outline, printf('%s %.1f%%', detector, conf * 100) AS label, x AS label_x,
    CASE WHEN y > 30 THEN y - 10 ELSE y + h + 20 END AS label_y FROM detections""",
)
_add(
    "nms", "detections", lambda d: detections.suppress(d, 0.4, 0.3).select("image_id", "det_id", "conf"),
    """, sized AS (SELECT image_id, det_id, conf, x, y, w + x AS w, h + y AS h, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS i FROM detections WHERE conf >= 0.3),
    met AS (SELECT a.image_id, b.i, a.i AS j, CAST(greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) AS DOUBLE) AS inter, a.w*a.h + b.w*b.h AS sum FROM sized a JOIN sized b ON a.image_id = b.image_id AND a.i < b.i),
    hits AS (SELECT image_id, i, list(j) AS js FROM met WHERE inter / (sum - inter) > 0.4 GROUP BY 1, 2),
    sizes AS (SELECT image_id, max(i) AS n FROM sized GROUP BY 1),
    walk(image_id, i, kept) AS (
        SELECT image_id, 0::BIGINT, []::BIGINT[] FROM sizes UNION ALL
        SELECT w.image_id, w.i + 1, CASE WHEN h.js IS NOT NULL AND list_has_any(h.js, w.kept) THEN w.kept ELSE list_append(w.kept, w.i + 1) END
        FROM walk w JOIN sizes s ON s.image_id = w.image_id AND w.i < s.n LEFT JOIN hits h ON h.image_id = w.image_id AND h.i = w.i + 1)
    SELECT d.image_id, det_id, conf FROM sized d JOIN sizes s ON s.image_id = d.image_id JOIN walk w ON w.image_id = d.image_id AND w.i = s.n WHERE list_contains(w.kept, d.i)""", recursive=True,
)

# --- quantisation and scores -----------------------------------------------------------------------------
def _lloyd_sql(colors_: str, k: int, rounds: int, keys: str = "image_id", name: str = "", order: str = "n DESC, b, g, r") -> str:
    """CTEs a{name}0 .. a{name}{rounds}: (keys, b, g, r, n, k) of ``colors_`` after so many updates; first centres come by ``order``."""
    c, a, on = f"c{name}", f"a{name}", " AND ".join(f"o.{x.strip()} = c.{x.strip()}" for x in keys.split(","))
    own = ", ".join(f"o.{x.strip()}" for x in keys.split(","))
    out = f""", {c}0 AS MATERIALIZED (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS k, CAST(b AS DOUBLE) AS cb, CAST(g AS DOUBLE) AS cg, CAST(r AS DOUBLE) AS cr FROM {colors_}
           QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) <= {k})"""
    for t in range(rounds + 1):
        out += f""", {a}{t} AS MATERIALIZED (SELECT {own}, b, g, r, n, min({{'d': (b-cb)*(b-cb) + (g-cg)*(g-cg) + (r-cr)*(r-cr), 'k': k}}).k AS k FROM {colors_} o JOIN {c}{t} c ON {on} GROUP BY {own}, b, g, r, n)"""
        if t < rounds:
            out += f", {c}{t + 1} AS MATERIALIZED (SELECT {keys}, k, sum(b*n)/sum(n) AS cb, sum(g*n)/sum(n) AS cg, sum(r*n)/sum(n) AS cr FROM {a}{t} GROUP BY {keys}, k)"
    return out


_COLORS_SQL = ", colors AS MATERIALIZED (SELECT image_id, b, g, r, count(*) AS n FROM pixels GROUP BY image_id, b, g, r)"
_CENTRES = "SELECT image_id, CAST(k AS INT) AS k, sum(b*n)/sum(n) AS b, sum(g*n)/sum(n) AS g, sum(r*n)/sum(n) AS r, CAST(sum(n) AS BIGINT) AS n FROM {} GROUP BY image_id, k"
_add("kmeans_lloyd", "pixels", lambda d: quantize.centres_of(quantize.lloyd(colors.distinct_colors(d), 4, 3, together=True)), _COLORS_SQL + _lloyd_sql("colors", 4, 3) + _CENTRES.format("a3"))
_add("kmeans_rgb", "pixels", lambda d: quantize.centres_of(quantize.lloyd_by_group(colors.distinct_colors(d), tfidf.CLUSTERS, tfidf.ROUNDS, together=True)), _COLORS_SQL + _lloyd_sql("colors", tfidf.CLUSTERS, tfidf.ROUNDS) + _CENTRES.format(f"a{tfidf.ROUNDS}"))


def _restarted(d: DataFrame) -> DataFrame:
    """The clusters of the most compact of ten starts, and how compact they are."""
    assigned = quantize.lloyd_by_group(colors.distinct_colors(d), tfidf.CLUSTERS, tfidf.ROUNDS, starts=quantize.STARTS, together=True)
    # By a window and not by a join with its own means, for which all starts would run twice.
    own = Window.partitionBy("image_id", "k")
    rows = assigned.withColumns({"pixels": F.sum("n").over(own), **{f"c{c}": F.sum(F.col(c) * F.col("n")).over(own) / F.sum("n").over(own) for c in "bgr"}})
    off = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "bgr"), F.lit(0.0))
    return rows.groupBy("image_id", "k", "pixels").agg(F.sum(F.col("n") * off).alias("spread"))


_STARTS_SQL = (
    f", starts(start, f) AS (VALUES {', '.join(f'({s}, {pow(quantize.MULTIPLIER, s, quantize.PRIME) if s else 0})' for s in range(quantize.STARTS))})"
    f", drawn AS MATERIALIZED (SELECT c.*, start, CASE WHEN start = 0 THEN -n ELSE (b * 65536 + g * 256 + r) * f % {quantize.PRIME} END AS draw FROM colors c, starts)"
)
_add(
    "kmeans_restarts", "pixels", _restarted,
    _COLORS_SQL + _STARTS_SQL + _lloyd_sql("drawn", tfidf.CLUSTERS, tfidf.ROUNDS, "image_id, start", "s", "draw, n DESC, b, g, r")
    + f""", means AS (SELECT *, sum(b*n) OVER w / sum(n) OVER w AS cb, sum(g*n) OVER w / sum(n) OVER w AS cg, sum(r*n) OVER w / sum(n) OVER w AS cr FROM as{tfidf.ROUNDS} WINDOW w AS (PARTITION BY image_id, start, k)),
    spreads AS MATERIALIZED (SELECT image_id, start, k, CAST(sum(n) AS BIGINT) AS pixels, sum(n * ((b-cb)*(b-cb) + (g-cg)*(g-cg) + (r-cr)*(r-cr))) AS spread FROM means GROUP BY 1, 2, 3),
    best AS (SELECT image_id, start FROM (SELECT image_id, start, floor(sum(spread) * {quantize.COARSE!r}) AS c FROM spreads GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY c, start) = 1)
    SELECT image_id, CAST(k AS INT) AS k, pixels, spread FROM spreads JOIN best USING (image_id, start)""",
)
_add("find_text_colors", "pixels", lambda d: search.find_text_colors(d, together=True), None)


def _evenness(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """A stand-in for the detector: how evenly a test image is split into black and gray."""
    share = np.count_nonzero(v == 0) / len(v)
    return 4 * share * (1 - share)


def _searched(d: DataFrame) -> DataFrame:
    return search.exhaustive_search(d, None, detector=_evenness, together=True)


_add("exhaustive_search", "pixels", _searched, None)
_add("darkest_color", "pixels", search.darkest, "SELECT image_id, b, g, r FROM pixels QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY b + g + r, y, x) = 1")
_add("kmeans_lab", "pixels", lambda d: quantize.centres_of(quantize.lloyd_lab(colors.distinct_colors(d), search.CLUSTERS, search.ROUNDS, together=True)), None)


def _near(d: DataFrame) -> DataFrame:
    rows = tfidf.region_pixels(d, _regions(d))
    return rows.withColumn("k", quantize.grid_cluster(*_bgr()))


_NEAR_SQL = """, near AS (
    SELECT image_id, 1 AS region_id, x, y, b, g, r, inbox AS in_doc, CAST((floor(b/64)*4 + floor(g/64))*4 + floor(r/64) AS INT) AS k FROM (
        SELECT *, greatest(0, least(bx + bw//2 - nw//2, width - nw)) AS ex, greatest(0, least(by_ + bh//2 - nh//2, height - nh)) AS ey
        FROM (SELECT *, CAST(trunc(bw*1.414) AS BIGINT) AS nw, CAST(trunc(bh*1.414) AS BIGINT) AS nh FROM pixels))
    WHERE x >= ex AND x < ex + least(nw, width - ex) AND y >= ey AND y < ey + least(nh, height - ey)),
counts AS (SELECT g.image_id, g.region_id, CAST(g.k AS INT) AS k, count(*) FILTER (WHERE in_doc) AS n_doc, count(*) FILTER (WHERE NOT in_doc) AS n_corpus
    FROM (SELECT DISTINCT image_id, region_id, range AS k FROM near, range(64)) g LEFT JOIN near n ON g.image_id = n.image_id AND g.region_id = n.region_id AND g.k = n.k GROUP BY ALL),
scored AS (SELECT *, n_doc / sum(n_doc) OVER (PARTITION BY image_id) AS tf, ln(sum(n_corpus) OVER (PARTITION BY image_id) / (n_corpus + 1)) AS idf FROM counts),
scores AS (
    SELECT *, tf*idf AS score, CAST(CASE WHEN max(tf*idf) OVER w > min(tf*idf) OVER w THEN floor((tf*idf - min(tf*idf) OVER w) / (max(tf*idf) OVER w - min(tf*idf) OVER w) * 255) ELSE 128 END AS INT) AS norm
    FROM scored WINDOW w AS (PARTITION BY image_id))"""
#: Cells of the fixed grid that stands in for clusters.
GRID = 64


def _scores(near: DataFrame) -> DataFrame:
    return tfidf.cluster_scores(near, clusters=GRID)


_SCORE_COLUMNS = "image_id, region_id, k, n_doc, n_corpus, tf, idf, score, norm"
_add("tfidf_scores", "pixels", lambda d: _scores(_near(d)).select(*_SCORE_COLUMNS.split(", ")), _NEAR_SQL + f"SELECT {_SCORE_COLUMNS} FROM scores")


def _top(d: DataFrame) -> DataFrame:
    near = _near(d)
    centres = near.groupBy("image_id", "region_id", "k").agg(F.avg("b").alias("b"), F.avg("g").alias("g"), F.avg("r").alias("r"))
    return tfidf.top_colors(_scores(near), centres)


_add(
    "tfidf_top_colors", "pixels", _top,
    _NEAR_SQL + """, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, k) AS INT) AS rank FROM scores WHERE score > 0),
    c AS (SELECT image_id, k, CAST(trunc(avg(b)) AS INT) AS b, CAST(trunc(avg(g)) AS INT) AS g, CAST(trunc(avg(r)) AS INT) AS r FROM near GROUP BY image_id, k)
    SELECT image_id, region_id, rank, k, score, printf('#%02X%02X%02X', r, g, b) AS hex FROM ranked JOIN c USING (image_id, k) WHERE rank <= 2""",
)


def _map(d: DataFrame, target: color.BGR | None = None) -> DataFrame:
    near = _near(d)
    keys = ["image_id", "region_id"]
    forced = None
    if target is not None:
        centres = near.groupBy(*keys, "k").agg(F.avg("b").alias("b"), F.avg("g").alias("g"), F.avg("r").alias("r"))
        forced = quantize.nearest_cluster(centres, target, keys)
    return tfidf.score_map(near, _scores(near), target=forced)


_add("tfidf_mask", "pixels", _map, _NEAR_SQL + "SELECT n.image_id, n.region_id, x, y, norm, CASE WHEN norm >= 188 THEN 255 ELSE 0 END AS v FROM near n JOIN scores s USING (image_id, k) WHERE in_doc")
_add(
    "tfidf_mask_target", "pixels", lambda d: _map(d, (130, 120, 140)),
    _NEAR_SQL + """, c AS (SELECT image_id, k FROM near GROUP BY image_id, k
        QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY (avg(b)-130)*(avg(b)-130) + (avg(g)-120)*(avg(g)-120) + (avg(r)-140)*(avg(r)-140), k) = 1)
    SELECT n.image_id, n.region_id, x, y, norm, CASE WHEN norm >= 188 OR c.k IS NOT NULL THEN 255 ELSE 0 END AS v FROM near n JOIN scores s USING (image_id, k) LEFT JOIN c USING (image_id, k) WHERE in_doc""",
)


def tfidf_mask_size(d: DataFrame) -> DataFrame:
    """The flagship: per image, the pixels of its region that stand out from the surroundings."""
    return _map(d).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("v") == 255).alias("n_mask"))


_add("tfidf_mask_size", "pixels", tfidf_mask_size, _NEAR_SQL + "SELECT n.image_id, count(*) AS n_pixels, count(*) FILTER (WHERE norm >= 188) AS n_mask FROM near n JOIN scores s USING (image_id, k) WHERE in_doc GROUP BY n.image_id")
_add("score_histogram", "pixels", lambda d: report.score_histogram(_scores(_near(d))), _NEAR_SQL + """, s AS (SELECT min(score) AS lo, max(score) AS hi FROM scores),
    c AS (SELECT CAST(least(floor((score - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM scores, s GROUP BY 1), a AS (SELECT CAST(range AS INT) AS bin, coalesce(n, 0) AS n FROM range(20) LEFT JOIN c ON bin = range)
    SELECT bin, n, repeat('#', CAST(floor(n / greatest((SELECT max(n) FROM a), 1) * 50) AS INT)) AS bar FROM a""")
_add("score_percentiles", "pixels", lambda d: report.score_percentiles(_scores(_near(d))), _NEAR_SQL + "SELECT range * 5.0 AS percent, (SELECT quantile_cont(score, list_transform(range(21), lambda i: i / 20)) FROM scores)[range + 1] AS value FROM range(21)")
_add("score_moments", "pixels", lambda d: report.score_moments(_scores(_near(d))), _NEAR_SQL + "SELECT count(score) AS n, avg(score) AS mean, median(score) AS median, stddev_pop(score) AS std, min(score) AS low, max(score) AS high FROM scores")
_add("threshold_sweep", "pixels", lambda d: report.threshold_sweep(_scores(_near(d))), _NEAR_SQL + "SELECT t AS threshold, avg(CASE WHEN norm >= t THEN 1 ELSE 0 END) * 100 AS percent FROM scores, (VALUES (64),(96),(128),(160),(188),(192),(224)) AS q(t) GROUP BY t")

# --- masks ----------------------------------------------------------------------------------------------
_add(
    "mask_or_combine", "pixels",
    lambda d: inpaint.combine_masks(_mask(d).unionByName(d.select("image_id", "x", "y", F.when(F.col("b") >= 180, 255).otherwise(0).cast("int").alias("v")))).groupBy("image_id").agg(F.count_if(F.col("v") > 0).alias("n_lit"), F.count(F.lit(1)).alias("n")),
    "SELECT image_id, count(*) FILTER (WHERE is_text OR b >= 180) AS n_lit, count(*) AS n FROM pixels GROUP BY image_id",
)


def _rectangle_sql(source: str, x: int, y: int, grow: bool, keys: str = "image_id") -> str:
    f = "max" if grow else "min"
    rows = f"SELECT {keys}, x, y, {f}(v) OVER (PARTITION BY {keys}, y ORDER BY x RANGE BETWEEN {x} PRECEDING AND {x} FOLLOWING) AS v FROM {source}"
    return f"SELECT {keys}, x, y, {f}(v) OVER (PARTITION BY {keys}, x ORDER BY y RANGE BETWEEN {y} PRECEDING AND {y} FOLLOWING) AS v FROM ({rows})"


def _ellipse_sql(source: str, size: int, grow: bool, keys: str = "image_id") -> str:
    """Each row of the ellipse by itself: its width along the rows, then the greatest (or least) of the rows above and below."""
    f, pick = ("max", "greatest") if grow else ("min", "least")
    half = morphology.half_widths(size)
    rows = ", ".join(f"{f}(v) OVER (PARTITION BY {keys}, y ORDER BY x RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS w{k}" for k, w in enumerate(half))
    at = lambda k, side: f"{f}(w{k}) OVER (PARTITION BY {keys}, x ORDER BY y RANGE BETWEEN {k} {side} AND {k} {side})"
    own = ["w0", *(f"coalesce({at(k, side)}, w0)" for k in range(1, len(half)) for side in ("PRECEDING", "FOLLOWING"))]
    return f"SELECT {keys}, x, y, {pick}({', '.join(own)}) AS v FROM (SELECT *, {rows} FROM {source})"


def _blur_sql(source: str, keys: str = "image_id") -> str:
    kernel = "(VALUES " + ",".join(f"({k - 4}, {w!r}::DOUBLE)" for k, w in enumerate(morphology.weights(9))) + ") AS q(d, f)"
    mirror = lambda c: f"greatest(lo, least(hi, CASE WHEN {c}+d < lo THEN 2*lo-({c}+d) WHEN {c}+d > hi THEN 2*hi-({c}+d) ELSE {c}+d END))"
    same = " AND ".join(f"m.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    wide = lambda name, c, other: f"(SELECT *, {mirror(c)} AS at FROM (SELECT *, min({c}) OVER (PARTITION BY {keys}, {other}) AS lo, max({c}) OVER (PARTITION BY {keys}, {other}) AS hi FROM {name}), {kernel})"
    return f"""h AS (SELECT {own}, p.x, p.y, sum(f * m.v) AS s FROM {wide(source, "x", "y")} p JOIN {source} m ON {same} AND m.y = p.y AND m.x = p.at GROUP BY ALL),
    b AS (SELECT {own}, p.x, p.y, sum(f * m.s) AS s FROM {wide("h", "y", "x")} p JOIN h m ON {same} AND m.x = p.x AND m.y = p.at GROUP BY ALL)
    SELECT {keys}, x, y, CASE WHEN round(s, 6) >= 127.5 THEN 255 ELSE 0 END AS v FROM b"""


def _clean_sql(source: str, keys: str = "image_id") -> str:
    """CTEs and SELECT of ``source`` closed by a rectangle of 11, grown by an ellipse of 13 and smoothed."""
    return f"grown AS ({_rectangle_sql(source, 5, 5, True, keys)}), closed AS ({_rectangle_sql('grown', 5, 5, False, keys)}), fat AS MATERIALIZED ({_ellipse_sql('closed', 13, True, keys)}), {_blur_sql('fat', keys)}"


_add("morph_close", "pixels", lambda d: morphology.close(_mask(d), together=False), f"{MASK_SQL}, grown AS ({_rectangle_sql('mask', 5, 5, True)}) {_rectangle_sql('grown', 5, 5, False)}")
_add("morph_expand", "pixels", lambda d: morphology.expand(_mask(d), 2, together=False), f"{MASK_SQL} {_rectangle_sql('mask', 2, 2, True)}")
_add("morph_dilate_ellipse", "pixels", lambda d: morphology.ellipse(_mask(d), 13), f"{MASK_SQL} {_ellipse_sql('mask', 13, True)}")
_add("morph_smooth", "pixels", lambda d: morphology.smooth(_mask(d), 9, together=False), f"{MASK_SQL}, {_blur_sql('mask')}")
_add("morph_clean", "pixels", lambda d: morphology.clean(_mask(d), together=False), f"{MASK_SQL}, {_clean_sql('mask')}")
_add("morph_clean_tiles", "pixels", lambda d, tasks: tiles.by_tiles(_mask(d), tiles.CLEAN, tile=32, tasks=tasks), f"{MASK_SQL}, {_clean_sql('mask')}", sized=True)


def _opened_sql() -> str:
    out, last = f"{MASK_SQL}, m0 AS ({_rectangle_sql('mask', 3, 3, True)})", "m0"
    for t in range(3):
        for k, (size, grow) in enumerate(((5, False), (5, True), (3, False), (2, True))):
            out += f", m{t}{k} AS MATERIALIZED ({_ellipse_sql(last, size, grow)})"
            last = f"m{t}{k}"
    return out + f" SELECT * FROM {last}"


_add("morph_open_erode_dilate", "pixels", lambda d: morphology.open_erode_dilate(morphology.expand(_mask(d), 3, together=False), together=False), _opened_sql())
_PAIR = "image_id, region_id"
_TEXT_SQL = (
    _NEAR_SQL[: _NEAR_SQL.index("counts AS")].replace("near AS (", "around AS MATERIALIZED (").rstrip().rstrip(",")
    + f", colors AS MATERIALIZED (SELECT {_PAIR}, b, g, r, count(*) AS n FROM around GROUP BY ALL)"
    + _lloyd_sql("colors", tfidf.CLUSTERS, tfidf.ROUNDS, _PAIR)
    + f", near AS MATERIALIZED (SELECT w.* EXCLUDE (k), a.k FROM around w JOIN a{tfidf.ROUNDS} a USING ({_PAIR}, b, g, r)), "
    + _NEAR_SQL[_NEAR_SQL.index("counts AS"):].replace("range(64)", f"range({tfidf.CLUSTERS})")
    + ", raw AS MATERIALIZED (SELECT n.image_id, n.region_id, x, y, CASE WHEN norm >= 188 THEN 255 ELSE 0 END AS v FROM near n JOIN scores s USING (image_id, region_id, k) WHERE in_doc)"
)
_add("text_mask_raw", "pixels", lambda d: tfidf.text_mask(d, _regions(d), clean=False), _TEXT_SQL + "SELECT * FROM raw")
_add("text_mask", "pixels", lambda d: tfidf.text_mask(d, _regions(d)), _TEXT_SQL + ", " + _clean_sql("raw", _PAIR))
_add(
    "inpaint_subregion", "pixels", lambda d: inpaint.subregion(_mask(d), _regions(d), context=8),
    """, m AS (SELECT image_id, width, height, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pixels WHERE is_text GROUP BY ALL)
    SELECT image_id, greatest(0, x0-8) AS x1, greatest(0, y0-8) AS y1, least(width, x1+8) AS x2, least(height, y1+8) AS y2 FROM m""",
)
_add(
    "mask_coverage", "pixels", lambda d: inpaint.coverage(_mask(d), _regions(d)),
    """SELECT image_id, count(*) AS n, (max(x)-min(x))*(max(y)-min(y)) AS area, count(*)*100.0 / ((max(x)-min(x))*(max(y)-min(y))) AS density, count(*)*100.0 / (width*height) AS share
    FROM pixels WHERE is_text GROUP BY image_id, width, height""",
)
_add("telea_fill", "pixels", lambda d: inpaint.telea_by_hole(d, _mask(d)), None)

# --- components and lines --------------------------------------------------------------------------------
_LABEL_SQL = """, lit AS (SELECT image_id, x, y, y*64 + x AS p FROM pixels WHERE is_text),
reached(image_id, x, y, p) AS (
    SELECT image_id, x, y, p FROM lit UNION
    SELECT l.image_id, l.x, l.y, r.p FROM reached r JOIN lit l ON l.image_id = r.image_id AND abs(l.x - r.x) <= 1 AND abs(l.y - r.y) <= 1),
lowest AS (SELECT image_id, x, y, min(p) AS p FROM reached GROUP BY 1, 2, 3),
labels AS (SELECT image_id, x, y, dense_rank() OVER (PARTITION BY image_id ORDER BY p) AS label FROM lowest),
feats AS (SELECT image_id, label, CAST(count(*) AS DOUBLE) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, (max(x)-min(x)+1) / (max(y)-min(y)+1) AS aspect FROM labels GROUP BY 1, 2)"""
_add("components", "pixels", lambda d: components.features(components.label(_mask(d))), _LABEL_SQL + "SELECT * FROM feats", recursive=True)
_add("components_tiles", "pixels", lambda d: components.features(tiles.label(_mask(d), tile=16)), _LABEL_SQL + "SELECT * FROM feats", recursive=True)
_add("filter_components", "pixels", lambda d: components.plausible(components.features(components.label(_mask(d))), area=(8, 5000), aspect=(0.4, 10)), _LABEL_SQL + "SELECT * FROM feats WHERE area BETWEEN 8 AND 5000 AND aspect BETWEEN 0.4 AND 10", recursive=True)
_add(
    "anchor_components", "pixels", lambda d: components.anchored(components.label(_mask(d)), _regions(d).select("image_id", "y", (F.col("h") / 2).cast("long").alias("h"))).select("image_id", "x", "y", "label"),
    _LABEL_SQL + """, band AS (SELECT DISTINCT image_id, by_ + 4 AS c FROM pixels)
    SELECT image_id, x, y, label FROM labels l WHERE EXISTS (SELECT 1 FROM labels t JOIN band USING (image_id) WHERE t.image_id = l.image_id AND t.label = l.label AND abs(t.y - c) <= 4)""", recursive=True,
)
_add("convexity", "pixels", lambda d, tasks: components.convexity(components.label(morphology.ellipse(_mask(d), 5), together=True), tasks=tasks), None, sized=True)
_FIT_SQL = """, fit AS (SELECT image_id, count(*) AS n, CASE WHEN count(*) < 2 OR min(cx) = max(cx) THEN 0 ELSE regr_slope(cy, cx) END AS slope, CASE WHEN count(*) < 2 THEN 0 WHEN min(cx) = max(cx) THEN avg(cy) ELSE regr_intercept(cy, cx) END AS intercept,
    CASE WHEN count(*) < 2 OR min(cx) = max(cx) THEN 0 WHEN min(cy) = max(cy) THEN 1 ELSE regr_r2(cy, cx) END AS r_squared FROM components GROUP BY image_id),
gaps AS (SELECT image_id, count(gap) AS n_gaps, stddev_pop(gap) / avg(gap) AS cv FROM (SELECT image_id, cx - lag(cx) OVER (PARTITION BY image_id ORDER BY cx) AS gap FROM components) WHERE gap IS NOT NULL GROUP BY image_id)"""
_add("line_regression", "components", textlike.line_fit, _FIT_SQL + "SELECT * FROM fit")
_add("spacing_cv", "components", lambda d: textlike.spacings(d).groupBy("image_id").agg(F.count("gap").alias("n_gaps"), textlike.variation("gap").alias("cv")), _FIT_SQL + "SELECT * FROM gaps")
_add("size_cv", "components", lambda d: d.groupBy("image_id").agg(textlike.variation("area").alias("cv")), "SELECT image_id, stddev_pop(area) / avg(area) AS cv FROM components GROUP BY image_id")
_add(
    "text_likelihood", "components", textlike.likelihood,
    _FIT_SQL + """, sizes AS (SELECT c.image_id, stddev_pop(area) / avg(area) AS cv, avg(abs(cy - (slope*cx + intercept))) AS off FROM components c JOIN fit f ON c.image_id = f.image_id GROUP BY c.image_id),
    parts AS (SELECT f.image_id, n, r_squared / (1 + off) AS colinearity, greatest(0, least(1, (0.6 - s.cv) / 0.6)) AS size_uniformity, CASE WHEN n_gaps >= 2 THEN greatest(0, least(1, (0.5 - g.cv) / 0.5)) ELSE 0.5 END AS spacing_uniformity,
        0.5 AS convexity, CASE WHEN n >= 3 THEN least(1, 0.5 + 0.1*n) ELSE 1 END AS count_score FROM fit f JOIN sizes s ON f.image_id = s.image_id LEFT JOIN gaps g ON f.image_id = g.image_id WHERE n >= 2)
    SELECT *, 0.3*colinearity + 0.25*size_uniformity + 0.25*spacing_uniformity + 0.15*convexity + 0.05*count_score AS likelihood FROM parts""",
)
_add(
    "tile_density", "pixels", lambda d: textlike.tile_density(d.withColumn("edge", F.when(F.col("is_text"), 255).otherwise(0)).withColumn("k", (F.col("b") % 2).cast("int")), 10, clusters=2),
    """SELECT image_id, y//10 AS ty, x//10 AS tx, avg(CASE WHEN is_text THEN 1 ELSE 0 END) AS edge_density, avg(CASE WHEN b % 2 = 0 THEN 1 ELSE 0 END) AS share_0, avg(CASE WHEN b % 2 = 1 THEN 1 ELSE 0 END) AS share_1 FROM pixels WHERE x < 60 AND y < 40 GROUP BY 1, 2, 3""",
)
_add("edgy_colors", "pixels", lambda d, tasks: textlike.edgy_colors(d, together=True, tasks=tasks), None, sized=True)

# --- filters ----------------------------------------------------------------------------------------------
#: Images of 64 by 48 have 16 tiles of 16 by 12, of which none is filled up; at most one pixel of a tile counts for a value.
_CONTRAST_SQL = """, gray AS MATERIALIZED (SELECT image_id, x, y, CAST(floor((b*9798 + g*19235 + r*3735 + 16384) / 32768) AS BIGINT) AS v FROM pixels),
hist AS (SELECT image_id, y // 12 AS ti, x // 16 AS tj, v, count(*) AS n FROM gray GROUP BY ALL),
bins AS (SELECT image_id, ti, tj, v, coalesce(n, 0) AS n FROM (SELECT image_id, a.range AS ti, b.range AS tj, c.range AS v FROM (SELECT DISTINCT image_id FROM gray), range(4) a, range(4) b, range(256) c) LEFT JOIN hist USING (image_id, ti, tj, v)),
cut AS (SELECT *, least(n, 1) AS c, CAST(sum(greatest(n - 1, 0)) OVER (PARTITION BY image_id, ti, tj) AS BIGINT) AS spare FROM bins),
shared AS (SELECT *, greatest(1, 256 // greatest(spare % 256, 1)) AS step FROM cut),
maps AS MATERIALIZED (
    SELECT image_id, ti, tj, v, least(255, round_even(CAST(sum(c + spare // 256 + CASE WHEN v % step = 0 AND v // step < spare % 256 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, ti, tj ORDER BY v ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 255 / 192, 0)) AS m
    FROM shared),
placed AS (SELECT *, CAST(floor(fy) AS BIGINT) AS y0, CAST(floor(fx) AS BIGINT) AS x0, fy - floor(fy) AS wy, fx - floor(fx) AS wx FROM (SELECT *, y / 12 - 0.5::DOUBLE AS fy, x / 16 - 0.5::DOUBLE AS fx FROM gray)),
even AS MATERIALIZED (
    SELECT p.image_id, x, y, CAST(least(255, greatest(0, round_even((a.m * (1 - wx) + b.m * wx) * (1 - wy) + (c.m * (1 - wx) + d.m * wx) * wy, 0))) AS BIGINT) AS v FROM placed p
    JOIN maps a ON a.image_id = p.image_id AND a.v = p.v AND a.ti = greatest(0, least(3, y0)) AND a.tj = greatest(0, least(3, x0))
    JOIN maps b ON b.image_id = p.image_id AND b.v = p.v AND b.ti = greatest(0, least(3, y0)) AND b.tj = greatest(0, least(3, x0 + 1))
    JOIN maps c ON c.image_id = p.image_id AND c.v = p.v AND c.ti = greatest(0, least(3, y0 + 1)) AND c.tj = greatest(0, least(3, x0))
    JOIN maps d ON d.image_id = p.image_id AND d.v = p.v AND d.ti = greatest(0, least(3, y0 + 1)) AND d.tj = greatest(0, least(3, x0 + 1)))"""
_add("contrast", "pixels", lambda d: filters.contrast_table(filters.gray_values(d)), _CONTRAST_SQL + " SELECT * FROM even")
_add(
    "prepare_images", "pixels", filters.prepare,
    _CONTRAST_SQL + """, disc AS (SELECT a.range AS dy, b.range AS dx FROM range(-4, 5) a, range(-4, 5) b WHERE a.range * a.range + b.range * b.range <= 16),
    seen AS (SELECT e.*, dx*dx + dy*dy AS far, CASE WHEN x+dx < 0 THEN -(x+dx) WHEN x+dx > 63 THEN 126-(x+dx) ELSE x+dx END AS nx, CASE WHEN y+dy < 0 THEN -(y+dy) WHEN y+dy > 47 THEN 94-(y+dy) ELSE y+dy END AS ny FROM even e, disc),
    near AS (SELECT s.image_id, s.x, s.y, n.v, exp(-s.far / 11250.0 - (n.v - s.v) * (n.v - s.v) / 20000.0) AS k FROM seen s JOIN even n ON n.image_id = s.image_id AND n.x = nx AND n.y = ny),
    soft AS (SELECT image_id, x, y, CAST(round_even(round(sum(k * v) / sum(k), 9), 0) AS BIGINT) AS p FROM near GROUP BY 1, 2, 3)
    SELECT image_id, x, y, p AS b, p AS g, p AS r FROM soft""",
)


def _edges_sql(low: int, high: int) -> str:
    """Each step as its windows have it, and strong ridges followed over weak ones."""
    side = lambda c, w, none: (f"coalesce(lag({c}) OVER {w}, {none})", f"coalesce(lead({c}) OVER {w}, {none})")
    up, down = side("v", "d", "v")
    left, right = side("v", "a", "v")
    s_left, s_right = side("s", "a", "s")
    t_up, t_down = side("t", "d", "t")
    windows = "WINDOW a AS (PARTITION BY image_id, y ORDER BY x), d AS (PARTITION BY image_id, x ORDER BY y)"
    around = ", ".join(f"{x} AS {c}{e}" for c in "umd" for e, x in zip("lr", side(c, "a", 0)))
    return f""", gray AS (SELECT image_id, x, y, CAST(floor((b*3735 + g*19235 + r*9798 + 16384) / 32768) AS DOUBLE) AS v FROM pixels),
    smooth AS (SELECT *, {up} + 2*v + {down} AS s, {left} + 2*v + {right} AS t FROM gray {windows}),
    sobel AS (SELECT *, {s_right} - {s_left} AS gx, {t_down} - {t_up} AS gy FROM smooth {windows}),
    size AS (SELECT *, abs(gx) + abs(gy) AS m FROM sobel),
    high AS (SELECT *, {side("m", "d", 0)[0]} AS u, {side("m", "d", 0)[1]} AS d FROM size {windows}),
    beside AS (SELECT *, {around} FROM high {windows}),
    turned AS (SELECT *, CAST(round_even((CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 WHEN degrees(atan2(gy, gx)) >= 180 THEN degrees(atan2(gy, gx)) - 180 ELSE degrees(atan2(gy, gx)) END) / 45, 0) AS INT) % 4 AS sector FROM beside),
    weak AS MATERIALIZED (SELECT image_id, x, y, m FROM turned WHERE m > {low} AND m >= CASE sector WHEN 0 THEN mr WHEN 1 THEN dr WHEN 2 THEN d ELSE dl END AND m > CASE sector WHEN 0 THEN ml WHEN 1 THEN ul WHEN 2 THEN u ELSE ur END),
    lit(image_id, x, y) AS (SELECT image_id, x, y FROM weak WHERE m > {high} UNION SELECT w.image_id, w.x, w.y FROM lit l JOIN weak w ON w.image_id = l.image_id AND abs(w.x - l.x) <= 1 AND abs(w.y - l.y) <= 1)
    SELECT image_id, p.x, p.y, CASE WHEN l.x IS NULL THEN 0 ELSE 255 END AS edge FROM pixels p LEFT JOIN lit l USING (image_id, x, y)"""


_add("edges", "pixels", lambda d, tasks: filters.edges_table(filters.gray_values(d, False), tasks=tasks), _edges_sql(50, 150), recursive=True, sized=True)


def _listed(d: DataFrame) -> DataFrame:
    """Pixels against some 10,000 colours an image, three steps wide."""
    of = lambda one, two, f, o: (F.col(one) * f + F.col(two) + o) % 256
    rows = d.select("image_id", "b", "g", "r", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("o"))
    return colors.mask_near_table(d, rows.select("image_id", of("b", "g", 2, F.col("o") * 37).alias("b"), of("g", "r", 3, F.col("o") * 91).alias("g"), of("r", "b", 5, F.col("o") * 53).alias("r")), 3)


_LISTED_SQL = ", listed AS MATERIALIZED (SELECT DISTINCT image_id, (b*2 + g + o.range*37) % 256 AS b, (g*3 + r + o.range*91) % 256 AS g, (r*5 + b + o.range*53) % 256 AS r FROM pixels, range(4) o)"
_add(
    "mask_color_table", "pixels", _listed,
    _LISTED_SQL + """, wide AS (SELECT l.*, b + o.range AS at FROM listed l, range(-3, 4) o),
    hits AS (SELECT DISTINCT p.image_id, p.b, p.g, p.r FROM (SELECT DISTINCT image_id, b, g, r FROM pixels) p JOIN wide w ON w.image_id = p.image_id AND w.at = p.b AND abs(w.g - p.g) <= 3 AND abs(w.r - p.r) <= 3)
    SELECT p.image_id, x, y, CASE WHEN h.b IS NULL THEN 0 ELSE 255 END AS v FROM pixels p LEFT JOIN hits h USING (image_id, b, g, r)""",
)

# --- reports and plans -----------------------------------------------------------------------------------
_add(
    "timing_report", "timings", report.timing_stats,
    " UNION ALL ".join(f"SELECT '{s}' AS stage, count({s}) AS n, coalesce(median({s}), 0) AS median, coalesce(avg({s}), 0) AS mean FROM timings" for s in ("detection_time", "color_time", "inpaint_time")),
)
_add("consensus_stats", "timings", report.consensus_stats, "SELECT CAST(sum(consensus_boxes_count) AS BIGINT) AS n_boxes, count(*) FILTER (WHERE consensus_boxes_count > 0) AS n_images, avg(CASE WHEN consensus_boxes_count > 0 THEN 1 ELSE 0 END) * 100 AS percent FROM timings")
_add(
    "failover_counts", "timings", report.failover_counts,
    "SELECT f AS failover_type, m AS marker, count(image_id) AS n FROM (VALUES ('none',''),('rotation','R'),('target_color','T'),('gray_enhancement','G'),('white_enhancement','W'),('watermark','B')) AS k(f, m) LEFT JOIN timings ON f = failover_type GROUP BY 1, 2",
)


def _cascade(d: DataFrame) -> DataFrame:
    seen = d.select("image_id").distinct()
    sized = seen.select("image_id", F.lit(WIDTH).cast("long").alias("width"), F.lit(HEIGHT).cast("long").alias("height"))
    pairs = cascade.padded(consensus.pair_regions(d.where("conf >= 0.75")).select("image_id", "x", "y", "w", "h"), sized)
    turned = d.where("conf >= 0.9").withColumn("_u", geo.unrotate(geo.box(), _high())).select("image_id", "_u.*")
    return cascade.first_found(sized, [("none", pairs), ("rotation", turned), ("watermark", cascade.baselines(sized))])


_add(
    "failover_cascade", "detections", _cascade,
    _PAIRS_SQL + f""", one AS (SELECT image_id, {_REGION_SQL} FROM near WHERE ca >= 0.75 AND cb >= 0.75),
    found AS (SELECT image_id, greatest(0, x - CAST(trunc(w*0.1) AS BIGINT)) AS x, greatest(0, y - CAST(trunc(h*0.1) AS BIGINT)) AS y, least({WIDTH} - greatest(0, x - CAST(trunc(w*0.1) AS BIGINT)), w + 2*CAST(trunc(w*0.1) AS BIGINT)) AS w,
        least({HEIGHT} - greatest(0, y - CAST(trunc(h*0.1) AS BIGINT)), h + 2*CAST(trunc(h*0.1) AS BIGINT)) AS h FROM one),
    turned AS (SELECT image_id, y AS x, {HEIGHT} - x - w AS y, h AS w, w AS h FROM detections WHERE conf >= 0.9 AND image_id NOT IN (SELECT image_id FROM found)),
    rest AS (SELECT DISTINCT image_id FROM detections WHERE image_id NOT IN (SELECT image_id FROM found) AND image_id NOT IN (SELECT image_id FROM turned))
    SELECT *, 'none' AS failover_type FROM found UNION ALL SELECT *, 'rotation' FROM turned
    UNION ALL SELECT image_id, {WIDTH - WIDTH // 4}, {HEIGHT - HEIGHT // 16}, {WIDTH // 4}, {HEIGHT // 16}, 'watermark' FROM rest UNION ALL SELECT image_id, {WIDTH - WIDTH // 16}, {HEIGHT - HEIGHT // 4}, {WIDTH // 16}, {HEIGHT // 4}, 'watermark' FROM rest""",
)


def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of image files among synthetic paths of the pages table."""
    ends = F.array(*map(F.lit, (".JPG", ".jpeg", ".png", ".webp", ".gif", "", ".txt", ".tif")))
    name = F.concat(F.lit("/data/in.v2/img_"), F.col("page_id").cast("string"), ends[(F.col("page_id") % 8).cast("int")])
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", name.alias("path")).where(files.is_image(F.col("path")))
    return rows.select("page_id", "path", files.output_names(F.col("path"))["clean"].alias("clean"), files.output_names(F.col("path"))["mask"].alias("mask"))


_queries["extension_filter"] = extension_filter
_sql["extension_filter"] = """
WITH p AS (SELECT page_id, ['.JPG', '.jpeg', '.png', '.webp', '.gif', '', '.txt', '.tif'][page_id % 8 + 1] AS e FROM pages)
SELECT page_id, '/data/in.v2/img_' || page_id || e AS path, 'img_' || page_id || '_clean' || e AS clean, 'img_' || page_id || '_mask.png' AS mask FROM p WHERE lower(e) IN ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.tif', '.webp')"""


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["tfidf_mask_size"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
