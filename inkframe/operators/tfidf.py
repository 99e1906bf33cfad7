"""Spatial TF-IDF: which colours are frequent in a region and rare around it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import color, geometry
from inkframe.operators import quantize, tiles
from inkframe.operators.groups import dealt

#: Normalised score from which a pixel counts as text; clusters and rounds of the quantisation.
THRESHOLD, CLUSTERS, ROUNDS = 188, 24, 20


def region_pixels(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """(image_id, region_id, x, y, b, g, r, in_doc) of the pixels in each region's surroundings, one scan.

    ``regions``: image_id, region_id, x, y, w, h, width, height. ``in_doc`` marks the region itself; the
    rest of the surroundings is the corpus.
    """
    b = geometry.box()
    r = regions.select("image_id", "region_id", b.alias("_d"), geometry.expanded(b, F.col("width"), F.col("height")).alias("_e"))
    joined = pixels.select("image_id", "x", "y", "b", "g", "r").join(r, "image_id")
    inside = joined.where(geometry.holds(F.col("_e"), F.col("x"), F.col("y")))
    return inside.select("image_id", "region_id", "x", "y", "b", "g", "r", geometry.holds(F.col("_d"), F.col("x"), F.col("y")).alias("in_doc"))


def cluster_scores(assigned: DataFrame, keys: Sequence[str] = ("image_id", "region_id"), weight: Column | None = None, clusters: int = CLUSTERS) -> DataFrame:
    """(keys, k, n_doc, n_corpus, tf, idf, score, norm) of each of the ``clusters`` clusters, by rows with ``k`` and ``in_doc``.

    score = n_doc / total_doc * ln(total_corpus / (n_corpus + 1)); norm is the score between the group's
    least (0) and greatest (255), truncated; 128 where all are equal or there is no corpus. A cluster without
    any pixel counts too, with score 0: it may be the least.
    """
    keys, n = list(keys), F.lit(1) if weight is None else weight
    counts = assigned.groupBy(*keys, F.col("k").cast("int").alias("k")).agg(
        F.sum(F.when(F.col("in_doc"), n).otherwise(0)).alias("n_doc"), F.sum(F.when(F.col("in_doc"), 0).otherwise(n)).alias("n_corpus")
    )
    found = F.map_from_entries(F.collect_list(F.struct("k", F.struct("n_doc", "n_corpus"))))
    groups = counts.groupBy(*keys).agg(found.alias("_m"), F.sum("n_doc").alias("_td"), F.sum("n_corpus").alias("_tc"))
    counts = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
    none = F.lit(0).cast(groups.schema["_td"].dataType)
    counts = counts.withColumns({c: F.coalesce(F.try_element_at("_m", F.col("k"))[c], none) for c in ("n_doc", "n_corpus")})
    group = Window.partitionBy(*keys)
    tf = F.when(F.col("_td") > 0, F.col("n_doc") / F.col("_td")).otherwise(0.0)
    idf = F.when(F.col("_tc") > 0, F.ln(F.col("_tc") / (F.col("n_corpus") + 1)))
    rows = counts.withColumns({"tf": tf, "idf": idf}).withColumn("score", F.col("tf") * F.col("idf"))
    low, high = F.min("score").over(group), F.max("score").over(group)
    norm = F.when((F.col("_tc") > 0) & (high > low), F.floor((F.col("score") - low) / (high - low) * 255)).otherwise(128)
    return rows.withColumn("norm", norm.cast("int")).drop("_td", "_tc", "_m")


def top_colors(scores: DataFrame, centres: DataFrame, most: int = 2, keys: Sequence[str] = ("image_id", "region_id")) -> DataFrame:
    """The ``most`` clusters of highest positive score, as #RRGGBB of their truncated centres; ties to the smaller k."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "k")
    best = scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = best.join(centres.select(*keys, "k", "b", "g", "r"), [*keys, "k"])
    return rows.select(*keys, "rank", "k", "score", color.to_hex(F.col("b"), F.col("g"), F.col("r")).alias("hex"))


def score_map(assigned: DataFrame, scores: DataFrame, keys: Sequence[str] = ("image_id", "region_id"), threshold: int = THRESHOLD, target: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, norm, v) of the region's own pixels; v is 255 from ``threshold`` on.

    ``target`` (keys, k): a cluster of each group whose pixels count as text whatever their score.
    """
    keys = list(keys)
    rows = assigned.where("in_doc").join(scores.select(*keys, "k", "norm"), [*keys, "k"])
    hit = F.col("norm") >= threshold
    if target is not None:
        rows = rows.join(target.withColumn("_t", F.lit(True)), [*keys, "k"], "left")
        hit = hit | F.coalesce("_t", F.lit(False))
    return rows.select(*keys, "x", "y", "norm", F.when(hit, 255).otherwise(0).cast("int").alias("v"))


def _mask_of(f: pd.DataFrame, clusters: int, rounds: int, target: color.BGR | None, starts: int) -> np.ndarray:
    """v of each row of one region's surroundings: quantisation, scores and threshold as the table functions have them."""
    code = (f["b"].to_numpy(np.int64) << 16) | (f["g"].to_numpy(np.int64) << 8) | f["r"].to_numpy(np.int64)
    colors_, at, n = np.unique(code, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # most frequent first, then by b, g, r
    points = np.stack([colors_ >> 16, colors_ >> 8 & 255, colors_ & 255], axis=1).astype(np.float64)
    k = np.empty(len(colors_), np.int64)
    k[order] = quantize.best_fit(points[order], n[order].astype(np.float64), colors_[order], clusters, rounds, starts)[1]
    own, doc = k[at], f["in_doc"].to_numpy(bool)
    n_doc, n_corpus = np.bincount(own[doc], minlength=clusters), np.bincount(own[~doc], minlength=clusters)
    norm = np.full(clusters, 128)
    if n_corpus.sum():
        score = n_doc / max(1, n_doc.sum()) * np.log(n_corpus.sum() / (n_corpus + 1))
        low, high = score.min(), score.max()
        if high > low:
            norm = np.floor((score - low) / (high - low) * 255)
    text = norm >= THRESHOLD
    if target is not None:
        total = np.bincount(k, n, clusters)
        means = np.stack([np.bincount(k, n * c, clusters) for c in points.T], axis=1) / np.maximum(total, 1)[:, None]
        d = ((means - np.array(target, float)) ** 2).sum(axis=1)
        d[total == 0] = np.inf
        text[d.argmin()] = True
    return np.where(text[own], 255, 0)


def text_mask(pixels: DataFrame, regions: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, target: color.BGR | None = None, clean: bool = True, tile: int | None = None, starts: int = 1) -> DataFrame:
    """(image_id, region_id, x, y, v): the mask of the text in each region.

    Surroundings, quantisation of their distinct colours, scores, threshold, then morphological cleaning
    within the region. Regions whose surroundings have fewer pixels than ``clusters`` give no rows.

    A region's surroundings fit a task, so all of its steps run in one, cleaning included, after one shuffle;
    ``cluster_scores`` and ``score_map`` do the same on tables, for groups of any size, and with ``tile`` the
    mask is cleaned by tiles of that size. ``starts``: of how many clusterings the most compact one counts.
    """
    keys = ["image_id", "region_id"]
    near = region_pixels(pixels, regions)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = f[[*keys, "x", "y"]].assign(v=0)
        if len(f) < clusters:
            return out[:0]
        out = out.assign(v=_mask_of(f, clusters, rounds, target, starts))[f["in_doc"].to_numpy(bool)]
        if clean and not tile:
            out["v"] = tiles.run_steps(out["x"].to_numpy(np.int64), out["y"].to_numpy(np.int64), out["v"].to_numpy(np.int32), tiles.CLEAN)
        return out

    kinds = {c: near.schema[c].dataType.simpleString() for c in (*keys, "x", "y")}
    mask = dealt(near, *keys).groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", v int")
    return tiles.by_tiles(mask, tiles.CLEAN, keys, tile) if clean and tile else mask
