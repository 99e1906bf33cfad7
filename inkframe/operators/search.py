"""Finding the colour of text: by grayness or a given colour, or by trying clusters out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions import color
from inkframe.operators import colors, components, quantize, textlike, tiles
from inkframe.operators.groups import dealt
from inkframe.sources.stored import stored

#: Clusters that the plain search forms; rounds of clustering at most, which ends when nothing moves; pixels a colour
#: needs to be kept; numbers of clusters that the long search tries, and the last of each lot that it tries in one plan.
CLUSTERS, ROUNDS, LEAST, RANGE, LOTS = 12, 200, 4, range(2, 17), (4, 8, 16)
#: What numbers a cluster across a lot: clusters * SPAN + k.
SPAN = 1000
#: How close two detector scores count as equal, and the score that ends the search.
CLOSE, ENOUGH = 0.01, 0.975
#: By what share a likelihood of 1 raises a detector's score.
BOOST = 0.5


def find_text_colors(pixels: DataFrame, target: color.BGR | None = None, clusters: int = CLUSTERS, rounds: int = ROUNDS, keys: tuple[str, ...] = ("image_id",), starts: int = quantize.STARTS, together: bool = False) -> DataFrame:
    """(keys, b, g, r, n): the colours of each group's text cluster with LEAST pixels or more.

    The cluster is that whose centre is closest to ``target``, or without one that of the least channel
    variance; ties to the smaller number. ``together``: pixels come with their group in one task already.
    """
    keys = list(keys)
    assigned = stored(quantize.lloyd_lab(colors.distinct_colors(pixels, keys), clusters, rounds, keys, starts, together=together))
    centres = quantize.centres_of(assigned, keys)
    if target is not None:
        best = quantize.nearest_cluster(centres, target, keys)
    else:
        spread = colors.channel_variance(F.col("b"), F.col("g"), F.col("r"))
        best = centres.groupBy(*keys).agg(F.min(F.struct(spread.alias("v"), "k")).alias("m")).select(*keys, "m.k")
    return assigned.join(best, [*keys, "k"], "left_semi").where(F.col("n") >= LEAST).select(*keys, "b", "g", "r", "n")


def _letters(assigned: DataFrame, lot: list[str]) -> DataFrame:
    """(image_id, k, label, area, cx, cy, convexity) of the plausible components of each cluster's own pixels after the triple cleaning.

    A task makes the masks of all of an image's clusters from its pixels, so no pixel is sent more than once.
    """

    steps = tiles.OPEN * 3

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, y, own = (f[c].to_numpy(np.int64) for c in ("x", "y", "k"))
        out = []
        for k, lit in tiles.run_each(x, y, own, steps):
            out += [(f["image_id"].iloc[0], k, *c) for c in components.letters(x[lit], y[lit])]
        return pd.DataFrame(out, columns=["image_id", "k", "label", "area", "cx", "cy", "convexity"])

    rows = dealt(assigned.select(*lot, "x", "y", "k"), *lot)
    kinds = f"image_id {assigned.schema['image_id'].dataType.simpleString()}, k {assigned.schema['k'].dataType.simpleString()}"
    return rows.groupBy(*lot).applyInPandas(run, kinds + ", label long, area double, cx double, cy double, convexity double")


def candidate_scores(assigned: DataFrame, confidence: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(image_id, k, conf, n_components, likelihood, combined) of each cluster of ``assigned`` (image_id, x, y, k).

    ``confidence`` is the detector: from test images (image_id, k, x, y, v: the cluster black on gray 192) to
    (image_id, k, conf). Of an image, only clusters of one number (``clusters``, if ``assigned`` has that) make up a test image. Components are those of the cluster's own pixels, after the triple cleaning. Text in a region
    that is taller than wide runs downwards.
    """
    lot = ["image_id", "clusters"] if "clusters" in assigned.columns else ["image_id"]
    ks = assigned.select(*lot, "k").distinct()
    wide, high = (F.max(c) - F.min(c) for c in "xy")
    upright = assigned.groupBy("image_id").agg((high > wide).alias("v")).where("v").select("image_id")
    pairs = assigned.select(*lot, "x", "y", F.col("k").alias("_own")).join(ks, lot)
    ks = ks.select("image_id", "k")
    images = pairs.select("image_id", "k", "x", "y", F.when(F.col("_own") == F.col("k"), 0).otherwise(192).cast("int").alias("v"))
    keys = ["image_id", "k"]
    found = stored(_letters(assigned, lot))
    return _combined(ks.join(confidence(images), keys, "left"), found, ks.join(upright, "image_id", "left_semi"))


def _combined(seen: DataFrame, found: DataFrame, upright: DataFrame) -> DataFrame:
    """``seen`` (image_id, k, conf and others) with n_components, likelihood and combined, from the letters of each cluster.

    ``upright``: (image_id, k) of clusters whose text runs downwards.
    """
    keys = ["image_id", "k"]
    line = textlike.likelihood(found, keys, found.where(~F.isnan("convexity")), upright).select(*keys, F.col("n").alias("n_components"), "likelihood")
    out = seen.join(line, keys, "left").na.fill(0, ["conf", "n_components", "likelihood"])
    # A likely line counts for more components, at most twice as many or ten more; an unlikely one for half.
    n = F.col("n_components")
    weighed = F.when(n < 2, n).when(F.col("likelihood") >= 0.7, F.least(n * 2, n + 10)).when(F.col("likelihood") >= 0.5, n).otherwise(F.greatest(F.lit(1), F.floor(n / 2)))
    out = out.withColumn("n_components", weighed.cast("long"))
    return out.withColumn("combined", F.col("conf") * (1.0 + F.col("likelihood") * BOOST))


#: What looks at one test image in a task: from its x, y and v (0 or 192) to a score.
Detector = Callable[[np.ndarray, np.ndarray, np.ndarray], float]
_LETTERS = pa.list_(pa.struct([("label", pa.int64()), ("area", pa.float64()), ("cx", pa.float64()), ("cy", pa.float64()), ("convexity", pa.float64())]))


def _tried(pixels: DataFrame, lot: list[int], rounds: int, starts: int, detector: Detector) -> DataFrame:
    """(image_id, k, conf, b, g, r, upright, letters) of each cluster of each number of ``lot``, k told apart by its number.

    ``pixels`` (image_id, x, y, b, g, r and the features of ``quantize.with_lab``) come with their image in one task. There its colours are clustered, and each cluster's test image and
    mask are made from its pixels, looked at and dropped, so of a cluster no pixel is ever a row.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        x, y, b, g, r = (t[c].to_numpy().astype(np.int64) for c in ("x", "y", "b", "g", "r"))
        codes, first, color_of, n = np.unique(b * 65536 + g * 256 + r, return_index=True, return_inverse=True, return_counts=True)
        points = np.stack([t[c].to_numpy()[first] for c in ("_l", "_a", "_b")], axis=1)
        order = np.lexsort([*points.T[::-1], -n])
        bgr, upright = np.stack([b, g, r]), bool(np.ptp(y) > np.ptp(x))
        owns = np.empty((len(lot), len(codes)), np.int64)
        for own, number in zip(owns, lot):
            own[order] = quantize.best_fit(points[order], n[order].astype(float), codes[order], number, rounds, starts, quantize.STILL)[1] + number * SPAN
        owns, out = owns[:, color_of], []
        for k, lit in tiles.run_each(x, y, owns, tiles.OPEN * 3):
            mine = owns[lot.index(k // SPAN)] == k
            conf = detector(x, y, np.where(mine, 0, 192))
            found = components.letters(x[lit], y[lit])
            out.append((int(k), float(conf), *(bgr[:, mine].sum(axis=1) / np.count_nonzero(mine)).tolist(), upright, [dict(zip(("label", "area", "cx", "cy", "convexity"), one)) for one in found]))
        names = ("k", "conf", "b", "g", "r", "upright")
        columns = dict(zip(names, zip(*(row[:-1] for row in out))))
        ids = pa.array([t["image_id"][0].as_py()] * len(out), t.schema.field("image_id").type)
        kinds = (pa.int32(), *[pa.float64()] * 4, pa.bool_())
        return pa.table({"image_id": ids, **{c: pa.array(columns[c], a) for c, a in zip(names, kinds)}, "letters": pa.array([row[-1] for row in out], _LETTERS)})

    schema = f"image_id {kind}, k int, conf double, b double, g double, r double, upright boolean, letters array<struct<label: bigint, area: double, cx: double, cy: double, convexity: double>>"
    return pixels.groupBy("image_id").applyInArrow(run, schema)


def detected_scores(pixels: DataFrame, lot: list[int], rounds: int, starts: int, detector: Detector) -> DataFrame:
    """``candidate_scores`` of all clusters of each number of ``lot`` with their mean colours, the detector run where the test images are made."""
    tried = stored(_tried(pixels, lot, rounds, starts, detector))
    found = tried.select("image_id", "k", F.inline("letters"))
    return _combined(tried.select("image_id", "k", "conf", "b", "g", "r"), found, tried.where("upright").select("image_id", "k"))


def best_of(scored: DataFrame) -> DataFrame:
    """(image_id, clusters, k, conf, n_components, likelihood, combined, b, g, r) of the candidate that stands after all have been tried.

    Candidates come by (clusters, k). One takes the lead by a higher combined score, or by more components at
    a score closer than CLOSE; a lead whose detector score is over ENOUGH ends the search after its number of clusters. So the order
    matters, and the search is a fold over an image's few candidates. The lead of some candidates
    may stand for them before those of higher numbers. Images where none scores over 0 or has components have no row.
    """
    columns = ["clusters", "k", "conf", "n_components", "likelihood", "combined", "b", "g", "r"]
    rows = scored.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("all"))
    none = {"conf": 0, "n_components": 0, "likelihood": 0, "combined": 0}
    kinds = ", ".join(f"'{c}', CAST({none.get(c, 'NULL')} AS {scored.schema[c].dataType.simpleString()})" for c in columns)
    # The lead, the number of clusters being tried, and whether the search was over before it.
    begin = F.struct(F.expr(f"named_struct({kinds})").alias("lead"), F.lit(0).alias("number"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        over = s["over"] | ((x["clusters"] > s["number"]) & (s["lead"]["conf"] > ENOUGH))
        best = s["lead"]
        better = (x["combined"] > best["combined"]) | ((F.abs(x["combined"] - best["combined"]) < CLOSE) & (x["n_components"] > best["n_components"]))
        return F.struct(F.when(~over & better, x).otherwise(best).alias("lead"), F.greatest(s["number"], x["clusters"]).alias("number"), over.alias("over"))

    lead = F.aggregate("all", begin, step, lambda s: s["lead"])
    return rows.select("image_id", lead.alias("b")).where("b.k IS NOT NULL").select("image_id", "b.*")


def darkest(pixels: DataFrame) -> DataFrame:
    """(image_id, b, g, r) of each image's pixel of least mean, the first by row and column."""
    order = F.struct((F.col("b") + F.col("g") + F.col("r")).alias("s"), "y", "x", "b", "g", "r")
    return pixels.groupBy("image_id").agg(F.min(order).alias("m")).select("image_id", "m.b", "m.g", "m.r")


def exhaustive_search(pixels: DataFrame, confidence: Callable[[DataFrame], DataFrame] | None, numbers: range = RANGE, rounds: int = ROUNDS, starts: int = 1, detector: Detector | None = None, together: bool = False) -> DataFrame:
    """(image_id, clusters, k, conf, n_components, likelihood, combined, b, g, r): the best cluster over all numbers of clusters.

    b, g, r are the cluster's mean colour. Numbers are tried in lots (LOTS), each one plan, in which a cluster's k is told apart by its
    number; images whose lead has a detector score over ENOUGH leave the search after a lot, and within it no later number counts. Only
    the lead of each image is carried on. An image without any candidate has its darkest pixel's colour and nulls.

    The detector is ``confidence``, a plan over the rows of all test images (``candidate_scores``), which are as many as all clusters
    times all pixels, or ``detector``, which looks at one test image after the other in the tasks of the images. For that, pixels that come with
    their image in one task already (``together``) stay there.
    """
    if detector is None:
        counted = stored(quantize.with_lab(colors.distinct_colors(pixels)))
    else:
        dealt_pixels = pixels.select("image_id", "x", "y", "b", "g", "r")
        dealt_pixels = dealt_pixels if together else dealt(dealt_pixels, "image_id")
    left, lead = pixels.select("image_id").distinct(), None
    lots = [lot for lo, hi in zip((0, *LOTS), (*LOTS, max(numbers, default=0))) if (lot := [n for n in numbers if lo < n <= hi])]
    for lot in lots:
        if detector is None:
            own = counted.join(left, "image_id", "left_semi").withColumn("clusters", F.explode(F.array(*map(F.lit, lot))))
            clustered = quantize.lloyd_by_group(own, "clusters", rounds, ("image_id", "clusters"), ("_l", "_a", "_b"), starts, quantize.STILL)
            clustered = stored(clustered.select("image_id", "clusters", "b", "g", "r", "n", (F.col("clusters") * SPAN + F.col("k")).alias("k")))
            assigned = pixels.join(clustered.select("image_id", "b", "g", "r", "clusters", "k").hint("merge"), ["image_id", "b", "g", "r"])
            means = quantize.centres_of(clustered).drop("n")
            scored = candidate_scores(assigned, confidence).join(means, ["image_id", "k"])
        else:
            own = dealt_pixels if lead is None else dealt_pixels.join(left, "image_id", "left_semi")
            scored = detected_scores(quantize.with_lab(own), lot, rounds, starts, detector)
        scored = scored.withColumns({"clusters": F.floor(F.col("k") / SPAN).cast("int"), "k": (F.col("k") % SPAN).cast("int")})
        lead = stored(best_of(scored if lead is None else lead.unionByName(scored)))
        if lot is lots[-1]:
            break
        left = stored(left.join(lead.where(F.col("conf") > ENOUGH).select("image_id"), "image_id", "left_anti"))
        if left.isEmpty():
            break
    # The lead is read from storage, so a plan that has it twice doesn't make it twice.
    rest = darkest(pixels.join(lead.select("image_id"), "image_id", "left_anti"))
    return lead.unionByName(rest.select("image_id", *(F.lit(None).cast(lead.schema[c].dataType).alias(c) for c in lead.columns[1:-3]), *(F.col(c).cast("double").alias(c) for c in "bgr")))
