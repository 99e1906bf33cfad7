"""Colour quantisation: k-means over distinct colours."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.groups import dealt
from inkframe.sources.stored import stored

#: Points that are compared with all centres before the next ones, and the share of the longest point's square from which one distance is
#: surely less than another.
BATCH, CLEAR = 4096, 1e-9
#: Rounds of clustering after which the plan is cut, and the colours of a task.
CUT, ROWS = 4, 250_000
#: Steps that compactness is compared in: clusterings that only differ in their numbers must count as equal, whatever the order
#: of their sums, and no sum of fractions lies on the edge of such a step.
COARSE = 1000 / math.pi
#: By how much no centre may have moved in Lab features (L from 0 to 2.55, a and b from 0 to 1) for clustering to end.
STILL = 0.1
#: Starts of which the most compact clustering is kept, and the generator (Park and Miller, 1988) that draws the first centres of
#: each start after the first: colours of least (b, g, r as one number) * MULTIPLIER^start modulo PRIME.
STARTS, MULTIPLIER, PRIME = 10, 48271, 2**31 - 1


def grid_cluster(b: Column, g: Column, r: Column, steps: int = 4) -> Column:
    """Cell of a fixed grid of ``steps`` per channel: a quantisation that needs no fitting."""
    cell = lambda c: F.floor(c * steps / 256).cast("int")
    return (cell(b) * steps + cell(g)) * steps + cell(r)


def lloyd(colors: DataFrame, k: int, rounds: int, keys: Sequence[str] = ("image_id",), together: bool = False) -> DataFrame:
    """(keys, b, g, r, n, k) with each distinct colour's cluster after ``rounds`` updates of weighted k-means.

    Starts from the group's ``k`` most frequent colours (ties: smaller b, g, r) and stops early nowhere, so
    the outcome is the same on any cluster. Clusters that lose all colours are dropped. Ties between
    centres go to the smaller number. The centres of a group, ``k`` at most, travel as one array beside
    its colours: a round is one aggregation and one join on the group, with no pair of rows ever formed.
    The distinct colours are stored once and dealt to as many tasks as they need, ``ROWS`` a task on average, and the centres are stored every few
    rounds, so neither a task nor the plan grows with them. Colours that come with their group in one task already (``together``) stay there, and
    are made again for each round.
    """
    keys = list(keys)
    colors = colors.select(*keys, "b", "g", "r", "n")
    if not together:
        colors = stored(colors)
        colors = dealt(colors, *keys, tasks=-(-colors.count() // ROWS))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "b", "g", "r")
    first = colors.withColumn("_k", F.row_number().over(order) - 1).where(F.col("_k") < k)
    point = F.struct(F.col("_k").alias("k"), *(F.col(c).cast("double").alias(c) for c in "bgr"))
    centres = first.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("_c"))

    def assigned(centres: DataFrame) -> DataFrame:
        d = lambda c: (F.col("b") - c["b"]) * (F.col("b") - c["b"]) + (F.col("g") - c["g"]) * (F.col("g") - c["g"]) + (F.col("r") - c["r"]) * (F.col("r") - c["r"])
        # Centre by centre, as a lambda over the array would not be compiled. A task's centres are few beside its colours, which needn't be sorted.
        near = [F.when(F.size("_c") > i, F.struct(d(c).alias("d"), c["k"].alias("k"))) for i in range(k) for c in [F.get("_c", F.lit(i))]]
        return colors.join(centres.hint("shuffle_hash"), keys).select(*keys, "b", "g", "r", "n", (F.least(*near) if k > 1 else near[0])["k"].alias("k"))

    for done in range(1, rounds + 1):
        weight = F.sum("n")
        means = assigned(centres).groupBy(*keys, "k").agg(*((F.sum(F.col(c) * F.col("n")) / weight).alias(c) for c in "bgr"))
        centres = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "b", "g", "r"))).alias("_c"))
        if done % CUT == 0:
            centres = stored(centres)
    return assigned(centres)


def fit(points: np.ndarray, weight: np.ndarray, k: int, rounds: int, first: np.ndarray | None = None, still: float = 0.0) -> np.ndarray:
    """Cluster of each point by weighted k-means; the first centres are the points ``first``, by default those that come first.

    Ends after ``rounds`` updates, or with one that moves no centre by more than ``still``.
    """
    first = np.arange(len(points)) if first is None else first
    number, centres = np.arange(min(k, len(points))), points[first[:k]]

    axes = np.ascontiguousarray(points.T)

    longest = float(np.square(points).sum(axis=1).max(initial=0.0))

    def nearest() -> np.ndarray:
        # By one product of matrices, whose rounding is far below CLEAR; points with two centres closer than that are measured as they are.
        out = np.empty(len(points), np.int64)
        shift, slack = np.square(centres).sum(axis=1), CLEAR * (longest + 1.0)
        for lo in range(0, len(points), BATCH):
            own = points[lo : lo + BATCH]
            rough, row = own @ (-2.0 * centres.T), np.arange(len(own))
            rough += shift
            at = rough.argmin(axis=1)
            least = rough[row, at]
            rough[row, at] = np.inf
            close = np.flatnonzero(rough.min(axis=1) - least <= slack)
            if len(close):
                at[close] = sum(np.square(line[lo : lo + BATCH][close, None] - c) for line, c in zip(axes, centres.T)).argmin(axis=1)
            out[lo : lo + BATCH] = at
        return out

    for _ in range(rounds):
        at = nearest()
        total = np.bincount(at, weight, len(centres))
        means = np.stack([np.bincount(at, weight * c, len(centres)) for c in points.T], axis=1)
        left = total > 0
        new = means[left] / total[left, None]
        done = left.all() and ((new - centres) ** 2).sum(axis=1).max() <= still * still
        number, centres = number[left], new
        if done:
            break
    return number[nearest()]


def compactness(points: np.ndarray, weight: np.ndarray, at: np.ndarray) -> float:
    """Sum of the weighted squared distances of points from the mean of their cluster."""
    total = np.bincount(at, weight)
    means = np.stack([np.bincount(at, weight * c) for c in points.T], axis=1) / np.maximum(total, 1)[:, None]
    return float((weight[:, None] * (points - means[at]) ** 2).sum())


def best_fit(points: np.ndarray, weight: np.ndarray, codes: np.ndarray, k: int, rounds: int, starts: int = STARTS, still: float = 0.0) -> tuple[int, np.ndarray]:
    """(start, clusters) of the most compact of ``starts`` clusterings, to a thousandth of pi, of equals the first.

    The first start is that of ``fit``; the others draw ``k`` colours by their ``codes`` (b * 65536 + g * 256 + r).
    """
    if starts == 1:
        return 0, fit(points, weight, k, rounds, None, still)
    best: tuple[float, int, np.ndarray] | None = None
    for s in range(starts):
        draw = np.argsort(codes * pow(MULTIPLIER, s, PRIME) % PRIME, kind="stable") if s else None
        at = fit(points, weight, k, rounds, draw, still)
        c = math.floor(compactness(points, weight, at) * COARSE)
        if best is None or c < best[0]:
            best = (c, s, at)
    return best[1], best[2]


def lloyd_by_group(colors: DataFrame, k: int | str, rounds: int, keys: Sequence[str] = ("image_id",), by: Sequence[str] = ("b", "g", "r"), starts: int = 1, still: float = 0.0, together: bool = False) -> DataFrame:
    """``lloyd`` for many groups of which each fits a task: all rounds of a group in one pass, after one shuffle.

    ``colors`` keeps its columns and gets ``k``; ``by`` names the features. A group has as many rows as its
    image's region has colours. For one huge group use ``lloyd``. With several ``starts`` the most compact clustering is
    kept (``best_fit``); all starts of a group run in the same pass. ``k`` may name a column of ``keys`` that has the group's number.
    Colours that come with their group in one task already (``together``) stay there.
    """
    by = list(by)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", *by], ascending=[False] + [True] * len(by), kind="stable")
        codes = f["b"].to_numpy(np.int64) * 65536 + f["g"].to_numpy(np.int64) * 256 + f["r"].to_numpy(np.int64)
        return f.assign(k=best_fit(f[by].to_numpy(np.float64), f["n"].to_numpy(np.float64), codes, int(f[k].iloc[0]) if isinstance(k, str) else k, rounds, starts, still)[1].astype("int32"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in colors.schema.fields) + ", k int"
    return (colors if together else dealt(colors, *keys)).groupBy(*keys).applyInPandas(run, schema)


def centres_of(assigned: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, k, b, g, r, n): mean colour and pixels of each cluster."""
    weight = F.sum("n")
    return assigned.groupBy(*keys, "k").agg(*((F.sum(F.col(c) * F.col("n")) / weight).alias(c) for c in "bgr"), weight.alias("n"))


def nearest_cluster(centres: DataFrame, target: tuple[int, int, int], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, k) of the centre closest to ``target``; ties to the smaller number."""
    d = sum(((F.col(c) - t) * (F.col(c) - t) for c, t in zip("bgr", target)), F.lit(0.0))
    return centres.groupBy(*keys).agg(F.min(F.struct(d.alias("d"), "k")).alias("m")).select(*keys, "m.k")


def nearest_clusters(centres: DataFrame, targets: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, b, g, r, k) of the centre closest to each colour of ``targets`` (keys, b, g, r); ties to the smaller number.

    As in ``lloyd`` a group's centres travel as one array beside its colours, so no pair of rows is formed.
    """
    keys = list(keys)
    known = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", *(F.col(c).cast("double").alias(c) for c in "bgr")))).alias("_c"))
    d = lambda c: sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in "bgr"), F.lit(0.0))
    near = F.array_min(F.transform("_c", lambda c: F.struct(d(c).alias("d"), c["k"].alias("k"))))
    return targets.select(*keys, "b", "g", "r").distinct().join(known, keys).select(*keys, "b", "g", "r", near["k"].alias("k"))


def with_lab(colors: DataFrame) -> DataFrame:
    """Adds _l, _a, _b: features for clustering in CIE Lab (sRGB, D65), L / 100 and (a + 127) / 254 of 8-bit values.

    Rounded to bytes first, as an 8-bit conversion does, so L spans 0 to 2.55 and weighs the most. Each
    step is a column of its own, so no expression is written out twice in the generated code.
    """

    def linear(c: str) -> Column:
        v = F.col(c) / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    f = lambda t: F.when(F.col(t) > 0.008856, F.cbrt(t)).otherwise(F.col(t) * 7.787 + 16.0 / 116)
    byte = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(v)))
    rows = colors.withColumns({f"_{c}l": linear(c) for c in "bgr"})
    mix = lambda kr, kg, kb: F.col("_rl") * kr + F.col("_gl") * kg + F.col("_bl") * kb
    rows = rows.withColumns({"_x": mix(0.412453, 0.357580, 0.180423) / 0.950456, "_y": mix(0.212671, 0.715160, 0.072169), "_z": mix(0.019334, 0.119193, 0.950227) / 1.088754})
    rows = rows.withColumns({f"_f{t}": f(f"_{t}") for t in "xyz"})
    light = F.when(F.col("_y") > 0.008856, F.col("_fy") * 116 - 16).otherwise(F.col("_y") * 903.3)
    a, b = (F.col("_fx") - F.col("_fy")) * 500, (F.col("_fy") - F.col("_fz")) * 200
    out = rows.withColumns({"_l": byte(light * 255 / 100) / 100, "_a": (byte(a + 128) + 127) / 254, "_b": (byte(b + 128) + 127) / 254})
    return out.select(*colors.columns, "_l", "_a", "_b")


def lloyd_lab(colors: DataFrame, k: int | str, rounds: int, keys: Sequence[str] = ("image_id",), starts: int = 1, still: float = STILL, together: bool = False) -> DataFrame:
    """``lloyd_by_group`` on Lab features: (keys, b, g, r, n, k)."""
    return lloyd_by_group(with_lab(colors), k, rounds, keys, ("_l", "_a", "_b"), starts, still, together).drop("_l", "_a", "_b")
