"""How much a set of components looks like a line of text, and simple regressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators import colors, filters, quantize
from inkframe.operators.groups import dealt
from inkframe.sources.stored import stored

#: Weights of line, size, spacing, convexity and count.
WEIGHTS = (0.30, 0.25, 0.25, 0.15, 0.05)


def line_fit(rows: DataFrame, keys: Sequence[str] = ("image_id",), x: str = "cx", y: str = "cy") -> DataFrame:
    """(keys, n, slope, intercept, r_squared) of ordinary least squares.

    Under two rows all are 0; equal x give (0, mean y, 0); a flat line fitted exactly has r_squared 1.
    """
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("q"),
        F.avg(y).alias("my"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    )
    few, same = F.col("n") < 2, F.col("x0") == F.col("x1")
    slope = F.when(few | same, 0.0).otherwise(F.col("s"))
    intercept = F.when(few, 0.0).when(same, F.col("my")).otherwise(F.col("i"))
    square = F.when(few | same, 0.0).when(F.col("y0") == F.col("y1"), 1.0).otherwise(F.col("q"))
    return out.select(*keys, "n", slope.alias("slope"), intercept.alias("intercept"), square.alias("r_squared"))


def variation(col: str) -> Column:
    """Aggregate: population standard deviation over mean, null where the mean isn't positive."""
    return F.when(F.avg(col) > 0, F.stddev_pop(col) / F.avg(col))


def spacings(rows: DataFrame, keys: Sequence[str] = ("image_id",), at: str = "cx") -> DataFrame:
    """(keys, gap) between neighbours in order of ``at``."""
    w = Window.partitionBy(*keys).orderBy(at)
    return rows.select(*keys, (F.col(at) - F.lag(at).over(w)).alias("gap")).where(F.col("gap").isNotNull())


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _evenness(cv: Column, limit: float) -> Column:
    return F.coalesce(_unit((limit - cv) / limit), F.lit(0.0))


def likelihood(components: DataFrame, keys: Sequence[str] = ("image_id",), convexity: DataFrame | None = None, vertical: DataFrame | None = None) -> DataFrame:
    """(keys, n, colinearity, size_uniformity, spacing_uniformity, convexity, count_score, likelihood).

    ``components``: keys, cx, cy, area. ``convexity``: keys, convexity of single components; without it the
    part is 0.5. ``vertical``: keys of groups whose box is taller than wide; their spacing goes by cy.
    Groups of under two components score 0.
    """
    keys = list(keys)
    rows = components.select(*keys, "cx", "cy", "area")
    rows = rows.withColumn("_at", F.col("cx")) if vertical is None else rows.join(vertical.select(*keys).distinct().withColumn("_v", F.lit(True)), keys, "left").withColumn("_at", F.when(F.col("_v"), F.col("cy")).otherwise(F.col("cx")))
    fit = line_fit(rows, keys)
    off = rows.join(fit, keys).groupBy(*keys).agg(F.avg(F.abs(F.col("cy") - (F.col("slope") * F.col("cx") + F.col("intercept")))).alias("_off"), variation("area").alias("_size"))
    gaps = spacings(rows, keys, "_at").groupBy(*keys).agg(F.count(F.lit(1)).alias("_gaps"), variation("gap").alias("_spacing"))
    out = fit.join(off, keys).join(gaps, keys, "left")
    if convexity is not None:
        shape = convexity.groupBy(*keys).agg(F.count(F.lit(1)).alias("_shapes"), F.avg("convexity").alias("_shape"), variation("convexity").alias("_shape_cv"))
        out = out.join(shape, keys, "left")
        good = (_evenness(F.col("_shape_cv"), 0.4) + F.when(F.col("_shape").between(0.6, 0.95), 1.0).otherwise(0.5)) / 2
        shape_score = F.when(F.col("_shapes") >= 2, good).otherwise(0.5)
    else:
        shape_score = F.lit(0.5)
    parts = {
        "colinearity": F.col("r_squared") / (1.0 + F.col("_off")), "size_uniformity": _evenness(F.col("_size"), 0.6),
        "spacing_uniformity": F.when(F.col("_gaps") >= 2, _evenness(F.col("_spacing"), 0.5)).otherwise(0.5), "convexity": shape_score,
        "count_score": F.when(F.col("n") >= 3, F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n"))).otherwise(1.0),
    }
    enough = F.col("n") >= 2
    out = out.select(*keys, "n", *(F.when(enough, c).otherwise(0.0).alias(k) for k, c in parts.items()))
    return out.withColumn("likelihood", sum((F.col(k) * w for k, w in zip(parts, WEIGHTS)), F.lit(0.0)))


def tile_density(pixels: DataFrame, size: int, keys: Sequence[str] = ("image_id",), clusters: int = 0) -> DataFrame:
    """(keys, ty, tx, edge_density[, share_0..]) of whole square tiles: mean of ``edge`` > 0 and shares of clusters ``k``.

    x and y count from the region's corner; what is left over at its right and bottom has no tile. Where a region ends its tiles tell, so
    its pixels are read once.
    """
    rows = pixels.withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)})
    shares = [F.avg((F.col("k") == c).cast("int")).alias(f"share_{c}") for c in range(clusters)]
    out = rows.groupBy(*keys, "ty", "tx").agg(F.avg((F.col("edge") > 0).cast("int")).alias("edge_density"), *shares, F.max("x").alias("_mx"), F.max("y").alias("_my"))
    ends = {f"_n{c}": F.floor((F.max(f"_m{c}").over(Window.partitionBy(*keys)) + 1) / size) for c in "xy"}
    return out.withColumns(ends).where("tx < _nx AND ty < _ny").drop("_mx", "_my", "_nx", "_ny")


def edgy_colors(pixels: DataFrame, size: int = 8, clusters: int = 4, rounds: int = 20, keys: Sequence[str] = ("image_id",), together: bool = False, tasks: int = 0) -> DataFrame:
    """(keys, k, weight, rank, b, g, r) of the colour clusters that go with edges: k-means, edges, shares by tile, regression.

    Pixels take their colours along when edges are found, and meet the clusters of these in ``tasks`` (``groups.dealt``).
    """
    assigned = stored(quantize.lloyd_by_group(colors.distinct_colors(pixels, list(keys)), clusters, rounds, keys, together=together))
    on = [*keys, "b", "g", "r"]
    seen = dealt(filters.edges(pixels, also=[c for c in on if c != "image_id"]), *on, tasks=tasks)
    tiles = tile_density(seen.join(assigned.select(*on, "k").hint("merge"), on), size, keys, clusters)
    return edgy_clusters(tiles, clusters, keys).join(quantize.centres_of(assigned, keys).drop("n"), [*keys, "k"])


def edgy_clusters(tiles: DataFrame, clusters: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, k, weight) of the clusters whose share raises edge density, heaviest first.

    Shares sum to one, so the least-squares solution is the one of smallest norm; fewer than two tiles give none. Tiles are
    sorted and weights equal to nine places rank by their cluster, so that the order in which tiles come changes nothing.
    """
    names = [f"share_{c}" for c in range(clusters)]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        head = {k: f[k].iloc[0] for k in keys}
        if len(f) < 2:
            return pd.DataFrame(columns=[*keys, "k", "weight", "rank"])
        f = f.sort_values([*names, "edge_density"])
        a = np.column_stack([np.ones(len(f)), f[names].to_numpy(float)])
        w = np.linalg.lstsq(a, f["edge_density"].to_numpy(float), rcond=None)[0][1:]
        order = [k for k in np.argsort(-np.round(w, 9), kind="stable") if w[k] > 0]
        return pd.DataFrame({**{k: [v] * len(order) for k, v in head.items()}, "k": order, "weight": w[order], "rank": range(1, len(order) + 1)})

    schema = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys) + ", k int, weight double, rank int"
    return tiles.groupBy(*keys).applyInPandas(run, schema)
