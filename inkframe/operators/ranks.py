"""Exact medians and percentiles of tables of any size, by histograms that are refined where the wanted ranks lie."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.sources.stored import stored

#: Buckets of a histogram.
BUCKETS = 4096


def _bucket(v: str, lo: str, hi: str, buckets: int) -> Column:
    """Bucket of a value from ``lo`` to ``hi``, never falling as it rises; by halves where the range is too wide for a double."""
    v, lo, hi = F.col(v), F.col(lo), F.col(hi)
    share = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    return F.when(hi > lo, F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")


def at_ranks(df: DataFrame, col: str, wanted: dict[tuple, Sequence[int]], keys: Sequence[str] = (), buckets: int = BUCKETS) -> dict[tuple, dict[int, float]]:
    """The values of the given ranks, from 0, among the finite values of each group; ``wanted`` has the ranks by group.

    Each pass counts the values of every range that holds a wanted rank in ``buckets`` buckets, with the least and the largest of
    each, and goes on with the buckets that hold one, until such a bucket has a single value. So a pass is one
    aggregation with partial sums, no task gathers values, and the driver sees ``buckets`` rows at most for each wanted
    rank. The second pass and later ones read only the rows of the ranges that are left. Two or three passes do unless values are spread
    over very many magnitudes; each at least separates a range's least value from its largest. Groups must be few.
    """
    keys, spark = list(keys), df.sparkSession
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    finite = F.col(col).cast("double")
    rows = df.select(*keys, finite.alias("_v")).where(~F.isnan("_v") & (F.abs("_v") != float("inf")))
    out: dict[tuple, dict[int, float]] = {g: {} for g in wanted}
    # by group and range: the ranks in it, and how many values lie before it
    ranges: dict[tuple, tuple[float, float, int, list[int]]] = {}
    for r in rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).collect():
        g = tuple(r[k] for k in keys)
        if own := sorted(x for x in wanted.get(g, ()) if x < r["n"]):
            ranges[*g, 0] = (r["lo"], r["hi"], 0, own)
    first = True
    while ranges:
        for at in [at for at, (lo, hi, _, _) in ranges.items() if lo == hi]:
            lo, _, _, own = ranges.pop(at)
            out[at[:-1]].update((k, lo) for k in own)
        if not ranges:
            break
        table = F.broadcast(spark.createDataFrame([(*at, lo, hi) for at, (lo, hi, _, _) in ranges.items()], ", ".join([*kinds, "_i int", "_lo double", "_hi double"])))
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        if first:
            held = rows.join(table, keys).where(inside) if keys else rows.join(table, inside)
        else:
            held = rows.join(table, [*keys, "_i"])
        held = held.withColumn("_b", _bucket("_v", "_lo", "_hi", buckets))
        counts: dict[tuple, list] = {}
        for r in held.groupBy(*keys, "_i", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
            counts.setdefault((*(r[k] for k in keys), r["_i"]), []).append((r["_b"], r["n"], r["lo"], r["hi"]))
        following: dict[tuple, tuple[float, float, int, list[int]]] = {}
        kept, new = [], 0
        for at, (_, _, before, own) in ranges.items():
            for b, n, lo, hi in sorted(counts[at]):
                if mine := [k for k in own if before <= k < before + n]:
                    if lo < hi:
                        kept.append((*at, b, new))
                    following[*at[:-1], new] = (lo, hi, before, mine)
                    new += 1
                before += n
        if kept:
            left = F.broadcast(spark.createDataFrame(kept, ", ".join([*kinds, "_i int", "_b int", "_n int"])))
            rows = stored(held.join(left, [*keys, "_i", "_b"]).select(*keys, "_v", F.col("_n").alias("_i")))
        ranges, first = following, False
    return out


def between(values: dict[int, float], n: int, share: float) -> float:
    """The value a ``share`` of the way along ``n`` sorted values, interpolated linearly."""
    at = share * (n - 1)
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def ranks_of(n: int, shares: Sequence[float]) -> list[int]:
    """The ranks that ``between`` looks at."""
    return sorted({f(s * (n - 1)) for s in shares for f in (math.floor, math.ceil)}) if n else []


def percentiles(df: DataFrame, col: str, shares: Sequence[float], keys: Sequence[str] = ()) -> dict[tuple, tuple[int, list[float | None]]]:
    """By group: the number of finite values, and the value at each of ``shares`` (0 to 1), null without any. Null, NaN and infinite values don't count."""
    keys = list(keys)
    v = F.col(col).cast("double")
    good = F.count_if(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sizes = {tuple(r[k] for k in keys): r["n"] for r in df.groupBy(*keys).agg(good.alias("n")).collect()}
    found = at_ranks(df, col, {g: ranks_of(n, shares) for g, n in sizes.items()}, keys)
    return {g: (n, [between(found[g], n, s) if n else None for s in shares]) for g, n in sizes.items()}
