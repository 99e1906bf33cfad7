"""Connected groups within many graphs at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.operators.groups import dealt
from inkframe.sources.stored import stored


def stars(a: Sequence, b: Sequence) -> dict:
    """Each node of the given edges, and the smallest one it is connected with by them."""
    above: dict = {}

    def top(k):
        while above.setdefault(k, k) != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    return {k: top(k) for k in above}


def contracted(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fewer ``edges`` (keys, a, b) that connect the same nodes: the edges of some keys meet in a task, and each batch of them becomes its stars."""
    keys = list(keys)
    kinds = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in (*keys, "a", "b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = list(zip(*(f[k].tolist() for k in keys)))
            ends = stars([(*k, x) for k, x in zip(own, f["a"].tolist())], [(*k, x) for k, x in zip(own, f["b"].tolist())])
            yield pd.DataFrame([(*n, c[-1]) for n, c in ends.items() if n != c], columns=[*keys, "a", "b"])

    return dealt(edges.select(*keys, "a", "b"), *keys).sortWithinPartitions(*keys, "a").mapInPandas(run, kinds)


def connected(edges: DataFrame, keys: Sequence[str] = ("image_id",), most_rounds: int = 60) -> DataFrame:
    """(keys, node, component) of the nodes of ``edges`` (keys, a, b); component is the smallest node of the same keys reachable.

    Edges hang on the smallest neighbour in turns, of the larger neighbours and of the smaller ones (alternating stars, Kiveris et
    al., 2014), so there are never more of them and paths shorten by the factor of a logarithm; a round is
    two aggregations and joins, each result stored. Ends when nothing changes: each node then hangs on its component.
    """
    keys = list(keys)
    e = stored(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        counts = e.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("n"))
        centres = e.select(*keys, F.col("v").alias("u")).distinct()
        if counts.where("n > 1").isEmpty() and e.join(centres, [*keys, "u"], "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = stored(both.where("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = e.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        ends = F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = stored(e.join(low, [*keys, "u"]).select(*keys, ends).where("u <> v").distinct())
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    own = e.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(e.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
