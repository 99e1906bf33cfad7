"""Connected components over edge tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.store import written


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the given links: (node, smallest node of its component), node > smallest.

    What one task found shrinks to under one edge a node here, so no task emits all pairs of a group.
    """
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    if not len(nodes):
        return nodes, nodes
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _is_stars(e: DataFrame) -> bool:
    """Whether each node of ``e`` (u, v; u > v) has one edge or is the centre of its edges: then v is u's component."""
    n = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("u")).first()
    return n.n == n.u and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): edges never grow in number and the rounds follow the logarithm of the longest path.
    Each round is written to the shared folder, and so are the smallest neighbours: both sides of a join
    are then plain shuffles, and adaptive execution splits that of a node with very many neighbours. Null ends and loops are ignored; an empty table gives no row.
    """
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        if _is_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        e = written(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
