"""Agreement of several detectors on a region."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe import schemas
from inkframe.functions import geometry as geo
from inkframe.operators import graph
from inkframe.operators.groups import dealt
from inkframe.sources.stored import stored

#: Share of the smaller box that two boxes must have in common.
OVERLAP = 0.1


def overlap_pairs(boxes: DataFrame, threshold: float = OVERLAP, tile: int | None = 128) -> DataFrame:
    """Pairs of boxes of one image and different detectors that overlap by ``threshold`` or more.

    Columns: image_id, id_a, id_b (id_a < id_b), overlap, ratio. Boxes meet within tiles of the image, so
    crowded images need no quadratic join: a pair is counted in the one tile that holds the upper left
    corner of its intersection. ``tile`` None joins on the image alone.
    """
    b = boxes.select("image_id", "det_id", "detector", geo.box().alias("b"))
    if tile is None:
        left, right = (b.select("image_id", *(F.col(c).alias(f"{c}_{s}") for c in ("det_id", "detector", "b"))) for s in "ab")
        keys = ["image_id"]
    else:
        cells = lambda at, n: F.sequence(F.floor(F.col(f"b.{at}") / tile), F.floor((F.col(f"b.{at}") + F.greatest(F.col(f"b.{n}"), F.lit(1)) - 1) / tile))
        b = b.withColumn("tx", F.explode(cells("x", "w"))).withColumn("ty", F.explode(cells("y", "h")))
        left, right = (b.select("image_id", "tx", "ty", *(F.col(c).alias(f"{c}_{s}") for c in ("det_id", "detector", "b"))) for s in "ab")
        keys = ["image_id", "tx", "ty"]
    pairs = left.join(right, keys).where((F.col("det_id_a") < F.col("det_id_b")) & (F.col("detector_a") != F.col("detector_b")))
    if tile is not None:
        corner = lambda at: F.floor(F.greatest(F.col(f"b_a.{at}"), F.col(f"b_b.{at}")) / tile)
        pairs = pairs.where((corner("x") == F.col("tx")) & (corner("y") == F.col("ty")))
    a, c = F.col("b_a"), F.col("b_b")
    pairs = pairs.withColumn("ratio", geo.overlap_ratio(a, c)).where(F.col("ratio") >= threshold)
    return pairs.select("image_id", F.col("det_id_a").alias("id_a"), F.col("det_id_b").alias("id_b"), geo.overlap_area(a, c).alias("overlap"), "ratio")


def pair_regions(boxes: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """Each overlapping pair as a region: the box around both, and the noisy-or of their confidences."""
    pairs = overlap_pairs(boxes, threshold)
    side = lambda s: boxes.select("image_id", F.col("det_id").alias(f"id_{s}"), geo.box().alias(f"b_{s}"), F.col("conf").alias(f"c_{s}"))
    rows = pairs.join(side("a"), ["image_id", "id_a"]).join(side("b"), ["image_id", "id_b"])
    rows = rows.withColumn("u", geo.union_box(F.col("b_a"), F.col("b_b")))
    return rows.select("image_id", "id_a", "id_b", "u.*", geo.noisy_or(F.array("c_a", "c_b")).alias("confidence"))


def greedy_groups(near: list[list[int]], detectors: list[str]) -> list[list[int]]:
    """Groups of indexes, in order of their seeds. ``near``: each box's overlapping boxes of other detectors, ascending.

    A seed takes each later unused box of another detector than its own that overlaps it; each box so
    taken lets in later unused boxes of detectors not in the group yet that overlap any member. So a
    group may hold a detector twice, and the outcome depends on the order; it is no transitive closure.
    Work follows the number of overlaps.
    """
    used = [False] * len(near)
    groups = []
    for seed in range(len(near)):
        if used[seed]:
            continue
        used[seed] = True
        members = [seed]
        for j in near[seed]:
            if j < seed or used[j] or detectors[j] == detectors[seed]:
                continue
            members.append(j)
            used[j] = True
            present = {detectors[m] for m in members}
            coming = [k for m in members for k in near[m] if k > j]
            heapq.heapify(coming)
            last = j
            while coming:
                k = heapq.heappop(coming)
                if k <= last or used[k] or detectors[k] in present:
                    last = max(last, k)
                    continue
                last = k
                members.append(k)
                used[k] = True
                present.add(detectors[k])
                for n in near[k]:
                    if n > k:
                        heapq.heappush(coming, n)
        groups.append(members)
    return groups


def consensus(boxes: DataFrame, threshold: float = OVERLAP, least: int = 2) -> DataFrame:
    """Regions (schemas.REGIONS) on which at least ``least`` boxes agree, greedily in order of (detector_rank, det_id).

    The overlaps come from ``overlap_pairs``, so no image is compared all with all. Boxes that no chain of overlaps joins
    never meet in a region, so each connected group of boxes is walked by itself: a task holds one such group at a time, not an image.
    Regions are numbered by their seeds.
    """
    order = Window.partitionBy("image_id").orderBy("detector_rank", "det_id")
    boxes = boxes.select("image_id", "det_id", "detector", "detector_rank", "x", "y", "w", "h", "conf").withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    pairs = overlap_pairs(boxes.select("image_id", F.col("seq").alias("det_id"), "detector", "x", "y", "w", "h"), threshold)
    pairs = stored(pairs.select("image_id", F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    joined = graph.connected(graph.contracted(pairs, ["image_id"]), ["image_id"])
    both = pairs.unionByName(pairs.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("image_id", F.col("a").alias("seq")).agg(F.sort_array(F.collect_list("b")).alias("near"))
    linked = joined.withColumnRenamed("node", "seq").join(near, ["image_id", "seq"])
    own = boxes.join(linked, ["image_id", "seq"], "inner" if least > 1 else "left")
    own = own.withColumns({"component": F.coalesce("component", "seq"), "near": F.coalesce("near", F.array().cast("array<long>"))})

    def walk(seq: list[int], near: list, names: list[str], b: np.ndarray, conf: np.ndarray, image) -> list[tuple]:
        place = {s: k for k, s in enumerate(seq)}
        out = []
        for members in greedy_groups([[place[s] for s in own] for own in near], names):
            if len(members) >= least:
                own, c = b[members], conf[members]
                x, y = own[:, 0].min(), own[:, 1].min()
                w, h = (own[:, 0] + own[:, 2]).max() - x, (own[:, 1] + own[:, 3]).max() - y
                out.append((image, seq[members[0]], x, y, w, h, 1 - np.prod(1 - c), [names[m] for m in members], len(members), c.tolist()))
        return out

    def walked(f: pd.DataFrame, cuts: list[int]) -> list[tuple]:
        """The regions of the groups of ``f`` that begin at ``cuts``; the last of these is where the last group ends."""
        seq, near, names, images = (f[c].tolist() for c in ("seq", "near", "detector", "image_id"))
        b, conf = f[["x", "y", "w", "h"]].to_numpy(np.int64), f["conf"].to_numpy(float)
        conf = np.where(conf > 1.0, conf / 100.0, conf)
        return [row for lo, hi in zip(cuts, cuts[1:]) for row in walk(seq[lo:hi], near[lo:hi], names[lo:hi], b[lo:hi], conf[lo:hi], images[lo])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["image_id", "seed", "x", "y", "w", "h", "confidence", "detectors", "detector_count", "original_confidences"]
        rest: pd.DataFrame | None = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            new = ((f["image_id"] != f["image_id"].shift()) | (f["component"] != f["component"].shift())).to_numpy()
            cuts = [*np.flatnonzero(new)]
            yield pd.DataFrame(walked(f, cuts), columns=columns)
            rest = f[cuts[-1] :]  # the last group may go on in the next batch
        if rest is not None and len(rest):
            yield pd.DataFrame(walked(rest, [0, len(rest)]), columns=columns)

    groups = dealt(own.select("image_id", "component", "seq", "detector", "x", "y", "w", "h", "conf", "near"), "image_id", "component").sortWithinPartitions("image_id", "component", "seq")
    found = groups.mapInPandas(run, schemas.REGIONS.replace("region_id int", "seed long"))
    number = (F.row_number().over(Window.partitionBy("image_id").orderBy("seed")) - 1).cast("int")
    return found.withColumn("region_id", number).select("image_id", "region_id", *found.columns[2:])
