"""Reports over batches: timings, failovers, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.operators import ranks

#: How an image's regions were found, and the sign of each in the report.
FAILOVERS = {"none": "", "rotation": "R", "target_color": "T", "gray_enhancement": "G", "white_enhancement": "W", "watermark": "B"}
#: Thresholds of the sweep beside the one in use.
SWEEP = (64, 96, 128, 160, 192, 224)


#: The columns of times that an image may have.
STAGES = ("load_time", "detection_time", "color_time", "mask_time", "inpaint_time", "total_time")


def timing_stats(timings: DataFrame, stages: Sequence[str] | None = None) -> DataFrame:
    """(stage, n, median, mean) over the values that are there, of all STAGES that the table has; zeros where none is.

    The median is exact, by refined histograms (``ranks.at_ranks``), so no task gathers a stage's values.
    """
    stages = [s for s in STAGES if s in timings.columns] if stages is None else stages
    pairs = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("t")) for s in stages))
    rows = timings.select(F.explode(pairs).alias("p")).select("p.*")
    sums = {r["stage"]: (r["n"], r["mean"]) for r in rows.groupBy("stage").agg(F.count("t").alias("n"), F.avg("t").alias("mean")).collect()}
    found = ranks.at_ranks(rows, "t", {(s,): ranks.ranks_of(n, [0.5]) for s, (n, _) in sums.items()}, ["stage"])
    out = [(s, n, ranks.between(found[s,], n, 0.5) if n else 0.0, mean if n else 0.0) for s, (n, mean) in sums.items()]
    return timings.sparkSession.createDataFrame(out, "stage string, n long, median double, mean double")


def consensus_stats(timings: DataFrame) -> DataFrame:
    """One row: boxes in all, images with any, and their per cent."""
    return timings.agg(F.sum("consensus_boxes_count").alias("n_boxes"), F.count_if(F.col("consensus_boxes_count") > 0).alias("n_images"), (F.avg((F.col("consensus_boxes_count") > 0).cast("int")) * 100).alias("percent"))


def run_time(timings: DataFrame, seconds: float) -> DataFrame:
    """One row: files, those with a time, ``seconds`` of the whole run, and seconds a file, failures included."""
    return timings.agg(F.count(F.lit(1)).alias("n_files"), F.count("detection_time").alias("n_done")).select("*", F.lit(float(seconds)).alias("total"), F.when(F.col("n_files") > 0, seconds / F.col("n_files")).otherwise(0.0).alias("average"))


def failover_counts(timings: DataFrame) -> DataFrame:
    """(failover_type, marker, n) of all six ways, zeros included."""
    marker = F.create_map(*(F.lit(x) for pair in FAILOVERS.items() for x in pair))
    types = timings.sparkSession.createDataFrame([(k,) for k in FAILOVERS], "failover_type string")
    found = timings.groupBy("failover_type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(types).join(found, "failover_type", "left").select("failover_type", marker[F.col("failover_type")].alias("marker"), F.coalesce("n", F.lit(0)).alias("n"))


#: Columns of the report of each image: heading, width and digits.
COLUMNS = {"image_mp": ("MP", 7, 2), "detection_time": ("detect", 8, 2), "color_time": ("colour", 8, 2), "mask_time": ("mask", 8, 2), "inpaint_time": ("paint", 8, 2), "total_time": ("total", 8, 2)}
NAME = 25


def _columns(timings: DataFrame) -> dict[str, tuple[str, int, int]]:
    return {c: x for c, x in COLUMNS.items() if c in timings.columns}


def report_lines(timings: DataFrame) -> DataFrame:
    """(value) fixed-width lines of the report of each image, to be written as text; a dash where an image has no time."""
    # A null would be formatted as a word.
    parts = [F.when(F.col(c).isNull(), "-".rjust(w)).otherwise(F.format_string(f"%{w}.{d}f", F.col(c).cast("double"))) for c, (_, w, d) in _columns(timings).items()]
    marker = F.create_map(*(F.lit(x) for pair in FAILOVERS.items() for x in pair))
    name = F.rpad(F.substring(F.col("image_id").cast("string"), 1, NAME), NAME, " ")
    return timings.select(F.concat_ws(" ", name, *parts, F.lpad(F.col("consensus_boxes_count").cast("string"), 5, " "), marker[F.col("failover_type")]).alias("value"))


def timing_report(timings: DataFrame, seconds: float, settings: dict[str, object] | None = None) -> DataFrame:
    """(part, place, value) the whole report as text, in order of (part, place): what was asked for, a line an image, medians and means, totals.

    Only the sums reach the driver; the images' lines are a plan, numbered by name. ``settings`` are shown as given.
    """
    spark, wide = timings.sparkSession, _columns(timings)
    line = lambda label, values, boxes: " ".join([label.ljust(NAME), *(values.get(c, "").rjust(w) for c, (_, w, _) in wide.items()), boxes])
    times = [c for c in wide if c != "image_mp"]
    with_boxes = timings.select(*times, F.col("consensus_boxes_count").cast("double").alias("boxes"))
    stats = {r["stage"]: r for r in timing_stats(with_boxes, [*times, "boxes"]).collect()}
    boxes, run = consensus_stats(timings).first(), run_time(timings, seconds).first()
    ways = {r["failover_type"]: r["n"] for r in failover_counts(timings).collect()}
    rule = "-" * len(line("", {}, "boxes way"))
    head = ["Times by image, in seconds", *(f"{k}: {v}" for k, v in (settings or {}).items()), "", line("image", {c: t for c, (t, _, _) in wide.items()}, "boxes way"), rule]
    shown = lambda of: line(of, {c: f"{stats[c][of]:.{wide[c][2]}f}" for c in times if c in stats}, f"{stats['boxes'][of]:5.1f}" if "boxes" in stats else "")
    tail = [rule, shown("median"), shown("mean"), rule, f"all images: {run['total']:.1f} s, {run['average']:.2f} s each, {run['n_done']} of {run['n_files']} with a time"]
    tail += [f"regions agreed on: {boxes['n_boxes'] or 0}, in {boxes['n_images']} images ({boxes['percent'] or 0.0:.1f} %)", "", "how regions were found:"]
    tail += [f"  {way.replace('_', ' ')}{f' ({sign})' if sign else ''}: {ways[way]}" for way, sign in FAILOVERS.items()]
    fixed = spark.createDataFrame([(0, f"{k:06d}", v) for k, v in enumerate(head)] + [(2, f"{k:06d}", v) for k, v in enumerate(tail)], "part int, place string, value string")
    named = report_lines(timings).withColumn("place", F.col("value")).select(F.lit(1).alias("part"), "place", "value")
    return fixed.unionByName(named)


def shortened(name: Column, most: int = 35) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def score_moments(scores: DataFrame, col: str = "score") -> DataFrame:
    """One row: how many, mean, exact median (as in ``timing_stats``), standard deviation, least and largest; nulls without scores."""
    row = scores.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("low"), F.max(col).alias("high"))
    (_, (median,)), = ranks.percentiles(scores, col, [0.5]).values()
    return row.select("n", "mean", F.lit(median).cast("double").alias("median"), "std", "low", "high")


def score_histogram(scores: DataFrame, bins: int = 20, width: int = 50, col: str = "score") -> DataFrame:
    """(bin, n, bar) of equal bins from the least to the largest score, the last one closed; empty bins included."""
    span = scores.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    rows = scores.crossJoin(F.broadcast(span))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(col) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    counts = rows.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"])
    most = out.agg(F.max("n").alias("most"))
    return out.crossJoin(F.broadcast(most)).select("bin", "n", F.repeat(F.lit("#"), F.floor(F.col("n") / F.greatest("most", F.lit(1)) * width).cast("int")).alias("bar"))


def score_percentiles(scores: DataFrame, points: int = 21, col: str = "score") -> DataFrame:
    """(percent, value) at ``points`` equal steps from 0 to 100, interpolated linearly; exact, as the median of ``timing_stats``. No scores give nulls."""
    steps = [k / (points - 1) for k in range(points)]
    (_, values), = ranks.percentiles(scores, col, steps).values()
    return scores.sparkSession.createDataFrame([(100.0 * s, v) for s, v in zip(steps, values)], "percent double, value double")


def threshold_sweep(scores: DataFrame, thresholds: Sequence[int] = SWEEP, current: int = 188, col: str = "norm") -> DataFrame:
    """(threshold, percent) of the scores at or over each threshold; one pass over the scores."""
    every = sorted({*thresholds, current})
    row = scores.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), (F.avg((F.col(col) >= t).cast("int")) * 100).alias("percent")) for t in every)).alias("a"))
    return row.select(F.inline("a"))
