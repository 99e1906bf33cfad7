"""Deterministic image, detection, component and timing tables over the driver's star schema.

The text of each table is the same for Spark and for the SQL engine that checks it; only base table names
are given differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGE_SQL = """
digits(d) AS (VALUES (0),(1),(2),(3),(4),(5),(6),(7)),
xs AS (SELECT CAST(a.d*8+b.d AS BIGINT) AS x FROM digits a CROSS JOIN digits b),
ys AS (SELECT CAST(a.d*8+b.d AS BIGINT) AS y FROM digits a CROSS JOIN digits b WHERE a.d < 6),
images AS (
  SELECT p_partkey AS image_id, 8 + (CAST(floor(p_partkey/50) AS BIGINT) % 5)*4 AS bx, 10 + (CAST(floor(p_partkey/50) AS BIGINT) % 3)*6 AS by_,
         CAST(32 AS BIGINT) AS bw, CAST(16 AS BIGINT) AS bh, CAST(64 AS BIGINT) AS width, CAST(48 AS BIGINT) AS height
  FROM part WHERE p_partkey % 50 = 0)"""

PIXEL_SQL = (
    IMAGE_SQL
    + """,
grid AS (
  SELECT i.*, x, y, (x*31 + y*17 + image_id*13) % 9 AS noise, (x >= bx AND x < bx+bw AND y >= by_ AND y < by_+bh) AS inbox
  FROM images i CROSS JOIN xs CROSS JOIN ys),
marked AS (SELECT *, (inbox AND (x-bx) % 4 < 2 AND (y-by_) % 8 BETWEEN 2 AND 5) AS is_text FROM grid),
pixels AS (
  SELECT image_id, x, y, bx, by_, bw, bh, width, height, inbox, is_text,
         CASE WHEN is_text THEN 20+noise ELSE 100 + (image_id*7 + x*3 + y) % 96 END AS b,
         CASE WHEN is_text THEN 22+noise ELSE  90 + (image_id*5 + x + y*2) % 96 END AS g,
         CASE WHEN is_text THEN 24+noise ELSE 110 + (image_id*3 + x*2 + y) % 96 END AS r
  FROM marked)"""
)

DETECTION_SQL = """
detections AS (
  SELECT user_id AS image_id, event_id AS det_id,
         CASE event_id % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'doctr' ELSE 'easyocr' END AS detector, CAST(event_id % 3 AS INT) AS detector_rank,
         (event_id*37) % 400 AS x, (event_id*53) % 300 AS y, 20 + (event_id*11) % 60 AS w, 10 + (event_id*7) % 30 AS h,
         CAST((event_id*29) % 100 AS DOUBLE)/100 AS conf
  FROM events)"""

COMPONENT_SQL = """
components AS (
  SELECT l_suppkey AS image_id, CAST(l_partkey % 400 AS DOUBLE) AS cx, CAST(l_quantity AS DOUBLE) AS cy, CAST(l_linenumber*20 + l_partkey % 7 AS DOUBLE) AS area
  FROM lineitem)"""

TIMING_SQL = """
timings AS (
  SELECT o_orderkey AS image_id,
         CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'rotation' WHEN 2 THEN 'target_color' WHEN 3 THEN 'gray_enhancement' WHEN 4 THEN 'white_enhancement' ELSE 'watermark' END AS failover_type,
         CAST((o_orderkey*7) % 500 AS DOUBLE)/100 AS detection_time,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST((o_custkey*3) % 300 AS DOUBLE)/100 END AS color_time,
         CAST((o_orderkey*11) % 200 AS DOUBLE)/100 AS inpaint_time, CAST(o_orderkey % 4 AS INT) AS consensus_boxes_count
  FROM orders)"""

#: Score-map cells of a detector: one a line item, angles far from where truncation would flip.
CELL_SQL = """
cells AS (
  SELECT l_suppkey AS image_id, (l_partkey % 80) AS cx, (l_orderkey % 80) AS cy, CAST((l_partkey * 13) % 100 AS DOUBLE) / 100 AS score,
         CAST(l_partkey % 17 AS DOUBLE) + 3.25 AS d0, CAST(l_orderkey % 23 AS DOUBLE) + 5.25 AS d1, CAST(l_linenumber AS DOUBLE) + 4.25 AS d2,
         CAST(l_partkey % 11 AS DOUBLE) + 2.25 AS d3, CAST(l_orderkey % 7 - 3 AS DOUBLE) / 20 AS angle
  FROM lineitem)"""

#: table: (its text, the table that it comes from)
TABLES = {
    "images": (IMAGE_SQL, "part"), "pixels": (PIXEL_SQL, "part"), "detections": (DETECTION_SQL, "events"),
    "components": (COMPONENT_SQL, "lineitem"), "timings": (TIMING_SQL, "orders"), "cells": (CELL_SQL, "lineitem"),
}


#: Images of which a task makes the pixels.
IMAGES = 50


def spread(parts: DataFrame) -> DataFrame:
    """The parts that are images, in as many tasks as their pixels need: ``IMAGES`` a task at most on average.

    A file of parts is read by one task and an image of it becomes 3,072 rows. Dealt before that by the key, images come with all
    their pixels in one task, so what works by image afterwards needs no further shuffle.
    """
    return _images(parts).repartition(_tasks(parts), "p_partkey")


def _images(parts: DataFrame) -> DataFrame:
    return parts.where("p_partkey % 50 = 0").select("p_partkey")


def _tasks(parts: DataFrame) -> int:
    n = _images(parts).count()
    least = min(n, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, least, -(-n // IMAGES))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks ``load`` makes the pixels, for steps that send them on."""
    return _tasks(spark.read.parquet(f"{sf_dir}/part.parquet"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, base = TABLES[name]
    body = text.replace(f"FROM {base}", "FROM {base}")
    rows = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return spark.sql(f"WITH {body} SELECT * FROM {name}", base=spread(rows) if name == "pixels" else rows)


def sql(name: str, query: str, recursive: bool = False) -> str:
    """``query`` over the table ``name``, for the engine that checks."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{TABLES[name][0].strip()}{query if query.lstrip().startswith(',') else ' ' + query}"
