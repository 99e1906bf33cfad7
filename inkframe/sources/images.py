"""Image files: listing, reading to pixels, writing, and names of what is written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import color

#: Suffixes of image files.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp")


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path's last part, with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./?#]*)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES)


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the image files of a folder (not below it), or of one file, by path."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.where(is_image(F.col("path"))).orderBy("path")


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, errors) of all image files: images are (name, width, height, channels, data), data in b, g, r order.

    Files that don't decode are rows of ``errors`` (name, stage, message) instead of failing the read.
    """
    raw = spark.read.format("image").load(path).select("image.*")
    raw = raw.where(is_image(F.col("origin")))
    good = F.col("nChannels") > 0
    images = raw.where(good).select(F.col("origin").alias("name"), "width", "height", F.col("nChannels").alias("channels"), "data")
    return images, raw.where(~good).select(F.col("origin").alias("name"), F.lit("load").alias("stage"), F.lit("could not decode").alias("message"))


def to_pixels(images: DataFrame) -> DataFrame:
    """(image_id, x, y, b, g, r) of images with ``image_id``; gray ones get three equal channels, alpha is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels).astype(np.int64)
                a = np.repeat(a, 3, axis=2) if r.channels == 1 else a[:, :, :3]
                for lo in range(0, r.height, max(1, 500_000 // max(1, r.width))):
                    part = a[lo : lo + max(1, 500_000 // max(1, r.width))]
                    y, x = np.mgrid[lo : lo + len(part), 0 : r.width]
                    yield pd.DataFrame({"image_id": r.image_id, "x": x.ravel(), "y": y.ravel(), **{c: part[:, :, k].ravel() for k, c in enumerate("bgr")}})

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(run, "image_id bigint, x bigint, y bigint, b bigint, g bigint, r bigint")


def from_pixels(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, channels, data) of pixels b, g, r, one group an image: what ``to_pixels`` came from."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, y = f["x"].to_numpy(), f["y"].to_numpy()
        image = np.zeros((y.max() + 1, x.max() + 1, 3), np.uint8)
        image[y, x] = f[["b", "g", "r"]].to_numpy()
        return pd.DataFrame({"image_id": [f["image_id"].iloc[0]], "width": [image.shape[1]], "height": [image.shape[0]], "channels": [3], "data": [image.tobytes()]})

    return pixels.select("image_id", "x", "y", "b", "g", "r").groupBy("image_id").applyInPandas(run, "image_id bigint, width int, height int, channels int, data binary")


def read_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(masks, errors): ``read_images`` as (name, x, y, v), coloured ones as their gray value."""
    found, errors = read_images(spark, path)
    names = found.withColumn("image_id", F.xxhash64("name"))
    gray = color.luma(F.col("b"), F.col("g"), F.col("r"))
    rows = to_pixels(names).select("image_id", "x", "y", gray.cast("int").alias("v")).join(names.select("image_id", "name"), "image_id")
    return rows.select("name", "x", "y", "v"), errors


def png(a: np.ndarray, level: int = 8) -> bytes:
    """A PNG of an array H x W (gray) or H x W x 3 (r, g, b)."""
    a = np.ascontiguousarray(a, np.uint8)
    lines = np.concatenate([np.zeros((len(a), 1), np.uint8), a.reshape(len(a), -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def encode_png(pixels: DataFrame) -> DataFrame:
    """(image_id, png binary) of pixels b, g, r, one group an image; a table that any sink can store."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, y = (f[c].to_numpy() - f[c].min() for c in "xy")
        image = np.zeros((y.max() + 1, x.max() + 1, 3), np.uint8)
        image[y, x] = f[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"image_id": [f["image_id"].iloc[0]], "png": [png(image)]})

    return pixels.select("image_id", "x", "y", "b", "g", "r").groupBy("image_id").applyInPandas(run, "image_id bigint, png binary")


def output_names(name: Column) -> Column:
    """struct<clean, mask, error>: names of what is written for an image file."""
    file = F.regexp_extract(name, r"([^/]*)$", 1)
    stem, end = F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(file, r"(?<=.)(\.[^.]*)$", 1)
    return F.struct(F.concat(stem, F.lit("_clean"), end).alias("clean"), F.concat(stem, F.lit("_mask.png")).alias("mask"), F.concat(stem, F.lit(".txt")).alias("error"))
