"""Detectors as plug-ins: opaque models that turn images into raw detections, one instance a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.operators import detections
from inkframe.sources.stored import stored

RAW = "image_id bigint, detector string, detector_rank int, det_id bigint, x bigint, y bigint, w bigint, h bigint, conf double, message string"


class Detector(Protocol):
    """What a model must offer: boxes (x, y, w, h, confidence) of one image (height x width x 3, b, g, r)."""

    def __call__(self, image: np.ndarray) -> list[tuple[int, int, int, int, float]]: ...


_loaded: dict[str, object] = {}


def pick_device(wanted: str = "cuda") -> str:
    """``wanted``, or cpu where that isn't to be had here."""
    if wanted != "cuda":
        return "cpu"
    try:
        import torch

        return "cuda" if torch.cuda.is_available() else "cpu"
    except ImportError:
        return "cpu"


def instance(name: str, load: Callable[[], object]) -> object:
    """The model ``name`` of this process, loaded at its first use."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def reset(name: str | None = None) -> None:
    """Forgets the model ``name`` of this process, or all of them."""
    _loaded.clear() if name is None else _loaded.pop(name, None)


def status(name: str, probe: Callable[[object], object] | None = None) -> dict[str, bool]:
    """Whether the model ``name`` is loaded in this process, and whether ``probe`` runs on it."""
    model = _loaded.get(name)
    healthy = model is not None
    if healthy and probe is not None:
        try:
            probe(model)
        except Exception:  # whatever ails the model
            healthy = False
    return {"loaded": model is not None, "healthy": healthy}


def retried(name: str, load: Callable[[], object], call: Callable[[object], object], again: bool = True) -> object:
    """``call`` on the model ``name``; when that fails, once more on a newly loaded one."""
    try:
        return call(instance(name, load))
    except Exception as first:
        if not again:
            raise
        reset(name)
        try:
            return call(instance(name, load))
        except Exception as second:
            raise RuntimeError(f"{name} failed twice: {first}; {second}") from second


def detect(images: DataFrame, name: str, load: Callable[[], Detector]) -> DataFrame:
    """RAW rows of detector ``name`` on ``images`` (image_id, width, height, channels, data).

    ``load`` runs once in each worker. An image on which the model fails gives one row with a message and
    no box, and the others go on.
    """
    rank = detections.DETECTORS.index(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = instance(name, load)
        for f in frames:
            out = []
            for r in f.itertuples():
                try:
                    a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                    found = model(np.repeat(a, 3, axis=2) if r.channels == 1 else a[:, :, :3])
                    out += [(r.image_id, name, rank, k, *map(int, b[:4]), float(b[4]), None) for k, b in enumerate(found)]
                except Exception as e:  # a model's failure is an image without boxes
                    out.append((r.image_id, name, rank, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")]).astype({k: "Int64" for k in ("det_id", "x", "y", "w", "h")})

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(run, RAW)


def detect_all(images: DataFrame, models: dict[str, Callable[[], Detector]], threshold: float, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(boxes, errors) of all given detectors together; one that is missing or fails adds no boxes. What they say is stored, so each runs once."""
    raw = None
    for name, load in models.items():
        part = detect(images, name, load)
        raw = part if raw is None else raw.unionByName(part)
    raw = stored(raw)
    boxes = detections.large_enough(detections.confident(raw.where("message IS NULL"), threshold), least).drop("message")
    errors = raw.where("message IS NOT NULL").select("image_id", F.concat(F.lit("detect "), "detector").alias("stage"), "message")
    return boxes, errors
