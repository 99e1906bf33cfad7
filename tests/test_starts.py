"""Clustering from several starts."""

import contextlib
import io

import numpy as np

from inkframe import queries
from inkframe.operators import quantize

SF = "/root/testdata/sf0.01"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_starts_run_once(spark):
    assert plan(queries.queries()["kmeans_restarts"](spark, SF)).count("FlatMapGroupsInPandas") == 1


def test_clusters_of_close_centres_are_those_of_plain_distances():
    rng = np.random.default_rng(3)
    for _ in range(50):
        points = rng.integers(0, 9, (400, 3)).astype(float)  # very many ties
        weight, k = rng.integers(1, 5, 400).astype(float), 24
        number, centres = np.arange(k), points[:k]
        for _ in range(6):
            at = sum(np.square(points[:, c, None] - centres[:, c]) for c in range(3)).argmin(axis=1)
            total = np.bincount(at, weight, len(centres))
            means = np.stack([np.bincount(at, weight * c, len(centres)) for c in points.T], axis=1)
            number, centres = number[total > 0], means[total > 0] / total[total > 0, None]
        at = sum(np.square(points[:, c, None] - centres[:, c]) for c in range(3)).argmin(axis=1)
        assert (quantize.fit(points, weight, k, 6) == number[at]).all()
