"""Masks of several clusters at once."""

import numpy as np

from inkframe.operators import tiles


def test_masks_run_together_are_those_run_alone():
    rng = np.random.default_rng(4)
    x, y = (c.ravel() for c in np.meshgrid(np.arange(31), np.arange(23)))
    given = rng.random(x.size) < 0.97
    x, y = x[given] + 5, y[given] + 7
    own = np.where(rng.random(x.size) < 0.15, 3, (x // 9 + y // 8) * 2)
    for cells in (1, 31 * 23 * 2, 1 << 22):
        got = dict(tiles.run_each(x, y, own, tiles.OPEN * 3, cells))
        assert sorted(got) == sorted(set(own.tolist()))
        for k, lit in got.items():
            assert (lit == (tiles.run_steps(x, y, np.where(own == k, 255, 0).astype(np.int32), tiles.OPEN * 3) > 0)).all()
