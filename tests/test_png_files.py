"""Image files are written all or not at all."""

import os

import numpy as np
import pytest

from inkframe.sources import images, png_files


def rows(spark, names):
    made = [(n, bytearray(images.png(np.full((4, 5, 3), 10 * k, np.uint8)))) for k, n in enumerate(names)]
    return spark.createDataFrame(made, "file string, png binary").repartition(3)


def test_files_by_name_can_be_read(spark, tmp_path):
    out = str(tmp_path / "out")
    names = [f"im{k}_clean.png" for k in range(7)]
    png_files.write_files(rows(spark, names), out)
    assert sorted(os.listdir(out)) == names
    found, errors = images.read_images(spark, out)
    assert found.count() == 7 and errors.isEmpty() and {(r.width, r.height) for r in found.collect()} == {(5, 4)}
    png_files.write_files(rows(spark, ["more.png", *names[:2]]), out)
    assert sorted(os.listdir(out)) == [*names, "more.png"]


@pytest.mark.parametrize("bad", [None, "", "a/b.png", "im1.png"])
def test_a_failure_leaves_no_file(spark, tmp_path, bad):
    """A name that is none, one that leads elsewhere, or one that there is already: nothing but what a task still running may stage."""
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="image"):
        png_files.write_files(rows(spark, ["im0.png", "im1.png", "im2.png", bad]), out)
    assert not os.path.isdir(out) or all(n.startswith("_staging-") for n in os.listdir(out))
