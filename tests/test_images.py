"""Network inputs and output maps by hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.operators import boxes, images


def test_resize_is_bilinear():
    x = np.array([[0.0, 10.0], [20.0, 30.0]])
    assert np.allclose(images.resize(x, 4, 4), [[0, 2.5, 7.5, 10], [5, 7.5, 12.5, 15], [15, 17.5, 22.5, 25], [20, 22.5, 27.5, 30]])
    assert np.array_equal(images.resize(x, 2, 2), x) and images.resize(x, 1, 1)[0, 0] == 15.0
    plane = np.add.outer(3.0 * np.arange(50), 2.0 * np.arange(80))
    big = images.resize(plane, 100, 160)
    assert np.allclose(np.diff(big[10:90, 20:140], axis=1), 1.0) and np.allclose(np.diff(big[10:90, 20:140], axis=0), 1.5)


def test_inputs_and_the_way_back(spark):
    rng = np.random.default_rng(1)
    plane = rng.normal(0, 1, (20, 30))
    plane[5, 7] = 50.0
    odd = plane.copy()
    odd[0, 0], odd[1, 1], odd[2, 2] = np.nan, np.inf, -np.inf
    rows = [(1, plane.ravel().tolist()), (2, [3.0] * 600), (3, odd.ravel().tolist()), (4, [float("nan")] * 600), (5, None), (6, [1.0] * 7)]
    colours = np.stack([np.linspace(0, 1, 256), np.linspace(1, 0, 256), np.full(256, 0.5)], 1)
    df = spark.createDataFrame(rows, "image long, pixels array<double>")
    got = {r.image: r.tensor for r in images.network_inputs(df, (20, 30), 64, colours).collect()}
    assert [k for k, v in got.items() if v is None] == [4, 5, 6]
    one = np.array(got[1]).reshape(3, 64, 64)
    seen = images.picture(one)
    assert seen.shape == (64, 64, 3) and seen[..., 0].min() == 0 and seen[..., 0].max() == 255 and np.all(np.abs(seen[..., 0].astype(int) + seen[..., 1] - 255) <= 1) and set(seen[..., 2].ravel()) <= {127, 128}
    assert np.unravel_index(seen[..., 0].argmax(), (64, 64)) in {(r, c) for r in range(14, 22) for c in range(12, 20)}
    flat = images.picture(np.array(got[2]).reshape(3, 64, 64))
    assert set(flat[..., 0].ravel()) == {0} and np.isfinite(got[3]).all()


def test_maps_give_known_boxes(spark):
    h, w = 4, 6
    heat, sizes, offsets = np.zeros((2, h, w)), np.zeros((2, h, w)), np.zeros((2, h, w))
    heat[0, 1, 2], heat[0, 1, 3], heat[1, 3, 5], heat[0, 3, 5], heat[0, 0, 0] = 0.9, 0.8, 0.7, 0.6, np.nan
    sizes[:, 1, 2], offsets[:, 1, 2], sizes[:, 3, 5] = (3.0, 2.0), (0.5, 0.25), (1.0, 1.0)
    flat = [x.ravel().tolist() for x in (heat, sizes, offsets)]
    rows = [("a", *flat), ("b", None, flat[1], flat[2]), ("c", flat[0][:-1], flat[1], flat[2]), ("d", [0.9] * 24, flat[1], flat[2]), ("e", [float("nan")] * 48, flat[1], flat[2])]
    df = spark.createDataFrame(rows, "image string, heat array<double>, sizes array<double>, offsets array<double>")
    got = images.decode(df, (h, w), 0.5).collect()
    mine = sorted(tuple(r)[1:] for r in got if r.image == "a")
    assert mine[0] == pytest.approx((8, 0, (2.5 - 1.5) / w, (1.25 - 1) / h, (2.5 + 1.5) / w, (1.25 + 1) / h, 0.9))
    assert mine[1] == pytest.approx((23, 1, 4.5 / w, 2.5 / h, 5.5 / w, 3.5 / h, 0.7)) and len(mine) == 2
    assert sum(r.image == "d" for r in got) == 24 and {r.image for r in got} == {"a", "d"}
    assert images.decode(df.limit(0), (h, w), 0.5).count() == 0 and images.decode(df.where("image = 'b'"), (h, w), 0.5).count() == 0
    kept = boxes.nms(images.decode(df.where("image = 'a'"), (h, w), 0.5).drop("kind"), "image", 0.3)
    assert kept.count() == 2 and kept.agg(F.max("score")).first()[0] == 0.9
