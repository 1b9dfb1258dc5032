"""The dedispersion kernel against sums over every trial, channel and time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.operators import dedisperse


def brute(rows, dms, freqs, dt, top, width=None, mid=None):
    """rows: (key, t, spec); returns {(key, dm_idx, t): (full, mid)}."""
    delay = np.trunc(4.15e3 * np.asarray(dms)[:, None] * (1.0 / (freqs * freqs) - 1.0 / (top * top))[None] / dt).astype(int)
    total, n, centre = {}, {}, {}
    for key, t, spec in rows:
        if spec is None:
            continue
        for c, v in enumerate(spec[: len(freqs)]):
            for k in range(len(dms)):
                at = t - delay[k, c]
                if at >= 0 and (width is None or at < width):
                    total[key, k, at] = total.get((key, k, at), 0) + (v or 0)
                    n[key, k, at] = n.get((key, k, at), 0) + 1
                    if c == mid:
                        centre[key, k, at] = centre.get((key, k, at), 0) + (v or 0)
    return {x: (total[x] / n[x], float(centre.get(x, 0))) for x in total}


def got(df):
    return {(r["file"], r["dm_idx"], r["t"]): (r["full"], r["mid"]) for r in df.collect()}


@pytest.mark.parametrize("values", [1 << 21, 3000, 200])
@pytest.mark.parametrize("width", [None, 70])
def test_kernel_equals_sums(spark, values, width):
    """One chunk, several chunks, and bands of channels; gaps, repeated rows, nulls, short and long arrays, two files."""
    rng = np.random.default_rng(1)
    freqs = 1200.0 + 25.0 * np.arange(12)
    rows = [(f, t, rng.integers(-50, 50, 12).tolist()) for f, n in (("a", 150), ("b", 40)) for t in range(n) if t % 11]
    rows += [("a", 33, [1] * 12), ("a", 34, [5] * 12), ("a", 44, None), ("a", 55, [None, 3, None]), ("a", 66, list(range(20))), ("b", 0, [])]
    dms = np.linspace(0, 90, 19)
    df = spark.createDataFrame(rows, "file string, t long, spec array<int>").repartition(3)
    plane = dedisperse.cube(df, dms, freqs, 1e-3, 1475.0, width=width, keys=("file",), mid=6, trials=7, values=values)
    assert got(plane) == brute(rows, dms, freqs, 1e-3, 1475.0, width, 6)
    _, wide, length = dedisperse.tiling(dms, freqs, 1e-3, 1475.0, 7, values)
    assert (wide < 12) == (values == 200) and (length < 300) == (values < 1 << 21)


def test_real_numbers_empty_table_and_one_trial(spark):
    freqs = np.array([1300.0, 1350.0, 1400.0])
    rows = [("a", t, [t / 7, -t / 3, 0.25]) for t in range(50)]
    df = spark.createDataFrame(rows, "file string, t long, spec array<double>")
    plane, want = got(dedisperse.cube(df, [33.0], freqs, 1e-3, 1400.0, keys=("file",), mid=1)), brute(rows, [33.0], freqs, 1e-3, 1400.0, mid=1)
    assert plane.keys() == want.keys() and all(np.allclose(plane[k], want[k], rtol=1e-12) for k in want)
    assert dedisperse.cube(df.limit(0), [33.0, 40.0], freqs, 1e-3, 1400.0, keys=("file",)).count() == 0
    assert dedisperse.cube(df, [], freqs, 1e-3, 1400.0, keys=("file",)).count() == 0


def test_two_thousand_trials(spark):
    """A pulse is found at its dispersion among 2,000 trials; rows are multiplied by blocks of trials, not by trials."""
    rng = np.random.default_rng(2)
    freqs = 1200.0 + 6.25 * np.arange(32)
    dms, at, true = np.linspace(0, 500, 2000), 120, 1234
    late = dedisperse.delay_matrix([dms[true]], freqs, 1e-4, freqs.max())[0]
    x = rng.integers(0, 20, (3000, 32))
    for c in range(32):
        x[at + late[c], c] += 400
    df = spark.createDataFrame([("a", t, r) for t, r in enumerate(x.tolist())], "file string, t long, spec array<int>")
    plane = dedisperse.cube(df, dms, freqs, 1e-4, float(freqs.max()), width=400, keys=("file",))
    assert plane.count() == 2000 * 400
    best = dedisperse.best_dm(plane).orderBy(F.desc("peak")).first()
    assert best.t == at and abs(best.dm_idx - true) <= 1
    tiles, wide, length = dedisperse.tiling(dms, freqs, 1e-4, float(freqs.max()), 256, 1 << 21)
    assert len(tiles) == 8 and wide == 32
    some = plane.where("dm_idx in (0, 777, 1999) and t % 97 = 5").collect()
    delay = dedisperse.delay_matrix(dms, freqs, 1e-4, freqs.max())
    for r in some:
        seen = [x[r.t + d, c] for c, d in enumerate(delay[r.dm_idx]) if r.t + d < 3000]
        assert r.full == sum(seen) / len(seen)
    assert len(some) > 10


def test_delays_equal_the_columns(spark):
    freqs = 1100.0 + 3.7 * np.arange(40)
    grid, chans = dedisperse.dm_grid(spark, 0, 900, 31), dedisperse.channels(spark, 40, 1100.0, 3.7)
    table = {(r.dm_idx, r.c): r.delay for r in dedisperse.delays(grid, chans, 3.3e-4, 1200.0).collect()}
    matrix = dedisperse.delay_matrix([0.0 + k * 30.0 for k in range(31)], freqs, 3.3e-4, 1200.0)
    assert all(matrix[k, c] == d for (k, c), d in table.items()) and (matrix < 0).any()
