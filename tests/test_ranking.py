"""Places and order statistics of large and awkward groups against plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.operators import ranking
from burstlake.operators.ranking import numbered, percentiles
from burstlake.operators.signal import series_normalize


def test_numbers_in_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 50 == 0 else "hot" if k % 3 == 0 else f"f{k % 7}", int(t)) for k, t in enumerate(rng.permutation(5000))]
    rows += [("hot", None), ("hot", 17), ("hot", 17)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "file string, t long").repartition(4)
        got = {}
        for r in numbered(df, ("file",), ["t"]).collect():
            got.setdefault(r.file, []).append((r.place, r.t, r["size"]))
        alone = numbered(df.select("t"), (), [F.desc("t")], "k", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for file in {f for f, _ in rows}:
        mine = sorted(got[file])
        want = sorted((t for f, t in rows if f == file), key=lambda t: (t is not None, t or 0))
        assert [p for p, _, _ in mine] == list(range(len(want))) and [t for _, t, _ in mine] == want and {n for _, _, n in mine} == {len(want)}
    assert sorted((r.k, r.n) for r in alone) == [(k, len(rows)) for k in range(len(rows))]
    assert numbered(df.limit(0), ("file",), ["t"]).count() == 0


def plain(values, p):
    x = sorted(v for v in values if v is not None)
    if not x:
        return None
    pos = p * (len(x) - 1)
    a, b = x[math.floor(pos)], x[math.ceil(pos)]
    return a if pos % 1 == 0 else (1 - pos % 1) * a + pos % 1 * b


@pytest.mark.parametrize("finish", [50_000, 300])
def test_percentiles_of_groups(spark, monkeypatch, finish):
    """The same with groups gathered whole and narrowed to 40 rows or one value: ties, outliers, nulls, a null key, hot values."""
    monkeypatch.setattr(ranking, "FINISH", finish)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(0, 1, 3000).tolist(), "ties": rng.integers(0, 4, 2000).astype(float).tolist(), "hot": [7.0] * 1500 + rng.normal(7, 1e-9, 400).tolist(),
        "outliers": [1e300, -1e300, math.inf, -math.inf] + rng.uniform(-1e-9, 1e-9, 900).tolist(), "one": [5.0], "two": [1.0, 2.0], "nulls": [None, None], None: [3.0, None, 4.0, 8.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    got = {r.g: r for r in percentiles(df, ("g",), "v", lo=0.05, mid=0.5, hi=0.95, third=F.least(F.lit(3), F.col("m") - 1)).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        x = sorted(v for v in vs if v is not None)
        for name, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.95)):
            want = plain(vs, p)
            assert (got[g][name] is None and want is None) or got[g][name] == pytest.approx(want, rel=1e-12), (g, name)
        assert got[g].third == (x[min(3, len(x) - 1)] if x else None)
    every = [v for vs in groups.values() for v in vs if v is not None and math.isfinite(v)]
    finite = df.where("v < 1e301 and v > -1e301")
    assert percentiles(finite, (), "v", mid=0.5).first().mid == plain(every, 0.5)
    assert percentiles(finite.limit(0), (), "v", mid=0.5).first().mid is None and percentiles(finite.limit(0), ("g",), "v", mid=0.5).count() == 0


@pytest.mark.parametrize("finish", [50_000, 60])
def test_series_as_one_block(spark, monkeypatch, finish):
    monkeypatch.setattr(ranking, "FINISH", finish)
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(5, 2, 500), "ties": rng.integers(0, 3, 333).astype(float), "flat": np.full(90, 4.0), "short": np.array([1.0, 9.0])}
    df = spark.createDataFrame([(f, t, float(v)) for f, x in series.items() for t, v in enumerate(x)], "file string, t long, s double")
    got = {(r.file, r.t): r.z for r in series_normalize(df, keys=("file",)).collect()}
    for f, x in series.items():
        d = np.sort(x - np.median(x))
        c = len(d) // 40
        sigma = math.sqrt((d[c : len(d) - c] ** 2).sum() / (0.95 * len(d))) * 1.148
        want = (x - np.median(x)) / (sigma if sigma > 0 else 1.0)
        assert np.allclose([got[f, t] for t in range(len(x))], want, atol=1e-9)
