"""The search from recordings to candidates, polarisations and models, on small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.functions import astro
from burstlake.operators import dedisperse, models, search, timegrid


def chosen(pols, mode, kind):
    """What each way to ask for a polarisation means."""
    if not pols:
        return None
    name = (mode or "").strip().lower()
    if len(pols) == 1:
        return pols[0]
    if name[:3] == "pol":
        rest = name[3:]
        return pols[min(int(rest), len(pols) - 1) if rest.isdigit() else 0]
    if (kind or "").strip().upper() == "IQUV" and len(pols) >= 4:
        composed = {"l": math.hypot(pols[1], pols[2]), "v": abs(pols[3])}
        return composed.get({"linear": "l", "lineal": "l", "circular": "v", "c": "v"}.get(name, name), pols[0])
    return pols[0]


def test_select_pol(spark):
    rows = [(p, m, k) for p in (None, [], [1.0], [1.0, 2.0], [1.0, 3.0, 4.0, -2.0]) for m in (None, "", "i", " L ", "lineal", "C", "pol1", "pol9", "polx", "odd") for k in ("IQUV", " iquv", "AABB", None)]
    df = spark.createDataFrame(rows, "p array<double>, m string, k string")
    for r in df.select("*", search.select_pol(F.col("p"), F.col("m"), F.col("k")).alias("x")).collect():
        want = chosen(r.p, r.m, r.k)
        assert r.x == want or r.x == pytest.approx(want), r


def planted(spark, at=(700, 1500), dm=60.0, n=2048):
    """A recording of noise with dispersed pulses, the first with linear polarisation; a second file of the same noise alone."""
    rng = np.random.default_rng(4)
    chans = [(1200.0 + 25.0 * c) for c in range(16)]
    late = [int(4150.0 * dm * (1 / f**2 - 1 / chans[-1] ** 2) / 1e-3) for f in chans]
    i, q, u = (rng.normal(0, 100, (n, 16)).round().astype(int) for _ in range(3))
    plain = i.copy()
    for k, t in enumerate(at):
        for c in range(16):
            i[t + late[c], c] += 3000
            if k == 0:
                q[t + late[c], c] += 3000
    rows = [(f, t, x[t].tolist(), q[t].tolist() if f == "a" else [0] * 16, u[t].tolist() if f == "a" else [0] * 16) for f, x in (("a", i), ("b", plain)) for t in range(n)]
    return spark.createDataFrame(rows, "file string, t long, i array<bigint>, q array<bigint>, u array<bigint>")


def test_trial_of_planted_pulses(spark):
    s = planted(spark)
    delay = dedisperse.delays(dedisperse.dm_grid(spark, 0, 200, 21), dedisperse.channels(spark, 16, 1200.0, 25.0), 1e-3, 1575.0)
    peaks = spark.createDataFrame([("a", 700), ("a", 1500)], "file string, t long")
    assert {(r.t, r.dm_idx) for r in search.dm_at(peaks, s, delay, ("file",)).collect()} == {(700, 6), (1500, 6)}
    flat = s.withColumn("i", F.array_repeat(F.lit(5).cast("bigint"), 16))
    assert {r.dm_idx for r in search.dm_at(peaks, flat, delay, ("file",)).collect()} == {10}


def test_search_gives_candidates_and_phases(spark):
    s = planted(spark, dm=0.0)
    delay = dedisperse.delays(dedisperse.dm_grid(spark, 0, 200, 21), dedisperse.channels(spark, 16, 1200.0, 25.0), 1e-3, 1575.0)
    got = search.search(s, delay, 1e-3, F.lit(60000.0), threshold=90.0)
    rows = got.collect()
    assert [(r.file, r.t_sample) for r in sorted(rows, key=lambda r: r.t_sample)] == [("a", 700), ("a", 1500)]
    assert all(r["dm_pc_cm-3"] == 0.0 and r.is_burst_intensity and r.width_ms == 1.0 for r in rows)
    assert {r.t_sample: r.is_burst_linear for r in rows} == {700: True, 1500: False}
    (n,) = search.phase_counts(got, 90.0).collect()
    assert (n.phase_1, n.phase_2, n.phase_1_3a, n.phase_1_3a_3b) == (2, 1, 2, 1)
    # Wide filters reach a threshold earlier than the pulse; the highest sample of the slice stays beside those peaks.
    low = search.search(s, delay, 1e-3, F.lit(60000.0), threshold=12.0)
    assert {700, 1500} <= {r.t_sample for r in low.where("file = 'a'").collect()}
    assert search.search(s.limit(0), delay, 1e-3, F.lit(60000.0)).count() == 0


def test_patches_stay_within_the_recording(spark):
    n, length, rows = 120, 64, []
    for t in range(n):
        rows.append(("a", t, [1000 * c + t for c in range(4)]))
    rows += [("short", t, [t] * 4) for t in range(20)]
    s = spark.createDataFrame(rows, "file string, t long, spec array<bigint>")
    late = [30, 12, 5, 0]
    delay = spark.createDataFrame(list(enumerate(late)), "c int, delay long")
    peaks = [0, 40, 60, 119]
    p = spark.createDataFrame([("a", k) for k in peaks] + [("short", 3)], "file string, peak long")
    got = {(r.file, r.peak, r.x, r.c): r.value for r in dedisperse.patches(p, s, delay, length, ("file",)).collect()}
    want = {}
    for k in peaks:
        first = min(max(0, k - length // 2), n - length - max(late))
        want |= {("a", k, x, c): 1000 * c + first + x + late[c] for x in range(length) for c in range(4)}
    assert got == want


def test_grids(spark):
    p = spark.createDataFrame([(511, 1e-5), (512, 1e-3), (1280, 49.152e-6), (4096, 2e-4)], "nchan int, dt double")
    freq, time = timegrid.auto_rates(F.col("nchan"), F.col("dt"))
    assert [tuple(r) for r in p.select(freq, time).collect()] == [(1, 78), (1, 1), (2, 16), (8, 3)]
    s = spark.createDataFrame([(0, 100), (90, 100), (96, 100), (120, 100)], "first int, n int")
    assert [(r.first, r.stop) for r in timegrid.valid_slices(s, 20).collect()] == [(0, 20), (90, 100)]
    v = spark.createDataFrame([(0, 0, 1.0), (1, 0, float("nan")), (2, 0, float("nan")), (1, 1, None)], "t int, c int, v double")
    assert {r.t_bin: r.value for r in timegrid.nanmean_bin(v, 2, 2).collect()} == {0: 1.0, 1: None}


def test_models(spark):
    df = spark.createDataFrame([(1, [1.0, 9.0]), (2, None), (3, []), (4, [5.0, 5.0]), (5, [1.0])], "k int, patch array<double>")
    got = {r.k: r.prob for r in models.classify(df, models.Logistic(5.0), shape=(1, 2)).collect()}
    assert got[2] is got[3] is got[5] is None and got[4] == 0.5
    same = spark.range(1).select(astro.logistic(F.lit(9.0), 5.0)).first()[0]
    assert got[1] == pytest.approx(same)
    assert models.classify(df.limit(0), models.Logistic(5.0)).count() == 0


def test_detector(spark):
    class Brightest:
        def detect(self, image):
            y, x = np.unravel_index(image.argmax(), image.shape)
            top = float(image.max())
            return [(x, y, x + 2.0, y + 2.0, top), (x, y, x + 2.0, y + 2.0, top - 0.1), (0.0, 0.0, 1.0, 1.0, 0.1)]

    df = spark.createDataFrame([("a", [0.0, 0.9, 0.0, 0.0]), ("b", [0.2] * 4), ("c", None), ("d", [1.0])], "image string, pixels array<double>")
    got = models.detect(df, Brightest(), (2, 2), 0.3).collect()
    assert [(r.image, r.box_id, r.x1, r.y1) for r in got] == [("a", 0, 1.0, 0.0)]


def test_reports_with_either_names(spark):
    from burstlake.operators import metrics

    texts = [
        '{"dm_cube": {"dm_max": 100.5, "delta_t_max_seconds": 2.0}, "overlap_validation": {"overlap_decimated_samples": 7, "no_edge_losses": true}, "actual_processing": {"chunks_processed": 3}}',
        '{"overlap_validation": {"overlap_decimated": 9, "overlap_decimated_samples": 7}, "chunks": []}', "no json", None,
    ]
    reports = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, report string")
    got = {r.k: tuple(r)[1:] for r in metrics.overlap_summary(reports, "report", "k").collect()}
    assert got == {0: (100.5, 2.0, 7, 3, True), 1: (None, None, 9, 0, False), 2: (None, None, None, 0, False), 3: (None, None, None, 0, False)}
    assert metrics.chunk_continuity(reports, "report", "k").count() == 0
