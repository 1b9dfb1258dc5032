"""From many files to whole candidate tables, read in tasks alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.operators import dedisperse, search
from burstlake.sources import catalog, recordings, scan
from tests.test_sources import write_filterbank, write_psrfits


@pytest.fixture
def no_driver_reads(monkeypatch):
    """The driver opens no file; tasks have modules of their own."""

    def refuse(path):
        raise AssertionError(f"the driver opened {path}")

    monkeypatch.setattr(recordings, "open_path", refuse)


def paths(spark, folder):
    return spark.createDataFrame([(str(p),) for p in sorted(folder.iterdir())] + [(None,)], "path string")


def test_ranges_bins_and_errors(spark, tmp_path, no_driver_reads):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 200, (103, 2, 8)), rng.integers(0, 16, (5, 16, 4, 8))
    write_filterbank(tmp_path / "a.fil", a, 1.0)
    write_psrfits(tmp_path / "b.fits", b, range(5))
    (tmp_path / "c.fil").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(b"nothing")
    (tmp_path / "e.fits").write_bytes(b"")
    files = paths(spark, tmp_path)
    got = scan.scan(files, time_rate=4, freq_rate=3, samples=10).collect()
    errors = {r.file.rsplit("/", 1)[1]: r.error for r in got if r.error}
    assert errors.keys() == {"c.fil", "d.txt", "e.fits"} and all(r.pols is None and r.t is None for r in got if r.error)
    mine = {r.t: r.pols for r in got if r.file.endswith("a.fil")}
    want = a[:100, :, :6].reshape(25, 4, 2, 2, 3).mean(4).sum(1)
    assert sorted(mine) == list(range(25)) and np.allclose([mine[t] for t in range(25)], want)
    plain = {r.t: r.pols for r in scan.scan(files.where("path like '%b.fits'"), samples=7, first=3, last=40).collect()}
    whole = (2 * b + 1).reshape(80, 4, 8)[:, :, ::-1]  # scaled by 2, offset 1, channels falling
    assert sorted(plain) == list(range(3, 40)) and np.allclose([plain[t] for t in range(3, 40)], whole[3:40]) and {r.n for r in got if r.file.endswith("a.fil")} == {25}
    assert scan.scan(files.limit(0)).count() == 0


def test_thousands_of_files(spark, tmp_path, no_driver_reads):
    for k in range(2000):
        write_filterbank(tmp_path / f"f{k}.fil", np.full((3, 1, 4), k % 200), 1.0)
    got = scan.scan(paths(spark, tmp_path), most_tasks=8).select("file", "t", F.element_at(F.get("pols", F.lit(0)), 1).alias("x")).groupBy("file").agg(F.count("*").alias("n"), F.max("x").alias("x")).collect()
    assert len(got) == 2000 and {r.n for r in got} == {3} and all(r.x == int(r.file.rsplit("/f", 1)[1][:-4]) % 200 for r in got)


@pytest.mark.parametrize("kind", ["filterbank", "psrfits"])
def test_from_files_to_candidates(spark, tmp_path, kind):
    """A dispersed, polarised pulse in a file is one row of the whole candidate table, at its time and dispersion."""
    rng = np.random.default_rng(4)
    n, chans, dm, at = 2048, 32, 20.0, 900
    freq = 1400.0 + 100 / 31 * np.arange(chans)
    late = dedisperse.delay_matrix([dm], freq, 1e-3, freq.max())[0]
    data = rng.normal(100, 5, (n, 4, chans))
    for c in range(chans):
        data[at + late[c] - 1 : at + late[c] + 2, :2, c] += 60
    data = data.clip(0, 255).round().astype(int)
    if kind == "filterbank":
        write_filterbank(tmp_path / "run.fil", data[:, :, ::-1], -100 / 31)
    else:
        write_psrfits(tmp_path / "run.fits", data[:, :, ::-1].reshape(-1, 64, 4, chans), range(n // 64), bits=8)
    spectra = scan.stokes(scan.scan(paths(spark, tmp_path)))
    grid = dedisperse.delays(dedisperse.dm_grid(spark, 0, 120, 13), dedisperse.channels(spark, chans, 1400.0, 100 / 31), 1e-3, float(freq.max()))
    found = search.search(spectra, grid, 1e-3, F.lit(58000.0), threshold=6.0)
    table = search.whole_candidates(found, spectra, grid, 1e-3, patch=64)
    assert [c for c, _ in table.dtypes] == [c.strip().rsplit(" ", 1)[0].strip("`") for c in catalog.CANDIDATE_COLUMNS.split(", ")]
    best = table.orderBy(F.desc("snr_patch_dedispersed")).first()
    assert at - 2 <= best.t_sample <= at + late.max() + 2 and abs(best["dm_pc_cm-3"] - dm) <= 20 and best.snr_patch_dedispersed > 6
    assert (best.slice_id, best.chunk_id, best.band_id, best.y1, best.y2) == (1, 0, 0, 0, 511) and best.x1 < best.t_sample - 512 < best.x2
    assert best.patch_file == f"run_slice1_sample{best.t_sample}_band0" and best.is_burst and best.snr_patch_dedispersed_linear is not None
