"""Images of any order of axes, and array files, against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.sources import arrays, catalog, recordings, scan
from tests.test_sources import header


def image(path, data, order, bitpix=16, first=True, **more):
    """data: (time, pol, channel); order: the axes from the fastest on, of t, p and f."""
    data, axes = (data, {"t": 0, "p": 1, "f": 2}) if "p" in order else (data[:, 0], {"t": 0, "f": 1})
    raw = np.transpose(data, [axes[a] for a in order[::-1]]).astype(recordings.IMAGE_KINDS[bitpix]).tobytes()
    names = {"t": ("TIME", 0.0, 2e-3), "p": ("STOKES", 1.0, 1.0), "f": ("FREQ-OBS", 1500.0, -2.0)}
    cards = [("SIMPLE", "T") if first else ("XTENSION", "IMAGE"), ("BITPIX", bitpix), ("NAXIS", len(order))]
    cards += [(f"NAXIS{k}", data.shape[axes[a]]) for k, a in enumerate(order, 1)]
    for k, a in enumerate(order, 1):
        cards += [(f"CTYPE{k}", names[a][0]), (f"CRVAL{k}", names[a][1]), (f"CDELT{k}", names[a][2]), (f"CRPIX{k}", 1)]
    path.write_bytes(header(*cards, *more.items()) + raw.ljust(-(-len(raw) // 2880) * 2880, b"\0"))


@pytest.mark.parametrize("order", ["".join(p) for p in itertools.permutations("tpf")] + ["ft", "tf"])
def test_images_in_ranges_equal_whole(spark, tmp_path, order):
    rng = np.random.default_rng(1)
    data = rng.integers(-500, 500, (37, 3 if "p" in order else 1, 8))
    image(tmp_path / "a.fits", data, order, BSCALE=0.5, BZERO=10.0)
    want = (data * 0.5 + 10)[:, :, ::-1]
    recordings.register(spark)
    got = spark.read.format("fits").option("samples", 10).load(str(tmp_path / "a.fits")).collect()
    assert len(got) == 37 * data.shape[1] and all(np.allclose(r.spec, want[r.sample_idx, r.pol]) for r in got)
    part = spark.read.format("fits").load(str(tmp_path / "a.fits")).where("sample_idx >= 11 and sample_idx < 23").collect()
    assert {r.sample_idx for r in part} == set(range(11, 23)) and all(np.allclose(r.spec, want[r.sample_idx, r.pol]) for r in part)
    files = spark.createDataFrame([(str(tmp_path / "a.fits"),)], "path string")
    p = catalog.obs_params(files).first()
    assert (p.nsamples, p.nchan, p.npol, p.nbits, p.tsamp, p.freq_low, p.freq_high, p.error) == (37, 8, 3 if "p" in order else None, 16, 2e-3, 1486.0, 1500.0, None)
    wide = {r.t: r.pols for r in scan.scan(files, samples=7).collect()}
    assert np.allclose([wide[t] for t in range(37)], want)


@pytest.mark.parametrize("bitpix", [8, 32, 64, -32, -64])
def test_numbers_blanks_and_errors(spark, tmp_path, bitpix):
    data = np.arange(5 * 2 * 4).reshape(5, 2, 4)
    image(tmp_path / "a.fits", data, "fpt", bitpix, BLANK=3)
    files = spark.createDataFrame([(str(tmp_path / "a.fits"),), (str(tmp_path / "cut.fits"),)], "path string")
    (tmp_path / "cut.fits").write_bytes((tmp_path / "a.fits").read_bytes()[:2890])
    got = scan.scan(files).collect()
    want = data.astype(float)[:, :, ::-1].copy()
    if bitpix > 0:
        want[0, 0, 0] = np.nan
    assert np.allclose([r.pols for r in sorted((r for r in got if not r.error), key=lambda r: r.t)], want, equal_nan=True)
    assert [r.file[-8:] for r in got if r.error] == ["cut.fits"]


def test_array_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {
        "burst/a": rng.normal(size=(7, 3, 2)), "burst/b": np.asfortranarray(rng.normal(size=(9, 4)).astype(">f4")), "noise/c": rng.integers(0, 9, 11).astype(np.int16), "noise/d": np.array(5.0),
        "noise/e": np.empty((0, 3)), "noise/f": np.asfortranarray(rng.integers(0, 255, (5, 2, 3)).astype(np.uint8)), "noise/g": np.array([True, False]), "noise/h": np.empty((3, 0)),
    }
    for name, x in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        np.save(tmp_path / f"{name}.npy", x)
    bad = {"noise/objects": np.array([None, 1], object), "noise/records": np.zeros(3, [("a", "i4")]), "noise/text": np.array(["x"])}
    for name, x in bad.items():
        np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / "noise/short.npy").write_bytes((tmp_path / "burst/a.npy").read_bytes()[:-8])
    (tmp_path / "noise/nothing.npy").write_bytes(b"")
    with (tmp_path / "noise/v3.npy").open("wb") as f:
        np.lib.format.write_array(f, np.arange(4.0), version=(3, 0))
    files = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*.npy")] + [(str(tmp_path / "absent.npy"),), (None,)], "path string")
    for values in (1 << 22, 8):
        rows = arrays.read_arrays(files, values).collect()
        got = {}
        for r in rows:
            if r.error is None:
                got.setdefault(r.file, {})[r.idx] = r
        for name, x in made.items():
            mine = got.get(str(tmp_path / f"{name}.npy"), {})
            whole = x.reshape(1) if x.ndim == 0 else x
            assert sorted(mine) == list(range(len(whole)))
            for k, r in mine.items():
                assert r.label == name.split("/")[0] and tuple(r.shape) == whole.shape[1:] and np.array_equal(np.array(r["values"]).reshape(r.shape), whole[k].astype(float))
        assert len(got[str(tmp_path / "noise/v3.npy")]) == 4
        assert {r.file.rsplit("/", 1)[1] for r in rows if r.error} == {"objects.npy", "records.npy", "text.npy", "short.npy", "nothing.npy", "absent.npy"}
    assert arrays.read_arrays(files.limit(0)).count() == 0
    assert arrays.read_arrays(files).where(F.col("label") == "burst").groupBy("label").count().first()[1] == 16
