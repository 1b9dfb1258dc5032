import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.functions import astro
from burstlake.operators import dedisperse, metrics, signal
from burstlake.sources import catalog
from burstlake.sources.recordings import PsrfitsReader, open_path, register, unpack
from burstlake.streaming import landing


def write_filterbank(path, data, foff, bits=8):
    """data: (sample, pol, channel)."""
    text = lambda s: struct.pack("<i", len(s)) + s.encode()
    h = text("HEADER_START") + text("source_name") + text("test") + text("machine_id") + struct.pack("<i", 3)
    for k, v in (("nbits", bits), ("nchans", data.shape[2]), ("nifs", data.shape[1])):
        h += text(k) + struct.pack("<i", v)
    for k, v in (("tsamp", 1e-3), ("fch1", 1500.0), ("foff", foff), ("tstart", 58000.5)):
        h += text(k) + struct.pack("<d", v)
    kind = {8: np.uint8, 16: np.int16, 32: np.float32}[bits]
    path.write_bytes(h + text("HEADER_END") + data.astype(kind).tobytes())


def card(key, value):
    v = f"'{value:<8}'" if isinstance(value, str) else str(value)
    return f"{key:<8}= {v:>20}".ljust(80)


def header(*items):
    text = "".join(card(k, v) for k, v in items) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def write_psrfits(path, data, slots, bits=4, swapped=False):
    """data: (row, sample, pol, channel) of small whole numbers; slots: where the rows stand in time."""
    rows, nsblk, npol, nchan = data.shape
    freq = np.linspace(1500, 1400, nchan).astype(">f4")
    out = []
    for k in range(rows):
        flat = (data[k].swapaxes(1, 2) if swapped else data[k]).astype(np.uint8).ravel().reshape(-1, 8 // bits)
        raw = np.zeros(len(flat), np.uint8)
        for j in range(8 // bits):
            raw |= flat[:, j] << np.uint8(8 - bits * (j + 1))
        out.append(struct.pack(">d", (slots[k] + 0.5) * nsblk * 1e-3) + freq.tobytes() + np.full(npol * nchan, 2, ">f4").tobytes() + np.full(npol * nchan, 1, ">f4").tobytes() + raw.tobytes())
    forms = [("OFFS_SUB", "1D"), ("DAT_FREQ", f"{nchan}E"), ("DAT_SCL", f"{npol * nchan}E"), ("DAT_OFFS", f"{npol * nchan}E"), ("DATA", f"{nsblk * npol * nchan * bits // 8}B")]
    sub = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", len(out[0])), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(forms)), ("EXTNAME", "SUBINT")]
    sub += [("NSBLK", nsblk), ("NPOL", npol), ("NCHAN", nchan), ("NBITS", bits), ("TBIN", 1e-3), ("POL_TYPE", "IQUV"), ("ZERO_OFF", 0)]
    sub += [x for k, (t, f) in enumerate(forms, 1) for x in ((f"TTYPE{k}", t), (f"TFORM{k}", f))]
    sub += [("TDIM5", f"({npol},{nchan},{nsblk})")] if swapped else []
    body = b"".join(out)
    path.write_bytes(header(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("STT_IMJD", 58000), ("STT_SMJD", 43200), ("STT_OFFS", 0.0)) + header(*sub) + body.ljust(-(-len(body) // 2880) * 2880, b"\0"))


def block(df, pols, chans):
    got = df.orderBy("sample_idx", "pol").toPandas()
    return np.stack(got.spec.to_numpy()).reshape(-1, pols, chans)


@pytest.mark.parametrize(("bits", "foff"), [(8, -1.0), (16, 1.0), (32, -0.5)])
def test_filterbank(spark, tmp_path, bits, foff):
    data = np.random.default_rng(bits).integers(0, 200, (50, 2, 8))
    write_filterbank(tmp_path / "a.fil", data, foff, bits)
    register(spark)
    df = spark.read.format("filterbank").option("samples", 16).load(str(tmp_path / "a.fil"))
    want = data[:, :, ::-1] if foff < 0 else data
    assert (block(df, 2, 8) == want).all() and df.rdd.getNumPartitions() == 4
    part = df.where("sample_idx >= 10 and sample_idx < 20")
    assert (block(part, 2, 8) == want[10:20]).all()


def test_psrfits_with_gap(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 16, (3, 10, 4, 8))
    write_psrfits(tmp_path / "b.fits", data, [0, 1, 3])
    register(spark)
    got = block(spark.read.format("psrfits").option("samples", 12).load(str(tmp_path / "b.fits")), 4, 8)
    want = np.concatenate((data[0], data[1], np.zeros((10, 4, 8)), data[2])) * 2.0 + 1
    want[20:30] = 0
    assert (got == want[:, :, ::-1]).all()


def test_psrfits_ranges_far_apart(spark, tmp_path):
    """Ranges find their rows by halving; batches end inside rows, whose bits end inside bytes."""
    slots = [0, 1, 4, 5, 6, 9, 20]
    data = np.random.default_rng(2).integers(0, 4, (len(slots), 6, 1, 2))
    write_psrfits(tmp_path / "g.fits", data, slots, bits=2)
    want = np.zeros((21 * 6, 1, 2))
    for d, s in zip(data, slots):
        want[s * 6 : s * 6 + 6] = d[:, :, ::-1] * 2.0 + 1
    reader = PsrfitsReader({"path": str(tmp_path / "g.fits")})
    with open_path(str(tmp_path / "g.fits")) as f:
        lay = reader.layout(f)
        assert reader.length(f, lay) == len(want)
        for a in range(0, len(want)):
            for b in (a + 1, a + 5, len(want)):
                assert (reader.block(f, lay, a, min(b, len(want))) == want[a : min(b, len(want))]).all()


def test_psrfits_axes_by_tdim(tmp_path):
    data = np.random.default_rng(4).integers(0, 200, (2, 5, 4, 8))
    write_psrfits(tmp_path / "a.fits", data, [0, 1], bits=8)
    write_psrfits(tmp_path / "b.fits", data, [0, 1], bits=8, swapped=True)
    for name in ("a.fits", "b.fits"):
        reader = PsrfitsReader({"path": ""})
        with open_path(str(tmp_path / name)) as f:
            lay = reader.layout(f)
            assert lay["swapped"] == (name == "b.fits")
            assert (reader.block(f, lay, 0, 10)[:, :, ::-1] == data.reshape(10, 4, 8) * 2.0 + 1).all()


def test_filterbank_without_header(spark, tmp_path):
    data = np.random.default_rng(5).integers(0, 200, (7, 512)).astype(np.uint8)
    (tmp_path / "raw.fil").write_bytes(b"\xff" * 512 + data.tobytes())
    (tmp_path / "tiny.fil").write_bytes(b"ab")
    register(spark)
    got = block(spark.read.format("filterbank").option("assume_header", True).load(str(tmp_path / "raw.fil")), 1, 512)
    assert (got[:, 0] == data[:, ::-1]).all()
    assert all(r.error and r.nchan is None for r in catalog.obs_params(catalog.find_files(spark, str(tmp_path))).collect())


def paths(spark, folder, *names):
    return spark.createDataFrame([(str(folder / n),) for n in names], "path string")


def test_file_checks(spark, tmp_path):
    (tmp_path / "a.fil").write_bytes(b"abc")
    (tmp_path / "b.fits").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "d.fil").mkdir()
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.errors, r.warnings) for r in catalog.file_checks(paths(spark, tmp_path, "a.fil", "b.fits", "c.txt", "d.fil", "e.fil"), large=2).collect()}
    assert got["a.fil"] == (3, [], ["large"]) and got["b.fits"] == (0, ["empty"], []) and got["c.txt"] == (1, ["unsupported"], [])
    assert got["d.fil"] == (None, ["not a file"], []) and got["e.fil"] == (None, ["missing"], [])


def test_reading_plan(spark):
    rows = spark.createDataFrame([("a.fits", 10_000_001, 0.5), ("b.fil", 500, 0.5), ("c.fil", 200_000_000, None), ("d.fil", None, 0.5)], "path string, nsamples long, tsamp double")
    got = {r.path: r for r in catalog.reading_plan(rows, 1000).collect()}
    assert (got["a.fits"].chunks, got["a.fits"].seconds, got["a.fits"].notes) == (10_001, 5_000_000.5, ["many samples"])
    assert (got["b.fil"].chunks, got["b.fil"].notes) == (1, ["short recording"])
    assert got["c.fil"].notes == ["many samples", "very long recording"] and got["c.fil"].seconds is None and got["d.fil"].chunks is None and got["d.fil"].notes == []


def test_outputs_of_recordings(spark, tmp_path):
    known = spark.createDataFrame([("/d/run_a.fil",), ("/d/run.fits",), ("/d/lost.fil",), ("/d/run_a.fil",)], "path string")
    found = ["/r/Validation/sub/run_a_dm/m.json", "/r/Validation/run_a.json", "/r/old/run_a/x.json", "/r/old/xrun/y.json", "/r/run_b/Validation/z.json"]
    files = spark.createDataFrame([(x,) for x in found] + [(None,)], "path string")
    got = {(r.file, r.output): r.rank for r in catalog.outputs_of(known, files, "/r/Validation", "/r/old").collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "/d/run_a.fil"} == {found[1]: 0, found[0]: 1, found[2]: 2}
    assert {k[1] for k in got if k[0] == "/d/run.fits"} == set(found[:4]) and ("/d/lost.fil", None) in got and len(got) == 8
    best = {r.file: r.output for r in catalog.first_output(catalog.outputs_of(known, files, "/r/Validation", "/r/old")).collect()}
    assert best == {"/d/run_a.fil": found[1], "/d/run.fits": found[1], "/d/lost.fil": None}


def test_parameters_of_plain_fits_and_other_start_keys(spark, tmp_path):
    primary = header(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("TSTART", 58000.25), ("NSUBOFFS", 10))
    image = [("XTENSION", "IMAGE"), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", 4), ("NAXIS2", 6), ("CTYPE1", "FREQ"), ("CRVAL1", 1400.0), ("CDELT1", -2.0), ("CRPIX1", 1), ("TBIN", 0.5), ("TSUBINT", 864.0)]
    (tmp_path / "plain.fits").write_bytes(primary + header(*image) + bytes(2880))
    (tmp_path / "none.fits").write_bytes(primary)
    (tmp_path / "empty.fits").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in catalog.obs_params(paths(spark, tmp_path, "plain.fits", "none.fits", "empty.fits")).collect()}
    one = got["plain.fits"]
    assert (one.nchan, one.nsamples, one.tsamp, one.freq_low, one.freq_high, one.npol) == (4, 6, 0.5, 1394.0, 1400.0, None)
    assert one.tstart_mjd == 58000.25 and abs(one.tstart_mjd_corr - 58000.35) < 1e-9
    assert got["none.fits"].error and got["empty.fits"].error and got["none.fits"].nchan is None


def test_unpack():
    assert unpack(np.array([0b10110001], np.uint8), 1).tolist() == [1, 0, 1, 1, 0, 0, 0, 1]
    assert unpack(np.array([0b10110001], np.uint8), 2).tolist() == [2, 3, 0, 1] and unpack(np.array([0xAB], np.uint8), 4).tolist() == [10, 11]


def test_files_and_parameters(spark, tmp_path):
    write_filterbank(tmp_path / "Run_a.fil", np.zeros((5, 1, 4)), -1.0)
    write_psrfits(tmp_path / "run_b.fits", np.zeros((2, 4, 1, 8), int), [0, 1])
    (tmp_path / "run_c.fil").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("x")
    files = catalog.find_files(spark, str(tmp_path), "RUN")
    got = {r.path.rsplit("/", 1)[1]: r for r in catalog.obs_params(files).collect()}
    assert len(got) == 3 and got["Run_a.fil"].nsamples == 5 and (got["Run_a.fil"].freq_low, got["Run_a.fil"].freq_high) == (1497.0, 1500.0)
    assert got["run_b.fits"].tstart_mjd == 58000.5 and got["run_b.fits"].pol_type == "IQUV" and got["run_c.fil"].error and got["run_c.fil"].nchan is None
    assert {(r.key, r.value) for r in catalog.header_cards(files).collect()} >= {("STT_IMJD", "58000")}


def test_search_recovers_a_pulse(spark, tmp_path):
    """Noise and a dispersed pulse in a file; read, dedisperse, normalise, filter, find."""
    rng = np.random.default_rng(3)
    n, chans, dm, at = 1024, 32, 60.0, 300
    freq = 1400 + 3.125 * np.arange(chans)
    data = rng.normal(100, 5, (n, chans))
    late = (4150.0 * dm * (freq**-2.0 - freq.max() ** -2.0) / 1e-3).astype(int)
    for c in range(chans):
        data[at + late[c] - 1 : at + late[c] + 2, c] += 12
    write_filterbank(tmp_path / "p.fil", data[:, None, ::-1].clip(0, 255), -3.125)
    register(spark)
    s = spark.read.format("filterbank").load(str(tmp_path / "p.fil")).select(F.col("sample_idx").alias("t"), F.posexplode("spec").alias("c", "v")).select("t", "c", F.round("v").cast("bigint").alias("q"))
    z = signal.prewhiten(s).select("t", "c", F.round(F.col("z") * 1000).cast("bigint").alias("q"))
    rows = z.groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "q"))), lambda x: x["q"]).alias("spec"))
    plane = dedisperse.cube(rows, np.arange(0, 121, 10), freq, 1e-3, float(freq.max()), width=n - int(late.max()) * 2)
    best = dedisperse.best_dm(plane).orderBy(F.desc("peak")).first()
    assert best.dm_idx == 6 and abs(best.t - at) <= 1
    one = plane.where("dm_idx = 6").select("t", F.col("full").alias("s"))
    snr = signal.matched_filter(signal.block_normalize(one, 1000), chunk=128)
    peaks = signal.global_first(snr, signal.spaced(signal.local_peaks(snr, 5.0, 4096), 16), 5.0, 4096)
    top = peaks.where("rank = 1").first()
    assert abs(top.t - at) <= 1 and top.snr > 10
    # The chunked filter gives what one window over all gives.
    whole = signal.matched_filter(signal.block_normalize(one, 1000), chunk=1 << 20)
    assert snr.select("t", "snr", "width").exceptAll(whole.select("t", "snr", "width")).count() == 0


def test_candidate_tables(spark, tmp_path):
    row = spark.range(1).selectExpr("'a.fil' as file", "1 as chunk_id", "0.5 as detection_prob", "true as is_burst", "cast(null as boolean) as is_burst_linear")
    text = catalog.as_text(row.withColumn("detection_prob", F.col("detection_prob").cast("double"))).first()
    assert text.detection_prob == "0.500" and text.is_burst == "burst" and text.is_burst_linear is None
    catalog.write_candidates(row, str(tmp_path / "c"))
    catalog.write_candidates(row.withColumn("file", F.lit("b.fil")), str(tmp_path / "c"))
    catalog.write_candidates(row, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).groupBy("file").count().collect().__len__() == 2
    names = [c.strip().rsplit(" ", 1)[0].strip("`") for c in catalog.CANDIDATE_COLUMNS.split(", ")]
    assert len(names) == 29
    (tmp_path / "x.csv").write_text(",".join(names) + "\na.fil,1,2,0,0.9,55.5" + "," * 21 + ",burst,\n" + "b.fil,1,2,0,bad,5" + "," * 21 + ",no_burst,\n")
    got = {r.file: r for r in catalog.read_candidates(spark, str(tmp_path / "x.csv")).collect()}
    assert got["a.fil"].is_burst is True and got["b.fil"].is_burst is False and got["b.fil"].detection_prob is None and got["a.fil"].is_burst_linear is None


def test_summary(spark, tmp_path):
    c = spark.createDataFrame([("a", True, True, True, False), ("a", True, None, None, None), ("b", False, True, True, True)], "file string, snr_i_ok boolean, snr_l_ok boolean, burst_i boolean, burst_l boolean")
    got = {r.file: r for r in metrics.phase_counters(c, "file").collect()}
    assert got[None].p1_detected == 2 and got["a"].p2_failed == 1 and got["a"].p3b_no_burst == 1 and got["b"].p3a_classified == 0
    catalog.write_summary(metrics.phase_counters(c, "file"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 3


def test_streaming(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, 5.0), (1, 4, 9.0), (1, 40, 3.0), (2, 2, 1.0), (1, 4000, 1.0)], "f int, s int, snr double").select("f", F.timestamp_seconds("s").alias("ts"), "snr")
    e.write.parquet(str(tmp_path / "in"))
    stream = landing.read_landing(spark, str(tmp_path / "in"), e.schema)
    q = landing.burst_sessions(stream, "f", "ts", "snr").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.f, r.n, r.peak) for r in spark.table("sessions").collect()) == [(1, 1, 3.0), (1, 2, 9.0), (2, 1, 1.0)]
    q = landing.run_batches(landing.read_landing(spark, str(tmp_path / "in"), e.schema), lambda b: b.where("snr > 2"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert landing.window_counts(e, "ts", "f").count() == 3


def test_delays_and_overlap(spark):
    assert astro.overlap_samples(100, 1200, 1500, 1e-3) == int(np.ceil(4148.8 * 100 * (1200**-2 - 1500**-2) / 1e-3)) and astro.overlap_samples(1, 1, 2, 0) == 1024


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_filterbank_of_few_bits(spark, tmp_path, bits):
    data = np.random.default_rng(bits).integers(0, 1 << bits, (21, 1, 3))
    write_filterbank(tmp_path / "whole.fil", data, 1.0, 8)
    raw = (tmp_path / "whole.fil").read_bytes()
    head = raw[: len(raw) - data.size]
    at = head.index(b"nbits") + 5
    head = head[:at] + struct.pack("<i", bits) + head[at + 4 :]
    flat = np.append(data.ravel(), np.zeros(-data.size % (8 // bits), int)).reshape(-1, 8 // bits)
    (tmp_path / "a.fil").write_bytes(head + (flat << (np.arange(8 // bits) * bits)).sum(1).astype(np.uint8).tobytes())
    register(spark)
    df = spark.read.format("filterbank").option("samples", 5).load(str(tmp_path / "a.fil"))
    assert (block(df.where("sample_idx < 21"), 1, 3) == data).all()


def test_batches_are_bounded(spark, tmp_path, monkeypatch):
    from burstlake.sources import recordings

    monkeypatch.setattr(recordings, "BATCH_VALUES", 64)
    data = np.random.default_rng(0).integers(0, 200, (50, 2, 8))
    write_filterbank(tmp_path / "a.fil", data, 1.0)
    reader = recordings.FilterbankReader({"path": str(tmp_path / "a.fil")})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in got) <= 8 and np.array([x for b in got for x in b.column("spec").to_pylist()]).reshape(50, 2, 8).tolist() == data.tolist()


def test_candidate_lists_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("is_burst,other,file,detection_prob\nBURST,x,a.fil,0.25\nno_burst,y,b.fil,bad\n,z,c.fil,\n")
    (tmp_path / "b.csv").write_text("file,t_sample\nd.fil,77\n")
    got = {r.file: r for r in catalog.read_lists(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert (got["a.fil"].is_burst, got["a.fil"].detection_prob) == (True, 0.25) and (got["b.fil"].is_burst, got["b.fil"].detection_prob) == (False, None)
    assert got["c.fil"].is_burst is None and got["d.fil"].t_sample == 77 and got["d.fil"].is_burst is None and len(got["a.fil"]) == 29


def test_header_cards_tell_errors(spark, tmp_path):
    write_psrfits(tmp_path / "good.fits", np.zeros((2, 4, 1, 8), int), [0, 1])
    (tmp_path / "bad.fits").write_bytes(b"nothing")
    rows = catalog.header_cards(catalog.find_files(spark, str(tmp_path))).collect()
    assert [r.key for r in rows if r.path.endswith("bad.fits")] == [None] and all(r.error for r in rows if r.path.endswith("bad.fits"))
    assert any(r.key == "STT_IMJD" for r in rows)


def test_history_keeps_each_run_once(spark, tmp_path):
    from burstlake.sources.catalog import append_history

    path = str(tmp_path / "history")
    for run, n in (("r1", 3), ("r2", 5), ("r1", 4)):
        append_history(spark.createDataFrame([("a", n), ("b", 0)], "file string, n int"), path, run)
    got = spark.read.parquet(path)
    assert sorted((r.run_id, r.file, r.n) for r in got.collect()) == [("r1", "a", 4), ("r1", "b", 0), ("r2", "a", 5), ("r2", "b", 0)]
    assert got.where("run_at is null").count() == 0


def test_lists_by_their_own_headers(spark, tmp_path):
    """A folder of unlike lists: order, separators, quotes, case, blank lines, a byte order mark, an empty list; and many of them."""
    folder = tmp_path / "lists"
    folder.mkdir()
    (folder / "a.csv").write_text("file,detection_prob,slice_id\na,0.5,3\n\na2,,x\n")
    (folder / "b.csv").write_text("slice_id,file,detection_prob\n4,b,0.25\n")
    (folder / "c.csv").write_text("\n﻿File;\"IS_BURST\";note;mjd_utc\nc;burst;\"a;b\";58000.5\n")
    (folder / "d.csv").write_text("is_burst\tfile\nno_burst\td\nis_burst\tfile\n")
    (folder / "e.csv").write_text("file,slice_id\n")
    (folder / "f.csv").write_text("")
    got = {r.file: r for r in catalog.read_candidates(spark, str(folder)).collect()}
    assert got.keys() == {"a", "a2", "b", "c", "d"}
    assert (got["a"].detection_prob, got["a"].slice_id) == (0.5, 3) and (got["a2"].detection_prob, got["a2"].slice_id) == (None, None)
    assert (got["b"].detection_prob, got["b"].slice_id) == (0.25, 4)
    assert (got["c"].is_burst, got["c"].mjd_utc, got["c"].slice_id) == (True, 58000.5, None) and got["d"].is_burst is False
    for k in range(300):
        (folder / f"n{k}.csv").write_text(f"file,slice_id\nn{k},{k}\n" if k % 2 else f"slice_id,file\n{k},n{k}\n")
    many = catalog.read_lists(spark, [str(folder / f"n{k}.csv") for k in range(300)] + [str(folder / "absent.csv")])
    assert {r.file: r.slice_id for r in many.select("file", "slice_id").collect()} == {f"n{k}": k for k in range(300)}
    assert catalog.read_lists(spark, [str(folder / "absent.csv")]).count() == 0


@pytest.fixture
def read_locally(spark):
    """Settings under which Spark turns joins into broadcasts as it runs and reads their shuffles locally, as it does by itself on larger tables."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_each_file_is_written_by_one_task(spark, tmp_path, read_locally):
    from burstlake.sources import arrays, export

    rows = spark.range(0, 900, 1, 6).selectExpr("concat('f', id % 3) file", "id div 3 t", "transform(sequence(0, 63), x -> id + 1 / (1 + x)) spec")
    files = export.write_files(rows, str(tmp_path / "a"), "array")
    assert sorted((r.path[-6:], r.samples) for r in files.collect()) == [(f"f{k}.npy", 300) for k in range(3)]
    got = arrays.read_arrays(files).selectExpr("int(substr(file, -5, 1)) f", "idx", "values[0] v", "error").collect()
    assert len(got) == 900 and all(r.error is None and r.v == 3 * r.idx + r.f + 1 for r in got)


@pytest.mark.parametrize("name", ["psrfits_gaps", "array_files", "filterbank_files", "image_bins", "recording_parameters", "recordings_found"])
def test_file_queries_with_shuffles_read_locally(spark, sf, read_locally, name):
    import duckdb

    from burstlake.plans import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    other = con.execute(SQL[name])
    columns = [d[0] for d in other.description]
    text = lambda rows: sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text(QUERIES[name](spark, sf).select(*columns).collect()) == text(other.fetchall())


def test_a_table_that_ends_early_is_a_row_with_its_error(spark, tmp_path):
    from burstlake.sources import export, scan

    rows = spark.range(20).selectExpr("'f' file", "id t", "array(1.0D, 2.0D) spec")
    path = export.write_files(rows, str(tmp_path / "p"), "psrfits").first().path
    with open(path, "r+b") as f:
        f.truncate(2 * 2880 + 100)
    got = scan.scan(spark.createDataFrame([(path,)], "path string")).collect()
    assert len(got) == 1 and got[0].error and got[0].pols is None


def test_candidate_table_of_many_files_has_few_folders(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(0, 3000, 1, 4).selectExpr("if(id % 500 = 0, null, concat('f', id % 500)) file", "id", "'a' run")
    catalog.write_candidates(rows, path)
    catalog.write_candidates(rows.where("file < 'f2' or file is null").selectExpr("file", "id + 10000 id", "'b' run", "1 more"), path)
    assert len(list((tmp_path / "c").rglob("*.parquet"))) <= 4 * catalog.BUCKETS
    got = spark.read.parquet(path).drop("file_bucket")
    want = rows.selectExpr("file", "if(file < 'f2' or file is null, id + 10000, id) id", "if(file < 'f2' or file is null, 'b', 'a') run")
    assert got.count() == 3000 and got.select("file", "id", "run").exceptAll(want).count() == 0
