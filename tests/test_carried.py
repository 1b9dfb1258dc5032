"""A stream that lands in pieces gives what the table gives at once."""

import numpy as np
from pyspark.sql import functions as F

from burstlake.operators import signal
from burstlake.streaming import landing
from burstlake.streaming.carried import pulses

SCHEMA = "file string, t long, s double, n long"


def test_pulses_over_borders_of_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    series = {"a": rng.integers(-9, 10, 1500), "b": rng.integers(-9, 10, 333), "c": rng.integers(-9, 10, 70)}
    series["a"][698:703] += 60  # over the border of the batches, which is also inside of a chunk's halo
    series["a"][254:258] += 60  # over the border of two chunks
    rows = {f: [(f, t, float(v), len(x)) for t, v in enumerate(x)] for f, x in series.items()}
    again = rows["a"][650:720]
    pieces = [rows["a"][:700] + rows["b"][100:], again + rows["a"][700:1000][::-1], rows["b"][:100] + rows["a"][1000:] + rows["c"][:69] + [("a", -1, 5.0, 1500), ("a", 2000, 5.0, 1500), ("a", None, 5.0, 1500)]]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        found = pulses(landing.read_landing(spark, source, SCHEMA, 1), 256, 40.0)
        q = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination(100)
        assert q.exception() is None

    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k != 1:  # the second and third piece are two batches of one run; the first run was stopped before
            run()
    got = sorted((r.file, r.t, r.snr, r.width) for r in spark.read.parquet(out).collect())
    table = spark.createDataFrame(rows["a"] + rows["b"], SCHEMA)  # c lacks a sample
    snr = signal.matched_filter(table, chunk=256, value="s", keys=("file",))
    want = sorted((r.file, r.t, r.snr, r.width) for r in signal.local_peaks(snr, 40.0, 256, keys=("file",)).collect())
    assert got == want and len({(f, t) for f, t, _, _ in got}) == len(got)
    assert any(f == "a" and 696 <= t <= 705 for f, t, _, _ in got) and any(f == "a" and 252 <= t <= 260 for f, t, _, _ in got)
    run()
    assert spark.read.parquet(out).count() == len(got)
    spark.createDataFrame(rows["c"][69:] + rows["a"][:300], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    late = spark.read.parquet(out).where(F.col("file") != "c").count()
    assert late == len(got)
