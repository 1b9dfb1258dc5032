"""Queries of the search proper: time grids, normalisation, matched filter, peaks, dedispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.functions import astro
from burstlake.operators import boxes, dedisperse, signal, timegrid
from burstlake.operators.ranking import numbered
from burstlake.plans.registry import CANDIDATES, DT, FREQ0, STEP, WATERFALL, candidates, query, spectra, table, waterfall

NCHAN = 64
TOP = FREQ0 + STEP * (NCHAN - 1)
TRIALS, FREQS = [10.0 * k for k in range(21)], [FREQ0 + STEP * c for c in range(NCHAN)]

SERIES = ", s AS (SELECT t, sum(q)::BIGINT AS s, count(*) AS n FROM w GROUP BY t)"
PEAKS = SERIES + """, p0 AS (SELECT t, t // 512 AS slice_id, s::DOUBLE AS snr, lag(s) OVER (PARTITION BY t // 512 ORDER BY t) AS b, lead(s) OVER (PARTITION BY t // 512 ORDER BY t) AS a FROM s),
p AS (SELECT slice_id, t, snr FROM p0 WHERE snr >= 0 AND snr >= b AND snr >= a)"""
SPACED = PEAKS + """, k AS (SELECT slice_id, min(t) AS t FROM p GROUP BY slice_id UNION ALL
SELECT k.slice_id, (SELECT min(p.t) FROM p WHERE p.slice_id = k.slice_id AND p.t >= k.t + 16) FROM k WHERE k.t IS NOT NULL)"""


def delay_sql(dm: str) -> str:
    f = f"({FREQ0}::DOUBLE + c * {STEP}::DOUBLE)"
    return f"CAST(trunc(4150.0::DOUBLE * {dm} * (1.0::DOUBLE / ({f} * {f}) - 1.0::DOUBLE / ({TOP}::DOUBLE * {TOP}::DOUBLE)) / {DT}::DOUBLE) AS BIGINT)"


CUBE = f""", d AS (SELECT i AS dm_idx, c, {delay_sql('(0.0::DOUBLE + i * 10.0::DOUBLE)')} AS delay FROM range(21) r(i), range({NCHAN}) h(c)),
cube AS (SELECT dm_idx, t - delay AS t, sum(q)::DOUBLE / count(*) AS "full", coalesce(sum(q) FILTER (w.c = 32), 0)::DOUBLE AS mid
FROM w JOIN d ON w.c = d.c WHERE t - delay >= 0 GROUP BY ALL)"""


def series(spark, sf_dir) -> DataFrame:
    return signal.integrate_spectra(spectra(spark, sf_dir))


def cube(spark, sf_dir) -> DataFrame:
    return dedisperse.cube(spectra(spark, sf_dir), TRIALS, FREQS, DT, TOP, mid=NCHAN // 2)


@query(WATERFALL + " SELECT t // 4 AS t_bin, c // 8 AS c_bin, sum(q)::DOUBLE / 8 AS value FROM w GROUP BY ALL HAVING count(*) = 32")
def decimate_block(spark, sf_dir):
    return timegrid.decimate(waterfall(spark, sf_dir), 4, 8).select("t_bin", "c_bin", "value")


@query(WATERFALL + """, m AS (SELECT c, sum(q)::DOUBLE AS s1, sum(q::HUGEINT * q)::DOUBLE AS s2, count(*) AS n FROM w GROUP BY c),
g AS (SELECT c, s1 / n AS mean, sqrt(greatest((s2 - s1 * s1 / n) / n, 0)) AS sg FROM m)
SELECT t, w.c, round((q - mean) / CASE WHEN sg < 1e-6 THEN 1.0 ELSE sg END, 6) AS z FROM w JOIN g ON w.c = g.c""")
def prewhiten_channels(spark, sf_dir):
    return signal.prewhiten(waterfall(spark, sf_dir)).select("t", "c", F.round("z", 6).alias("z"))


@query(WATERFALL + SERIES + " SELECT t, s, n AS n_chan, round(s::DOUBLE / n, 3) AS mean FROM s")
def frequency_integrate(spark, sf_dir):
    return series(spark, sf_dir).select("t", "s", "n_chan", F.round(F.col("s").cast("double") / F.col("n_chan"), 3).alias("mean"))


BLOCKS = SERIES + """, b AS (SELECT t, s, t // 500 AS block FROM s), md AS (SELECT block, median(s) AS med, count(*) AS m FROM b GROUP BY block),
x AS (SELECT b.block, t, s - med AS x, m, row_number() OVER (PARTITION BY b.block ORDER BY s - med, t) - 1 AS r FROM b JOIN md ON b.block = md.block),
g0 AS (SELECT block, sqrt(coalesce(sum(x * x) FILTER (r >= m // 40 AND r < m - m // 40), 0) / (0.95::DOUBLE * max(m))) * 1.148::DOUBLE AS sg FROM x GROUP BY block),
g AS (SELECT block, CASE WHEN sg > 0 THEN sg ELSE 1.0 END AS sg FROM g0),
e AS (SELECT count(*) AS n, median(sg) AS mid, stddev_pop(sg) AS dev FROM g),
z AS (SELECT x.block, x.t, CASE WHEN e.n >= 3 AND abs(sg - mid) > 4 * dev THEN 0.0 ELSE x / sg END AS z FROM x JOIN g ON x.block = g.block, e)"""


@query(WATERFALL + BLOCKS + " SELECT block, t, round(z, 6) AS z FROM z")
def block_normalize(spark, sf_dir):
    return signal.block_normalize(series(spark, sf_dir), 500).select("block", "t", F.round("z", 6).alias("z"))


def _boxcar(value: str, source: str) -> str:
    cols = ", ".join(f"round(sum({value}) OVER (ORDER BY t ROWS BETWEEN {w // 2} PRECEDING AND {w - 1 - w // 2} FOLLOWING) / {w**0.5!r}::DOUBLE, 6) AS b{w}" for w in astro.BOXCARS)
    best = "greatest(" + ", ".join(f"b{w}" for w in astro.BOXCARS) + ")"
    case = "CASE " + " ".join(f"WHEN b{w} = {best} THEN {w}" for w in astro.BOXCARS) + " END"
    return f", bx AS (SELECT t, {cols} FROM {source}), snr AS (SELECT t, {best} AS snr, {case} AS width FROM bx)"


@query(WATERFALL + SERIES + _boxcar("s", "s") + " SELECT t, snr, width FROM snr")
def boxcar_matched_filter(spark, sf_dir):
    s = series(spark, sf_dir).select("t", F.col("s").cast("double").alias("z"))
    return signal.matched_filter(s).select("t", "snr", "width")


def _peaks(spark, sf_dir):
    return signal.local_peaks(series(spark, sf_dir).select("t", F.col("s").cast("double").alias("snr")), 0.0, 512)


@query(WATERFALL + PEAKS + " SELECT slice_id, t, snr FROM p")
def local_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir).select("slice_id", "t", "snr")


@query(WATERFALL + SPACED + " SELECT slice_id, t FROM k WHERE t IS NOT NULL")
def spaced_peaks(spark, sf_dir):
    return signal.spaced(_peaks(spark, sf_dir), 16)


@query(WATERFALL + SPACED + """, g AS (SELECT slice_id, arg_min(t, (-snr, t)) AS t, max(snr) AS snr FROM (SELECT t // 512 AS slice_id, t, s::DOUBLE AS snr FROM s) GROUP BY slice_id HAVING max(snr) >= 0),
a AS (SELECT slice_id, t, snr, true AS g FROM g UNION ALL SELECT k.slice_id, k.t, p.snr, false FROM k JOIN p ON k.t = p.t),
o AS (SELECT slice_id, t, max(snr) AS snr, bool_or(g) AS is_global FROM a GROUP BY slice_id, t)
SELECT slice_id, t, snr, is_global, row_number() OVER (PARTITION BY slice_id ORDER BY is_global DESC, snr DESC, t) AS rank FROM o""")
def global_peak_first(spark, sf_dir):
    snr = series(spark, sf_dir).select("t", F.col("s").cast("double").alias("snr"))
    taken = signal.spaced(signal.local_peaks(snr, 0.0, 512), 16)
    return signal.global_first(snr, taken, 0.0, 512).select("slice_id", "t", "snr", "is_global", "rank")


SEARCH = BLOCKS + _boxcar("z", "z") + """, sl AS (SELECT t // 512 AS slice_id, t, snr, width, lag(snr) OVER (PARTITION BY t // 512 ORDER BY t) AS b, lead(snr) OVER (PARTITION BY t // 512 ORDER BY t) AS a FROM snr)
SELECT slice_id, t, snr, width, round(1 / (1 + exp(-(snr - 2.0) / 2.0)), 4) AS prob, round(least(0.99, greatest(0.05, snr / 10.0)), 4) AS confidence, 1 / (1 + exp(-(snr - 2.0) / 2.0)) >= 0.6 AS is_burst
FROM sl WHERE snr >= 2.0 AND snr >= b AND snr >= a"""


@query(WATERFALL + SEARCH)
def pulse_search(spark, sf_dir):
    """Which samples hold a pulse: integrate, normalise by blocks, matched filter, local peaks, logistic classifier."""
    z = signal.block_normalize(series(spark, sf_dir), 500)
    hits = signal.local_peaks(signal.matched_filter(z), 2.0, 512)
    prob = astro.logistic(F.col("snr"), 2.0)
    return hits.select("slice_id", "t", "snr", "width", F.round(prob, 4).alias("prob"), F.round(astro.confidence(F.col("snr")), 4).alias("confidence"), (prob >= 0.6).alias("is_burst"))


@query("""WITH f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
g AS (SELECT *, greatest(1, least(CAST(round_even(n / 30.0::DOUBLE, 0) AS BIGINT), least(8, n))) AS k FROM f),
h AS (SELECT *, n // k AS b, n % k AS r FROM g)
SELECT label, CASE WHEN i < r * (b + 1) THEN i // (b + 1) ELSE r + (i - r * (b + 1)) // b END AS slice_id, min(i) AS first, max(i) AS last, count(*) AS n FROM h GROUP BY ALL""")
def slice_plan(spark, sf_dir):
    f = numbered(table(spark, sf_dir, "embeddings").select("label", "vec_id"), ("label",), ["vec_id"], place="i", size="n")
    f = f.withColumn("k", timegrid.slice_count(F.col("n"), 30, 8))
    return f.groupBy("label", timegrid.slice_of(F.col("i"), F.col("n"), F.col("k")).alias("slice_id")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"))


HALO = """WITH e AS (SELECT event_id AS t, unnest(range(CAST(floor((event_id - 50) / 1000.0::DOUBLE) AS BIGINT), CAST(floor((event_id + 50) / 1000.0::DOUBLE) AS BIGINT) + 1)) AS chunk_id FROM events)"""


@query(HALO + " SELECT chunk_id, count(*) AS n, count(*) FILTER (chunk_id = t // 1000) AS n_owned, min(t) AS first, max(t) AS last FROM e WHERE chunk_id >= 0 GROUP BY chunk_id")
def chunk_halo(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("t"))
    return timegrid.with_halo(e, "t", 1000, 50).groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if("owned").alias("n_owned"), F.min("t").alias("first"), F.max("t").alias("last"))


@query(HALO + " SELECT t, chunk_id FROM e WHERE chunk_id = t // 1000")
def chunk_ownership(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("t"))
    return timegrid.with_halo(e, "t", 1000, 50).where("owned").select("t", "chunk_id")


@query(f"SELECT event_id, {delay_sql('value').replace('c *', '(user_id % 64) *')} AS delay, round(value / (0.000241::DOUBLE * 1.44::DOUBLE), 4) AS ms FROM events")
def dm_delays(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    freq = F.lit(FREQ0) + (F.col("user_id") % 64) * F.lit(STEP)
    return e.select("event_id", astro.delay_samples(F.col("value"), freq, F.lit(TOP), DT).alias("delay"), F.round(F.col("value") / (F.lit(astro.K_INVERSE) * F.lit(1.44)), 4).alias("ms"))


@query(WATERFALL + CUBE + ' SELECT dm_idx, t, round("full", 4) AS "full", mid, round("full" - mid, 4) AS diff FROM cube')
def dedisperse_cube(spark, sf_dir):
    return cube(spark, sf_dir).select("dm_idx", "t", F.round("full", 4).alias("full"), "mid", F.round("diff", 4).alias("diff"))


@query(WATERFALL + f", d AS (SELECT c, {delay_sql('56.7::DOUBLE')} AS delay FROM range({NCHAN}) h(c)) SELECT t - delay AS t, w.c, q FROM w JOIN d ON w.c = d.c WHERE t - delay >= 0")
def dedisperse_block(spark, sf_dir):
    grid, chans = dedisperse.dm_grid(spark, 56.7, 56.7, 1), dedisperse.channels(spark, NCHAN, FREQ0, STEP)
    return dedisperse.shifted(waterfall(spark, sf_dir), dedisperse.delays(grid, chans, DT, TOP), 1 << 60)


@query(WATERFALL + CUBE + """ SELECT t, arg_min(dm_idx, (-"full", dm_idx)) AS dm_idx, round(max("full"), 4) AS peak, round(stddev_pop("full"), 3) AS spread FROM cube GROUP BY t""")
def dm_at_peak(spark, sf_dir):
    return dedisperse.best_dm(cube(spark, sf_dir)).select("t", "dm_idx", F.round("peak", 4).alias("peak"), F.round("spread", 3).alias("spread"))


@query(WATERFALL + CUBE + """, n AS (SELECT dm_idx + i AS dm_idx, t + j AS t, max("full") AS top FROM cube, range(-1, 2) a(i), range(-1, 2) b(j) GROUP BY ALL)
SELECT cube.dm_idx, cube.t, round("full", 4) AS "full" FROM cube JOIN n ON cube.dm_idx = n.dm_idx AND cube.t = n.t WHERE "full" >= 100000 AND "full" >= top""")
def plane_maxima(spark, sf_dir):
    plane = cube(spark, sf_dir).select("dm_idx", "t", "full")
    return boxes.plane_maxima(plane, "dm_idx", "t", "full", 100000.0).select("dm_idx", "t", F.round("full", 4).alias("full"))


@query(WATERFALL + """, u AS (SELECT label, t, c, q / 1e6 + 1.0 AS p FROM w), m AS (SELECT label, c, avg(p) AS mu FROM u GROUP BY ALL),
p AS (SELECT u.label, t, u.c, p / CASE WHEN mu = 0 THEN 1 ELSE mu END AS p FROM u JOIN m ON u.label = m.label AND u.c = m.c),
l AS (SELECT label, quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM p GROUP BY label)
SELECT t, c, round(CASE WHEN hi > lo THEN (least(hi, greatest(lo, p)) - lo) / (hi - lo) ELSE 0 END, 5) AS norm FROM p JOIN l ON p.label = l.label""")
def patch_normalize(spark, sf_dir):
    w = waterfall(spark, sf_dir).withColumn("v", F.col("q") / F.lit(1e6))
    return signal.patch_normalize(w, "label", "c", "v").select("t", "c", F.round("norm", 5).alias("norm"))


@query(WATERFALL + " SELECT c, round((quantile_cont(q::DOUBLE, 0.75) - quantile_cont(q::DOUBLE, 0.25)) / 1.349::DOUBLE, 4) AS sigma FROM w GROUP BY c")
def iqr_sigma(spark, sf_dir):
    w = waterfall(spark, sf_dir).withColumn("q", F.col("q").cast("double"))
    return signal.iqr_sigma(w, ("c",), "q").select("c", F.round("sigma", 4).alias("sigma"))


@query(CANDIDATES + """, p AS (SELECT file_id, snr, row_number() OVER (PARTITION BY file_id ORDER BY t_sec, cand_id) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM cand),
o AS (SELECT file_id, snr, CASE WHEN i < n // 4 THEN 0 WHEN i >= n - n // 4 THEN 1 END AS side FROM p),
m AS (SELECT file_id, side, favg(snr) AS mu FROM o WHERE side IS NOT NULL GROUP BY ALL)
SELECT o.file_id, round(avg(snr - mu), 6) + 0.0 AS mean, round(median(snr - mu), 9) AS median, round(stddev_pop(snr - mu), 6) AS std FROM o JOIN m ON o.file_id = m.file_id AND o.side = m.side GROUP BY ALL""")
def off_pulse_stats(spark, sf_dir):
    p = numbered(candidates(spark, sf_dir).select("file_id", "snr", "t_sec", "cand_id"), ("file_id",), ["t_sec", "cand_id"], place="i", size="n")
    out = signal.off_pulse(p, "file_id", F.col("i"), F.col("n"), "snr")
    return out.select("file_id", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("median", 9).alias("median"), F.round("std", 6).alias("std"))


STOKES = ", st AS (SELECT t, c // 4 AS c, max(q) FILTER (c % 4 = 0) AS i, max(q) FILTER (c % 4 = 1)::DOUBLE AS qq, max(q) FILTER (c % 4 = 2)::DOUBLE AS u, max(q) FILTER (c % 4 = 3) AS v FROM w GROUP BY ALL)"


def stokes(spark, sf_dir) -> DataFrame:
    """Four channels in turn read as I, Q, U, V of one."""
    pol = lambda k: F.max(F.when(F.col("c") % 4 == k, F.col("q")))
    return waterfall(spark, sf_dir).groupBy("t", F.floor(F.col("c") / 4).alias("c")).agg(pol(0).alias("i"), pol(1).cast("double").alias("qq"), pol(2).cast("double").alias("u"), pol(3).alias("v"))


@query(WATERFALL + STOKES + " SELECT t, c, i, round(sqrt(qq * qq + u * u), 3) AS l, abs(v) AS v FROM st")
def stokes_linear(spark, sf_dir):
    return stokes(spark, sf_dir).select("t", "c", "i", F.round(F.sqrt(F.col("qq") * F.col("qq") + F.col("u") * F.col("u")), 3).alias("l"), F.abs("v").alias("v"))


@query(WATERFALL + STOKES + " SELECT t, round(sqrt(sum(qq) * sum(qq) + sum(u) * sum(u)), 3) AS l FROM st GROUP BY t")
def linear_pol_series(spark, sf_dir):
    a, b = F.sum("qq"), F.sum("u")
    return stokes(spark, sf_dir).groupBy("t").agg(F.round(F.sqrt(a * a + b * b), 3).alias("l"))


@query("""WITH v AS (SELECT vec_id AS t, label::BIGINT AS x FROM embeddings WHERE label <> 1), r AS (SELECT max(vec_id) AS top FROM embeddings)
SELECT a.t, coalesce(v.x, 0) AS x, v.x IS NULL AS is_gap FROM (SELECT unnest(range(0, top + 1)) AS t FROM r) a LEFT JOIN v ON a.t = v.t""")
def gap_fill(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    last = e.agg(F.coalesce(F.max("vec_id"), F.lit(-1))).first()[0]
    return timegrid.fill_gaps(e.where("label <> 1").select(F.col("vec_id").alias("t"), F.col("label").cast("bigint").alias("x")), "t", 0, last, "x")


@query("""SELECT event_id, least(2048, greatest(32, greatest(612, floor(value / 1000 / 0.0005::DOUBLE + 0.5))))::INT AS slice_len,
CAST(round_even((event_id % 2048) * 512.0::DOUBLE / 2048, 0) AS INT) AS x, greatest(4, 2048 // 64) AS half FROM events""")
def slice_geometry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", timegrid.slice_length(F.col("value"), F.lit(0.0005)).alias("slice_len"), astro.to_grid(F.col("event_id") % 2048, F.lit(2048)).alias("x"), astro.half_width(F.lit(2048)).alias("half"))


@query()
def box_nms(spark, sf_dir):
    """Boxes around candidates, 30 wide, one image for each file and ten days; the best of overlapping ones stays."""
    c = candidates(spark, sf_dir)
    x, y = F.floor(F.pmod(F.col("t_sec") / 168.75, F.lit(512.0))), F.floor(F.pmod(F.col("snr") * 51.2, F.lit(512.0)))
    b = c.select(F.concat_ws("/", "file_id", F.floor(F.col("mjd") / 10).cast("long")).alias("image"), F.col("cand_id").alias("box_id"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 30).alias("y2"), F.col("snr").alias("score"))
    return boxes.nms(b, "image", 0.3)


@query()
def inject_pulse_recover(spark, sf_dir):
    """A dispersed Gaussian pulse added to every recording at its 40th sample, and where the search then finds the peak."""
    late = F.array(*(F.lit(int(d)) for d in dedisperse.delay_matrix([TRIALS[4]], FREQS, DT, TOP)[0]))
    x = lambda d: F.pmod("t", F.lit(500)) - 40 - d
    pulse = F.zip_with("spec", late, lambda q, d: q + F.round(F.lit(2e6) * F.exp(-x(d) * x(d) / 4.0)).cast("bigint"))
    w = spectra(spark, sf_dir).select("t", pulse.alias("spec"), F.floor(F.col("t") / 500).cast("long").alias("block"))
    c = dedisperse.cube(w, TRIALS, FREQS, DT, TOP, keys=("block",))
    return c.groupBy("block").agg(F.max_by(F.struct("dm_idx", "t"), "full").alias("b"), F.max("full").alias("peak")).select("block", "b.dm_idx", "b.t", F.round("peak", 2).alias("peak"))
