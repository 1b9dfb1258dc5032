"""The whole search over recordings with polarisations, and the rules of its time and frequency grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.functions import astro
from burstlake.operators import dedisperse, images, metrics, search, timegrid
from burstlake.plans.analytics_queries import FLAGS, OUT, flags, outcomes
from burstlake.plans.registry import CANDIDATES, DT, FREQ0, STEP, WATERFALL, candidates, query, spectra, table, waterfall
from burstlake.plans.signal_queries import STOKES

#: Recordings of so many samples; four vector components in turn are I, Q, U and V of one of 16 channels.
LENGTH, CHANS, WIDE = 4096, 16, 4 * STEP
TOP = FREQ0 + WIDE * (CHANS - 1)


def recordings(spark, sf_dir) -> DataFrame:
    """(file, t, i, q, u, v), an array over channels for each polarisation."""
    s = spectra(spark, sf_dir)
    pol = lambda k: F.filter("spec", lambda _, at: at % 4 == k)
    name = F.concat(F.lit("rec"), F.floor(F.col("t") / LENGTH).cast("string"))
    return s.select(name.alias("file"), F.pmod("t", F.lit(LENGTH)).alias("t"), *(pol(k).alias(n) for k, n in enumerate("iquv")))


def trials(spark) -> DataFrame:
    return dedisperse.delays(dedisperse.dm_grid(spark, 0, 200, 21), dedisperse.channels(spark, CHANS, FREQ0, WIDE), DT, TOP)


RECORDINGS = WATERFALL + f""", st AS (SELECT 'rec' || (t // {LENGTH}) AS file, t % {LENGTH} AS t, c // 4 AS c, max(q) FILTER (c % 4 = 0) AS i, max(q) FILTER (c % 4 = 1)::DOUBLE AS q, max(q) FILTER (c % 4 = 2)::DOUBLE AS u FROM w GROUP BY ALL),
s AS (SELECT file, t, sum(i)::BIGINT AS total, sum(round(sqrt(q * q + u * u))::BIGINT)::BIGINT AS linear FROM st GROUP BY ALL)"""


def _filtered(value: str) -> str:
    """snr and width of a series in SQL, for each file."""
    v, over = value, "OVER (PARTITION BY file ORDER BY t ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
    sums = ", ".join(f"round(sum(z) {over.format(w // 2, w - 1 - w // 2)} / {w**0.5!r}::DOUBLE, 6) AS b{w}" for w in astro.BOXCARS)
    best = "greatest(" + ", ".join(f"b{w}" for w in astro.BOXCARS) + ")"
    width = "CASE " + " ".join(f"WHEN b{w} = {best} THEN {w}" for w in astro.BOXCARS) + " END"
    return f""", m_{v} AS (SELECT file, t // 500 AS block, median({v}) AS med, count(*) AS m FROM s GROUP BY ALL),
x_{v} AS (SELECT s.file, block, t, {v} - med AS x, m, row_number() OVER (PARTITION BY s.file, block ORDER BY {v} - med, t) - 1 AS r FROM s JOIN m_{v} ON s.file = m_{v}.file AND t // 500 = block),
h_{v} AS (SELECT file, block, sqrt(coalesce(sum(x * x) FILTER (r >= m // 40 AND r < m - m // 40), 0) / (0.95::DOUBLE * max(m))) * 1.148::DOUBLE AS sg FROM x_{v} GROUP BY ALL),
g_{v} AS (SELECT file, block, CASE WHEN sg > 0 THEN sg ELSE 1.0 END AS sg FROM h_{v}), e_{v} AS (SELECT file, count(*) AS n, median(sg) AS mid, stddev_pop(sg) AS dev FROM g_{v} GROUP BY file),
z_{v} AS (SELECT x.file, x.t, CASE WHEN n >= 3 AND abs(sg - mid) > 4 * dev THEN 0.0 ELSE x / sg END AS z FROM x_{v} x JOIN g_{v} g ON x.file = g.file AND x.block = g.block JOIN e_{v} e ON x.file = e.file),
y_{v} AS (SELECT file, t, {sums} FROM z_{v}), f_{v} AS (SELECT file, t, {best} AS snr, {width} AS width FROM y_{v})"""


FREQ = f"({FREQ0}::DOUBLE + c * {WIDE}::DOUBLE)"
DELAYS = f""", d AS (SELECT i AS dm_idx, c, CAST(trunc(4150.0::DOUBLE * (0.0::DOUBLE + i * 10.0::DOUBLE) * (1.0::DOUBLE / ({FREQ} * {FREQ}) - 1.0::DOUBLE / ({TOP}::DOUBLE * {TOP}::DOUBLE)) / {DT}::DOUBLE) AS BIGINT) AS delay FROM range(21) r(i), range({CHANS}) h(c))"""
PEAKS = _filtered("total") + """, n0 AS (SELECT file, t // 512 AS slice_id, t, snr, width, lag(snr) OVER w AS b, lead(snr) OVER w AS a FROM f_total WINDOW w AS (PARTITION BY file, t // 512 ORDER BY t)),
p AS (SELECT file, slice_id, t, snr, width FROM n0 WHERE snr >= 2.0 AND snr >= b AND snr >= a),
k AS (SELECT file, slice_id, min(t) AS t FROM p GROUP BY ALL UNION ALL SELECT file, slice_id, (SELECT min(p.t) FROM p WHERE p.file = k.file AND p.slice_id = k.slice_id AND p.t >= k.t + 16) FROM k WHERE k.t IS NOT NULL),
o AS (SELECT file, t FROM k WHERE t IS NOT NULL UNION SELECT file, arg_min(t, (-snr, t)) FROM f_total GROUP BY file, t // 512 HAVING max(snr) >= 2.0),
pk AS (SELECT f.file, f.t // 512 AS slice_id, f.t, snr, width FROM f_total f JOIN o ON f.file = o.file AND f.t = o.t)"""
FOUND = RECORDINGS + DELAYS + PEAKS + _filtered("linear") + """, pl AS (SELECT pk.file, pk.t, d.dm_idx, sum(st.i)::DOUBLE / count(*) AS f FROM pk CROSS JOIN d JOIN st ON st.file = pk.file AND st.c = d.c AND st.t = pk.t + d.delay GROUP BY ALL),
dm AS (SELECT file, t, CASE WHEN stddev_pop(f) < 1e-6 THEN 10 ELSE arg_min(dm_idx, (-f, dm_idx)) END AS dm_idx FROM pl GROUP BY ALL),
found AS (SELECT pk.*, l.snr AS snr_l, dm_idx, 1 / (1 + exp(-(pk.snr - 2.0) / 2.0)) AS pi, 1 / (1 + exp(-(l.snr - 2.0) / 2.0)) AS pl FROM pk JOIN f_linear l ON pk.file = l.file AND pk.t = l.t JOIN dm ON pk.file = dm.file AND pk.t = dm.t)"""


def found(spark, sf_dir) -> DataFrame:
    start = F.lit(60000.0) + F.substring("file", 4, 20).cast("double")
    return search.search(recordings(spark, sf_dir), trials(spark), DT, start)


@query(FOUND + """ SELECT file, slice_id, round(least(0.99, greatest(0.05, snr / 10.0)), 4) AS detection_prob, dm_idx * 10.0::DOUBLE AS "dm_pc_cm-3", round(t * 0.001::DOUBLE, 6) AS t_sec_dm_time, t AS t_sample,
round(60000.0::DOUBLE + substr(file, 4)::DOUBLE + t * 0.001::DOUBLE / 86400.0::DOUBLE, 9) AS mjd_utc, snr AS snr_waterfall, snr_l AS snr_waterfall_linear, width::DOUBLE AS width_ms, round(pi, 4) AS class_prob_intensity, pi >= 0.6 AS is_burst_intensity,
round(pl, 4) AS class_prob_linear, pl >= 0.6 AS is_burst_linear, pi >= 0.6 OR pl >= 0.6 AS is_burst FROM found""")
def search_candidates(spark, sf_dir):
    """From recordings to the candidate table."""
    digits = {"detection_prob": 4, "t_sec_dm_time": 6, "mjd_utc": 9, "class_prob_intensity": 4, "class_prob_linear": 4, "width_ms": 3}
    c = found(spark, sf_dir)
    return c.select(*(F.round(f"`{n}`", digits[n]).alias(n) if n in digits else F.col(f"`{n}`") for n in c.columns))


def _patch_snr(name: str, value: str) -> str:
    """The highest filtered value of each candidate's own window in SQL."""
    over = "OVER (PARTITION BY file, peak ORDER BY k ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
    sums = ", ".join(f"round(sum(z) {over.format(w // 2, w - 1 - w // 2)} / {w**0.5!r}::DOUBLE, 6)" for w in astro.BOXCARS)
    return f""", a_{name} AS (SELECT f.file, f.t AS peak, st.t - delay - f.t + 32 AS k, sum({value})::BIGINT AS s FROM found f JOIN d ON d.dm_idx = f.dm_idx JOIN st ON st.file = f.file AND st.c = d.c
AND st.t - delay >= greatest(0, f.t - 32) AND st.t - delay < f.t + 32 GROUP BY ALL HAVING count(*) = {CHANS}),
b_{name} AS (SELECT file, peak, median(s) AS med, count(*) AS m FROM a_{name} GROUP BY ALL),
c_{name} AS (SELECT a.file, a.peak, k, s - med AS x, m, row_number() OVER (PARTITION BY a.file, a.peak ORDER BY s - med, k) - 1 AS r FROM a_{name} a JOIN b_{name} b ON a.file = b.file AND a.peak = b.peak),
e_{name} AS (SELECT file, peak, sqrt(coalesce(sum(x * x) FILTER (r >= m // 40 AND r < m - m // 40), 0) / (0.95::DOUBLE * max(m))) * 1.148::DOUBLE AS sg FROM c_{name} GROUP BY ALL),
h_{name} AS (SELECT c.file, c.peak, k, x / CASE WHEN sg > 0 THEN sg ELSE 1.0 END AS z FROM c_{name} c JOIN e_{name} e ON c.file = e.file AND c.peak = e.peak),
s_{name} AS (SELECT file, peak, max(snr) AS snr FROM (SELECT file, peak, greatest({sums}) AS snr FROM h_{name}) GROUP BY ALL)"""


@query(FOUND + _patch_snr("pi", "st.i") + _patch_snr("pl", "round(sqrt(st.q * st.q + st.u * st.u))::BIGINT") + """ SELECT f.file, (f.t // 256)::INT AS chunk_id, 0 AS band_id, f.slice_id::INT AS slice_id, f.t AS t_sample, round(f.t * 0.001::DOUBLE, 6) AS t_sec_waterfall,
CAST(round_even(greatest(0, f.t % 512 - 8) * 512.0::DOUBLE / 512, 0) AS INT) AS x1, 0 AS y1, CAST(round_even(least(511, f.t % 512 + 8) * 512.0::DOUBLE / 512, 0) AS INT) AS x2, 511 AS y2,
round(a.snr, 5) AS snr_patch_dedispersed, round(b.snr, 5) AS snr_patch_dedispersed_linear, f.file || '_slice' || f.slice_id || '_sample' || f.t || '_band0' AS patch_file
FROM found f LEFT JOIN s_pi a ON a.file = f.file AND a.peak = f.t LEFT JOIN s_pl b ON b.file = f.file AND b.peak = f.t""")
def candidate_boxes_and_patches(spark, sf_dir):
    """What the whole candidate table has besides search_candidates: chunk, band, box, values of the dedispersed patch, its name."""
    c = search.whole_candidates(found(spark, sf_dir), recordings(spark, sf_dir), trials(spark), DT, chunk=256, patch=64)
    names = ["file", "chunk_id", "band_id", "slice_id", "t_sample", "x1", "y1", "x2", "y2", "patch_file"]
    return c.select(*names, F.round("t_sec_waterfall", 6).alias("t_sec_waterfall"), *(F.round(x, 5).alias(x) for x in ("snr_patch_dedispersed", "snr_patch_dedispersed_linear")))


STOKES_WINDOWS = """, pw AS (SELECT f.file, f.t, s4.pol, (st.t - delay - f.t + 32) // 2 AS k, st.t, s4.v FROM found f JOIN d ON d.dm_idx = f.dm_idx
JOIN (SELECT t % {n} AS t, 'rec' || (t // {n}) AS file, c // 4 AS c, CASE c % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'q' WHEN 2 THEN 'u' ELSE 'v' END AS pol, q::DOUBLE AS v FROM w) s4 ON s4.file = f.file AND s4.c = d.c
JOIN (SELECT DISTINCT file, t FROM st) st ON st.file = f.file AND st.t = s4.t AND st.t - delay >= greatest(0, f.t - 32) AND st.t - delay < f.t + 32),
ps AS (SELECT file, t, pol, k, sum(v) AS s FROM pw GROUP BY ALL HAVING count(*) = 2 * {chans}),
pc AS (SELECT *, s - avg(s) OVER (PARTITION BY file, t, pol) AS x, CASE WHEN k < 8 THEN 0 WHEN k >= 24 THEN 1 END AS side FROM ps),
pd AS (SELECT *, CASE WHEN side IS NOT NULL THEN x - avg(x) OVER (PARTITION BY file, t, pol, side) END AS dd FROM pc)"""


@query(FOUND + STOKES_WINDOWS.format(n=LENGTH, chans=CHANS) + """ SELECT file, t, pol, count(*) AS n, round(avg(dd), 3) + 0.0 AS mean, round((median(dd) FILTER (side = 0) + median(dd) FILTER (side = 1)) / 2, 2) AS median,
round(stddev_pop(dd), 3) AS std, round(max(x), 3) AS burst, arg_min(k, (-round(x, 6), k))::INT AS pos FROM pd GROUP BY ALL""")
def pulse_window_stats(spark, sf_dir):
    """Noise and height of each Stokes value in the dedispersed window of each candidate, in bins of two samples."""
    c, r = found(spark, sf_dir), recordings(spark, sf_dir)
    peaks = c.select("file", F.col("t_sample").alias("t"), (F.col("`dm_pc_cm-3`") / 10).cast("int").alias("dm_idx"))
    s = search.window_stats(search.pulse_windows(peaks, r, trials(spark), ("file",), 32, 2), ("file",), 32)
    return s.select("file", "t", "pol", "n", (F.round("mean", 3) + F.lit(0.0)).alias("mean"), F.round("median", 2).alias("median"), F.round("std", 3).alias("std"), F.round("burst", 3).alias("burst"), "pos")


@query("""WITH c AS (SELECT vec_id, k - 1 AS cell, (k - 1) // 8 AS y, (k - 1) % 8 AS x, CAST(embedding[k] AS DOUBLE) AS v, CAST(embedding[65 - k] AS DOUBLE) AS o FROM embeddings, range(1, 65) r(k) WHERE len(embedding) = 64),
p AS (SELECT a.vec_id, a.cell, a.x, a.y, a.v, a.o FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL HAVING a.v >= max(b.v) AND a.v > 0.2)
SELECT vec_id AS image, cell::INT AS box_id, 0 AS kind, round((x + o - (1 + abs(v)) / 2) / 8, 6) AS x1, round((y + v - 1.0) / 8, 6) AS y1, round((x + o + (1 + abs(v)) / 2) / 8, 6) AS x2, round((y + v + 1.0) / 8, 6) AS y2, round(v, 6) AS score FROM p""")
def detector_decode(spark, sf_dir):
    """Vectors read as a network's map of 8 x 8 cells, its sizes and offsets made of the same values, as boxes."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") == 64)
    two = F.transform("embedding", lambda v: F.lit(2.0))
    maps = e.select(F.col("vec_id").alias("image"), F.col("embedding").alias("heat"), F.concat(F.transform("embedding", lambda v: 1 + F.abs(v.cast("double"))), two).alias("sizes"), F.concat(F.reverse("embedding"), "embedding").alias("offsets"))
    found_ = images.decode(maps, (8, 8), 0.2)
    return found_.select("image", "box_id", "kind", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")))


@query(FOUND + """ SELECT file, count(*) AS phase_1, count(*) FILTER (snr_l >= 2.0) AS phase_2, count(*) FILTER (pi >= 0.6) AS phase_1_3a, count(*) FILTER (snr_l >= 2.0 AND pi >= 0.6) AS phase_2_3a,
count(*) FILTER (pi >= 0.6 AND pl >= 0.6) AS phase_1_3a_3b, count(*) FILTER (snr_l >= 2.0 AND pi >= 0.6 AND pl >= 0.6) AS all_phases FROM found GROUP BY file""")
def search_phases(spark, sf_dir):
    """How many candidates of each recording every configuration of phases keeps."""
    return search.phase_counts(found(spark, sf_dir), 2.0)


@query(RECORDINGS + DELAYS + PEAKS + """, z AS (SELECT file, max(t) + 1 AS n FROM st GROUP BY file), y AS (SELECT max(delay) AS far FROM d WHERE dm_idx = 6),
a AS (SELECT pk.file, pk.t AS peak, n, far, least(64, greatest(32, n - far)) AS len FROM pk JOIN z ON pk.file = z.file, y),
b AS (SELECT *, CASE WHEN greatest(0, peak - len // 2) + len + far > n THEN greatest(0, n - len - far) ELSE greatest(0, peak - len // 2) END AS first FROM a),
cut AS (SELECT *, least(len, least(first + len + far, n) - first - far) AS fill FROM b)
SELECT o.file, peak, first, st.t - first - delay + (64 - fill) // 2 AS x, st.c, st.i AS value FROM cut o JOIN d ON dm_idx = 6 JOIN st ON st.file = o.file AND st.c = d.c AND st.t >= first + delay AND st.t < first + delay + fill""")
def dedisperse_patch_clamped(spark, sf_dir):
    """Windows of 64 samples around the peaks, moved and shrunk to what the recording holds and centred."""
    r = recordings(spark, sf_dir)
    return dedisperse.patches(found(spark, sf_dir).select("file", F.col("t_sample").alias("peak")), r, trials(spark).where("dm_idx = 6"), 64, ("file",), spec="i")


@query(WATERFALL + STOKES + """, x AS (SELECT t, c, t % 11 = 0 AS single, t % 3 <> 0 AND t % 11 <> 0 AS whole, t % 8 AS m, i::DOUBLE AS i, qq, u, v::DOUBLE AS v FROM st)
SELECT t, c, whole AS full_stokes, round(CASE WHEN single OR m = 5 THEN i WHEN m = 3 THEN qq WHEN m = 4 THEN v WHEN NOT whole THEN i WHEN m = 1 THEN sqrt(qq * qq + u * u) WHEN m = 2 THEN abs(v) ELSE i END, 3) AS value FROM x""")
def polarisation_select(spark, sf_dir):
    """Each way to ask for a polarisation, of recordings with full Stokes values, with four plain ones and with one."""
    s = spectra(spark, sf_dir)
    every = F.sequence(F.lit(0), F.floor(F.size("spec") / 4).cast("int") - 1)
    e = s.where(F.size("spec") >= 4).select("t", F.posexplode(F.transform(every, lambda k: F.slice("spec", k * 4 + 1, F.lit(4)))).alias("c", "pols"))
    pols = F.transform(F.when(F.col("t") % 11 == 0, F.slice("pols", 1, 1)).otherwise(F.col("pols")), lambda x: x.cast("double"))
    modes = F.array(*(F.lit(m) for m in ("intensity", " L", "Circular", "pol1", "pol9", "polx", "other", None)))
    mode, kind = F.get(modes, (F.col("t") % 8).cast("int")), F.when(F.col("t") % 3 == 0, "AABB").otherwise(" iquv")
    return e.select("t", "c", search.full_stokes(kind, F.size(pols)).alias("full_stokes"), F.round(search.select_pol(pols, mode, kind), 3).alias("value"))


@query("""WITH p AS (SELECT event_id, event_id % 3000 + 1 AS nchan, (user_id % 400 + 1) * 4e-6::DOUBLE AS dt, floor(value)::BIGINT AS halo, floor(value)::BIGINT AS top FROM events),
q AS (SELECT *, CASE WHEN nchan >= 512 THEN greatest(1, CAST(round_even(nchan / 512.0::DOUBLE, 0) AS BIGINT)) ELSE 1 END AS freq_rate, greatest(1, CAST(trunc(49.152::DOUBLE * 16e-6::DOUBLE / dt) AS BIGINT)) AS time_rate FROM p)
SELECT event_id, freq_rate, time_rate, nchan // freq_rate AS channels, CAST(ceil(halo / time_rate::DOUBLE) AS BIGINT) AS halo, top + 1 AS height FROM q""")
def derived_params(spark, sf_dir):
    """Rates that follow from channels and sampling time, and what a halo and a grid of trials come to with them."""
    e = table(spark, sf_dir, "events")
    p = e.select("event_id", (F.col("event_id") % 3000 + 1).alias("nchan"), ((F.col("user_id") % 400 + 1) * F.lit(4e-6)).alias("dt"), F.floor("value").alias("top"))
    freq_rate, time_rate = timegrid.auto_rates(F.col("nchan"), F.col("dt"))
    p = p.withColumns({"freq_rate": freq_rate, "time_rate": time_rate})
    return p.select("event_id", "freq_rate", "time_rate", F.floor(F.col("nchan") / F.col("freq_rate")).alias("channels"), timegrid.decimated_halo(F.col("top"), F.col("time_rate")).alias("halo"), timegrid.trial_rows(F.lit(0), F.col("top")).alias("height"))


@query("""WITH f AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), g AS (SELECT label, n, unnest(range(0, n // 30 + 2)) * 30 AS first FROM f)
SELECT label, first // 30 AS slice_id, first, least(first + 30, n) AS stop FROM g WHERE first < n AND least(first + 30, n) - first >= 15""")
def slice_validation(spark, sf_dir):
    """Planned slices of 30 samples, less those that begin past the end or are cut to under half."""
    f = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    g = f.select("label", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.floor(F.col("n") / 30) + 1) * 30, F.lit(30).cast("bigint"))).alias("first"))
    return timegrid.valid_slices(g, 30).select("label", F.floor(F.col("first") / 30).alias("slice_id"), "first", "stop")


@query(WATERFALL + " SELECT t // 4 AS t_bin, c // 8 AS c_bin, round(avg(q) FILTER (t % 8 >= 4 AND (t + c) % 5 <> 0), 4) AS value FROM w GROUP BY ALL")
def nanmean_bin(spark, sf_dir):
    """Means over bins of samples and channels without what isn't a number; a bin without any has none."""
    v = F.when((F.pmod("t", F.lit(8)) < 4) | (F.pmod(F.col("t") + F.col("c"), F.lit(5)) == 0), F.lit(float("nan"))).otherwise(F.col("q").cast("double"))
    return timegrid.nanmean_bin(waterfall(spark, sf_dir).withColumn("v", v), 4, 8, value="v").select("t_bin", "c_bin", F.round("value", 4).alias("value"))


@query(CANDIDATES + """, h AS (SELECT label, max(len(embedding)) AS n FROM embeddings GROUP BY label), f AS (SELECT label, unnest(range(0, n)) AS c FROM h),
m AS (SELECT label, avg(1.0::DOUBLE / ((1200.0::DOUBLE + c * 6.25::DOUBLE) * (1200.0::DOUBLE + c * 6.25::DOUBLE))) AS inv FROM f WHERE c > 0 GROUP BY label)
SELECT cand_id, round(mjd - 4148.808::DOUBLE * (snr * 50.0::DOUBLE) * inv / 86400.0::DOUBLE, 9) AS mjd FROM cand JOIN m ON file_id % 10 = label""")
def infinite_frequency_mean(spark, sf_dir):
    """Dates at infinite frequency by the mean over a recording's channels; channels without a frequency don't count."""
    h = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("n")).where("n > 0")
    f = h.select("label", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    freq = F.when(F.col("c") > 0, F.lit(FREQ0) + F.col("c") * F.lit(STEP)).otherwise(0.0)
    m = f.groupBy("label").agg(astro.mean_inverse_square(freq).alias("inv"))
    c = candidates(spark, sf_dir).withColumn("label", (F.col("file_id") % 10).cast("int"))
    return c.join(m.withColumn("label", F.col("label").cast("int")), "label").select("cand_id", F.round(astro.infinite_frequency_mjd_mean(F.col("mjd"), F.col("snr") * F.lit(50.0), F.col("inv")), 9).alias("mjd"))


@query(FLAGS + " SELECT kind, count(DISTINCT file_id) AS files, count(*) FILTER (validated) AS expected, count(*) FILTER (validated AND matched) AS found, bool_and(coalesce(NOT validated OR matched, false)) AS complete FROM f GROUP BY ROLLUP (kind)")
def case_totals(spark, sf_dir):
    """Pulses expected and found in each case and in all, and whether a case is complete."""
    f = flags(spark, sf_dir).select("kind", "file_id", "validated", "matched")
    # Files are counted from sums by file, so that no distinct set stands in one task.
    v, m = F.coalesce("validated", F.lit(False)), F.coalesce(F.col("validated") & F.col("matched"), F.lit(False))
    by = f.groupBy("kind", "file_id").agg(F.count_if(v).alias("expected"), F.count_if(m).alias("found"), F.every(F.coalesce(~F.col("validated") | F.col("matched"), F.lit(False))).alias("complete"))
    return by.rollup("kind").agg(F.count_distinct("file_id").alias("files"), F.sum("expected").alias("expected"), F.sum("found").alias("found"), F.every("complete").alias("complete"))


@query(OUT + """, g AS (SELECT lang, count(*) FILTER (i AND l) AS tp, count(*) FILTER (i AND NOT l) AS fp, count(*) FILTER (NOT i AND l) AS fn, count(*) FILTER (NOT i AND NOT l) AS tn FROM o GROUP BY lang),
r AS (SELECT lang, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS prec, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS spec FROM g)
SELECT lang, round(coalesce(recall / nullif(prec, 0), 0), 6) AS ratio, round(spec, 6) AS specificity, CASE WHEN recall > prec THEN 'sensitivity' ELSE 'precision' END AS favours FROM r""")
def phase_tradeoff(spark, sf_dir):
    """Recall over precision of each group: over 1 it favours sensitivity, under 1 precision."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    i, l_ = F.col("i"), F.col("l")
    g = outcomes(spark, sf_dir).groupBy("lang").agg(n(i & l_).alias("tp"), n(i & ~l_).alias("fp"), n(~i & l_).alias("fn"), n(~i & ~l_).alias("tn"))
    recall, precision = metrics.share(F.col("tp"), F.col("tp") + F.col("fn")), metrics.share(F.col("tp"), F.col("tp") + F.col("fp"))
    specificity = metrics.share(F.col("tn"), F.col("tn") + F.col("fp"))
    return g.select("lang", F.round(metrics.share(recall, precision), 6).alias("ratio"), F.round(specificity, 6).alias("specificity"), F.when(recall > precision, "sensitivity").otherwise("precision").alias("favours"))


@query("""WITH p AS (SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.chunk_samples') AS BIGINT), try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS n FROM events)
SELECT event_id, n AS chunk_samples, n % 16 AS rest, n > 0 AND n % 16 = 0 AS aligned FROM p""")
def chunk_alignment(spark, sf_dir):
    """Chunk sizes from reports that name them differently, and whether slices of 16 fill a chunk."""
    named = [F.get_json_object("props", f"$.{k}").try_cast("bigint") for k in ("chunk_samples", "k")]
    n = F.coalesce(*named, F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "events").select("event_id", n.alias("chunk_samples"), (n % 16).alias("rest"), ((n > 0) & (n % 16 == 0)).alias("aligned"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(l_tax AS DOUBLE) AS tax FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(0 AS BIGINT) AS chunk_index, q AS overlap_left, CAST(0 AS BIGINT) AS overlap_right, q + 5 AS valid_start, CAST(NULL AS BIGINT) AS valid_end, q * 2 AS valid_samples, tax < 0.04 AS overlap_sufficient, tax AS overlap_ratio, false AS continuity_with_previous FROM l WHERE l_linenumber % 3 >= 1
UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT), q + 1, q + 2, NULL, q + 9, q * 3, false, tax + 1, q % 2 = 0 FROM l WHERE l_linenumber % 3 = 2""")
def report_chunk_continuity(spark, sf_dir):
    """Reports of none to two chunks, made of each line item: the first as newer runs name its figures, the second as older ones."""
    q, tax = F.floor("l_quantity").cast("bigint"), F.col("l_tax").cast("double")
    newer = F.to_json(F.struct(F.struct(q.alias("overlap_left_decimated"), (q + 5).alias("valid_start_decimated"), (q * 2).alias("valid_samples")).alias("temporal_info"), (tax < 0.04).alias("overlap_sufficient"), tax.alias("overlap_vs_delay_ratio")))
    older = F.to_json(F.struct(F.col("l_linenumber").alias("chunk_idx"), (q + 1).alias("overlap_left_decimated"), (q + 2).alias("overlap_right_decimated"), (q + 9).alias("valid_end_decimated"), (q * 3).alias("valid_samples_decimated"), (tax + 1).alias("overlap_ratio"), (q % 2 == 0).alias("continuity_with_previous")))
    each = F.when(F.col("l_linenumber") % 3 == 2, F.concat_ws(",", newer, older)).when(F.col("l_linenumber") % 3 == 1, newer).otherwise("")
    reports = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit('{"chunks": ['), each, F.lit("]}")).alias("report"))
    return metrics.chunk_continuity(reports, "report", "l_orderkey", "l_linenumber")
