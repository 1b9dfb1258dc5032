"""Further queries: patches around candidates, lookups in profiles and dictionaries, lists in text, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstlake.functions import astro, names
from burstlake.operators import dedisperse, signal, timegrid
from burstlake.plans.analytics_queries import FLAGS, flags
from burstlake.plans.registry import CANDIDATES, DT, FREQ0, STEP, WATERFALL, candidates, query, table, waterfall
from burstlake.plans.signal_queries import NCHAN, SERIES, SPACED, TOP, delay_sql, series

PATCH = 16


def trial(spark, dm: float):
    return dedisperse.delays(dedisperse.dm_grid(spark, dm, dm, 1), dedisperse.channels(spark, NCHAN, FREQ0, STEP), DT, TOP)


@query(WATERFALL + SPACED + f""", d AS (SELECT c, {delay_sql('56.7::DOUBLE')} AS delay FROM range({NCHAN}) h(c)), pk AS (SELECT t AS peak FROM k WHERE t IS NOT NULL)
SELECT peak, (w.t - d.delay) - peak + {PATCH // 2} AS x, w.c, q FROM w JOIN d ON w.c = d.c JOIN pk ON w.t - d.delay >= peak - {PATCH // 2} AND w.t - d.delay < peak + {PATCH // 2} WHERE w.t - d.delay >= 0""")
def dedisperse_patch(spark, sf_dir):
    """The dedispersed window around each peak: peaks give their window's times, which meet the shifted samples on equal times."""
    s = series(spark, sf_dir).select("t", F.col("s").cast("double").alias("snr"))
    peaks = signal.spaced(signal.local_peaks(s, 0.0, 512), 16).select(F.col("t").alias("peak"))
    times = peaks.withColumn("t", F.explode(F.sequence(F.col("peak") - PATCH // 2, F.col("peak") + PATCH // 2 - 1)))
    flat = dedisperse.shifted(waterfall(spark, sf_dir), trial(spark, 56.7), 1 << 60)
    return flat.join(times, "t").select("peak", (F.col("t") - F.col("peak") + PATCH // 2).alias("x"), "c", "q")


@query(WATERFALL + f", d AS (SELECT c, {delay_sql('56.7::DOUBLE')} AS delay FROM range({NCHAN}) h(c)), n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT ((w.t - d.delay) % n + n) % n AS t, w.c, q FROM w JOIN d ON w.c = d.c, n")
def roll_dedisperse(spark, sf_dir):
    """Each channel moved by its delay, around the end."""
    n = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    met = waterfall(spark, sf_dir).join(F.broadcast(trial(spark, 56.7).select("c", "delay")), "c").crossJoin(F.broadcast(n))
    return met.select(F.pmod(F.col("t") - F.col("delay"), "n").alias("t"), "c", "q")


@query(WATERFALL + SERIES + """, md AS (SELECT median(s) AS med, count(*) AS m FROM s), x AS (SELECT t, s - med AS x, m, row_number() OVER (ORDER BY s - med, t) - 1 AS r FROM s, md),
g AS (SELECT sqrt(sum(x * x) FILTER (r >= m // 40 AND r < m - m // 40) / (0.95::DOUBLE * max(m))) * 1.148::DOUBLE AS sg FROM x) SELECT t, round(x / CASE WHEN sg > 0 THEN sg ELSE 1 END, 6) AS z FROM x, g""")
def whole_series_normalize(spark, sf_dir):
    """The same normalisation over a series as one block, by exact order statistics instead of a sort in one task."""
    return signal.series_normalize(series(spark, sf_dir)).select("t", F.round("z", 6).alias("z"))


@query(WATERFALL + SPACED + " SELECT k.t, s.s AS snr, n AS n_chan, round((k.t - k.slice_id * 512) * (512 * 0.001::DOUBLE / 511), 6) AS t_sec FROM k JOIN s ON k.t = s.t")
def profile_lookup(spark, sf_dir):
    """Values of a profile at the candidates' samples, and their time on an axis that includes its end."""
    s = series(spark, sf_dir)
    peaks = signal.spaced(signal.local_peaks(s.select("t", F.col("s").cast("double").alias("snr")), 0.0, 512), 16)
    axis = (F.col("t") - F.col("slice_id") * 512) * F.lit(512 * 0.001 / 511)
    return peaks.join(s, "t").select("t", F.col("s").alias("snr"), "n_chan", F.round(axis, 6).alias("t_sec"))


@query("""SELECT event_id, user_id, value FROM events WHERE (user_id, event_type) IN
(SELECT user_id, event_type FROM events GROUP BY ALL HAVING max(value) > 0.75::DOUBLE * (SELECT max(value) FROM events))""")
def semi_join_ids(spark, sf_dir):
    """All rows of the groups whose best value is over three quarters of the best of all: some group always is."""
    e = table(spark, sf_dir, "events")
    best = e.agg((F.max("value") * F.lit(0.75)).alias("least"))
    ids = e.groupBy("user_id", "event_type").agg(F.max("value").alias("top")).crossJoin(F.broadcast(best)).where("top > least")
    return e.join(ids, ["user_id", "event_type"], "left_semi").select("event_id", "user_id", "value")


@query(CANDIDATES + ", f AS (SELECT file_id, min(mjd) AS start, max(mjd) AS stop, avg(snr) AS level FROM cand GROUP BY file_id) SELECT cand_id, round(start + t_sec / 86400, 9) AS mjd, round(stop - mjd, 6) AS left_days, round(level, 6) AS level FROM cand JOIN f USING (file_id)")
def file_dictionary_lookup(spark, sf_dir):
    """Per-file parameters (start, end, level) joined to candidates; Spark broadcasts them if they are small."""
    c = candidates(spark, sf_dir)
    f = c.groupBy("file_id").agg(F.min("mjd").alias("start"), F.max("mjd").alias("stop"), F.avg("snr").alias("level"))
    return c.join(f, "file_id").select("cand_id", F.round(F.col("start") + F.col("t_sec") / 86400.0, 9).alias("mjd"), F.round(F.col("stop") - F.col("mjd"), 6).alias("left_days"), F.round("level", 6).alias("level"))


@query("SELECT event_id, CASE WHEN value < 0 THEN '-' ELSE '' END || lpad((floor(abs(value) * 400 / 10000))::INT::VARCHAR, 2, '0') || ':' || lpad((floor(floor(abs(value) * 400) / 100) % 100)::INT::VARCHAR, 2, '0') || ':' || lpad((floor(abs(value) * 400) % 100)::INT::VARCHAR, 2, '0') AS angle FROM events")
def sexagesimal_angle(spark, sf_dir):
    """hhmmss as hh:mm:ss."""
    return table(spark, sf_dir, "events").select("event_id", names.angle(F.floor(F.col("value") * 400)).alias("angle"))


@query(r"SELECT page_id, unnest(regexp_extract_all(url, '\d+')) AS number FROM pages")
def listed_numbers(spark, sf_dir):
    """All numbers named in a text, one row each."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit(r"(\d+)"))).alias("number"))


@query("""WITH f AS (SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS n FROM embeddings), g AS (SELECT label, n, greatest(1, least(CAST(round_even(n / 30.0::DOUBLE, 0) AS BIGINT), least(8, n))) AS k FROM f GROUP BY ALL)
SELECT label, k AS slices, n // k AS shortest, n // k + CASE WHEN n % k > 0 THEN 1 ELSE 0 END AS longest, n // k + CASE WHEN n % k > 0 AND k - n % k <= k // 2 THEN 1 ELSE 0 END AS middle FROM g""")
def slice_plan_summary(spark, sf_dir):
    """Shortest, longest and upper middle length of each file's slices."""
    g = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("k", timegrid.slice_count(F.col("n"), 30, 8))
    b, r = F.floor(F.col("n") / F.col("k")), F.pmod("n", "k")
    more = lambda c: F.when(c, 1).otherwise(0)
    return g.select("label", F.col("k").alias("slices"), b.alias("shortest"), (b + more(r > 0)).alias("longest"), (b + more((r > 0) & (F.col("k") - r <= F.floor(F.col("k") / 2)))).alias("middle"))


@query(FLAGS + """, t AS (SELECT kind, count(*) AS n, count(*) FILTER (burst_i) AS b FROM f GROUP BY ROLLUP (kind)) SELECT kind, '{"candidates":' || n || ',"burst":' || b || ',"no_burst":' || (n - b) || '}' AS summary FROM t""")
def execution_summary(spark, sf_dir):
    """Counters for each group and in all, as JSON."""
    t = flags(spark, sf_dir).rollup("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("burst_i", F.lit(False))).alias("b"))
    return t.select("kind", F.to_json(F.struct(F.col("n").alias("candidates"), F.col("b").alias("burst"), (F.col("n") - F.col("b")).alias("no_burst"))).alias("summary"))


@query(WATERFALL + " SELECT label, round(median(1200.0::DOUBLE + c * 6.25::DOUBLE), 4) AS mid_freq, median(1200.0::DOUBLE + c * 6.25::DOUBLE) >= 1390 AS high, max(CASE WHEN c < 32 THEN 1200.0 + c * 6.25 END)::DOUBLE AS low_band_end, min(CASE WHEN c >= 32 THEN 1200.0 + c * 6.25 END)::DOUBLE AS high_band_begin FROM w GROUP BY label")
def frequency_predicate(spark, sf_dir):
    """Whether a recording's median frequency asks for the high-frequency search, and where its half bands meet."""
    f = F.lit(FREQ0) + F.col("c") * F.lit(STEP)
    # The channel table of a recording follows from its number of channels: no sample is unfolded.
    wide = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("n")).where("n > 0")
    return wide.select("label", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c")).groupBy("label").agg(F.round(F.median(f), 4).alias("mid_freq"), (F.median(f) >= 1390).alias("high"), F.max(F.when(F.col("c") < 32, f)).alias("low_band_end"), F.min(F.when(F.col("c") >= 32, f)).alias("high_band_begin"))


@query("""WITH h AS (SELECT page_id, url IS NOT NULL AND contains(url, '://') AS has_scheme, length(html) > 0 AS has_body, length(url) < 200 AS short FROM pages)
SELECT page_id, (CASE WHEN NOT has_scheme THEN 1 ELSE 0 END + CASE WHEN NOT has_body THEN 1 ELSE 0 END + CASE WHEN NOT short THEN 1 ELSE 0 END) AS problems, has_scheme AND has_body AND short AS ok FROM h""")
def integrity_rules(spark, sf_dir):
    """A list of named rules checked on every row: how many fail, and whether all hold."""
    rules = {"scheme": F.col("url").isNotNull() & F.col("url").contains("://"), "body": F.length("html") > 0, "short": F.length("url") < 200}
    failed = F.filter(F.array(*(F.when(~c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return table(spark, sf_dir, "pages").select("page_id", F.size(failed).alias("problems"), (F.size(failed) == 0).alias("ok"))


@query(CANDIDATES + " SELECT file_id, floor(t_sec / 3600)::BIGINT AS hour, count(*) AS n, round(max(snr), 6) AS peak, arg_max(cand_id, (snr, -cand_id)) AS best FROM cand GROUP BY ALL")
def hourly_peaks(spark, sf_dir):
    """The best candidate of each file and hour: the table form of the stream's windows."""
    c = candidates(spark, sf_dir)
    return c.groupBy("file_id", F.floor(F.col("t_sec") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.round(F.max("snr"), 6).alias("peak"), F.max_by("cand_id", F.struct("snr", -F.col("cand_id"))).alias("best"))


@query(CANDIDATES + """, o AS (SELECT *, CASE WHEN t_sec - lag(t_sec) OVER (PARTITION BY file_id ORDER BY t_sec, cand_id) < 1800 THEN 0 ELSE 1 END AS new FROM cand),
s AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY t_sec, cand_id ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT file_id, round(min(t_sec), 6) AS start, count(*) AS n, round(max(snr), 6) AS peak FROM s GROUP BY file_id, k""")
def burst_sessions(spark, sf_dir):
    """Candidates of a file that follow each other within half an hour, as one row."""
    c = candidates(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.round(F.col("t_sec") * 1e6).cast("bigint")))
    s = c.groupBy("file_id", F.session_window("ts", "30 minutes")).agg(F.min("t_sec").alias("start"), F.count("*").alias("n"), F.max("snr").alias("peak"))
    return s.select("file_id", F.round("start", 6).alias("start"), "n", F.round("peak", 6).alias("peak"))


@query(CANDIDATES + " SELECT cand_id, round(4150.0::DOUBLE * snr * (1 / (1100.0::DOUBLE * 1100.0::DOUBLE) - 1 / (1500.0::DOUBLE * 1500.0::DOUBLE)), 9) AS kernel_s, round(4148.8::DOUBLE * snr * (1 / (1100.0::DOUBLE * 1100.0::DOUBLE) - 1 / (1500.0::DOUBLE * 1500.0::DOUBLE)), 9) AS overlap_s, round(snr / (0.000241::DOUBLE * 1.21::DOUBLE), 6) AS inverse_ms FROM cand")
def delay_constants(spark, sf_dir):
    """The delay of each candidate with each of the constants in use, which differ in the fourth digit."""
    f = lambda k: F.round(astro.delay_seconds(F.col("snr"), F.lit(1100.0), F.lit(1500.0), k), 9)
    return candidates(spark, sf_dir).select("cand_id", f(astro.K_KERNEL).alias("kernel_s"), f(astro.K_OVERLAP).alias("overlap_s"), F.round(F.col("snr") / (F.lit(astro.K_INVERSE) * F.lit(1.21)), 6).alias("inverse_ms"))
