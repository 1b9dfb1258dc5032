"""The search from recordings to candidates: polarisations, two series, peaks, dispersion at the peak, two classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlake.functions import astro
from burstlake.operators import signal
from burstlake.sources.catalog import CANDIDATE_COLUMNS
from burstlake.staging import cut

# The names of the two composed polarisations; any other name means the first one.
LINEAR, CIRCULAR = ("linear", "l", "lineal"), ("circular", "v", "c")


def full_stokes(pol_type: Column, npol: Column) -> Column:
    """Whether a recording holds I, Q, U and V."""
    return F.coalesce((F.upper(F.trim(pol_type)) == "IQUV") & (npol >= 4), F.lit(False))


def select_pol(pols: Column, mode: Column, pol_type: Column, default: int = 0) -> Column:
    """The value that mode asks for of an array with one value for each polarisation.

    polN is clamped to those there are (`default` if N isn't a number); linear and circular are composed of full Stokes
    values and `default` is taken without them; null and unknown modes give the first. An empty or null array gives null.
    """
    m, n = F.lower(F.trim(F.coalesce(mode, F.lit("")))), F.size(pols)
    at = lambda k: F.get(pols, F.lit(k))
    number = F.coalesce(F.replace(m, F.lit("pol"), F.lit("")).try_cast("int"), F.lit(default))
    indexed = F.get(pols, F.greatest(F.lit(0), F.least(n - 1, number)))
    plain = F.when(n == 1, at(0)).when(m.startswith("pol"), indexed).when(~full_stokes(pol_type, n), at(default))
    return plain.when(m.isin(*LINEAR), F.sqrt(at(1) * at(1) + at(2) * at(2))).when(m.isin(*CIRCULAR), F.abs(at(3))).otherwise(at(0))


def series_of(spectra: DataFrame, keys: tuple[str, ...], t: str = "t") -> DataFrame:
    """(keys, t, total, linear) of spectra with one array for each of i, q and u: sums over channels, narrow.

    The linear polarisation of a channel is rounded to whole counts, so that sums don't depend on an order.
    """
    zero = F.lit(0).cast("bigint")
    add = lambda a, x: a + F.coalesce(x, zero)
    power = F.zip_with("q", "u", lambda a, b: F.round(F.sqrt(a.cast("double") * a + b.cast("double") * b)).cast("bigint"))
    return spectra.select(*keys, t, F.aggregate("i", zero, add).alias("total"), F.aggregate(power, zero, add).alias("linear"))


def dm_at(peaks: DataFrame, spectra: DataFrame, delay: DataFrame, keys: tuple[str, ...], t: str = "t", spec: str = "i") -> DataFrame:
    """(keys, t, dm_idx): the trial with the highest mean over the channels that the recording reaches, at each peak.

    Only the samples that a peak's trials touch are moved: a peak asks for one time for each distinct delay, and those
    times meet the spectra on equal keys and times. A column that is flat over the trials gives the middle trial.
    """
    asked = delay.groupBy("delay").agg(F.collect_list(F.struct("dm_idx", "c")).alias("cells"))
    middle = delay.agg(F.floor((F.max("dm_idx") + 1) / 2).cast("int").alias("middle"))
    times = peaks.select(*keys, F.col(t).alias("peak")).crossJoin(F.broadcast(asked)).withColumn(t, F.col("peak") + F.col("delay"))
    met = times.join(spectra.select(*keys, t, spec), [*keys, t]).select(*keys, "peak", spec, F.explode("cells").alias("cell"))
    cells = met.select(*keys, "peak", F.col("cell.dm_idx").alias("dm_idx"), F.get(spec, F.col("cell.c")).alias("x")).where("x is not null")
    plane = cells.groupBy(*keys, "peak", "dm_idx").agg((F.sum("x") / F.count("*")).alias("full"))
    best = plane.groupBy(*keys, "peak").agg(F.max_by("dm_idx", F.struct("full", -F.col("dm_idx"))).alias("best"), F.stddev_pop("full").alias("spread"))
    flat = F.col("spread") < 1e-6
    return best.crossJoin(F.broadcast(middle)).select(*keys, F.col("peak").alias(t), F.when(flat, F.col("middle")).otherwise(F.col("best")).alias("dm_idx"))


def search(spectra: DataFrame, delay: DataFrame, dt: float, start: Column, threshold: float = 2.0, least_prob: float = 0.6, block: int = 500, slice_len: int = 512, distance: int = 16, strict: bool = False) -> DataFrame:
    """Candidates of recordings (file, t, i, q, u): the columns of a candidate table that this search fills.

    Both series are normalised by blocks and filtered in chunks with a halo; the highest sample of each slice of the
    total and peaks at least `distance` apart are candidates, from `threshold` on. Their trial is the best at the peak,
    their linear value that of the same sample, each classified by itself; is_burst is the decision on both. start is the
    date of a file's first sample, a column over file. Files are split by blocks, chunks and slices, so that a long one
    is many groups. An empty table gives none.
    """
    keys = ("file",)
    s = series_of(spectra, keys)

    def filtered(value: str) -> DataFrame:
        return signal.matched_filter(signal.block_normalize(s, block, value=value, keys=keys), keys=keys)

    strong = cut(filtered("total").select("file", "t", "snr", "width"))  # read by the peaks, their highest and the values at them
    taken = signal.spaced(signal.local_peaks(strong, threshold, slice_len, keys=keys), distance, keys=keys)
    first = signal.global_first(strong, taken, threshold, slice_len, keys=keys).select("file", "slice_id", "t")
    peaks = first.join(strong, ["file", "t"])
    weak = filtered("linear").select("file", "t", F.col("snr").alias("snr_l"))
    dm = delay.select("dm_idx", "dm").distinct()
    found = peaks.join(weak, ["file", "t"]).join(dm_at(peaks, spectra, delay, keys), ["file", "t"]).join(F.broadcast(dm), "dm_idx")
    prob_i, prob_l = astro.logistic(F.col("snr"), threshold), astro.logistic(F.col("snr_l"), threshold)
    seconds, burst_i, burst_l = F.col("t") * F.lit(dt), prob_i >= least_prob, prob_l >= least_prob
    return found.select(
        "file", F.col("slice_id").cast("int").alias("slice_id"), astro.confidence(F.col("snr")).alias("detection_prob"), F.col("dm").alias("dm_pc_cm-3"),
        seconds.alias("t_sec_dm_time"), F.col("t").cast("bigint").alias("t_sample"), astro.topocentric_mjd(start, F.lit(None).cast("double"), seconds).alias("mjd_utc"),
        F.col("snr").alias("snr_waterfall"), F.col("snr_l").alias("snr_waterfall_linear"), (F.col("width") * F.lit(dt * 1000)).alias("width_ms"),
        prob_i.alias("class_prob_intensity"), burst_i.alias("is_burst_intensity"), prob_l.alias("class_prob_linear"), burst_l.alias("is_burst_linear"),
        astro.decision(F.lit(True), F.lit(True), burst_i, burst_l, F.lit(strict)).alias("is_burst"),
    )


def patch_snr(peaks: DataFrame, spectra: DataFrame, delay: DataFrame, keys: tuple[str, ...], length: int, t: str = "t", spec: str = "i") -> DataFrame:
    """(keys, t, snr): the highest filtered value of each peak's window of `length` samples, dedispersed at its own trial and normalised by itself.

    peaks: (keys, t, dm_idx). A place counts if every channel has a sample for it. A peak asks for its own samples only;
    its window is one group of `length` rows at most.
    """
    asked = delay.groupBy("dm_idx", "delay").agg(F.collect_list("c").alias("chans"))
    chans = delay.agg(F.count_distinct("c").alias("chans_all"))
    k = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")
    want = peaks.select(*keys, F.col(t).alias("peak"), "dm_idx").join(F.broadcast(asked), "dm_idx").select(*keys, "peak", "delay", "chans", k)
    want = want.withColumn("at", F.col("peak") - length // 2 + F.col("k")).where("at >= 0").withColumn(t, F.col("at") + F.col("delay"))
    met = want.join(spectra.select(*keys, t, spec), [*keys, t]).select(*keys, "peak", "at", F.filter(F.transform("chans", lambda c: F.get(spec, c)), lambda v: v.isNotNull()).alias("v"))
    add = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, v: a + v)
    series = met.groupBy(*keys, "peak", "at").agg(F.sum(add).alias("s"), F.sum(F.size("v")).alias("n")).crossJoin(F.broadcast(chans)).where("n = chans_all")
    own = (*keys, "peak")
    z = signal.block_normalize(series.withColumn("k", F.col("at") - F.col("peak") + length // 2).select(*own, "k", "s"), length, t="k", keys=own)
    snr = signal.matched_filter(z, chunk=length, t="k", keys=own)
    return snr.groupBy(*own).agg(F.max("snr").alias("snr")).withColumnRenamed("peak", t)


def pulse_windows(peaks: DataFrame, spectra: DataFrame, delay: DataFrame, keys: tuple[str, ...], length: int, rate: int = 1, pols: tuple[str, ...] = ("i", "q", "u", "v"), t: str = "t") -> DataFrame:
    """(keys, t, pol, k, s): of each peak and polarisation the series over its window of `length` bins of `rate` samples, dedispersed at its own trial, less its mean.

    peaks: (keys, t, dm_idx). A sample counts if every channel has a value for it, a bin if all its samples do; s is the
    sum over channels. The window begins `length` / 2 bins before the peak. A peak asks for its own samples only.
    """
    asked = delay.groupBy("dm_idx", "delay").agg(F.collect_list("c").alias("chans"))
    every = delay.agg(F.count_distinct("c").alias("chans_all"))
    at = F.explode(F.sequence(F.lit(0), F.lit(length * rate - 1))).alias("at")
    want = peaks.select(*keys, F.col(t).alias("peak"), "dm_idx").join(F.broadcast(asked), "dm_idx").select(*keys, "peak", "delay", "chans", at)
    want = want.withColumn(t, F.col("peak") - (length // 2) * rate + F.col("at") + F.col("delay")).where(F.col(t) - F.col("delay") >= 0)
    values = lambda p: F.filter(F.transform("chans", lambda c: F.get(p, c)), lambda v: v.isNotNull())
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pol"), values(p).alias("v")) for p in pols))).alias("x")
    met = want.join(spectra.select(*keys, t, *pols), [*keys, t]).select(*keys, "peak", F.floor(F.col("at") / rate).cast("int").alias("k"), each)
    total = F.aggregate("x.v", F.lit(0.0), lambda a, v: a + v.cast("double"))
    series = met.groupBy(*keys, "peak", "x.pol", "k").agg(F.sum(total).alias("s"), F.sum(F.size("x.v")).alias("n")).crossJoin(F.broadcast(every)).where(F.col("n") == F.col("chans_all") * rate)
    own = Window.partitionBy(*keys, "peak", "pol")  # `length` rows at most
    return series.withColumn("s", F.col("s") - F.avg("s").over(own)).select(*keys, F.col("peak").alias(t), "pol", "k", "s")


def window_stats(windows: DataFrame, keys: tuple[str, ...], length: int, t: str = "t") -> DataFrame:
    """(keys, t, pol, n, mean, median, std, burst, pos): of pulse_windows(), the noise of the first and last quarter, each less its own mean, and the highest value and its bin."""
    own = [*keys, t, "pol"]
    side = F.when(F.col("k") < length // 4, 0).when(F.col("k") >= 3 * length // 4, 1)
    level = Window.partitionBy(*own, "side")
    flat = windows.withColumn("side", side).withColumn("d", F.when(F.col("side").isNotNull(), F.col("s") - F.avg("s").over(level)))
    middle = lambda k: F.median(F.when(F.col("side") == k, F.col("d")))  # noqa: E731  (a window is `length` rows at most)
    return flat.groupBy(*own).agg(
        F.count("*").alias("n"), F.avg("d").alias("mean"), ((middle(0) + middle(1)) / 2).alias("median"), F.stddev_pop("d").alias("std"),
        F.max("s").alias("burst"), F.max_by("k", F.struct("s", -F.col("k"))).alias("pos"),
    )


def normalised_windows(windows: DataFrame, stats: DataFrame, keys: tuple[str, ...], t: str = "t") -> DataFrame:
    """(keys, t, k, i, linear, v): windows less the noise's mean over its deviation (1 if that isn't positive), and the linear polarisation of such q and u."""
    own = [*keys, t, "pol"]
    z = windows.join(stats.select(*own, "mean", "std"), own).withColumn("z", (F.col("s") - F.coalesce("mean", F.lit(0.0))) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))
    of = lambda p: F.max(F.when(F.col("pol") == p, F.col("z")))
    one = z.groupBy(*keys, t, "k").agg(of("i").alias("i"), of("q").alias("q"), of("u").alias("u"), of("v").alias("v"))
    return one.select(*keys, t, "k", "i", F.sqrt(F.col("q") * F.col("q") + F.col("u") * F.col("u")).alias("linear"), "v")


def whole_candidates(found: DataFrame, spectra: DataFrame, delay: DataFrame, dt: float, slice_len: int = 512, chunk: int = 1 << 16, patch: int = 512, grid: int = 512) -> DataFrame:
    """All columns of the candidate table of what search() found, in their order: chunk, band, box, patch values and names besides.

    A box is as wide as half_width() to either side of the peak within its slice, spans all trials, and stands on an
    image of `grid` pixels a side. Barycentric dates are null. A peak whose window isn't covered by every channel
    anywhere has no patch values.
    """
    found = cut(found)
    dms = delay.select("dm_idx", "dm").distinct()
    peaks = found.join(F.broadcast(dms), F.col("dm") == F.col("`dm_pc_cm-3`")).select("file", F.col("t_sample").alias("t"), "dm_idx")
    power = F.zip_with("q", "u", lambda a, b: F.round(F.sqrt(a.cast("double") * a + b.cast("double") * b)).cast("bigint"))
    total = patch_snr(peaks, spectra, delay, ("file",), patch)
    linear = patch_snr(peaks, spectra.select("file", "t", power.alias("l")), delay, ("file",), patch, spec="l")
    named = lambda df, name: df.select("file", F.col("t").alias("t_sample"), F.col("snr").alias(name))
    at, half = F.pmod("t_sample", F.lit(slice_len)), astro.half_width(F.lit(slice_len))
    pixel = lambda x: F.bround(x * F.lit(float(grid)) / F.lit(float(slice_len))).cast("int")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "(?i)[.](fil|fits)$", "")
    extra = {
        "chunk_id": F.floor(F.col("t_sample") / chunk).cast("int"), "band_id": F.lit(0), "t_sec_waterfall": F.col("t_sec_dm_time"),
        "x1": pixel(F.greatest(F.lit(0), at - half)), "y1": F.lit(0), "x2": pixel(F.least(F.lit(slice_len - 1), at + half)), "y2": F.lit(grid - 1),
        "patch_file": F.concat(stem, F.lit("_slice"), F.col("slice_id"), F.lit("_sample"), F.col("t_sample"), F.lit("_band0")),
        **{c: F.lit(None).cast("double") for c in ("mjd_bary_utc", "mjd_bary_tdb", "mjd_bary_utc_inf", "mjd_bary_tdb_inf")},
    }
    both = found.join(named(total, "snr_patch_dedispersed"), ["file", "t_sample"], "left").join(named(linear, "snr_patch_dedispersed_linear"), ["file", "t_sample"], "left").withColumns(extra)
    return both.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in ((c.strip().rsplit(" ", 1)[0].strip("`"), c.strip().rsplit(" ", 1)[1]) for c in CANDIDATE_COLUMNS.split(", "))))


def phase_counts(candidates: DataFrame, threshold: float) -> DataFrame:
    """For each file: candidates, those also there in the linear series, and those that each stricter phase keeps."""
    seen, i, l_ = F.col("snr_waterfall_linear") >= threshold, F.col("is_burst_intensity"), F.col("is_burst_linear")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return candidates.groupBy("file").agg(F.count("*").alias("phase_1"), n(seen).alias("phase_2"), n(i).alias("phase_1_3a"), n(seen & i).alias("phase_2_3a"), n(i & l_).alias("phase_1_3a_3b"), n(seen & i & l_).alias("all_phases"))
