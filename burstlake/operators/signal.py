"""Detection on time series: normalisation, matched filter, peaks. Everything is grouped or windowed by bounded blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlake.functions.astro import BOXCARS
from burstlake.operators.ranking import beside, percentiles
from burstlake.operators.timegrid import with_halo


def integrate(samples: DataFrame, keys: tuple[str, ...] = ("t",), value: str = "q") -> DataFrame:
    """Sum over channels, and their number."""
    return samples.groupBy(*keys).agg(F.sum(value).alias("s"), F.count("*").alias("n_chan"))


def integrate_spectra(spectra: DataFrame, t: str = "t", spec: str = "spec", keys: tuple[str, ...] = ()) -> DataFrame:
    """The same where a sample's channels stand in one array: narrow, nothing is shuffled. Null channels add nothing and are counted."""
    total = F.aggregate(spec, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint")))
    return spectra.select(*keys, t, total.alias("s"), F.size(spec).cast("bigint").alias("n_chan"))


def prewhiten(samples: DataFrame, keys: tuple[str, ...] = ("c",), value: str = "q") -> DataFrame:
    """z-score of each channel over the block, population sigma, a sigma under 1e-6 counting as 1.

    Moments are aggregated (partly before the shuffle) to a row for each channel and joined back.
    """
    v = F.col(value).cast("decimal(38,0)")
    m = samples.groupBy(*keys).agg(F.sum(value).alias("s1"), F.sum(v * v).alias("s2"), F.count(value).alias("n"))
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2").cast("double") - F.col("s1").cast("double") * F.col("s1").cast("double") / F.col("n")) / F.col("n")
    sigma = F.sqrt(F.greatest(var, F.lit(0.0)))
    m = m.select(*keys, mean.alias("mean"), F.when(sigma < 1e-6, 1.0).otherwise(sigma).alias("sigma"))
    return samples.join(m, list(keys)).withColumn("z", (F.col(value) - F.col("mean")) / F.col("sigma"))


def block_normalize(series: DataFrame, block_len: int, t: str = "t", value: str = "s", keys: tuple[str, ...] = ()) -> DataFrame:
    """(x - block median) / block sigma, sigma from the middle 95 % by rank; blocks with an odd sigma become 0.

    sigma = sqrt(sum of squares without m // 40 values at either end / (0.95 m)) * 1.148, 1 if not positive. With three
    blocks or more, those whose sigma is over four population deviations from the median sigma are set to 0.
    """
    k = [*keys, "block"]
    w = Window.partitionBy(*k)
    # Medians, ranks and sums of a block are windows over the same key: one shuffle for all of them.
    b = series.withColumn("block", F.floor(F.col(t) / block_len).cast("long"))
    x = b.withColumns({"med": F.median(value).over(w), "m": F.count("*").over(w)}).withColumn("x", F.col(value) - F.col("med"))
    x = x.withColumn("rank", F.row_number().over(w.orderBy("x", t)) - 1)
    cut = F.floor(F.col("m") / 40)
    sq = F.sum(F.when((F.col("rank") >= cut) & (F.col("rank") < F.col("m") - cut), F.col("x") * F.col("x"))).over(w)
    x = x.withColumn("sigma", F.sqrt(sq / (F.lit(0.95) * F.col("m"))) * F.lit(1.148))
    x = x.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0))
    every = x.where("rank = 0").groupBy(*keys).agg(F.count("*").alias("blocks"), F.median("sigma").alias("mid"), F.stddev_pop("sigma").alias("dev"))
    x = x.join(F.broadcast(every), list(keys)) if keys else x.crossJoin(F.broadcast(every))
    odd = (F.col("blocks") >= 3) & (F.abs(F.col("sigma") - F.col("mid")) > 4 * F.col("dev"))
    return x.withColumn("z", F.when(odd, 0.0).otherwise(F.col("x") / F.col("sigma"))).drop("rank", "x", "med", "m", "blocks", "mid", "dev")


def series_normalize(series: DataFrame, t: str = "t", value: str = "s", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, z): the same over a whole series as one block of any length.

    The values left out at either end are those below and above two order statistics; of values equal to them as many are
    counted as stand between.
    """
    m, x = F.col("m"), F.col(value)
    ends = percentiles(series, keys, value, med=0.5, low=F.floor(m / 40), high=m - 1 - F.floor(m / 40))
    met = beside(series, ends, keys)
    off = lambda c: (F.col(c) - F.col("med")) * (F.col(c) - F.col("med"))
    parts = met.groupBy(*keys, "med", "low", "high").agg(F.count(x).alias("m"), F.count_if(x <= F.col("low")).alias("head"), F.count_if(x < F.col("high")).alias("tail"), F.sum(F.when((x > F.col("low")) & (x < F.col("high")), off(value))).alias("inner"))
    cut = F.floor(m / 40)
    kept = F.when(F.col("low") < F.col("high"), F.coalesce("inner", F.lit(0.0)) + (F.col("head") - cut) * off("low") + (m - cut - F.col("tail")) * off("high")).otherwise((m - 2 * cut) * off("low"))
    sigma = F.sqrt(kept / (F.lit(0.95) * m)) * F.lit(1.148)
    scale = parts.select(*keys, F.col("med").alias("mid"), F.when(sigma > 0, sigma).otherwise(1.0).alias("scale"))
    return beside(series, scale, keys).select(*keys, t, ((x - F.col("mid")) / F.col("scale")).alias("z"))


def matched_filter(series: DataFrame, chunk: int = 4096, t: str = "t", value: str = "z", widths: tuple[int, ...] = BOXCARS, keys: tuple[str, ...] = ()) -> DataFrame:
    """snr and width of the best boxcar at each sample; the first width wins a tie. snr is rounded to 6 digits.

    The series is cut into chunks with a halo of half the widest boxcar, so that each window stays within a task.
    """
    halo = max(widths)
    h = with_halo(series, t, chunk, halo)
    w = Window.partitionBy(*keys, "chunk_id").orderBy(t)
    sums = {x: F.round(F.sum(value).over(w.rowsBetween(-(x // 2), x - 1 - x // 2)) / F.lit(float(x) ** 0.5), 6) for x in widths}
    out = h.select("*", *(v.alias(f"b{x}") for x, v in sums.items()))
    best = F.greatest(*(F.col(f"b{x}") for x in widths))
    width = reduce(lambda a, x: a.when(F.col(f"b{x}") == best, F.lit(x)), widths, F)
    return out.where("owned").select(*keys, t, value, best.alias("snr"), width.alias("width"))


def without_gaps(series: DataFrame, value: str = "snr", keys: tuple[str, ...] = ()) -> DataFrame:
    """series with NaN as minus infinity and plus infinity as the highest finite value of its group (0 without one), so that neither is a peak."""
    v = F.col(value)
    top = series.groupBy(*keys).agg(F.max(F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)).alias("gap_top"))
    clean = F.when(F.isnan(v), F.lit(float("-inf"))).when(v == F.lit(float("inf")), F.coalesce("gap_top", F.lit(0.0))).otherwise(v)
    return beside(series, top, keys).withColumn(value, clean).drop("gap_top")


def local_peaks(snr: DataFrame, threshold: float, slice_len: int, t: str = "t", keys: tuple[str, ...] = ()) -> DataFrame:
    """Inner samples of each slice with snr at the threshold or above that are not below either neighbour."""
    s = snr.withColumn("slice_id", F.floor(F.col(t) / slice_len).cast("long"))
    w = Window.partitionBy(*keys, "slice_id").orderBy(t)
    s = s.withColumns({"before": F.lag("snr").over(w), "after": F.lead("snr").over(w)})
    hit = (F.col("snr") >= threshold) & (F.col("snr") >= F.col("before")) & (F.col("snr") >= F.col("after"))
    return s.where(hit).drop("before", "after")


def spaced(peaks: DataFrame, distance: int, t: str = "t", keys: tuple[str, ...] = ()) -> DataFrame:
    """Of each slice's peaks, from the left, those at least `distance` after the last one taken. A slice's peaks are few."""
    many = peaks.groupBy(*keys, "slice_id").agg(F.sort_array(F.collect_list(t)).alias("all"))
    none = F.array().cast("array<bigint>")
    fold = F.aggregate("all", none, lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= distance), F.concat(a, F.array(x))).otherwise(a))
    return many.select(*keys, "slice_id", F.explode(fold).alias(t))


def global_first(snr: DataFrame, taken: DataFrame, threshold: float, slice_len: int, t: str = "t", keys: tuple[str, ...] = ()) -> DataFrame:
    """Peaks of each slice in order: the highest sample first if it reaches the threshold, then the others by snr."""
    s = snr.withColumn("slice_id", F.floor(F.col(t) / slice_len).cast("long"))
    k = [*keys, "slice_id"]
    top = s.groupBy(*k).agg(F.max("snr").alias("snr"), F.max_by(t, F.struct("snr", -F.col(t))).alias(t)).where(F.col("snr") >= threshold)
    both = top.select(*k, t, "snr", F.lit(True).alias("is_global")).unionByName(taken.join(s.select(*k, t, "snr"), [*k, t]).select(*k, t, "snr", F.lit(False).alias("is_global")))
    one = both.groupBy(*k, t).agg(F.max("snr").alias("snr"), F.bool_or("is_global").alias("is_global"))
    order = Window.partitionBy(*k).orderBy(F.desc("is_global"), F.desc("snr"), t)
    return one.withColumn("rank", F.row_number().over(order))


def iqr_sigma(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Deviation from the quartiles of each group, of any size: their distance over that of a normal distribution's."""
    q = percentiles(df, keys, value, low=0.25, high=0.75)
    return q.select(*keys, ((F.col("high") - F.col("low")) / F.lit(1.349)).alias("sigma"))


def off_pulse(series: DataFrame, key: str, position: Column, size: Column, value: str) -> DataFrame:
    """Mean, median and deviation of the first and last quarter of each group, each quarter less its own mean."""
    side = F.when(position < F.floor(size / 4), F.lit(0)).when(position >= size - F.floor(size / 4), F.lit(1))
    off = series.withColumn("side", side).where("side is not null")
    # In two steps, as sums of numbers near 0 hardly depend on the order of rows.
    rough = off.groupBy(key, "side").agg(F.avg(value).alias("rough"))
    rest = off.join(rough, [key, "side"]).groupBy(key, "side", "rough").agg(F.avg(F.col(value) - F.col("rough")).alias("rest"))
    mean = rest.select(key, "side", (F.col("rough") + F.col("rest")).alias("mu"))
    flat = off.join(mean, [key, "side"]).withColumn("d", F.col(value) - F.col("mu"))
    return flat.groupBy(key).agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std")).join(percentiles(flat, (key,), "d", median=0.5), key)


def patch_normalize(patch: DataFrame, key: str, channel: str, value: str) -> DataFrame:
    """+1, over the channel's mean, clipped to the 5th and 95th percentile of the patch, then scaled to 0 and 1."""
    up = patch.withColumn("p", F.col(value) + F.lit(1.0))
    mean = up.groupBy(key, channel).agg(F.avg("p").alias("mu"))
    up = up.join(mean, [key, channel]).withColumn("p", F.col("p") / F.when(F.col("mu") == 0, 1.0).otherwise(F.col("mu")))
    up = up.join(percentiles(up, (key,), "p", lo=0.05, hi=0.95), key).withColumn("p", F.least("hi", F.greatest("lo", "p")))
    span = F.col("hi") - F.col("lo")
    return up.withColumn("norm", F.when(span > 0, (F.col("p") - F.col("lo")) / span).otherwise(0.0)).drop("p", "mu", "lo", "hi")
