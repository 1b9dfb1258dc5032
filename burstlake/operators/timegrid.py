"""Time axes: chunks with halos, planned slices, decimation, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_of(t: Column, size: int) -> Column:
    return F.floor(t / size).cast("long")


def with_halo(df: DataFrame, t: str, size: int, halo: int) -> DataFrame:
    """Every sample once for each chunk whose halo holds it: adds chunk_id and owned. Narrow; rows grow by 2 * halo / size."""
    chunks = F.sequence(F.floor((F.col(t) - halo) / size), F.floor((F.col(t) + halo) / size))
    out = df.withColumn("chunk_id", F.explode(chunks))
    return out.where("chunk_id >= 0").withColumn("owned", F.col("chunk_id") == chunk_of(F.col(t), size))


def slice_count(n: Column, target: int, most: int) -> Column:
    """Slices of about target samples, between 1 and most, rounded half to even."""
    return F.greatest(F.lit(1), F.least(F.bround(n / F.lit(float(target))).cast("long"), F.least(F.lit(most), n)))


def slice_of(t: Column, n: Column, slices: Column) -> Column:
    """The slice of sample t when n samples are cut in `slices` parts, the first n mod slices of which have one more."""
    b, r = F.floor(n / slices), F.pmod(n, slices)
    head = r * (b + 1)
    return F.when(t < head, F.floor(t / (b + 1))).otherwise(r + F.floor((t - head) / b)).cast("long")


def slice_length(ms: Column, dt: Column, least: int = 612, low: int = 32, high: int = 2048) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.greatest(F.lit(least), F.floor(ms / 1000 / dt + 0.5)))).cast("int")


def decimate(samples: DataFrame, time_rate: int, freq_rate: int, keys: tuple[str, ...] = (), t: str = "t", c: str = "c", value: str = "q") -> DataFrame:
    """Sum over time_rate samples of the mean over freq_rate channels; what doesn't fill a bin is left out.

    Aggregates before it shuffles; keys may hold the polarisation.
    """
    tb, cb = F.floor(F.col(t) / time_rate).cast("long").alias("t_bin"), F.floor(F.col(c) / freq_rate).cast("long").alias("c_bin")
    out = samples.groupBy(*keys, tb, cb).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return out.where(F.col("n") == time_rate * freq_rate).withColumn("value", F.col("total") / F.lit(float(freq_rate)))


def fill_gaps(df: DataFrame, t: str, first: int, last: int, value: str, step: int = 1) -> DataFrame:
    """A row for each t from first to last, value 0 where df has none."""
    axis = df.sparkSession.range(first, last + 1, step).withColumnRenamed("id", t)
    return axis.join(df, t, "left").withColumn("is_gap", F.col(value).isNull()).withColumn(value, F.coalesce(value, F.lit(0)))


def auto_rates(nchan: Column, dt: Column, channels: int = 512, grid: float = 49.152 * 16e-6) -> tuple[Column, Column]:
    """Rates of channels and samples where none are set: about `channels` are left, and a sample is about `grid` seconds; 1 at least."""
    freq = F.when(nchan >= channels, F.bround(nchan / F.lit(float(channels))).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), freq), F.greatest(F.lit(1).cast("bigint"), (F.lit(grid) / dt).cast("bigint"))


def decimated_halo(halo: Column, rate: Column) -> Column:
    """Samples of a halo after decimation, rounded up so that none is lost."""
    return F.ceil(halo / rate)


def trial_rows(dm_min: Column, dm_max: Column) -> Column:
    """Rows of a plane with a trial for each unit, both ends included."""
    return (dm_max - dm_min + 1).cast("bigint")


def valid_slices(planned: DataFrame, slice_len: int, first: str = "first", n: str = "n") -> DataFrame:
    """Adds stop, where a slice of a recording of n samples ends; slices past its end or cut to under half are left out."""
    stop = F.least(F.col(first) + slice_len, F.col(n))
    return planned.withColumn("stop", stop).where((F.col(first) < F.col(n)) & (2 * (F.col("stop") - F.col(first)) >= slice_len))


def nanmean_bin(samples: DataFrame, time_rate: int, freq_rate: int, keys: tuple[str, ...] = (), t: str = "t", c: str = "c", value: str = "v") -> DataFrame:
    """Mean of what is a number in each bin of samples and channels, partial bins included; null in a bin without any."""
    tb, cb = F.floor(F.col(t) / time_rate).cast("long").alias("t_bin"), F.floor(F.col(c) / freq_rate).cast("long").alias("c_bin")
    return samples.groupBy(*keys, tb, cb).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("value"))
