"""Scalar expressions of the search: dispersion delays, dates, boxes, scores and decisions. All are plain Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dispersion constants (MHz^2 s cm^3 / pc), one for each use.
K_KERNEL, K_OVERLAP, K_MJD, K_INVERSE = 4.15e3, 4.1488e3, 4.148808e3, 2.41e-4
# Widths of the matched filter, in samples.
BOXCARS = (1, 2, 3, 4, 6, 9, 14, 20, 30)
SECONDS_PER_DAY, MJD_UNIX = 86400.0, 40587.0


def delay_seconds(dm: Column, freq: Column, freq_ref: Column, k: float = K_KERNEL) -> Column:
    return F.lit(k) * dm * (F.lit(1.0) / (freq * freq) - F.lit(1.0) / (freq_ref * freq_ref))


def delay_samples(dm: Column, freq: Column, freq_ref: Column, dt: float, k: float = K_KERNEL) -> Column:
    """Whole samples, truncated toward zero."""
    return (delay_seconds(dm, freq, freq_ref, k) / F.lit(dt)).cast("bigint")


def reference_delay(dm: Column, freq: Column) -> Column:
    """Delay in ms against infinite frequency (GHz)."""
    return dm / (F.lit(K_INVERSE) * freq * freq)


def overlap_samples(dm_max: float, freq_min: float, freq_max: float, dt: float) -> int:
    """Halo of a chunk, rounded up; 1024 if the sampling time isn't positive."""
    if dt <= 0:
        return 1024
    return -int(-(K_OVERLAP * dm_max * (freq_min**-2 - freq_max**-2) / dt) // 1)


def mjd_from_timestamp(ts: Column) -> Column:
    """Days since the MJD epoch of a timestamp without zone, taken as UTC."""
    seconds = F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
    return F.lit(MJD_UNIX) + seconds / F.lit(SECONDS_PER_DAY)


def topocentric_mjd(tstart: Column, corrected: Column, t_sec: Column) -> Column:
    """Start (corrected if there, else plain, else 0) plus seconds."""
    return F.coalesce(corrected, tstart, F.lit(0.0)) + t_sec / F.lit(SECONDS_PER_DAY)


def infinite_frequency_mjd(mjd: Column, dm: Column, freq: Column) -> Column:
    return mjd - F.lit(K_MJD) * dm / (freq * freq) / F.lit(SECONDS_PER_DAY)


def mean_inverse_square(freq: Column) -> Column:
    """Aggregate: the mean of 1 / f^2 over channels that have a frequency."""
    return F.avg(F.when(freq > 0, F.lit(1.0) / (freq * freq)))


def infinite_frequency_mjd_mean(mjd: Column, dm: Column, inverse_square: Column) -> Column:
    """The same by the mean over channels instead of one frequency."""
    return mjd - F.lit(K_MJD) * dm * inverse_square / F.lit(SECONDS_PER_DAY)


def dm_classic(y: Column, dm_min: float, dm_max: float) -> Column:
    return F.lit(dm_min) + y * F.lit((dm_max - dm_min + 1) / 512.0)


def dm_of_row(row: Column, height: int, dm_min: float, dm_max: float) -> Column:
    return F.lit(float(dm_min)) if height <= 1 else F.lit(dm_min) + row / F.lit(float(height - 1)) * F.lit(float(dm_max - dm_min))


def significance(snr: Column, samples: Column, trials: Column) -> Column:
    return F.greatest(F.lit(0.0), snr - F.sqrt(F.lit(2.0) * F.ln(samples * trials)))


def confidence(snr: Column) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.05), snr / F.lit(10.0)))


def logistic(snr: Column, threshold: float) -> Column:
    """The default classifier: odds of a burst from the peak over the threshold."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(snr - F.lit(threshold)) / F.lit(2.0)))


def dm_range(dm: Column, low: float, high: float, factor: float, least: float, most: float) -> tuple[Column, Column]:
    """A window around dm, factor * dm to either side, its width kept within bounds, shifted to lie in [low, high]."""
    wide = F.when(dm > 0, dm * F.lit(2.0 * factor)).otherwise(F.lit(least))
    wide = F.least(F.lit(most), F.greatest(F.lit(least), wide))
    a, b = dm - wide / 2, dm + wide / 2
    first = F.when(a < low, F.lit(low)).when(b > high, F.greatest(F.lit(high) - wide, F.lit(low))).otherwise(a)
    last = F.when(a < low, F.least(F.lit(low) + wide, F.lit(high))).when(b > high, F.lit(high)).otherwise(b)
    return first, last


def decision(has_i: Column, has_l: Column, burst_i: Column, burst_l: Column, strict: Column) -> Column:
    """Whether a candidate is saved, given which classifiers ran, what they said, and whether only bursts count."""
    i, l_ = F.coalesce(burst_i, F.lit(False)), F.coalesce(burst_l, F.lit(False))
    both = F.when(strict, i & l_).otherwise(i | l_)
    return F.when(has_i & has_l, both).when(has_i, ~strict | i).when(has_l, ~strict | l_).otherwise(F.lit(False))


def half_width(slice_len: Column) -> Column:
    return F.greatest(F.lit(4), F.floor(slice_len / 64))


def to_grid(x: Column, size: Column) -> Column:
    """A sample of a slice on the 512-wide image, rounded half to even."""
    return F.bround(x * F.lit(512.0) / size).cast("int")
