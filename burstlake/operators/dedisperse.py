"""Dedispersion: a kernel over chunks of time and blocks of trials for whole planes, joins on times for single trials and patches."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake.functions.astro import K_KERNEL, delay_samples


def dm_grid(spark: SparkSession, dm_min: float, dm_max: float, trials: int) -> DataFrame:
    """One global grid, both ends included."""
    step = (dm_max - dm_min) / (trials - 1) if trials > 1 else 0.0
    return spark.range(trials).select(F.col("id").cast("int").alias("dm_idx"), (F.lit(float(dm_min)) + F.col("id") * F.lit(step)).alias("dm"))


def channels(spark: SparkSession, n: int, first: float, step: float) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("c"), (F.lit(first) + F.col("id") * F.lit(step)).alias("freq"))


def delays(grid: DataFrame, chans: DataFrame, dt: float, top: float) -> DataFrame:
    """(dm_idx, dm, c, delay): both sides are parameters of the search, trials and channels, not data."""
    each = grid.crossJoin(F.broadcast(chans))
    return each.select("dm_idx", "dm", "c", delay_samples(F.col("dm"), F.col("freq"), F.lit(top), dt).alias("delay"))


def delay_matrix(dms: np.ndarray, freqs: np.ndarray, dt: float, top: float) -> np.ndarray:
    """The delays of delays() as a matrix of trials and channels: the same operations in the same order."""
    f, ref = np.asarray(freqs, float), float(top)
    return np.trunc(K_KERNEL * np.asarray(dms, float)[:, None] * (1.0 / (f * f) - 1.0 / (ref * ref))[None] / dt).astype(np.int64)


@dataclass
class Tile:
    """A block of trials over a band of channels, and the least and greatest delay in it."""

    block: int
    band: int
    low: int
    high: int


def tiling(dms: np.ndarray, freqs: np.ndarray, dt: float, top: float, trials: int, values: int) -> tuple[list[Tile], int, int]:
    """(tiles, channels of a band, times of a chunk), so that a chunk with what its delays reach has about `values` values.

    One band of all channels if that can be; else bands are halved until the spread of delays in a tile fits.
    """
    wide = len(freqs)
    while True:
        tiles = []
        for b in range(0, len(dms), trials):
            d = delay_matrix(dms[b : b + trials], freqs, dt, top)
            tiles += [Tile(b // trials, k, int(part.min()), int(part.max())) for k, part in enumerate(d[:, c : c + wide] for c in range(0, len(freqs), wide))]
        spread = max((t.high - t.low for t in tiles), default=0)
        room = values // wide
        if 2 * spread <= room or wide == 1:
            return tiles, wide, int(min(1 << 16, max(256, spread, room - spread)))
        wide = -(-wide // 2)


def trial_sums(x: np.ndarray, delay: np.ndarray, length: int, group: int = 8) -> Iterator[np.ndarray]:
    """For each row of delay (trials x channels, from 0 on) the sum over channels of x (channels x times) moved up by its delays.

    Channels are taken in groups of neighbours: a group's delays against its earliest channel stay the same over many
    neighbouring trials, which share its sum, moved as a whole. Sums of whole numbers are exact in any order.
    """
    groups = [slice(c, min(c + group, len(x))) for c in range(0, len(x), group)]
    held: list[tuple[bytes, np.ndarray]] = [(b"", x[:0])] * len(groups)
    for row in delay:
        total = np.zeros(length, x.dtype)
        for k, g in enumerate(groups):
            first = int(row[g].min())
            shape = row[g] - first
            key = shape.tobytes()
            if held[k][0] != key:
                reach = x.shape[1] - int(shape.max())
                summed = np.zeros(reach, x.dtype)
                for channel, late in zip(x[g], shape.tolist(), strict=True):
                    summed += channel[late : late + reach]
                held[k] = (key, summed)
            total += held[k][1][first : first + length]
        yield total


def cube(spectra: DataFrame, dms: list[float] | np.ndarray, freqs: list[float] | np.ndarray, dt: float, top: float, width: int | None = None, keys: tuple[str, ...] = (), t: str = "t", spec: str = "spec", mid: int | None = None, trials: int = 256, values: int = 1 << 21) -> DataFrame:
    """(keys, dm_idx, t, full, mid, diff): mean over the channels that reach the time, that of the middle channel, and their difference.

    spectra: a row for each sample, spec one value for each of freqs. Times before 0, from `width` on, or that no sample
    reaches are left out; a sample that is missing, or too short an array, counts for none of its channels; null values
    count and add nothing, as do all values of repeated rows.

    Recordings are cut into chunks of time with what the delays of a block of trials reach beyond, each of which is one
    array of about `values` values in a task, whatever the number of trials and the length of the recording. Where
    delays reach too far for that, channels are cut into bands, whose sums are added up after. No row stands for a
    trial before its sums do.
    """
    dms, freqs = np.asarray(dms, float), np.asarray(freqs, float)
    tiles, wide, length = tiling(dms, freqs, dt, top, trials, values)
    bands = -(-len(freqs) // wide)
    whole = spectra.schema[spec].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    kind, number = ("long", np.int64) if whole else ("double", np.float64)

    near = F.array(*(F.struct(F.lit(x.block).alias("block"), F.lit(x.band).alias("band"), F.lit(x.low).cast("long").alias("low"), F.lit(x.high).cast("long").alias("high")) for x in tiles)).cast("array<struct<block: int, band: int, low: bigint, high: bigint>>")
    each = spectra.where(F.col(t).isNotNull() & F.col(spec).isNotNull()).select(*keys, F.col(t).cast("long").alias("cube_t"), F.col(spec).alias("cube_spec"), F.explode(near).alias("cube_tile"))
    part = F.col("cube_spec") if bands == 1 else F.slice("cube_spec", F.col("cube_tile.band") * wide + 1, F.lit(wide))
    chunk = F.sequence(F.floor((F.col("cube_t") - F.col("cube_tile.high")) / length), F.floor((F.col("cube_t") - F.col("cube_tile.low")) / length))
    each = each.select(*keys, F.col("cube_tile.block").alias("cube_block"), F.col("cube_tile.band").alias("cube_band"), F.explode(chunk).alias("cube_chunk"), "cube_t", F.transform(part, lambda v: v.cast(kind)).alias("cube_spec")).where("cube_chunk >= 0")

    names = [*keys, "cube_block", "cube_band", "cube_chunk"]
    shape = T.StructType([*(spectra.schema[k] for k in keys), *(T.StructField(c, x) for c, x in (("dm_idx", T.IntegerType()), ("t", T.LongType()), ("total", T.LongType() if whole else T.DoubleType()), ("n", T.LongType()), ("mid_total", T.LongType() if whole else T.DoubleType())))])
    low = {(x.block, x.band): (x.low, x.high) for x in tiles}

    def kernel(table: pa.Table) -> pa.Table:
        block, band, at = (table.column(c)[0].as_py() for c in ("cube_block", "cube_band", "cube_chunk"))
        first, last = low[block, band]
        begin, c0 = at * length, band * wide
        chans = min(wide, len(freqs) - c0)
        reach = length + last - first
        place = table.column("cube_t").to_numpy() - (begin + first)
        lists = table.column("cube_spec").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(number, copy=False)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        x = np.zeros((chans, reach), number)
        there = np.zeros((chans, reach), np.int64)
        rows = np.repeat(place, size)
        ok = within < chans
        np.add.at(x, (within[ok], rows[ok]), flat[ok])
        np.add.at(there, (within[ok], rows[ok]), 1)
        delay = delay_matrix(dms[block * trials : (block + 1) * trials], freqs[c0 : c0 + chans], dt, top) - first
        even = bool((there == there[0, 0]).all())
        counts = itertools.repeat(np.full(length, chans * there[0, 0])) if even else trial_sums(there, delay, length)
        out: list[list[np.ndarray]] = []
        stop = length if width is None else max(0, min(length, width - begin))
        for k, (total, n) in enumerate(zip(trial_sums(x, delay, length), counts, strict=False)):
            keep = np.nonzero(n[:stop])[0]
            centre = np.zeros(len(keep), number)
            if mid is not None and c0 <= mid < c0 + chans:
                centre = x[mid - c0, delay[k, mid - c0] + keep]
            out.append([np.full(len(keep), block * trials + k, np.int32), keep + begin, total[keep], n[keep], centre])
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        held = [pa.repeat(table.column(k)[0], len(columns[0])) for k in keys]
        return pa.Table.from_arrays([*held, *columns], names=[*keys, "dm_idx", "t", "total", "n", "mid_total"])

    out = each.groupBy(*names).applyInArrow(kernel, shape)
    if bands > 1:
        out = out.groupBy(*keys, "dm_idx", "t").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("mid_total").alias("mid_total"))
    full, middle = F.col("total") / F.col("n"), F.col("mid_total").cast("double") if mid is not None else F.lit(0.0)
    return out.select(*keys, "dm_idx", "t", full.alias("full"), middle.alias("mid"), (full - middle).alias("diff"))


def shifted(samples: DataFrame, delay: DataFrame, length: int, value: str = "q") -> DataFrame:
    """The block at one trial: each channel moved up by its delay, zeros at the tail."""
    met = samples.join(F.broadcast(delay.select("c", "delay")), "c")
    return met.withColumn("t", F.col("t") - F.col("delay")).where((F.col("t") >= 0) & (F.col("t") < length)).select("t", "c", value)


def best_dm(plane: DataFrame, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """The trial with the highest mean at each time, the first at a tie, and the spread over trials."""
    return plane.groupBy(*keys).agg(F.max_by("dm_idx", F.struct("full", -F.col("dm_idx"))).alias("dm_idx"), F.max("full").alias("peak"), F.stddev_pop("full").alias("spread"))


def patches(peaks: DataFrame, spectra: DataFrame, delay: DataFrame, length: int, keys: tuple[str, ...] = (), peak: str = "peak", t: str = "t", spec: str = "spec", least: int = 32) -> DataFrame:
    """(keys, peak, first, x, c, value): the dedispersed window of `length` samples around each peak at one trial.

    A window is moved so that it and the longest delay lie within the recording, shrunk to what there is (`least` at
    the fewest) and centred at x from 0 to length - 1; places without a row are padding and count as 0. A peak asks for
    its own samples only, which meet the spectra on equal keys and times; the delay table is a parameter and is broadcast.
    """
    n, far = F.col("n"), F.col("far")
    head = spectra.groupBy(*keys).agg((F.max(t) + 1).alias("n"))
    p = peaks.join(head, list(keys)) if keys else peaks.crossJoin(F.broadcast(head))
    p = p.crossJoin(F.broadcast(delay.agg(F.max("delay").alias("far"))))
    p = p.withColumn("len", F.least(F.lit(length), F.greatest(F.lit(least), n - far)))
    wanted = F.greatest(F.lit(0), F.col(peak) - F.floor(F.col("len") / 2))
    p = p.withColumn("first", F.when(wanted + F.col("len") + far > n, F.greatest(F.lit(0), n - F.col("len") - far)).otherwise(wanted))
    p = p.withColumn("fill", F.least(F.col("len"), F.least(F.col("first") + F.col("len") + far, n) - F.col("first") - far)).where("fill > 0")
    asked = p.select(*keys, peak, "first", "fill", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fill") - 1)).alias("k"))
    asked = asked.crossJoin(F.broadcast(delay.select("c", "delay"))).withColumn(t, F.col("first") + F.col("k") + F.col("delay"))
    met = asked.join(spectra.select(*keys, t, spec), [*keys, t])
    at = (F.col("k") + F.floor((F.lit(length) - F.col("fill")) / 2)).alias("x")
    return met.select(*keys, peak, "first", at, "c", F.get(spec, F.col("c")).alias("value"))
