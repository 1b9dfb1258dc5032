"""Many recordings read in tasks from the start: headers, plans of ranges and samples; the driver opens no file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.sources import recordings
from burstlake.staging import cut

READERS = {"filterbank": recordings.FilterbankReader, "fits": recordings.FitsReader}
#: What a file that can't be read may raise.
UNREADABLE = (OSError, ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, struct.error)
RANGES = "file string, first bigint, last bigint, nsamples bigint, error string"


def plan_ranges(files: DataFrame, samples: int, first: int = 0, last: int | None = None, assume_header: bool = False) -> DataFrame:
    """(file, first, last, nsamples, error): the ranges of about `samples` samples of each path; an unreadable file is one row with its error."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path in b["path"]:
                try:
                    reader = READERS[recordings.file_kind(path)]({"path": path, "assume_header": str(assume_header)})
                    with recordings.open_path(path) as f:
                        n = reader.length(f, reader.layout(f))
                    end = n if last is None else min(n, last)
                    rows += [(path, a, min(a + samples, end), n, None) for a in range(first, end, samples)]
                except UNREADABLE as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file", "first", "last", "nsamples", "error"]).astype({c: "Int64" for c in ("first", "last", "nsamples")})

    return files.where("path is not null").select("path").distinct().mapInPandas(plan, RANGES)


def scan(files: DataFrame, time_rate: int = 1, freq_rate: int = 1, samples: int = 1 << 16, first: int = 0, last: int | None = None, assume_header: bool = False, most_tasks: int = 100_000) -> DataFrame:
    """(file, t, n, pols, error) of a table of paths: an array over channels, in order of rising frequency, for each polarisation.

    t counts bins of time_rate samples from the file's start, n is the number of bins of the whole file; a value is the sum over them of
    the mean over freq_rate channels, and what doesn't fill a bin is left out. Samples first to last - 1 are read, first
    being rounded up to a bin. Headers are read by tasks, which write the plan of ranges; each range is then read by the
    task that it is dealt to. A file or a range that can't be read is a row with its error and nulls; the others are read.
    """
    start = -(-first // time_rate) * time_rate
    plan = cut(plan_ranges(files, max(1, samples // time_rate) * time_rate, start, last, assume_header))
    tasks = max(1, min(most_tasks, plan.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, end, n, error in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if error is not None:
                    yield failed(path, None, error)
                    continue
                try:
                    yield from bins(path, begin, end, n)
                except UNREADABLE as e:
                    yield failed(path, begin // time_rate, f"{type(e).__name__}: {e}")

    def failed(path: str, t: int | None, error: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([t], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.list_(pa.float64()))), pa.array([error])], names=["file", "t", "n", "pols", "error"])

    def bins(path: str, begin: int, end: int, n: int) -> Iterator[pa.RecordBatch]:
        reader = READERS[recordings.file_kind(path)]({"path": path, "assume_header": str(assume_header)})
        with recordings.open_path(path) as f:
            lay, at, step = reader.layout(f), begin, time_rate
            while at + time_rate <= end:
                stop = min(at + step, end - (end - at) % time_rate)
                x = np.asarray(reader.block(f, lay, at, stop), float)  # (sample, pol, channel)
                chans = x.shape[2] // freq_rate
                step = max(1, recordings.BATCH_VALUES // max(1, x.shape[1] * x.shape[2] * time_rate)) * time_rate
                x = x[:, :, : chans * freq_rate].reshape(-1, time_rate, x.shape[1], chans, freq_rate)
                x = x.mean(4).sum(1) if freq_rate > 1 else x[..., 0].sum(1)
                rows, pols, _ = x.shape
                inner = pa.ListArray.from_arrays(np.arange(0, rows * pols * chans + 1, max(1, chans), dtype=np.int32) if chans else np.zeros(rows * pols + 1, np.int32), pa.array(x.ravel()))
                outer = pa.ListArray.from_arrays(np.arange(0, rows * pols + 1, pols, dtype=np.int32), inner)
                t = at // time_rate + np.arange(rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * rows), pa.array(t), pa.array(np.full(rows, n // time_rate)), outer, pa.nulls(rows, pa.string())], names=["file", "t", "n", "pols", "error"])
                at = stop

    # A number of its own, as rows of the plan are small and Spark would put them all into one task.
    return plan.repartition(tasks, "file", "first").mapInArrow(read, "file string, t bigint, n bigint, pols array<array<double>>, error string")


def stokes(scanned: DataFrame, scale: float = 1.0) -> DataFrame:
    """(file, t, i, q, u) of scan(), values times scale as whole counts: what the search takes. A polarisation that isn't there is an empty array; rows with errors are left out."""
    pol = lambda k: F.transform(F.coalesce(F.get("pols", F.lit(k)), F.array().cast("array<double>")), lambda x: F.round(x * scale).cast("bigint"))
    return scanned.where("error is null").select("file", "t", pol(0).alias("i"), pol(1).alias("q"), pol(2).alias("u"))
