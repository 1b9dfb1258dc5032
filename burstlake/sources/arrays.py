"""Array files with their own header (.npy) as tables: slices along the first axis, labels from folder names."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.sources.recordings import open_path
from burstlake.sources.scan import UNREADABLE
from burstlake.staging import cut

# How an array file begins, and the width of its header's length by version.
MAGIC, LENGTHS = b"\x93NUMPY", {1: 2, 2: 4, 3: 4}


def array_header(f) -> dict:
    """(kind, shape, fortran, body) of an array file; arrays of objects and of records are an error."""
    head = f.read_at(12, 0)
    if head[:6] != MAGIC or len(head) < 10 or head[6] not in LENGTHS:
        raise ValueError("not an array file")
    width = LENGTHS[head[6]]
    n = int.from_bytes(head[8 : 8 + width], "little")
    text = f.read_at(n, 8 + width)
    told = ast.literal_eval(text.decode("utf-8" if head[6] == 3 else "latin-1").strip())
    if not isinstance(told["descr"], str):
        raise ValueError("an array of records")
    kind = np.dtype(told["descr"])
    if kind.kind not in "biuf":
        raise ValueError(f"an array of {kind}")
    body = 8 + width + n
    if f.size() < body + math.prod(told["shape"]) * kind.itemsize:
        raise ValueError("the file ends within its array")
    return {"kind": kind, "shape": tuple(told["shape"]), "fortran": bool(told["fortran_order"]), "body": body}


def array_slice(f, head: dict, first: int, last: int) -> np.ndarray:
    """Places first to last - 1 of the first axis: one stretch of the file, or one for each place of the other axes where the first runs fastest."""
    shape, kind = head["shape"], head["kind"]
    inner = math.prod(shape[1:])
    if not head["fortran"]:
        raw = f.read_at((last - first) * inner * kind.itemsize, head["body"] + first * inner * kind.itemsize)
        return np.frombuffer(raw, kind).reshape(last - first, *shape[1:])
    raw = b"".join(f.read_at((last - first) * kind.itemsize, head["body"] + (k * shape[0] + first) * kind.itemsize) for k in range(inner))
    return np.frombuffer(raw, kind).reshape(last - first, *shape[1:], order="F")


def read_arrays(files: DataFrame, values: int = 1 << 22, most_tasks: int = 100_000) -> DataFrame:
    """(file, label, idx, shape, values, error) of a table of paths: a row for each place of an array's first axis.

    label is the name of the file's folder, shape that of a slice, values its numbers, the last axis running fastest.
    An array without axes is one row. Tasks read the headers and then slices of about `values` numbers, so that a file may
    be larger than a task; the driver opens none. A file that can't be read is a row with its error and nulls.
    """

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path in b["path"]:
                try:
                    with open_path(path) as f:
                        shape = array_header(f)["shape"] or (1,)
                    step = max(1, values // max(1, math.prod(shape[1:])))
                    rows += [(path, a, min(a + step, shape[0]), None) for a in range(0, shape[0], step)]
                except (*UNREADABLE, SyntaxError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file", "first", "last", "error"]).astype({c: "Int64" for c in ("first", "last")})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "idx", "shape", "values", "error"]
        for b in batches:
            for path, first, last, error in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x = None
                if error is None:
                    try:
                        with open_path(path) as f:
                            head = array_header(f)
                            head["shape"] = head["shape"] or (1,)
                            x = array_slice(f, head, first, last)
                    except UNREADABLE as e:
                        error = f"{type(e).__name__}: {e}"
                if x is None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.float64())), pa.array([error])], names=names)
                    continue
                n, inner = len(x), math.prod(x.shape[1:])
                flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * inner, pa.array(np.ascontiguousarray(x, np.float64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(first, last)), pa.array([list(x.shape[1:])] * n, pa.list_(pa.int32())), flat, pa.nulls(n, pa.string())], names=names)

    ranges = cut(files.where("path is not null").select("path").distinct().mapInPandas(plan, "file string, first bigint, last bigint, error string"))
    tasks = max(1, min(most_tasks, ranges.count()))
    rows = ranges.repartition(tasks, "file", "first").mapInArrow(read, "file string, idx bigint, shape array<int>, values array<double>, error string")
    return rows.select("file", F.element_at(F.split("file", "/"), -2).alias("label"), "idx", "shape", "values", "error")
