"""Vectors as short codes: a codebook for each part of a vector, and memoised grid cells that leave few entries to compare with."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake.llm.shared import cut, mix

#: Components beyond this many units are an error: squared distances of parts with up to 512 components stay within 63 bits.
MOST = 1 << 26

#: Cells that a part's memo holds, and cells whose bounds, and pairs of part and entry whose distances, are computed at a time.
MEMO, BLOCK, PAIRS = 1 << 15, 1024, 1 << 17


class Cells:
    """The nearest entries of one part's codebook.

    Space is cut into cubic cells. A cell's memo holds the entries that aren't dominated across its box: those whose
    least distance to it isn't over the smallest of the entries' greatest distances. The nearest entry of every point of
    the cell, and all entries that tie with it, are among them, so that only they are compared exactly, in whole numbers.
    """

    def __init__(self, book: np.ndarray, memo: int = MEMO):
        self.book, self.memo, self.most = book, {}, memo
        self.real = book.astype(float)
        self.squares = (self.real * self.real).sum(1)
        spread = float(np.abs(self.real - self.real.mean(0)).mean()) if book.size else 0.0
        self.shift = max(0, int(math.log2(max(1.0, spread / 6))))
        self.factors = mix(np.arange(1, book.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def hashes(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((cells.astype(np.uint64) * self.factors).sum(1, dtype=np.uint64))

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell its entries, ascending. A ball around the box rules most entries out by products of matrices."""
        width = float(1 << self.shift)
        half = (width - 1) / 2
        mid = cells * width + half
        square = np.maximum((mid * mid).sum(1)[:, None] - 2 * mid @ self.real.T + self.squares, 0)
        away = np.sqrt(square)
        # What rounding may add to a distance is far below this.
        slack = 1e-3 + 1e-6 * float(away.max(initial=0.0)) + math.sqrt(float(square.max(initial=0.0)) + float(self.squares.max())) * 1e-5
        ball = half * math.sqrt(mid.shape[1]) + slack
        at, entry = np.nonzero(away <= (away.min(1) + 2 * ball)[:, None])
        apart = np.abs(mid[at] - self.real[entry])
        low, high = (np.maximum(apart - half, 0) ** 2).sum(1), ((apart + half) ** 2).sum(1)
        first = np.searchsorted(at, np.arange(len(cells)))
        kept = low <= (np.minimum.reduceat(high, first) * (1 + 1e-9))[at]
        at, entry = at[kept], entry[kept]
        return np.split(entry, np.searchsorted(at, np.arange(1, len(cells))))

    def candidates(self, cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(place, lists): the list of each row's cell, looked up or computed once for all rows of a cell."""
        h = self.hashes(cells)
        keys, first, place = np.unique(h, return_index=True, return_inverse=True)
        mine = cells[first]
        lists: list = [None] * len(keys)
        for k, key in enumerate(keys.tolist()):
            held = self.memo.get(key)
            if held is not None and held[0] == mine[k].tobytes():
                lists[k] = held[1]
        new = [k for k, x in enumerate(lists) if x is None]
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
        for a in range(0, len(new), BLOCK):
            some = new[a : a + BLOCK]
            for k, entries in zip(some, self.undominated(mine[some]), strict=True):
                lists[k] = entries
                if len(self.memo) < self.most:
                    self.memo[int(keys[k])] = (mine[k].tobytes(), entries)
        other = (cells != mine[place]).any(1)  # another cell with the same hash: all entries
        if other.any():
            place = np.where(other, len(lists), place)
            lists.append(np.arange(len(self.book)))
        return place, lists

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its nearest entry, of ties the first, and the squared distance to it."""
        place, lists = self.candidates(parts >> self.shift)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, begin = np.concatenate(lists), np.cumsum(size) - size
        best, least = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        n, a = size[place], 0
        ends = np.cumsum(n)
        while a < len(parts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + PAIRS, "right")))
            m = n[a:b]
            start = np.cumsum(m) - m
            row = np.repeat(np.arange(b - a), m)
            entry = flat[np.arange(len(row)) - start[row] + begin[place[a:b]][row]]
            gap = parts[a:b][row] - self.book[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            low = np.minimum.reduceat(d, start)
            hit = np.nonzero(d == low[row])[0]
            hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
            best[a:b], least[a:b] = entry[hit], low
            a = b
        return best, least


@dataclass
class Codebooks:
    """books: for each part its entries, whole numbers in units of 1 / scale."""

    books: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and place, separated by commas; lowercase."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for: the middle of each unit."""
        at = bytes.fromhex(code)
        return (np.concatenate([b[k] for b, k in zip(self.books, at, strict=True)]) + 0.5) / self.scale


def whole_units(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, units): floor(scale * x) of each component as little-endian 32-bit integers, without invalid vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(2)
            size = np.diff(e.offsets.to_numpy())
            flat = e.values.slice(e.offsets[0].as_py(), int(size.sum())) if len(e) else e.values
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            begin = np.cumsum(size) - size
            good = np.ones(len(e), bool) if not e.null_count else np.asarray(e.is_valid())
            good &= (size > 0) & (size % parts == 0)
            bad = ~np.isfinite(x)
            if bad.any():
                good[np.repeat(np.arange(len(e)), size)[bad]] = False
            units = np.floor(np.where(bad, 0, x) * scale)
            if (np.abs(units[np.repeat(good, size)]) > MOST).any():
                raise ValueError(f"a component is beyond {MOST} units of 1 / {scale}")
            packed = np.where(np.abs(units) > MOST, 0, units).astype("<i4")
            rows = np.nonzero(good)[0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array([packed[begin[k] : begin[k] + size[k]].tobytes() for k in rows.tolist()], pa.binary())],
                names=["vec_id", "label", "units"],
            )

    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    shape = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", own.schema["label"].dataType), T.StructField("units", T.BinaryType())])
    return own.mapInArrow(work, shape)


def matrices(batches: Iterator[pa.RecordBatch], dims: int, rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """About `rows` rows at a time, with their units as a matrix of 64-bit integers."""
    held, n = [], 0

    def out():
        t = pa.Table.from_batches(held)
        flat = b"".join(t.column("units").to_pylist())
        return t, np.frombuffer(flat, "<i4").reshape(-1, dims).astype(np.int64)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def sums_of_entries(units: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """(part, entry, n, s0 ...): for each entry that is nearest to some part the number and the sum of those; added up in tasks before the shuffle."""
    width = books[0].shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for _, m in matrices(batches, dims):
            for p, c in enumerate(cells):
                mine = m[:, p * width : (p + 1) * width]
                best, _ = c.nearest(mine)
                count[p] += np.bincount(best, minlength=len(c.book))
                np.add.at(total[p], best, mine)
        part = np.repeat(np.arange(len(books), dtype=np.int32), [len(b) for b in books])
        entry = np.concatenate([np.arange(len(b), dtype=np.int32) for b in books])
        n, s = np.concatenate(count), np.concatenate(total)
        used = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (part, entry, n, *s.T)], names=["part", "entry", "n", *(f"s{k}" for k in range(width))])

    columns = [f"s{k}" for k in range(width)]
    each = units.mapInArrow(work, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in columns))
    return each.groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *columns]))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error), codebooks): each vector as the nearest entries of its parts, learnt from all vectors.

    Components count in whole units of 1 / scale, rounded down, so that sums and distances are exact and reruns agree.
    Codebooks begin as the parts of the `entries` (256 at most) vectors with the smallest vec_id, nulls last, and of equal ids by content;
    each round moves an entry to the mean, rounded down, of the parts that it is nearest to; unused entries stay. code
    has two hexadecimal digits for each part, error is the squared distance in units. Vectors that are null, empty, or
    hold null or non-finite components are left out, as are those of another length than the most frequent one that is a
    multiple of `parts` (of equally frequent ones the longest). Repeated rows are rows like others; an empty table gives
    none, and empty codebooks. Components beyond MOST units are an error. Other columns are left out.

    Tasks return a row for each entry at most, which are added up by Spark; the driver gets the codebooks alone.
    """
    units = cut(whole_units(vectors, vec_id, embedding, label, parts, scale))
    lengths = units.groupBy((F.octet_length("units") / 4).cast("int").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    shape = T.StructType([*units.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if lengths is None:
        return units.sparkSession.createDataFrame([], shape), Codebooks([np.empty((0, 0), np.int64)] * parts, scale)
    dims = lengths["dims"]
    width = dims // parts
    units = units.where(F.octet_length("units") == 4 * dims)
    head = units.select("vec_id", "units").orderBy(F.asc_nulls_last("vec_id"), "units").limit(min(entries, 256)).collect()
    first = np.array([np.frombuffer(bytes(r["units"]), "<i4") for r in head]).astype(np.int64)
    books = [np.ascontiguousarray(first[:, p * width : (p + 1) * width]) for p in range(parts)]
    for _ in range(rounds):
        for r in sums_of_entries(units, books, dims).collect():  # a row for each entry of a codebook at most
            books[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // int(r["n"]) for k in range(width)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for t, m in matrices(batches, dims):
            code, error = np.empty((len(m), parts), np.uint8), np.zeros(len(m), np.int64)
            for p, c in enumerate(cells):
                code[:, p], least = c.nearest(m[:, p * width : (p + 1) * width])
                error += least
            digits = code.tobytes().hex()
            codes = pa.array([digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)])
            yield from t.select(["vec_id", "label"]).append_column("code", codes).append_column("error", pa.array(error)).to_batches()

    return units.mapInArrow(work, shape), Codebooks(books, scale)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors added up over rows of an equal label, nulls together. Reads coded twice: hand over a table."""
    each = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(each, F.col("label").eqNullSafe(F.col("of"))).drop("of")
