"""Recordings as tables: filterbank and PSRFITS files through Spark's Python data source interface.

`register(spark)`, then `spark.read.format("filterbank").load(path)`, or "psrfits", or "fits" for plain images as well. Rows are
(file, sample_idx, pol, spec), one for each sample and polarisation, spec in order of rising frequency. Files are read
in ranges of samples, each a partition, through pyarrow's file systems, so that a path may be in any store it knows. A
filter on sample_idx is pushed down to the ranges.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "file string, sample_idx bigint, pol int, spec array<float>"
#: Header keys that hold text and double precision numbers; all others hold 32-bit integers.
TEXT_KEYS = {"rawdatafile", "source_name"}
DOUBLE_KEYS = {"az_start", "za_start", "src_raj", "src_dej", "tstart", "tsamp", "fch1", "foff", "refdm"}
#: How a sample of so many bits is held: whole numbers up to 16 bits, floating point above; fewer than 8 bits are packed in bytes.
KINDS = {8: np.uint8, 16: np.int16, 32: np.float32, 64: np.float64}
PACKED = (1, 2, 4)
#: A batch of spectra has about so many values.
BATCH_VALUES = 1 << 22
#: What a file without a filterbank header is taken for, where the reader is told to assume one.
ASSUMED_HEADER = {"nchans": 512, "tsamp": 8.192e-5, "fch1": 1500.0, "foff": -1.0, "nbits": 8, "nifs": 1, "header_size": 512}
SUFFIXES = {".fil": "filterbank", ".fits": "fits"}


def file_kind(path: str) -> str:
    for suffix, kind in SUFFIXES.items():
        if path.lower().endswith(suffix):
            return kind
    raise ValueError(f"neither a filterbank nor a FITS file: {path}")


def open_path(path: str):
    """A random-access file of any store that pyarrow knows."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def filterbank_header(f, assume: bool = False) -> dict:
    """The header's keys, `header_size`, and `nsamples` from the file's length. A file without header has ASSUMED_HEADER, if asked for."""
    try:
        h = own_header(f)
    except (ValueError, struct.error) as e:
        if not assume:
            raise ValueError(f"no filterbank header: {e}") from e
        h = dict(ASSUMED_HEADER)
    h["nsamples"] = max(0, f.size() - h["header_size"]) * 8 // (h["nchans"] * h["nifs"] * h["nbits"])
    return h


def own_header(f) -> dict:
    f.seek(0)

    def text() -> str:
        n = struct.unpack("<i", f.read(4))[0]
        if not 0 <= n <= 255:
            raise ValueError("not a filterbank header")
        return f.read(n).decode("utf-8", "ignore")

    if text() != "HEADER_START":
        raise ValueError("not a filterbank header")
    h: dict = {}
    while (key := text()) != "HEADER_END":
        h[key] = text() if key in TEXT_KEYS else struct.unpack("<d", f.read(8))[0] if key in DOUBLE_KEYS else struct.unpack("<i", f.read(4))[0]
    h["header_size"] = f.tell()
    h.setdefault("nifs", 1)
    return h


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class Ranges(DataSourceReader):
    """Splits files into ranges of samples; filters on sample_idx narrow them. Subclasses give layouts, sizes and rows."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.step = int(options.get("samples", 1 << 16))
        self.assume = str(options.get("assume_header", "false")).lower() == "true"
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("sample_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = f.value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = v + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            with open_path(p) as f:
                n = self.length(f, self.layout(f))
            end = n if self.high is None else min(n, self.high)
            out += [Range(p, a, min(a + self.step, end)) for a in range(min(self.low, end), end, self.step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.last <= part.first:
            return
        first, step = part.first, 0
        with open_path(part.path) as f:
            lay = self.layout(f)
            while first < part.last:
                # One sample tells how wide a row is; then batches have a bounded number of values.
                last = min(part.last, first + max(1, step))
                block = np.ascontiguousarray(self.block(f, lay, first, last), np.float32)  # (sample, pol, channel)
                n, pols, chans = block.shape
                step = max(1, BATCH_VALUES // max(1, pols * chans))
                spec = pa.ListArray.from_arrays(np.arange(0, n * pols * chans + 1, chans, dtype=np.int32), pa.array(block.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * (n * pols)), pa.array(np.repeat(np.arange(first, last), pols)), pa.array(np.tile(np.arange(pols, dtype=np.int32), n)), spec], names=["file", "sample_idx", "pol", "spec"])
                first = last

    def layout(self, f) -> dict:
        raise NotImplementedError

    def length(self, f, lay: dict) -> int:
        raise NotImplementedError

    def block(self, f, lay: dict, first: int, last: int) -> np.ndarray:
        raise NotImplementedError


class FilterbankReader(Ranges):
    def layout(self, f) -> dict:
        return filterbank_header(f, self.assume)

    def length(self, f, lay: dict) -> int:
        return lay["nsamples"]

    def block(self, f, h: dict, first: int, last: int) -> np.ndarray:
        values, bits = h["nchans"] * h["nifs"], h["nbits"]
        begin, end = first * values * bits, last * values * bits
        raw = f.read_at(-(-end // 8) - begin // 8, h["header_size"] + begin // 8)
        if bits in PACKED:  # the first value of a byte stands in its lowest bits
            flat = (np.frombuffer(raw, np.uint8)[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)) & ((1 << bits) - 1)
            data = flat.ravel()[begin % 8 // bits :][: (last - first) * values]
        elif bits in KINDS:
            data = np.frombuffer(raw, KINDS[bits])
        else:
            raise ValueError(f"samples of {bits} bits")
        data = data.reshape(-1, h["nifs"], h["nchans"])
        return data[:, :, ::-1] if h["foff"] < 0 else data


class Filterbank(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filterbank"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilterbankReader(self.options)


# ---- FITS -------------------------------------------------------------------------------------------------------------


def cards(f, at: int) -> tuple[dict, int]:
    """The keyword cards of the header at a position, and where it ends."""
    out: dict = {}
    while True:
        block = f.read_at(2880, at).decode("latin-1")
        if len(block) < 2880:
            raise ValueError("a FITS header without end")
        at += 2880
        for k in range(0, 2880, 80):
            card = block[k : k + 80]
            key = card[:8].strip()
            if key == "END":
                return out, at
            if card[8:10] == "= ":
                out[key] = value(card[10:])


def value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while (end := text.find("'", end)) >= 0 and text[end : end + 2] == "''":
            end += 2
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def hdus(f) -> Iterator[tuple[dict, int]]:
    """The cards of each header of a file, and where its data begin."""
    at = 0
    while at < f.size():
        head, body = cards(f, at)
        yield head, body
        axes = [head[f"NAXIS{k + 1}"] for k in range(head.get("NAXIS", 0))]
        size = abs(head.get("BITPIX", 8)) // 8 * head.get("GCOUNT", 1) * (head.get("PCOUNT", 0) + math.prod(axes)) if axes else 0
        at = body + -(-size // 2880) * 2880


def psrfits_layout(f) -> dict:
    """Primary and SUBINT cards, where the table begins, its row length, and the offset, form and count of each column."""
    heads = hdus(f)
    primary, _ = next(heads, ({}, 0))
    sub, body = next(((h, b) for h, b in heads if h.get("EXTNAME") == "SUBINT"), (None, 0))
    if sub is None:
        raise ValueError("no table SUBINT")
    columns, offset, dims = {}, 0, []
    width = {"B": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "A": 1, "L": 1}
    for k in range(1, sub["TFIELDS"] + 1):
        form = sub[f"TFORM{k}"]
        n = int(form[:-1] or 1)
        columns[sub[f"TTYPE{k}"]] = (offset, form[-1], n)
        offset += -(-n // 8) if form[-1] == "X" else n * width[form[-1]]
        if sub[f"TTYPE{k}"] == "DATA":
            dims = [int(x) for x in str(sub.get(f"TDIM{k}", "")).strip("() ").split(",") if x.strip()]
    # Axes are (sample, pol, channel), the last running fastest, unless TDIM, which begins with the fastest, has pol before channel.
    fine = max(1, 8 // sub.get("NBITS", 8)) if columns["DATA"][1] == "B" else 1
    swapped = sub["NPOL"] != sub["NCHAN"] and [n * m for n, m in zip(dims, (fine, 1))] == [sub["NPOL"], sub["NCHAN"]]
    return {"primary": primary, "sub": sub, "body": body, "row": sub["NAXIS1"], "rows": sub["NAXIS2"], "columns": columns, "swapped": swapped}


def start_mjd(primary: dict, sub: dict) -> tuple[float | None, float | None]:
    """Where a recording starts, by STT_IMJD or, where that is absent, TSTART; and the same moved by the rows that NSUBOFFS tells."""
    if "STT_IMJD" in primary:
        start = primary["STT_IMJD"] + (primary.get("STT_SMJD", 0) + primary.get("STT_OFFS", 0.0)) / 86400.0
    elif primary.get("TSTART"):
        start = float(primary["TSTART"])
    else:
        return None, None
    rows = sub.get("NSUBOFFS", primary.get("NSUBOFFS", 0)) or 0
    return start, start + rows * sub.get("TSUBINT", sub.get("NSBLK", 1) * sub.get("TBIN", 0.0)) / 86400.0


def plain_fits(f) -> tuple[dict, np.ndarray]:
    """The cards of the first HDU with an axis named FREQ among its first three, and that axis's frequencies by its world coordinates."""
    for head, _ in hdus(f):
        k = next((k for k in (1, 2, 3) if head.get("NAXIS", 0) and "FREQ" in str(head.get(f"CTYPE{k}", "")).upper()), None)
        if k:
            place = np.arange(head.get(f"NAXIS{k}", head.get("NCHAN", 0))) - (float(head.get(f"CRPIX{k}", 1)) - 1)
            return head, float(head.get(f"CRVAL{k}", 0)) + place * float(head.get(f"CDELT{k}", 1))
    raise ValueError("neither SUBINT nor an axis of frequencies")


#: How a FITS image holds its numbers, by BITPIX.
IMAGE_KINDS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def image_layout(f) -> dict:
    """Where the samples of the first image with an axis of frequencies stand: its numbers, axes (fastest first) and which of them are time, polarisation and frequency.

    Time is the axis named so, else the longest of those that are neither frequency nor polarisation; an image without
    one has one sample. Other axes must have length 1.
    """
    for head, body in hdus(f):
        axes = [head[f"NAXIS{k + 1}"] for k in range(head.get("NAXIS", 0))]
        names = [str(head.get(f"CTYPE{k + 1}", "")).upper() for k in range(len(axes))]
        freq = next((k for k, n in enumerate(names) if "FREQ" in n), None)
        if freq is None or head.get("XTENSION", "IMAGE").strip() != "IMAGE":
            continue
        pol = next((k for k, n in enumerate(names) if "STOKES" in n or "POL" in n), None)
        rest = [k for k in range(len(axes)) if k not in (freq, pol)]
        time = next((k for k in rest if "TIME" in names[k]), max(rest, key=lambda k: axes[k], default=None))
        if any(axes[k] != 1 for k in rest if k != time):
            raise ValueError(f"an axis besides time, polarisation and frequency: {names}")
        place = np.arange(axes[freq]) - (float(head.get(f"CRPIX{freq + 1}", 1)) - 1)
        return {
            "head": head, "body": body, "axes": axes, "time": time, "pol": pol, "freq": freq, "kind": np.dtype(IMAGE_KINDS[head["BITPIX"]]),
            "freqs": float(head.get(f"CRVAL{freq + 1}", 0)) + place * float(head.get(f"CDELT{freq + 1}", 1)), "nsamples": axes[time] if time is not None else 1,
        }
    raise ValueError("neither SUBINT nor an image with an axis of frequencies")


def unpack(raw: np.ndarray, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, the first in the highest bits of each byte."""
    if bits == 8:
        return raw
    shift = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((raw[:, None] >> shift) & np.uint8((1 << bits) - 1)).ravel()


class PsrfitsReader(Ranges):
    """Samples are numbered from the start that OFFS_SUB tells, so that rows missing in the file are zeros.

    Rows stand in order of time, as the format has it; so a range finds its first row by halving, and reads no others.
    Without OFFS_SUB rows follow each other. A row's samples are read as far as a batch goes.
    """

    def layout(self, f) -> dict:
        return psrfits_layout(f)

    def slot(self, f, lay: dict, k: int) -> int:
        """Where row k stands, counted in rows from the first."""
        if "OFFS_SUB" not in lay["columns"]:
            return k
        seconds = [struct.unpack(">d", f.read_at(8, lay["body"] + r * lay["row"] + lay["columns"]["OFFS_SUB"][0]))[0] for r in (0, k)]
        return round((seconds[1] - seconds[0]) / (lay["sub"]["NSBLK"] * lay["sub"]["TBIN"]))

    def length(self, f, lay: dict) -> int:
        return (self.slot(f, lay, lay["rows"] - 1) + 1) * lay["sub"]["NSBLK"] if lay["rows"] else 0

    def block(self, f, lay: dict, first: int, last: int) -> np.ndarray:
        nsblk = lay["sub"]["NSBLK"]
        out = np.zeros((last - first, lay["sub"]["NPOL"], lay["sub"]["NCHAN"]), np.float32)
        for k in range(bisect_left(range(lay["rows"]), first // nsblk, key=lambda k: self.slot(f, lay, k)), lay["rows"]):
            begin = self.slot(f, lay, k) * nsblk
            if begin >= last:
                break
            a, b = max(first, begin), min(last, begin + nsblk)
            out[a - first : b - first] = self.samples(f, lay, k, a - begin, b - begin)
        return out

    def samples(self, f, lay: dict, row: int, a: int, b: int) -> np.ndarray:
        """Samples a to b of a row, calibrated, as (sample, pol, channel) in order of rising frequency."""
        sub, start = lay["sub"], lay["body"] + row * lay["row"]
        npol, nchan = sub["NPOL"], sub["NCHAN"]

        def column(name: str, default: np.ndarray) -> np.ndarray:
            if name not in lay["columns"]:
                return default
            at, form, n = lay["columns"][name]
            kind = np.dtype({"E": ">f4", "D": ">f8"}[form])
            return np.frombuffer(f.read_at(n * kind.itemsize, start + at), kind).astype(np.float64)

        at, form, _ = lay["columns"]["DATA"]
        kind = np.dtype({"B": np.uint8, "I": ">i2", "E": ">f4"}[form])
        bits = sub["NBITS"] if form == "B" else 8 * kind.itemsize
        low, high = a * npol * nchan * bits, b * npol * nchan * bits
        data = np.frombuffer(f.read_at(-(-high // 8) - low // 8, start + at + low // 8), kind)
        data = unpack(data, bits)[low % 8 // bits :][: (b - a) * npol * nchan] if form == "B" else data
        data = data.reshape(b - a, nchan, npol).swapaxes(1, 2) if lay["swapped"] else data.reshape(b - a, npol, nchan)
        x = data.astype(np.float64) - float(sub.get("ZERO_OFF", 0) or 0)
        scale = column("DAT_SCL", np.ones(npol * nchan)).reshape(npol, nchan)
        offset = column("DAT_OFFS", np.zeros(npol * nchan)).reshape(npol, nchan)
        x = (x * scale + offset) * column("DAT_WTS", np.ones(nchan))
        return x[:, :, np.argsort(column("DAT_FREQ", np.arange(nchan, dtype=float)), kind="stable")]


class ImageReader(Ranges):
    """Samples of plain FITS images of any order of axes, scaled by BSCALE and BZERO, in order of rising frequency; BLANK is NaN.

    A range of samples is read in as many stretches as there are places on the axes slower than time, and nothing else is.
    """

    def layout(self, f) -> dict:
        lay = image_layout(f)
        if f.size() < lay["body"] + math.prod(lay["axes"]) * lay["kind"].itemsize:
            raise ValueError("the file ends within its image")
        return lay

    def length(self, f, lay: dict) -> int:
        return lay["nsamples"]

    def block(self, f, lay: dict, first: int, last: int) -> np.ndarray:
        axes, kind, head = lay["axes"], lay["kind"], lay["head"]
        time = lay["time"] if lay["time"] is not None else len(axes)
        inner, outer, n = math.prod(axes[:time]), math.prod(axes[time + 1 :]), lay["nsamples"]
        size = inner * (last - first)
        raw = b"".join(f.read_at(size * kind.itemsize, lay["body"] + (o * n + first) * inner * kind.itemsize) for o in range(outer))
        data = np.frombuffer(raw, kind)
        x = data.astype(np.float64) * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))
        if kind.kind != "f" and "BLANK" in head:
            x[data == head["BLANK"]] = np.nan
        shape = [*axes[:time], last - first, *axes[time + 1 :]]
        x = x.reshape(shape[::-1])  # slowest first
        place = {k: len(shape) - 1 - k for k in range(len(shape))}
        want = [place[time], *([place[lay["pol"]]] if lay["pol"] is not None else []), place[lay["freq"]]]
        x = np.transpose(x, [*want, *(k for k in range(len(shape)) if k not in want)]).reshape([x.shape[k] for k in want])
        x = x if lay["pol"] is not None else x[:, None, :]
        return x[:, :, np.argsort(lay["freqs"], kind="stable")]


class FitsReader(Ranges):
    """Of a file with a table SUBINT its samples, else those of its image."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.table, self.image = PsrfitsReader(options), ImageReader(options)

    def layout(self, f) -> dict:
        try:
            return {"reader": self.table, "lay": psrfits_layout(f)}
        except ValueError:
            return {"reader": self.image, "lay": self.image.layout(f)}

    def length(self, f, lay: dict) -> int:
        return lay["reader"].length(f, lay["lay"])

    def block(self, f, lay: dict, first: int, last: int) -> np.ndarray:
        return lay["reader"].block(f, lay["lay"], first, last)


class Fits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(self.options)


class Psrfits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "psrfits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PsrfitsReader(self.options)


def register(spark) -> None:
    """The formats for a session, with the pushing down of filters to Python sources switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Filterbank, Psrfits, Fits):
        spark.dataSource.register(source)
