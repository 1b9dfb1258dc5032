"""Spectra written as files of their own formats by tasks: filterbank, PSRFITS tables, FITS images and array files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def card(key: str, v) -> str:
    text = f"'{v}'".ljust(20) if isinstance(v, str) and v not in ("T", "F") else str(v).rjust(20)
    return f"{key.ljust(8)}= {text}".ljust(80)


def fits_header(*cards: tuple) -> bytes:
    text = "".join(card(k, v) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii")


class Filterbank:
    """32-bit samples, channels rising."""

    suffix = ".fil"

    def __init__(self, n: int, chans: int, start: float, dt: float, freq: float, step: float):
        def text(s: str) -> bytes:
            return struct.pack("<i", len(s)) + s.encode()

        whole = {"nchans": chans, "nbits": 32, "nifs": 1}
        real = {"tsamp": dt, "tstart": start, "fch1": freq, "foff": step}
        self.head = text("HEADER_START") + b"".join(text(k) + struct.pack("<i", v) for k, v in whole.items()) + b"".join(text(k) + struct.pack("<d", v) for k, v in real.items()) + text("HEADER_END")
        self.tail = b""

    def rows(self, t: np.ndarray, x: np.ndarray) -> bytes:
        return x.astype("<f4").tobytes()


class Image:
    """A FITS image of 32-bit numbers, frequency fastest, time slowest."""

    suffix = ".fits"

    def __init__(self, n: int, chans: int, start: float, dt: float, freq: float, step: float):
        self.head = fits_header(
            ("SIMPLE", "T"), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", chans), ("NAXIS2", n), ("CTYPE1", "FREQ"), ("CRVAL1", freq), ("CDELT1", step), ("CRPIX1", 1),
            ("CTYPE2", "TIME"), ("CRVAL2", 0.0), ("CDELT2", dt), ("CRPIX2", 1), ("TSTART", start),
        )
        size = n * chans * 4
        self.tail = b"\0" * (-size % 2880)

    def rows(self, t: np.ndarray, x: np.ndarray) -> bytes:
        return x.astype(">f4").tobytes()


class Psrfits:
    """A table SUBINT with one sample a row and its place in OFFS_SUB, so that samples that aren't there are gaps."""

    suffix = ".fits"

    def __init__(self, n: int, chans: int, start: float, dt: float, freq: float, step: float):
        day = int(start)
        form = [("OFFS_SUB", "1D"), ("DAT_FREQ", f"{chans}D"), ("DATA", f"{chans}E")]
        width = 8 + 12 * chans
        sub = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3), ("EXTNAME", "SUBINT")]
        sub += [("NSBLK", 1), ("NPOL", 1), ("NCHAN", chans), ("NBITS", 32), ("TBIN", dt), ("POL_TYPE", "AABB")] + [y for k, (name, f) in enumerate(form, 1) for y in ((f"TTYPE{k}", name), (f"TFORM{k}", f))]
        primary = [("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("STT_IMJD", day), ("STT_SMJD", round((start - day) * 86400)), ("STT_OFFS", 0.0)]
        self.head = fits_header(*primary) + fits_header(*sub)
        self.tail = b"\0" * (-n * width % 2880)
        self.freq, self.dt = (freq + step * np.arange(chans)).astype(">f8").tobytes(), dt

    def rows(self, t: np.ndarray, x: np.ndarray) -> bytes:
        return b"".join(struct.pack(">d", (int(k) + 0.5) * self.dt) + self.freq + row.tobytes() for k, row in zip(t, x.astype(">f4"), strict=True))


class Array:
    """An array file of doubles, time first."""

    suffix = ".npy"

    def __init__(self, n: int, chans: int, start: float, dt: float, freq: float, step: float):
        told = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({n}, {chans}), }}"
        told = told.ljust(-(-(len(told) + 11) // 64) * 64 - 11) + "\n"
        self.head, self.tail = b"\x93NUMPY\x01\x00" + struct.pack("<H", len(told)) + told.encode(), b""

    def rows(self, t: np.ndarray, x: np.ndarray) -> bytes:
        return x.astype("<f8").tobytes()


FORMATS = {"filterbank": Filterbank, "psrfits": Psrfits, "image": Image, "array": Array}


def write_files(spectra: DataFrame, folder: str, kind: str, start: float = 58000.0, dt: float = 1e-3, freq: float = 1200.0, step: float = 6.25, file: str = "file", t: str = "t", spec: str = "spec") -> DataFrame:
    """Writes folder/<file><suffix> for each file of (file, t, spec) in order of t, and gives (path, samples) of each as a written table.

    A file's samples pass through one task in batches, as a file is written from its beginning; its header is told their
    number, which is counted before. A task writes under a name of its own and renames when the file is whole, so that one
    that is lost and done again leaves no half file. spec arrays of a file have one length.
    """
    from burstlake.staging import cut

    count = spectra.groupBy(F.col(file).alias("export_file")).agg(F.count("*").alias("n"))
    rows = spectra.join(count, F.col(file) == F.col("export_file")).select("export_file", F.col(t).cast("long").alias("t"), "n", F.col(spec).cast("array<double>").alias("spec"))
    # By a hash: Spark drops a repartition by the join's own key, and what is left of it may be split or read locally, so that a file fell to several tasks.
    ordered = rows.repartition(F.xxhash64("export_file")).sortWithinPartitions("export_file", "t")
    make = FORMATS[kind]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        now, out, form, temporary, done = None, None, None, "", []

        def close() -> None:
            out.write(form.tail)
            out.close()
            store.move(temporary, f"{root}/{now[0]}{form.suffix}")
            done.append((f"{folder}/{now[0]}{form.suffix}", now[1]))

        for b in batches:
            names = b.column(0).to_pylist()
            lists, at = b.column(3), 0
            while at < len(names):
                stop = at
                while stop < len(names) and names[stop] == names[at]:
                    stop += 1
                x = np.array(lists.slice(at, stop - at).to_pylist(), float).reshape(stop - at, -1)
                if now is None or now[0] != names[at]:
                    if now is not None:
                        close()
                    now = (names[at], b.column(2)[at].as_py())
                    form, temporary = make(now[1], x.shape[1], start, dt, freq, step), f"{root}/{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(temporary)
                    out.write(form.head)
                out.write(form.rows(b.column(1).slice(at, stop - at).to_numpy(), x))
                at = stop
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "samples"])

    return cut(ordered.mapInArrow(write, "path string, samples bigint"))
