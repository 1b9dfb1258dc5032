"""Token ids as flat files of unsigned integers with 64-bit document offsets, written in order of the ids and read through memory maps."""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer, pre_tokenizers

from burstlake.llm.shared import keep_until_exit, shared_dir

# ---- Encoding -----------------------------------------------------------------------------------------------------------

# How a vocabulary file of lower-cased words says that it cuts a text.
LOWER_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LOWER_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: A character, or the beginning of a special token, for which a word goes to the library whole. All others (printable ASCII, letters
#: of Latin-1) are their own normal form, and whether they are letters or digits is the same in every Unicode version.
ODD = re.compile("[^\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]|<\\|")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+", re.ASCII)
WORDS = re.compile("[^\\x20\\x09-\\x0D]+")

#: So many characters of a text are cut at a time; pieces, and words with odd characters, that a worker keeps the ids of.
SLICE, PIECES, ODD_WORDS = 1 << 20, 600_000, 1 << 17


class Encoder:
    """Ids of texts as little-endian bytes, equal to those of the tokenizers library for the whole text without special tokens.

    Where the vocabulary file cuts texts into lower-cased words, no token crosses white space: pieces between cuts are
    encoded by the library once and looked up from then on, in a table of bounded size. Other files get whole texts.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        shape = json.loads(self.library.to_str())
        self.dtype = id_type(top_id(self.library), end_id)
        self.one = [np.array(k, self.dtype).tobytes() for k in range(1 + max(top_id(self.library), end_id or 0))]
        self.end = b"" if end_id is None else self.pack([end_id])
        self.by_pieces = (shape["normalizer"], shape["pre_tokenizer"]) == (LOWER_NORMALIZER, LOWER_SPLIT)
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(self.library.model)  # printable ASCII stands for its own bytes
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return b"".join(map(self.one.__getitem__, ids))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_pieces:
            return self.pack(self.library.encode(text, add_special_tokens=False).ids) + self.end
        return b"".join([*map(self.slice, slices(text)), self.end])

    def slice(self, text: str) -> bytes:
        if not ODD.search(text):
            return self.plain(PIECE.findall(text.lower()))
        parts = []
        for odd, run in itertools.groupby(WORDS.findall(text), lambda w: ODD.search(w) is not None):
            parts.append(self.whole(list(run)) if odd else self.plain(PIECE.findall(" ".join(run).lower())))
        return b"".join(parts)

    def plain(self, pieces: list[str]) -> bytes:
        return self.known(pieces, self.pieces, PIECES, self.ascii, self.bare)

    def whole(self, words: list[str]) -> bytes:
        return self.known(words, self.odd, ODD_WORDS, self.library, self.library)

    def known(self, keys: list[str], table: dict[str, bytes], most: int, by_ascii: Tokenizer, by_other: Tokenizer) -> bytes:
        try:
            return b"".join(map(table.__getitem__, keys))
        except KeyError:
            pass
        new = [k for k in dict.fromkeys(keys) if k not in table]
        if len(table) + len(new) > most:
            table.clear()
            new = list(dict.fromkeys(keys))
        for by, some in ((by_ascii, [k for k in new if k.isascii()]), (by_other, [k for k in new if not k.isascii()])):
            table.update(zip(some, (self.pack(e.ids) for e in by.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        return b"".join(map(table.__getitem__, keys))


def top_id(library: Tokenizer) -> int:
    return max(library.get_vocab(with_added_tokens=True).values(), default=0)


def id_type(top: int, end_id: int | None) -> str:
    """The narrowest unsigned type that holds each id."""
    return "<u2" if max(top, end_id or 0) < 1 << 16 else "<u4"


def slices(text: str) -> Iterator[str]:
    """The text cut at white space into slices of about SLICE characters; a longer run without any stays whole."""
    at, blank = 0, re.compile("[\\x20\\x09-\\x0D]")
    while len(text) - at > SLICE:
        stop = blank.search(text, at + SLICE)
        if not stop:
            break
        yield text[at : stop.start()]
        at = stop.end()
    yield text[at:]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's encoder; it is kept from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def encode(docs: DataFrame, path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, ids): the ids of each text, end_id after them, as little-endian bytes; narrow. A null text is an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        names, packed, size = [], [], 0
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                names.append(name)
                packed.append(enc(t.as_py()))
                size += len(packed[-1])
                if size >= batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "ids"])
                    names, packed, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, ids binary")


# ---- Files --------------------------------------------------------------------------------------------------------------

MANIFEST = "manifest.json"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path and file: are the (shared) local one, which can be memory-mapped."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), urlparse(path).path if scheme else path
    return pyarrow.fs.FileSystem.from_uri(path)


def stretch(fs: pyarrow.fs.FileSystem, path: str, dtype: str, first: int, last: int) -> np.ndarray:
    """Numbers first to last - 1 of a flat file: a memory map where the file system is local, else a read of that range."""
    width = np.dtype(dtype).itemsize
    if last <= first:
        return np.empty(0, dtype)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r", first * width, (last - first,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at((last - first) * width, first * width), dtype)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    docs: int
    nulls: int
    ids: int


class TokenWriter(DataSourceArrowWriter):
    """Each task writes its rows in their order, under a name of its own attempt; the commit alone makes them a table.

    Of a task it gets four numbers: prefix sums over them, in order of partitions, are the places at which each file begins.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dtype, self.overwrite = options["path"], options.get("dtype", "<u4"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        part, width = TaskContext.get().partitionId(), np.dtype(self.dtype).itemsize
        file = f"part-{part:06d}-{uuid.uuid4().hex}"
        docs = nulls = ids = 0
        with fs.open_output_stream(f"{root}/{file}.ids") as flat, fs.open_output_stream(f"{root}/{file}.offsets") as offsets, fs.open_output_stream(f"{root}/{file}.docs") as names:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for b in iterator:
                packed = b.column(b.schema.get_field_index("ids")).to_pylist()
                name = b.column(b.schema.get_field_index("doc_id"))
                ends = ids + np.cumsum([len(x) // width for x in packed], dtype="<i8")
                flat.write(b"".join(packed))
                offsets.write(ends.astype("<i8").tobytes())
                names.write(name.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs, nulls, ids = docs + b.num_rows, nulls + name.null_count, int(ends[-1]) if len(ends) else ids
        return Written(part, file, docs, nulls, ids)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        old = read_manifest(fs, root)
        if old and not self.overwrite:
            raise ValueError(f"{self.path} holds token files already")
        parts, base, first = [], 0, 0
        for m in sorted((m for m in messages if m and m.docs), key=lambda m: m.part):
            parts.append({"file": m.file, "docs": m.docs, "nulls": m.nulls, "ids": m.ids, "base": base, "first_doc": first})
            base, first = base + m.ids, first + m.docs
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"dtype": self.dtype, "ids": base, "docs": first, "parts": parts}).encode())
        remove(fs, root, [p["file"] for p in old["parts"]] if old else [])
        remove(fs, root, [m.file for m in messages if m and not m.docs])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        remove(fs, root, [m.file for m in messages if m])


def remove(fs: pyarrow.fs.FileSystem, root: str, files: list[str]) -> None:
    for file in files:
        for kind in ("ids", "offsets", "docs"):
            fs.delete_file(f"{root}/{file}.{kind}")


def read_manifest(fs: pyarrow.fs.FileSystem, root: str) -> dict | None:
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class Documents(InputPartition):
    def __init__(self, part: dict, first: int, last: int):
        super().__init__((part["file"], first, last))
        self.part, self.first, self.last = part, first, last


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split_bytes, self.batch_ids = options["path"], int(options.get("split_bytes", 64 << 20)), 1 << 20
        manifest = read_manifest(*filesystem(self.path))
        if manifest is None:
            raise ValueError(f"{self.path} holds no token files")
        self.dtype, self.parts = manifest["dtype"], manifest["parts"]

    def partitions(self) -> list[Documents]:
        out = []
        for p in self.parts:
            n = min(p["docs"], max(1, -(-p["ids"] * np.dtype(self.dtype).itemsize // self.split_bytes)))
            at = [p["docs"] * k // n for k in range(n + 1)]
            out += [Documents(p, a, b) for a, b in itertools.pairwise(at)]
        return out or [Documents({"file": ""}, 0, 0)]

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        p, first = partition.part, partition.first
        if first >= partition.last:
            return
        offsets = np.asarray(stretch(fs, f"{root}/{p['file']}.offsets", "<i8", first, partition.last + 1))
        names = np.asarray(stretch(fs, f"{root}/{p['file']}.docs", "<i8", first, partition.last))
        k = 0
        while k < len(names):
            stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + self.batch_ids, "right")) - 1)
            stop = min(stop, len(names))
            flat = np.asarray(stretch(fs, f"{root}/{p['file']}.ids", self.dtype, int(offsets[k]), int(offsets[stop]))).astype("<u4")
            counts, starts = np.diff(offsets[k : stop + 1]), offsets[k:stop] + p["base"]
            name = pa.array(names[k:stop], mask=np.arange(first + k, first + stop) < p["nulls"])  # null ids come first
            at = pa.py_buffer(((offsets[k : stop + 1] - offsets[k]) * 4).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), stop - k, [None, at, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([name, pa.array(starts), pa.array(counts), ids], names=["doc_id", "start", "n_tokens", "ids"])
            k = stop


class TokenSource(DataSource):
    """Format "token_files": (doc_id, start, n_tokens, ids), start the ids of all documents before, ids little-endian unsigned 32-bit."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options, overwrite)


class TokenFiles:
    """Memory-mapped access for a loader: document i, or any window of ids over file borders."""

    def __init__(self, path: str):
        self.fs, self.root = filesystem(path)
        manifest = read_manifest(self.fs, self.root)
        if manifest is None:
            raise ValueError(f"{path} holds no token files")
        self.dtype, self.ids, self.docs, self.parts = manifest["dtype"], manifest["ids"], manifest["docs"], manifest["parts"]
        self.bases = np.array([p["base"] for p in self.parts] + [self.ids])
        self.firsts = np.array([p["first_doc"] for p in self.parts] + [self.docs])

    def __len__(self) -> int:
        return self.docs

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < self.docs:
            raise IndexError(k)
        p = self.parts[int(np.searchsorted(self.firsts, k, "right")) - 1]
        first, last = stretch(self.fs, f"{self.root}/{p['file']}.offsets", "<i8", k - p["first_doc"], k - p["first_doc"] + 2)
        return stretch(self.fs, f"{self.root}/{p['file']}.ids", self.dtype, int(first), int(last))

    def window(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n - 1 of all documents one after the other; fewer at the end."""
        stop, got = min(start + n, self.ids), []
        while start < stop:
            p = self.parts[int(np.searchsorted(self.bases, start, "right")) - 1]
            last = min(stop, p["base"] + p["ids"])
            got.append(stretch(self.fs, f"{self.root}/{p['file']}.ids", self.dtype, start - p["base"], last - p["base"]))
            start = last
        return np.concatenate(got) if got else np.empty(0, self.dtype)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int | None = None, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encode every whole text and write the ids in ascending order of doc_id, nulls first; returns the path, by default in the shared folder.

    vocabulary is a file of the tokenizers library that every executor can read. Rows of one id stand in order of their
    texts' hashes, equal rows beside each other, so that any number of them is split over partitions like other rows;
    other columns are left out. A null text is an empty one. A task that is lost is done again under another name, and
    its rows are in the table once. An empty table gives files without a document. docs is read twice, for the bounds of
    the ranges and to be shuffled: hand over a table, not a long plan.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenSource)
    path = path or keep_until_exit(spark, f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}")
    dtype = id_type(top_id(Tokenizer.from_file(vocabulary)), end_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.sort("doc_id", F.xxhash64("text"), "row").drop("row")
    encode(ordered, vocabulary, end_id).write.format("token_files").option("dtype", dtype).mode("append").save(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_files").load(path)
