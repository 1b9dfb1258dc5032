"""State carried between batches of a stream: samples wait for the rest of their chunk, and each chunk is searched once, whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from burstlake.functions.astro import BOXCARS
from burstlake.operators.timegrid import with_halo

#: What the state needs that Spark's default store lacks: several kinds of state for a key, written as changes.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Kernel = Callable[[np.ndarray, np.ndarray, int, int], pd.DataFrame]


class HeldChunks(StatefulProcessor):
    """Of each (file, chunk): the samples that came, until all of the chunk and its halo are there; then the kernel's rows, and a mark that it is done."""

    def __init__(self, size: int, halo: int, kernel: Kernel):
        self.size, self.halo, self.kernel = size, halo, kernel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "t binary, x binary")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        file, chunk = key
        before = self.seen.get()[0] if self.seen.exists() else 0
        total, t, x = 0, [], []
        for b in rows:
            total = int(b["carried_n"].iloc[0])
            t.append(b["carried_t"].to_numpy(np.int64))
            x.append(b["carried_x"].to_numpy(float))
        if before < 0:  # done: what comes again changes nothing
            return
        t, x = np.concatenate(t), np.concatenate(x)
        begin, end = max(0, chunk * self.size - self.halo), min(total, (chunk + 1) * self.size + self.halo)
        if before + len(t) >= end - begin:
            held = [(np.frombuffer(a, np.int64), np.frombuffer(v, float)) for a, v in self.parts.get()] if before else []
            all_t, all_x = np.concatenate([*(a for a, _ in held), t]), np.concatenate([*(v for _, v in held), x])
            at, first = np.unique(all_t, return_index=True)  # a sample that came twice counts once, as it came first
            if len(at) >= end - begin:
                self.parts.clear()
                self.seen.update((-1,))
                found = self.kernel(at, all_x[first], chunk * self.size, min(total, (chunk + 1) * self.size))
                if len(found):
                    yield pd.concat([pd.DataFrame({"file": [file] * len(found), "chunk_id": chunk}), found.reset_index(drop=True)], axis=1)
                return
        self.parts.appendValue((t.tobytes(), x.tobytes()))
        self.seen.update((before + len(t),))

    def close(self) -> None:
        pass


def carried_chunks(stream: DataFrame, size: int, halo: int, kernel: Kernel, schema: str, file: str = "file", t: str = "t", value: str = "s", n: str = "n") -> DataFrame:
    """Rows (file, chunk_id, schema) of the kernel for each chunk of each file, as soon as its last sample has come, in whichever batch.

    stream: a row for each sample, n the file's number of samples, as its header tells. A sample goes to its chunk and to
    those whose halo it is in; a chunk's samples are state from batch to batch, so that nothing at the border of two
    batches is lost or found twice, and a stream that is taken up again from its checkpoint goes on with them. A key is
    one chunk: a long file is many of them in many tasks. The kernel gets places, values, and the chunk's first place and
    the one after its last. Samples that come again, late or in any order, change nothing; a chunk of which a sample
    never comes gives no row. Rows with nulls in any of the four columns, or with places outside of 0 to n - 1, are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = stream.select(F.col(file).alias("file"), F.col(t).cast("long").alias("carried_t"), F.col(value).cast("double").alias("carried_x"), F.col(n).cast("long").alias("carried_n")).dropna()
    rows = rows.where((F.col("carried_t") >= 0) & (F.col("carried_t") < F.col("carried_n")))
    spread = with_halo(rows, "carried_t", size, halo).where(F.col("chunk_id") * size < F.col("carried_n")).drop("owned")
    return spread.groupBy("file", "chunk_id").transformWithStateInPandas(HeldChunks(size, halo, kernel), f"file string, chunk_id bigint, {schema}", "Append", "none")


def boxcar_peaks(threshold: float, widths: tuple[int, ...] = BOXCARS) -> Kernel:
    """The kernel of matched_filter() and local_peaks() with slices of a chunk's length: (t, snr, width) of inner samples that are peaks."""

    def kernel(t: np.ndarray, x: np.ndarray, first: int, stop: int) -> pd.DataFrame:
        run = np.concatenate([[0.0], np.cumsum(x)])
        place = np.arange(len(t))
        each = np.stack([np.round((run[np.minimum(len(t), place + w - w // 2)] - run[np.maximum(0, place - w // 2)]) / float(w) ** 0.5, 6) for w in widths])
        snr, width = each.max(0), np.asarray(widths)[each.argmax(0)]
        inner = np.nonzero((t > first) & (t < stop - 1))[0]
        hit = inner[(snr[inner] >= threshold) & (snr[inner] >= snr[inner - 1]) & (snr[inner] >= snr[inner + 1])]
        return pd.DataFrame({"t": t[hit], "snr": snr[hit], "width": width[hit].astype("int32")})

    return kernel


def pulses(stream: DataFrame, size: int, threshold: float, widths: tuple[int, ...] = BOXCARS) -> DataFrame:
    """(file, chunk_id, t, snr, width): the pulses of a stream of samples (file, t, s, n), each once."""
    return carried_chunks(stream, size, max(widths), boxcar_peaks(threshold, widths), "t bigint, snr double, width int")
