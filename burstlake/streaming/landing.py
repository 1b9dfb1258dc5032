"""Candidates as a stream: bursts of candidates as sessions, chunks searched as they land, an append sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_landing(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def burst_sessions(cands: DataFrame, key: str, ts: str, snr: str, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Candidates of a key that follow each other within the gap, as one row. Works on streams and tables alike."""
    s = cands.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("session"))
    out = s.agg(F.count("*").alias("n"), F.max(snr).alias("peak"), F.max_by(ts, snr).alias("peak_ts"))
    return out.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "peak", "peak_ts")


def window_counts(cands: DataFrame, ts: str, by: str, width: str = "1 minute", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Candidates for each tumbling (or sliding) window and group."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return cands.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_batches(stream: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Search each batch of landed rows with a function of tables, and write what it finds in a folder for the batch.

    A batch that is run again after a failure replaces its own folder, so that no row is there twice. A batch whose
    search fails stops the stream; it is taken up again from the state folder.
    """

    def one(batch: DataFrame, k: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{out}/batch={k}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
