"""Where queries are registered: a name, a function of (session, folder), and the same in DuckDB SQL if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as spectra: (t, c, q, label), q the value in millionths, a whole number as a recorder's counts are."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), "label", F.posexplode("embedding").alias("c", "v"))
    return e.select("t", "label", "c", F.round(F.col("v").cast("double") * F.lit(1e6)).cast("bigint").alias("q"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one array for each sample: (t, label, spec), for what looks at all channels of a sample at once."""
    q = F.transform("embedding", lambda v: F.round(v.cast("double") * F.lit(1e6)).cast("bigint"))
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").alias("t"), "label", q.alias("spec"))


#: The same in SQL, as the beginning of a query.
WATERFALL = """WITH RECURSIVE w AS (SELECT t, label, c, CAST(round(CAST(v AS DOUBLE) * 1e6) AS BIGINT) AS q FROM
(SELECT vec_id AS t, label, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) AS v FROM embeddings))"""

FREQ0, STEP, DT = 1200.0, 6.25, 1e-3


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as candidates: (cand_id, file_id, kind, t_sec, mjd, snr)."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("cand_id"), F.col("user_id").alias("file_id"), F.col("event_type").alias("kind"),
        ((us - F.lit(1704067200000000)) / F.lit(1e6)).alias("t_sec"), (F.lit(40587.0) + us / F.lit(1e6) / F.lit(86400.0)).alias("mjd"), (F.col("value") / F.lit(50.0)).alias("snr"),
    )


CANDIDATES = """WITH RECURSIVE cand AS (SELECT event_id AS cand_id, user_id AS file_id, event_type AS kind,
CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 1e6 AS t_sec, 40587.0::DOUBLE + CAST(epoch_us(ts) AS DOUBLE) / 1e6 / 86400.0::DOUBLE AS mjd, value / 50.0::DOUBLE AS snr FROM events)"""
