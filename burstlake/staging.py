"""Tables written to the folder that driver and executors share, where lineage ends and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none (tests) gets a temporary one; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = tempfile.mkdtemp(prefix="spark-shared-")
        named = _temporary[app]
    return named.rstrip("/")


def _folder(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """The path, which is removed when the session's JVM ends, or by tidy()."""
    store, there = _folder(spark, path)
    store.deleteOnExit(there)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again. The folder is removed when the session's JVM ends, or by tidy()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(keep_until_exit(spark, path))


def tidy(spark: SparkSession) -> int:
    """Remove the tables that cut() has written in this session, and tell how many; for long sessions, when results have been written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        store, there = _folder(spark, path)
        store.delete(there, True)
    return len(paths)
