"""Sessions: the package on the executors, and defaults for local work."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that Python functions of it can run there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        files = sorted(root.rglob("*.py"))
        digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}-{digest}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in files:
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target.as_uri())
        _shipped.add(app)
        # Rows hold whole texts and spectra: batches of Spark's default size would be tens of megabytes in every worker.
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("burstlake")
    base = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)
