"""Names of recordings and numbers in text, case by case."""

import pytest
from pyspark.sql import functions as F

from burstlake.functions import names

NAMES = {
    "2024-01-05-12-30-45_0001.fits": "2024_01_05_12_30_45_0001", "2024_01_05-123045_0001": "2024_01_05_12_30_45_0001", " 2024-01-05-12_30_45_0001_t17.5": "2024_01_05_12_30_45_0001",
    "2024-01-05": "2024_01_05", "2024-01-05_0007": "2024_01_05_0007", "2024-01-050007": "2024_01_05_0007", "2024-01-05_123045": "2024_01_05_12_3045", "2024-01-05-x7_a": "2024_01_05_x7a",
    "2024-01-05--a__1234": "2024_01_05_a_1234", "2024-01-05_12-30-45-extra": "2024_01_05_12_30_45", "2024-01-05_12-3": "2024_01_05_123", "RUN-burst-17": "run_burst_17", "x_t.fits": "x_t", "_t5": "_t5",
    "a.fits_t12": "a", "": "", None: "", "20240105_0001": "20240105_0001", "2024-1-05": "2024_1_05",
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    return {r.n: r.m for r in df.select("n", names.normal_name(F.col("n")).alias("m")).collect()}


@pytest.mark.parametrize("name", list(NAMES))
def test_normal_names(got, name):
    assert got[name] == NAMES[name]


def test_numbers_in_header_fields(spark):
    rows = ["1.5", "*", "UNSET", "* 2 *", "UNSET3", "abc", "", None, "-1e3*"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string").orderBy("k")
    assert [r[0] for r in df.select(names.safe_number(F.col("x"), -9.0)).collect()] == [1.5, -9.0, -9.0, 2.0, 3.0, -9.0, -9.0, -9.0, -1000.0]
