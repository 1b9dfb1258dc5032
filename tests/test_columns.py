from pyspark.sql import functions as F

from burstlake.functions.columns import first_of_duplicates, priority_order


def test_priority_order(spark):
    df = spark.range(1).select(*(F.lit(1).alias(c) for c in ("z", "validated_b", "detected_a", "file", "validated_a", "a.b")))
    assert priority_order(df, ["file", "absent", "file", "z"]).columns == ["file", "z", "validated_a", "validated_b", "detected_a", "a.b"]
    assert priority_order(df, []).columns == ["validated_a", "validated_b", "detected_a", "z", "file", "a.b"]


def test_first_of_duplicates(spark):
    df = spark.range(1).select(*(F.lit(k).alias(c) for k, c in enumerate(("x", "x.1", "y.2", "y.1", "v1.5a", "x.2"))))
    got = first_of_duplicates(df)
    assert got.columns == ["x", "y", "v1.5a"] and tuple(got.first()) == (0, 2, 4)
