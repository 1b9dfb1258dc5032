"""What the classifiers share: folds by crc32 of the id, labels once for each document, a seeded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id's decimal text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def held_out(doc_id: str, parts: int, fold_out: int) -> F.Column:
    """Whether the row is in the fold that nothing is learnt from; a null id is in none."""
    return F.coalesce(fold(doc_id, parts) == fold_out, F.lit(False))


def one_label(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) once for each document; repeated rows count once, and contradictory labels are left out."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    both = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
    return both.where("label = top").drop("top")


def thin(df: DataFrame, rows: int, doc_id: str = "doc_id", seed: int = 3) -> DataFrame:
    """All of df if it has at most `rows` rows, else the ids whose seeded hash falls under a share that gives a little less.

    Nothing is sorted, and only the chosen rows leave their tasks: for samples of thousands of rows.
    """
    n = df.count()
    if n <= rows:
        return df
    parts = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(parts)) < int(0.95 * rows / n * parts))
