"""Lists of recordings that stand in the text of settings, under headings in comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text) of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def setting_lists(texts: DataFrame, heading: str = r"#\s*(No\d+)", file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, heading, name, part, times) of each quoted item of a list, `- "name"`, that stands under a heading.

    A heading is a comment that the pattern is found in, anywhere in a line, which then holds no item; it is in force until the
    next one of its text, whatever keys, other comments and lists stand between. part is the first run of exactly four digits after an
    underscore, else the four digits at the end, else null; times are all numbers after `_t`. Lines are numbered from 0;
    items without quotes, before the first heading or with an empty name are left out, repeated ones stay. A null text has
    no lines. Lines of one text are looked at together, as they follow each other.
    """
    lines = texts.where(F.col(file).isNotNull() & F.col(text).isNotNull()).select(F.col(file).alias("file"), F.posexplode(F.split(text, r"\r?\n")).alias("line", "row"))
    told = F.nullif(F.regexp_extract("row", heading, 1), F.lit(""))
    after = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    under = lines.select("file", "line", "row", told.alias("told"), F.last(told, True).over(after).alias("heading"))
    items = under.where("told is null and heading is not null").withColumn("name", F.nullif(F.regexp_extract("row", r'^\s*-\s*"([^"]+)"', 1), F.lit(""))).where("name is not null")
    part = F.coalesce(F.nullif(F.regexp_extract("name", r"_(\d{4})(?![0-9])", 1), F.lit("")), F.nullif(F.regexp_extract("name", r"(\d{4})$", 1), F.lit("")))
    times = F.filter(F.transform(F.regexp_extract_all("name", F.lit(r"_t([\d.]+)")), lambda t: F.rtrim(t, F.lit(".")).try_cast("double")), lambda t: t.isNotNull())
    return items.select("file", "line", "heading", "name", part.alias("part"), times.alias("times"))
