"""The order and the names of a table's columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def priority_order(df: DataFrame, first: list[str], prefixes: tuple[str, ...] = ("validated_", "detected_")) -> DataFrame:
    """df with the columns of `first` that it has in front, then those of each prefix by name, then the others as they stand."""
    front = [c for c in dict.fromkeys(first) if c in df.columns]
    named = [c for p in prefixes for c in sorted(df.columns) if c.startswith(p) and c not in front]
    named = list(dict.fromkeys(named))
    return df.select(*(F.col(f"`{c}`") for c in [*front, *named, *(c for c in df.columns if c not in front and c not in named)]))


def first_of_duplicates(df: DataFrame) -> DataFrame:
    """df with one column for each name that a reader of lists has told apart as name, name.1, name.2 ...: the first, under the plain name."""
    kept: dict[str, str] = {}
    for c in df.columns:
        kept.setdefault(re.sub(r"[.]\d+$", "", c), c)
    return df.select(*(F.col(f"`{c}`").alias(plain) for plain, c in kept.items()))
