"""File names, lists in text, and numbers in text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A recording's name: date, whatever stands between (the time, in most), and the part of the recording; then the time itself.
RECORDING = r"^(\d{4})[-_](\d\d)[-_](\d\d)[-_]*(.*?)(?:_?(\d{4}))?$"
CLOCK = r"^(\d\d)(?:[-_](\d\d)[-_](\d\d)|(\d\d)(\d\d)).*$"


def normal_name(name: Column) -> Column:
    """YYYY_MM_DD_HH_MM_SS_XXXX of a recording's name in any of its spellings; what has no date gets underscores only.

    `.fits` goes, and all from `_t<number>`; the last four digits are the part of the recording; the time may be
    separated or not. A time that can't be read stays as it is, without separators. Null gives an empty name.
    """
    stem = F.lower(F.regexp_replace(F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit(".fits"), F.lit("")), r"(?<=.)_t[\d.].*$", ""))
    # One match gives all parts, apart from each other by a character that no name has.
    parts = F.split(F.regexp_replace(stem, RECORDING, "$1_$2_$3\u0001$4\u0001$5"), "\u0001")
    middle = F.get(parts, F.lit(1))
    clock = F.when(middle.rlike(CLOCK), F.regexp_replace(middle, CLOCK, "$1_$2$4_$3$5")).otherwise(F.translate(middle, "-_", ""))
    told = F.filter(F.array(F.get(parts, F.lit(0)), clock, F.get(parts, F.lit(2))), lambda x: x != "")
    return F.when(middle.isNotNull(), F.array_join(told, "_")).otherwise(F.translate(stem, "-", "_"))


def underscored(name: Column) -> Column:
    return F.lower(F.translate(name, "-", "_"))


def hyphened(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(name, "_", "-"), " ", ""))


def long_tokens(name: Column, separator: str = "-", least: int = 3) -> Column:
    """Distinct tokens of a name with `least` characters or more."""
    return F.array_distinct(F.filter(F.split(name, separator), lambda x: F.length(x) >= least))


def similar(a: Column, b: Column) -> Column:
    """Whether two token sets share min(3, either size) tokens, and one at least."""
    need = F.greatest(F.lit(1), F.least(F.lit(3), F.size(a), F.size(b)))
    return F.size(F.array_intersect(a, b)) >= need


def bare_number(text: Column) -> Column:
    """The number in a text without what stands in parentheses; null if there is none."""
    return F.regexp_replace(text, r"\s*\([^)]*\)", "").try_cast("double")


def safe_number(text: Column, default: float) -> Column:
    """The number in a header field, whatever stars and the word UNSET stand in or around it; else default."""
    return F.coalesce(F.trim(F.array_join(F.split(text, r"[*]|UNSET"), "")).try_cast("double"), F.lit(default))


def is_special(name: Column) -> Column:
    return name.rlike(r"_t[\d.]+")


def angle(packed: Column) -> Column:
    """hh:mm:ss (or dd:mm:ss) of a whole number hhmmss, with its sign."""
    a = F.abs(packed.cast("bigint"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(packed < 0, "-").otherwise(""), F.concat_ws(":", two(F.floor(a / 10000)), two(F.pmod(F.floor(a / 100), F.lit(100))), two(F.pmod(a, F.lit(100)))))
