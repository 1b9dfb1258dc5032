"""Exact places and order statistics of groups of any size: no window, sort or percentile over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlake.staging import cut

#: Groups, or what is left of them around an order statistic, are finished as one group from so many rows on.
FINISH = 50_000
#: Sketched places of one round, and the accuracy of the sketch, which is far finer.
EDGES, ACCURACY = 500, 20_000


def numbered(df: DataFrame, keys: tuple[str, ...], order: list[str | Column], place: str = "place", size: str = "size") -> DataFrame:
    """Adds place (0, 1, 2 ... in each group by order) and size (rows of the group). keys may be empty; nulls are a group like others.

    Rows are sorted by ranges of keys and order, so that a group of any size is spread over tasks, and written with
    their place in their range; counts of ranges, added up, give each range its first number, and a group begins at its
    smallest. Rows that are equal in keys and order get places in any order. An empty table gives none.
    """
    spread = df.sort(*keys, *order).withColumn("ranking_row", F.monotonically_increasing_id())
    rows = cut(spread)
    part, at = F.shiftright("ranking_row", 33), F.col("ranking_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("ranking_part")).agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("ranking_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cut(counts.select("ranking_part", before.alias("ranking_base")))
    every = rows.withColumn("ranking_part", part).join(base, "ranking_part").withColumn("ranking_at", F.col("ranking_base") + at).drop("ranking_part", "ranking_base", "ranking_row")
    first = every.groupBy(*keys).agg(F.min("ranking_at").alias("ranking_first"), F.count("*").alias(size))
    return beside(every, first, keys).withColumn(place, F.col("ranking_at") - F.col("ranking_first")).drop("ranking_at", "ranking_first")


def percentiles(df: DataFrame, keys: tuple[str, ...], value: str | Column, **wanted: float | Column) -> DataFrame:
    """(keys, one double for each name of wanted): exact percentiles (0 to 1) with linear interpolation; a row for each group.

    Instead of a share wanted may be a column over m, the number of values in the group: a place from 0 to m - 1.

    Null values are left out, NaN is above all numbers; a group without values has nulls. Groups may have any size: what
    is left around an order statistic is narrowed round by round, between two edges of a sketch that surely enclose it,
    and rows below them are counted exactly, until it is an edge or FINISH rows are left. Only those are gathered.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("ranking_v"))
    sizes = rows.groupBy(*keys).agg(F.count("ranking_v").alias("m"))
    target = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (p if isinstance(p, Column) else F.lit(float(p)) * (F.col("m") - 1)).cast("double").alias("pos")) for name, p in wanted.items())))
    each = sizes.where("m > 0").select(*keys, "m", target.alias("x")).select(*keys, "m", "x.name", "x.pos").withColumnRenamed("name", "ranking_name")
    ends = F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos"))))
    none = F.lit(None).cast("double")
    state = each.select(*keys, F.col("ranking_name").alias("name"), "pos", ends.alias("rank"), "m").withColumns({"k": F.col("rank"), "lo": none, "hi": none, "v": none})
    rows = rows.where("ranking_v is not null")
    wide, done = F.col("v").isNull() & (F.col("m") > FINISH), []
    while state.where(wide).limit(1).count():
        state = cut(state)
        done.append(state.where(~wide))
        state = cut(narrowed(rows, state.where(wide), keys))
    for some in done:
        state = state.unionByName(some)
    names = ["name", "pos", "rank"]
    gathered = _inside(rows, state.where("v is null").drop("v"), keys).groupBy(*keys, *names, "k").agg(F.sort_array(F.collect_list("ranking_v")).alias("all"))
    found = gathered.select(*keys, *names, F.get("all", F.col("k").cast("int")).alias("v"))
    if done:
        found = found.unionByName(state.where("v is not null").select(*keys, *names, "v"))
    low = F.max(F.when(F.col("rank") == F.floor("pos"), F.col("v")))
    high = F.max(F.when(F.col("rank") == F.ceil("pos"), F.col("v")))
    part = F.col("pos") - F.floor("pos")
    one = found.groupBy(*keys, "name", "pos").agg(low.alias("low"), high.alias("high"))
    one = one.select(*keys, "name", F.when(part == 0, F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high")).alias("v"))
    wide_rows = one.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted))
    if not keys:
        return wide_rows
    return beside(sizes.select(*keys), wide_rows, keys, "left")


def beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, null keys being equal; without keys right is a few rows and is broadcast."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"ranking_{k}"))
    other = right.select(*(F.col(k).alias(f"ranking_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(other, same, how).drop(*(f"ranking_{k}" for k in keys))


def _inside(rows: DataFrame, state: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each value with each order statistic of its group whose interval, without its ends, holds it."""
    v = F.col("ranking_v")
    return beside(rows, state, keys).where(F.col("lo").isNull() | ((v > F.col("lo")) & (v < F.col("hi"))))


def narrowed(rows: DataFrame, state: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The same order statistics: v where one is an edge of its interval, else the interval between the edges and the place in it.

    Edges are values of the group, and all rows that equal them are counted out, so that every round takes some away, be
    a value as frequent as it may; of others about 3 / EDGES stay.
    """
    names, v = ["name", "pos", "rank"], F.col("ranking_v")
    grid = F.array(*(F.lit(i / EDGES) for i in range(EDGES + 1)))
    sketch = _inside(rows, state.drop("v"), keys).groupBy(*keys, *names, "m", "k", "lo", "hi").agg(F.percentile_approx(v, grid, ACCURACY).alias("edges"))
    at = F.floor(F.col("k") / F.col("m") * EDGES).cast("int")
    near = cut(sketch.withColumns({"from": F.get("edges", F.greatest(at - 1, F.lit(0))), "to": F.get("edges", F.least(at + 2, F.lit(EDGES)))}).drop("edges", "m"))
    n = {"below": v < F.col("from"), "first": v == F.col("from"), "between": (v > F.col("from")) & (v < F.col("to")), "last": (v == F.col("to")) & (F.col("from") < F.col("to"))}
    count = _inside(rows, near, keys).groupBy(*keys, *names, "k", "from", "to").agg(*(F.count_if(c).alias(name) for name, c in n.items()))
    k = F.col("k") - F.col("below")
    beyond = (k < 0) | (k >= F.col("first") + F.col("between") + F.col("last"))
    found = F.when(beyond, F.raise_error(F.lit("an order statistic left its interval")).cast("double")).when(k < F.col("first"), F.col("from")).when(k >= F.col("first") + F.col("between"), F.col("to"))
    return count.select(*keys, *names, F.col("between").alias("m"), (k - F.col("first")).alias("k"), F.col("from").alias("lo"), F.col("to").alias("hi"), found.alias("v"))
