"""Detections against lists of known pulses: band, nearest, greedy, similarity and lookup joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlake.functions import names


def band_match(truth: DataFrame, found: DataFrame, key: str, tolerance: float, strict: bool = True) -> DataFrame:
    """truth (truth_id, key, truth_t) left outer found (found_id, key, found_t) on the key and a time distance under tolerance.

    Times go into bins of the tolerance's width, and each truth into its own and both neighbours: an equi join on (key,
    bin) that spreads a hot key over its bins. One row for each match, with their number; the unmatched stay with nulls.
    """
    near = F.abs(F.col("truth_t") - F.col("found_t"))
    hit = near < tolerance if strict else near <= tolerance
    t = truth.select(key, "truth_id", "truth_t", F.explode(F.sequence(F.floor(F.col("truth_t") / tolerance) - 1, F.floor(F.col("truth_t") / tolerance) + 1)).alias("bin"))
    d = found.select(key, "found_id", "found_t", F.floor(F.col("found_t") / tolerance).alias("bin"))
    pairs = t.join(d, [key, "bin"]).where(hit).select("truth_id", "found_id", "found_t")
    out = truth.join(pairs, "truth_id", "left")
    many = F.count("found_id").over(Window.partitionBy("truth_id"))
    return out.withColumn("num_matches", many).withColumn("has_match", F.col("found_id").isNotNull())


def never_matched(found: DataFrame, matches: DataFrame) -> DataFrame:
    return found.join(matches.where("found_id is not null").select("found_id"), "found_id", "left_anti")


def full_match(truth: DataFrame, found: DataFrame, key: str, tolerance: float) -> DataFrame:
    """band_match and the detections left over, in one table with match_type `validated` or `new`."""
    met = band_match(truth, found, key, tolerance)
    new = never_matched(found, met)
    a = met.select(key, "truth_id", "found_id", "num_matches", "has_match", F.lit("validated").alias("match_type"))
    b = new.select(key, "found_id", F.lit(0).cast("long").alias("num_matches"), F.lit(False).alias("has_match"), F.lit("new").alias("match_type"))
    return a.unionByName(b, allowMissingColumns=True)


def nearest_same_day(cands: DataFrame, bursts: DataFrame, bins_per_day: int = 1440) -> DataFrame:
    """(cand_id, burst_id, delta_s): the burst nearest in mjd, one of the same day if there is any, else of all days.

    The nearest is the last one before or the first one after (the earlier at a tie, then the smaller id). Both are
    sought within a bin of time, then among the ends of the day's other bins, then among the ends of other days, so that
    no window holds more rows than a bin has, or a day has bins, or the table has days.
    """
    cut = lambda df: df.withColumns({"bin": F.floor(F.col("mjd") * bins_per_day), "day": F.floor("mjd")})
    c, b = cut(cands.select("cand_id", "mjd")), cut(bursts.select("burst_id", "mjd"))
    end, begin = F.struct(F.col("mjd").alias("m"), (-F.col("burst_id")).alias("i")), F.struct(F.col("mjd").alias("m"), F.col("burst_id").alias("i"))
    tip = lambda keys: b.groupBy(*keys).agg(F.max(end).alias("last"), F.min(begin).alias("first"))

    def around(rows: DataFrame, ends: DataFrame, at: str, within: list[str], names: tuple[str, str]) -> DataFrame:
        every = rows.select(*within, at).distinct().join(ends, [*within, at], "full")
        w = Window.partitionBy(*within).orderBy(at)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        return every.select(*within, at, F.last("last", True).over(back).alias(names[0]), F.first("first", True).over(ahead).alias(names[1]))

    both = c.select("bin", "day", "mjd", "cand_id", F.lit(None).cast("long").alias("burst_id")).unionByName(b.select("bin", "day", "mjd", F.lit(None).cast("long").alias("cand_id"), "burst_id"))
    w = Window.partitionBy("bin").orderBy("mjd")
    seen = lambda x: F.when(F.col("burst_id").isNotNull(), x)
    own = both.withColumns({"p0": F.max(seen(end)).over(w.rangeBetween(Window.unboundedPreceding, 0)), "n0": F.min(seen(begin)).over(w.rangeBetween(0, Window.unboundedFollowing))}).where("cand_id is not null")
    out = own.join(around(c, tip(["day", "bin"]), "bin", ["day"], ("p1", "n1")), ["day", "bin"])
    # Days are few (a century has 36525), whatever the number of candidates.
    days = around(c.withColumn("all", F.lit(1)), tip(["day"]).withColumn("all", F.lit(1)), "day", ["all"], ("p2", "n2")).drop("all")
    out = out.join(F.broadcast(days), "day")

    def best(*cols: tuple[str, int]) -> F.Column:
        each = F.array(*[F.struct(F.abs(F.col("mjd") - F.col(f"{k}.m")).alias("d"), F.col(f"{k}.m").alias("m"), (F.col(f"{k}.i") * sign).alias("i")) for k, sign in cols])
        return F.array_min(F.filter(each, lambda x: x["m"].isNotNull()))

    same, other = best(("p0", -1), ("n0", 1), ("p1", -1), ("n1", 1)), best(("p2", -1), ("n2", 1))
    out = out.withColumn("b", F.coalesce(same, other))
    return out.select("cand_id", F.col("b.i").alias("burst_id"), F.round(F.col("b.d") * F.lit(86400.0), 3).alias("delta_s"))


def greedy_match(expected: DataFrame, found: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Each expected time in order takes the nearest detection of its key not yet taken, within the tolerance, ends included.

    The order of the choice matters, so it runs by group. A group is an unbroken run of time bins of the tolerance's
    width, which no match can leave; runs are found on the distinct bins of a key, not on its rows.
    """
    both = expected.select(key, F.col("truth_id").alias("id"), F.col("truth_t").alias("t"), F.lit(0).alias("kind")).unionByName(found.select(key, F.col("found_id").alias("id"), F.col("found_t").alias("t"), F.lit(1).alias("kind")))
    both = both.withColumn("bin", F.floor(F.col("t") / tolerance))
    w = Window.partitionBy(key).orderBy("bin")
    runs = both.select(key, "bin").distinct().withColumn("gap", F.coalesce((F.col("bin") - F.lag("bin").over(w) > 2).cast("int"), F.lit(0)))
    # Runs don't touch, so that some of them may share a group: a bounded number, else groups would be many and tiny.
    runs = runs.select(key, "bin", F.floor(F.sum("gap").over(w) / 64).alias("run"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        e = part[part["kind"] == 0].sort_values(["t", "id"])
        free = part[part["kind"] == 1].sort_values(["t", "id"])
        times, ids, used, rows = free["t"].to_numpy(), free["id"].to_numpy(), set(), []
        for x in e.itertuples():
            lo, hi = np.searchsorted(times, x.t - tolerance - 1e-6), np.searchsorted(times, x.t + tolerance + 1e-6)
            ok = [k for k in range(lo, hi) if k not in used and abs(times[k] - x.t) <= tolerance]
            k = min(ok, key=lambda k: (abs(times[k] - x.t), k), default=None)
            used |= {k}
            rows.append((part[key].iloc[0], x.id, None if k is None else ids[k]))
        return pd.DataFrame(rows, columns=[key, "truth_id", "found_id"]).astype({"found_id": "Int64"})

    kind = dict(both.dtypes)[key]
    return both.join(runs, [key, "bin"]).groupBy(key, "run").applyInPandas(choose, f"{key} {kind}, truth_id long, found_id long")


def similar_match(known: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """(known_id, found_id, common): all pairs with similar names whose times are at most the tolerance apart.

    known: (known_id, known_t, known_tokens); found: (found_id, found_t, found_tokens). Times go into bins of the
    tolerance's width, and each known row into its own and both neighbours, so that only rows near in time meet.
    """
    at = F.floor(F.col("known_t") / tolerance)
    k = known.withColumn("bin", F.explode(F.array(at - 1, at, at + 1)))
    pairs = k.join(found.withColumn("bin", F.floor(F.col("found_t") / tolerance)), "bin").where(F.abs(F.col("known_t") - F.col("found_t")) <= tolerance)
    met = pairs.where(names.similar(F.col("known_tokens"), F.col("found_tokens")))
    return met.select("known_id", "found_id", F.size(F.array_intersect("known_tokens", "found_tokens")).cast("long").alias("common"))


def lookup(rows: DataFrame, table: DataFrame, variants: list[Column], key: str, value: str, row_id: str) -> DataFrame:
    """The value of the first of several spellings of a key that the table has; null if it has none."""
    tries = rows.select(row_id, F.posexplode(F.array(*variants)).alias("priority", key))
    best = tries.join(table.select(key, value), key).groupBy(row_id).agg(F.min_by(value, "priority").alias(value), F.min("priority").alias("priority"))
    return rows.join(best, row_id, "left")


def best_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("row_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("row_ = 1").drop("row_")
