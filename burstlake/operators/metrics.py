"""Counters, statistics and comparisons over candidate tables. Every one is an aggregate that Spark forms before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlake.operators.ranking import beside, percentiles


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def phase_counters(cands: DataFrame, by: str) -> DataFrame:
    """Per `by` and in all (null): how many entered, passed and failed each phase, and what was classified.

    cands has the columns snr_i_ok, snr_l_ok, burst_i, burst_l (booleans). Phase 2 gets what passed phase 1, 3a what
    passed 2, 3b what 3a has classified; a classified candidate has passed, burst or not.
    """
    ok2 = F.col("snr_i_ok") & F.coalesce("snr_l_ok", F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    p1, p2 = n(F.col("snr_i_ok")), n(ok2)
    c3a, c3b = ok2 & F.col("burst_i").isNotNull(), ok2 & F.col("burst_i").isNotNull() & F.col("burst_l").isNotNull()
    return cands.rollup(by).agg(
        p1.alias("p1_detected"), p1.alias("p2_detected"), p2.alias("p2_passed"), (p1 - p2).alias("p2_failed"),
        n(c3a).alias("p3a_classified"), n(c3a & F.col("burst_i")).alias("p3a_burst"), n(c3a & ~F.col("burst_i")).alias("p3a_no_burst"),
        n(c3b).alias("p3b_classified"), n(c3b & F.col("burst_l")).alias("p3b_burst"), n(c3b & ~F.col("burst_l")).alias("p3b_no_burst"),
    )


def column_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median, ends, count and sample deviation (null for a single value) of groups of any size."""
    v = F.col(value)
    plain = df.groupBy(*by).agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"), F.round(F.stddev_samp(v), 6).alias("std"))
    middle = percentiles(df, by, value, median=0.5)
    both = beside(plain, middle, by) if by else plain.crossJoin(F.broadcast(middle))
    return both.select(*by, "mean", F.round("median", 6).alias("median"), "min", "max", "n", "std")


def confusion(validated: Column, matched: Column, burst: Column) -> dict[str, Column]:
    """Counts and rates of a table of validated and new rows, as an aggregation.

    tp: validated, matched and burst; fn: validated and not matched; fp and tn: new, burst or not. Matched rows that are
    no burst are in none of the four; fn_all counts them, for recall_all.
    """
    b = F.coalesce(burst, F.lit(False))
    return {"tp": F.count_if(validated & matched & b), "fn": F.count_if(validated & ~matched), "fp": F.count_if(~validated & b), "tn": F.count_if(~validated & ~b), "fn_all": F.count_if(validated & ~(matched & b))}


def rates(counts: DataFrame) -> DataFrame:
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    r, p = share(tp, tp + fn), share(tp, tp + fp)
    return counts.withColumns({
        "recall": F.round(r, 6), "precision": F.round(p, 6), "accuracy": F.round(share(tp + tn, tp + fn + fp + tn), 6),
        "f1": F.round(share(2 * r * p, r + p), 6), "specificity": F.round(share(tn, tn + fp), 6), "recall_all": F.round(share(tp, tp + F.col("fn_all")), 6),
    })


def coherence(i: Column, l_: Column) -> dict[str, Column]:
    """Both classifiers, only the first, only the second, neither; null counts as no burst."""
    a, b = F.coalesce(i, F.lit(False)), F.coalesce(l_, F.lit(False))
    return {"both": F.count_if(a & b), "only_i": F.count_if(a & ~b), "only_l": F.count_if(~a & b), "neither": F.count_if(~a & ~b)}


def two_sample(stats: DataFrame) -> DataFrame:
    """Pooled t statistic, Cohen's d and its size from one row with m1, s1, n1, m2, s2, n2 (means, sample deviations, counts)."""
    m1, s1, n1, m2, s2, n2 = (F.col(c).cast("double") for c in ("m1", "s1", "n1", "m2", "s2", "n2"))
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))
    t, d = share(m1 - m2, pooled * F.sqrt(1 / n1 + 1 / n2)), share(m1 - m2, pooled)
    size = F.when(F.abs(d) > 0.8, "large").when(F.abs(d) > 0.5, "medium").otherwise("small")
    return stats.withColumns({"t": F.round(t, 6), "d": F.round(d, 6), "effect": size, "significant": F.abs(t) > 2})


def fences(stats: DataFrame) -> DataFrame:
    """Coefficient of variation in percent, and outlier fences from quartiles guessed at a quarter and three of the range."""
    q1, q3 = F.col("min") + 0.25 * (F.col("max") - F.col("min")), F.col("min") + 0.75 * (F.col("max") - F.col("min"))
    return stats.withColumns({"cv": F.round(share(F.col("std") * 100, F.col("mean")), 4), "low_fence": F.round(q1 - 1.5 * (q3 - q1), 4), "high_fence": F.round(q3 + 1.5 * (q3 - q1), 4)})


def any_per_key(df: DataFrame, key: str, **flags: Column) -> DataFrame:
    return df.groupBy(key).agg(*(F.bool_or(c).alias(k) for k, c in flags.items()))


def last_runs(runs: DataFrame, by: str, order: str, values: list[str], keep: int = 10) -> DataFrame:
    """The last `keep` runs of each key, with running totals over all its runs."""
    w = Window.partitionBy(by).orderBy(order)
    total = runs.withColumns({f"total_{v}": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) for v in values})
    return total.withColumn("age", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("age") <= keep)


#: What a run's report may hold, with the names of older reports beside the newer ones.
REPORT = """dm_cube struct<dm_max: double, delta_t_max_seconds: double>, actual_processing struct<chunks_processed: bigint>,
overlap_validation struct<overlap_decimated: bigint, overlap_decimated_samples: bigint, no_edge_losses: boolean>,
chunks array<struct<chunk_idx: bigint, temporal_info: struct<overlap_left_decimated: bigint, overlap_right_decimated: bigint, valid_start_decimated: bigint, valid_end_decimated: bigint, valid_samples: bigint>,
overlap_left_decimated: bigint, overlap_right_decimated: bigint, valid_start_decimated: bigint, valid_end_decimated: bigint, valid_samples_decimated: bigint,
overlap_sufficient: boolean, overlap_vs_delay_ratio: double, overlap_ratio: double, continuity_with_previous: boolean>>"""


def overlap_summary(reports: DataFrame, text: str, *keep: str) -> DataFrame:
    """Of each report, a JSON text: the overlap that was planned, how many chunks were read (0 if untold) and whether no edge was lost (false if untold).

    The columns `keep` stay. A text that is null or no JSON has nulls and these defaults.
    """
    r = F.from_json(text, REPORT)
    v = r["overlap_validation"]
    return reports.select(
        *keep, r["dm_cube"]["dm_max"].alias("dm_max"), r["dm_cube"]["delta_t_max_seconds"].alias("delta_t_max_s"), F.coalesce(v["overlap_decimated"], v["overlap_decimated_samples"]).alias("overlap_samples"),
        F.coalesce(r["actual_processing"]["chunks_processed"], F.lit(0)).alias("num_chunks"), F.coalesce(v["no_edge_losses"], F.lit(False)).alias("no_edge_losses"),
    )


def chunk_continuity(reports: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each chunk of each report, a JSON text: its index (its place if untold), overlaps, valid part and whether it joins the one before.

    The columns `keep` stay. What is told within `temporal_info` comes before the same beside it; untold overlaps and
    ratios are 0, untold answers false, an untold valid part null. Reports that are null, no JSON or without chunks have no row.
    """
    c, inner = F.col("report_chunk"), F.col("report_chunk.temporal_info")
    told = lambda name, flat=None: F.coalesce(inner[name], c[flat or name])
    return reports.select(*keep, F.posexplode(F.from_json(text, REPORT)["chunks"]).alias("report_place", "report_chunk")).select(
        *keep, F.coalesce(c["chunk_idx"], F.col("report_place")).alias("chunk_index"),
        F.coalesce(told("overlap_left_decimated"), F.lit(0)).alias("overlap_left"), F.coalesce(told("overlap_right_decimated"), F.lit(0)).alias("overlap_right"),
        told("valid_start_decimated").alias("valid_start"), told("valid_end_decimated").alias("valid_end"), told("valid_samples", "valid_samples_decimated").alias("valid_samples"),
        F.coalesce(c["overlap_sufficient"], F.lit(False)).alias("overlap_sufficient"), F.coalesce(c["overlap_vs_delay_ratio"], c["overlap_ratio"], F.lit(0.0)).alias("overlap_ratio"),
        F.coalesce(c["continuity_with_previous"], F.lit(False)).alias("continuity_with_previous"),
    )
