"""Queries of candidate analytics: names, dates, matching, metrics, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.functions import astro, names
from burstlake.operators import matching, metrics
from burstlake.operators.ranking import beside, percentiles
from burstlake.plans.registry import CANDIDATES, candidates, query, table

TOL = 600.0


def truth(spark, sf_dir) -> DataFrame:
    return candidates(spark, sf_dir).where("kind = 'purchase'").select("file_id", F.col("cand_id").alias("truth_id"), F.col("t_sec").alias("truth_t"))


def found(spark, sf_dir) -> DataFrame:
    return candidates(spark, sf_dir).where("kind = 'error'").select("file_id", F.col("cand_id").alias("found_id"), F.col("t_sec").alias("found_t"))


MATCH = CANDIDATES + """, tr AS (SELECT file_id, cand_id AS truth_id, t_sec AS truth_t FROM cand WHERE kind = 'purchase'), fo AS (SELECT file_id, cand_id AS found_id, t_sec AS found_t FROM cand WHERE kind = 'error'),
mt AS (SELECT tr.file_id, truth_id, truth_t, found_id, found_t, count(found_id) OVER (PARTITION BY truth_id) AS num_matches, found_id IS NOT NULL AS has_match
FROM tr LEFT JOIN fo ON tr.file_id = fo.file_id AND abs(truth_t - found_t) < 600)"""


@query(MATCH + " SELECT file_id, truth_id, found_id, num_matches, has_match FROM mt")
def match_band_left(spark, sf_dir):
    return matching.band_match(truth(spark, sf_dir), found(spark, sf_dir), "file_id", TOL).select("file_id", "truth_id", "found_id", "num_matches", "has_match")


@query(MATCH + " SELECT file_id, found_id FROM fo WHERE found_id NOT IN (SELECT found_id FROM mt WHERE found_id IS NOT NULL)")
def match_anti_new(spark, sf_dir):
    f = found(spark, sf_dir)
    return matching.never_matched(f, matching.band_match(truth(spark, sf_dir), f, "file_id", TOL)).select("file_id", "found_id")


@query(MATCH + """ SELECT file_id, truth_id, found_id, num_matches, has_match, 'validated' AS match_type FROM mt
UNION ALL SELECT file_id, NULL, found_id, 0, false, 'new' FROM fo WHERE found_id NOT IN (SELECT found_id FROM mt WHERE found_id IS NOT NULL)""")
def match_full(spark, sf_dir):
    return matching.full_match(truth(spark, sf_dir), found(spark, sf_dir), "file_id", TOL)


NEAREST = CANDIDATES + """, c AS (SELECT cand_id, mjd, floor(mjd) AS day FROM cand WHERE kind = 'click'), b AS (SELECT cand_id AS burst_id, mjd AS bm, floor(mjd) AS day FROM cand WHERE kind = 'purchase'),
s AS (SELECT cand_id, burst_id, abs(mjd - bm) AS d, row_number() OVER (PARTITION BY cand_id ORDER BY abs(mjd - bm), bm, burst_id) AS k FROM c JOIN b ON c.day = b.day),
o AS (SELECT cand_id, burst_id, abs(mjd - bm) AS d, row_number() OVER (PARTITION BY cand_id ORDER BY abs(mjd - bm), bm, burst_id) AS k FROM c, b WHERE c.day NOT IN (SELECT day FROM b))
SELECT cand_id, burst_id, round(d * 86400.0::DOUBLE, 3) AS delta_s FROM s WHERE k = 1 UNION ALL SELECT cand_id, burst_id, round(d * 86400.0::DOUBLE, 3) FROM o WHERE k = 1"""


@query(NEAREST)
def nearest_same_day(spark, sf_dir):
    """The burst nearest to each candidate, over all bursts of the table."""
    c = candidates(spark, sf_dir)
    return matching.nearest_same_day(c.where("kind = 'click'"), c.where("kind = 'purchase'").select(F.col("cand_id").alias("burst_id"), "mjd"))


#: The name that round 1 gave to the search over all bursts.
query(NEAREST, "nearest_same_day_all")(nearest_same_day)


@query()
def greedy_one_to_one(spark, sf_dir):
    return matching.greedy_match(truth(spark, sf_dir), found(spark, sf_dir), "file_id", 3600.0)


@query("""WITH l AS (SELECT lang, min(doc_id) AS lo, max(doc_id) AS hi FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT page_id, lang FROM pages JOIN l ON contains(url, '/' || lang || '/') AND page_id BETWEEN lo AND hi""")
def canonical_theta_match(spark, sf_dir):
    """Rows that contain a pattern of a short list and lie in its interval; the list has a row for each language and is broadcast by Spark if it is small."""
    lst = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array_distinct(F.split("url", "/"))).alias("lang"))
    return p.join(lst, "lang").where(F.col("url").contains(F.concat(F.lit("/"), "lang", F.lit("/"))) & F.col("page_id").between(F.col("lo"), F.col("hi"))).select("page_id", "lang")


@query("""WITH p AS (SELECT page_id, list_distinct(list_filter(string_split_regex(url, '[/.]'), lambda x: length(x) >= 3)) AS tk FROM pages)
SELECT a.page_id, len(list_intersect(a.tk, b.tk)) AS common, len(list_intersect(a.tk, b.tk)) >= greatest(1, least(3, len(a.tk), len(b.tk))) AS similar FROM p a JOIN p b ON b.page_id = a.page_id + 1""")
def token_similarity_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", names.long_tokens(F.col("url"), "[/.]").alias("tk"))
    q = p.select((F.col("page_id") - 1).alias("page_id"), F.col("tk").alias("other"))
    return p.join(q, "page_id").select("page_id", F.size(F.array_intersect("tk", "other")).cast("long").alias("common"), names.similar(F.col("tk"), F.col("other")).alias("similar"))


@query("""WITH p AS (SELECT page_id, list_distinct(list_filter(string_split_regex(url, '[/.]'), lambda x: length(x) >= 3)) AS tk FROM pages)
SELECT a.page_id AS known_id, b.page_id AS found_id, len(list_intersect(a.tk, b.tk)) AS common FROM p a JOIN p b ON b.page_id > a.page_id AND b.page_id <= a.page_id + 8
WHERE len(list_intersect(a.tk, b.tk)) >= greatest(1, least(3, len(a.tk), len(b.tk)))""")
def token_similarity_band(spark, sf_dir):
    """All pairs of pages with similar names within a band of ids, which stand for times; each pair once."""
    side = lambda x: table(spark, sf_dir, "pages").select(F.col("page_id").alias(f"{x}_id"), F.col("page_id").alias(f"{x}_t"), names.long_tokens(F.col("url"), "[/.]").alias(f"{x}_tokens"))
    return matching.similar_match(side("known"), side("found"), 8).where("known_id < found_id")


@query("""SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey, d.c_custkey) AS custkey, CASE WHEN a.c_custkey IS NOT NULL THEN 0 WHEN b.c_custkey IS NOT NULL THEN 1 WHEN d.c_custkey IS NOT NULL THEN 2 END AS priority
FROM orders LEFT JOIN customer a ON a.c_name = 'Customer#' || o_custkey::VARCHAR LEFT JOIN customer b ON b.c_name = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') LEFT JOIN customer d ON d.c_name = 'customer-' || o_custkey::VARCHAR""")
def lookup_with_variants(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"))
    tries = [F.concat(F.lit("Customer#"), "k"), F.concat(F.lit("Customer#"), F.lpad("k", 9, "0")), F.concat(F.lit("customer-"), "k")]
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("spelling"), F.col("c_custkey").alias("custkey"))
    return matching.lookup(o, c, tries, "spelling", "custkey", "o_orderkey").select("o_orderkey", "custkey", "priority")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def best_match_dedup(spark, sf_dir):
    return matching.best_of(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.desc_nulls_last("value"), F.asc("event_id"))


FLAGS = CANDIDATES + """, f AS (SELECT *, kind = 'purchase' AS validated, snr > 2 AS matched, CASE WHEN kind = 'error' THEN NULL ELSE snr > 5 END AS burst_i, CASE WHEN cand_id % 3 = 0 THEN NULL ELSE snr > 6 END AS burst_l,
snr > 3 AS snr_i_ok, CASE WHEN file_id % 7 = 0 THEN NULL ELSE snr > 4 END AS snr_l_ok FROM cand)"""


def flags(spark, sf_dir) -> DataFrame:
    """Candidates with the outcomes of the phases, from their score and kind."""
    c, s = candidates(spark, sf_dir), F.col("snr")
    return c.withColumns({
        "validated": F.col("kind") == "purchase", "matched": s > 2, "burst_i": F.when(F.col("kind") != "error", s > 5), "burst_l": F.when(F.col("cand_id") % 3 != 0, s > 6),
        "snr_i_ok": s > 3, "snr_l_ok": F.when(F.col("file_id") % 7 != 0, s > 4),
    })


CONF = FLAGS + """, n AS (SELECT file_id, count(*) FILTER (validated AND matched AND coalesce(burst_i, false)) AS tp, count(*) FILTER (validated AND NOT matched) AS fn, count(*) FILTER (NOT validated AND coalesce(burst_i, false)) AS fp,
count(*) FILTER (NOT validated AND NOT coalesce(burst_i, false)) AS tn, count(*) FILTER (validated AND NOT (matched AND coalesce(burst_i, false))) AS fn_all FROM f GROUP BY file_id),
r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rc, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr FROM n)
SELECT file_id, tp, fn, fp, tn, fn_all, round(rc, 6) AS recall, round(pr, 6) AS precision, round(coalesce((tp + tn)::DOUBLE / nullif(tp + fn + fp + tn, 0), 0), 6) AS accuracy,
round(coalesce(2 * rc * pr / nullif(rc + pr, 0), 0), 6) AS f1, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(tp::DOUBLE / nullif(tp + fn_all, 0), 0), 6) AS recall_all FROM r"""


@query(CONF)
def confusion_metrics(spark, sf_dir):
    c = metrics.confusion(F.col("validated"), F.col("matched"), F.col("burst_i"))
    return metrics.rates(flags(spark, sf_dir).groupBy("file_id").agg(*(v.alias(k) for k, v in c.items())))


@query(FLAGS + """ SELECT kind, count(*) FILTER (snr_i_ok) AS p1_detected, count(*) FILTER (snr_i_ok) AS p2_detected, count(*) FILTER (snr_i_ok AND snr_l_ok) AS p2_passed, count(*) FILTER (snr_i_ok) - count(*) FILTER (snr_i_ok AND snr_l_ok) AS p2_failed,
count(*) FILTER (snr_i_ok AND snr_l_ok AND burst_i IS NOT NULL) AS p3a_classified, count(*) FILTER (snr_i_ok AND snr_l_ok AND burst_i) AS p3a_burst, count(*) FILTER (snr_i_ok AND snr_l_ok AND NOT burst_i) AS p3a_no_burst,
count(*) FILTER (snr_i_ok AND snr_l_ok AND burst_i IS NOT NULL AND burst_l IS NOT NULL) AS p3b_classified, count(*) FILTER (snr_i_ok AND snr_l_ok AND burst_i IS NOT NULL AND burst_l) AS p3b_burst,
count(*) FILTER (snr_i_ok AND snr_l_ok AND burst_i IS NOT NULL AND NOT burst_l) AS p3b_no_burst FROM f GROUP BY ROLLUP (kind)""")
def phase_counters_rollup(spark, sf_dir):
    return metrics.phase_counters(flags(spark, sf_dir), "kind")


@query(FLAGS + " SELECT file_id, count(*) AS n, count(*) FILTER (burst_i) AS n_burst, max(snr) AS max_snr, round(avg(snr), 6) AS mean_snr, CASE WHEN file_id % 2 = 0 THEN count(*) FILTER (burst_i) ELSE count(*) END AS n_effective FROM f GROUP BY file_id")
def candidate_stats(spark, sf_dir):
    n, b = F.count("*"), F.count_if(F.coalesce("burst_i", F.lit(False)))
    return flags(spark, sf_dir).groupBy("file_id").agg(n.alias("n"), b.alias("n_burst"), F.max("snr").alias("max_snr"), F.round(F.avg("snr"), 6).alias("mean_snr"), F.when(F.col("file_id") % 2 == 0, b).otherwise(n).alias("n_effective"))


STATS = "round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, min({v}) AS min, max({v}) AS max, count({v}) AS n, round(stddev_samp({v}), 6) AS std"


@query("SELECT event_type, " + STATS.format(v="value") + " FROM events GROUP BY event_type")
def column_stats(spark, sf_dir):
    return metrics.column_stats(table(spark, sf_dir, "events"), "value", "event_type")


def outcomes(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("size"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("i"), (F.col("toxic") == 1).alias("l")), "doc_id")


OUT = "WITH o AS (SELECT d.doc_id, lang, n_chars::DOUBLE AS size, quality = 1 AS i, toxic = 1 AS l FROM documents d JOIN labels USING (doc_id))"


@query(OUT + ", s AS (SELECT 'i' AS classifier, i AS outcome, size FROM o UNION ALL SELECT 'l', l, size FROM o) SELECT classifier, outcome, " + STATS.format(v="size") + " FROM s GROUP BY ALL")
def stats_by_classifier(spark, sf_dir):
    s = outcomes(spark, sf_dir).selectExpr("size", "stack(2, 'i', i, 'l', l) as (classifier, outcome)")
    return metrics.column_stats(s, "size", "classifier", "outcome")


@query(OUT + " SELECT lang, count(*) FILTER (coalesce(i, false) AND coalesce(l, false)) AS both, count(*) FILTER (coalesce(i, false) AND NOT coalesce(l, false)) AS only_i, count(*) FILTER (NOT coalesce(i, false) AND coalesce(l, false)) AS only_l, count(*) FILTER (NOT coalesce(i, false) AND NOT coalesce(l, false)) AS neither FROM o GROUP BY lang")
def coherence_2x2(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("lang").agg(*(v.alias(k) for k, v in metrics.coherence(F.col("i"), F.col("l")).items()))


TWO = """, g AS (SELECT lang, avg(size) FILTER (l) AS m1, stddev_samp(size) FILTER (l) AS s1, count(*) FILTER (l) AS n1, avg(size) FILTER (NOT l) AS m2, stddev_samp(size) FILTER (NOT l) AS s2, count(*) FILTER (NOT l) AS n2 FROM o GROUP BY lang),
p AS (SELECT *, sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) AS pooled FROM g),
q AS (SELECT lang, n1, n2, coalesce((m1 - m2) / nullif(pooled * sqrt(1 / n1::DOUBLE + 1 / n2::DOUBLE), 0), 0) AS t, coalesce((m1 - m2) / nullif(pooled, 0), 0) AS d FROM p)
SELECT lang, n1, n2, round(t, 6) AS t, round(d, 6) AS d, CASE WHEN abs(d) > 0.8 THEN 'large' WHEN abs(d) > 0.5 THEN 'medium' ELSE 'small' END AS effect, abs(t) > 2 AS significant FROM q"""


@query(OUT + TWO)
def cohens_d(spark, sf_dir):
    side = lambda on: F.when(on, F.col("size"))
    a, b = side(F.col("l")), side(~F.col("l"))
    g = outcomes(spark, sf_dir).groupBy("lang").agg(F.avg(a).alias("m1"), F.stddev_samp(a).alias("s1"), F.count(a).alias("n1"), F.avg(b).alias("m2"), F.stddev_samp(b).alias("s2"), F.count(b).alias("n2"))
    return metrics.two_sample(g).select("lang", "n1", "n2", "t", "d", "effect", "significant")


@query("WITH a AS (SELECT user_id, event_type, round(avg(value), 6) AS score FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (score, event_type)) AS best, max(score) AS score FROM a GROUP BY user_id")
def best_phase(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"))
    return a.groupBy("user_id").agg(F.max_by("event_type", F.struct("score", "event_type")).alias("best"), F.max("score").alias("score"))


@query("WITH s AS (SELECT user_id, " + STATS.format(v="value") + " FROM events GROUP BY user_id) SELECT user_id, round(coalesce(std * 100 / nullif(mean, 0), 0), 4) AS cv, round(min + 0.25 * (max - min) - 1.5 * ((min + 0.75 * (max - min)) - (min + 0.25 * (max - min))), 4) AS low_fence, round(min + 0.75 * (max - min) + 1.5 * ((min + 0.75 * (max - min)) - (min + 0.25 * (max - min))), 4) AS high_fence FROM s")
def cv_and_fences(spark, sf_dir):
    return metrics.fences(metrics.column_stats(table(spark, sf_dir, "events"), "value", "user_id")).select("user_id", "cv", "low_fence", "high_fence")


@query(FLAGS + " SELECT file_id, bool_or(matched) AS detected, bool_or(coalesce(burst_i, false)) AS burst FROM f GROUP BY file_id")
def any_burst_per_pulse(spark, sf_dir):
    return metrics.any_per_key(flags(spark, sf_dir), "file_id", detected=F.col("matched"), burst=F.coalesce("burst_i", F.lit(False)))


RAW_NAME = """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d-%H-%M-%S') || '_' || lpad((event_id % 10000)::VARCHAR, 4, '0') || '.fits' WHEN 1 THEN strftime(ts, '%Y_%m_%d-%H%M%S') || '_' || lpad((event_id % 10000)::VARCHAR, 4, '0')
WHEN 2 THEN ' ' || strftime(ts, '%Y-%m-%d-%H_%M_%S') || '_' || lpad((event_id % 10000)::VARCHAR, 4, '0') || '_t' || (event_id % 90)::VARCHAR || '.5' WHEN 3 THEN 'RUN-' || event_type || '-' || event_id::VARCHAR ELSE strftime(ts, '%Y-%m-%d') || '-x' || user_id::VARCHAR || '_a' END AS raw FROM events)"""


def raw_names(spark, sf_dir) -> DataFrame:
    """Names of recordings in the spellings that occur, from events."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    part, day = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), lambda f: F.date_format(ts, f)
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.concat(day("yyyy-MM-dd-HH-mm-ss"), F.lit("_"), part, F.lit(".fits")))
        .when(k == 1, F.concat(day("yyyy_MM_dd-HHmmss"), F.lit("_"), part))
        .when(k == 2, F.concat(F.lit(" "), day("yyyy-MM-dd-HH_mm_ss"), F.lit("_"), part, F.lit("_t"), (F.col("event_id") % 90).cast("string"), F.lit(".5")))
        .when(k == 3, F.concat(F.lit("RUN-"), "event_type", F.lit("-"), F.col("event_id").cast("string")))
        .otherwise(F.concat(day("yyyy-MM-dd"), F.lit("-x"), F.col("user_id").cast("string"), F.lit("_a")))
    )
    return e.select("event_id", raw.alias("raw"))


NORMAL = RAW_NAME + r""", b AS (SELECT event_id, raw, regexp_replace(lower(replace(trim(raw), '.fits', '')), '^(.+?)_t[\d.].*$', '\1') AS b FROM s),
w AS (SELECT *, string_split_regex(b, '[-_]') AS w FROM b),
d AS (SELECT *, regexp_full_match(w[1], '\d{4}') AND regexp_full_match(w[2], '\d\d') AND regexp_full_match(w[3], '\d\d') AS dated, regexp_full_match(w[len(w)], '\d{4}') AS parted FROM w),
m AS (SELECT *, w[4:len(w) - parted::INT] AS m FROM d),
c AS (SELECT *, CASE WHEN len(list_filter(m[1:3], lambda x: regexp_full_match(x, '\d\d'))) = 3 THEN m[1:3] WHEN regexp_matches(m[1], '^\d{6}') THEN [m[1][1:2], m[1][3:4], m[1][5:6]] ELSE [array_to_string(m, '')] END AS clock FROM m)
SELECT event_id, CASE WHEN dated THEN array_to_string(list_filter(w[1:3] || clock || CASE WHEN parted THEN w[len(w):] ELSE [] END, lambda x: x <> ''), '_') ELSE replace(b, '-', '_') END AS name,
lower(replace(raw, '-', '_')) AS underscored, lower(replace(replace(raw, '_', '-'), ' ', '')) AS hyphened FROM c"""


@query(NORMAL)
def normalize_filename(spark, sf_dir):
    r = raw_names(spark, sf_dir)
    return r.select("event_id", names.normal_name(F.col("raw")).alias("name"), names.underscored(F.col("raw")).alias("underscored"), names.hyphened(F.col("raw")).alias("hyphened"))


@query(r"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (value)::DECIMAL(12,2)::DOUBLE END AS number, event_type = 'purchase' AS is_canonical FROM events")
def strip_parenthesised_number(spark, sf_dir):
    """Times with a remark in parentheses, some of them unreadable; the remark marks canonical pulses."""
    e = table(spark, sf_dir, "events")
    number = F.when(F.col("event_id") % 9 == 0, F.lit("n/a")).otherwise(F.format_string("%.2f", F.col("value")))
    text = F.concat(number, F.lit(" ("), F.when(F.col("event_type") == "purchase", "Pulso Jose").otherwise("pulso"), F.lit(")"))
    return e.select("event_id", names.bare_number(text).alias("number"), F.lower(text).contains("pulso jose").alias("is_canonical"))


@query(RAW_NAME + r", f AS (SELECT event_id, raw, regexp_matches(raw, '_t[\d.]+') AS special FROM s) SELECT event_id, special FROM f WHERE NOT special OR event_id - 2 NOT IN (SELECT event_id FROM f WHERE NOT special)")
def special_file_filter(spark, sf_dir):
    """Names with a time mark go if the plain recording two before is there."""
    f = raw_names(spark, sf_dir).withColumn("special", names.is_special(F.col("raw")))
    plain = f.where("not special").select((F.col("event_id") + 2).alias("event_id"), F.lit(True).alias("has_plain"))
    return f.join(plain, "event_id", "left").where("not special or has_plain is null").select("event_id", "special")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def catalog_grouping_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') OR contains(url, '/fr/') THEN 'central' WHEN contains(url, '/es/') THEN 'south' ELSE 'unknown' END AS "case",
CASE WHEN ends_with(lower(url), '.html') THEN 'html' ELSE 'other' END AS format, round(length(html) / 1048576.0::DOUBLE, 6) AS mb FROM pages""")
def file_classification(spark, sf_dir):
    p, u = table(spark, sf_dir, "pages"), F.col("url")
    case = F.when(u.contains("/en/"), "english").when(u.contains("/de/") | u.contains("/fr/"), "central").when(u.contains("/es/"), "south").otherwise("unknown")
    return p.select("page_id", case.alias("case"), F.when(F.lower(u).endswith(".html"), "html").otherwise("other").alias("format"), F.round(F.length("html") / F.lit(1048576.0), 6).alias("mb"))


@query(CANDIDATES + """ SELECT cand_id, round(coalesce(CASE WHEN cand_id % 3 = 0 THEN floor(mjd) + 0.5 END, CASE WHEN cand_id % 5 <> 0 THEN floor(mjd) END, 0) + t_sec / 86400, 9) AS mjd_topo,
round(mjd - 4148.808::DOUBLE * snr / (1400.0::DOUBLE * 1400.0::DOUBLE) / 86400, 9) AS mjd_inf, round(t_sec - 4150.0::DOUBLE * snr * (1 / (1250.0::DOUBLE * 1250.0::DOUBLE) - 1 / (1500.0::DOUBLE * 1500.0::DOUBLE)), 6) AS t_undispersed, round(t_sec + 0.0000256, 7) AS t_centred FROM cand""")
def candidate_times(spark, sf_dir):
    """Topocentric and infinite-frequency dates, arrival without dispersion, and the centre of the sample."""
    c, day = candidates(spark, sf_dir), F.floor("mjd").cast("double")
    topo = astro.topocentric_mjd(F.when(F.col("cand_id") % 5 != 0, day), F.when(F.col("cand_id") % 3 == 0, day + 0.5), F.col("t_sec"))
    flat = F.col("t_sec") - astro.delay_seconds(F.col("snr"), F.lit(1250.0), F.lit(1500.0))
    return c.select("cand_id", F.round(topo, 9).alias("mjd_topo"), F.round(astro.infinite_frequency_mjd(F.col("mjd"), F.col("snr"), F.lit(1400.0)), 9).alias("mjd_inf"), F.round(flat, 6).alias("t_undispersed"), F.round(F.col("t_sec") + F.lit(0.0000256), 7).alias("t_centred"))


@query("""WITH w AS (SELECT event_id, value AS dm, least(200.0::DOUBLE, greatest(50.0::DOUBLE, CASE WHEN value > 0 THEN value * 0.4::DOUBLE ELSE 50.0 END)) AS wd FROM events)
SELECT event_id, round(CASE WHEN dm - wd / 2 < 0 THEN 0.0 WHEN dm + wd / 2 > 450 THEN greatest(450.0 - wd, 0.0) ELSE dm - wd / 2 END, 6) AS lo, round(CASE WHEN dm - wd / 2 < 0 THEN least(0.0 + wd, 450.0) WHEN dm + wd / 2 > 450 THEN 450.0 ELSE dm + wd / 2 END, 6) AS hi FROM w""")
def dynamic_dm_range(spark, sf_dir):
    lo, hi = astro.dm_range(F.col("value"), 0.0, 450.0, 0.2, 50.0, 200.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(CANDIDATES + """ SELECT cand_id, round(greatest(0.0::DOUBLE, snr - sqrt(2.0::DOUBLE * ln((1 + file_id) * 21))), 6) AS significance, round(least(0.99, greatest(0.05, snr / 10.0)), 6) AS confidence, round(1 / (1 + exp(-(snr - 5.0) / 2.0)), 6) AS prob,
1 / (1 + exp(-(snr - 5.0) / 2.0)) >= 0.6 AS is_burst FROM cand""")
def candidate_scores(spark, sf_dir):
    s = F.col("snr")
    prob = astro.logistic(s, 5.0)
    return candidates(spark, sf_dir).select("cand_id", F.round(astro.significance(s, 1 + F.col("file_id"), F.lit(21)), 6).alias("significance"), F.round(astro.confidence(s), 6).alias("confidence"), F.round(prob, 6).alias("prob"), (prob >= 0.6).alias("is_burst"))


@query(CANDIDATES + """ SELECT cand_id, round(0 + (cand_id % 512) * ((200.0::DOUBLE - 0 + 1) / 512.0::DOUBLE), 6) AS dm_classic, round(0 + (cand_id % 201) / 200.0::DOUBLE * 200.0::DOUBLE, 6) AS dm_row,
round((4150.0::DOUBLE * 200 * (1 / (1200.0::DOUBLE * 1200.0::DOUBLE) - 1 / (1500.0::DOUBLE * 1500.0::DOUBLE)) - 4150.0::DOUBLE * snr * (1 / (1200.0::DOUBLE * 1200.0::DOUBLE) - 1 / (1500.0::DOUBLE * 1500.0::DOUBLE))) / 0.001::DOUBLE, 3) AS span_samples FROM cand""")
def dispersion_span(spark, sf_dir):
    """Both maps from a row to a DM, and by how many samples the delays of a range of DMs differ."""
    lo, hi = (astro.delay_seconds(d, F.lit(1200.0), F.lit(1500.0)) for d in (F.col("snr"), F.lit(200.0)))
    k = F.col("cand_id")
    return candidates(spark, sf_dir).select("cand_id", F.round(astro.dm_classic(k % 512, 0.0, 200.0), 6).alias("dm_classic"), F.round(astro.dm_of_row(k % 201, 201, 0.0, 200.0), 6).alias("dm_row"), F.round((hi - lo) / F.lit(0.001), 3).alias("span_samples"))


DECIDE = "CASE WHEN hi AND hl THEN CASE WHEN st THEN i AND l ELSE i OR l END WHEN hi THEN NOT st OR i WHEN hl THEN NOT st OR l ELSE false END"


@query("WITH o AS (SELECT doc_id, quality = 1 AS i, toxic = 1 AS l, doc_id % 5 <> 0 AS hi, doc_id % 3 <> 0 AS hl, doc_id % 2 = 0 AS st FROM labels) SELECT doc_id, hi AND i AS is_burst, " + DECIDE + " AS should_save FROM o")
def decision_table(spark, sf_dir):
    o, k = table(spark, sf_dir, "labels"), F.col("doc_id")
    i, l_ = F.col("quality") == 1, F.col("toxic") == 1
    return o.select("doc_id", ((k % 5 != 0) & i).alias("is_burst"), astro.decision(k % 5 != 0, k % 3 != 0, i, l_, k % 2 == 0).alias("should_save"))


#: The six configurations of a run: which classifiers count, and whether only bursts are saved.
CONFIGS = [("a", True, True, True), ("b", True, True, False), ("c", True, False, True), ("d", True, False, False), ("e", False, True, True), ("f", False, True, False)]


@query(FLAGS + ", g(config, hi, hl, st) AS (VALUES " + ", ".join(f"('{c}', {h}, {k}, {s})" for c, h, k, s in CONFIGS) + "), x AS (SELECT config, hi, hl, st, coalesce(burst_i, false) AS i, coalesce(burst_l, false) AS l FROM f, g) SELECT config, count(*) AS n, count(*) FILTER (" + DECIDE + ") AS saved FROM x GROUP BY config")
def phase_configs(spark, sf_dir):
    """All configurations in one pass over the candidates: each is a count, not a copy of the rows."""
    d = [astro.decision(F.lit(h), F.lit(k), F.col("burst_i"), F.col("burst_l"), F.lit(s)) for _, h, k, s in CONFIGS]
    one = flags(spark, sf_dir).agg(F.count("*").alias("n"), *(F.count_if(x).alias(c) for x, (c, *_) in zip(d, CONFIGS, strict=True)))
    return one.selectExpr("n", f"stack({len(CONFIGS)}, " + ", ".join(f"'{c}', `{c}`" for c, *_ in CONFIGS) + ") as (config, saved)").select("config", "n", "saved")


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice / l_quantity), 4) AS avg_ratio, min(l_discount) AS min_ratio, max(l_discount) AS max_ratio, bool_and(l_tax < 0.08) AS all_sufficient, count(*) FILTER (l_tax < 0.08) AS n_sufficient, count(*) AS n FROM lineitem GROUP BY ALL""")
def overlap_validation(spark, sf_dir):
    ok = F.col("l_tax") < 0.08
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("avg_ratio"), F.min("l_discount").alias("min_ratio"), F.max("l_discount").alias("max_ratio"), F.every(ok).alias("all_sufficient"), F.count_if(ok).alias("n_sufficient"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, sum((o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ALL)
SELECT o_custkey, day, n, cents, total_n::BIGINT AS total_n, total_cents::BIGINT AS total_cents, age FROM (SELECT *, sum(n) OVER w AS total_n, sum(cents) OVER w AS total_cents, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC) AS age FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING)) WHERE age <= 10""")
def run_history_last10(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.groupBy("o_custkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return metrics.last_runs(r, "o_custkey", "day", ["n", "cents"])


@query("SELECT 'click' AS source_file, event_id, value, NULL AS user_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'error', event_id, NULL, user_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'view', event_id, value, user_id FROM events WHERE event_type = 'view'")
def union_candidates(spark, sf_dir):
    """Lists whose columns differ, as one table."""
    e = table(spark, sf_dir, "events")
    parts = [e.where(f"event_type = '{k}'").select(F.lit(k).alias("source_file"), *c) for k, c in (("click", ["event_id", "value"]), ("error", ["event_id", "user_id"]), ("view", ["event_id", "value", "user_id"]))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query(FLAGS + """ SELECT CASE WHEN validated THEN 'validated' ELSE 'new' END AS grp, count(*) AS detected, count(*) FILTER (snr_i_ok) AS passed_i, count(*) FILTER (snr_i_ok AND snr_l_ok) AS passed_l, count(*) FILTER (burst_i) AS burst_i, count(*) FILTER (burst_i AND burst_l) AS burst_both,
round(count(*) FILTER (burst_i) * 100.0::DOUBLE / count(*), 4) AS pct_burst, count(*) - count(*) FILTER (burst_i) AS critical FROM f GROUP BY ALL""")
def flow_table(spark, sf_dir):
    """How many rows of either group reach each stage, and those detected but not accepted."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    i, l_, b, bl = (F.col(c) for c in ("snr_i_ok", "snr_l_ok", "burst_i", "burst_l"))
    total = F.count("*")
    return flags(spark, sf_dir).groupBy(F.when(F.col("validated"), "validated").otherwise("new").alias("grp")).agg(
        total.alias("detected"), n(i).alias("passed_i"), n(i & l_).alias("passed_l"), n(b).alias("burst_i"), n(b & bl).alias("burst_both"), F.round(n(b) * F.lit(100.0) / total, 4).alias("pct_burst"), (total - n(b)).alias("critical")
    )


@query(FLAGS + " SELECT file_id, count(*) FILTER (burst_i) AS n_i, count(*) FILTER (burst_l) AS n_l, count(*) FILTER (burst_i AND burst_l) AS n_both, round(max(snr), 6) AS top, count(*) FILTER (validated) AS expected, count(*) FILTER (validated AND matched) AS matched, round(coalesce(count(*) FILTER (validated AND matched)::DOUBLE / nullif(count(*) FILTER (validated), 0), 0), 6) AS coverage FROM f GROUP BY ROLLUP (file_id)")
def classification_counts(spark, sf_dir):
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    v, m = F.col("validated"), F.col("validated") & F.col("matched")
    return flags(spark, sf_dir).rollup("file_id").agg(n(F.col("burst_i")).alias("n_i"), n(F.col("burst_l")).alias("n_l"), n(F.col("burst_i") & F.col("burst_l")).alias("n_both"), F.round(F.max("snr"), 6).alias("top"), n(v).alias("expected"), n(m).alias("matched"), F.round(metrics.share(n(m), n(v)), 6).alias("coverage"))


@query("SELECT user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def json_field_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id) SELECT e.user_id, m.med >= 240 AS high, min(event_id) AS first, arg_min(event_id, (NOT value > 400, event_id)) AS best FROM events e JOIN m ON e.user_id = m.user_id GROUP BY ALL")
def best_per_slice(spark, sf_dir):
    """The first candidate of a file, the first burst instead if there is one, and whether its median is high."""
    rows = table(spark, sf_dir, "events")
    e = rows.groupBy("user_id").agg(F.min("event_id").alias("first"), F.min_by("event_id", F.struct(~(F.col("value") > 400), "event_id")).alias("best"))
    return beside(e, percentiles(rows, ("user_id",), "value", med=0.5), ("user_id",)).select("user_id", (F.col("med") >= 240).alias("high"), "first", "best")
