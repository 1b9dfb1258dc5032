"""Queries of sources, sinks and streams: the given tables are written as recordings, lists and landed files, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.functions.astro import BOXCARS
from burstlake.operators import signal
from burstlake.operators.containment import containing
from burstlake.operators.ranking import numbered
from burstlake.plans.registry import DT, FREQ0, STEP, query, table
from burstlake.sources import arrays, catalog, export, scan, settings
from burstlake.sources.recordings import register
from burstlake.staging import cut, keep_until_exit, shared_dir
from burstlake.streaming import carried, landing


def folder(spark) -> str:
    return keep_until_exit(spark, f"{shared_dir(spark)}/files/{uuid.uuid4().hex}")


def samples(spark, sf_dir) -> DataFrame:
    """(file, t, spec): the vectors of each label as one recording, in order of ids, numbered without a window over it."""
    e = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & (F.size("embedding") > 0)).select(F.concat(F.lit("run"), "label").alias("file"), "vec_id", F.col("embedding").alias("spec"))
    return numbered(e, ("file",), ["vec_id"], "t").select("file", "t", "spec")


def stem(path: str = "file"):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[.][a-z]+$", "")


def millionths(values: str):
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + F.round(v.cast("double") * 1e6).cast("bigint"))


SAMPLES = """WITH r AS (SELECT 'run' || label AS file, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
s AS (SELECT file, t, CAST(list_sum(list_transform(x, lambda v: CAST(round(CAST(v AS DOUBLE) * 1e6) AS BIGINT))) AS BIGINT) AS s FROM r)"""


@query(SAMPLES + " SELECT file, t, 0 AS pol, s FROM s")
def filterbank_files(spark, sf_dir):
    """Written as filterbank files and read by the source in ranges."""
    register(spark)
    paths = ",".join(r.path for r in export.write_files(samples(spark, sf_dir), folder(spark), "filterbank", dt=DT, freq=FREQ0, step=STEP).collect())
    read = spark.read.format("filterbank").option("samples", 20).option("paths", paths).load()
    return read.select(stem().alias("file"), F.col("sample_idx").alias("t"), "pol", millionths("spec").alias("s"))


@query(SAMPLES + ", n AS (SELECT file, max(t) AS last FROM r WHERE t % 3 <> 1 GROUP BY file) SELECT n.file, u.t, coalesce(CASE WHEN u.t % 3 <> 1 THEN s.s END, 0) AS s FROM (SELECT file, unnest(range(0, last + 1)) AS t FROM n) u JOIN n ON n.file = u.file LEFT JOIN s ON s.file = u.file AND s.t = u.t")
def psrfits_gaps(spark, sf_dir):
    """Written as PSRFITS rows of which every third is missing; read in tasks, the missing ones as zeros."""
    files = export.write_files(samples(spark, sf_dir).where("t % 3 <> 1"), folder(spark), "psrfits", dt=DT, freq=FREQ0, step=STEP)
    return scan.scan(files, samples=32).select(stem().alias("file"), "t", millionths(F.get("pols", F.lit(0))).alias("s"))


@query(SAMPLES + """, w AS (SELECT file, t // 2 AS t, (c - 1) // 4 AS c, CAST(x[c] AS DOUBLE) AS v FROM r, range(1, 65) k(c)), b AS (SELECT file, t, c, sum(v) / 4 AS v FROM w GROUP BY ALL HAVING count(*) = 8)
SELECT file, t, c, round(v, 5) + 0.0 AS value FROM b""")
def image_bins(spark, sf_dir):
    """Written as FITS images, read in tasks with two samples and four channels in a bin."""
    files = export.write_files(samples(spark, sf_dir), folder(spark), "image", dt=DT, freq=FREQ0, step=STEP)
    read = scan.scan(files, time_rate=2, freq_rate=4, samples=30)
    return read.select(stem().alias("file"), "t", F.posexplode(F.get("pols", F.lit(0))).alias("c", "v")).select("file", "t", F.col("c").cast("bigint").alias("c"), (F.round("v", 5) + F.lit(0.0)).alias("value"))


@query(SAMPLES + " SELECT file, t AS idx, CAST(len(x) AS BIGINT) AS n, s FROM r JOIN s USING (file, t)")
def array_files(spark, sf_dir):
    """Written as array files and read in slices."""
    files = export.write_files(samples(spark, sf_dir), folder(spark), "array")
    return arrays.read_arrays(files, values=2000).select(stem().alias("file"), "idx", F.get("shape", F.lit(0)).cast("bigint").alias("n"), millionths("values").alias("s"))


def _kinds(spark, sf_dir) -> DataFrame:
    """The same recordings in three formats, in one folder each."""
    s = cut(samples(spark, sf_dir))
    made = [export.write_files(s, folder(spark), kind, 58000.25, DT, FREQ0, STEP).withColumn("format", F.lit(kind)) for kind in ("filterbank", "psrfits", "image")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(SAMPLES + """, n AS (SELECT file, count(*) AS n FROM r GROUP BY file) SELECT file, format, 64 AS nchan, 32 AS nbits, n AS nsamples, 0.001::DOUBLE AS tsamp, 1200.0::DOUBLE AS freq_low, 1593.75::DOUBLE AS freq_high, 58000.25::DOUBLE AS tstart_mjd
FROM n, (VALUES ('filterbank'), ('psrfits'), ('image')) f(format)""")
def recording_parameters(spark, sf_dir):
    """Parameters of the same recordings in three formats."""
    files = _kinds(spark, sf_dir)
    p = catalog.obs_params(files).join(files, "path")
    return p.select(stem("path").alias("file"), "format", "nchan", "nbits", "nsamples", "tsamp", "freq_low", "freq_high", "tstart_mjd")


@query(SAMPLES + """, n AS (SELECT file, count(*) AS n FROM r GROUP BY file), f(format, suffix) AS (VALUES ('filterbank', '.fil'), ('psrfits', '.fits'), ('image', '.fits'))
SELECT file, format, CASE format WHEN 'filterbank' THEN 'filterbank' ELSE 'fits' END AS kind, 0 AS errors, (n + 99) // 100 AS chunks, round(n * 0.001::DOUBLE, 6) AS seconds, CASE format WHEN 'filterbank' THEN NULL ELSE 'SIMPLE=True' END AS first_card FROM n, f""")
def recordings_found(spark, sf_dir):
    """Files found, checked and planned, and the card that each FITS file begins with."""
    files = cut(_kinds(spark, sf_dir))
    root = shared_dir(spark) + "/files"
    listed = catalog.find_files(spark, root, "RUN").select(stem("path").alias("name"), F.element_at(F.split("path", "/"), -2).alias("dir"), "kind")
    mine = files.select("path", "format", "samples", stem("path").alias("name"), F.element_at(F.split("path", "/"), -2).alias("dir"))
    checks = catalog.file_checks(files).select("path", F.size("errors").alias("errors"))
    plan = catalog.reading_plan(catalog.obs_params(files), 100).select("path", "chunks", F.round("seconds", 6).alias("seconds"))
    cards = catalog.header_cards(files.withColumn("kind", F.when(F.col("format") != "filterbank", "fits"))).where("key = 'SIMPLE'").select("path", F.concat_ws("=", "key", "value").alias("first_card"))
    return mine.join(listed, ["name", "dir"]).join(checks, "path").join(plan, "path").join(cards, "path", "left").select(F.col("name").alias("file"), "format", "kind", "errors", "chunks", "seconds", "first_card")


LISTS = """WITH c AS (SELECT 'ev' || event_id AS file, user_id % 3 AS list, event_id::INT AS slice_id, round(value, 2) AS snr, value > 250 AS is_burst FROM events)"""


@query(LISTS + " SELECT file, slice_id, CASE WHEN list <> 2 THEN snr END AS snr_waterfall, CASE WHEN list <> 1 THEN is_burst END AS is_burst FROM c")
def candidate_lists(spark, sf_dir):
    """Lists with three unlike headers and two separators in one folder, each read by its own header."""
    e = table(spark, sf_dir, "events")
    word = F.when(F.col("value") > 250, "burst").otherwise("no_burst")
    cells = {"file": F.concat(F.lit("ev"), "event_id"), "slice_id": F.col("event_id"), "snr_waterfall": F.round("value", 2), "is_burst": word, "note": F.lit('"a, b"')}
    shapes = [(0, ",", ["file", "slice_id", "snr_waterfall", "is_burst"]), (1, ",", ["snr_waterfall", "note", "slice_id", "file"]), (2, ";", ["is_burst", "file", "slice_id"])]
    where = folder(spark)
    for k, sep, names in shapes:
        lines = e.where(F.col("user_id") % 3 == k).select(F.concat_ws(sep, *(cells[n].cast("string") for n in names)).alias("value"))
        head = spark.createDataFrame([(sep.join(names),)], "value string")
        # A header on top of each file of a list, as its writer's tasks make several.
        lines = lines.repartition(2).mapInArrow(_with_header(head.first()[0]), "value string")
        lines.write.text(f"{where}/list{k}")
    found = catalog.read_candidates(spark, [f"{where}/list{k}" for k, _, _ in shapes])
    return found.select("file", "slice_id", "snr_waterfall", "is_burst")


def _with_header(head: str):
    import pyarrow as pa

    def add(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    return add


@query("""WITH c AS (SELECT 'user' || user_id AS file, count(*) AS n, sum(event_id)::BIGINT AS ids, sum((event_type = 'view')::INT)::BIGINT AS views FROM events GROUP BY user_id) SELECT file, n, ids, views, n AS read_n, 1 AS runs FROM c""")
def candidate_sinks(spark, sf_dir):
    """Candidates written by file, some of them again; counters written as JSON and to a history in which a run is written twice; all read back."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("user"), "user_id").alias("file"), "event_id", "event_type")
    where = folder(spark)
    catalog.write_candidates(e, f"{where}/candidates")
    catalog.write_candidates(e.where("file < 'user5'"), f"{where}/candidates")
    read = spark.read.parquet(f"{where}/candidates")
    counts = read.groupBy("file").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_if(F.col("event_type") == "view").alias("views"))
    catalog.write_summary(counts, f"{where}/summary")
    for _ in range(2):
        catalog.append_history(counts.select("file", "n"), f"{where}/history", "first")
    told = spark.read.schema("file string, n bigint, ids bigint, views bigint").json(f"{where}/summary")
    history = spark.read.parquet(f"{where}/history").groupBy("file").agg(F.max("n").alias("read_n"), F.count("*").cast("int").alias("runs"))
    return told.join(history, "file")


@query("""SELECT user_id, count(*) AS n, max(value) AS top, count(*) AS n_json, count(*) AS n_latest FROM events GROUP BY user_id""")
def catalogue_files(spark, sf_dir):
    """A catalogue written as lists and as JSON, and a summary of two runs of which the second is the latest; all read back."""
    where = folder(spark)
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.count("*").alias("n"))
    catalog.write_catalogue(c, where, ["n", "user_id"])
    catalog.write_summary(c.limit(0), f"{where}/summary", "run1")
    catalog.write_summary(c, f"{where}/summary", "run2")
    listed = spark.read.schema("n bigint, user_id bigint, top double").option("header", True).option("enforceSchema", False).csv(f"{where}/csv")
    lines = spark.read.schema("user_id bigint, n bigint").json(f"{where}/json").select("user_id", F.col("n").alias("n_json"))
    latest = spark.read.schema("user_id bigint, n bigint").json(f"{where}/summary/latest").select("user_id", F.col("n").alias("n_latest"))
    return listed.join(lines, "user_id").join(latest, "user_id").select("user_id", "n", "top", "n_json", "n_latest")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, event_id % 11 = 0 AND event_id % 7 <> 0 AS up FROM events),
m AS (SELECT user_id, max(v) FILTER (NOT up) AS top FROM e GROUP BY user_id) SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN up THEN coalesce(top, 0.0) ELSE v END AS snr FROM e JOIN m USING (user_id)""")
def snr_without_gaps(spark, sf_dir):
    """Values that aren't numbers or are infinite, made such that they are no peaks; minus infinity is told as null."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("snr"))
    clean = signal.without_gaps(e, keys=("user_id",))
    return clean.select("event_id", F.when(F.col("snr") > F.lit(float("-inf")), F.col("snr")).alias("snr"))


@query("""SELECT 'No' || user_id || CASE WHEN event_id % 2 = 0 THEN '0' ELSE '1' END AS heading, 'run-' || event_id || '_' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '_t' || (event_id % 90) || '.5' AS name,
lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS part, (event_id % 90) + 0.5::DOUBLE AS time FROM events WHERE event_id % 5 <> 0""")
def listed_in_settings(spark, sf_dir):
    """Each user's events as a settings file with two headings, other comments, keys and items without quotes; read as lists."""
    where = folder(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 2).alias("half"))
    name = F.concat(F.lit("run-"), "event_id", F.lit("_"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit("_t"), F.col("event_id") % 90, F.lit(".5"))
    item = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("  - "), name)).otherwise(F.concat(F.lit('    - "'), name, F.lit('"  # seen')))
    halves = e.groupBy("user_id", "half").agg(F.array_join(F.sort_array(F.collect_list(item)), "\n").alias("items"))  # the events of one user
    part = F.concat(F.lit("list:\n  # No"), "user_id", "half", F.lit("\n  # a note\n"), "items")
    files = halves.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(part)), "\n").alias("value"))
    files.select("value").repartition(3).write.text(where, lineSep="\n---\n")
    lists = settings.setting_lists(settings.read_texts(spark, where))
    return lists.select("heading", "name", "part", F.explode("times").alias("time"))


@query("""WITH p AS (SELECT DISTINCT substr(text, 1 + item_id % 7, 12 + item_id % 20) AS pattern FROM benchmark UNION SELECT DISTINCT substr(text, 5, 4) FROM benchmark)
SELECT doc_id, pattern FROM documents JOIN p ON contains(text, pattern) WHERE pattern <> '' GROUP BY ALL""")
def passages_contained(spark, sf_dir):
    """Pieces of benchmark texts, short ones within long ones, that stand in documents."""
    b = table(spark, sf_dir, "benchmark")
    long_ = b.select(F.substr("text", (1 + F.col("item_id") % 7).cast("int"), (12 + F.col("item_id") % 20).cast("int")).alias("pattern"))
    return containing(table(spark, sf_dir, "documents"), long_.union(b.select(F.substring("text", 5, 4))), "doc_id", "text", "pattern")


def _stream_sql() -> str:
    over = "OVER (PARTITION BY file ORDER BY t ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
    sums = ", ".join(f"round(sum(s) {over.format(w // 2, w - 1 - w // 2)} / {w**0.5!r}::DOUBLE, 6) AS b{w}" for w in BOXCARS)
    best = "greatest(" + ", ".join(f"b{w}" for w in BOXCARS) + ")"
    return SAMPLES + f""", y AS (SELECT file, t, {sums} FROM s), f AS (SELECT file, t, {best} AS snr FROM y),
p AS (SELECT file, t, snr, lag(snr) OVER w AS b, lead(snr) OVER w AS a FROM f WINDOW w AS (PARTITION BY file, t // 32 ORDER BY t))
SELECT file, t // 32 AS chunk_id, t, round(snr, 3) AS snr FROM p WHERE snr >= 1000000 AND snr >= b AND snr >= a"""


@query(_stream_sql())
def stream_pulses(spark, sf_dir):
    """Series that land in three pieces, the last first, as a stream whose state carries chunks from batch to batch."""
    where = folder(spark)
    s = signal.integrate_spectra(samples(spark, sf_dir).select("file", "t", F.transform("spec", lambda v: F.round(v.cast("double") * 1e6).cast("bigint")).alias("spec")), keys=("file",))
    n = s.groupBy("file").agg(F.count("*").alias("n"))
    s = cut(s.join(n, "file").select("file", "t", F.col("s").cast("double").alias("s"), "n"))
    shape = "file string, t bigint, s double, n bigint"
    for k, part in enumerate(("t % 3 = 2", "t % 3 = 0", "t % 3 = 1")):
        s.where(part).coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{where}/in")
    found = carried.pulses(landing.read_landing(spark, f"{where}/in", shape, 1), 32, 1e6)
    q = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/out")
    q.awaitTermination()
    read = spark.read.schema("file string, chunk_id bigint, t bigint, snr double, width int").parquet(f"{where}/out")
    return read.select("file", "chunk_id", "t", F.round("snr", 3).alias("snr"))


@query("""WITH e AS (SELECT user_id, event_type, value, epoch_us(ts) AS us FROM events), w AS (SELECT event_type, us // 86400000000 AS day, count(*) AS n FROM e GROUP BY ALL) SELECT event_type, day, n FROM w""")
def stream_windows(spark, sf_dir):
    """Events that land as a stream, counted by day in windows of it, written in batches of which each has its own folder."""
    where = folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.repartition(3).write.parquet(f"{where}/in")
    stream = landing.read_landing(spark, f"{where}/in", e.schema, 1)
    q = landing.run_batches(stream, lambda b: landing.window_counts(b, "ts", "event_type", "1 day"), f"{where}/out", f"{where}/state")
    q.awaitTermination()
    read = spark.read.schema("event_type string, start timestamp, end timestamp, n bigint").parquet(f"{where}/out")
    return read.groupBy("event_type", F.floor(F.unix_micros("start") / 86400000000).alias("day")).agg(F.sum("n").alias("n"))
