"""Files found, their parameters and header cards, as tables; candidate lists in; candidate tables out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.functions.columns import priority_order
from burstlake.operators.containment import containing
from burstlake.sources.recordings import cards, file_kind, filterbank_header, image_layout, open_path, plain_fits, psrfits_layout, start_mjd
from burstlake.staging import cut

#: The columns of a candidate table, in order, with their kinds; and the digits of the text form.
CANDIDATE_COLUMNS = (
    "file string, chunk_id int, slice_id int, band_id int, detection_prob double, `dm_pc_cm-3` double, t_sec_dm_time double, t_sec_waterfall double, t_sample bigint, "
    "mjd_utc double, mjd_bary_utc double, mjd_bary_tdb double, mjd_bary_utc_inf double, mjd_bary_tdb_inf double, x1 int, y1 int, x2 int, y2 int, "
    "snr_waterfall double, snr_patch_dedispersed double, snr_waterfall_linear double, snr_patch_dedispersed_linear double, width_ms double, "
    "class_prob_intensity double, is_burst_intensity boolean, class_prob_linear double, is_burst_linear boolean, is_burst boolean, patch_file string"
)
DIGITS = {"detection_prob": 3, "dm_pc_cm-3": 2, "t_sec_dm_time": 6, "t_sec_waterfall": 6, "width_ms": 3, "class_prob_intensity": 3, "class_prob_linear": 3}
DIGITS |= dict.fromkeys(("mjd_utc", "mjd_bary_utc", "mjd_bary_tdb", "mjd_bary_utc_inf", "mjd_bary_tdb_inf"), 12)
DIGITS |= dict.fromkeys(("snr_waterfall", "snr_patch_dedispersed", "snr_waterfall_linear", "snr_patch_dedispersed_linear"), 2)


def find_files(spark: SparkSession, folder: str, target: str = "") -> DataFrame:
    """(path, name, length, kind) of recordings under a folder whose name holds target, whatever the case. Contents aren't read; empty files aren't listed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower(name).endswith(".fil"), "filterbank").when(F.lower(name).endswith(".fits"), "fits")
    return f.select("path", name.alias("name"), "length", kind.alias("kind")).where(F.col("kind").isNotNull() & F.lower("name").contains(target.lower()))


def file_checks(files: DataFrame, large: int = 10 << 30) -> DataFrame:
    """(path, length, errors, warnings) of the paths of a table: what is missing, no file, of neither format or empty; what is larger than a size in bytes."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stats = [fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p) for p in b["path"]]
            info = [store.get_file_info(inner) for store, inner in stats]
            yield pd.DataFrame({"path": b["path"], "what": [i.type.name for i in info], "length": pd.array([i.size for i in info], "Int64")})

    f = files.where("path is not null").select("path").mapInPandas(look, "path string, what string, length long")
    error = F.when(F.col("what") == "NotFound", "missing").when(F.col("what") != "File", "not a file").when(~F.lower("path").rlike("[.](fil|fits)$"), "unsupported").when(F.col("length") == 0, "empty")
    return f.select("path", "length", F.array_compact(F.array(error)).alias("errors"), F.array_compact(F.array(F.when(F.col("length") > large, "large"))).alias("warnings"))


def reading_plan(params: DataFrame, chunk: int) -> DataFrame:
    """Chunks and seconds of each recording of obs_params(), and notes on its size; nulls where the parameters are null.

    Fixed values: many samples are more than 10 million in FITS and 50 million in filterbank files; a recording is short
    under 1 million samples and very long over 100 million.
    """
    n = F.col("nsamples")
    many = n > F.when(F.lower("path").endswith(".fits"), 10_000_000).otherwise(50_000_000)
    notes = F.array(F.when(many, "many samples"), F.when(n < 1_000_000, "short recording"), F.when(n > 100_000_000, "very long recording"))
    return params.select("path", F.ceil(n / chunk).alias("chunks"), (n * F.col("tsamp")).alias("seconds"), F.array_compact(notes).alias("notes"))


def outputs_of(recordings: DataFrame, results: DataFrame, validation: str, legacy: str) -> DataFrame:
    """(file, output, rank): result files under two folders that have a recording's name, without its suffix, in their own or their directories' names.

    Rank 0 stands right in the validation folder, 1 in directories under it, 2 in the legacy folder; a recording without
    results has one row with nulls. Recordings given twice count once; results elsewhere and null paths are left out.
    Each distinct name of a result's path is searched once for all recordings' names, so that no result meets each recording.
    """
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "(?i)[.](fil|fits)$", "")
    known = recordings.where("path is not null").select(F.col("path").alias("file"), base.alias("stem")).where("stem != ''").distinct()
    inside = lambda folder: F.col("path").startswith(folder.rstrip("/") + "/")
    rest = F.when(inside(validation), F.substring("path", len(validation.rstrip("/")) + 2, 1 << 20)).when(inside(legacy), F.substring("path", len(legacy.rstrip("/")) + 2, 1 << 20))
    rank = F.when(~inside(validation), 2).when(rest.contains("/"), 1).otherwise(0)
    there = results.where("path is not null").select(F.col("path").alias("output"), rest.alias("rest"), rank.alias("rank")).where("rest is not null").distinct()
    names = there.select("output", "rank", F.explode(F.split("rest", "/")).alias("name"))
    held = containing(names.select("name").distinct().withColumn("text", F.col("name")), known, "name", "text", "stem")
    parts = names.join(held, "name").select("output", "rank", "stem").distinct()
    return known.join(parts, "stem", "left").select("file", "output", "rank")


def first_output(outputs: DataFrame) -> DataFrame:
    """(file, output): of each recording the result of the lowest rank, the first by name among several."""
    return outputs.groupBy("file").agg(F.min_by("output", F.struct("rank", "output")).alias("output"))


PARAMS = "path string, nchan int, npol int, nbits int, nsamples long, tsamp double, freq_low double, freq_high double, tstart_mjd double, tstart_mjd_corr double, pol_type string, error string"


def obs_params(files: DataFrame) -> DataFrame:
    """One row of parameters for each file; one that can't be read has its error and nulls.

    FITS files without SUBINT have the frequencies of their axis named FREQ, and nulls for what their header doesn't tell.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(p) for p in b["path"]], columns=[c.split()[0] for c in PARAMS.split(", ")]).astype({c: "Int64" for c in ("nchan", "npol", "nbits", "nsamples")})

    def one(path: str) -> tuple:
        try:
            with open_path(path) as f:
                if file_kind(path) == "filterbank":
                    h = filterbank_header(f)
                    ends = sorted((h["fch1"], h["fch1"] + h["foff"] * (h["nchans"] - 1)))
                    return (path, h["nchans"], h["nifs"], h["nbits"], h["nsamples"], h["tsamp"], *ends, h.get("tstart"), h.get("tstart"), None, None)
                try:
                    lay = psrfits_layout(f)
                except ValueError:
                    return plain(path, f)
                p, s = lay["primary"], lay["sub"]
                at, form, n = lay["columns"]["DAT_FREQ"]
                freq = np.frombuffer(f.read_at(n * (8 if form == "D" else 4), lay["body"] + at), ">f8" if form == "D" else ">f4")
                return (path, s["NCHAN"], s["NPOL"], s["NBITS"], s["NSBLK"] * lay["rows"], s["TBIN"], float(freq.min()), float(freq.max()), *start_mjd(p, s), s.get("POL_TYPE"), None)
        except (OSError, ValueError, KeyError) as e:
            return (path, *[None] * 10, f"{type(e).__name__}: {e}")

    def plain(path: str, f) -> tuple:
        head, freq = plain_fits(f)
        if head.get("XTENSION", "IMAGE").strip() == "IMAGE":
            lay = image_layout(f)
            k = (lay["time"] or 0) + 1
            pols = {"NPOL": lay["axes"][lay["pol"]]} if lay["pol"] is not None else {}
            samples, head = lay["nsamples"], {**pols, "NBITS": abs(head["BITPIX"]), "TBIN": head.get("TBIN", head.get(f"CDELT{k}")), **head}
        else:
            samples = head["NAXIS2"] * head.get("NSBLK", 1) if "NAXIS2" in head else None
        return (path, head.get("NCHAN", len(freq)), head.get("NPOL"), head.get("NBITS"), samples, head.get("TBIN"), float(freq.min()), float(freq.max()), *start_mjd(cards(f, 0)[0], head), head.get("POL_TYPE"), None)

    return files.select("path").mapInPandas(read, PARAMS)


def header_cards(files: DataFrame) -> DataFrame:
    """(path, key, value, error) of the primary header of each FITS file; one that can't be read has one row, with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for p in b["path"]:
                try:
                    with open_path(p) as f:
                        rows += [(p, k, str(v), None) for k, v in cards(f, 0)[0].items()]
                except (OSError, ValueError, KeyError) as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "key", "value", "error"], dtype=object)

    return files.where("kind = 'fits'").select("path").mapInPandas(read, "path string, key string, value string, error string")


def read_candidates(spark: SparkSession, path: str | list[str], separators: tuple[str, ...] = (",", ";", "\t")) -> DataFrame:
    """Candidate lists in text, of a path, several or a folder, in one plan whatever their number, each by its own header.

    A list's columns are found by the names in its first line that isn't blank, in whatever order and with or without
    quotes; of the separators the one that this line has most of holds for the list. Absent columns are null, others are
    left out. Both vocabularies of burst flags are read; cells that don't fit their column are null; files that can't be
    read are skipped; a list of its header alone gives no row, and neither do lines that repeat the header.
    """
    flags = ("is_burst_intensity", "is_burst_linear", "is_burst")
    place = F.col("_metadata.file_path")
    lines = spark.read.option("ignoreCorruptFiles", True).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), place.alias("list"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).where("trim(line) != ''")
    # Only the first block of each list is looked through, and only its first line leaves the task.
    first = lines.where("start = 0").groupBy("list").agg(F.min_by("line", "row").alias("header"))
    count = F.array(*(F.struct(F.size(F.split("header", f"[{s}]")).alias("n"), F.lit(-k).alias("k")) for k, s in enumerate(separators)))
    first = first.withColumn("sep", -F.array_max(count)["k"])
    parts = [F.split("header", f"[{s}]") for s in separators]
    known = F.coalesce(*(F.when(F.col("sep") == k, x) for k, x in enumerate(parts)))
    first = first.withColumn("known", F.transform(known, lambda c: F.lower(F.trim(F.translate(c, '"\'', "")))))
    widest = first.agg(F.max(F.size("known"))).first()[0] or 1
    cells = [F.from_csv("line", ", ".join(f"c{k} string" for k in range(widest)), {"sep": s}) for s in separators]
    row = F.coalesce(*(F.when(F.col("sep") == k, F.array(*(x[f"c{j}"] for j in range(widest)))) for k, x in enumerate(cells)))
    raw = lines.join(first, "list").where("line != header").select("known", row.alias("cells"))
    yes = lambda c: F.lower(F.trim(c)).isin("burst", "true", "1", "yes", "1.000")
    cols = []
    for name, kind in (c.strip().rsplit(" ", 1) for c in CANDIDATE_COLUMNS.split(", ")):
        name = name.strip("`")
        cell = F.get("cells", (F.array_position("known", name) - 1).cast("int"))
        cols.append((F.when(F.trim(cell) != "", yes(cell)) if name in flags else F.trim(cell).alias("cell").try_cast(kind)).alias(name))
    return raw.select(*cols)


def read_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Candidate lists of paths of which some may be absent; those are left out, none is an empty table."""
    fs_of = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [p for p in dict.fromkeys(paths) if fs_of(q := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)).exists(q)]
    return read_candidates(spark, there) if there else spark.createDataFrame([], CANDIDATE_COLUMNS)


def as_text(df: DataFrame) -> DataFrame:
    """The text form of a candidate table: fixed digits, burst / no_burst, nothing for null."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if name in DIGITS:
            return F.format_string(f"%.{DIGITS[name]}f", c)
        return F.when(c, "burst").when(~c, "no_burst") if kind == "boolean" else c.cast("string")

    return df.select(*(cell(n, k).alias(n) for n, k in df.dtypes))


#: Folders of a candidate table, whatever the number of its files: a folder for each would be a file or more for each.
BUCKETS = 64


def write_candidates(df: DataFrame, path: str) -> None:
    """A table of which a rerun replaces only the files it has rows for, in folders `file_bucket`, each with the rows of many files, sorted by file.

    A rerun writes the folders of its files again, with what they hold of others; so one writer at a time.
    """
    spark = df.sparkSession
    rows = df.withColumn("file_bucket", F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int"))
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(there) and any(x.isDirectory() for x in store.listStatus(there)):
        rows = cut(rows)
        mine = [r[0] for r in rows.select("file_bucket").distinct().collect()]  # BUCKETS rows at most
        old = spark.read.option("mergeSchema", True).parquet(path).where(F.col("file_bucket").isin(mine))
        again = rows.select(F.col("file").alias("file_again")).distinct()
        kept = old.join(again, F.col("file").eqNullSafe(F.col("file_again")), "left_anti")
        rows = rows.unionByName(cut(kept), allowMissingColumns=True)
    # Rebalanced: a large folder is written by several tasks, each with rows of few folders.
    ordered = rows.hint("rebalance", "file_bucket").sortWithinPartitions("file_bucket", "file")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_bucket").parquet(path)


def write_summary(counts: DataFrame, path: str, run: str | None = None) -> None:
    """Counters as JSON lines, one for each file and one for all; with the name of a run in a folder of that name, and in `latest` as well."""
    lines = counts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    for where in [path] if run is None else [f"{path}/{run}", f"{path}/latest"]:
        lines.write.mode("overwrite").text(where)


def write_catalogue(files: DataFrame, path: str, first: list[str]) -> None:
    """The catalogue of files as text lists with a header and as JSON lines, columns of `first` in front, sorted by them."""
    ordered = priority_order(files, first).sort(*[c for c in first if c in files.columns])
    ordered.write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/csv")
    ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")


def append_history(counts: DataFrame, path: str, run_id: str) -> None:
    """Counters of one run, added to a table with a folder for each run; writing a run again replaces it and no other.

    run_id and run_at (when it was written) are added, in place of columns of those names.
    """
    row = counts.drop("run_id", "run_at").withColumn("run_at", F.current_timestamp()).withColumn("run_id", F.lit(run_id))
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
