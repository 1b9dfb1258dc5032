"""Sharding by a two-pass external shuffle: scatter into buckets that fit memory, Fisher-Yates in each, write."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake.llm.shared import OWN, cut, mark_ids, shared_dir

#: A task of the second pass gets so many buckets at most, one after the other.
PART_BUCKETS = 16
#: Buckets whose rows are added up in one group.
RUN = 4096


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of n: for each place from the last, swap with one drawn from those up to it."""
    order = np.arange(n)
    drawn = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for k in range(n - 1, 0, -1):
        j = drawn[k]
        order[k], order[j] = order[j], order[k]
    return order


def shuffle_into_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20, seed: int = 11) -> DataFrame:
    """All rows of docs in a random order, dealt to shards whose counts differ by one at most (law `rows`).

    Adds size (UTF-8 bytes of the text, 8 more), text_crc32 (unsigned, of the UTF-8 text; null for null), bucket,
    shard and slot (0, 1, 2 ... in each shard), replacing columns of these names. The first pass scatters rows by a
    seeded hash of all their columns into buckets of about bucket_bytes; rows that are equal in all columns and too many
    for one bucket are numbered, and the number is hashed too. The second pass orders each bucket by Fisher-Yates,
    seeded by the bucket. Buckets one after the other give each row its place; place modulo shards is its shard. The
    result is written to the shared folder. Rows that are equal in all columns are interchangeable; all others get the
    same place in every run, however the table is partitioned. Null ids and texts are rows like others; an empty table
    gives none.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    same, copy = OWN + "same", OWN + "copy"
    # Null columns add nothing to a hash, so that which are null is hashed as well.
    hashed = [h for c in docs.columns for h in (F.to_json(c) if isinstance(docs.schema[c].dataType, T.MapType) else F.col(c), F.col(c).isNull())]
    own = docs.withColumn(same, F.xxhash64(F.lit(seed), *hashed)).withColumns({"size": size, "text_crc32": F.crc32(F.col(text).cast("binary"))})
    groups = own.groupBy(same).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = cut(groups.where(f"n > 1 and bytes > {bucket_bytes // 4}").select(same))  # rows that stand too often for one bucket
    total = own.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    # Tasks grow in number with the table, not in size: a partition gets about PART_BUCKETS buckets at most.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // PART_BUCKETS))
    marked = mark_ids(own, same, groups, OWN + "maybe")
    maybe = F.col(OWN + "maybe")
    once = marked.where(~maybe).drop(OWN + "maybe").withColumn(copy, F.lit(0).cast("long"))
    # Copies meet as one row of each task with their number, and are unfolded where they go to.
    row = F.struct(*own.columns)
    often = marked.where(maybe).select(same, F.xxhash64(F.lit(~seed), *hashed).alias(OWN + "also"), row.alias(OWN + "row")).groupBy(same, OWN + "also").agg(F.any_value(OWN + "row").alias(OWN + "row"), F.count("*").alias(OWN + "n"))
    often = often.select(OWN + "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col(OWN + "n") - 1)).alias(copy)).select(*(F.col(OWN + "row")[c].alias(c) for c in own.columns), copy)
    at = once.unionByName(often).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), same, copy), F.lit(buckets))).repartition(parts, "bucket")
    place, first = OWN + "place", OWN + "first"
    shape = T.StructType([*at.schema.fields, T.StructField(place, T.LongType())])

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (doc_id, "text_crc32", same, copy)])
        rng = np.random.default_rng([seed, table.column("bucket")[0].as_py()])
        order = fisher_yates(table.num_rows, rng)
        return table.take(pa.array(order)).append_column(place, pa.array(np.arange(table.num_rows)))

    dealt = cut(at.groupBy("bucket").applyInArrow(work, shape))
    # One row for each bucket; they are added up in runs of RUN, and the runs' sums after.
    count = cut(dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = count.groupBy("run").agg(F.sum("n").alias("n")).select("run", before.alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = cut(count.withColumn("within", within).join(runs, "run").select("bucket", (F.col("before") + F.col("within")).alias(first)))
    at = F.col(first) + F.col(place)
    out = dealt.join(begin, "bucket").withColumns({"shard": F.pmod(at, F.lit(shards)).cast("int"), "slot": F.floor(at / shards).cast("long")})
    return out.select(*[c for c in docs.columns if c not in ("size", "text_crc32", "bucket", "shard", "slot")], "size", "text_crc32", "bucket", "shard", "slot")


def write_shards(sharded: DataFrame, path: str | None = None) -> str:
    """Write one folder for each shard, its rows in order of slot; returns the path, by default in the shared folder."""
    path = path or f"{shared_dir(sharded.sparkSession)}/shards"
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return path
