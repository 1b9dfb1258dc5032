"""Helpers that the training-data operators share: written tables, words as hashes, linked components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.staging import cut, keep_until_exit, shared_dir, tidy

__all__ = ["cut", "keep_until_exit", "shared_dir", "tidy"]

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Columns that operators add to a caller's table for a while begin so; no table may have columns that do.
OWN = "burstlake__"

#: A set of ids is told by so many bits at most, which are broadcast as rows of 64 bits: 131 072 rows, whatever the table's size.
ID_BITS = 1 << 23


def mark_ids(df: DataFrame, column: str, ids: DataFrame, out: str) -> DataFrame:
    """Adds out to df: false where column surely isn't among the values of the one column of ids (or is null), else true.

    The bits that say so have a fixed size: where ids are many, more rows are marked that a join must then rule out,
    and no row is lost. So joins of few ids with whole texts move few texts, and joins of many ids are plain joins.
    """
    at = lambda c: F.pmod(F.xxhash64(F.lit("bits"), F.col(c).cast("long")), F.lit(ID_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(c), F.lit(64)).cast("int"))
    word = lambda c: F.floor(at(c) / 64).cast("int")
    (name,) = ids.columns
    held = ids.where(F.col(name).isNotNull()).groupBy(word(name).alias(f"{out}_word")).agg(F.bit_or(bit(name)).alias(f"{out}_bits"))
    met = df.withColumn(f"{out}_of", word(column)).join(F.broadcast(held), F.col(f"{out}_of") == F.col(f"{out}_word"), "left")
    return met.withColumn(out, F.coalesce(F.col(f"{out}_bits").bitwiseAND(bit(column)) != 0, F.lit(False)) & F.col(column).isNotNull()).drop(f"{out}_of", f"{out}_word", f"{out}_bits")


def with_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose column is among ids (one column of longs); only rows that may be are shuffled. Columns of df stay.

    The join is a shuffled one at every size, so that what is measured on small tables holds for large ones.
    """
    own = ids.toDF(OWN + "id").distinct().hint("merge")
    return mark_ids(df, column, own, OWN + "maybe").where(OWN + "maybe").drop(OWN + "maybe").join(own, F.col(column) == F.col(OWN + "id"), "left_semi")


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose column is null or not among ids; only rows that may be among them are shuffled."""
    own = ids.toDF(OWN + "id").distinct().hint("merge")
    marked = mark_ids(df, column, own, OWN + "maybe")
    rest = marked.where(OWN + "maybe").join(own, F.col(column) == F.col(OWN + "id"), "left_anti")
    return marked.where(f"not {OWN}maybe").unionByName(rest).drop(OWN + "maybe")


def runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 50_000, mb: int = 16) -> Iterator[pa.Table]:
    """Tables of a stream that is sorted by key, cut only where the key changes: about `rows` rows or `mb` megabytes, or one key's rows."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= mb << 20:
            whole = pa.Table.from_batches(held)
            at = np.flatnonzero(starts(whole, key))[-1]
            if at:
                yield whole.slice(0, at)
                held = whole.slice(at).combine_chunks().to_batches()
                n, size = whole.num_rows - at, sum(x.nbytes for x in held)
            else:
                rows, mb = max(rows, 2 * n), max(mb, (2 * size) >> 20)
    if held:
        yield pa.Table.from_batches(held)


def starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Which rows differ from the row before in any column of key (numbers)."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in key:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it reaches in a symmetric matrix of links; every row is visited once."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] >= 0:
            continue
        root[k], front = k, np.array([k])
        while len(front):
            new = linked[front].any(0) & (root < 0)
            front = np.nonzero(new)[0]
            root[front] = k
    return root


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8. bytes.split() separates at exactly the characters of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int, short: bool = True) -> np.ndarray:
    """Hashes of all runs of width words, in order. With fewer words: the whole sequence as one if short, else none."""
    n = len(h)
    if n < width:
        if not short or not n:
            return np.empty(0, np.uint64)
        width = n
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
    return mix(out)


#: An edge list of at most so many rows is finished in one task.
FINISH = 15_000


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """The connected components of an edge list of longs: (node, component), component the smallest node.

    Each round every node merges into the neighbour that comes first in an order drawn anew for the round; edges
    within a merged node vanish. A round removes a constant share of the nodes, so rounds grow with the logarithm
    of the longest path. When FINISH edges or fewer are left, one task ends the work. All state is in written
    tables. Nodes without an edge to another have no row.
    """
    links = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v")
    live = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    steps = []
    for k in range(rounds):
        if live.limit(FINISH + 1).count() <= FINISH:
            break
        both = live.union(live.select("v", "u"))
        rank = F.xxhash64(F.lit(k), "v")
        best = both.groupBy("u").agg(F.min(rank).alias("r"), F.min_by("v", rank).alias("m"))
        own = F.xxhash64(F.lit(k), "u")
        best = cut(best.select(F.col("u").alias("node"), F.when(F.col("r") < own, F.col("m")).otherwise(F.col("u")).alias("to")))
        steps.append(best)
        one, two = (best.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in ("u", "v"))
        moved = live.join(one, "u").join(two, "v").where("u_to != v_to")
        live = cut(moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = live.coalesce(1).mapInPandas(_union_find, "node long, to long")
    for best in reversed(steps):
        later = label.select(F.col("node").alias("to"), F.col("to").alias("end"))
        label = best.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    if steps:
        label = cut(label)
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    return cut(label.join(least, "to").select("node", "component"))


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for b in batches:
        for x, y in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            above.setdefault(x, x)
            above.setdefault(y, y)
            a, c = top(x), top(y)
            above[max(a, c)] = min(a, c)
    nodes = sorted(above)
    yield pd.DataFrame({"node": nodes, "to": [top(x) for x in nodes]}, dtype="int64")
