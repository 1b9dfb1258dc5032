"""Benchmark decontamination by greedy string tiling: shared seeds, then longest non-overlapping matches by running Karp-Rabin."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.shared import OWN, cut, mix, word_hashes, words

#: Up to so many benchmark seeds are held by each worker (8 bytes and a list entry each); beyond, seeds are joined by Spark.
MAX_SEEDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class Rolling:
    """Karp-Rabin hashes of any run of tokens, from hashes of all prefixes modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        with np.errstate(over="ignore"):
            # prefix[k] = sum of tokens[i] * BASE**i for i < k; comparing runs needs both brought to one power.
            self.power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE))))
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens) * self.power[:n])))
        self.n = n

    def windows(self, length: int, top: int) -> np.ndarray:
        """Of each run of `length` tokens, as if it began at power `top`; runs of two texts compare for the same top."""
        if length > self.n:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            diff = self.prefix[length:] - self.prefix[:-length]
            k = np.arange(len(diff))
            return diff * powers(top)[top - k]

    def same(self, other: "Rolling", i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many tokens from i on equal those of other from j on, limit at most: bisection over hashes of runs."""
        low, high = np.zeros(len(i), np.int64), limit.astype(np.int64)
        held = powers(max(self.n, other.n))
        with np.errstate(over="ignore"):
            while (low < high).any():
                mid = (low + high + 1) // 2
                one, two = self.prefix[i + mid] - self.prefix[i], other.prefix[j + mid] - other.prefix[j]
                up = np.maximum(i, j)
                equal = one * held[up - i] == two * held[up - j]
                low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low


_held = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _held
    if len(_held) <= n:
        with np.errstate(over="ignore"):
            _held = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * n + 64, BASE))))
    return _held


def free_run(free: np.ndarray) -> np.ndarray:
    """For each place how many free places follow, itself included."""
    at = np.arange(len(free))
    marked = np.where(free, len(free), at)
    return np.minimum.accumulate(marked[::-1])[::-1] - at


#: Pairs of equal windows that are looked at at once.
PAIRS = 1 << 20


def matches(a: Rolling, b: Rolling, item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, s: int, top: int) -> list[tuple[int, int, int]]:
    """(-length, begin in item, begin in doc) of all matches of s unmarked tokens or more that can't be longer on either side."""
    wi, wd = a.windows(s, top), b.windows(s, top)
    if not len(wi) or not len(wd):
        return []
    run_i, run_d = free_run(free_i), free_run(free_d)
    order = np.argsort(wi, kind="stable")
    order = order[run_i[order] >= s]
    keys = wi[order]
    cand = np.nonzero(run_d[: len(wd)] >= s)[0]
    lo, hi = np.searchsorted(keys, wd[cand], "left"), np.searchsorted(keys, wd[cand], "right")
    cand, lo, hi = cand[hi > lo], lo[hi > lo], hi[hi > lo]
    out: list[tuple[int, int, int]] = []
    ends = np.cumsum(hi - lo)
    first = 0
    while first < len(cand):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        count = (hi - lo)[first:last]
        j = np.repeat(cand[first:last], count)
        i = order[np.repeat(lo[first:last] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        inner = (i > 0) & (j > 0)
        inner[inner] = free_i[i[inner] - 1] & free_d[j[inner] - 1] & (item[i[inner] - 1] == doc[j[inner] - 1])
        i, j = i[~inner], j[~inner]
        n = a.same(b, i, j, np.minimum(run_i[i], run_d[j]))
        out += zip((-n[n >= s]).tolist(), i[n >= s].tolist(), j[n >= s].tolist(), strict=True)
        first = last
    return out


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (begin in item, begin in doc, length) of greedy string tiling; no tile is shorter than `least` tokens.

    The search length starts high and halves down to `least`. At each length, Karp-Rabin hashes of unmarked runs find
    matches, which are followed to their ends; a match over twice as long as the search length raises it. Matches
    are marked from the longest, then (ties) from the first in the item and in the document; of one that is covered in
    part, the free runs of search length or more are queued again.
    """
    top = max(len(doc), len(item))
    a, b = Rolling(item), Rolling(doc)
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(len(item), 32))
    while True:
        found = matches(a, b, item, doc, free_i, free_d, s, top)
        if found and -min(found)[0] > 2 * s:
            s = -min(found)[0]
            continue
        heapq.heapify(found)
        while found and free_i.any():
            n, i, j = heapq.heappop(found)
            both = free_i[i : i - n] & free_d[j : j - n]
            if both.all():
                tiles.append((i, j, -n))
                free_i[i : i - n] = free_d[j : j - n] = False
                continue
            if not both.any():
                continue
            both = np.concatenate(([False], both, [False]))
            edge = np.nonzero(both[1:] != both[:-1])[0]
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if y - x >= s:
                    heapq.heappush(found, (x - y, i + x, j + x))
        if s == least or not free_i.any():
            return tiles
        s = max(least, s // 2)


class Index:
    """Seeds of the benchmark: sorted hashes of runs of `least` tokens, the item of each, and the items' tokens."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.items, rows = least, {}, []
        for item_id, text in items:
            h = word_hashes(words(text))
            self.items[item_id] = h
            if len(h) >= least:
                rows += [(int(x), item_id) for x in np.unique(seeds(h, least))]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.item = [r[1] for r in rows]
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, doc: np.ndarray) -> set[int]:
        h = seeds(doc, self.least)
        h = h[self.mask[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        if not len(h):
            return set()
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        return {self.item[k] for x, y in zip(lo, hi, strict=True) for k in range(x, y)}


def seeds(h: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all runs of `least` tokens, the same wherever they stand."""
    if len(h) < least:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, m = np.zeros(len(h) - least + 1, np.uint64), mix(h)
        for k in range(least):
            out = out * BASE + m[k : len(h) - least + 1 + k]
    return mix(out)


def judge(doc: np.ndarray, items: dict[int, np.ndarray], among, least: int, threshold: float) -> tuple[int | None, float, int]:
    """(item of the largest coverage, smallest id at a tie, or None; that coverage; items at the threshold or above)."""
    best, most, over = None, 0.0, 0
    for k in sorted(among):
        share = sum(n for _, _, n in tile(doc, items[k], least)) / len(items[k])
        over += share >= threshold
        if share > most:
            best, most = k, share
    return best, most, over


FOUND = OWN + "found"
RESULT = "item long, coverage double, items int"


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 5, threshold: float = 0.5, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """Adds leak_item, leak_coverage, leak_items and leaked to docs: how far each whole text covers benchmark items.

    Words are what white space separates, A-Z lower-cased. Coverage is the share of an item's words under tiles of
    `least` words or more, in whatever order the text has them, so that reordered passages count. leak_item has the
    largest coverage (the smallest id at a tie; null if no run of `least` words is shared), leak_items counts items
    with `threshold` or more, leaked says whether there is one. Items that are null, have a null id or fewer than
    `least` words never match; items with the same id count as one, the smallest text. Null and empty texts have
    coverage 0. Repeated rows and extra columns stay; columns with the new names are replaced.

    If the benchmark has at most max_seeds seeds (counted first), they go to every worker and documents are judged
    where they are, without a shuffle. Beyond, seeds of both sides are joined by Spark; see joined().
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null")
    items = items.groupBy("item").agg(F.min("item_text").alias("item_text"))
    count = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if count <= 2 * max_seeds:  # a word and its space are two characters at least
        index = spark.sparkContext.broadcast(Index([(r.item, r.item_text) for r in items.collect()], least))

        @F.pandas_udf(RESULT)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            held = index.value
            for texts in batches:
                out = []
                for t in texts:
                    h = word_hashes(words(t))
                    out.append(judge(h, held.items, held.candidates(h), least, threshold))
                yield frame(out)

        judged = docs.withColumn(FOUND, found(text))
    else:
        judged = joined(docs, items, text, least, threshold)
    share = F.coalesce(F.col(FOUND + ".coverage"), F.lit(0.0))
    over = F.coalesce(F.col(FOUND + ".items"), F.lit(0))
    return judged.withColumns({"leak_item": F.col(FOUND + ".item"), "leak_coverage": share, "leak_items": over, "leaked": over > 0}).drop(FOUND)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["item", "coverage", "items"])
    return out.astype({"item": "Int64", "coverage": "float64", "items": "int32"})


def joined(docs: DataFrame, items: DataFrame, text: str, least: int, threshold: float) -> DataFrame:
    """The way for benchmarks of any size: texts are told by a 128-bit hash, seeds of either side meet in a shuffled join,
    whose hot seeds Spark can split; then each text comes once to all of its items, which follow it one by one."""
    key = OWN + "key"
    own = docs.withColumn(key, F.concat(F.hex(F.xxhash64(F.lit(1), F.col(text))), F.hex(F.xxhash64(F.lit(2), F.col(text)))))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [np.unique(seeds(word_hashes(words(t)), least)).view(np.int64) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"].repeat([len(x) for x in h]).to_numpy(), "seed": np.concatenate([*h, np.empty(0, np.int64)])})

    texts = own.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").dropDuplicates(["k"])
    left = texts.mapInPandas(explode, "k string, seed long").withColumnRenamed("k", "key")
    right = items.select(F.col("item").alias("k"), F.col("item_text").alias("t")).mapInPandas(explode, "k long, seed long").withColumnRenamed("k", "item")
    pairs = cut(left.join(right, "seed").select("key", "item").distinct())
    wanted = pairs.join(items, "item").select("key", F.lit(1).alias("nth"), "item", F.col("item_text").alias("t"))
    asked = texts.withColumnRenamed("k", "key").join(pairs.select("key").distinct(), "key", "left_semi").select("key", F.lit(0).alias("nth"), F.lit(None).cast("long").alias("item"), "t")

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, doc = None, None
        for b in batches:
            rows = []
            for k, n, item, t in zip(b["key"], b["nth"], b["item"], b["t"], strict=True):
                h = word_hashes(words(t))
                if not n:
                    at, doc = k, h
                elif k == at:
                    rows.append((k, int(item), sum(x for _, _, x in tile(doc, h, least)) / len(h)))
            yield pd.DataFrame(rows, columns=["key", "item", "coverage"]).astype({"item": "int64", "coverage": "float64"})

    shares = asked.union(wanted).repartition("key").sortWithinPartitions("key", "nth", "item").mapInPandas(share, "key string, item long, coverage double")
    best = shares.groupBy("key").agg(F.max("coverage").alias("coverage"), F.max_by("item", F.struct("coverage", -F.col("item"))).alias("item"), F.count_if(F.col("coverage") >= threshold).cast("int").alias("items"))
    best = cut(best.select(F.col("key").alias(OWN + "text"), F.struct("item", "coverage", "items").alias(FOUND)))
    return own.join(best, F.col(key) == F.col(OWN + "text"), "left").drop(key, OWN + "text")
