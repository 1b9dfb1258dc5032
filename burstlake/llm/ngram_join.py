"""N-gram Jaccard join: a grouped prefix join over shingle sets, whose links are verified exactly.

Every text is a set of shingle hashes. In one global order of shingles, two sets that are similar enough share one of
the first few (their prefixes). Documents with the same prefix and size form one group. Groups meet in the posting
lists of prefix shingles, where pairs of groups are filtered by their sizes, by the places of the shared shingle, and by
parities that bound how much two sets differ. Only groups that are left are expanded to their members, and these are
verified on the whole sets.

What is wanted is the components of the links. So no step gives pairs of what it compares: groups are first compared
with one pivot of each posting list, a number of pairs that grows with the list and not with its square. Lists
that hold several components then meet block by block in a kernel that gives the groups of each connected case, one row for
each; cases meet block by block in another one that gives a forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstlake.llm.shared import OWN, components, cut, forest, runs, shingle_hashes, starts, with_ids, without_ids, word_hashes, words

#: At most so many frequent shingles are held by each worker (16 bytes each); shingles in fewer texts than the least don't count as frequent.
MAX_FREQUENT, LEAST_FREQUENT, CHUNK = 1_000_000, 24, 2_000_000
#: Posting lists of frequent shingles are split in parts of about so many rows.
HOT_ROWS = 20_000
#: Rows of a block in which groups meet; rows and shingles of a block in which members are verified.
BLOCK_ROWS, VERIFY_ROWS, VERIFY_SHINGLES = 1024, 256, 400_000
#: Bits of the least parity, see parity().
PARITY = 512


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted set of shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(words(text)), width))


def frequent_shingles(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles, the place of each in the order of their counts, and the counts.

    Lossy counting: every task counts the shingles of its texts exactly in chunks, and lets go of those that only one
    text of the chunk has. The counts of the rest are summed over all texts. The list only sets the order of shingles
    (rare before frequent) and how many parts a posting list has; whatever it holds, the join finds the same links. If
    more than MAX_FREQUENT are frequent, a higher count is asked for, which a histogram of counts tells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c > 1
            return pa.record_batch({"h": h[keep].view(np.int64), "c": c[keep].astype(np.int64)})

        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), width)
                held.append(s)
                n += len(s)
                if n >= CHUNK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    found = cut(docs.select(text).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_FREQUENT))
    step = F.floor(F.log2("c") * 16).cast("int")
    least, total = None, 0
    for r in found.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 16 rows for each doubling of a count
        total += r["count"]
        if total > MAX_FREQUENT:
            break
        least = r.step
    top = found.where(step >= least).toPandas() if least is not None else found.limit(0).toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    by = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(1, len(h) + 1)
    return h[by], rank[by], c[by]


def prefix(s: np.ndarray, frequent: tuple, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in the global order: infrequent ones by hash, then frequent ones by count."""
    n = len(s)
    size = n - -(-num * n // den) + 1
    h, rank = frequent[:2]
    if not len(h):
        return s[:size]
    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
    place = np.where(h[at] == s, rank[at], 0)
    return s[np.lexsort((s, place))[:size]]


def parity(s: np.ndarray) -> bytes:
    """Bits that tell whether the set has an odd number of shingles with that hash remainder: PARITY of them, and twice
    as many until they are as many as the set's shingles. Bits that differ between two sets are never more than the shingles
    that only one of them has."""
    bits = PARITY
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities over a shorter range of remainders, which divides the longer one."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def differ(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def need(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of linked sets with n and m shingles."""
    return -(-num * (n + m) // (den + num))


def could_meet(n, p, m, q, num: int, den: int):
    """Whether sets with n and m shingles can link if the first shingle that they share stands at p in one and at q in the other.

    For numbers, arrays and columns alike. Where an earlier shingle is shared as well, the pair is decided there.
    """
    rest, other = n - p, m - q
    return ((den + num) * rest >= num * (n + m)) & ((den + num) * other >= num * (n + m)) & (den * n >= num * m) & (den * m >= num * n)


def words64(odd: list[bytes]) -> np.ndarray:
    """Parities folded to PARITY bits, one row of 64-bit words for each."""
    return np.stack([fold(np.frombuffer(x, np.uint64), PARITY // 64) for x in odd])


def survivors(a: np.ndarray, b: np.ndarray, odd_a: list[bytes], odd_b: list[bytes], limit: np.ndarray) -> np.ndarray:
    """Of pairs of rows (a[k], b[k]), which have parities that differ in at most limit[k] bits."""
    out = np.zeros(len(a), bool)
    x, y = words64(odd_a), words64(odd_b)
    for k in range(0, len(a), 1 << 16):
        at = slice(k, k + (1 << 16))
        out[at] = np.bitwise_count(x[a[at]] ^ y[b[at]]).sum(1, dtype=np.int64) <= limit[at]
    for k in np.flatnonzero(out).tolist():  # folded parities of large sets tell little
        if min(len(odd_a[a[k]]), len(odd_b[b[k]])) * 8 > PARITY:
            out[k] = differ(odd_a[a[k]], odd_b[b[k]]) <= limit[k]
    return out


def meeting(table: pa.Table, num: int, den: int) -> tuple[list[int], list[int]]:
    """(cases, leaders) of one pair of blocks of a posting list: each connected case of group pairs that no filter rules out.

    Rows of side 0 meet those of side 1. c is a group's component, loose says that members lie in others as well.
    """
    side = table.column("side").to_numpy()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(one) or not len(two):
        return [], []
    node, n, p, c, r = (table.column(k).to_numpy() for k in ("node", "n", "pos", "c", "radius"))
    loose = table.column("loose").to_numpy(zero_copy_only=False)
    ok = could_meet(n[one][:, None], p[one][:, None], n[two][None, :], p[two][None, :], num, den)
    ok &= (c[one][:, None] != c[two][None, :]) | loose[one][:, None] | loose[two][None, :]
    ok &= node[one][:, None] != node[two][None, :]
    i, j = np.nonzero(ok)
    if not len(i):
        return [], []
    odd = table.column("odd").to_pylist()
    limit = (n[one][i] + n[two][j]) * (den - num) // (den + num) + r[one][i] + r[two][j]
    keep = survivors(i, j, [odd[k] for k in one], [odd[k] for k in two], limit)
    u, v = node[one][i[keep]], node[two][j[keep]]
    if not len(u):
        return [], []
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[at[: len(u)], at[len(u) :]] = linked[at[len(u) :], at[: len(u)]] = True
    root = forest(linked)
    cases, leaders = [], []
    for k in np.unique(root):
        own = ids[root == k]
        cases += [xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)] * len(own)
        leaders += own.tolist()
    return cases, leaders


def links_of(node: list[int], c: list[int], own: list[int], cross: bool, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the links among rows of one block or, if cross, between rows that differ in own: pairs of nodes.

    Pairs that are connected already, by their components c or by links that were found, aren't looked at.
    """
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    size = np.array([len(s) for s in sets])
    apart = np.triu(np.array(c)[:, None] != np.array(c)[None, :], 1)
    apart &= (den * np.minimum.outer(size, size) >= num * np.maximum.outer(size, size)) & (size > 0)[:, None] & (size > 0)[None, :]
    if cross:
        apart &= np.array(own)[:, None] != np.array(own)[None, :]
    i, j = np.nonzero(apart)
    if len(i):
        odd = [parity(s) for s in sets]
        keep = survivors(i, j, odd, odd, (size[i] + size[j]) * (den - num) // (den + num))
        i, j = i[keep], j[keep]
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(c[x]), find(c[y])
        if a != b and linked(sets[x], sets[y], num, den):
            top[a] = b
            out.append((node[x], node[y]))
    return out


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of docs.

    Words are what white space separates, A-Z lower-cased. A document's set holds its distinct shingles of `width`
    words; with fewer words, the whole sequence is the one shingle; without words or with a null text the set is empty
    and links with nothing. Two documents link if den * intersection >= num * union. component_id is the smallest id
    reachable by links, the document's own included. class_id is the smallest id of a
    document with an equal set. Rows with
    the same id are one document, which links if any of its texts does. A null id links with nothing and has a null
    component. Extra columns are left out; an empty table gives none.

    Links aren't counted: that would ask for each pair of a hot group, of which components need a few.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(base, "text", width))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, key, first, group, odd = [], [], [], [], []
                for t in part.column("text"):
                    s = shingles(t.as_py(), width)
                    n.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    p = prefix(s, frequent.value, num, den).tobytes() if len(s) else None
                    first.append(p)
                    odd.append(parity(s) if len(s) else None)
                    group.append(None if p is None else xxhash.xxh3_128_digest(len(s).to_bytes(8, "little") + p))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "group_key": pa.array(group, pa.binary()), "prefix": pa.array(first, pa.binary()), "odd": pa.array(odd, pa.binary())})

    rows = cut(base.mapInArrow(sets, "doc_id long, n long, key binary, group_key binary, prefix binary, odd binary"))
    usable = rows.where("key is not null and doc_id is not null")
    # One document stands for all with an equal set: they are found, and need no comparison.
    classes = cut(usable.groupBy("key").agg(F.min("doc_id").alias("node")))
    reps = usable.select("key", F.col("doc_id").alias("node"), "n", "group_key").join(classes, ["key", "node"]).select("node", "n", "group_key").distinct()
    per_group = reps.groupBy("group_key").agg(F.min("node").alias("leader"), F.count("*").alias("rows"))
    members = cut(reps.join(per_group.where("rows > 1"), "group_key").select("leader", "node", "n").distinct())
    signs = usable.select(F.col("doc_id").alias("node"), "n", "odd").dropDuplicates(["node", "n", "odd"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value[2] > HOT_ROWS
        hash_, count = frequent.value[0][hot].view(np.int64), frequent.value[2][hot]
        by = np.argsort(hash_)
        hash_, parts = hash_[by], -(-count[by] // HOT_ROWS)
        for b in batches:
            tokens = [np.frombuffer(p.as_py(), np.int64) for p in b.column("prefix")]
            size = [len(t) for t in tokens]
            token = np.concatenate([*tokens, np.empty(0, np.int64)])
            node = np.repeat(b.column("node").to_numpy(), size)
            part = np.full(len(token), -1, np.int32)
            if len(hash_) and len(token):
                at = np.minimum(np.searchsorted(hash_, token), len(hash_) - 1)
                part = np.where(hash_[at] == token, np.abs(node * 0x9E3779B1 % 2147483647) % parts[at], -1).astype(np.int32)
            place = np.concatenate([*map(np.arange, size), np.empty(0, np.int64)]).astype(np.int32)
            yield pa.record_batch({"token": pa.array(token), "part": pa.array(part), "node": pa.array(node), "n": pa.array(np.repeat(b.column("n").to_numpy(), size).astype(np.int32)), "pos": pa.array(place)})

    # Rows of a list are in a seeded order, those that any set of equal size could meet first: the list's first row is its pivot.
    group = usable.groupBy("group_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posting = group.select("node", "n", "prefix").mapInArrow(explode, "token long, part int, node long, n int, pos int")
    late = ~could_meet(F.col("n").cast("long"), F.col("pos"), F.col("n").cast("long"), F.col("pos"), num, den)
    ordered = posting.repartition("token", "part").sortWithinPartitions("token", "part", late, F.xxhash64("node"), "node", "n")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists with several rows, of which two can meet; each row with its list's pivot."""
        for t in runs(batches, ["token", "part"]):
            first = np.flatnonzero(starts(t, ["token", "part"]))
            size = np.diff(np.append(first, t.num_rows))
            n, pos, part = (t.column(k).to_numpy() for k in ("n", "pos", "part"))
            early = could_meet(n[first].astype(np.int64), pos[first], n[first].astype(np.int64), pos[first], num, den)
            keep = (part[first] >= 0) | ((size > 1) & early)
            at = np.repeat(first, size)[np.repeat(keep, size)]
            own = t.filter(pa.array(np.repeat(keep, size))).combine_chunks()
            for b in own.to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(t.column(k).to_numpy()[at]) for k in ("node", "n", "pos"))], [*b.schema.names, "pivot", "pivot_n", "pivot_pos"])

    index = cut(ordered.mapInArrow(lists, "token long, part int, node long, n int, pos int, pivot long, pivot_n int, pivot_pos int"))

    def sieve(pairs: DataFrame) -> DataFrame:
        """Of pairs (u, v) of nodes, those whose parities allow a link."""

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, m = b.column("n_u").to_numpy(), b.column("n_v").to_numpy()
                apart = np.array([differ(x.as_py(), y.as_py()) for x, y in zip(b.column("odd_u"), b.column("odd_v"), strict=True)], np.int64)
                yield b.select(["u", "v"]).filter(pa.array(apart * (den + num) <= (n + m) * (den - num)))

        for x in ("u", "v"):
            pairs = pairs.join(signs.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")), x)
        return pairs.mapInArrow(keep, "u long, v long").distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch({"node": b.column("node"), "text": pa.array([tool.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")], pa.binary())})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for t in runs(batches, ["case", "part"], rows=2000):
            first = np.flatnonzero(starts(t, ["case", "part"]))
            found = []
            for a, z in zip(first, np.append(first[1:], t.num_rows), strict=True):
                x = t.slice(a, z - a)
                held = [shingles(tool.decompress(b.as_py()).decode("utf-8", "surrogatepass"), width) for b in x.column("text")]
                found += links_of(x.column("node").to_pylist(), x.column("c").to_pylist(), x.column("own").to_pylist(), x.column("crossed")[0].as_py(), held, num, den)
            yield pa.record_batch({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    def verify(blocks: DataFrame) -> DataFrame:
        """(u, v): links among the nodes of each (case, part), a forest of them. blocks: (case, part, crossed, own, node, c)."""
        # Texts travel to their blocks, and so are packed by zstandard before they do.
        needed = with_ids(base.withColumnRenamed("doc_id", "node"), "node", blocks.select("node"))
        texts = needed.mapInArrow(pack, "node long, text binary")
        met = blocks.join(texts, "node").select("case", "part", "crossed", "own", "node", "c", "text")
        return cut(met.repartition("case", "part").sortWithinPartitions("case", "part").mapInArrow(check, "u long, v long"))

    # Groups with their lists' pivots, pivots of a split list with one of them, and members with their group's leader.
    fits = could_meet(F.col("n").cast("long"), F.col("pos"), F.col("pivot_n").cast("long"), F.col("pivot_pos"), num, den)
    first = index.where((F.col("node") != F.col("pivot")) & fits).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    parted = index.where("part >= 0").select("token", "pivot", "pivot_n", "pivot_pos").distinct()
    head = parted.groupBy("token").agg(F.min_by(F.struct("pivot", "pivot_n", "pivot_pos"), F.xxhash64("pivot")).alias("head"))
    met = parted.join(head, "token").select(F.col("pivot").alias("u"), "pivot_n", "pivot_pos", F.col("head.pivot").alias("v"), F.col("head.pivot_n").alias("m"), F.col("head.pivot_pos").alias("q"))
    met = met.where((F.col("u") != F.col("v")) & could_meet(F.col("pivot_n").cast("long"), F.col("pivot_pos"), F.col("m").cast("long"), F.col("q"), num, den)).select("u", "v")
    within = members.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    star = cut(sieve(first.union(met).union(within).distinct()))
    # A pivot is compared with its partners in parts, each of which holds the pivot.
    parts = star.groupBy("v").agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("parts"))
    ray = star.join(parts, "v").select(F.col("v").alias("case"), F.pmod(F.xxhash64("u"), "parts").alias("part"), F.lit(1).alias("own"), F.col("u").alias("node"))
    hub = parts.select(F.col("v").alias("case"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.lit(0).alias("own"), F.col("v").alias("node"))
    known = verify(ray.unionByName(hub).select("case", "part", F.lit(True).alias("crossed"), "own", "node", F.col("node").alias("c")))
    joined = components(known)

    # Lists that hold several components meet in full: rows outside the list's largest component with all of its rows.
    own = members.join(joined, "node", "left").join(signs, ["node", "n"]).select("leader", "node", F.coalesce("component", "node").alias("c"), "odd")
    lead = own.where("node = leader").select("leader", F.col("odd").alias("lead_odd"))
    reach = F.pandas_udf(lambda a, b: pd.Series([differ(x, y) for x, y in zip(a, b, strict=True)], dtype="int64"), "long")
    spread = own.join(lead, "leader").groupBy("leader").agg(F.max(reach("odd", "lead_odd")).alias("radius"), (F.min("c") != F.max("c")).alias("loose"))
    spread = cut(spread.select(F.col("leader").alias("node"), "radius", "loose"))
    at = index.join(joined, "node", "left").join(spread, "node", "left")
    at = at.select("token", "node", F.col("n").cast("long").alias("n"), "pos", F.coalesce("component", "node").alias("c"), F.coalesce("radius", F.lit(0)).alias("radius"), F.coalesce("loose", F.lit(False)).alias("loose"), F.col("radius").isNotNull().alias("many"), ((F.col("part") < 0) & (F.col("node") == F.col("pivot"))).alias("lead"))
    at = cut(at)
    # Single sets have met their pivot.
    each = at.groupBy("token", "c").agg(F.count("*").alias("rows"), F.count_if("loose").alias("loose_rows"), F.count_if(F.col("lead") & ~F.col("many")).alias("leads"), F.count_if("many").alias("many_rows"))
    mixed = each.groupBy("token").agg(F.sum("rows").alias("rows"), F.max_by("c", "rows").alias("major"), F.max("rows").alias("major_rows"), F.count("*").alias("kinds"), F.sum("loose_rows").alias("loose_rows"), F.sum("leads").alias("leads"), F.sum("many_rows").alias("many_rows"))
    mixed = mixed.where("(kinds > 1 or loose_rows > 0) and (rows - leads > 1 or many_rows > 0)")
    mixed = mixed.select("token", "major", F.ceil(F.greatest(F.col("rows") - F.col("major_rows") + F.col("loose_rows"), F.lit(1)) / BLOCK_ROWS).alias("few"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("all"))
    live = at.join(mixed, "token").join(signs, ["node", "n"]).select("token", "node", "n", "pos", "c", "radius", "loose", "odd", "major", "few", "all")
    left = live.where("c <> major or loose").withColumns({"side": F.lit(0), "i": F.pmod(F.xxhash64(F.lit(1), "node"), "few"), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1))})
    right = live.withColumns({"side": F.lit(1), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)), "j": F.pmod(F.xxhash64(F.lit(2), "node"), "all")})
    both = left.unionByName(right).drop("major", "few", "all")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["token", "i", "j"], rows=5000):
            first = np.flatnonzero(starts(t, ["token", "i", "j"]))
            case, leader = [], []
            for a, z in zip(first, np.append(first[1:], t.num_rows), strict=True):
                found = meeting(t.slice(a, z - a), num, den)
                case += found[0]
                leader += found[1]
            yield pa.record_batch({"case": pa.array(case, pa.int64()), "leader": pa.array(leader, pa.int64())})

    cases = both.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(meet, "case long, leader long")
    cases = cases.union(spread.where("loose").select(F.xxhash64(F.lit("group"), "node"), "node")).distinct()
    # Groups are expanded to their members.
    cases = cases.join(members.select("leader", "node"), "leader", "left").select("case", F.coalesce("node", "leader").alias("node")).distinct()
    sizes = usable.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n"))
    cases = cut(cases.join(joined, "node", "left").join(sizes, "node").select("case", "node", F.coalesce("component", "node").alias("c"), "n"))
    wide = cases.groupBy("case").agg(F.greatest(F.ceil(F.count("*") / VERIFY_ROWS), F.ceil(F.sum("n") / VERIFY_SHINGLES)).alias("wide"))
    dealt = cases.join(wide, "case").withColumn("own", F.pmod(F.xxhash64("node"), "wide").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)))
    part = F.least("own", "other") * F.col("wide") + F.greatest("own", "other")
    # Where a case has several blocks, rows of one are compared with one another in the part that it has alone.
    alone = (F.col("part") == F.col("own") * (F.col("wide") + 1)) & (F.col("own") == F.col("other"))
    dealt = dealt.withColumn("part", part).withColumn("crossed", ~alone)
    found = verify(dealt.select("case", "part", "crossed", "own", "node", "c"))
    if not found.isEmpty():
        joined = components(known.union(found))

    label = classes.join(joined, "node", "left").select("key", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(label, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without near-duplicates: of each component, the document with the smallest id stays, once.

    Rows with a null id stay. Of rows with the same id the one with the smallest text stays, nulls last. All columns stay.
    """
    found = cut(jaccard_components(docs, doc_id, text, **how).select("doc_id", "component_id"))
    kept = without_ids(docs, doc_id, found.where("doc_id <> component_id").select("doc_id"))
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    first, nth = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last(), *[c for c in docs.columns if c not in (doc_id, text)]), OWN + "nth"
    once = kept.where(F.col(doc_id).isNotNull()).withColumn(nth, F.row_number().over(first)).where(f"{nth} = 1").drop(nth)
    return once.unionByName(kept.where(F.col(doc_id).isNull()))
