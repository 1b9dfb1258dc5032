"""The trie of conversations' prefixes: sorted neighbours, their common prefixes as edges, and components merged from the deepest edge up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.shared import WORD, cut, mix

#: Turns that a task builds a forest of at a time; ids in one chunk of a node's ends; partition forests that are merged by one task.
BLOCK_TURNS, CHUNK, FAN = 200_000, 50_000, 64

NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b""


def turn_lists(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, nulls first, each as (turn, h, w).

    h is half of the SHA-256 of role and text in hexadecimal digits, w the number of words; a null role or text is an
    empty one. Equal places are ordered by h. Rows without a conv_id are left out. Texts don't leave their tasks.
    """
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    h = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 32)
    each = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), h.alias("h"), F.regexp_count(t, F.lit(WORD)).alias("w")).alias("x"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


# ---- Forests in tasks ---------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """A prefix: depth, hashes of itself and its parent, members, smallest member, words shared along its edges, leaves,
    children, words before its last turn and with it, digest of the members that end here (None: it comes from chunks).

    left: on the path of the first row, so that it may belong to a node of an earlier forest. open: on the path of the
    last row, so that rows of later forests may belong to it.
    """

    depth: int
    key: bytes
    above: bytes
    n: int
    conv: int
    shared: int
    leaves: int
    kids: int
    before: int
    words: int
    ends: str | None
    left: bool
    open: bool


class Merger:
    """Forests of neighbouring stretches of the sorted rows, one after the other, contracted to the paths of their first and last rows.

    Nodes that no further row can reach are done. What stays is bounded by the depth of two conversations.
    """

    def __init__(self):
        self.left: list[Node] | None = None
        self.path: list[Node] = []
        self.done: list[Node] = []

    def close(self, node: Node) -> None:
        node.open = False
        if not node.left:
            self.done.append(node)

    def add(self, left: list[Node], path: list[Node]) -> None:
        """left and path by depth, from 1 on; a node that is on both stands in both."""
        if self.left is None:
            self.left, self.path = left, path
            return
        common = 0
        while common < min(len(left), len(self.path)) and left[common].key == self.path[common].key:
            common += 1
        last, first = len(self.path), len(left)
        for d, (mine, theirs) in enumerate(zip(self.path[:common], left, strict=False), 1):
            mine.n += theirs.n
            mine.conv = min(mine.conv, theirs.conv)
            mine.shared += theirs.shared + left[common - 1].words
            mine.leaves += theirs.leaves - 1 + (common < last)
            mine.kids += theirs.kids - (first > d) + (common == d and first > d)
        for mine in self.path[common:]:
            self.close(mine)
        for mine, theirs in zip(self.path[:common], left, strict=False):
            if not theirs.open:
                self.close(mine)
        for theirs in left[common:]:
            theirs.left = False
            if not theirs.open:
                self.done.append(theirs)
        self.path = [self.path[d] if node.left else node for d, node in enumerate(path)]

    def spines(self) -> list[Node]:
        return [*(self.left or []), *(node for node in self.path if not node.left)]

    def finish(self) -> list[Node]:
        """All nodes that are left, when no stretch precedes or follows."""
        rest, self.left, self.path = self.spines(), None, []
        for node in rest:
            node.left = node.open = False
        return rest


def prefix_hashes(items: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """128 bits for each prefix of each row's items (two 64-bit halves of a hash each): those of its items, mixed with their places, in exclusive or."""
    at = (np.arange(len(items)) - np.repeat(begin, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        a = mix(items[:, 0] ^ mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
        b = mix(items[:, 1] + mix(at * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2)))
    run = np.bitwise_xor.accumulate(np.stack([a, b], 1), axis=0) if len(items) else np.empty((0, 2), np.uint64)
    head = np.zeros((len(begin), 2), np.uint64)
    head[begin > 0] = run[begin[begin > 0] - 1]
    return (run ^ np.repeat(head, size, axis=0)).tobytes()


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 16
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // 16


def forest(convs: list[int], seqs: list[bytes], words: list[list[int]], chunk: int = CHUNK) -> tuple[list[Node], list[Node], list[Node], list[tuple[bytes, int, str]]]:
    """(left path, last path, other nodes, chunks of ids at the borders) of rows sorted by sequence and id.

    Union-find: rows are components; edges between neighbours are taken from the deepest common prefix up. Where a
    component deeper than the edge is merged, its chain of turns down to there is done and it becomes a child of the node
    at the edge's depth.
    """
    m = len(seqs)
    size = np.array([len(s) // 16 for s in seqs])
    begin = np.cumsum(size) - size
    keys = prefix_hashes(np.frombuffer(b"".join(seqs), "<u8").reshape(-1, 2), begin, size)
    flat = np.concatenate([np.asarray(w, np.int64) for w in words])
    run = np.concatenate([[0], np.cumsum(flat)])
    upto = (run[1:] - np.repeat(run[begin], size)).tolist()  # words up to each turn, that turn included
    begin, size = begin.tolist(), size.tolist()
    lcp = [0] + [common_turns(a, b) for a, b in zip(seqs, seqs[1:], strict=False)]
    key = lambda row, d: keys[16 * (begin[row] + d - 1) : 16 * (begin[row] + d)] if d else ROOT
    till = lambda row, d: upto[begin[row] + d - 1] if d else 0

    # Equal sequences stand beside each other in order of ids: their nodes' ends. Those at either border may go on beyond it.
    ends, chunks, a = {}, [], 0
    while a < m:
        b = a + 1
        while b < m and lcp[b] == size[b] == size[a]:
            b += 1
        if a == 0 or b == m:
            ends[a] = None
            for k in range(a, b, chunk):
                chunks.append((key(a, size[a]), convs[k], ",".join(map(str, convs[k : min(b, k + chunk)]))))
        else:
            ends[a] = hashlib.sha256(",".join(map(str, convs[a:b])).encode()).hexdigest()
        a = b

    nodes: list[Node] = []
    up = list(range(m))  # union-find; a component's root is its first row
    stop = list(range(m))  # its last row
    depth, n, conv, shared, leaves, kids = list(size), [1] * m, list(convs), [0] * m, [1] * m, [0] * m

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def chain(r: int, low: int) -> None:
        """The nodes of component r with depths over low."""
        for d in range(low + 1, depth[r] + 1):
            last = d == depth[r]
            end = ends.get(r, NO_ENDS) if d == size[r] else NO_ENDS
            nodes.append(Node(d, key(r, d), key(r, d - 1), n[r], conv[r], shared[r], leaves[r], kids[r] if last else 1, till(r, d - 1), till(r, d), end, r == 0, stop[r] == m - 1))

    for k in sorted((k for k in range(1, m) if lcp[k]), key=lambda k: -lcp[k]):
        d, x, y = lcp[k], top(k - 1), top(k)
        count = leaf = 0
        for r in (x, y):
            if depth[r] > d:
                chain(r, d)
                count, leaf = count + 1, leaf + leaves[r]
            elif kids[r]:
                count, leaf = count + kids[r], leaf + leaves[r]
        up[y], stop[x], depth[x] = x, stop[y], d
        n[x] += n[y]
        conv[x] = min(conv[x], conv[y])
        shared[x] += shared[y] + till(k, d)
        kids[x], leaves[x] = count, leaf or 1
    for r in range(m):
        if up[r] == r:
            chain(r, 0)
    by_depth = lambda some: sorted(some, key=lambda x: x.depth)
    return by_depth(x for x in nodes if x.left), by_depth(x for x in nodes if x.open), [x for x in nodes if not (x.left or x.open)], chunks


FIELDS = "kind int, part long, depth long, key binary, above binary, n long, conv long, shared long, leaves long, kids long, before long, words long, ends string, on_left boolean, on_last boolean"
DONE, SPINE, CHUNK_OF_ENDS = 0, 1, 2


def node_rows(nodes: list[Node], kind: int, part: int) -> list[tuple]:
    return [(kind, part, x.depth, x.key, x.above, x.n, x.conv, x.shared, x.leaves, x.kids, x.before, x.words, x.ends, x.left, x.open) for x in nodes]


NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
KINDS = [TYPES[f.split()[1]] for f in FIELDS.split(", ")]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in KINDS], names=NAMES)


def partition_forest(block_turns: int, chunk: int):
    """(conv_id, seq, words) sorted by seq and conv_id: its finished nodes, its two paths, and ids of members that end at borders of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, part = Merger(), TaskContext.get().partitionId()
        convs, seqs, words, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            left, path, others, chunks = forest(convs, seqs, words, chunk)
            merger.add(left, path)
            others += merger.done
            merger.done = []
            return batch(node_rows(others, DONE, part) + [(CHUNK_OF_ENDS, part, None, k, None, None, first, None, None, None, None, None, text, None, None) for k, first, text in chunks])

        for b in batches:
            for c, s, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                convs.append(c)
                seqs.append(s)
                words.append(w)
                held += len(w)
                if held >= block_turns:
                    yield block()
                    convs, seqs, words, held = [], [], [], 0
        if convs:
            yield block()
        yield batch(node_rows(merger.spines(), SPINE, part))

    return work


def merge_forests(last: bool, fan: int):
    """The paths of `fan` neighbouring partitions, merged; of all there are if last, and then every node is done."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        merger = Merger()
        rows = rows.sort_values(["part", "depth"], kind="stable")
        for _, one in rows.groupby("part", sort=True):
            all_of = [Node(*r) for r in one[["depth", "key", "above", "n", "conv", "shared", "leaves", "kids", "before", "words", "ends", "on_left", "on_last"]].itertuples(index=False, name=None)]
            for x in all_of:
                x.ends = x.ends if isinstance(x.ends, str) else None
            merger.add([x for x in all_of if x.left], [x for x in all_of if x.open])
        rest = merger.finish() if last else merger.spines()
        part = int(rows["part"].iloc[0]) // fan
        return pd.DataFrame(node_rows(merger.done, DONE, part) + node_rows(rest, DONE if last else SPINE, part), columns=NAMES)

    return work


def chunks_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as chunks of the root's ends, one for each batch."""
    for b in batches:
        some = b.column(0).to_pylist()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([ROOT]), pa.array([some[0]]), pa.array([",".join(map(str, some))])], names=["key", "conv", "ends"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, conv, ends) sorted by key and conv: the digest of each key's chunks, which pass one by one."""
    key, state = None, None
    for b in batches:
        out = []
        for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b"," + text.encode())
                continue
            if state is not None:
                out.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out])], names=["key", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "digest"])


def prefix_trie(lists: DataFrame, block_turns: int = BLOCK_TURNS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each distinct prefix.

    lists: (conv_id, turns) as turn_lists() gives them, ids distinct and not null. Prefixes count as equal if 128 bits of
    hashes are. Conversations are sorted by the hashes of their turns, then by id; tasks build the forests of stretches
    and hand on the paths of their first and last rows alone, which are merged `fan` at a time until one is left. The
    ids of members that end in one node are hashed as they stand sorted, in chunks of bounded size; the chunks of one
    node pass through one task, as the digest is over all of them in order. A conversation is a row, 20 bytes a turn.
    Turnless conversations end in the root. An empty table gives no row, as the root has no member.
    """
    hashed = F.unhex(F.array_join(F.transform("turns", lambda x: x["h"]), ""))
    rows = cut(lists.select("conv_id", hashed.alias("seq"), F.transform("turns", lambda x: x["w"].cast("int")).alias("words")))
    long = rows.where(F.octet_length("seq") > 0).sort("seq", "conv_id")
    made = cut(long.mapInArrow(partition_forest(block_turns, chunk), FIELDS))
    done, spines = made.where(F.col("kind") == DONE), made.where(F.col("kind") == SPINE)
    last = spines.agg(F.max("part")).first()[0]
    while last is not None:
        final = last < fan
        step = cut(spines.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merge_forests(final, fan), FIELDS))
        done, spines = done.unionByName(step.where(F.col("kind") == DONE)), step.where(F.col("kind") == SPINE)
        last = None if final else last // fan
    saved = F.col("shared") - (F.col("n") - 1) * F.col("before")
    nodes = done.select("depth", "key", "above", F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), "ends")

    turnless = rows.where(F.octet_length("seq") == 0).select("conv_id").sort("conv_id")
    chunks = made.where(F.col("kind") == CHUNK_OF_ENDS).select("key", "conv", "ends").unionByName(turnless.mapInArrow(chunks_of_ids, "key binary, conv long, ends string"))
    digest = chunks.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(digests, "key binary, digest string")

    all_of = rows.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    below = nodes.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.nullif(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = all_of.crossJoin(F.broadcast(below)).select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("above"), "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    nodes = nodes.unionByName(root)

    # Few nodes wait for a digest, those at borders of blocks; parents are looked up by hash, the root's children get the root's one row.
    known = nodes.where(F.col("ends").isNotNull())
    waiting = nodes.where(F.col("ends").isNull()).drop("ends").join(digest, "key", "left").withColumn("ends", F.coalesce("digest", F.lit(NO_ENDS))).drop("digest")
    nodes = known.unionByName(waiting)
    parent = done.select(F.col("key").alias("above"), F.col("conv").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parent, "above")
    first = nodes.where("depth = 1").crossJoin(F.broadcast(all_of.select(F.col("conv_id").alias("parent_conv_id"))))
    every = deep.unionByName(first).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
