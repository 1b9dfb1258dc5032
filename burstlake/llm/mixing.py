"""Mixing sources to target weights: water-filled targets, pivotal dependent rounding, a reduction tree of residuals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstlake.llm.shared import OWN, WORD, cut


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: Sequence[float], share: float, cap: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of each source; sizes: (source, size).

    Sources by code point, null last, take the weights in turn. The targets sum to share times all sizes, in
    proportion to the weights, but no target is over cap times its source's size; what is above goes to the others
    by weight, until none is above. If all are at the cap, the rest of the share stays unused.
    """
    rows = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {x[0]: float(weights[k % len(weights)]) for k, x in enumerate(rows)}
    left, free, out = share * sum(n for _, n in rows), dict(rows), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = [s for s, n in free.items() if rate * weight[s] > cap * n]
        if not full:
            out |= {s: rate * weight[s] for s in free}
            break
        for s in full:
            out[s] = cap * free.pop(s)
            left -= out[s]
    return [(s, n, out[s]) for s, n in rows]


def pivot_round(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move mass between pairs of fractional rows until at most one is left; sum(size * p) doesn't change.

    Of two rows, either the first gives to the second or the reverse, as far as one of them becomes 0 or 1; draw
    decides, with such odds that no p changes in expectation.
    """
    p, held = p.copy(), -1
    for k in range(len(p)):
        if not 1e-12 < p[k] < 1 - 1e-12:
            p[k] = round(p[k])
            continue
        if size[k] <= 0:
            p[k] = float(draw[k] < p[k])
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # words that i can take from j
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if draw[k] * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for x in (i, j):
            if p[x] < 1e-9 or p[x] > 1 - 1e-9:
                p[x] = round(p[x])
        held = next((x for x in (j, i) if 0 < p[x] < 1), -1)
    return p


#: A source's last rows, among which its words are brought closest to the target, are so many at most.
EVEN_ROWS, EVEN_BITS = 4096, 4


def even_out(size: np.ndarray, p: np.ndarray, off: float) -> np.ndarray:
    """Flip rows (0 or 1) until off, the words over the target, is nearly 0.

    In the order given, which is random, rows of the state that is too frequent are flipped while they fit: no row is
    preferred, so that expectations stay. What is left is less than a row, for which rows are tried from large to small,
    and then the pair of rows that comes closest.
    """
    p = p.copy()
    mine = np.nonzero((p > 0.5) == (off > 0))[0]
    fits = mine[np.cumsum(size[mine]) <= abs(off)]
    off -= np.sign(off) * float(size[fits].sum())
    p[fits] = 1 - p[fits]
    rest = np.delete(np.arange(len(p)), fits)
    for k in rest[np.argsort(-size[rest], kind="stable")]:
        by = size[k] if p[k] < 0.5 else -size[k]
        if abs(off + by) < abs(off):
            off, p[k] = off + by, 1 - p[k]
    while len(p) > 1 and abs(off) >= 0.5:
        by = np.where(p < 0.5, size, -size)
        order = np.argsort(by, kind="stable")
        near = np.clip(np.searchsorted(by[order], -off - by) + np.array([[-2], [-1], [0], [1]]), 0, len(p) - 1)
        other = order[near]
        apart = np.where(other == np.arange(len(p)), np.inf, np.abs(off + by + by[other]))
        how, i = np.unravel_index(apart.argmin(), apart.shape)
        if apart[how, i] >= abs(off) - 1e-6:
            break
        pair = [i, other[how, i]]
        off, p[pair] = off + float(by[pair].sum()), 1 - p[pair]
    return p


def even_sources(done: DataFrame, rates: dict[str | None, tuple[float, float]]) -> DataFrame:
    """done with rows flipped so that each source's words meet its target; rates: (target, rate) of each source.

    The rows that a lot decided at the root stay as they are, and so do sources without fractional rows. Rows flip in
    the order of a hash: whole runs of it where they fit, found by sums over ranges of the hash, which are divided further
    until at most EVEN_ROWS rows of the source are left, in which even_out() ends the work.
    """
    spark, names = done.sparkSession, done.columns
    top = 60
    place = F.shiftrightunsigned(F.xxhash64("lot", F.lit(2)), 64 - top)
    done = cut(done.withColumn("at", place).withColumn("on", F.col("p") > 0.5))
    sums = done.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") + F.col("on").cast("long"))).alias("taken"), F.count_if((~F.col("drawn")) & (F.col("size") > 0)).alias("n")).collect()
    # Of each source: (words over the target that are left, bits of the hash decided, their value, rows under it).
    state = {r.source: [r.taken - rates[r.source][0], 0, 0, r.n] for r in sums if 0 < rates[r.source][1] % 1 < 1 and r.n and abs(r.taken - rates[r.source][0]) >= 0.5}
    if not state:
        return done.select(*names)
    step = 1 << EVEN_BITS

    def joined(only: list) -> DataFrame:
        plan = spark.createDataFrame([(s, float(state[s][0]), top - state[s][1], state[s][2]) for s in only], "of string, off double, shift int, prefix long")
        return done.where(~F.col("drawn") & (F.col("size") > 0)).join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    inside = F.expr("shiftright(at, shift)") == F.col("prefix")
    while wide := [s for s, x in state.items() if x[3] > EVEN_ROWS and x[1] + EVEN_BITS <= top]:
        part = F.expr(f"shiftright(at, shift - {EVEN_BITS})").alias("part")
        fit = F.sum(F.when(F.col("on") == (F.col("off") > 0), F.col("size")).otherwise(0)).alias("fit")
        found: dict = {}
        for r in joined(wide).where(inside).groupBy("source", part).agg(fit, F.count("*").alias("n")).collect():
            found.setdefault(r.source, {})[r.part] = (r.fit, r.n)
        for s in wide:
            x = state[s]
            begin = x[2] * step
            x[1], x[2], x[3] = x[1] + EVEN_BITS, begin + step - 1, 0
            for k in range(begin, begin + step):
                n, rows = found.get(s, {}).get(k, (0, 0))
                if n > abs(x[0]) or k == begin + step - 1:
                    x[2], x[3] = k, rows
                    break
                x[0] -= n if x[0] > 0 else -n
    over = {r.source: r.taken > rates[r.source][0] for r in sums}
    # state holds what is left for the last run; runs before it flip whole.
    plan = spark.createDataFrame([(s, float(x[0]), top - x[1], x[2], over[s]) for s, x in state.items()], "of string, off double, shift int, prefix long, too_many boolean")
    all_rows = done.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of")) & F.col("shift").isNotNull(), "left")
    free = ~F.col("drawn") & (F.col("size") > 0) & F.col("shift").isNotNull()
    before = free & (F.expr("shiftright(at, shift)") < F.col("prefix")) & (F.col("on") == F.col("too_many"))
    last = F.coalesce(free & inside, F.lit(False))
    all_rows = all_rows.withColumn("p", F.when(before, 1.0 - F.col("p")).otherwise(F.col("p"))).withColumn("last", last)
    shape = all_rows.select(*names).schema

    def end(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "size", "doc_id"], kind="stable").reset_index(drop=True)
        return part.assign(p=even_out(part["size"].to_numpy(np.float64), part["p"].to_numpy(np.float64), float(part["off"].iloc[0])))[names]

    ended = all_rows.where("last").select(*names, "at", "off").groupBy("source").applyInPandas(end, shape)
    return all_rows.where("not last").select(*names).unionByName(ended)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 256,
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, copies, taken).

    Every document of a source has the same expected copies, target / source_size, which is cap at most. The whole
    part is certain; the fractional part is rounded so that the source's words stay what they were: blocks of about
    `block` documents (by a seeded hash, so that a hot source is spread) are rounded each by itself, the one row that
    may stay fractional in each goes up a tree of such blocks. At its root one row is rounded by lot, which can be the
    longest of the source; even_sources() then flips rows from all of the source until it meets its target.

    Null or empty texts have size 0 and taken 0 if their lot says so, either way 0 words. A null source is a source
    of its own. Null ids and repeated rows are dealt with as documents of their own. An empty table gives none. Columns
    besides the three named are left out. Only sizes move, no text; per source, a few numbers go to the driver.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    sized = cut(sized.withColumn("lot", F.xxhash64(F.lit(seed), "doc_id", "size")))
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    rows = {r.source: r.rows for r in per}
    told = [(s, n, t, min(t / n, cap) if n else 0.0, max(1, -(-rows[s] // block))) for s, n, t in targets([(r.source, r["size"]) for r in per], weights, share, cap)]
    plan = spark.createDataFrame(told, "of string, source_size long, target double, rate double, blocks long")
    at = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at = at.withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.floor("rate"))
    at = at.withColumn("block", F.pmod("lot", F.col("blocks"))).withColumn("drawn", F.lit(False))
    keys, blocks = ["source", "block"], max([1, *(t[4] for t in told)])
    shape = at.schema

    def work(last: bool):
        def f(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["size", "lot", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            draw = (part["lot"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
            p = pivot_round(part["size"].to_numpy(np.float64), part["p"].to_numpy(np.float64), draw)
            if last:
                lot = (p > 0) & (p < 1)
                return part.assign(p=np.where(lot, draw < p, p).astype(np.float64), drawn=lot)
            return part.assign(p=p)

        return f

    done = None
    while True:
        last = blocks == 1
        at = cut(at.groupBy(*keys).applyInPandas(work(last), shape))
        settled = at.where("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        at = at.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") / block).cast("long"))
        at = at.withColumn("lot", F.xxhash64("lot", F.lit(1))).withColumn("block", F.pmod("lot", F.col("blocks"))).select(*shape.names)
        blocks = -(-blocks // block)
    done = even_sources(done, {s: (t, r) for s, _, t, r, _ in told})
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    return done.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as mix() says, with all their columns.

    Rows that share an id, a source and a size are numbered within these on both sides, to tell them apart.
    """
    names = {k: how.get(k, k) for k in ("doc_id", "text", "source")}
    like = [OWN + k for k in ("id", "source", "size")]
    nth, copies, copy = (OWN + k for k in ("nth", "copies", "copy"))
    chosen = cut(mix(docs, **how).select(*(F.col(k).alias(x) for k, x in zip(("doc_id", "source", "size"), like, strict=True)), F.col("copies").alias(copies)))
    own = docs.withColumns(dict(zip(like, (F.col(names["doc_id"]), F.col(names["source"]), word_count(names["text"])), strict=True)))
    if chosen.groupBy(*like).count().where("count > 1").isEmpty():
        chosen, own = chosen.withColumn(nth, F.lit(1)), own.withColumn(nth, F.lit(1))
    else:
        same = Window.partitionBy(*like)
        chosen = chosen.withColumn(nth, F.row_number().over(same.orderBy(copies)))
        own = own.withColumn(nth, F.row_number().over(same.orderBy(names["text"])))
    a, b = own.alias("a"), chosen.where(F.col(copies) > 0).alias("b")
    # Asked for at every size: broadcasts would only make small tables look cheaper than large ones are.
    met = a.join(b.hint("merge"), reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*like, nth)]))
    met = met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"b.{copies}").cast("int"))))
    return met.select(*(F.col(f"a.`{c}`") for c in docs.columns))
