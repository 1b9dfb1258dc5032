"""Line near-duplicates by deletion neighbourhoods over words: a line goes if an earlier one is the same or, if both are long enough, one word edit away.

Two word sequences are one edit apart if a word was replaced (both, without the word at one place, are the same), or
added or removed (one of them, without a word, is the other). So every line emits itself and its variants with one word
deleted, as hashed keys; lines meet on equal keys, where the earliest line decides, so that no key makes pairs of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.shared import OWN, cut, mark_ids, words


#: A line's place in the corpus as one number, in the order of document and line.
LINES = 1 << 31
#: In a line of fewer words, one word is too large a part: drop_lines() takes such lines for the same only if all words are.
LEAST_WORDS = 6
#: Variants that a task hands on at a time, or those of one line.
EMIT = 50_000


def digest(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def halves(tokens: list[bytes]) -> list[int]:
    """Four keys of a line; lines one edit apart share one of them, as an edit leaves one half of the shorter line whole.

    For the line's own length, and for a partner that is one word shorter: the first half of that length, and the rest
    from the end.
    """
    out = []
    for n in (len(tokens), len(tokens) - 1):
        p = n // 2
        out.append(xxhash.xxh3_64_intdigest(b"P%d " % n + b" ".join(tokens[:p])))
        out.append(xxhash.xxh3_64_intdigest(b"S%d " % n + b" ".join(tokens[len(tokens) - (n - p) :] if n > p else [])))
    return out


#: Keys of sequences of LONG words and more are polynomials of word hashes modulo a prime, so that each variant takes constant
#: time; those of shorter ones are digests of the words, which is quicker there. A sequence's length alone decides.
LONG, MODULUS, BASE = 48, (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F


def variants(tokens: list[bytes]) -> tuple[bytes, list[bytes]]:
    """The key of a line, and its keys without its word at each place; time and memory grow with the line, not with its square."""
    n = len(tokens)
    if n < LONG:
        return digest(tokens), [digest(tokens[:k] + tokens[k + 1 :]) for k in range(n)]
    h = [xxhash.xxh3_64_intdigest(w) + 1 for w in tokens]
    before = [0]
    for x in h:
        before.append((before[-1] * BASE + x) % MODULUS)
    whole = before[-1].to_bytes(16, "big")
    if n == LONG:
        return whole, [digest(tokens[:k] + tokens[k + 1 :]) for k in range(n)]
    out, after, power = [], 0, 1
    for k in range(n - 1, -1, -1):
        out.append(((before[k] * power + after) % MODULUS).to_bytes(16, "big"))
        after = (h[k] * power + after) % MODULUS
        power = power * BASE % MODULUS
    return whole, out[::-1]


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two word sequences are at most one word apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[p:] == long[p + 1 :]


def place(doc: str = "doc_id", line: str = "line") -> F.Column:
    return (F.col(doc).cast("decimal(20,0)") * F.lit(LINES).cast("decimal(10,0)") + F.col(line).cast("decimal(10,0)")).cast("decimal(38,0)")


def near_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(doc_id, line, of_doc, of_line): each line that goes, and the earliest line within its bound.

    The bound of two lines is one word edit if both have `least` words or more, else none: they must be the same.

    Lines are what line feeds separate, numbered from 0; words are what white space separates, A-Z lower-cased. Earlier
    is a smaller (doc_id, line). A line goes if any earlier line, kept or not, has the same words or is in the bound,
    in the same document or another. Lines without words are never compared and stay. Null texts and ids have no
    lines. Rows with the same id count as one document; a line number goes if a line with it goes in any of them.
    Extra columns are left out; an empty table gives none.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                doc, line, own, half, exact = [], [], [], [], []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for k, x in enumerate(t.split("\n")):
                        tokens = words(x)
                        if tokens:
                            doc.append(d)
                            line.append(k)
                            own.append(digest(tokens))
                            half += halves(tokens) if len(tokens) >= least else [0] * 4
                            exact.append(len(tokens) < least)
                h = np.array(half, np.uint64).view(np.int64).reshape(-1, 4)
                none = np.array(exact, bool)
                yield pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "line": pa.array(line, pa.int64()), "own": pa.array(own, pa.binary()), **{f"k{j}": pa.array(np.ascontiguousarray(h[:, j]), mask=none) for j in range(4)}})

    keys = ["k0", "k1", "k2", "k3"]
    lines = cut(base.mapInArrow(split, "doc_id long, line long, own binary, " + ", ".join(f"{k} long" for k in keys)))
    # The first line with the same words stands for all of them; a frequent line is summed up before it is shuffled.
    firsts = cut(lines.groupBy("own").agg(F.min(place()).alias("at"), *(F.min(k).alias(k) for k in keys)))
    # Only lines that share a half with another can be one edit away from one; the others need no variants.
    half = firsts.select(F.xxhash64("own").alias("own"), F.explode(F.array(*keys)).alias("key")).where("key is not null")
    shared = half.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("key")
    near = half.join(shared, "key").select(F.col("own").alias("short")).distinct()
    near = firsts.withColumn("short", F.xxhash64("own")).join(near, "short").select(F.floor(F.col("at") / LINES).cast("long").alias("doc_id"), F.pmod("at", F.lit(LINES)).cast("long").alias("line"))
    asked = near.groupBy("doc_id").agg(F.collect_set("line").alias("ask"))

    def rows(doc: list, line: list, own: list, key: list, gone: list, full: list) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "line": pa.array(line, pa.int64()), "own": pa.array(own, pa.binary()), "key": pa.array(key, pa.binary()), "gone": pa.array(gone, pa.int32()), "full": pa.array(full, pa.binary())})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                doc, line, own, key, gone, full = [], [], [], [], [], []
                for d, t, ask in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("ask").to_pylist(), strict=True):
                    each = t.split("\n")
                    for k in ask:
                        tokens = words(each[k]) if k < len(each) else []
                        if not tokens:
                            continue
                        mine, (whole_key, found) = digest(tokens), variants(tokens)
                        n = len(found) + 1
                        doc += [d] * n
                        line += [k] * n
                        own += [mine] * n
                        key += [whole_key, *found]
                        gone += range(-1, n - 1)
                        full += [b" ".join(tokens), *[None] * (n - 1)]
                        if len(doc) >= EMIT:
                            yield rows(doc, line, own, key, gone, full)
                            doc, line, own, key, gone, full = [], [], [], [], [], []
                yield rows(doc, line, own, key, gone, full)

    asked = cut(asked)
    may = mark_ids(base, "doc_id", asked.select("doc_id"), "may").where("may").drop("may")
    made = may.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "ask").mapInArrow(emit, "doc_id long, line long, own binary, key binary, gone int, full binary")
    made = cut(made.withColumn("at", place()).drop("doc_id", "line"))
    # Equal (key, place of the deleted word): one replaced. Equal key with the line itself, where no word is gone (-1): one added.
    per = made.groupBy("key", "gone").agg(F.min("at").alias("same"))
    whole, less = F.min(F.when(F.col("gone") < 0, F.col("same"))), F.min(F.when(F.col("gone") >= 0, F.col("same")))
    by_key = per.groupBy("key").agg(whole.alias("whole"), less.alias("less"))
    best = F.when(F.col("gone") < 0, F.col("less")).otherwise(F.least("same", "whole"))
    met = made.join(per, ["key", "gone"]).join(by_key, "key").withColumn("best", best)
    found = met.where("best < at").groupBy("own").agg(F.min("at").alias("at"), F.min("best").alias("best"))

    # The partner's words are compared in full.
    texts = made.where("gone = -1").select("own", "at", "full").groupBy("own").agg(F.min("at").alias("at"), F.min("full").alias("full"))
    is_near = F.pandas_udf(lambda a, b: pd.Series([one_edit(x.split(b" "), y.split(b" ")) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")
    pairs = found.select("own", "best").join(texts.select("own", "full"), "own").join(texts.select(F.col("at").alias("best"), F.col("full").alias("other")), "best")
    verified = cut(pairs.where(is_near("full", "other")).select("own", "best"))

    label = firsts.select("own", "at").join(verified, "own", "left").select("own", F.least("at", "best").alias("first"))
    # Nothing stands above this join that needs a line's copies together, so that Spark can split those of a frequent line.
    gone = cut(lines.select("doc_id", "line", "own", place().alias("at")).join(label, "own").where("first < at").select("doc_id", "line", "first"))
    return gone.select("doc_id", "line", F.floor(F.col("first") / LINES).cast("long").alias("of_doc"), F.pmod("first", F.lit(LINES)).cast("long").alias("of_line")).distinct()


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """docs with the lines of near_lines() taken out of the texts, and n_lines and n_dropped added (replaced, if there).

    Every row stays; a null text stays null and counts 0 lines; a document all of whose lines go keeps an empty text.
    """
    gone_id, gone_lines, may = OWN + "id", OWN + "lines", OWN + "may"
    gone = near_lines(docs, doc_id, text, least).groupBy(F.col("doc_id").alias(gone_id)).agg(F.collect_set("line").alias(gone_lines))
    gone = cut(gone)
    # A row without words in lines that go, as nearly all whose bit isn't set, moves nowhere.
    marked = mark_ids(docs, doc_id, gone.select(gone_id), may)
    met = marked.where(may).join(gone.hint("merge"), F.col(doc_id).cast("long") == F.col(gone_id), "left").drop(gone_id)
    rest = marked.where(f"not {may}").withColumn(gone_lines, F.lit(None).cast("array<bigint>"))
    out = met.unionByName(rest).drop(may)

    @F.pandas_udf("string")
    def without(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(texts, lines, strict=True):
            if t is None or x is None:
                out.append(t)
                continue
            go = set(x.tolist())
            out.append("\n".join(y for k, y in enumerate(t.split("\n")) if k not in go))
        return pd.Series(out, dtype=object)

    n = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    kept = F.when(F.col(gone_lines).isNull(), F.col(text)).otherwise(without(F.when(F.col(gone_lines).isNotNull(), F.col(text)), gone_lines))
    dropped = F.when(F.col(text).isNull() | F.col(gone_lines).isNull(), 0).otherwise(F.size(gone_lines))
    return out.withColumns({"n_lines": n.cast("int"), "n_dropped": dropped.cast("int"), text: kept}).drop(gone_lines)
