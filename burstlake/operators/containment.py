"""Which of many patterns stand in which of many texts: one automaton over all of them, or grams that meet them by a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.staging import cut

#: Letters of all patterns together up to which their automaton is built in every task; it takes some 100 bytes a letter.
AUTOMATON_LETTERS = 1 << 20
#: Lengths of the grams that patterns begin with, and bits that tell which grams are some pattern's.
GRAMS, GRAM_BITS = (1, 4, 8, 16, 32), 1 << 23


def gram_length(n: int) -> int:
    return max(q for q in GRAMS if q <= n)


def gram_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def containing(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str, letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """(key, pattern): the distinct patterns that stand in the text of each row of texts, overlapping ones too, once for each key and pattern.

    A pattern is a string of letters, compared as it is; null and empty patterns, null texts and null keys give no row.
    Patterns of `letters` together at most are sent to all tasks as one automaton, which reads each text once. Beyond, a
    pattern is met by the gram that it begins with: a text gives each of its grams whose bit is set among the patterns'
    (as many bits as GRAM_BITS whatever their number), equal grams are joined, and whole patterns are then looked for. Both
    ways give the same rows. Without patterns there are none.
    """
    known = cut(patterns.where(F.col(pattern).isNotNull() & (F.col(pattern) != "")).select(F.col(pattern).alias("pattern")).distinct())
    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = known.agg(F.sum(F.length("pattern"))).first()[0] or 0
    kind = texts.schema[key].dataType
    if total <= letters:
        found = _by_automaton(rows, [r[0] for r in known.collect()], kind)
    else:
        found = _by_grams(rows, known, kind)
    return found.distinct().select(F.col("key").alias(key), F.col("pattern").alias(pattern))


def _by_automaton(rows: DataFrame, patterns: list[str], kind) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(patterns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for k, p in enumerate(shared.value):
            tree.add_word(p, k)
        tree.make_automaton()
        for b in batches:
            at, found = [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                held = {k for _, k in tree.iter(t)} if shared.value else ()
                at += [row] * len(held)
                found += [shared.value[k] for k in held]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "pattern"])

    return rows.mapInArrow(work, f"key {kind.simpleString()}, pattern string")


def _by_grams(rows: DataFrame, known: DataFrame, kind) -> DataFrame:
    @F.pandas_udf("bigint")
    def gram(patterns):
        return patterns.map(lambda p: gram_hash(p[: gram_length(len(p))]))

    keyed = cut(known.withColumn("gram", gram("pattern")))
    at = F.pmod("gram", F.lit(GRAM_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))
    held = keyed.groupBy(F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # GRAM_BITS / 64 rows at most
    bits = np.zeros(GRAM_BITS // 64, np.int64)
    for r in held:
        bits[r["word"]] = r["bits"]
    lengths = sorted(r[0] for r in known.select(F.length("pattern").alias("n")).select(F.expr("case " + " ".join(f"when n >= {q} then {q}" for q in GRAMS[::-1]) + " end")).distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, grams = [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                mine = {gram_hash(t[k : k + q]) for q in lengths for k in range(len(t) - q + 1)}
                mine = [g for g in mine if (int(shared.value[g % GRAM_BITS // 64]) >> (g % GRAM_BITS % 64)) & 1]
                at += [row] * len(mine)
                grams += mine
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(grams, pa.int64())], names=["key", "gram"])

    asked = rows.mapInArrow(work, f"key {kind.simpleString()}, gram bigint").distinct()
    pairs = asked.join(keyed, "gram").select("key", "pattern")
    return pairs.join(rows, "key").where(F.contains("text", "pattern")).select("key", "pattern")
