"""Language identification by compression: the language whose zstandard dictionary makes the text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.shared import OWN

#: Bounds of what is learnt from: about so many documents for each language, their length, bytes of each dictionary, and languages (the most frequent ones).
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, ALL_BYTES = 128, (200, 20_000), 64_000, 16 << 20
#: A text is compressed in pieces of so many bytes, each against the dictionary alone, so that every part counts alike.
PIECE = 4096


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    """Matches from four bytes on with a short lazy search: syllables and short words count; frames carry no header fields."""
    how = zstandard.ZstdCompressionParameters(compression_level=3, strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=3, hash_log=15, chain_log=15, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0)
    table = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    table.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=table, compression_params=how)


def learn_dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", all_bytes: int = ALL_BYTES) -> dict[str, bytes]:
    """Raw dictionary content for each language: whole lower-cased documents, in a seeded order of ids.

    The sample is a share of a hash of ids and texts that gives about SAMPLE_DOCS documents for each language with a
    length in SAMPLE_CHARS, longer ones standing with a piece of that length at a place drawn from the hash; a language without
    one takes shorter documents. Every language is learnt: dictionaries are of DICT_BYTES and of all_bytes together, so
    that each of many languages gets a smaller one from fewer documents. Null and empty texts and null languages
    aren't learnt from; null ids are, as one id; repeated rows count once. An empty table gives no dictionary. Nothing
    is sorted: languages are counted, and only sampled texts are gathered.
    """
    n, parts = F.length(text), 1 << 30
    fit = docs.where(F.col(lang).isNotNull() & (n > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit(5), doc_id, text).alias("h"))
    n, top = F.length("t"), SAMPLE_CHARS[1]
    long_ = n >= SAMPLE_CHARS[0]
    piece = F.when(n > top, F.substring("t", F.pmod(F.col("h"), n - top + 1).cast("int") + 1, F.lit(top))).otherwise(F.col("t"))
    one = F.min_by(piece, F.struct(~long_, "h", "t")).alias("one")  # for a language that the sample misses
    counts = fit.groupBy("l").agg(F.count("*").alias("rows"), F.count_if(long_).alias("long"), one).collect()  # a row for each language
    if not counts:
        return {}
    each = min(DICT_BYTES, max(64, all_bytes // len(counts)))
    sample = max(1, SAMPLE_DOCS * each // DICT_BYTES)
    told = [(r.l, min(parts, 1 + int(sample / (r.long or r.rows) * parts)), r.long > 0) for r in counts]
    plan = docs.sparkSession.createDataFrame(told, "l string, share long, only_long boolean")
    drawn = fit.join(F.broadcast(plan), "l").where((F.pmod("h", F.lit(parts)) < F.col("share")) & (long_ | ~F.col("only_long")))
    drawn = drawn.select("l", piece.alias("t"), "h").distinct()
    held: dict[str, bytes] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.l, r.h, r.t)):
        got = held.get(r.l, b"")
        if len(got) < each:
            held[r.l] = got + b"\n" + r.t.lower().encode("utf-8", "surrogatepass")
    for r in counts:
        held.setdefault(r.l, r.one.lower().encode("utf-8", "surrogatepass"))
    # zstandard takes content of 8 bytes at least; what stands last is nearest, and so cheapest to point at.
    return {k: v[:each].rjust(8, b"\n") for k, v in held.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = 0.005) -> DataFrame:
    """Adds lang_pred, lang_score, lang_margin and lang_rejected to docs; whole texts, one narrow stage.

    Each text, lower-cased, is compressed with each language's dictionary in pieces of about PIECE bytes, each of them
    a frame that knows nothing of the others; the fewest bytes of all pieces win, the first language by
    name at a tie. lang_margin is the share of bytes by which the second is larger. lang_rejected says that it is
    under `margin`, so that callers can treat the guess as none. lang_score is 1 over the sum of 2 to the power of
    minus each language's bytes beyond the best. Texts that are null or hold no letter, and all texts if no
    dictionary was learnt, get `und`, score 0, margin 0 and are rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang string, score double, margin double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = {k: compressor(v) for k, v in sorted(shared.value.items())}
        for texts in batches:
            out = []
            for t in texts:
                if not t or not tools or not any(map(str.isalpha, t)):
                    out.append(("und", 0.0, 0.0))
                    continue
                raw = t.lower().encode("utf-8", "surrogatepass")
                n = -(-len(raw) // PIECE)
                pieces = [raw[len(raw) * k // n : len(raw) * (k + 1) // n] for k in range(n)]
                took = sorted((sum(len(c.compress(x)) for x in pieces), k) for k, c in tools.items())
                best, name = took[0]
                apart = (took[1][0] - best) / best if len(took) > 1 else 1.0
                out.append((name, 1 / sum(2.0 ** max(best - n, -1000) for n, _ in took), apart))
            yield pd.DataFrame(out, columns=["lang", "score", "margin"])

    out = docs.withColumn(OWN + "lang", judge(text))
    found = {f"lang_{k}": F.col(f"{OWN}lang.{v}") for k, v in (("pred", "lang"), ("score", "score"), ("margin", "margin"))}
    return out.withColumns(found).withColumn("lang_rejected", F.col("lang_margin") < margin).drop(OWN + "lang")
