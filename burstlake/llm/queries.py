"""The registered queries of the numbered operators, with their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.llm import quality, toxicity
from burstlake.llm.decontaminate import decontaminate
from burstlake.llm.embedding_dedup import near_duplicates
from burstlake.llm.labels import held_out, one_label
from burstlake.llm.language_id import identify, learn_dictionaries
from burstlake.llm.line_dedup import drop_lines
from burstlake.llm.mixing import mix
from burstlake.llm.ngram_join import jaccard_components
from burstlake.llm.shared import cut
from burstlake.llm.sharding import shuffle_into_shards
from burstlake.llm.prefix_trie import prefix_trie, turn_lists
from burstlake.llm.token_files import read_tokens, write_tokens
from burstlake.llm.url_filter import filter_urls
from burstlake.llm.vector_codes import compress, with_label_error

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by the dictionary that compresses it best; null and letterless texts are `und` with score 0, ties go to the first language by name, rows with one id are each a row."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    known = learn_dictionaries(docs.where(~out & F.col("doc_id").isNotNull()))
    found = identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle sets and components of all documents; documents without words have empty sets and link with nothing, repeated rows are each a row and link like others."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


OP2_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS class_id, s FROM s),
k AS (SELECT class_id, n, s FROM c WHERE doc_id = class_id AND n > 0),
t AS (SELECT class_id, n, unnest(s) AS x FROM k),
p AS (SELECT a.class_id AS u, b.class_id AS v FROM t a JOIN t b ON a.x = b.x AND a.class_id < b.class_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT c.doc_id, c.n AS n_shingles, c.class_id, least(c.class_id, coalesce(m.v, c.class_id)) AS component_id FROM c LEFT JOIN m ON m.u = c.class_id
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal labels; vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0
      AND list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.98),
r(u, w) AS (SELECT u, w FROM p UNION SELECT r.u, p.w FROM r JOIN p ON r.w = p.u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(least(e.vec_id, m.w), e.vec_id) AS component_id, coalesce(least(e.vec_id, m.w), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM p GROUP BY u) c ON c.u = e.vec_id LEFT JOIN (SELECT u, min(w) AS w FROM r GROUP BY u) m ON m.u = e.vec_id
"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; a null url has empty parts and no rule, and without a rule the verdict is allow."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP4_SQL = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's highest window score; null and empty texts have a score too, null ids are in no held-out fold, rows with one id are each scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 3, 1)
    net = toxicity.learn(docs.where(~out), one_label(table(spark, sf_dir, "labels"), "toxic"))
    scored = toxicity.score(docs, net, out="score")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without lines that an earlier document or line has; null texts count 0 lines and stay null, rows with one id count as one document."""
    cleaned = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("kept_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality by rules over statistics of its whole text; null and empty texts have the statistics of no words, null ids are in no held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = cut(quality.with_stats(docs).drop("text"))
    out = held_out("doc_id", 3, 1)
    rules = quality.learn(measured.where(~out), one_label(table(spark, sf_dir, "labels"), "quality"))
    scored = quality.score(measured, rules, "score")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null sources are one source, the last, null texts have size 0 and are never taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every row by law `rows`; null ids and texts are rows like others, rows that are equal in all columns are interchangeable."""
    dealt = shuffle_into_shards(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document covers half of a benchmark item or more, and which; null texts and items cover nothing, ties go to the item with the smallest id."""
    judged = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", F.col("leaked").alias("contaminated"), F.col("leak_item").alias("item_id"), F.col("leak_coverage").alias("coverage"), F.col("leak_items").alias("n_items"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids in flat files, and what those files hold."""
    import public_tokenizers  # only this query needs the vocabulary files

    path = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid vector as a code of four parts, with its error, its label's error and a digest of the codebooks."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(cut(coded)).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 4) -> str:
    near = """SELECT vec_id, label, part, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
(SELECT u.*, c.entry, list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM u JOIN c{k} c ON u.part = c.part) GROUP BY ALL"""
    step = """a{k} AS (""" + near + """),
m{k} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM a{k}) GROUP BY ALL),
w{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM m{k} GROUP BY ALL),
c{next} AS (SELECT c.part, c.entry, coalesce(w.e, c.e) AS e FROM c{k} c LEFT JOIN w{k} w ON c.part = w.part AND c.entry = w.entry)"""
    return (
        """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
u AS (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS p FROM v, range(4) r(part)),
k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 256),
c0 AS (SELECT part, entry, p AS e FROM u JOIN k ON u.vec_id = k.vec_id),
"""
        + ",\n".join(step.format(k=k, next=k + 1) for k in range(rounds))
        + ",\nf AS ("
        + near.format(k=rounds)
        + """),
o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY ALL),
"""
        + f"h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})"
        + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o, h"""
    )


OP12_SQL = _op12_sql()


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with turns of another one, as their ids say."""
    own = cut(turn_lists(table(spark, sf_dir, "conversations")))
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    none = F.slice("turns", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return prefix_trie(own.join(heads, base == F.col("base"), "left").select("conv_id", rebuilt.alias("turns")))


OP13_SQL = """
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS n FROM o GROUP BY c),
c AS (SELECT c, c - c % 20 AS b, n, xor(list_reduce(list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT), lambda crc, x:
      list_reduce(range(8), lambda y, j: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(crc, x)), 4294967295), 4294967295) % 4 AS h FROM i),
r AS (SELECT c.c, o.k AS p, role, text FROM c JOIN o ON o.c = c.b AND o.k <= c.h
      UNION ALL SELECT c.c, least(c.h, coalesce(f.n, 0)) + o.k - c.h, role, text FROM c JOIN o ON o.c = c.c AND o.k > c.h LEFT JOIN c f ON f.c = c.b),
q AS (SELECT c, p, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY p) AS s FROM r),
x AS (SELECT c, p, w, min(c) OVER (PARTITION BY p, s) AS m FROM q UNION ALL SELECT c, 0, 0, min(c) OVER () FROM c),
n AS (SELECT m, p, count(*) AS n, (count(*) - 1) * max(w) AS saved FROM x GROUP BY m, p),
u AS (SELECT n.*, x.m AS above FROM n LEFT JOIN x ON x.c = n.m AND x.p = n.p - 1),
k AS (SELECT above AS m, p - 1 AS p, count(*) AS kids FROM u WHERE p > 0 GROUP BY ALL),
t AS (SELECT x.m, x.p, sum(n.saved) AS saved, count(*) FILTER (k.kids IS NULL) AS leaves FROM n JOIN x ON x.c = n.m AND x.p <= n.p LEFT JOIN k ON k.m = n.m AND k.p = n.p GROUP BY ALL),
l AS (SELECT c, max(p) AS p FROM x GROUP BY c),
e AS (SELECT x.m, x.p, sha256(string_agg(CAST(x.c AS VARCHAR), ',' ORDER BY x.c)) AS h FROM l JOIN x ON x.c = l.c AND x.p = l.p GROUP BY ALL)
SELECT u.m AS conv_id, u.p AS depth, u.above AS parent_conv_id, u.n AS n_convs, coalesce(k.kids, 0) AS n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM u JOIN t ON t.m = u.m AND t.p = u.p LEFT JOIN k ON k.m = u.m AND k.p = u.p LEFT JOIN e ON e.m = u.m AND e.p = u.p
"""


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_ngram_join": op2_ngram_join,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_url_filters": op4_url_filters,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_sharding": op9_sharding,
        "op10_decontamination": op10_decontamination,
        "op11_token_files": op11_token_files,
        "op12_vector_codes": op12_vector_codes,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op4_url_filters": OP4_SQL, "op12_vector_codes": OP12_SQL, "op13_prefix_trie": OP13_SQL}
