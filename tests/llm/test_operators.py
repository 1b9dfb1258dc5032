"""Every operator on awkward tables (nulls, empty and long texts, ties, repeated rows, no rows, clashing columns), and against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.llm import decontaminate, embedding_dedup, language_id, line_dedup, mixing, ngram_join, quality, sharding, toxicity, url_filter
from burstlake.llm.labels import held_out, one_label
from burstlake.llm.shared import components, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000
AWKWARD = [
    (1, "the cat sat on the mat and the dog ran away\nsecond line here", "en", "a", 5),
    (2, "the cat sat on the mat and the dog ran away\nsecond line here", "en", "a", 5),
    (2, "the cat sat on the mat and the dog ran away\nsecond line here", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", None, "b", 3),
    (None, "a row without an id", "en", None, 1),
    (6, LONG, "de", "a", len(LONG)),
    (7, "Ünïcödé ßtraße 🙂 x", "de", None, 9),
    (8, "12345 67890 !!!", None, "c", 2),
    (9, "one", "en", "c", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    extra = ["bucket", "leaked", "component_id", "url_rule", "lang_pred", "toxicity", "n_lines", "shard"]
    return spark.createDataFrame(AWKWARD, DOCS).withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def texts(n, seed, vocabulary=60, length=(1, 40)):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefgh") + str(rng.randrange(vocabulary)) for _ in range(rng.randint(*length))) for _ in range(n)]


def test_words_and_folds(spark):
    assert words("A b\tC\x0b\x0c\x1cd\u00a0e É") == [b"a", b"b", b"c", b"\x1cd\xc2\xa0e", "É".encode()]
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", held_out("doc_id", 4, 2)).collect()}
    assert got.pop(None) is False and got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(50)}
    lab = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    assert rows(one_label(lab, "toxic")) == [(1, 1), (4, 0)]


def test_components_long_path(spark, monkeypatch):
    from burstlake.llm import shared

    monkeypatch.setattr(shared, "FINISH", 10)
    edges = [(k, k + 1) for k in range(1, 120)] + [(500 + k, 500) for k in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 121)} | {500 + k: 500 for k in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1 ----------------------------------------------------------------------------------------------------------------


def test_language(spark, awkward, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = held_out("doc_id", 4, 2)
    known = language_id.learn_dictionaries(docs.where(~out))
    assert set(known) == {"en", "de", "fr", "es"} and all(len(v) <= language_id.DICT_BYTES for v in known.values())
    got = language_id.identify(docs.where(out & F.col("lang").isNotNull()), known).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.lang_score.between(0, 1).all()
    odd = {(r.doc_id, r.text): r for r in language_id.identify(awkward, known).collect()}
    assert len(odd) == 10 and all(odd[k, t].lang_pred == "und" and odd[k, t].lang_rejected for k, t in ((3, None), (4, ""), (8, "12345 67890 !!!")))
    assert language_id.identify(empty, known).count() == 0
    assert language_id.learn_dictionaries(empty) == {}
    assert {r.lang_pred for r in language_id.identify(awkward, {}).collect()} == {"und"}


def test_language_of_a_long_text_is_that_of_most_of_it(spark):
    rng = random.Random(6)
    make = lambda stem, n: " ".join(stem + rng.choice("aeiou") + rng.choice("bdgklmn") + rng.choice(["ung", "heit"] if stem == "sch" else ["ing", "ness"]) for _ in range(n))
    known = {"de": make("sch", 6000).encode()[:64000], "en": make("th", 6000).encode()[:64000]}
    odd = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(270_000))
    cases = [(1, odd + make("sch", 30_000), "de"), (2, odd + make("th", 30_000), "en"), (3, make("th", 2000) + " " + make("sch", 6000), "de"), (4, make("th", 30_000) + " " + make("sch", 40_000), "de")]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string"), known).collect()}
    assert got == {k: lang for k, _, lang in cases}


# ---- 2 ----------------------------------------------------------------------------------------------------------------


def brute_components(pairs_of, sets, num, den):
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingle_set(t, width):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join_brute_force(spark, width, num):
    rng = random.Random(num)
    base = texts(25, num, length=(1, 60)) + ["x y", "x  Y", "", None]
    for t in list(base[:12]):
        for _ in range(9):
            w = (t or "").split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(30))
            base.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(base)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(docs, width=width, num=num, den=100).collect()}
    sets = {k: shingle_set(t, width) for k, t in enumerate(base)}
    want = brute_components(None, sets, num, 100)
    assert got == {k: (want[k], len(sets[k])) for k in sets}


def test_ngram_join_awkward(spark, awkward, empty):
    got = rows(ngram_join.jaccard_components(awkward).select("doc_id", "n_shingles", "component_id"))
    assert (3, 0, 3) in got and (4, 0, 4) in got and (None, 1, None) in got and got.count((2, 10, 1)) == 2 and len(got) == 11
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in (1, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)]
    assert ngram_join.jaccard_components(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for k in range(60):
        top = 400 if k < 40 else 20000
        a, b = (np.unique(rng.integers(0, top, rng.integers(1, top))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        assert ngram_join.differ(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))
        assert ngram_join.differ(ngram_join.parity(a), ngram_join.parity(a)) == 0


# ---- 3 ----------------------------------------------------------------------------------------------------------------


def brute_vectors(data, least):
    unit = {k: embedding_dedup.unit(v) for k, (v, _) in enumerate(data)}
    link = {k: set() for k in unit}
    for a in unit:
        for b in unit:
            if a != b and unit[a] is not None and unit[b] is not None and data[a][1] is not None and data[a][1] == data[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                link[a].add(b)
    comp = {}
    for a in sorted(unit):
        todo = [a] if a not in comp else []
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = a
                todo += link[x]
    return {(k, len(link[k]), comp[k], comp[k] == k) for k in unit}


def test_vectors_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "PLACE_ROWS", 30)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((12, 6))
    data = [((centre[k % 12] + rng.standard_normal(6) * 0.22).tolist(), int(k % 3)) for k in range(260)]
    data += [(data[0][0], 0)] * 5 + [([2 * x for x in data[1][0]], 1), (None, 0), ([0.0] * 6, 0), ([float("nan")] * 6, 0), ([1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (data[3][0], None), ([1.0, 2.0], 0), ([1.0, 2.0], 0), ([], 0)]
    df = spark.createDataFrame([(k, v, lab, "x") for k, (v, lab) in enumerate(data)], "vec_id long, embedding array<double>, label int, cell string")
    assert {tuple(r) for r in embedding_dedup.near_duplicates(df).collect()} == brute_vectors(data, 0.98)


def test_vectors_awkward(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = rows(embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (5, [1.0], 1), (5, [1.0], 1), (7, [1.0], 1)], kind)))
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, True)]


# ---- 4 ----------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "b.example.com", ""), ("allow", "b.example.com", "/x/y")]
    urls = [
        ("http://a.example.com/en/71?q", "a.example.com", "/en/71", "example.com/en/7", "allow"), ("https://EXAMPLE.com/en/8#x", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.net/de/", "notexample.net", "/de/", "net/de/", "block"), ("x", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://b.example.com", "b.example.com", "", "b.example.com", "block"), ("http://b.example.com/x/yz/w", "b.example.com", "/x/yz/w", "b.example.com/x/y", "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://b.example.com/en/7", "b.example.com", "/en/7", "b.example.com", "block"), ("http://x.com?/en/", "x.com", "", None, "allow"), ("http://com/EN/", "com", "/EN/", None, "allow"),
    ]
    df = spark.createDataFrame([(k, u[0], "clash") for k, u in enumerate(urls)], "page_id long, url string, url_rule string")
    got = url_filter.filter_urls(df, rules).orderBy("page_id").select("url", "url_host", "url_path", "url_rule", "url_verdict")
    assert [tuple(r) for r in got.collect()] == urls
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_url_filter_query_has_the_rules_of_its_contract(spark, tmp_path):
    from burstlake.llm import queries

    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/1", "http://www.example.net/de/81", "http://example.net/de/7", "http://a.org/es/", "http://a.org/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op4_url_filters(spark, str(tmp_path)).orderBy("page_id").select("rule", "verdict").collect()
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]
    assert [tuple(r) for r in got] == want


# ---- 5 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_gradients():
    net = toxicity.Network([b"a", b"b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    tokens = [b"a", b"b", b"ccc", b"dd"]
    kinds = (net.word_ids(tokens), *toxicity.grams(tokens))
    ids, mask = np.array([[0, 1, 2, 3, 1], [2, 2, 0, 0, 0]]), np.array([[1.0] * 5, [1.0, 1, 0, 0, 0]])
    y, w = np.array([1.0, 0.0]), np.ones(2)
    _, d = net.gradients(ids, mask, kinds, y, w)
    for name, g in d.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.p[name][at], 1e-4
        both = []
        for x in (old + e, old - e):
            net.p[name][at] = x
            both.append(net.gradients(ids, mask, kinds, y, w)[0])
        net.p[name][at] = old
        assert abs(g[at] - (both[0] - both[1]) / 2 / e) < 1e-5, name


def test_toxicity_finds_planted(spark, awkward, empty):
    rng = random.Random(0)
    clean = texts(260, 3, length=(5, 120))
    bad = []
    for t in texts(120, 4, length=(5, 120)):
        w = t.split()
        for _ in range(1 + len(w) // 20):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scumbag", "moron"]))
        bad.append(" ".join(w))
    net = toxicity.train(clean[:200] + bad[:80], np.array([0] * 200 + [1] * 80))
    late = texts(1, 5, length=(5000, 5000))[0] + " idiot moron idiot"
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(clean[200:] + bad[80:] + [late])], "doc_id long, text string, toxicity string")
    got = toxicity.score(docs, net).toPandas().sort_values("doc_id")
    hit = got.toxicity.astype(float) >= 0.7
    assert hit[:60].mean() < 0.05 and hit[60:100].mean() > 0.9 and hit.iloc[-1]
    odd = toxicity.score(awkward, net).toPandas()
    assert odd.toxicity.between(0, 1).all() and (odd[odd.text.isna()].toxicity == 0).all()
    assert toxicity.score(empty, net).count() == 0
    few = toxicity.learn(awkward, spark.createDataFrame([(1, 0)], "doc_id long, label int"))
    assert toxicity.score(awkward, few).toPandas().toxicity.max() < 0.7
    toxicity.learn(empty, spark.createDataFrame([], "doc_id long, label int"))


def test_toxicity_windows_cover_all_words():
    for n in (1, 39, 40, 41, 70, 71, 500):
        ids, mask = toxicity.windows(np.arange(n))
        seen = ids.ravel() if mask is None else ids[mask > 0]
        assert set(seen.tolist()) == set(range(n))


def test_toxicity_windows_hold_passages_whole():
    for n in (41, 70, 75, 200):
        ids, _ = toxicity.windows(np.arange(n))
        for a in range(n - 20):
            assert any(w[0] <= a and a + 20 <= w[-1] for w in ids), (n, a)


def test_toxicity_barely_moves_with_clean_words_in_front():
    rng = random.Random(9)
    clean = texts(200, 3, length=(5, 120))
    bad = []
    for t in texts(80, 4, length=(5, 120)):
        w = t.split()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scumbag", "moron"]))
        bad.append(" ".join(w))
    scorer = toxicity.Scorer(toxicity.train(clean + bad, np.array([0] * 200 + [1] * 80)))
    filler = texts(1, 11, length=(400, 400))[0].split()
    body = filler[:24] + ["idiot"] + filler[24:28] + ["moron"] + filler[28:39] + ["idiot"] + filler[39:41] + ["moron"] + filler[41:140]
    got = scorer.score([" ".join(filler[200 : 200 + k] + body) for k in range(31)])
    assert got.max() - got.min() < 0.05, got


# ---- 6 ----------------------------------------------------------------------------------------------------------------


def test_lines_brute_force(spark):
    rng = random.Random(2)
    base = [texts(1, 100 + k, vocabulary=3, length=(1, 7))[0] for k in range(30)]
    docs = []
    for k in range(60):
        each = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(base).split()
            if w and rng.random() < 0.6:
                j = rng.randrange(len(w))
                w[j : j + rng.randint(0, 1)] = rng.choice([[], ["z" + str(rng.randrange(6))]])
            each.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        docs.append((k, "\n".join(each)))
    got = {tuple(r)[:2]: tuple(r)[2:] for r in line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    every = [(d, k, words(x)) for d, t in docs for k, x in enumerate(t.split("\n")) if words(x)]
    want = {}
    for n, (d, k, w) in enumerate(every):
        first = next(((e, j) for e, j, v in every[:n] if line_dedup.one_edit(w, v)), None)
        if first:
            want[d, k] = first
    assert got == want


def test_one_edit():
    assert line_dedup.one_edit([b"a"], [b"b"]) and line_dedup.one_edit([], [b"b"]) and line_dedup.one_edit([b"a", b"b"], [b"b"])
    assert not line_dedup.one_edit([b"a", b"b"], [b"b", b"a"]) and not line_dedup.one_edit([b"a"], [b"a", b"b", b"c"])


def test_distinct_short_lines_stay(spark):
    near = ["a b c d e f", "a b c d e", "a b x d e f", "a b c d x", "a b c d e f g"]
    docs = [(1, "haanth.\nanth.\nChapter 1\nChapter 2\nchapter 1"), (2, "\n".join(near)), (3, "Anth.\nchapter 3")]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "haanth.\nanth.\nChapter 1\nChapter 2", 2: "a b c d e f\na b c d e\na b c d x", 3: "chapter 3"}


def test_lines_awkward(spark, awkward, empty):
    got = line_dedup.drop_lines(awkward)
    assert set(got.columns) == {*awkward.columns, "n_dropped"} and got.count() == 11
    by = {(r.doc_id, r.n_chars): (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert by[1, 5][2] == 0 and by[2, 5] == ("", 2, 2) and by[3, None] == (None, 0, 0) and by[4, 0] == ("", 1, 0) and by[6, len(LONG)][0] == LONG
    assert line_dedup.drop_lines(empty).count() == 0


# ---- 7 ----------------------------------------------------------------------------------------------------------------


def test_quality(spark, awkward, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = held_out("doc_id", 3, 1)
    m = quality.with_stats(docs)
    rules = quality.learn(m.where(~out), one_label(spark.read.parquet(f"{sf}/labels.parquet"), "quality"))
    assert rules.rules
    one = quality.score(m, rules).select("doc_id", "quality_score", "quality_stats.*").toPandas()
    x = one[list(quality.STATS)].to_numpy()
    at = {s: k for k, s in enumerate(quality.STATS)}
    z = sum(w * quality.holds(x, tuple((at[s], op, t) for s, op, t in r)) for r, w in rules.rules) + rules.bias
    assert np.allclose(one.quality_score, 1 / (1 + np.exp(-z)))
    odd = quality.score(quality.with_stats(awkward), rules).toPandas()
    assert odd.quality_score.between(0, 1).all() and len(odd) == 11
    assert quality.score(quality.with_stats(empty), quality.learn(quality.with_stats(empty), spark.createDataFrame([], "doc_id long, label int"))).count() == 0


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    rules = quality.fit_rules(x, y, ("a", "b", "c", "d"))
    z = sum(w * quality.holds(x, tuple(("abcd".index(s), op, t) for s, op, t in r)) for r, w in rules.rules) + rules.bias
    assert ((z > 0) == y).mean() > 0.97 and len(rules.rules) < 80


# ---- 8 ----------------------------------------------------------------------------------------------------------------


def test_targets():
    got = mixing.targets([("b", 100), (None, 50), ("a", 10), ("c", 0)], (5, 2, 1), 1.5, 2.0)
    assert [g[0] for g in got] == ["a", "b", "c", None] and got[0][2] == 20 and got[2][2] == 0
    # 240 words; a and c are full; b (weight 2) and null (weight 5) share 220, null is full at 100, b takes the rest.
    assert got[3][2] == 100 and got[1][2] == pytest.approx(120)


def test_pivot_keeps_sum_and_expectation():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for k in range(3000):
        q = mixing.pivot_round(size, p, np.random.default_rng(k).random(40))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6 and ((q > 0) & (q < 1)).sum() <= 1
        total += q
    assert np.abs(total / 3000 - p).max() < 0.05


def test_mix(spark, awkward, empty):
    docs = spark.createDataFrame([(k, t, None, f"s{k % 5}" if k % 11 else None, 0) for k, t in enumerate(texts(900, 1))], DOCS)
    a, b = mixing.mix(docs, block=16).toPandas(), mixing.mix(docs.repartition(5), block=16).toPandas()
    assert a.sort_values("doc_id").reset_index(drop=True).equals(b.sort_values("doc_id").reset_index(drop=True))
    assert len(a) == 900 and (a.taken <= 2 * a["size"]).all()
    for _, g in a.groupby("source", dropna=False):
        # The lot at the root of the tree decides on one document.
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and g.source_size.iloc[0] == g["size"].sum()
    for _, g in mixing.mix(docs).toPandas().groupby("source", dropna=False):
        # A source that fits one block is evened out over all its rows.
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2
    taken = mixing.take(docs, block=16).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = a[a.copies > 0].set_index("doc_id").copies
    assert taken.sort_index().to_dict() == want.sort_index().to_dict()
    assert mixing.mix(awkward).count() == 11 and mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    out = mixing.take(awkward)
    assert out.columns == awkward.columns and out.count() == mixing.mix(awkward).agg(F.sum("copies")).first()[0]


def test_mix_offsets_one_very_long_document(spark):
    rng = random.Random(4)
    docs = []
    for name, n in (("s500", 500), ("s5000", 5000)):
        docs += [(f"{name}", rng.randint(100, 800)) for _ in range(n - 1)] + [(name, 100_000)]
    docs = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(docs)], "doc_id long, source string, n int").selectExpr("doc_id", "repeat('w ', n) text", "source")
    for seed in (7, 8):
        got = mixing.mix(docs, weights=(1, 12), share=0.5, seed=seed).toPandas()
        assert len(got) == 5500 and got.doc_id.is_unique
        for s, g in got.groupby("source"):
            assert 0 < (g.target / g.source_size).iloc[0] % 1 < 1
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 2, (s, g.taken.sum(), g.target.iloc[0])


# ---- 9 ----------------------------------------------------------------------------------------------------------------


def test_shards(spark, awkward, empty, tmp_path):
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts(500, 2))], DOCS)
    got = sharding.shuffle_into_shards(docs, 7, bucket_bytes=5000).toPandas()
    per = got.groupby("shard").slot
    assert sorted(got.doc_id) == list(range(500)) and per.count().max() - per.count().min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in per) and got.bucket.nunique() > 5
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 8 == n for t, c, n in zip(got.text, got.text_crc32, got["size"], strict=True))
    place = got.sort_values("doc_id").eval("slot * 7 + shard").to_numpy()
    assert abs(np.corrcoef(place, np.arange(500))[0, 1]) < 0.2
    odd = sharding.shuffle_into_shards(awkward, 3)
    assert odd.count() == 11 and len(odd.columns) == len(set(odd.columns))
    assert odd.where("text is null").first().text_crc32 is None and odd.where("text is null").first()["size"] == 8
    assert sharding.shuffle_into_shards(empty, 3).count() == 0
    path = sharding.write_shards(sharding.shuffle_into_shards(docs, 7), str(tmp_path / "out"))
    assert spark.read.parquet(path).count() == 500


def test_shards_of_a_hot_row_and_reruns(spark):
    """60,000 copies of a row are spread over buckets of their size; rows that differ in any column have one place in every run."""
    hot = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a hot row " * 3).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rest = [(k % 50, "same text", None if k % 2 else "x", "x" if k % 2 else None, k // 4) for k in range(2000)]
    rest += [(k, t, "en", "s", 0) for k, t in enumerate(texts(500, 3))]
    docs = spark.createDataFrame(rest, DOCS).union(hot)
    one = sharding.shuffle_into_shards(docs.repartition(5), 7, bucket_bytes=1 << 16)
    two = sharding.shuffle_into_shards(docs.repartition(3, "n_chars"), 7, bucket_bytes=1 << 16)
    sizes = [r[0] for r in one.groupBy("bucket").agg(F.sum("size")).collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * (1 << 16) and one.count() == 62_500 and one.where("doc_id = 7 and text like 'a hot%'").count() == 60_000
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert one.select(*docs.columns).exceptAll(docs).count() == 0


def test_fisher_yates_is_uniform():
    seen = {}
    for k in range(6000):
        seen.setdefault(tuple(sharding.fisher_yates(3, np.random.default_rng(k))), []).append(k)
    assert len(seen) == 6 and all(850 < len(v) < 1150 for v in seen.values())


# ---- 10 ---------------------------------------------------------------------------------------------------------------


def naive_tiles(doc, item, least):
    fi, fd, out = [True] * len(item), [True] * len(doc), []
    while True:
        best, top = [], least
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and fi[i + n] and fd[j + n]:
                    n += 1
                if n > top:
                    best, top = [(i, j, n)], n
                elif n == top:
                    best.append((i, j, n))
        if not best:
            return sorted(out)
        for i, j, n in best:
            if all(fi[i : i + n]) and all(fd[j : j + n]):
                out.append((i, j, n))
                fi[i : i + n] = fd[j : j + n] = [False] * n


def test_tiles_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        v = rng.choice([2, 3, 6, 30])
        item = [rng.randrange(v) for _ in range(rng.randrange(1, 30))]
        doc = [rng.randrange(v) for _ in range(rng.randrange(0, 50))]
        if rng.random() < 0.5 and len(item) > 6:
            c = rng.randrange(1, len(item))
            doc = doc[:10] + item[c:] + doc[10:] + item[:c]
        assert sorted(decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)) == naive_tiles(doc, item, 3)


def test_decontaminate_both_ways(spark, awkward, empty):
    bench = [(k, t) for k, t in enumerate(texts(8, 9, vocabulary=200, length=(20, 30)))] + [(20, "too short"), (21, None), (None, "no id at all but five words")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    w = bench[3][1].split()
    plants = [bench[0][1].upper(), "x y z " + " ".join(w[12:] + ["gap"] + w[:12]) + " end", " ".join(bench[5][1].split()[:7]), "clean words only", None, "", texts(1, 77, length=(20000, 20000))[0] + " " + bench[1][1]]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(plants)] + [(0, plants[0], 1)], "doc_id long, text string, leaked int")
    near = [rows(decontaminate.decontaminate(docs, items, **how).select("doc_id", "leak_item", "leak_coverage", "leak_items", "leaked")) for how in ({}, {"max_seeds": 1})]
    assert near[0] == near[1]
    assert [(r[0], r[1], r[4]) for r in near[0]] == [(0, 0, True), (0, 0, True), (1, 3, True), (2, 5, False), (3, None, False), (4, None, False), (5, None, False), (6, 1, True)]
    assert decontaminate.decontaminate(awkward, items).count() == 11 and decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("leaked").count() == 0


# ---- Long lines and many languages --------------------------------------------------------------------------------------


def test_variants_of_a_long_line_are_linear():
    import time

    tokens = [b"w%d" % (k % 1000) for k in range(400_000)]
    began = time.process_time()
    whole, every = line_dedup.variants(tokens)
    assert time.process_time() - began < 20 and len(every) == 400_000 and len(whole) == 16
    for n in (7, 46, 47, 48, 49, 50, 60):
        some = tokens[:n]
        whole, every = line_dedup.variants(some)
        for k in range(n):
            assert every[k] == line_dedup.variants(some[:k] + some[k + 1 :])[0]
        assert len({whole, *every}) == n + 1
    assert line_dedup.variants([b"a"])[1] == [line_dedup.variants([])[0]]


def test_near_copy_of_a_long_text_without_line_feeds(spark):
    long = [f"w{k * 7919 % 1000}" for k in range(60_000)]
    docs = [(1, " ".join(long)), (2, " ".join([*long[:40_000], "other", *long[40_001:]])), (3, " ".join(long[:-2]))]
    got = line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string"), least=6).collect()
    assert [(r.doc_id, r.of_doc) for r in got] == [(2, 1)]


def test_no_language_is_lost(spark):
    """A language of long documents alone, one of a short document, 300 languages, and a hot row."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice(chr(97 + k % 20) + chr(97 + k // 20) + "xyz") for _ in range(6))
    rows = [(k, " ".join(word(k) for _ in range(60)), f"l{k:03d}") for k in range(300)]
    rows += [(1000, "lang " * 9000 + "ende", "long"), (1001, "kurz", "short"), *[(5, "hot row " * 40, "hot")] * 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.learn_dictionaries(docs)
    assert set(known) == {r[2] for r in rows} and len(known["long"]) > 10_000 and len(known["hot"]) < 400
    small = language_id.learn_dictionaries(docs, all_bytes=64 * 303)
    assert set(small) == set(known) and max(map(len, small.values())) <= 64
    got = language_id.identify(docs.where("doc_id < 40"), known).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.8
