"""Joins at their limits: long posting lists, blocks of few rows, split lists, cases of several blocks, and marks that say nothing."""

import random

import duckdb
import pytest

from burstlake.llm import embedding_dedup, line_dedup, ngram_join, queries, shared
from tests.llm.test_operators import brute_components, brute_vectors, shingle_set


def hot_texts(seed):
    """One cluster of over a hundred near copies, another one of texts that share a passage and little else, and others."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    base, passage = [word() for _ in range(60)], [word() for _ in range(30)]
    out = []
    for _ in range(130):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = word()
        out.append(" ".join(w))
    for _ in range(90):
        own = [word() for _ in range(rng.randint(2, 8))]
        out.append(" ".join(passage + own if rng.random() < 0.5 else own + passage))
    out += [" ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_with_long_lists(spark, monkeypatch, small):
    if small:
        for name, n in (("BLOCK_ROWS", 16), ("VERIFY_ROWS", 8), ("HOT_ROWS", 20), ("LEAST_FREQUENT", 2), ("VERIFY_SHINGLES", 300)):
            monkeypatch.setattr(ngram_join, name, n)
        monkeypatch.setattr(shared, "ID_BITS", 64)
    texts = hot_texts(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, width=3, num=80, den=100).collect()}
    want = brute_components(None, {k: shingle_set(t, 3) for k, t in enumerate(texts)}, 80, 100)
    assert got == want and len(set(want.values())) > 60


def test_marks_lose_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(k,) for k in range(200)] + [(None,), (5,)], "x long")
    ids = spark.createDataFrame([(k,) for k in range(0, 400, 3)] + [(None,)], "y long")
    for bits in (64, 1 << 23):
        monkeypatch.setattr(shared, "ID_BITS", bits)
        inside = sorted(r.x for r in shared.with_ids(df, "x", ids).collect())
        outside = sorted((r.x is None, r.x) for r in shared.without_ids(df, "x", ids).collect())
        assert inside == [k for k in range(200) if k % 3 == 0] and [x for _, x in outside] == sorted([*(k for k in range(200) if k % 3), 5]) + [None]


def test_lines_with_marks_that_say_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f\nx", "k"), (2, "q\na b c d e g\nx", "k"), (3, None, "k"), (None, "x", "k")], "doc_id long, text string, gone_id string")
    want = {(1, "a b c d e f\nx", 0), (2, "q", 2), (3, None, 0), (None, "x", 0)}
    for bits in (64, 1 << 23):
        monkeypatch.setattr(shared, "ID_BITS", bits)
        assert {(r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_lines(docs).collect()} == want


def test_vectors_in_cells_of_several_levels(spark, monkeypatch):
    import numpy as np

    for name, n in (("CELL_ROWS", 10), ("MAX_CELLS", 3), ("BLOCK_ROWS", 16), ("PLACE_ROWS", 30), ("SAMPLE_ROWS", 60), ("DIVIDE_AGAIN", 2)):
        monkeypatch.setattr(embedding_dedup, name, n)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((40, 6))
    data = [((centre[k % 40] + rng.standard_normal(6) * 0.2).tolist(), int(k % 2)) for k in range(300)]
    df = spark.createDataFrame([(k, v, lab) for k, (v, lab) in enumerate(data)], "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in embedding_dedup.near_duplicates(df).collect()} == brute_vectors(data, 0.98)


def test_vectors_are_written_once_however_many_cells_they_meet(spark, monkeypatch):
    """Vectors that lie near many cells' borders: with a copy of each for every such cell the tables held 8 times the vectors."""
    from pathlib import Path

    import numpy as np

    for name, n in (("CELL_ROWS", 40), ("BLOCK_ROWS", 80)):
        monkeypatch.setattr(embedding_dedup, name, n)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x[2000:] = x[:1000] + rng.standard_normal((1000, 64)) * 0.2  # cosines around 0.98, often across a border
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    size = lambda: sum(p.stat().st_size for p in Path(shared.shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    before = size()
    got = {tuple(r) for r in embedding_dedup.near_duplicates(df).collect()}
    assert size() - before < 2 * x.nbytes
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    linked = u @ u.T >= 0.98
    np.fill_diagonal(linked, False)
    root = shared.forest(linked)
    assert got == {(k, int(linked[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(x))} and 100 < linked[:1000].sum() < 900


def test_close_calls_are_decided_in_double_precision():
    import numpy as np

    rng = np.random.default_rng(3)
    a = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    cos = 0.98 + np.array([1e-12, -1e-12, 1e-9, -1e-9, 1e-7, -1e-7, 1e-3, -1e-3])
    u = np.concatenate([a[:8], cos[:, None] * a[:8] + np.sqrt(1 - cos * cos)[:, None] * a[8:16]])
    block = lambda k: embedding_dedup.Block(k, np.full(len(k), 3.0), u[k], u[k].astype(np.float32), np.empty(0, np.int32), np.empty((0, 64)))
    want = [(k, 3, k % 8) for k in range(16) if k % 2 == 0]
    for found in (embedding_dedup.links(block(np.arange(16)), None, 0.98), embedding_dedup.links(block(np.arange(8)), block(np.arange(8, 16)), 0.98)):
        assert [tuple(map(int, r)) for r in zip(*embedding_dedup.summed(found), strict=True)] == want


def test_dense_and_sparse_links_agree():
    import numpy as np

    rng = np.random.default_rng(6)
    for share in (0.0005, 0.004, 0.3):
        linked = rng.random((90, 140)) < share
        i, j = np.nonzero(linked)
        top = embedding_dedup.joined(i, 90 + j, 230)
        row, col = embedding_dedup.groups(linked)
        assert (row[i] == top[i]).all() and (col[j] == top[90 + j]).all() and (row >= 0).sum() == len(set(i)) and (col >= 0).sum() == len(set(j))


def test_ngram_sql_on_awkward_texts(spark, tmp_path):
    rows = [(1, "a b c d e"), (2, "A b  c\td E"), (3, "a b"), (4, "a B"), (5, ""), (6, None), (7, " \n"), (8, "é É x y z"), (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(queries.OP2_SQL).df()[["doc_id", "n_shingles", "class_id", "component_id"]].itertuples(index=False)}
    got = {(r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in queries.op2_ngram_join(spark, str(tmp_path)).collect()}
    assert got == want
