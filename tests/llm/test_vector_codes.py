"""Vector codes against a plain computation of every distance."""

import hashlib
import math

import numpy as np
import pytest

from burstlake.llm import vector_codes
from burstlake.llm.vector_codes import Cells, compress, with_label_error

ROWS = "vec_id long, embedding array<double>, label int, code string, error string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label); returns the rows and the codebooks' digest."""
    kept = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in kept if len(v) % parts == 0]
    if not sizes:
        return [], hashlib.sha256(b"").hexdigest()
    dims = max(set(sizes), key=lambda n: (sizes.count(n), n))
    kept = [r for r in kept if len(r[1]) == dims]
    w = dims // parts
    head = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[r[1][p * w : (p + 1) * w] for r in head] for p in range(parts)]

    def nearest(book, x):
        d = ((np.array(book) - np.array(x)) ** 2).sum(1).tolist()
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                x = v[p * w : (p + 1) * w]
                got.setdefault(nearest(books[p], x)[0], []).append(x)
            for k, xs in got.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, lab in kept:
        near = [nearest(books[p], v[p * w : (p + 1) * w]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for k, _ in near), sum(d for _, d in near)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS).repartition(3)
    coded, books = compress(df, **kw)
    key = lambda r: tuple((x is not None, x) for x in r)
    want, digest = brute(rows, **kw)
    got = [tuple(r) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and books.sha256() == digest
    return coded, books


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.1, (5, 16))
    rows = [(k, (centres[k % 5] + rng.normal(0, 0.02, 16)).tolist(), k % 3) for k in range(300)]
    rows += [(1000 + k, rows[7][1], None) for k in range(200)]  # a group of copies
    coded, books = check(spark, rows)
    total = {lab: sum(r[3] for r in brute(rows)[0] if r[1] == lab) for lab in (0, 1, 2, None)}
    assert {r["label"]: r["label_error"] for r in with_label_error(coded).collect()} == total
    one = next(r for r in coded.collect() if r["vec_id"] == 3)
    assert ((np.floor((books.decode(one["code"]) - 0.5 / 1024) * 1024 + 0.5) - np.floor(np.array(rows[3][1]) * 1024)) ** 2).sum() == one["error"]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 7, -k / 3, 0.5, -1e-9, float(k % 2), 0.25, -0.25, 1.0], 1) for k in range(6)]
    bad = [(50, None, 1), (51, [], 1), (52, [None] + [0.0] * 7, 1), (53, [nan] * 8, None), (54, [inf] + [0.0] * 7, 1), (55, [1.0] * 4, 2), (56, [1.0] * 7, 2), (57, [0.0] * 8, None), (None, [0.0] * 8, None), (3, [9.0] * 8, 4), (3, [9.0] * 8, 4)]
    check(spark, good + bad)
    check(spark, good + bad, entries=3, rounds=2, scale=10)
    check(spark, bad[:5])
    check(spark, [])
    check(spark, good[:1])
    with pytest.raises(Exception, match="beyond"):
        compress(spark.createDataFrame([(1, [1e30] * 4, 1, "", "")], ROWS))


@pytest.mark.parametrize("case", ["wide", "narrow", "grid", "far", "same"])
def test_cells_lose_no_entry(case, monkeypatch):
    rng = np.random.default_rng(2)
    spread = {"wide": 3000, "narrow": 3, "grid": 40, "far": 20, "same": 0}[case]
    book = rng.integers(-spread, spread + 1, (256, 6))
    points = rng.integers(-2 * spread, 2 * spread + 1, (3000, 6))
    if case == "grid":  # many ties
        book, points = book // 20 * 20, points // 10 * 10
    if case == "far":
        points = points + 1_000_000
    want = ((points[:, None, :] - book[None]) ** 2).sum(2)
    monkeypatch.setattr(vector_codes, "PAIRS", 1000)
    for memo in (1 << 15, 10, 0):
        cells = Cells(book, memo)
        for a in range(0, 3000, 700):
            best, least = cells.nearest(points[a : a + 700])
            assert np.array_equal(best, want[a : a + 700].argmin(1)) and np.array_equal(least, want[a : a + 700].min(1))
        assert len(cells.memo) <= memo
    cells = Cells(book)
    monkeypatch.setattr(cells, "hashes", lambda c: np.zeros(len(c), np.uint64))  # all cells collide
    best, _ = cells.nearest(points[:500])
    assert np.array_equal(best, want[:500].argmin(1))
    if case == "wide":
        fresh = Cells(book)
        place, lists = fresh.candidates(points >> fresh.shift)
        assert np.mean([len(x) for x in lists]) < 40 and len(fresh.memo) == len(lists)
