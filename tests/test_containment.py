"""Patterns in texts by the automaton and by grams, against looking for each pattern in each text."""

import random

import pytest

from burstlake.operators.containment import containing


@pytest.mark.parametrize("letters", [1 << 20, 0])
def test_both_ways_equal_brute_force(spark, letters):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("aab é🙂") for _ in range(n))
    texts = [(k, word(rng.randint(0, 80))) for k in range(120)] + [(500, None), (None, "aaa"), (3, "a second row of an id aab"), (501, ""), (502, "ab" * 5000)]
    patterns = ["a", "aa", "aaa", "ab", "ba", "é", "🙂a", "b" * 40, "ab" * 20, "ab" * 16 + "b", "nowhere", "", None, "a", *(word(rng.randint(1, 20)) for _ in range(60)), *(t[5:45] for _, t in texts[:40] if t and len(t) > 50)]
    got = containing(spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(p, "x") for p in patterns], "p string, id string"), "id", "text", "p", letters)
    want = {(k, p) for k, t in texts for p in patterns if k is not None and t is not None and p and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and got.columns == ["id", "p"]


@pytest.mark.parametrize("letters", [10, 0])
def test_without_patterns_or_texts(spark, letters):
    texts, patterns = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "p string")
    assert containing(texts, patterns.limit(0), "id", "text", "p", letters).count() == 0
    assert containing(texts.limit(0), patterns, "id", "text", "p", letters).count() == 0
