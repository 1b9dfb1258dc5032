"""The trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from burstlake.llm.prefix_trie import Merger, forest, prefix_trie, turn_lists
from burstlake.llm.queries import op13_prefix_trie

CONVS = "conv_id long, turn long, role string, text string, depth string, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """convs: {id: ((role, text), ...)}"""
    members, ends, words = {}, {}, {(): 0}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                words[turns[:d]] = len((turns[d - 1][1]).encode().split())
        ends.setdefault(turns, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[q] for q in children.get(p, [])]
        leaves = sum(x[5] for x in below) or 1
        saved = (len(members[p]) - 1) * words[p] + sum(x[6] for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, digest)
    return sorted(out.values(), key=str)


def table(spark, convs, parts=3):
    rows = [(c, k, r, t, "clash", "clash") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, CONVS).repartition(parts)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def some(seed, n, turns, vocabulary):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 10 * n), n)
    return {c: tuple((rng.choice("ab"), rng.choice(vocabulary)) for _ in range(rng.randint(1, turns))) for c in ids}


@pytest.mark.parametrize("seed", range(40))
def test_forests_merge_at_any_border(seed):
    """Blocks of any lengths, merged one after the other and in two levels, give the nodes of one forest."""
    rng = random.Random(seed)
    items = [bytes([k]) * 16 for k in range(1, 4)]
    rows = sorted((b"".join(rng.choice(items) for _ in range(rng.randint(1, 5))), c) for c in range(60))
    weight = lambda s: [1 + s[16 * k] for k in range(len(s) // 16)]
    block = lambda some: forest([c for _, c in some], [s for s, _ in some], [weight(s) for s, _ in some])
    plain = lambda nodes: sorted((x.depth, x.key, x.above, x.n, x.conv, x.shared, x.leaves, x.kids, x.before, x.words) for x in nodes)
    one = Merger()
    left, path, done, _ = block(rows)
    one.add(left, path)
    want = plain(done + one.done + one.finish())
    assert len({x[1] for x in want}) == len(want)
    cuts = sorted({0, 60, *rng.sample(range(60), rng.randint(1, 30))})
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    groups = [parts[k : k + 3] for k in range(0, len(parts), 3)]
    nodes, whole = [], Merger()
    for group in groups:
        merger = Merger()
        for part in group:
            left, path, done, _ = block(part)
            merger.add(left, path)
            nodes += done
        nodes += merger.done
        rest = merger.spines()
        whole.add([x for x in rest if x.left], [x for x in rest if x.open])
    assert plain(nodes + whole.done + whole.finish()) == want


@pytest.mark.parametrize("case", ["broad", "deep", "copies", "one", "chain"])
def test_equals_brute_force(spark, case):
    convs = {
        "broad": some(1, 150, 4, ["x y", "z", "", "one two three"]),
        "deep": some(2, 40, 30, ["w"]),
        "copies": {c: (("u", "same first turn"), ("a", f"answer {c % 7}" if c % 3 else "hot")) for c in range(300)},
        "one": {5: (("u", "a b"), ("a", "c"))},
        "chain": {c: tuple(("u", "t t") for _ in range(c + 1)) for c in range(25)},
    }[case]
    df = table(spark, convs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert got(prefix_trie(turn_lists(df), block_turns=9, chunk=4, fan=2)) == brute(convs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got(prefix_trie(turn_lists(df))) == brute(convs)


def test_awkward_rows(spark):
    long = "word " * 50000
    rows = [(1, None, "u", "first"), (1, 3, None, "second"), (1, 3, None, "second"), (2, 0, "u", "first"), (2, 1, "", "second"), (3, 0, "u", None), (4, 0, "u", ""), (None, 0, "u", "lost"), (5, 0, "u", long), (6, 0, "u", long), (6, 1, "u:", "x"), (7, 1, "u", ":x"), (7, 2, "1:u", "")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], CONVS)
    convs = {1: (("u", "first"), ("", "second"), ("", "second")), 2: (("u", "first"), ("", "second")), 3: (("u", ""),), 4: (("u", ""),), 5: (("u", long),), 6: (("u", long), ("u:", "x")), 7: (("u", ":x"), ("1:u", ""))}
    assert got(prefix_trie(turn_lists(df))) == brute(convs)
    assert prefix_trie(turn_lists(df.limit(0))).count() == 0
    turnless = turn_lists(df).where("conv_id < 4").withColumn("turns", F.slice("turns", 1, 0))
    assert got(prefix_trie(turnless.union(turn_lists(df).where("conv_id >= 4")))) == brute(convs | {1: (), 2: (), 3: ()})
    assert got(prefix_trie(turnless)) == brute({1: (), 2: (), 3: ()})


def test_rebuilt_conversations(spark, tmp_path):
    import zlib

    own = some(3, 120, 5, ["p", "q r"])
    table(spark, own).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, ())[:h] + turns[h:]
    assert () in rebuilt.values()
    assert got(op13_prefix_trie(spark, str(tmp_path))) == brute(rebuilt)
