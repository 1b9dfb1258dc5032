"""Quality classifier: rules from tree paths over text statistics, lasso logistic weights, Spark column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.labels import thin
from burstlake.llm.shared import words

STATS = (
    "n_words", "word_len", "word_len_spread", "symbols", "digits", "uppers", "points", "commas", "controls", "high_bytes",
    "unique_words", "top_word", "bare_words", "marked_words", "repeated_next", "n_lines", "line_words", "repeated_lines", "short_lines", "sentence_words",
)

#: Fixed classes of bytes: 0 letters, 1 digits, 2 upper case, 3 sentence ends, 4 commas and the like, 5 white space, 6 other symbols, 7 control, 8 non-ASCII.
CLASS = np.full(256, 6, np.uint8)
CLASS[128:] = 8
CLASS[:32] = 7
CLASS[127] = 7
CLASS[[9, 10, 11, 12, 13, 32]] = 5
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 2
CLASS[ord("0") : ord("9") + 1] = 1
CLASS[[ord(c) for c in ".!?"]] = 3
CLASS[[ord(c) for c in ",;:'\"()-"]] = 4


def measure(text: str | None) -> tuple[float, ...]:
    """The STATS of a whole text; all 0 for a null or empty one."""
    if not text:
        return (0.0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    share = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    tokens = words(text)
    n = len(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    if not n:
        return (0.0,) * 3 + (share[6], share[1], share[2], share[3], share[4], share[7], share[8]) + (0.0,) * 5 + (float(len(lines)),) + (0.0,) * 4
    size = np.fromiter(map(len, tokens), np.float64, n)
    count: dict[bytes, int] = {}
    for w in tokens:
        count[w] = count.get(w, 0) + 1
    kinds = list(count)
    last = CLASS[np.fromiter((w[-1] for w in kinds), np.uint8, len(kinds))]
    first = CLASS[np.fromiter((w[0] for w in kinds), np.uint8, len(kinds))]
    times = np.fromiter(count.values(), np.float64, len(kinds))
    marked = times[(last == 6) & (first != 6)].sum()
    bare = times[(last == 6) & (first == 6)].sum()
    nexts = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    whole = len(lines)
    short = sum(len(x) < 20 for x in lines)
    ends = max(1.0, share[3] * len(raw))
    return (
        float(n), size.mean(), size.std(), share[6], share[1], share[2], share[3], share[4], share[7], share[8],
        len(kinds) / n, times.max() / n, bare / n, marked / n, nexts / n, float(whole), n / max(1, whole), 1 - len(set(lines)) / max(1, whole), short / max(1, whole), n / ends,
    )


def text_stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=list(STATS), dtype=np.float64)


Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold


@dataclass(frozen=True)
class Rules:
    """score = sigmoid(bias + the weights of the rules that hold); a rule is a conjunction of conditions."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, prefix: str = "") -> F.Column:
        def holds(rule: tuple[Condition, ...]) -> F.Column:
            each = [F.col(prefix + s) <= F.lit(t) if op == "<=" else F.col(prefix + s) > F.lit(t) for s, op, t in rule]
            return reduce(lambda a, b: a & b, each)

        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, rng: np.random.Generator) -> tuple[list, np.ndarray]:
    """One regression tree on gradients: the paths to all its nodes, and what it adds for each row."""
    add, paths = np.zeros(len(x)), []
    stack = [(np.arange(len(x)), ())]
    while stack:
        rows, path = stack.pop()
        g, h = grad[rows], hess[rows]
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 2 * least:
            base = g.sum() ** 2 / (h.sum() + 1)
            for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
                if not len(cuts[f]):
                    continue
                at = np.searchsorted(cuts[f], x[rows, f], side="left")
                gs, hs, ns = (np.bincount(at, w, len(cuts[f]) + 1).cumsum()[:-1] for w in (g, h, np.ones(len(rows))))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, cuts[f][k]))
        if path:
            paths.append(path)
        if best[1] is None:
            add[rows] = g.sum() / (h.sum() + 1)
            continue
        f, t = best[1]
        low = x[rows, f] <= t
        stack += [(rows[low], (*path, (f, "<=", t))), (rows[~low], (*path, (f, ">", t)))]
    return paths, add


def simplify(path: tuple) -> tuple:
    """At most one threshold for each statistic and side, in a fixed order."""
    kept: dict = {}
    for f, op, t in path:
        kept[f, op] = min(t, kept.get((f, op), np.inf)) if op == "<=" else max(t, kept.get((f, op), -np.inf))
    return tuple(sorted((f, op, t) for (f, op), t in kept.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATS, trees: int = 40, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 1) -> Rules:
    """Boosted trees give candidate rules; logistic regression with an L1 penalty (accelerated proximal gradient) keeps a few."""
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
    if len(y) < 20 or y.min() == y.max():
        return Rules(base, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33), method="lower")) for f in range(x.shape[1])]
    margin, found = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        use = rng.random(len(y)) < 0.7
        paths, _add = grow(x[use], (y - p)[use], (p * (1 - p))[use], cuts, depth, max(5, len(y) // 400), rng)
        value = np.zeros(len(y))
        leaves = [q for q in paths if not any(len(r) > len(q) and r[: len(q)] == q for r in paths)]
        for q in leaves:
            rows = holds(x, q)
            g, h = (y - p)[rows & use].sum(), (p * (1 - p))[rows & use].sum()
            value[rows] = g / (h + 1)
        margin += 0.3 * value
        found |= dict.fromkeys(simplify(q) for q in paths)
    rules = list(found)
    z = np.stack([holds(x, r) for r in rules], 1).astype(np.float64)
    _, first = np.unique(z, axis=1, return_index=True)
    first = [k for k in sorted(first) if 0 < z[:, k].mean() < 1]
    rules, z = [rules[k] for k in first], z[:, sorted(first)]
    if not rules:
        return Rules(base, ())
    mean, std = z.mean(0), z.std(0)
    zs = (z - mean) / std
    w, b, v, c, t = np.zeros(len(rules)), base, np.zeros(len(rules)), base, 1.0
    step = 4 / (np.linalg.norm(zs, 2) ** 2 / len(y) + 1)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(zs @ v + c))) - y
        w1 = v - step * (zs.T @ r / len(y))
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1, t1 = c - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    keep = np.nonzero(w)[0]
    weight = w / std
    kept = tuple((tuple((names[f], op, float(t)) for f, op, t in rules[k]), float(weight[k])) for k in keep)
    return Rules(float(b - (weight * mean).sum()), kept)


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, op, t in rule:
        ok &= x[:, f] <= t if op == "<=" else x[:, f] > t
    return ok


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one struct column, quality_stats, with the STATS of each whole text; one narrow stage.

    Null and empty texts have statistics 0. Every row stays, repeated ones too, with all its columns; a column that is
    called quality_stats already is replaced. An empty table stays empty.
    """
    stats = F.pandas_udf(text_stats, ", ".join(f"{s} double" for s in STATS))
    return docs.withColumn("quality_stats", stats(text))


def learn(measured: DataFrame, labels: DataFrame, rows: int = 20_000, doc_id: str = "doc_id") -> Rules:
    """Fit on at most about `rows` labelled documents, a seeded share of ids. labels: (doc_id, label); only statistics are gathered.

    Null ids have no label. Repeated rows count as often as they stand there, ties between splits go to the first
    statistic in order. With under 20 labelled rows, or one label only, there is no rule and the score is one number.
    """
    own = measured.select(F.col(doc_id).alias("doc_id"), "quality_stats.*").join(labels, "doc_id")
    got = thin(own, rows).toPandas().sort_values(["doc_id", *STATS])
    return fit_rules(got[list(STATS)].to_numpy(np.float64), got["label"].to_numpy(np.float64))


def score(measured: DataFrame, rules: Rules, out: str = "quality_score") -> DataFrame:
    """Adds the score, 0 to 1, as one column expression over quality_stats; replaces a column of that name. All rows and other columns stay.

    Null and empty texts have statistics 0 and so a score.
    """
    return measured.withColumn(out, rules.column("quality_stats."))
