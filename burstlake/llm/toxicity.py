"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A text is cut into overlapping windows of words; the network scores every window, and the text's score is that of its
highest window. Training (on the driver, over a bounded sample) knows labels of texts only: each round it scores all
windows of the sample, and then learns from the highest window of each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.labels import thin
from burstlake.llm.shared import cut, words

#: Every passage of WINDOW - STRIDE + 1 words lies whole in a window.
WINDOW, STRIDE = 40, 20
#: In a text whose highest window has a logit between these, every shift around windows above the lower one is scored as well.
UNSURE = (-5.0, 4.0)
HIDDEN, DIM, BUCKETS, ATTEND = 8, 8, 8192, 8
#: Bounds of what is learnt from: texts of either label, their length in characters, and known words.
SAMPLE_DOCS, SAMPLE_CHARS, MAX_WORDS, LEAST_DOCS = 1500, 6000, 4096, 12
CACHE, BATCH = 100_000, 4096


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def grams(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of three and of five bytes of each word between marks, word by word, and where each word's begin.

    Words are padded behind, so that each has as many runs of either length as it has bytes.
    """
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03\x03\x03" for w in tokens), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.concatenate(([0], np.cumsum(size + 4)[:-1])).astype(np.int64)
    inside = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    out = np.empty((2, len(inside)), np.int64)
    for row, width in enumerate((3, 5)):
        h = np.full(len(inside), width, np.uint32)
        for k in range(width):
            h = h * np.uint32(65599) + raw[inside + k]
        out[row] = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13)
    return out.T.ravel(), 2 * np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = 0):
        rng = np.random.default_rng(seed)
        d, h = 2 * DIM, HIDDEN
        shape = {"Ew": (len(vocabulary) + 1, DIM), "Ec": (BUCKETS, DIM), "Wf": (d, 3 * h), "Uf": (h, 3 * h), "Wb": (d, 3 * h), "Ub": (h, 3 * h), "Wa": (2 * h, ATTEND), "va": (ATTEND,), "wo": (2 * h,)}
        self.p = {k: (rng.standard_normal(s) * (0.3 if k[0] == "E" else s[0] ** -0.5)).astype(np.float32) for k, s in shape.items()}
        self.p |= {"bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32), "ba": np.zeros(ATTEND, np.float32), "bo": np.zeros(1, np.float32)}
        self.word = {w: k + 1 for k, w in enumerate(vocabulary)}

    def word_ids(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter((self.word.get(w, 0) for w in tokens), np.int64, len(tokens))

    # ---- training -------------------------------------------------------------------------------------------------

    def gradients(self, ids: np.ndarray, mask: np.ndarray, kinds: tuple, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients. ids: (batch, time) into kinds = (word ids, gram buckets, starts) of the words met."""
        p, h_ = self.p, HIDDEN
        wid, tri, start = kinds
        size = np.sqrt(np.diff(np.append(start, len(tri)))).astype(np.float32)
        chars = np.add.reduceat(p["Ec"][tri], start, axis=0) / size[:, None]
        kind_x = np.concatenate((p["Ew"][wid], chars), 1)
        x = kind_x[ids]
        n, t, _ = x.shape
        hs, saved = np.zeros((n, t, 2 * h_), np.float32), {}
        for side, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            h, a, u = np.zeros((n, h_), np.float32), x @ p["W" + side] + p["b" + side], p["U" + side]
            for k in order:
                g = h @ u
                zr = sigmoid(a[:, k, : 2 * h_] + g[:, : 2 * h_])
                z, r = zr[:, :h_], zr[:, h_:]
                c = np.tanh(a[:, k, 2 * h_ :] + r * g[:, 2 * h_ :])
                new = ((1 - z) * c + z * h) * mask[:, k, None]
                saved[side, k] = (h, z, r, c, g[:, 2 * h_ :])
                h = new
                hs[:, k, (0 if side == "f" else h_) : (h_ if side == "f" else 2 * h_)] = h
        e = np.tanh(hs @ p["Wa"] + p["ba"])
        s = e @ p["va"] + (mask - 1) * 1e4
        s = np.exp(s - s.max(1, keepdims=True))
        alpha = s / s.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", alpha, hs)
        q = sigmoid(pooled @ p["wo"] + p["bo"])
        loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / n)
        d = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((q - y) * weight / n).astype(np.float32)
        d["wo"], d["bo"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * p["wo"]
        dhs = alpha[:, :, None] * dpool[:, None, :]
        da = np.einsum("nh,nth->nt", dpool, hs)
        ds = alpha * (da - (alpha * da).sum(1, keepdims=True))
        d["va"] = np.einsum("nt,nta->a", ds, e)
        de = ds[:, :, None] * p["va"] * (1 - e * e)
        d["Wa"], d["ba"] = np.einsum("nth,nta->ha", hs, de), de.sum((0, 1))
        dhs = dhs + de @ p["Wa"].T
        dx = np.zeros_like(x)
        for side, order in (("f", range(t - 1, -1, -1)), ("b", range(t))):
            at = slice(0, h_) if side == "f" else slice(h_, 2 * h_)
            dh, da_, u = np.zeros((n, h_), np.float32), np.zeros((n, t, 3 * h_), np.float32), p["U" + side]
            for k in order:
                h, z, r, c, gc = saved[side, k]
                dh = (dh + dhs[:, k, at]) * mask[:, k, None]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate((dz, dr, dc * r), 1)
                da_[:, k] = np.concatenate((dz, dr, dc), 1)
                d["U" + side] += h.T @ dg
                dh = dh * z + dg @ u.T
            d["W" + side] = np.einsum("ntd,ntg->dg", x, da_)
            d["b" + side] = da_.sum((0, 1))
            dx += da_ @ p["W" + side].T
        dk = np.zeros_like(kind_x)
        np.add.at(dk, ids.ravel(), dx.reshape(-1, dx.shape[2]) * mask.reshape(-1, 1))
        np.add.at(d["Ew"], wid, dk[:, :DIM])
        np.add.at(d["Ec"], tri, np.repeat(dk[:, DIM:] / size[:, None], np.diff(np.append(start, len(tri))), axis=0))
        return loss, d

    # ---- scoring --------------------------------------------------------------------------------------------------

    def inputs(self, tokens: list[bytes]) -> np.ndarray:
        """What each word adds to the gates of either direction: (6 * HIDDEN, words)."""
        p = self.p
        tri, start = grams(tokens)
        size = np.sqrt(np.diff(np.append(start, len(tri)))).astype(np.float32)
        x = np.concatenate((p["Ew"][self.word_ids(tokens)], np.add.reduceat(p["Ec"][tri], start, axis=0) / size[:, None]), 1)
        return np.concatenate((x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]), 1)

    def logits(self, ids: np.ndarray, mask: np.ndarray | None, table: np.ndarray) -> np.ndarray:
        """Of windows ids (count, time) of rows of table; mask (count, time) only where windows are padded."""
        p, h_ = self.p, HIDDEN
        n, t = ids.shape
        hs = np.empty((t, 2 * h_, n), np.float32)
        for side, order, first in (("f", range(t), 0), ("b", range(t - 1, -1, -1), 3 * h_)):
            h, u = np.zeros((h_, n), np.float32), np.ascontiguousarray(p["U" + side].T)
            half = np.ascontiguousarray(table[:, first : first + 3 * h_])
            at = slice(0, h_) if side == "f" else slice(h_, 2 * h_)
            for k in order:
                a = half[ids[:, k]].T
                g = u @ h
                zr = a[: 2 * h_] + g[: 2 * h_]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = zr[h_:] * g[2 * h_ :]
                c += a[2 * h_ :]
                np.tanh(c, out=c)
                h = h - c
                h *= zr[:h_]
                h += c
                if mask is not None:
                    h *= mask[:, k]
                hs[k, at] = h
        e = np.tanh(np.ascontiguousarray(p["Wa"].T) @ hs + p["ba"][:, None])
        s = np.einsum("a,tan->tn", p["va"], e)
        if mask is not None:
            s += (mask.T - 1) * 1e4
        s -= s.max(0)
        np.exp(s, out=s)
        return ((np.einsum("h,thn->tn", p["wo"], hs) * s).sum(0) / s.sum(0)) + p["bo"][0]

    def window_logits(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The logits of all windows of one text, given its words' rows of table."""
        w, mask = windows(ids)
        return self.logits(w, mask, table)


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """All windows of a text: every STRIDE words one of WINDOW words, the last at the end. A shorter text is padded."""
    n = len(ids)
    if n < WINDOW:
        mask = (np.arange(WINDOW) < n).astype(np.float32)
        return np.append(ids, np.zeros(WINDOW - n, ids.dtype))[None, :], mask[None, :]
    return ids[starts(n)[:, None] + np.arange(WINDOW)], None


def starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin."""
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def shifts(n: int, unsure: np.ndarray) -> np.ndarray:
    """Where further windows begin: at each word less than STRIDE away from a begin that is unsure, but for begins that starts() has."""
    at = np.unique((unsure[:, None] + np.arange(1 - STRIDE, STRIDE)).ravel())
    at = at[(at > 0) & (at < n - WINDOW)]
    return at[at % STRIDE > 0]


class Scorer:
    """Scores texts in batches; words' gate inputs are kept, up to CACHE words."""

    def __init__(self, net: Network):
        self.net, self.row, self.table = net, {}, np.zeros((0, 6 * HIDDEN), np.float32)

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in tokens if w not in self.row))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.fresh.append(self.net.inputs(new))
        return np.fromiter(map(self.row.__getitem__, tokens), np.int32, len(tokens))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each; 0 for a text without words."""
        out = np.zeros(len(texts))
        todo: list[tuple[int, np.ndarray, np.ndarray | None]] = []
        self.long: dict[int, np.ndarray] = {}
        held = 0
        if len(self.row) > CACHE:
            self.row, self.table = {}, self.table[:0]
        self.fresh = [self.table]
        for k, t in enumerate(texts):
            tokens = words(t)
            if tokens:
                ids = self.rows(tokens)
                w, mask = windows(ids)
                todo.append((k, w, mask))
                if len(ids) > WINDOW:
                    self.long[k] = ids
                held += len(w)
            if held >= 4 * BATCH:
                self.finish(todo, out)
                todo, held = [], 0
        self.finish(todo, out)
        return out

    def highest(self, owner: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, best: np.ndarray) -> np.ndarray:
        """The logits of windows; best, the highest of each owner, is brought up to date."""
        z = np.concatenate([self.net.logits(ids[a : a + BATCH], None if mask is None else mask[a : a + BATCH], self.table) for a in range(0, len(ids), BATCH)])
        np.maximum.at(best, owner, z)
        return z

    def finish(self, todo: list, out: np.ndarray) -> None:
        if len(self.fresh) > 1:
            self.table = np.concatenate(self.fresh)
            self.fresh = [self.table]
        best = np.full(len(out), -np.inf)
        for padded in (False, True):
            part = [x for x in todo if (x[2] is not None) == padded]
            if not part:
                continue
            owner = np.repeat([x[0] for x in part], [len(x[1]) for x in part])
            z = self.highest(owner, np.concatenate([x[1] for x in part]), np.concatenate([x[2] for x in part]) if padded else None, best)
            if padded:
                continue
            more, end = [], np.cumsum([len(x[1]) for x in part])
            for (k, w, _), e in zip(part, end.tolist(), strict=True):
                if k in self.long and UNSURE[0] < best[k] < UNSURE[1]:
                    words_ = self.long[k]
                    at = shifts(len(words_), starts(len(words_))[z[e - len(w) : e] > UNSURE[0]])
                    if len(at):
                        more.append((k, words_[at[:, None] + np.arange(WINDOW)]))
            if more:
                self.highest(np.repeat([k for k, _ in more], [len(w) for _, w in more]), np.concatenate([w for _, w in more]), None, best)
        hit = [x[0] for x in todo]
        out[hit] = 1 / (1 + np.exp(-np.clip(best[hit].astype(np.float64), -60, 60)))


def train(texts: list[str], y: np.ndarray, rounds: int = 8, batch: int = 128, rate: float = 0.01, decay: float = 3e-4, seed: int = 0) -> Network:
    """Learn from texts and their labels; see the module's text. Without texts of both labels, the bias alone."""
    rng = np.random.default_rng(seed)
    row: dict[bytes, int] = {}
    held = [np.fromiter((row.setdefault(w, len(row)) for w in words(t)), np.int32) for t in texts]
    keep = [k for k, x in enumerate(held) if len(x)]
    held, y = [held[k] for k in keep], np.asarray(y, np.float32)[keep]
    kinds = list(row)
    seen = np.bincount(np.concatenate([np.unique(x) for x in held] or [np.zeros(0, np.int32)]), minlength=len(kinds))
    frequent = sorted((-n, w) for w, n in zip(kinds, seen.tolist(), strict=True) if n >= LEAST_DOCS)
    net = Network([w for _, w in frequent[:MAX_WORDS]], seed)
    if len(y) < 8 or y.min() == y.max():
        net.p["wo"][:] = 0
        net.p["bo"][:] = 4.0 if len(y) and y.min() == 1 else -4.0
        return net
    wid = net.word_ids(kinds)
    tri, start = grams(kinds)
    end = np.append(start[1:], len(tri))
    # Windows are told by their text and begin, and cut out of all texts' words when they are needed.
    begins = [starts(len(x)) if len(x) >= WINDOW else np.zeros(1, np.int64) for x in held]
    count = np.array([len(x) for x in begins])
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    of = np.repeat(np.arange(len(y)), count)
    size = np.array([len(x) for x in held])
    flat, at = np.concatenate([*held, np.zeros(WINDOW, np.int32)]), (np.cumsum(size) - size)[of] + np.concatenate(begins)
    del held, begins

    def cut_out(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (np.arange(WINDOW)[None, :] < size[of[chosen]][:, None]).astype(np.float32)
        return np.where(mask > 0, flat[at[chosen][:, None] + np.arange(WINDOW)], 0), mask

    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    for k in range(rounds):
        lot = first + (rng.random(len(y)) * count).astype(np.int64)
        if k:
            table = np.concatenate([net.inputs(kinds[a : a + BATCH]) for a in range(0, len(kinds), BATCH)])
            z = np.concatenate([net.logits(*cut_out(np.arange(a, min(a + BATCH, len(of)))), table) for a in range(0, len(of), BATCH)])
            del table
            order = np.lexsort((z, of))
            top = order[np.append(np.nonzero(np.diff(of[order]))[0], len(of) - 1)]
            chosen = np.concatenate((top, lot[y == 0]))
        else:
            chosen = lot
        for _ in range(2):
            rng.shuffle(chosen)
            for a in range(0, len(chosen), batch):
                c = chosen[a : a + batch]
                ids, mask = cut_out(c)
                used, inner = np.unique(ids, return_inverse=True)
                wide = end[used] - start[used]
                begin = np.concatenate(([0], np.cumsum(wide)[:-1]))
                every = np.repeat(start[used] - begin, wide) + np.arange(wide.sum())
                # A third of the word inputs is hidden, so that characters are learnt as well.
                shown = np.where(rng.random(len(used)) < 1 / 3, 0, wid[used])
                _, d = net.gradients(inner.reshape(len(c), -1), mask, (shown, tri[every], begin), y[of[c]], weight[of[c]])
                step += 1
                for name, g in d.items():
                    g = g + decay * net.p[name]
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.99 * m2[name] + 0.01 * g * g
                    net.p[name] -= (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Network:
    """Train on a seeded sample of labelled texts, bounded by SAMPLE_DOCS for either label and SAMPLE_CHARS. labels: (doc_id, label).

    Null and empty texts, null ids and longer texts aren't learnt from; rows with the same id are learnt from each. The
    sample is a share of a hash of ids, so nothing is sorted and only sampled texts are gathered. Extra columns don't
    matter. Without texts of both labels the network's score is one number.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    # Which documents are drawn is decided on ids alone; their number is bounded, so the ids can be broadcast to the texts.
    known = cut(own.select("doc_id").join(labels, "doc_id"))
    drawn = cut(thin(known.where("label = 1"), SAMPLE_DOCS).union(thin(known.where("label = 0"), SAMPLE_DOCS)))
    got = own.join(F.broadcast(drawn.distinct()), "doc_id").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.label, r.text))
    return train([r.text for r in got], np.array([r.label for r in got]))


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds the score of each whole text, 0 to 1, one narrow stage. Null texts and texts without words score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            rows = texts.tolist()
            yield pd.Series(np.concatenate([scorer.score(rows[a : a + 512]) for a in range(0, len(rows), 512)] or [np.zeros(0)]))

    return docs.withColumn(out, judge(text))
