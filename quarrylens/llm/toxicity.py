"""Toxicity of whole texts by a bidirectional gated recurrent network.

A word enters as the sum of its own vector (words of the training vocabulary)
and the mean of its character n-gram and affix vectors. Two gated recurrent
layers read a window of WINDOW words from either end; attention pools their
states, and a linear layer gives the window's log-odds. A text is read in all
its windows, STRIDE apart and overlapping; it is as toxic as its most toxic
window, and a logistic curve over that gives the score. The curve is fitted on
the training texts, each weighted by its label's rows in the whole table over
those in the sample, so that a score stands for the table's share of toxic texts.

Training is numpy only: backpropagation through time, Adam, over a bounded
sample. A toxic text need not be toxic throughout, so after a first epoch only
the window that scores highest stands for it; others teach that they are clean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common, learning

DOCS_PER_LABEL = 1500
#: Windows of a text that enter the training sample at most, spread over it.
WINDOWS_PER_DOC = 12
WINDOW, STRIDE = 48, 40
HIDDEN, INPUT = 8, 12
GRAMS = 1 << 14
VOCABULARY = 30_000
EPOCHS = 5
#: Steps that a small sample is trained for at least; more epochs then.
LEAST_STEPS = 300
GROUP_WORDS = 60_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_gru(x: np.ndarray, live: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, n, H) of one direction. x (T, n, 3H): projected inputs of the
    update, reset and candidate; live (T, n, 1): 0 beyond a window's end."""
    t, n, three = x.shape
    k = three // 3
    h, out, steps = np.zeros((n, k), x.dtype), np.empty((t, n, k), x.dtype), []
    for i in range(t):
        hu = h @ u
        zr = hu[:, : 2 * k] + x[i, :, : 2 * k]
        np.tanh(np.multiply(zr, 0.5, out=zr), out=zr)  # the logistic function by tanh
        zr += 1
        zr *= 0.5
        z, r = zr[:, :k], zr[:, k:]
        c = r * hu[:, 2 * k :]
        c += x[i, :, 2 * k :]
        np.tanh(c, out=c)
        new = c - h
        new *= live[i] * (1 - z)
        new += h
        if keep:
            steps.append((h, z, r, c, hu[:, 2 * k :]))
        h = out[i] = new
    return out, steps


def back_gru(d_out: np.ndarray, live: np.ndarray, u: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u, for those of the states."""
    t, n, h_size = d_out.shape
    dx, du, dh = np.empty((t, n, 3 * h_size), d_out.dtype), np.zeros_like(u), np.zeros((n, h_size), d_out.dtype)
    for i in range(t - 1, -1, -1):
        h, z, r, c, hu = steps[i]
        dh = dh + d_out[i]
        g = dh * live[i]
        dc = g * (1 - z) * (1 - c * c)
        dz = g * (h - c) * z * (1 - z)
        dr = dc * hu * r * (1 - r)
        dx[i] = np.concatenate([dz, dr, dc], 1)
        dhu = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ dhu
        dh = dh - g * (1 - z) + dhu @ u.T
    return dx, du


def attend(states: np.ndarray, live: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the windows, attention weights and pooled states."""
    e = states @ p["v"] + (live[:, :, 0] - 1) * 1e4
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ p["w"] + p["c"], a, pooled


def new_parameters(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    two, h = 2 * HIDDEN, HIDDEN
    normal = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
    return {
        "words": normal(n_words + 1, INPUT, k=0.1), "grams": normal(GRAMS, INPUT, k=0.1),
        "wf": normal(INPUT, 3 * h), "wb": normal(INPUT, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
        "uf": normal(h, 3 * h), "ub": normal(h, 3 * h), "v": normal(two), "w": normal(two), "c": np.zeros(1, np.float32),
    }


def loss_and_gradients(p: dict, word: np.ndarray, grams: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Mean log loss of windows and its gradients. ids (n, T) are rows of `word`
    (vocabulary numbers) and `grams` (n-gram numbers), -1 beyond the end."""
    live = (ids >= 0).T[:, :, None].astype(p["wf"].dtype)
    used, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape).T
    g = grams[used]
    n_grams = np.maximum((g > 0).sum(1), 1)[:, None].astype(p["wf"].dtype)
    vec = p["words"][word[used]] + (p["grams"][g] * (g > 0)[:, :, None]).sum(1) / n_grams
    x = vec[at]
    xf, xb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
    hf, sf = run_gru(xf, live, p["uf"], True)
    hb, sb = run_gru(xb[::-1], live[::-1], p["ub"], True)
    states = np.concatenate([hf, hb[::-1]], 2)
    odds, a, pooled = attend(states, live, p)
    prob = _sigmoid(odds)
    loss = -(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum()
    d = weight * (prob - y)
    grad = {"w": pooled.T @ d, "c": d.sum(keepdims=True)}
    d_pooled = d[:, None] * p["w"]
    from_pool = np.einsum("nh,tnh->tn", d_pooled, states)
    d_e = a * (from_pool - (a * from_pool).sum(0))
    grad["v"] = np.einsum("tn,tnh->h", d_e, states)
    d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * p["v"]
    dxf, grad["uf"] = back_gru(d_states[:, :, :HIDDEN], live, p["uf"], sf)
    dxb, grad["ub"] = back_gru(d_states[::-1, :, HIDDEN:], live[::-1], p["ub"], sb)
    dxb = dxb[::-1]
    dx = dxf @ p["wf"].T + dxb @ p["wb"].T
    for k, d3 in (("f", dxf), ("b", dxb)):
        grad[f"w{k}"] = np.tensordot(x, d3, ([0, 1], [0, 1]))
        grad[f"b{k}"] = d3.sum((0, 1))
    dv = np.stack([np.bincount(at.ravel(), dx[:, :, k].ravel(), len(used)) for k in range(INPUT)], 1)
    rows = word[used]
    grad["words"] = (rows, dv)
    grad["grams"] = (g, dv / n_grams)
    return loss, grad


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.rate, self.n = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, grad: dict) -> None:
        self.n += 1
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grad.items():
            if k in ("words", "grams"):
                rows, dv = g
                flat = rows.reshape(len(dv), -1)
                live = flat.ravel() > 0
                touched, at = np.unique(flat.ravel()[live], return_inverse=True)
                per = np.repeat(dv, flat.shape[1], axis=0)[live]
                g = np.stack([np.bincount(at, per[:, j], len(touched)) for j in range(dv.shape[1])], 1).astype(np.float32)
            else:
                touched, g = slice(None), g.astype(np.float32)
            m = self.m[k][touched] = 0.9 * self.m[k][touched] + 0.1 * g
            s = self.s[k][touched] = 0.999 * self.s[k][touched] + 0.001 * g * g
            p[k][touched] -= self.rate * fix * m / (np.sqrt(s) + 1e-8)


def starts(n: int) -> list[int]:
    """First words of a text's windows; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def learn(pdf: pd.DataFrame, seed: int = 5) -> dict[str, np.ndarray]:
    """text, toxic and n_label (rows of that label in the whole table)."""
    rng = np.random.default_rng(seed)
    texts = [learning.letter_words(t or "") for t in pdf["text"]]
    toxic = pdf["toxic"].to_numpy(np.float64)
    of_label = pdf["n_label"].to_numpy(np.float64)
    weight = of_label / pdf.groupby("toxic")["toxic"].transform("size").to_numpy()
    seen = Counter(w for t in texts for w in set(t))
    kept = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    number = {w: i + 1 for i, w in enumerate(kept)}
    windows, owner = [], []
    for i, t in enumerate(texts):
        at = starts(len(t))
        if len(at) > WINDOWS_PER_DOC:
            at = sorted(rng.choice(at, WINDOWS_PER_DOC, replace=False))
        for s in at if t else []:
            windows.append(t[s : s + WINDOW])
            owner.append(i)
    owner = np.array(owner, np.int64)
    row: dict[str, int] = {}
    ids = np.full((len(windows), WINDOW), -1, np.int64)
    for j, w in enumerate(windows):
        ids[j, : len(w)] = [row.setdefault(x, len(row)) for x in w]
    every = list(row)
    word = np.array([number.get(w, 0) for w in every] + [0], np.int64)
    grams = np.concatenate([learning.ngram_hashes(every, GRAMS), np.zeros((1, 2 * learning.WIDTH + 7), np.int32)])
    p = new_parameters(len(kept), rng)
    p["words"][0] = 0
    adam = Adam(p, 0.01)
    share = float(np.clip(toxic.mean(), 0.01, 0.99)) if len(toxic) else 0.5
    p["c"][:] = np.log(share / (1 - share))
    best = np.ones(len(windows), bool)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // max(1, len(windows) // 256)))):
        odds = np.zeros(len(windows))
        use = np.flatnonzero(best | (toxic[owner] == 0)) if len(windows) else np.zeros(0, np.int64)
        for at in np.array_split(rng.permutation(use), max(1, len(use) // 256)) if len(use) else []:
            _, grad = loss_and_gradients(p, word, grams, ids[at], toxic[owner[at]], np.full(len(at), 1 / len(at)))
            adam.step(p, grad)
        # from here on a toxic text is its most toxic window
        inputs = _inputs(p, word, grams)
        for at in np.array_split(np.arange(len(windows)), max(1, len(windows) // 2048)) if len(windows) else []:
            odds[at] = _odds(p, inputs, ids[at])
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, odds)
        best = odds >= top[owner]
    at = np.isfinite(top)
    scale, shift = _calibrated(top[at], toxic[at], weight[at])
    share = float((weight * toxic).sum() / weight.sum()) if len(toxic) else 0.5
    f, b = p["wf"], p["wb"]
    model = {k: p[k] for k in ("words", "grams", "uf", "ub", "v", "w", "c", "bf", "bb")}
    return model | {"wf": f, "wb": b, "curve": np.array([scale, shift, share]), "kept": np.array(kept, dtype="U")}


def _calibrated(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression on one variable."""
    x, weight = np.array([1.0, 0.0]), weight / max(weight.sum(), 1e-9)

    def loss(a: float, b: float) -> float:
        z = a * odds + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * (a - 1) ** 2

    for _ in range(200 if len(y) else 0):
        q = _sigmoid(x[0] * odds + x[1])
        g = np.array([(weight * (q - y) * odds).sum() + 1e-3 * (x[0] - 1), (weight * (q - y)).sum()])
        s = weight * q * (1 - q)
        h = np.array([[(s * odds * odds).sum() + 1e-3, (s * odds).sum()], [(s * odds).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        # a full step overshoots where the curve is flat
        while loss(*(x - step)) > loss(*x) and np.abs(step).max() > 1e-9:
            step = step / 2
        x = x - step
    return max(x[0], 0.05), x[1]


def _inputs(p: dict, word: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Projected inputs of both directions, (rows, 6H), one row per distinct word."""
    out = np.empty((len(word), 6 * HIDDEN), np.float32)
    both = np.concatenate([p["wf"], p["wb"]], 1)
    zero = p["grams"].copy()
    zero[0] = 0  # row 0 stands for nothing
    for at in range(0, len(word), 4096):
        g = grams[at : at + 4096]
        total = np.zeros((len(g), INPUT), np.float32)
        for column in g.T:
            total += zero[column]
        vec = p["words"][word[at : at + 4096]] + total / np.maximum((g > 0).sum(1), 1)[:, None]
        out[at : at + 4096] = vec @ both + np.concatenate([p["bf"], p["bb"]])
    return out


def _odds(p: dict, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-odds of windows given as rows of projected inputs, -1 beyond the end."""
    live = (ids >= 0).T[:, :, None].astype(np.float32)
    rows = np.maximum(ids, 0).T
    hf, _ = run_gru(x[rows, : 3 * HIDDEN], live, p["uf"], False)
    hb, _ = run_gru(x[rows[::-1], 3 * HIDDEN :], live[::-1], p["ub"], False)
    return attend(np.concatenate([hf, hb[::-1]], 2), live, p)[0]


def _scorer(model: dict[str, np.ndarray]):
    number = {w: i + 1 for i, w in enumerate(model["kept"].tolist())}
    scale, shift, share = model["curve"]

    def make(words: list[str]) -> np.ndarray:
        word = np.array([number.get(w, 0) for w in words], np.int64)
        return _inputs(model, word, learning.ngram_hashes(words, GRAMS))

    cache = learning.WordRows(make)

    def score(words: list[str], sizes: list[int]) -> np.ndarray:
        rows = cache.rows(words)
        firsts, owner = [], []
        at = 0
        for i, n in enumerate(sizes):
            own = starts(n) if n else []
            firsts += [(at + s, min(n, WINDOW)) for s in own]
            owner += [i] * len(own)
            at += n
        top = np.full(len(sizes), -np.inf)
        if firsts:
            first, length = np.array(firsts, np.int64).T
            place = np.arange(WINDOW)
            ids = np.where(place < length[:, None], rows[np.minimum(first[:, None] + place, len(rows) - 1)], -1)
            odds = np.concatenate([_odds(model, cache.table, ids[k : k + 2048]) for k in range(0, len(ids), 2048)])
            np.maximum.at(top, owner, odds)
        return np.where(np.isfinite(top), _sigmoid(scale * np.where(np.isfinite(top), top, 0.0) + shift), share)

    return score


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL) -> dict[str, np.ndarray]:
    """Fit on about `per_label` texts of either label outside the held-out fold.
    A doc_id labelled twice takes its higher label; null labels are none."""
    y = labels.select(labels["doc_id"], labels["toxic"]).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = common.only(docs, "doc_id", "text").where(~common.held_out(F.col("doc_id")) & F.col("text").isNotNull())
    ids = learning.bounded_sample(d.select("doc_id").join(y, "doc_id"), "toxic", per_label, counted=True)
    ids = common.if_bounded(session.cut_lineage(ids.dropDuplicates(["doc_id"])))
    return learning.fit(d.join(ids, "doc_id").select("doc_id", "text", "toxic", "n_label"), learn)


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`.

    Texts without a word (null and empty ones too) get the share of toxic texts
    among all labelled ones outside the held-out fold; with nothing to learn from, all scores are 0. Only `text`
    enters a score; repeated rows get equal ones."""
    d = docs.select(docs["doc_id"], docs["text"])
    if model:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = _scorer(sent.value)
            for texts in batches:
                parts = [score(*group) for group in learning.grouped(texts, GROUP_WORDS)]
                yield pd.Series(np.concatenate([np.zeros(0), *parts]))

        d = d.select("doc_id", scored("text").alias("score"))
    else:
        d = d.select("doc_id", F.lit(0.0).alias("score"))
    return d.select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
