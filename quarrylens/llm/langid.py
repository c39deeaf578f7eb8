"""Language of code-switched text by a linear-chain conditional random field.

Each word has a label, a language. Its features are affixes, character n-grams
and membership in the languages' lexicons, hashed to a fixed number of weights
for each label; transitions between labels are learned with them. Training
maximizes the conditional likelihood of label sequences (forward-backward,
Adagrad) over a bounded sample; half of the sequences join stretches of two
documents, so that switches are seen. A text is cut into chains of CHAIN words;
forward-backward gives every word its label probabilities, and the document
gets the language with the highest mean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm import common, learning

DOCS_PER_LANG = 400
#: Words of a document that enter the training sample at most, in chains spread over it.
CHAINS_PER_DOC = 6
CHAIN = 48
BUCKETS = 1 << 16
#: Rows of the weights that stand for lexicons, row 0 for nothing.
LEXICA = 64
LEXICON = 300
GROUP_WORDS = 100_000
UNKNOWN = "und"


def word_features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """(n, features) weight rows of each word, 0 for none: the first LEXICA rows
    are the lexicons, the rest hashed affixes, n-grams and lexicon words."""
    grams = learning.ngram_hashes(words, BUCKETS - LEXICA)
    bits = np.fromiter((lexicon.get(w, 0) for w in words), np.uint64, len(words))
    own = np.fromiter((crc32(w.encode()) % (BUCKETS - LEXICA - 1) + 1 if lexicon.get(w) else 0 for w in words), np.int32, len(words))
    member = (bits[:, None] >> np.arange(LEXICA - 1, dtype=np.uint64)) & np.uint64(1)
    listed = (member * np.arange(1, LEXICA, dtype=np.uint64)).astype(np.int32)
    listed = listed[:, : max(1, int(bits.max()).bit_length() if len(words) else 1)]
    hashed = np.concatenate([own[:, None], grams], 1)
    return np.concatenate([listed, np.where(hashed > 0, hashed + LEXICA - 1, 0)], 1)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word marginals (n, T, L), expected transitions (L, L), log partition (n).

    Chains are left-aligned in `emit`; what lies beyond a length is ignored."""
    n, t, k = emit.shape
    peak = emit.max(2, keepdims=True)
    e = np.exp(emit - peak)
    m = np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((n, t), e.dtype)
    alpha[:, 0] = e[:, 0] / k
    scale[:, 0] = alpha[:, 0].sum(1)
    alpha[:, 0] /= scale[:, 0, None]
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        s = a.sum(1)
        alpha[:, i], scale[:, i] = a / s[:, None], s
    live = np.arange(t) < lengths[:, None]
    for i in range(t - 2, -1, -1):
        b = (e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None]) @ m.T
        beta[:, i] = np.where(live[:, i + 1, None], b, 1.0)
    gamma = alpha * beta * live[:, :, None]
    right = e[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * live[:, 1:, None]
    expected = np.einsum("nti,ntj->ij", alpha[:, :-1], right) * m
    return gamma, expected, ((np.log(scale) + peak[:, :, 0]) * live).sum(1)


def learn(pdf: pd.DataFrame, seed: int = 3) -> dict[str, np.ndarray]:
    """weights (BUCKETS, L), trans (L, L), langs, and the lexicon as words and bit sets."""
    rng = np.random.default_rng(seed)
    langs = sorted(pdf["lang"].unique())
    number = {x: i for i, x in enumerate(langs)}
    chains: list[tuple[list[str], int]] = []
    counts = [Counter() for _ in langs]
    for text, lang in zip(pdf["text"], pdf["lang"]):
        words = learning.letter_words(text or "")
        starts = list(range(0, len(words), CHAIN))
        if len(starts) > CHAINS_PER_DOC:
            starts = sorted(rng.choice(starts, CHAINS_PER_DOC, replace=False))
        for s in starts:
            chains.append((words[s : s + CHAIN], number[lang]))
            counts[number[lang]].update(words[s : s + CHAIN])
    lexicon: dict[str, int] = {}
    for i, c in enumerate(counts[: LEXICA - 1]):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << i
    vocabulary = sorted({w for words, _ in chains for w in words})
    row = {w: i for i, w in enumerate(vocabulary)}
    feats = word_features(vocabulary, lexicon)
    sequences = []
    order = rng.permutation(len(chains))
    for i, c in enumerate(order):
        words, lang = chains[c]
        ids, labels = [row[w] for w in words], [lang] * len(words)
        if i % 2 and len(chains) > 1:
            other, lang2 = chains[order[rng.integers(len(order))]]
            a, b = rng.integers(1, len(words) + 1), rng.integers(1, len(other) + 1)
            ids = (ids[:a] + [row[w] for w in other[:b]])[:CHAIN]
            labels = (labels[:a] + [lang2] * b)[:CHAIN]
        if ids:
            sequences.append((ids, labels))
    k = len(langs)
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    gw, gt = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    for epoch in range(4):
        for at in range(0, len(sequences), 128):
            batch = sequences[at : at + 128]
            lengths = np.array([len(s) for s, _ in batch])
            t = int(lengths.max())
            ids = np.full((len(batch), t), -1)
            gold = np.zeros((len(batch), t, k))
            true_steps = np.zeros((k, k))
            for j, (s, y) in enumerate(batch):
                ids[j, : len(s)] = s
                gold[j, np.arange(len(s)), y] = 1
                np.add.at(true_steps, (y[:-1], y[1:]), 1)
            emit = weights[feats[ids]].sum(2)
            gamma, expected, _ = forward_backward(emit, lengths, trans)
            f = feats[ids[ids >= 0]]
            err = (gold - gamma)[ids >= 0] / len(batch)
            flat, per = f.ravel(), np.repeat(err, feats.shape[1], axis=0)
            grad = np.stack([np.bincount(flat, per[:, y], BUCKETS) for y in range(k)], 1) - 1e-6 * weights
            grad[0] = 0
            gw += grad**2
            weights += 0.3 * grad / np.sqrt(gw)
            grad = (true_steps - expected) / len(batch) - 1e-4 * trans
            gt += grad**2
            trans += 0.1 * grad / np.sqrt(gt)
    words = sorted(lexicon)
    return {
        "weights": weights.astype(np.float32), "trans": trans.astype(np.float32), "langs": np.array(langs, dtype="U64"),
        "words": np.array(words, dtype="U"), "bits": np.array([lexicon[w] for w in words], np.uint64),
    }


def _emissions(weights: np.ndarray, words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for at in range(0, len(words), 4096):
        some = words[at : at + 4096]
        for column in word_features(some, lexicon).T:
            out[at : at + 4096] += weights[column]
    return out


def _tagger(model: dict[str, np.ndarray]):
    lexicon = dict(zip(model["words"].tolist(), map(int, model["bits"])))
    weights = model["weights"]
    cache = learning.WordRows(lambda words: _emissions(weights, words, lexicon))

    def tag(words: list[str], sizes: list[int], k: int) -> np.ndarray:
        """Mean word marginals of each text."""
        lengths = np.array([min(CHAIN, n - s) for n in sizes for s in range(0, n, CHAIN)], np.int64)
        owner = np.repeat(np.arange(len(sizes)), [-(-n // CHAIN) for n in sizes])
        means = np.zeros((len(sizes), k))
        if words:
            at = cache.rows(words)
            emit = np.zeros((len(lengths), CHAIN, k), np.float32)
            emit[np.arange(CHAIN) < lengths[:, None]] = cache.table[at]
            gamma, _, _ = forward_backward(emit, lengths, model["trans"])
            np.add.at(means, owner, gamma.sum(1))
            means /= np.maximum(sizes, 1)[:, None]
        return means

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs = model["langs"].tolist()
        for texts in batches:
            means = np.zeros((0, len(langs)))
            for words, sizes in learning.grouped(texts, GROUP_WORDS):
                means = np.concatenate([means, tag(words, sizes, len(langs))])
            best = means.argmax(1)
            score = np.minimum(means[np.arange(len(means)), best], 1.0)
            yield pd.DataFrame({"lang_pred": [langs[b] if s > 0 else UNKNOWN for b, s in zip(best, score)], "score": score})

    return run


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> dict[str, np.ndarray]:
    """Fit on about `per_lang` documents of each lang outside the held-out fold."""
    d = common.only(docs, "doc_id", "text", "lang")
    d = d.where(~common.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return learning.fit(learning.bounded_sample(d, "lang", per_lang), learn)


def _prediction(model: dict[str, np.ndarray], spark):
    if not model:
        return lambda text: F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _tagger(sent.value)(batches)

    return predict


def identify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of `docs`.

    Null texts and texts without a letter are `und` with score 0, as is
    everything where there was nothing to learn from. The score is the mean
    probability of the predicted language over the words. Only `text` enters a
    prediction; repeated rows get equal results."""
    d = docs.select(docs["doc_id"], docs["text"])
    p = d.select("doc_id", _prediction(model, docs.sparkSession)(F.col("text")).alias("p"))
    return p.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: dict[str, np.ndarray], least: float = 0.3) -> DataFrame:
    """Rows of `docs`, columns unchanged, whose language is known: neither `und`
    nor under a mean probability of `least`."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    p = row.select("row", _prediction(model, docs.sparkSession)(F.col("row.text")).alias("p"))
    p = p.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least))
    return p.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
