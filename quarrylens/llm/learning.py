"""Fit on a bounded sample in one task, apply everywhere: what the two
learners share."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common

_LETTERS = re.compile(r"[^\W\d_]+")
#: Distinct words that a worker keeps; beyond it starts anew (speed only).
CACHE_WORDS = 200_000


#: Characters of a word at most; longer runs are read in pieces that share OVERLAP.
WIDTH = 24
OVERLAP = 8


def letter_words(text: str) -> list[str]:
    """Runs of letters, lower-cased; longer ones in overlapping pieces. Numbers
    such as fractions and superscripts are no letters."""
    found = _LETTERS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    if max(map(len, found), default=0) <= WIDTH:
        return found
    step = WIDTH - OVERLAP
    return [w[i : i + WIDTH] for w in found for i in range(0, max(1, len(w) - OVERLAP), step)]


def bounded_sample(rows: DataFrame, label: str, per_label: int, seed: int = 7, counted: bool = False) -> DataFrame:
    """About `per_label` rows of each label (all, where there are fewer), chosen
    by a hash of doc_id; `counted` keeps n_label, the label's rows in the whole table."""
    counts = common.if_bounded(session.cut_lineage(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(counts, label).where(u * F.col("n_label") < per_label).drop(*[] if counted else ["n_label"])


def fit(sample: DataFrame, learn: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that `learn` makes of the whole (bounded) sample, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            out = io.BytesIO()
            pdf = pd.concat(parts).sort_values("doc_id", kind="stable").reset_index(drop=True)
            np.savez(out, **learn(pdf))
            yield pd.DataFrame({"model": [out.getvalue()]})

    rows = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return dict(np.load(io.BytesIO(rows[0]["model"]))) if rows else {}


def ngram_hashes(words: list[str], buckets: int) -> np.ndarray:
    """Hashed affixes (1 to 3 characters at either end) and character 2- and
    3-grams of each word (WIDTH characters at most) with its boundaries: (n, 2 WIDTH + 7) numbers from 1 to
    buckets - 1, 0 where a word has no more."""
    c = np.array([f"^{w}$" for w in words], dtype=f"U{WIDTH + 2}").view(np.uint32).reshape(len(words), WIDTH + 2).astype(np.uint64)
    n = (c > 0).sum(1)

    def mixed(parts: list[np.ndarray], kind: int) -> np.ndarray:
        h = np.full(parts[0].shape, kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for x in parts:
            h = (h ^ x) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(buckets - 1)).astype(np.int32) + 1

    two, three = mixed([c[:, :-1], c[:, 1:]], 1), mixed([c[:, :-2], c[:, 1:-1], c[:, 2:]], 2)
    two *= c[:, 1:] > 0
    three *= c[:, 2:] > 0
    rows = np.arange(len(words))
    ends = []
    for k in (1, 2, 3):
        long = n > k
        ends.append(mixed([c[:, i] for i in range(k + 1)], 3 + k) * long)
        ends.append(mixed([c[rows, np.maximum(n - 1 - i, 0)] for i in range(k + 1)], 6 + k) * long)
    return np.concatenate([np.stack(ends, 1), two, three], 1)


class WordRows:
    """Row numbers of words in a growing table; `make` yields the rows of new words."""

    def __init__(self, make: Callable[[list[str]], np.ndarray]) -> None:
        self.make, self.known = make, {}
        self.table = make([])

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, first = self.known, len(self.known)
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(first, first + len(new))))
            if len(known) > len(self.table):
                grown = np.zeros((2 * len(known), *self.table.shape[1:]), self.table.dtype)
                grown[:first] = self.table[:first]
                self.table = grown
            self.table[first : len(known)] = self.make(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def grouped(texts: Iterable[str | None], n_words: int) -> Iterator[tuple[list[str], list[int]]]:
    """Words of consecutive texts, about `n_words` at a time, and each text's number of them."""
    words: list[str] = []
    sizes: list[int] = []
    for text in texts:
        own = letter_words(text or "")
        words += own
        sizes.append(len(own))
        if len(words) >= n_words:
            yield words, sizes
            words, sizes = [], []
    if sizes:
        yield words, sizes
