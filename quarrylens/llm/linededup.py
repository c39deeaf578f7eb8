"""Repeated lines by a sharded minimal perfect hash that documents probe.

One map-side combined aggregation finds the line keys that enough documents
hold. Their hashes are dealt to shards of bounded size; each shard gets a
minimal perfect hash (bit levels: a key goes to the first level where nothing
else hits its bit, and the rank of the bit is its slot), beside which lie arrays
of fingerprints, document counts and last holders. Documents probe the arrays
with the hashes of their lines; no line is joined, and texts stay in the JVM.

An index of at most `index_bytes` is sent to the workers at a time. What is
larger is probed in several passes over the table, `index_bytes` each, with the
same result. A wrong hit would need a clash in both 64-bit hashes of a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common

SHARD_LINES = 1 << 16
INDEX_BYTES = 64 << 20
NO_ID = -(1 << 63)

_SHARD = (
    "shard int, n long, sizes array<long>, bits binary, prints binary, counts binary, lasts binary, bytes long"
)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 finisher (public constants), another function for each level."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LineIndex:
    """Shards of bit levels and arrays, looked up for many hashes at once."""

    def __init__(self, n_shards: int, rows: list) -> None:
        deepest = max((len(r["sizes"]) for r in rows), default=0)
        self.n_shards = n_shards
        self.first = np.zeros((n_shards, deepest), np.int64)
        self.bits = np.zeros((n_shards, deepest), np.uint64)
        self.base = np.zeros(n_shards, np.int64)
        words, word_at, slot_at = [], 0, 0
        for r in rows:
            own = np.frombuffer(r["bits"], np.uint64)
            at = word_at
            for level, size in enumerate(r["sizes"]):
                self.first[r["shard"], level], self.bits[r["shard"], level] = at, size
                at += size // 64
            self.base[r["shard"]] = slot_at - int(sum(np.bitwise_count(w).sum(dtype=np.int64) for w in words))
            words.append(own)
            word_at, slot_at = at, slot_at + r["n"]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        arrays = [np.concatenate([np.frombuffer(r[k], kind) for r in rows]) if rows else np.zeros(0, kind)
                  for k, kind in (("prints", np.int64), ("counts", np.int64), ("lasts", np.int64))]
        self.prints, self.counts, self.lasts = arrays

    @staticmethod
    def build(shard: int, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> dict:
        left, owners = h1.view(np.uint64), np.arange(len(h1))
        sizes, words, order = [], [], []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            order.append(owners[alone][np.argsort(at[alone])])
            left, owners = left[~alone], owners[~alone]
        slots = np.concatenate(order) if order else np.zeros(0, np.int64)
        blobs = {
            "bits": np.concatenate(words).tobytes() if words else b"",
            "prints": h2[slots].astype(np.int64).tobytes(),
            "counts": counts[slots].astype(np.int64).tobytes(),
            "lasts": lasts[slots].astype(np.int64).tobytes(),
        }
        return {"shard": shard, "n": len(h1), "sizes": sizes, **blobs, "bytes": sum(map(len, blobs.values()))}

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each line, -1 where the index doesn't hold it."""
        found = np.full(len(h1), -1, np.int64)
        keys = h1.view(np.uint64)
        shard = (keys % np.uint64(self.n_shards)).astype(np.int64)
        todo = np.arange(len(h1))
        for level in range(self.first.shape[1]):
            size = self.bits[shard[todo], level]
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            at = (_mixed(keys[todo], level) % size).astype(np.int64)
            word = self.first[shard[todo], level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            below = np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            slot = self.ranks[w] + below + self.base[shard[todo[hit]]]
            same = self.prints[slot] == h2[todo[hit]]
            found[todo[hit][same]] = slot[same]
            todo = todo[~hit]
        return found


def line_key(line: Column) -> Column:
    return common.ascii_lower(F.btrim(line, F.lit(common.BLANKS)))


def with_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """row (all columns of docs), lines, and two hashes of each line (0 for short keys)."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    d = d.withColumn("lines", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n"))
    d = d.withColumn("keys", F.transform("lines", line_key))
    long = lambda seed: F.transform(
        "keys", lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(F.lit(seed), k)).otherwise(F.lit(0).cast("long"))
    )
    return d.select("row", "lines", long(1).alias("h1"), long(2).alias("h2"))


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h1, h2, n_docs, last: line keys held by at least `min_docs` documents. Rows of
    one doc_id are one document, and so are all rows without an id."""
    own = with_lines(docs, min_chars).select(
        F.coalesce(F.col("row.doc_id"), F.lit(NO_ID)).alias("doc_id"),
        F.explode_outer(F.array_distinct(F.arrays_zip("h1", "h2"))).alias("h"),
    ).where("h.h1 <> 0").distinct()
    return (
        own.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
        .where(F.col("n_docs") >= min_docs)
    )


def build_index(lines: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: bit levels and arrays as binaries."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n_docs", "last")]
        return pd.DataFrame([LineIndex.build(int(key[0]), *cols)])

    unsigned = F.pmod(F.conv(F.hex("h1"), 16, 10).cast("decimal(20,0)"), F.lit(n_shards))
    return lines.withColumn("shard", unsigned.cast("int")).groupBy("shard").applyInPandas(one, _SHARD)


def _probe(spark, n_shards: int, rows: list):
    sent = spark.sparkContext.broadcast((n_shards, [r.asDict() for r in rows]))

    @F.pandas_udf("array<boolean>")
    def drops(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        index = LineIndex(*sent.value)
        for h1, h2, doc in batches:
            sizes = h1.map(len).to_numpy()
            a, b = (np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64) for s in (h1, h2))
            slot = index.find(a, b)
            last = index.lasts[slot] if len(index.lasts) else slot
            flags = (slot >= 0) & (last != np.repeat(doc.to_numpy(np.int64), sizes))
            yield pd.Series(np.split(flags, np.cumsum(sizes)[:-1]), dtype=object)

    return drops


def _passes(index: DataFrame, index_bytes: int) -> list[list[int]]:
    """Shards by pass; only their sizes reach the driver here."""
    out, room = [[]], index_bytes
    for r in index.select("shard", "bytes").orderBy("shard").toLocalIterator():
        if out[-1] and r["bytes"] > room:
            out, room = [*out, []], index_bytes
        out[-1].append(r["shard"])
        room -= r["bytes"]
    return out


def _dropping(docs: DataFrame, min_chars: int, min_docs: int, index_bytes: int) -> DataFrame:
    """row, lines, kept (the lines that stay)."""
    spark = docs.sparkSession
    lines = session.cut_lineage(repeated_lines(docs, min_chars, min_docs))
    n_shards = max(1, -(-lines.count() // SHARD_LINES))
    index = session.cut_lineage(build_index(lines, n_shards))
    d = with_lines(docs, min_chars).withColumn("drop", F.transform("h1", lambda h: F.lit(False)))
    passes = _passes(index, index_bytes)
    for i, shards in enumerate(passes):
        if i:
            d = session.cut_lineage(d)
        rows = index.where(F.col("shard").between(shards[0], shards[-1])).collect() if shards else []
        hit = _probe(spark, n_shards, rows)("h1", "h2", F.coalesce("row.doc_id", F.lit(NO_ID)))
        d = d.withColumn("hit", hit)
        d = d.withColumn("drop", F.col("hit") if not i else F.zip_with("drop", "hit", lambda x, y: x | y)).drop("hit")
    return d.select("row", "lines", F.filter("lines", lambda x, i: ~F.get("drop", i)).alias("kept"))


def deduplicate_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """The rows and columns of `docs`, with repeated lines taken out of `text`.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys
    of at least `min_chars` code points in at least `min_docs` rows keep their
    lines only in the largest doc_id that holds them (all of them there, and in
    each row that repeats this id). A row counts once for a key however often
    it holds it. Null texts stay null, as do empty ones; a row without a doc_id
    counts, but never is the last holder if a row with one is.
    """
    d = _dropping(docs, min_chars, min_docs, index_bytes)
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    return d.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_report(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row; same rules. A null
    or empty text has one empty line."""
    d = _dropping(common.only(docs, "doc_id", "text"), min_chars, min_docs, index_bytes)
    return d.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )
