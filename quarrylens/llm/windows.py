"""Passages of a small reference table inside documents: windows of words.

Shared by the license scan and the decontamination. Words are runs of letters
and digits, lower-cased, so case, punctuation and marks between words don't
hide a passage. Everything is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common

SHINGLE = 5


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def hashed(table: DataFrame, *keys: str, n: int = SHINGLE) -> DataFrame:
    """keys and h, the hashes of all n-word shingles by position.

    Don't filter on h before it is materialized or exploded (by an outer
    explode): a filter is pushed below and would split the text anew for each
    position.
    """
    t = table.select(*keys, plain_words(F.col("text")).alias("w"))
    return t.select(*keys, common.shingle_hashes("w", n).alias("h"))


def reference_shingles(reference: DataFrame, *keys: str) -> DataFrame:
    """x (hash), keys, at (its position) and m (shingles of the entry)."""
    return reference.select(*keys, F.size("h").alias("m"), F.posexplode("h").alias("at", "x"))


def positions(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, key (hash of the text), pos, x: one row per word position."""
    d = common.only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    return hashed(d, "doc_id", "key", n=n).select("doc_id", "key", F.posexplode_outer("h").alias("pos", "x"))


def cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The shingles of given windows: spans has doc_id, key, s (first shingle)
    and m; the result adds h. Only documents with a window are hashed again."""
    by_doc = common.if_bounded(
        session.cut_lineage(spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "m")).alias("spans")))
    )
    d = common.only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    d = d.join(by_doc, (d["doc_id"].eqNullSafe(by_doc["doc_id"])) & (d["key"] == by_doc["key"])).select(
        d["doc_id"], d["key"], "text", "spans"
    )
    h = hashed(d, "doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    h = h.select("doc_id", "key", "h", F.explode("spans").alias("span"))
    return h.select("doc_id", "key", "span.s", "span.m", F.expr("slice(h, span.s + 1, span.m)").alias("h"))


def shared_weight(a: str, b: str) -> Column:
    """Sum over shingles of the lesser count in the two arrays."""
    plain = f"size(array_intersect({a}, {b}))"
    counted = (
        f"aggregate(array_intersect({a}, {b}), 0, (acc, x) -> acc + "
        f"least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    )
    single = f"size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b})"
    return F.expr(f"CASE WHEN {single} THEN {plain} ELSE {counted} END")
