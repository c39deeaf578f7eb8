"""Scrubbing, token search and vector search against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import text
from quarrylens.operators import search

TEXTS = [
    "write to jane.doe@example.com or +1 (555) 010-1234 now",
    "card 1234-5678-9012-3456 and ssn 123-45-6789",
    "no personal data, only 12 numbers 123",
    "a@b.c then 555.010.9999x and 555 010 9999",
    "",
    "été naïve Straße 漢字 x_y",
]


def test_scrub_order_and_hits(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(9, None)], "k int, t string")
    rows = df.select(
        "k", text.scrubbed(F.col("t")).alias("s"), *[text.hit_count(F.col("t"), k).alias(k) for k in text.SCRUB_PATTERNS]
    ).orderBy("k").collect()
    for row, raw in zip(rows, TEXTS):
        want = raw
        for pattern, label in text.SCRUB_PATTERNS.values():
            want = re.sub(pattern, label, want)
        assert row["s"] == want
        for kind, (pattern, _) in text.SCRUB_PATTERNS.items():
            assert row[kind] == len(re.findall(pattern, raw)), (raw, kind)
    assert rows[-1]["s"] is None and rows[-1]["email"] == 0


def test_redaction(spark):
    df = spark.createDataFrame([("GET ?key=ab-1_c&x TOKEN9",), (None,)], "m string")
    got = [r[0] for r in df.select(text.redacted_secrets(F.col("m"), ["TOKEN9", ""])).collect()]
    assert got == ["GET ?key=[REDACTED]&x [REDACTED_API_KEY]", ""]


def plain_hits(docs, query, k):
    tokens = set(re.findall(r"\w+", query.lower()))
    if not tokens:
        return []
    scored = []
    for key, doc in docs:
        words = set(re.findall(r"\w+", doc.lower()))
        score = len(tokens & words) / len(tokens) + 0.2 * sum(t in doc.lower() for t in tokens)
        scored.append((-score, key))
    return [(key, round(1 + s, 3)) for s, key in sorted(scored)[:k]]


def test_token_search(spark):
    docs = list(enumerate(TEXTS + ["Card cards CARD_1 card", "x_y z", "strasse straße été"]))
    queries = ["card number", "ÉTÉ straße", "x_y", "?!", "no such token at all", "555 010"]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    rows = search.token_search(df, queries, k=4).orderBy("query_id", "rank").collect()
    for number, query in enumerate(queries):
        got = [r for r in rows if r["query_id"] == number]
        want = plain_hits(docs, query, 4)
        assert [r["doc_id"] for r in got] == [key for key, _ in want], query
        assert [r["distance"] for r in got] == pytest.approx([d for _, d in want], abs=0.0011)


def test_scope_is_applied_before_ranking(spark):
    df = spark.createDataFrame([(0, "alpha", "x"), (1, "beta", "y"), (2, "gamma", "y")], "doc_id int, text string, ds string")
    got = search.token_search(df, ["alpha"], k=2, where=F.col("ds") == "y").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]
    assert search.token_search(df, ["..."]).collect() == []


def test_more_queries_than_a_block(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} both") for i in range(6)], "doc_id int, text string")
    points = df.selectExpr("doc_id AS vec_id", "array(float(doc_id), 1F) AS embedding")
    asked = points.selectExpr("vec_id AS query_id", "embedding AS query_vector")
    queries = [f"w{i}" for i in range(6)]
    once = search.token_search(df, queries, k=2).collect(), search.vector_knn(points, asked, k=2).collect()
    monkeypatch.setattr(search, "TOKEN_BLOCK", 4)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 2)
    split = search.token_search(df, queries, k=2).collect(), search.vector_knn(points, asked, k=2).collect()
    assert [sorted(map(tuple, x)) for x in split] == [sorted(map(tuple, x)) for x in once]
    assert len(split[0]) == len(split[1]) == 12


def test_knn(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(200, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in p], i % 4) for i, p in enumerate(points)], "vec_id int, embedding array<float>, label int")
    queries = df.where("vec_id IN (3, 9)").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    rows = search.vector_knn(df, queries, k=5, where=F.col("label") != 1).orderBy("query_id", "rank").collect()
    allowed = [i for i in range(200) if i % 4 != 1]
    for q in (3, 9):
        gaps = {i: float(((points[i].astype(float) - points[q].astype(float)) ** 2).sum()) for i in allowed}
        want = sorted(gaps, key=lambda i: (gaps[i], i))[:5]
        assert [r["vec_id"] for r in rows if r["query_id"] == q] == want


def test_rankings_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    plan = search.token_search(df, ["1", "2"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_knn_by_matrix_products(spark):
    """Many equal distances, vectors far from the origin, and odd ones."""
    rng = np.random.default_rng(4)
    points = rng.integers(0, 3, size=(3000, 4)) / 8 + 1e4
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows[::-1], "vec_id int, embedding array<float>").coalesce(2)
    queries = df.where("vec_id % 300 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    hits = search.vector_knn(df, queries, k=5)
    assert "MapInArrow" in hits._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in hits.collect())
    held = points.astype("float32").astype(float)
    want = []
    for q in range(0, 3000, 300):
        gaps = ((held - held[q]) ** 2).cumsum(axis=1)[:, -1]
        want += [(q, n + 1, int(i), float(gaps[i])) for n, i in enumerate(np.lexsort((np.arange(3000), gaps))[:5])]
    assert got == want
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [1.0, 4.0])], df.schema)
    asked = odd.where("vec_id IN (1, 2)").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], str(r["distance"])) for r in search.vector_knn(odd, asked, k=6).collect())
    assert [x[2:] for x in found[:6]] == [(2, "None"), (3, "None"), (5, "None"), (1, "0.0"), (6, "4.0"), (4, "nan")]
    assert [x[2:] for x in found[6:]] == [(i, "None") for i in range(1, 7)]
