"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves. Independent k-means
codebooks of the halves span a grid of cells; a vector lives in the cell of its
two nearest centroids. It visits cells in the order of the summed distances of
its halves (multi-sequence traversal: the cell of ranks a and b can be among
the first m only if (a + 1)(b + 1) <= m), and as many of them as it takes for
the target recall: on the sample, so many cells hold a partner made to lie
exactly at the threshold. A pair is verified if either end visits the other's
cell, so the recall of links is above the target, and the cosine is computed in
double precision.

Equal vectors are one class beforehand. Work is dealt by rows of the grid, rows
in blocks of bounded size, so a cell that holds a third of all vectors is many
tasks. A block pair counts links and emits one link per vector and class it is
connected with there, not one per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import learning
from quarrylens.llm.components import connected_components

#: Vectors that the codebooks and the number of visits are fitted on, by a hash of the id.
SAMPLE = 10_000
TARGET_RECALL = 0.97
CELL_VECTORS = 32
MOST_CENTROIDS = 256
MEMBERS, VISITORS = 1024, 2048


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(12):
        near = _distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1) if x.shape[1] else c
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _half_distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return _distances(x[:, :h], books[0]), _distances(x[:, h:], books[1])


def codebooks(vectors: np.ndarray, k: int, cosine: float, seed: int = 11) -> dict[str, np.ndarray]:
    """first, second: the centroids; visits: cells to visit for the target recall."""
    rng = np.random.default_rng(seed)
    x = _unit(vectors.astype(np.float64))
    h = x.shape[1] // 2
    books = _k_means(x[:, :h], k, rng), _k_means(x[:, h:], k, rng)
    q = x[:2000]
    u = rng.standard_normal(q.shape)
    u -= (u * q).sum(1, keepdims=True) * q
    u /= np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-12)
    d1, d2 = _half_distances(q, books)
    p1, p2 = _half_distances(cosine * q + np.sqrt(1 - cosine**2) * u, books)
    at = np.arange(len(q))
    own = d1[at, p1.argmin(1)] + d2[at, p2.argmin(1)]
    rank = np.array([(a[:, None] + b[None, :] < o - 1e-12).sum() for a, b, o in zip(d1, d2, own)])
    visits = int(np.quantile(rank, TARGET_RECALL, method="higher")) + 1
    return {"first": books[0], "second": books[1], "visits": np.array(visits)}


def traverse(x: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector and the first `visits` cells of its traversal."""
    d1, d2 = _half_distances(x, (model["first"], model["second"]))
    k1, k2 = d1.shape[1], d2.shape[1]
    o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
    home = o1[:, 0] * k2 + o2[:, 0]
    m = min(int(model["visits"]), k1 * k2)
    a, b = np.meshgrid(np.arange(k1), np.arange(k2), indexing="ij")
    fits = (a + 1) * (b + 1) <= m
    a, b = a[fits], b[fits]
    rows = np.arange(len(x))[:, None]
    i, j = o1[:, a], o2[:, b]
    total = d1[rows, i] + d2[rows, j]
    first = np.argpartition(total, m - 1, 1)[:, :m] if m < total.shape[1] else np.tile(np.arange(total.shape[1]), (len(x), 1))
    return home, i[rows, first] * k2 + j[rows, first]


def _placed(model: dict[str, np.ndarray], spark):
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("home int, cells array<int>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        homes, cells = [], []
        for at in range(0, len(vectors), 256):
            h, c = traverse(_unit(np.stack(vectors[at : at + 256]).astype(np.float64)), sent.value)
            homes.append(h)
            cells += list(c.astype(np.int32))
        return pd.DataFrame({"home": np.concatenate(homes).astype(np.int32), "cells": pd.Series(cells, dtype=object)})

    return place


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _block_pair(k2: int, cosine: float):
    def links(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        """Weighted link counts (other null) and one link per vector to its component."""
        if not len(members) or not len(visitors):
            return pd.DataFrame({"id": [], "n": [], "other": []}).astype({"id": np.int64, "n": np.int64, "other": "Int64"})
        x = _unit(np.stack(members["vec"]).astype(np.float64))
        q = _unit(np.stack(visitors["vec"]).astype(np.float64))
        mid, vid = members["id"].to_numpy(np.int64), visitors["id"].to_numpy(np.int64)
        mw, vw = members["w"].to_numpy(np.int64), visitors["w"].to_numpy(np.int64)
        column = members["home"].to_numpy(np.int64) % k2
        goes = np.zeros((len(q), k2), bool)
        sizes = visitors["js"].map(len).to_numpy()
        goes[np.repeat(np.arange(len(q)), sizes), np.concatenate(visitors["js"].to_list()).astype(np.int64)] = True
        ends = []
        for j in np.unique(column):
            vs, ms = np.flatnonzero(goes[:, j]), np.flatnonzero(column == j)
            r, c = np.nonzero(q[vs] @ x[ms].T >= cosine)
            ends.append((vs[r], ms[c]))
        v, m = (np.concatenate(e) for e in zip(*ends))
        other = vid[v] != mid[m]
        v, m = v[other], m[other]
        homes, home_of = np.unique(visitors["home"].to_numpy(np.int64), return_inverse=True)
        mutual = np.zeros((len(x), len(homes)), bool)
        for i in np.unique(m):
            mutual[i] = np.isin(homes, members["cells"].iloc[i])
        one_way = ~mutual[m, home_of[v]]
        n_v = np.bincount(v, mw[m], len(q))
        n_m = np.bincount(m[one_way], vw[v[one_way]], len(x))
        label = _roots(len(q) + len(x), v, m + len(q))
        ids = np.concatenate([vid, mid])
        hung = np.flatnonzero(label != np.arange(len(ids)))
        out = {
            "id": np.concatenate([vid, mid, ids[hung]]),
            "n": np.concatenate([n_v, n_m, np.zeros(len(hung))]).astype(np.int64),
            "other": pd.array(np.concatenate([np.zeros(len(ids), np.int64), ids[label[hung]]]), dtype="Int64"),
        }
        out["other"][: len(ids)] = pd.NA
        out = pd.DataFrame(out)
        return out[(out["n"] > 0) | out["other"].notna()]

    return links


def _linked(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """id, n, other for the classes of one dimension."""
    spark = classes.sparkSession
    n = classes.count()
    k = int(np.clip(round((n / CELL_VECTORS) ** 0.5), 1, MOST_CENTROIDS))
    sample = classes.select(F.col("id").alias("doc_id"), "vec", F.lit(0).alias("all"))
    model = learning.fit(
        learning.bounded_sample(sample, "all", SAMPLE),
        lambda pdf: codebooks(np.stack(pdf["vec"]), k, cosine),
    )
    if not model:
        # a sample by hash may miss all of a handful of vectors
        model = learning.fit(sample, lambda pdf: codebooks(np.stack(pdf["vec"]), k, cosine))
    k2 = len(model["second"])
    placed = session.cut_lineage(classes.withColumn("p", _placed(model, spark)("vec")).select("id", "w", "vec", "p.home", "p.cells"))
    members = placed.withColumn("i", F.expr(f"home div {k2}"))
    visitors = placed.select(
        *[F.col(c).alias(c) for c in placed.columns], F.explode(F.array_distinct(F.transform("cells", lambda c: F.floor(c / k2)))).alias("i")
    ).withColumn("js", F.expr(f"transform(filter(cells, c -> c div {k2} = i), c -> c % {k2})")).drop("cells")
    # blocks of each row of the grid; at most MOST_CENTROIDS rows
    blocks = (
        members.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("mb"))
        .join(visitors.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("vb")), "i")
    )
    blocks = F.broadcast(session.cut_lineage(blocks))
    m = members.join(blocks, "i").select(
        "id", "w", "vec", "home", "cells", "i", F.pmod(F.xxhash64("id"), "mb").alias("mb"), F.explode(F.expr("sequence(0, vb - 1)")).alias("vb")
    )
    v = visitors.join(blocks, "i").select(
        "id", "w", "vec", "home", "js", "i", F.explode(F.expr("sequence(0, mb - 1)")).alias("mb"), F.pmod(F.xxhash64("id"), "vb").alias("vb")
    )
    by = ["i", "mb", "vb"]
    return m.groupBy(*by).cogroup(v.groupBy(*by)).applyInPandas(_block_pair(k2, cosine), "id long, n long, other long")


def similar_vectors(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `embeddings`.

    n_links counts the other rows of cosine >= `cosine`. Null, empty and zero
    vectors and those with null or non-finite components link with nothing, nor
    do vectors of different length. Rows that repeat a vec_id are one node of
    the link graph; with a null vec_id a row has no links, no component, and is
    not kept. Labels and other columns are not read.
    """
    e = embeddings.select(embeddings["vec_id"], embeddings["embedding"].alias("vec"))
    finite = "forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)"
    rows = session.cut_lineage(e.withColumn("ok", F.expr(f"coalesce(vec_id IS NOT NULL AND {finite}, false)")))
    classes = session.cut_lineage(
        rows.where("ok").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"))
    )
    parts = [
        session.cut_lineage(_linked(classes.where(F.size("vec") == r["d"]), r["d"], cosine))
        for r in classes.select(F.size("vec").alias("d")).distinct().orderBy("d").collect()
    ]
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
    else:
        found = rows.sparkSession.createDataFrame([], "id long, n long, other long")
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("other IS NOT NULL").select("id", "other"), "id", "other")
    c = classes.join(counts, "id", "left").join(labels, F.col("id") == F.col("node"), "left").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"),
        F.lit(True).alias("ok"),
    )
    out = rows.join(c, ["ok", "vec"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
