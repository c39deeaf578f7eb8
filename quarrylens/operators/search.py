"""Searchable documents of a catalog, token search and vector search."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quarrylens.functions import masking, text as text_rules, values
from quarrylens.operators.profile import union_all

SUBSTRING_BOOST = 0.2
# Queries that share a scan; more take further scans.
TOKEN_BLOCK = 100
VECTOR_BLOCK = 1000
# Vectors of a task that are measured at once, pairs of which the exact distance is taken
# at once, and the share of the lengths by which a matrix product may be off.
VECTOR_SLICE, PAIRS_AT_ONCE, ROUGH = 1024, 100_000, 1e-9
MEASURED = "__vector"


def build_documents(
    tables: DataFrame, columns: DataFrame, relationships: DataFrame, glossary: DataFrame
) -> DataFrame:
    """Documents of the four kinds: tables, columns, relationships, terms.

    Inputs are catalog tables; `glossary` carries the dataset it is indexed for.
    """
    no_text = F.lit("")
    ids = F.format_string
    table_docs = tables.select(
        ids("ds_%s_tbl_%s", "dataset", "table_name").alias("doc_id"),
        F.lit("table").alias("doc_type"),
        "dataset",
        "table_name",
        F.format_string(
            "Table Name: %s\nDescription: %s\nColumns: %s",
            "table_name",
            F.coalesce("description", no_text),
            F.array_join("columns", ", "),
        ).alias("text"),
    )
    column_docs = columns.select(
        ids("ds_%s_col_%s_%s", "dataset", "table_name", "column_name").alias("doc_id"),
        F.lit("column").alias("doc_type"),
        "dataset",
        "table_name",
        F.format_string(
            "Column Name: %s\nTable: %s\nData Type: %s\nPrivacy: %s\nDescription: %s",
            "column_name",
            "table_name",
            "data_type",
            masking.pii_label(F.col("is_pii") == 1),
            F.coalesce("description", no_text),
        ).alias("text"),
    )
    relationship_docs = relationships.select(
        ids("ds_%s_rel_%s", "dataset", F.col("position").cast("string")).alias("doc_id"),
        F.lit("relationship").alias("doc_type"),
        "dataset",
        F.col("source_table").alias("table_name"),
        F.format_string(
            "Relationship: Table %s links to %s on keys (%s -> %s). "
            "Confidence: %s. Type: %s. Details: %s",
            "source_table",
            "target_table",
            "source_column",
            "target_column",
            F.col("confidence").cast("string"),
            "type",
            F.coalesce("reason", no_text),
        ).alias("text"),
    )
    term_docs = glossary.select(
        ids("ds_%s_glossary_%s", "dataset", "term").alias("doc_id"),
        F.lit("glossary").alias("doc_type"),
        "dataset",
        F.lit(None).cast("string").alias("table_name"),
        F.format_string(
            "Glossary Term: %s\nDefinition: %s\nBusiness Meaning: %s\nUsage Context: %s",
            "term",
            F.coalesce("definition", no_text),
            F.coalesce("business_meaning", no_text),
            F.coalesce("business_usage", no_text),
        ).alias("text"),
    )
    return union_all([table_docs, column_docs, relationship_docs, term_docs])


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def ranked(hits: DataFrame, score: Column, keys: Sequence[str], k: int) -> DataFrame:
    """The k first hits per query. The rank filter becomes a per-task group
    limit ahead of the shuffle, so a query's hits never gather unbounded."""
    order = W.partitionBy("query_id").orderBy(score, *keys)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_rows(df: DataFrame, group: Sequence[str], key: str, k: int) -> DataFrame:
    """The k first rows by key of each group, limited per task ahead of the shuffle."""
    if not group:
        return df.orderBy(quoted_key(key)).limit(k)
    order = W.partitionBy(*group).orderBy(quoted_key(key))
    return df.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


def token_search(
    documents: DataFrame,
    queries: Sequence[str],
    *,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    where: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Best k documents per query by token overlap, in one scan for a block of queries.

    Score: share of the query's distinct tokens found among the document's
    tokens, plus 0.2 for every query token that occurs as a substring. A query
    without tokens finds nothing. `where` scopes the documents before ranking.
    """
    scoped = documents if where is None else documents.where(where)
    prepared = scoped.select(quoted_key(key), *keep, F.lower(text).alias("__lower"))
    blocks = [
        _token_block(prepared, queries[at : at + TOKEN_BLOCK], at, key, k, keep)
        for at in range(0, max(len(queries), 1), TOKEN_BLOCK)
    ]
    return union_all(blocks).withColumn("distance", F.round(1.0 - F.col("score"), 3))


def _token_block(
    prepared: DataFrame, queries: Sequence[str], first: int, key: str, k: int, keep: Sequence[str]
) -> DataFrame:
    """Best k documents of each query of one block, numbered from `first`."""
    scores = []
    for number, query in enumerate(queries, first):
        tokens = query_words(query)
        if not tokens:
            continue
        inside = [f"contains(__lower, {values.literal(t)})" for t in tokens]
        # A token of the document is an occurrence with no word character on
        # either side; the plain substring test spares most texts the pattern.
        found = [
            f"CAST({c} AND __lower RLIKE {values.literal(text_rules.whole_word(t))} AS INT)"
            for c, t in zip(inside, tokens)
        ]
        boost = " + ".join(f"CAST({c} AS INT)" for c in inside)
        scores.append(
            f"struct({number} AS query_id, ({' + '.join(found)}) / {len(tokens)} "
            f"+ {SUBSTRING_BOOST}D * ({boost}) AS score)"
        )
    if not scores:
        scores = ["struct(0 AS query_id, 0D AS score)"]
        prepared = prepared.where(F.lit(False))
    hits = prepared.select(key, *keep, F.expr(f"inline(array({', '.join(scores)}))"))
    return ranked(hits, F.col("score").desc(), [key], k)


def quoted_key(key: str) -> Column:
    return F.col(f"`{key}`")


def vector_knn(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    where: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Nearest k vectors per query vector by squared Euclidean distance.

    `queries` has columns query_id (each once) and query_vector. They are dealt
    by a hash of the id to blocks of about VECTOR_BLOCK; a block is sent to every task
    and measured against its vectors by matrix products, so there is no join, and only
    k rows per query and slice are shuffled, fewer as a task goes on. `where` is
    applied before ranking. Without a distance (a null, another length) a vector comes first.
    """
    scoped = vectors if where is None else vectors.where(where)
    scoped = scoped.select(quoted_key(key), *[quoted_key(c) for c in keep], quoted_key(vector).alias(MEASURED))
    queries = queries.select("query_id", F.col("query_vector").cast("array<double>"))
    n_blocks = max(1, -(-queries.count() // VECTOR_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    result = T.StructType([*scoped.schema.fields[:-1], queries.schema["query_id"], T.StructField("distance", T.DoubleType())])
    found = [
        scoped.mapInArrow(_VectorBlock(queries.where(block == b).toArrow(), key, k), result) for b in range(n_blocks)
    ]
    return ranked(union_all(found), F.col("distance"), [key], k)


def first_places(query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are among the k first of their query by `order`, in what place;
    equal ones in the order they are in."""
    at = np.lexsort((np.arange(len(query)), order, query))
    place = np.arange(len(at)) - np.searchsorted(query[at], query[at])
    return at[place < k], place[place < k]


class _VectorBlock:
    """Distances of vectors to one block of query vectors, inside a task."""

    def __init__(self, queries: pa.Table, key: str, k: int):
        self.key, self.k = key, k
        self.ids = queries["query_id"].combine_chunks()
        listed = queries["query_vector"].to_pylist()
        # -1: nothing has a distance to it
        lengths = np.array([-1 if v is None or None in v else len(v) for v in listed], dtype=int)
        self.groups = [
            (int(n), np.flatnonzero(lengths == n), np.array([v for v, m in zip(listed, lengths) if m == n and n >= 0], dtype=float))
            for n in np.unique(lengths)
        ]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(self.ids), self.k), np.inf)  # so far in this task
        for batch in batches:
            # equal distances go by key, in the order Spark has
            batch = batch.take(pc.array_sort_indices(batch.column(self.key), null_placement="at_start"))
            for start in range(0, batch.num_rows, VECTOR_SLICE):
                rows = batch.slice(start, VECTOR_SLICE)
                for n, own, points in self.groups:
                    yield from self._measured(rows, n, own, points, best)

    def _measured(self, rows: pa.RecordBatch, n: int, own: np.ndarray, points: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = rows.column(MEASURED)
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        values = column.flatten()
        broken = np.zeros(len(column), dtype=bool)
        if values.null_count:
            broken[pc.list_parent_indices(column).to_numpy().astype(int)[pc.is_null(values).to_numpy(zero_copy_only=False)]] = True
        whole = (lengths == n) & ~broken if n >= 0 else np.zeros(len(column), dtype=bool)
        without = np.flatnonzero(~whole)[: self.k]
        if len(without):
            place, query = np.tile(without, len(own)), np.repeat(own, len(without))
            yield self._rows(rows, place, query, pa.nulls(len(place), pa.float64()))
        at = np.flatnonzero(whole)
        if not len(at):
            return
        vectors = pc.cast(column.take(pa.array(at)).flatten(), pa.float64()).to_numpy().reshape(len(at), n)
        with np.errstate(invalid="ignore", over="ignore"):
            size = (vectors**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)
            rough = size - 2 * (vectors @ points.T)
            slack = ROUGH * size  # far above the error of the products
            most = best[own, -1]
            if len(at) > self.k:  # the k least of the slice bound what can be among its first
                most = np.minimum(most, np.nan_to_num(np.partition(rough + slack, self.k - 1, axis=0)[self.k - 1], nan=np.inf))
            place, query = np.nonzero(~(rough - slack > most))
            distance = np.empty(len(place))
            for part in range(0, len(place), PAIRS_AT_ONCE):
                some = slice(part, part + PAIRS_AT_ONCE)
                gaps = (vectors[place[some]] - points[query[some]]) ** 2
                # summed from the first to the last component
                distance[some] = np.cumsum(gaps, axis=1)[:, -1] if n else 0.0
        kept, rank = first_places(query, distance, self.k)
        place, query, distance = place[kept], own[query[kept]], distance[kept]
        added = np.full_like(best, np.inf)
        added[query, rank] = np.nan_to_num(distance, nan=np.inf, posinf=np.inf)
        best[:] = np.sort(np.concatenate([best, added], axis=1), axis=1)[:, : self.k]
        yield self._rows(rows, at[place], query, pa.array(distance))

    def _rows(self, rows: pa.RecordBatch, place: np.ndarray, query: np.ndarray, distance: pa.Array) -> pa.RecordBatch:
        names = [c for c in rows.schema.names if c != MEASURED]
        own = [rows.column(c).take(pa.array(place)) for c in names]
        return pa.RecordBatch.from_arrays([*own, self.ids.take(pa.array(query)), distance], names=[*names, "query_id", "distance"])


def hit_sources(hits: DataFrame) -> DataFrame:
    """Distinct tables behind the hits of each query."""
    return hits.where(F.col("table_name").isNotNull()).select("query_id", "table_name").distinct()


def schema_context(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table, its structure as prompt-ready text; never any values."""
    flag = F.when(F.col("is_pii") == 1, " (PII - SENSITIVE)").otherwise("")
    line = F.format_string(
        "  - %s (%s)%s: %s", "column_name", "data_type", flag, F.coalesce("description", F.lit(""))
    )
    return _with_lines(tables, columns, line).select(
        "dataset",
        "table_name",
        F.format_string(
            "Table: %s\nDescription: %s\nColumns:\n%s",
            "table_name",
            F.coalesce("description", F.lit("")),
            "lines",
        ).alias("context"),
    )


def schema_context_with_samples(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The variant with row counts and three (masked) samples per column."""
    line = F.format_string(
        "  - %s (%s): %s | Samples: [%s]",
        "column_name",
        "data_type",
        F.coalesce("description", F.lit("")),
        F.array_join(F.slice("sample_values", 1, 3), ", "),
    )
    return _with_lines(tables, columns, line).select(
        "dataset",
        "table_name",
        F.format_string(
            "Table: %s (Row count: %s, Description: %s)\n%s",
            "table_name",
            F.col("row_count").cast("string"),
            F.coalesce("description", F.lit("")),
            "lines",
        ).alias("context"),
    )


def _with_lines(tables: DataFrame, columns: DataFrame, line: Column) -> DataFrame:
    lines = (
        columns.select("dataset", "table_name", F.struct("position", line.alias("line")).alias("l"))
        .groupBy("dataset", "table_name")
        .agg(F.array_sort(F.collect_list("l")).alias("l"))
        .select(
            "dataset",
            "table_name",
            F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"),
        )
    )
    return tables.join(lines, ["dataset", "table_name"])
