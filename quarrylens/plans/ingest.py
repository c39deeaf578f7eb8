"""From source tables to a filled catalog, step by step, each step whole-table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens import session
from quarrylens.operators import glossary, profile, quality, relations, search
from quarrylens.plans import catalog_queries
from quarrylens.plans.catalog import CatalogStore


# The catalog tables that ingestion fills, in order, each with those it is derived from.
# A dataset is listed once all the others are there.
PARTS: dict[str, tuple[str, ...]] = {
    "columns": (),
    "tables": ("columns",),
    "relationships": ("columns",),
    "quality_metrics": (),
    "glossary": ("columns",),
    "documents": ("columns", "tables", "relationships"),
}
PARTS["datasets"] = tuple(PARTS)


def with_sources(parts: Iterable[str]) -> list[str]:
    """The given parts and all they are derived from, in the order in which they are filled."""
    wanted = set(parts)
    for part in reversed(PARTS):
        if part in wanted:
            wanted |= set(PARTS[part])
    return [p for p in PARTS if p in wanted]


def complete_columns(profiled: DataFrame) -> dict[str, set[str]]:
    """Columns without nulls, per table: metadata, one entry per column."""
    found: dict[str, set[str]] = {}
    for row in profiled.where("null_count = 0").select("table_name", "column_name").collect():
        found.setdefault(row["table_name"], set()).add(row["column_name"])
    return found


def quality_records(details: DataFrame) -> DataFrame:
    """One nested record per table: score, counts, column details, recommendations.

    The nested lists have one entry per column, not per row.
    """
    entry = F.struct(
        "position", "column_name", "missing", "missing_percentage", "outliers", "invalid_formats"
    )
    per_column = details.where(F.col("row_count") > 0).groupBy("table_name").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    advice = (
        quality.recommendations(details)
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "recommendation"))).alias("advice"))
    )
    return (
        quality.health_scores(details)
        .join(per_column, "table_name", "left")
        .join(advice, "table_name", "left")
        .select(
            "table_name",
            "row_count",
            "health_score",
            "missing_count",
            "duplicate_count",
            "outlier_count",
            "invalid_format_count",
            F.transform("entries", lambda e: e.dropFields("position")).alias("details"),
            F.transform("advice", lambda a: a["recommendation"]).alias("recommendations"),
        )
    )


def ingest(
    store: CatalogStore,
    dataset: str,
    kind: str,
    path: str,
    tables: Mapping[str, DataFrame],
    *,
    order_by: Mapping[str, Sequence[str]] | None = None,
    now: datetime | None = None,
    approximate: bool = False,
    column_description: Column | None = None,
    parts: Iterable[str] = tuple(PARTS),
) -> None:
    """Profile, score, link, describe and index the tables of one dataset.

    Re-ingesting a dataset replaces everything it owns. The dataset row is
    written last, so a dataset is listed only once it is complete. `parts` names
    the catalog tables to fill where not all of them are wanted yet; what they are
    derived from (`PARTS`) has to be among them or in the store.
    """
    stamp = F.lit(now or datetime.now(timezone.utc)).cast("timestamp")
    owner = F.lit(dataset).alias("dataset")
    own, parts = F.col("dataset") == dataset, set(parts)

    if "columns" in parts:
        profiled = session.cut_lineage(
            profile.profile_columns(tables, approximate=approximate)
        )
        samples = profile.profile_samples(tables, order_by, complete=complete_columns(profiled))
        described = column_description
        if described is None:
            described = catalog_queries.template_column_text(F.col("column_name"))
        columns = profiled.join(samples, "column_id", "left").withColumns(
            {
                "dataset": owner,
                "description": described,
                "sample_values": F.coalesce("sample_values", F.array().cast("array<string>")),
            }
        )
        store.replace_dataset("columns", dataset, columns)
    columns = store.read("columns").where(own)

    if "tables" in parts:
        schemas = F.create_map(
            *[F.lit(x) for t, df in tables.items() for x in (t, df.schema.simpleString())]
        )
        per_table = (
            columns.groupBy("table_name")
            .agg(
                F.min("column_id").alias("first_id"),
                F.max("row_count").alias("row_count"),
                F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("c"),
            )
            .select(
                owner,
                "table_name",
                F.col("first_id").alias("position"),
                "row_count",
                catalog_queries.template_table_text(F.col("table_name")).alias("description"),
                F.transform("c", lambda x: x["column_name"]).alias("columns"),
                F.try_element_at(schemas, F.col("table_name")).alias("raw_schema"),
            )
        )
        store.replace_dataset("tables", dataset, per_table)

    if "relationships" in parts:
        found = relations.discover_relationships(columns, tables)
        store.replace_dataset("relationships", dataset, found.withColumn("dataset", owner))

    if "quality_metrics" in parts:
        details = session.cut_lineage(quality.column_details(tables))
        store.replace_dataset(
            "quality_metrics", dataset, quality_records(details).withColumn("dataset", owner)
        )

    terms = glossary.glossary_terms(columns)
    if "glossary" in parts:
        store.upsert("glossary", terms.withColumn("created_at", stamp))

    if "documents" in parts:
        store.replace_dataset(
            "documents",
            dataset,
            search.build_documents(
                store.read("tables").where(own),
                columns,
                store.read("relationships").where(own),
                terms.withColumn("dataset", owner),
            ),
        )
    if "datasets" in parts:
        total = store.read("tables").where(own).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))
        store.upsert(
            "datasets",
            total.select(
                F.lit(dataset).alias("name"),
                F.lit(kind).alias("type"),
                F.lit(path).alias("file_path"),
                "row_count",
                stamp.alias("uploaded_at"),
            ),
        )


def rebuild_documents(store: CatalogStore, dataset: str) -> DataFrame:
    """Documents of one dataset from the stored catalog, with every glossary term."""
    own = F.col("dataset") == dataset
    return search.build_documents(
        store.read("tables").where(own),
        store.read("columns").where(own),
        store.read("relationships").where(own),
        store.read("glossary").withColumn("dataset", F.lit(dataset)),
    )


def backfill_glossary(store: CatalogStore) -> None:
    """Propose terms for all stored columns; terms already there stay as they are."""
    terms = glossary.glossary_terms(
        store.read("columns").withColumn("place", F.struct("dataset", "column_id")), "place"
    )
    store.insert_missing("glossary", terms.withColumn("created_at", F.current_timestamp()))
