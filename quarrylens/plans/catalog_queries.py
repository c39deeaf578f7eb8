"""The fixed questions asked of a catalog. All inputs are catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.operators.quality import health_band

SEARCH_LIMIT = 20


def schema_explorer(tables: DataFrame, columns: DataFrame, dataset: str) -> DataFrame:
    """Tables of a dataset, each with its nested column list."""
    nested = (
        columns.where(F.col("dataset") == dataset)
        .groupBy("table_name")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("position", "column_name", "data_type", "description", "is_pii")
                )
            ).alias("column_list")
        )
    )
    return (
        tables.where(F.col("dataset") == dataset)
        .join(nested, "table_name", "left")
        .select("table_name", "row_count", "description", "column_list")
    )


def _contains(phrase: str, *columns: str) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.ilike(F.col(c), F.lit(f"%{phrase}%")), F.lit(False))
    return hit


def catalog_search(
    tables: DataFrame,
    columns: DataFrame,
    phrase: str,
    dataset: str | None = None,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """Columns whose own or whose table's name or description holds the phrase."""
    joined = columns.select(
        "dataset", "table_name", "column_id", "column_name", "data_type",
        F.col("description").alias("column_desc"),
    ).join(
        tables.select("dataset", "table_name", F.col("description").alias("table_desc")),
        ["dataset", "table_name"],
    )
    if dataset is not None:
        joined = joined.where(F.col("dataset") == dataset)
    return (
        joined.where(_contains(phrase, "column_name", "column_desc", "table_name", "table_desc"))
        .orderBy("dataset", "column_id")
        .limit(limit)
        .select("dataset", "table_name", "column_name", "data_type", "column_desc", "table_desc")
    )


def describe_table(tables: DataFrame, columns: DataFrame, dataset: str, table: str) -> DataFrame:
    """One row per column with the table's facts beside it; none if unknown."""
    wanted = (F.col("dataset") == dataset) & (F.col("table_name") == table)
    return (
        tables.where(wanted)
        .select("dataset", "table_name", "row_count", F.col("description").alias("table_desc"))
        .join(
            columns.where(wanted).select(
                "dataset", "table_name", "position", "column_name", "data_type",
                F.col("description").alias("column_desc"), "is_pii", "distinct_count", "null_count",
            ),
            ["dataset", "table_name"],
        )
    )


def describe_column(
    columns: DataFrame, table: str, column: str, dataset: str | None = None
) -> DataFrame:
    wanted = (F.col("table_name") == table) & (F.col("column_name") == column)
    if dataset is not None:
        wanted = wanted & (F.col("dataset") == dataset)
    return columns.where(wanted)


def list_relationships(relationships: DataFrame, dataset: str) -> DataFrame:
    return relationships.where(F.col("dataset") == dataset)


def list_quality(metrics: DataFrame, dataset: str, table: str | None = None) -> DataFrame:
    found = metrics.where(F.col("dataset") == dataset)
    return found if table is None else found.where(F.col("table_name") == table)


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias(name))


def dataset_summary(
    datasets: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    relationships: DataFrame,
    metrics: DataFrame,
) -> DataFrame:
    """Counts and mean health per dataset; only a missing mean becomes 100."""
    health = metrics.groupBy("dataset").agg(F.avg("health_score").alias("health"))
    joined = datasets.withColumnRenamed("name", "dataset")
    for part in (
        _counts(tables, "total_tables"),
        _counts(columns.join(tables.select("dataset", "table_name"), ["dataset", "table_name"]), "total_columns"),
        _counts(relationships, "relationships_found"),
        health,
    ):
        joined = joined.join(part, "dataset", "left")
    return joined.select(
        F.col("dataset").alias("name"),
        "type",
        "row_count",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("total_tables", "total_columns", "relationships_found")
        ],
        F.coalesce(F.round("health", 1), F.lit(100.0)).alias("health_score"),
    )


def glossary_search(glossary: DataFrame, phrase: str | None = None) -> DataFrame:
    found = glossary
    if phrase:
        found = glossary.where(_contains(phrase, "term", "definition", "business_meaning"))
    return found.orderBy("term")


def catalog_kpis(
    datasets: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    relationships: DataFrame,
    metrics: DataFrame,
    traces: DataFrame,
    dataset: str,
) -> DataFrame:
    """The dashboard numbers of one dataset, in one row."""
    own = F.col("dataset") == dataset

    def measure(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")

    rows = F.count(F.lit(1))
    parts = [
        measure(datasets, "total_datasets", rows),
        measure(tables.where(own), "total_tables", rows),
        measure(columns.where(own), "total_columns", rows),
        measure(relationships.where(own), "total_relationships", rows),
        measure(metrics.where(own), "health_score", F.coalesce(F.round(F.avg("health_score"), 1), F.lit(100.0))),
        measure(traces, "questions_handled", rows),
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    names = [
        ("total_datasets", "bigint"), ("total_tables", "bigint"), ("total_columns", "bigint"),
        ("total_relationships", "bigint"), ("health_score", "double"), ("questions_handled", "bigint"),
    ]
    return long.agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).cast(t).alias(n) for n, t in names]
    )


def catalog_coverage(tables: DataFrame, columns: DataFrame, dataset: str) -> DataFrame:
    """Share of columns with a description, in percent."""
    known = columns.where(F.col("dataset") == dataset).join(
        tables.select("dataset", "table_name"), ["dataset", "table_name"]
    )
    total = F.count(F.lit(1))
    described = F.count_if(F.col("description").isNotNull() & (F.col("description") != ""))
    return known.agg(described.alias("described_columns"), total.alias("total_columns")).select(
        "described_columns",
        "total_columns",
        F.when(
            F.col("total_columns") > 0,
            F.round(F.col("described_columns") / F.col("total_columns") * 100, 1),
        )
        .otherwise(0.0)
        .alias("coverage"),
    )


def tables_by_size(tables: DataFrame, dataset: str) -> DataFrame:
    return (
        tables.where(F.col("dataset") == dataset)
        .select("table_name", "row_count")
        .orderBy(F.col("row_count").desc(), "table_name")
    )


def table_health(metrics: DataFrame, dataset: str) -> DataFrame:
    return metrics.where(F.col("dataset") == dataset).select(
        "table_name", "health_score", health_band(F.col("health_score")).alias("band")
    )


def latest(log: DataFrame, order: str, size: int = 20) -> DataFrame:
    """The newest rows of a log; a bounded top-k, never a full sort."""
    return log.orderBy(F.col(order).desc()).limit(size)


def last_event(log: DataFrame, order: str) -> DataFrame:
    """The single newest row, as one aggregate; empty for an empty log."""
    newest = F.max_by(F.struct(*[F.col(c) for c in log.columns]), F.col(order))
    return log.agg(newest.alias("e")).where(F.col("e").isNotNull()).select("e.*")


def list_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.col("uploaded_at").desc(), "name")


def dataset_tables(tables: DataFrame, dataset: str) -> DataFrame:
    return tables.where(F.col("dataset") == dataset)


def tables_of_path(datasets: DataFrame, tables: DataFrame, path: str) -> DataFrame:
    """Table names cataloged for a source path."""
    return tables.join(
        datasets.where(F.col("file_path") == path).select(F.col("name").alias("dataset")), "dataset"
    ).select("table_name")


def explorer_view(columns: DataFrame, dataset: str) -> DataFrame:
    """Columns as the explorer shows them: three samples, a privacy label, counts."""
    return columns.where(F.col("dataset") == dataset).select(
        "table_name",
        "column_name",
        "data_type",
        F.concat_ws(", ", F.slice("sample_values", 1, 3)).alias("sample_text"),
        "null_count",
        "distinct_count",
        F.when(F.col("is_pii") == 1, "SENSITIVE").otherwise("PUBLIC").alias("pii_status"),
        "description",
    )


def relationship_view(relationships: DataFrame, dataset: str) -> DataFrame:
    return relationships.where(F.col("dataset") == dataset).select(
        F.concat_ws(".", "source_table", "source_column").alias("source_asset"),
        F.concat_ws(".", "target_table", "target_column").alias("target_asset"),
        F.col("type").alias("cardinality"),
        F.concat((F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias(
            "confidence_level"
        ),
        F.coalesce("join_suggestion", F.lit("N/A")).alias("join_suggestion"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


# Template texts for tables, columns and summaries.
TABLE_TEXT = "This table contains structured data records for %s including key indicators."
COLUMN_TEXT = "Business term representing %s identifier."


def template_table_text(name: Column) -> Column:
    return F.format_string(TABLE_TEXT, name)


def template_column_text(name: Column) -> Column:
    return F.format_string(COLUMN_TEXT, name)


def template_descriptions(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """A template description for every table and column of the catalog."""
    of_tables = tables.select(
        "dataset",
        "table_name",
        F.lit(None).cast("string").alias("column_name"),
        template_table_text(F.col("table_name")).alias("description"),
    )
    of_columns = columns.select(
        "dataset",
        "table_name",
        "column_name",
        template_column_text(F.col("column_name")).alias("description"),
    )
    return of_tables.unionByName(of_columns)


def quality_summary_text(metrics: DataFrame) -> DataFrame:
    """Summary lines of one table's quality record."""
    return metrics.select(
        "dataset",
        "table_name",
        F.format_string(
            "- Table **%s**:\n  - Health Score: **%s%%**\n  - Missing Values: %s\n"
            "  - Duplicate Rows: %s\n  - Outliers: %s\n  - Format Mismatches: %s",
            "table_name",
            F.col("health_score").cast("string"),
            *[
                F.col(c).cast("string")
                for c in ("missing_count", "duplicate_count", "outlier_count", "invalid_format_count")
            ],
        ).alias("summary"),
    )


def schema_overview_text(tables: DataFrame) -> DataFrame:
    """Table, number of columns and the first six column names."""
    names = F.concat(
        F.array_join(F.slice("columns", 1, 6), ", "),
        F.when(F.size("columns") > 6, "...").otherwise(""),
    )
    return tables.select(
        "dataset",
        "table_name",
        F.format_string(
            "- **%s** (%s columns: %s)", "table_name", F.size("columns").cast("string"), names
        ).alias("overview"),
    )


def column_list_text(columns: DataFrame) -> DataFrame:
    """One line per column: name, type and, where there is one, its description."""
    described = F.col("description").isNotNull() & (F.col("description") != "")
    return columns.select(
        "dataset",
        "table_name",
        "position",
        F.concat(
            F.format_string("- **%s** (%s)", "column_name", "data_type"),
            F.when(described, F.format_string(" — *%s*", "description")).otherwise(""),
        ).alias("line"),
    )


def dataset_row_count(tables: DataFrame) -> DataFrame:
    """Rows of a dataset: the sum over its tables."""
    return tables.groupBy("dataset").agg(F.sum("row_count").alias("row_count"))
