"""Database sources over Spark's JDBC reader. The driver jar comes with the cluster."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Queries that list the user tables of a database.
TABLE_LISTINGS = {
    "sqlite": "SELECT name AS table_name FROM sqlite_master "
    "WHERE type = 'table' AND name NOT LIKE 'sqlite_%'",
    "postgresql": "SELECT table_name FROM information_schema.tables "
    "WHERE table_schema = 'public' AND table_type = 'BASE TABLE'",
}


def dialect(url: str) -> str:
    parts = url.split(":")
    if len(parts) < 3 or parts[0] != "jdbc" or parts[1] not in TABLE_LISTINGS:
        raise ValueError(f"unsupported JDBC url: {url}")
    return parts[1]


def table_options(
    url: str,
    table: str,
    *,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Reader options of one table; with a split column the scan runs in parallel."""
    quote = "`" if dialect(url) == "sqlite" else '"'
    options = {
        "url": url,
        "dbtable": f"{quote}{table}{quote}",
        "fetchsize": str(fetch_rows),
    }
    if split_column is not None and bounds is not None:
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def list_tables(spark: SparkSession, url: str, credentials: Mapping[str, str] | None = None) -> list[str]:
    listing = (
        spark.read.format("jdbc")
        .options(url=url, query=TABLE_LISTINGS[dialect(url)], **(credentials or {}))
        .load()
    )
    return sorted(r["table_name"] for r in listing.collect())


def database_tables(
    spark: SparkSession,
    url: str,
    credentials: Mapping[str, str] | None = None,
    splits: Mapping[str, tuple[str, int, int]] | None = None,
) -> dict[str, DataFrame]:
    """Every user table as a lazy DataFrame, whole; `splits` gives
    (column, lower, upper) for tables to be read in parallel."""
    tables = {}
    for table in list_tables(spark, url, credentials):
        split = (splits or {}).get(table)
        options = table_options(
            url,
            table,
            split_column=split[0] if split else None,
            bounds=split[1:] if split else None,
        )
        tables[table] = (
            spark.read.format("jdbc").options(**options, **(credentials or {})).load()
        )
    return tables
