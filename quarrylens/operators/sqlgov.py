"""Logged SQL checked against the catalog, and governed queries over tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.functions import masking, questions, values
from quarrylens.operators import lineage
from quarrylens.operators.profile import Tables

MAX_ROWS = 50
NO_TABLE = "Could not extract any tables from the generated SQL query."
UNKNOWN_TABLE = "Table '%s' referenced in SQL does not exist in the dataset catalog."
UNKNOWN_COLUMN = "Column '%s' does not exist on table '%s'."


def sql_table_refs(log: DataFrame, key: str = "sql_id", sql: str = "sql_text") -> DataFrame:
    """One row per logged statement and table it names."""
    return log.select(key, F.explode(questions.table_references(F.col(sql))).alias("table_name"))


def sql_log_check(
    log: DataFrame, columns: DataFrame, key: str = "sql_id", sql: str = "sql_text"
) -> DataFrame:
    """(key, is_valid, message): tables must be cataloged, and `table.column`
    pairs on a named table must exist.

    The catalog (one entry per table) enters as one constant, which no row carries,
    so the log is checked in a single pass without a shuffle.
    """
    listed = (
        columns.groupBy(F.lower("table_name").alias("t"))
        .agg(
            F.first("table_name").alias("name"),
            F.collect_set(F.lower("column_name")).alias("cols"),
        )
        .collect()
    )
    entries = [
        f"{values.literal(r['t'])}, struct({values.literal(r['name'])} AS name, "
        f"CAST(array({', '.join(map(values.literal, sorted(r['cols'])))}) AS array<string>) AS cols)"
        for r in listed
    ]
    catalog = F.expr(f"map({', '.join(entries)})").cast("map<string,struct<name:string,cols:array<string>>>")
    read = questions.with_references(log, key, sql).withColumn("lowered", F.transform("refs", lambda t: F.lower(t)))
    unknown = F.filter("refs", lambda t: ~F.map_contains_key(catalog, F.lower(t)))
    bad_pairs = F.filter(
        "pairs",
        lambda p: F.array_contains(F.col("lowered"), F.split_part(p, F.lit("."), F.lit(1)))
        & ~F.array_contains(
            F.try_element_at(catalog, F.split_part(p, F.lit("."), F.lit(1)))["cols"],
            F.split_part(p, F.lit("."), F.lit(2)),
        ),
    )
    first_bad = F.get("bad_pairs", F.lit(0))
    message = (
        F.when(F.size("refs") == 0, NO_TABLE)
        .when(F.size("unknown") > 0, F.format_string(UNKNOWN_TABLE, F.get("unknown", F.lit(0))))
        .when(
            F.size("bad_pairs") > 0,
            F.format_string(
                UNKNOWN_COLUMN,
                F.split_part(first_bad, F.lit("."), F.lit(2)),
                F.try_element_at(catalog, F.split_part(first_bad, F.lit("."), F.lit(1)))["name"],
            ),
        )
    )
    return (
        read.withColumns({"unknown": unknown, "bad_pairs": bad_pairs})
        .withColumn("message", message)
        .select(key, F.col("message").isNull().alias("is_valid"), "message")
    )


def view_name(table: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", table)


@contextmanager
def _views(spark: SparkSession, tables: Tables) -> Iterator[None]:
    """The tables as temporary views, each under its cleaned and its own name; views
    of the caller under these names are back afterwards."""
    names: dict[str, str] = {}
    for table in tables:
        clean = view_name(table)
        if names.setdefault(clean.lower(), table) != table:
            raise ValueError(f"tables {names[clean.lower()]} and {table} have one name once cleaned: {clean}")
    before, made = {}, []
    try:
        for table, df in tables.items():
            for name in dict.fromkeys((view_name(table), table)):
                own = values.quote(name)
                if any(t.name == name.lower() for t in spark.catalog.listTables(pattern=view_name(name)) if t.isTemporary):
                    before[own] = spark.table(own)
                df.createOrReplaceTempView(own)
                made.append(own)
        yield
    finally:
        for own in made:
            spark.sql(f"DROP VIEW IF EXISTS {own}")
        for own, df in before.items():
            df.createOrReplaceTempView(own)


def governed_query(
    spark: SparkSession,
    sql: str,
    tables: Tables,
    *,
    max_rows: int = MAX_ROWS,
    mask_parts: Sequence[str] = masking.RESULT_NAME_PARTS,
    strict: bool = False,
) -> DataFrame:
    """Run one query over the given tables; the result is row-limited and masked.

    Tables are visible under their cleaned names and, in backticks, under their
    own; the text is run as it is. Only queries over these tables with Spark's own
    functions run: commands, other tables, files read by path and functions that run
    code are refused (`lineage.QueryRefused`). A result column is masked if its name
    says personal data, or the name of any source column it is derived from, whatever
    alias, subquery or union lies between; a value computed from such columns shows
    nothing at all, and counts stay. With `strict=True` personal-data columns are
    masked in the sources, so that filters don't see them either.
    """
    text = sql.strip().rstrip(";")
    if strict:
        tables = {t: masking.mask_columns(df, masking.PII_NAME_PARTS) for t, df in tables.items()}
    allowed = {name for t in tables for name in (t, view_name(t))}
    lineage.check_parsed(spark, text, allowed)
    with _views(spark, tables):
        result = spark.sql(text)
        lineage.check_resolved(result, allowed)
    places = [f"c{i}" for i in range(len(result.columns))]
    shown = []
    for place, name, derived in zip(places, result.columns, lineage.source_columns(result)):
        sensitive = [n for n in sorted(derived.names) if any(p in n.lower() for p in mask_parts)]
        column = F.col(place)
        if sensitive and not derived.unchanged:
            column = F.when(column.isNotNull(), masking.WHOLLY_MASKED)
        elif sensitive:
            column = masking.masked(column, sensitive[0])
        elif any(p in name.lower() for p in mask_parts):
            column = masking.masked(column, name)
        shown.append(column.alias(name))
    return result.limit(max_rows).toDF(*places).select(*shown)
