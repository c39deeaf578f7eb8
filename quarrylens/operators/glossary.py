"""Glossary terms proposed from column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Name parts that make a column a glossary candidate.
TERM_NAME_PARTS = (
    "status", "type", "category", "channel", "amount", "price", "revenue", "score",
    "cost", "flag", "gender", "role", "dept", "department", "level", "rate",
    "satisfaction", "field", "education", "travel", "income", "year", "age",
    "performance", "balance", "marital", "churn", "tenure", "partner", "dependent",
    "phone", "contract", "method", "billing", "charge", "salary", "time", "distance",
    "attrition",
)

# Texts of a proposed term.
DEFINITION = "Standardized classifier column containing %s values."
MEANING = "Used to categorize or track the state of %s in operational flows."
USAGE = "Reporting aggregations, filter segments, and data-cube slices."
NO_EXAMPLE = "N/A"


def glossary_candidates(columns: DataFrame) -> DataFrame:
    return columns.where(F.lower("column_name").rlike("|".join(TERM_NAME_PARTS)))


def glossary_terms(columns: DataFrame, position: str = "column_id") -> DataFrame:
    """One proposed term per lower-cased column name; the first column wins.

    `columns` needs column_name, sample_values and an order column.
    """
    first = (
        glossary_candidates(columns)
        .groupBy(F.lower("column_name").alias("key"))
        .agg(F.min_by(F.struct("column_name", "sample_values"), F.col(position)).alias("c"))
        .select("c.*")
    )
    return first.select(
        F.upper("column_name").alias("term"),
        F.format_string(DEFINITION, "column_name").alias("definition"),
        F.format_string(MEANING, F.replace("column_name", F.lit("_"), F.lit(" "))).alias(
            "business_meaning"
        ),
        F.lit(USAGE).alias("business_usage"),
        F.coalesce(F.get("sample_values", F.lit(0)), F.lit(NO_EXAMPLE)).alias("example_val"),
    )
