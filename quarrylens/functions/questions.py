"""Rules over questions, answers and logged SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Phrases that mark a question as numeric.
NUMERIC_PHRASES = (
    "average", "mean", "median", "count", "total", "sum", "minimum", "maximum",
    "highest", "lowest", "percentage", "attrition rate",
)

# Intents and their phrases; the first intent that matches wins.
INTENT_PHRASES = (
    ("QUALITY", ("health", "null", "duplicate", "outlier", "quality")),
    ("RELATIONSHIP", ("join", "link", "relationship", "foreign key", "primary key")),
    ("SQL", ("sql", "query", "select", "average", "mean", "median", "count", "sum")),
    ("GLOSSARY", ("definition", "glossary", "term", "meaning")),
    ("METADATA", ("table", "column", "schema", "database", "exist")),
)
OTHER_INTENT = "BUSINESS"

# Fixed value: the text that replaces a refused answer.
DENIAL = (
    "Access Denied: The query generated output containing raw customer contact "
    "information, which violates the enterprise security catalog policy."
)


def _mentions(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(p).replace("\\ ", " ") for p in phrases))


def is_numeric_question(question: Column) -> Column:
    return _mentions(question, NUMERIC_PHRASES)


def question_intent(question: Column) -> Column:
    intent = F.lit(OTHER_INTENT)
    for name, phrases in reversed(INTENT_PHRASES):
        intent = F.when(_mentions(question, phrases), name).otherwise(intent)
    return intent


def answer_confidence(model: Column, has_context: Column) -> Column:
    score = (
        F.lit(0.90)
        - F.when(F.contains(model, F.lit("Fallback")), 0.15).otherwise(0.0)
        - F.when(has_context, 0.0).otherwise(0.10)
    )
    return F.round(F.greatest(score, F.lit(0.50)), 2)


def answer_verdict(question: Column, answer: Column) -> Column:
    """PASSED, PII_MASKED or REJECTED_RAW_DATA; rejection overrides masking."""
    asks_for_data = F.contains(F.lower(question), F.lit("email")) | F.contains(
        F.lower(answer), F.lit("select")
    )
    shows_address = F.contains(answer, F.lit("@")) & ~F.contains(
        answer, F.lit("[REDACTED_EMAIL]")
    )
    shows_mask = F.contains(answer, F.lit("[MASKED_")) | F.contains(answer, F.lit("[REDACTED_"))
    return (
        F.when(asks_for_data & shows_address, "REJECTED_RAW_DATA")
        .when(shows_mask, "PII_MASKED")
        .otherwise("PASSED")
    )


def released_answer(question: Column, answer: Column) -> Column:
    rejected = answer_verdict(question, answer) == "REJECTED_RAW_DATA"
    return F.when(rejected, DENIAL).otherwise(answer)


# Comment and reference patterns of logged SQL.
LINE_COMMENT = r"--.*?\n"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
TABLE_REFERENCE = r'(?i)(?:FROM|JOIN)\s+[`"\[]?([\p{L}\p{N}_.-]+)[`"\]]?'
COLUMN_REFERENCE = r"([\p{L}_][\p{L}\p{N}_]*+\.[\p{L}_][\p{L}\p{N}_]*+)"


def without_comments(sql: Column) -> Column:
    """The text without comments; the patterns run only where one can begin."""
    for mark, comment in (("--", LINE_COMMENT), ("/*", BLOCK_COMMENT)):
        sql = F.when(F.contains(sql, F.lit(mark)), F.regexp_replace(sql, comment, "")).otherwise(sql)
    return sql


def _table_references(bare: Column) -> Column:
    found = F.regexp_extract_all(bare, F.lit(TABLE_REFERENCE), F.lit(1))
    last = F.transform(found, lambda t: F.substring_index(t, ".", -1))
    return F.array_sort(F.array_distinct(last))


def _column_references(bare: Column) -> Column:
    found = F.regexp_extract_all(F.lower(bare), F.lit(COLUMN_REFERENCE), F.lit(1))
    none = F.when(bare.isNotNull(), F.array().cast("array<string>"))
    return F.when(F.contains(bare, F.lit(".")), F.array_sort(F.array_distinct(found))).otherwise(none)


def table_references(sql: Column) -> Column:
    """Sorted distinct table names after FROM or JOIN, schema prefix dropped."""
    return _table_references(without_comments(sql))


def column_references(sql: Column) -> Column:
    """Sorted distinct `name.name` pairs, lower-cased."""
    return _column_references(without_comments(sql))


def with_references(log: DataFrame, key: str, sql: str) -> DataFrame:
    """(key, refs, pairs): both kinds of references, comments taken out once for both."""
    bare = log.select(key, without_comments(F.col(sql)).alias("__bare"))
    return bare.select(
        key, _table_references(F.col("__bare")).alias("refs"), _column_references(F.col("__bare")).alias("pairs")
    )
