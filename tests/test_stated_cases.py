"""Literal cases with stated outcomes: flags, masks, outliers, scores, links, texts."""

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import masking, questions
from quarrylens.operators import quality, quartiles, relations
from quarrylens.plans import catalog_queries as cq


def value_of(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name,flag", [("customer_email", True), ("phone_number", True), ("created_at", False)])
def test_pii_flag(spark, name, flag):
    assert masking.is_pii_name(name) is flag
    assert value_of(spark, masking.pii_name_flag(F.lit(name))) is flag


@pytest.mark.parametrize(
    "value,name,shown",
    [
        ("john.doe@gmail.com", "customer_email", "j*******@gmail.com"),
        ("j@x.org", "email", "*@x.org"),
        ("@x.org", "email", "*@x.org"),
        ("no address", "email", "****@example.com"),
        ("a@b@c", "email", "****@example.com"),
        ("1234567812345678", "credit_card", "****-****-****-5678"),
        ("123", "card", "****************"),
        ("555-010-1234", "Mobile_No", "****-****-1234"),
        ("12", "phone", "**********"),
        ("hunter2", "password", "********"),
        ("50000", "salary", "$XX,XXX"),
        ("50000", "income_tax", "$XX,XXX"),
        ("AB12", "passport", "[MASKED_PII_DATA]"),
        ("  ada@x.org \t", "email", "a**@x.org"),
        ("   ", "email", ""),
        (None, "email", None),
    ],
)
def test_masks(spark, value, name, shown):
    assert value_of(spark, masking.masked(F.lit(value).cast("string"), name)) == shown


@pytest.mark.parametrize(
    "numbers,count",
    [
        ([10, 12, 11, 13, 12, 11, 12, 10, 11, 12], 0),
        ([10, 12, 11, 13, 12, 11, 12, 10, 11, 120], 1),
        ([1, 1, 1, 1, 1, 500], 0),
        ([1, 2, 3, 1000], 0),
    ],
)
def test_outliers(spark, numbers, count):
    df = spark.createDataFrame([(n,) for n in numbers], "n int")
    assert quartiles.outlier_counts(df, df.schema.fields).first()["outliers"] == [count]


def health(spark, rows, schema):
    return quality.health_scores(quality.column_details({"t": spark.createDataFrame(rows, schema)})).first()


def test_clean_table_scores_full(spark):
    row = health(spark, list(zip(range(1, 10), "ABCDEFGHI")), "id bigint, val string")
    assert (row["health_score"], row["missing_count"], row["duplicate_count"]) == (100.0, 0, 0)


def test_dirty_table(spark):
    rows = list(zip([1, 2, 2, 4, 5, 6, 7, 8, 9], ["A", None, None, "D", "E", "F", "G", "H", "I"]))
    row = health(spark, rows, "id bigint, val string")
    assert (row["health_score"], row["missing_count"], row["duplicate_count"]) == (77.8, 2, 1)


def test_relationship_from_profiles_alone(spark):
    profile = spark.createDataFrame(
        [
            (0, "customers", "customer_id", "INTEGER", 50, 0, 1.0, 50),
            (1, "customers", "name", "TEXT", 50, 0, 1.0, 50),
            (2, "orders", "order_id", "INTEGER", 100, 0, 1.0, 100),
            (3, "orders", "customer_id", "INTEGER", 30, 5, 0.3, 100),
        ],
        "column_id int, table_name string, column_name string, data_type string, distinct_count bigint, "
        "null_count bigint, uniqueness_ratio double, row_count bigint",
    )
    (found,) = relations.discover_relationships(profile).collect()
    assert (found["source_table"], found["source_column"]) == ("customers", "customer_id")
    assert (found["target_table"], found["target_column"]) == ("orders", "customer_id")
    assert (found["type"], found["confidence"]) == ("one-to-many", 0.55)
    assert found["join_suggestion"] == (
        "SELECT * FROM customers JOIN orders ON customers.customer_id = orders.customer_id"
    )


@pytest.mark.parametrize(
    "question,intent",
    [
        ("Check duplicates on customer billing tables", "QUALITY"),
        ("How do I join A and B?", "RELATIONSHIP"),
        ("What is the average price?", "SQL"),
        ("Give the definition of churn", "GLOSSARY"),
        ("Which columns exist?", "METADATA"),
        ("Tell me about sales", "BUSINESS"),
    ],
)
def test_intent(spark, question, intent):
    assert value_of(spark, questions.question_intent(F.lit(question))) == intent


def test_template_texts(spark):
    assert "customers" in value_of(spark, cq.template_table_text(F.lit("customers")))
    assert "customer_id" in value_of(spark, cq.template_column_text(F.lit("customer_id")))


def test_raw_addresses_are_refused(spark):
    q = F.lit("Show all customer email records")
    a = F.lit("Here is the requested email list: Alice (alice@gmail.com), Bob (bob@gmail.com)")
    assert value_of(spark, questions.answer_verdict(q, a)) == "REJECTED_RAW_DATA"
    assert value_of(spark, questions.released_answer(q, a)).startswith("Access Denied")


def test_numeric_question(spark):
    assert value_of(spark, questions.is_numeric_question(F.lit("Attrition RATE by team"))) is True
    assert value_of(spark, questions.is_numeric_question(F.lit("attrition by team"))) is False


def test_glossary_search_without_hits(spark):
    empty = spark.createDataFrame(
        [], "term string, definition string, business_meaning string, business_usage string, example_val string"
    )
    assert cq.glossary_search(empty, "nonexistent_term").collect() == []
