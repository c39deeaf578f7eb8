"""Profiles against a plain recount of the same rows, odd types and values included."""

import datetime as dt
import math

import pytest

from quarrylens.operators import profile

LONG = "x" * 200
ROWS = [
    (1, 1.5, "a", True, dt.date(2024, 1, 1), [1, 2], ("p", 1), bytearray(b"1"), "2024-01-01"),
    (2, float("nan"), LONG + "1", False, dt.date(2024, 1, 2), [1, 2], ("p", 2), bytearray(b"1"), "2024/02/01"),
    (2, None, LONG + "2", None, None, None, None, None, None),
    (None, -0.0, LONG + "2", True, dt.date(2024, 1, 2), [], ("q", 1), bytearray(b"2"), "13 Feb 2024"),
    (5, 0.0, "é", True, dt.date(2023, 1, 2), [3], ("q", 1), bytearray(b"3"), "2024-01-01 10:00:00"),
]
SCHEMA = (
    "i int, d double, s string, b boolean, day date, arr array<int>, st struct<x:string,y:int>, "
    "bin binary, `when it.was` string"
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def recount(index):
    seen = []
    for row in ROWS:
        v = row[index]
        if v is None or (isinstance(v, float) and math.isnan(v)):
            continue
        seen.append(tuple(v) if isinstance(v, (list, bytearray)) else v)
    return len(ROWS) - len(seen), len(set(seen))


def test_exact_counts(spark, table):
    got = {r["position"]: r for r in profile.profile_columns({"t": table}).collect()}
    assert len(got) == len(table.columns)
    for position in got:
        nulls, distinct = recount(position)
        row = got[position]
        assert (row["null_count"], row["distinct_count"]) == (nulls, distinct), row["column_name"]
        assert row["duplicate_count"] == len(ROWS) - distinct
        assert row["null_percentage"] == round(nulls / len(ROWS) * 100, 2)


def test_distinct_values_of_every_part(spark):
    """Whole and broken numbers, times at and off midnight: none is counted twice or lost."""
    number = "CASE id % 7 WHEN 0 THEN 0.01D * (id % 90) WHEN 1 THEN -0.01D * (id % 90) WHEN 2 THEN id / 3D WHEN 3 THEN 1e300D WHEN 4 THEN double('inf') WHEN 5 THEN double('-inf') ELSE 123456789012345.5D + id % 2 END"
    df = spark.range(4000).selectExpr(
        "id - 2000 AS k", "CASE WHEN id % 2 = 0 THEN -9223372036854775808L ELSE 9223372036854775807L - id % 5 END AS far",
        f"{number} AS d", f"CAST({number} AS FLOAT) AS f", "CAST(id % 9 AS DECIMAL(9, 2)) AS dec", "id % 2 = 0 AS b",
        "timestamp_micros((id - 2000) * CASE id % 3 WHEN 0 THEN 86400000000L WHEN 1 THEN 3600000000L ELSE 7L END) AS at",
        "CAST('1969-12-25 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(id % 50 AS INT), CAST(id % 2 AS INT)) AS wall",
        "date_from_unix_date(CAST(id % 77 - 30 AS INT)) AS day", "CONCAT('é', id % 64) AS s",
    )
    rows = df.collect()
    got = {r["position"]: r["distinct_count"] for r in profile.profile_columns({"t": df}).collect()}
    assert got == {i: len({r[i] for r in rows}) for i in range(len(df.columns))}


def test_dense_keys_are_shuffled_in_words(spark):
    """One row for 64 neighbours reaches the shuffle, not one for each value."""
    df = spark.range(64_000, numPartitions=2).selectExpr("id AS k", "id / 100D AS price")
    counted = profile.distinct_counts({"t": df})
    assert {r["distinct_count"] for r in counted.collect()} == {64_000}
    plan, written = counted._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        metrics = node.metrics()
        if node.nodeName() == "Exchange" and metrics.contains("shuffleRecordsWritten"):
            written.append(metrics.apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    assert written and max(written) <= 2_100


def test_numbers_keep_their_aggregate_beside_texts(spark):
    facts = profile.column_facts({"t": spark.createDataFrame([(1, "a", 2.0), (3, "b", None)], "k int, s string, d double")}, dates=True)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan
    got = {r["column_name"]: (r["column_id"], r["row_count"], r["null_count"], r["min_text"], r["max_num"]) for r in facts.collect()}
    assert got == {"k": (0, 2, 0, "1", 3.0), "s": (1, 2, 0, "a", None), "d": (2, 2, 1, None, 2.0)}


def test_types_and_extremes(spark, table):
    got = {r["column_name"]: r for r in profile.profile_columns({"t": table}).collect()}
    types = {n: r["data_type"] for n, r in got.items()}
    assert types == {
        "i": "INTEGER", "d": "FLOAT", "s": "TEXT", "b": "BOOLEAN", "day": "DATETIME", "arr": "TEXT",
        "st": "TEXT", "bin": "TEXT", "when it.was": "DATETIME",
    }
    assert (got["d"]["min_num"], got["d"]["max_num"], got["d"]["min_text"]) == (0.0, 1.5, None)
    assert (got["i"]["min_text"], got["i"]["max_num"]) == ("1", 5.0)
    assert (got["b"]["min_text"], got["b"]["max_text"]) == ("False", "True")
    assert got["arr"]["min_text"] is None


def test_empty_table_keeps_its_columns(spark, table):
    rows = profile.profile_columns({"t": table.where("i > 100")}).collect()
    assert len(rows) == len(table.columns)
    assert {(r["row_count"], r["distinct_count"], r["uniqueness_ratio"], r["duplicate_count"]) for r in rows} == {(0, 0, 0.0, 0)}


def test_date_like_uses_all_values(spark):
    rows = [(i, "2024-01-01" if i < 100 else "soon") for i in range(120)]
    tables = {"t": spark.createDataFrame(rows, "k int, v string").coalesce(1)}
    for found in (profile.profile_types(tables), profile.profile_columns(tables)):
        assert {r["column_name"]: r["data_type"] for r in found.collect()}["v"] == "TEXT"
    sampled = profile.profile_columns(tables, type_sample=100, order_by={"t": ["k"]})
    assert {r["column_name"]: r["data_type"] for r in sampled.collect()}["v"] == "DATETIME"
    with pytest.raises(ValueError):
        profile.profile_columns(tables, type_sample=100)


def test_words_are_not_dates(spark):
    tables = {"t": spark.createDataFrame([("now",), ("10:30",), (None,)], "v string")}
    assert profile.profile_types(tables).first()["data_type"] == "TEXT"


def test_approximate_is_close(spark):
    df = spark.range(20000).selectExpr("id", "id % 700 AS m", "CAST(id % 3 AS STRING) AS s")
    exact = {r["column_name"]: r for r in profile.profile_columns({"t": df}).collect()}
    near = {r["column_name"]: r for r in profile.profile_columns({"t": df}, approximate=True, rsd=0.02).collect()}
    for name, row in exact.items():
        assert abs(near[name]["distinct_count"] - row["distinct_count"]) <= 0.1 * row["distinct_count"]
        assert near[name]["null_count"] == row["null_count"]


@pytest.mark.parametrize("order", [None, {"t": ["k"]}])
@pytest.mark.parametrize("complete", [None, {"t": {"k", "email"}}])
def test_samples(spark, order, complete):
    rows = [(i, f"u{i}@x.org", None if i < 3 else f"v{i}") for i in range(20)]
    tables = {"t": spark.createDataFrame(rows, "k int, email string, v string").coalesce(1)}
    found = profile.named_columns(tables, profile.profile_samples(tables, order, complete=complete))
    got = {r["column_name"]: r["sample_values"] for r in found.collect()}
    assert got["k"] == ["0", "1", "2", "3", "4"]
    assert got["v"] == ["v3", "v4", "v5", "v6", "v7"]
    assert got["email"] == ["u*@x.org"] * 5


def test_schema_only_profile(spark, table):
    rows = profile.profile_schema_only({"t": table.withColumnRenamed("s", "phone")}).collect()
    assert {r["row_count"] for r in rows} == {len(ROWS)}
    assert [r["column_name"] for r in rows if r["is_pii"]] == ["phone"]
    assert {r["distinct_count"] for r in rows} == {0}


def test_the_date_rule_is_written_once_for_all_columns(spark):
    wide = spark.range(3).selectExpr("id", *[f"concat('2024-01-0', id + 1, ' 10:00:0', {i}) AS s{i}" for i in range(8)])
    facts = profile.column_facts({"t": wide}, dates=True)
    assert facts._jdf.queryExecution().executedPlan().toString().count("RLIKE") <= 20
    assert {r["column_name"]: r["date_like"] for r in facts.collect()} == {"id": False} | {f"s{i}": True for i in range(8)}
