"""Quality measures on skewed and odd data, recounted plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import values
from quarrylens.operators import profile, quality, quartiles


@pytest.mark.parametrize("size", [64, 512, 4096])
def test_quartiles_are_exact(spark, size):
    """A third of the rows share one value; the rest are heavy-tailed or sparse."""
    rng = np.random.default_rng(7)
    n = 30_000
    tail = np.where(rng.random(n) < 0.34, 42.0, np.exp(rng.normal(0, 8, n)))
    few = rng.integers(0, 3, n)
    holes = np.where(rng.random(n) < 0.9, np.nan, rng.normal(0, 1, n))
    df = spark.createDataFrame(
        [(float(a), int(b), float(c)) for a, b, c in zip(tail, few, holes)], "a double, b int, c double"
    )
    got = quartiles.quartiles(df, df.schema.fields, size).first()["q"]
    for row, values in zip(got, (tail, few, holes[~np.isnan(holes)])):
        assert row["n"] == len(values)
        assert np.allclose([row["q1"], row["q3"]], np.quantile(values, [0.25, 0.75]), rtol=1e-12, atol=0)


def test_values_of_one_narrow_interval(spark):
    """All values but two lie close together, a third of them are equal; the widest range."""
    n = 40_000
    df = spark.range(n, numPartitions=5).selectExpr(
        "CASE WHEN id = 0 THEN -1e300D WHEN id = 1 THEN 1e300D WHEN id % 3 = 0 THEN 1D ELSE 1D + pmod(xxhash64(id), 100000) * 1e-14D END AS v",
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS w", "CAST(NULL AS DOUBLE) AS nothing", "CAST(id % 2 AS INT) AS two",
    )
    got = quartiles.quartiles(df, df.schema.fields).first()["q"]
    rows = df.collect()
    for at, name in enumerate(("v", "w", "nothing", "two")):
        values = [r[name] for r in rows if r[name] is not None]
        found = [got[at]["q1"], got[at]["q3"]]
        assert got[at]["n"] == len(values)
        assert found == ([None, None] if not values else pytest.approx(list(np.quantile(values, [0.25, 0.75])), rel=1e-15))


@pytest.mark.parametrize("wrong", [0.0, 0.3, 0.9])
def test_misleading_sketches_only_cost_time(spark, monkeypatch, wrong):
    """Candidates that miss the ranks leave the rest of the interval; the numbers stay exact."""
    df = spark.range(20_000, numPartitions=3).selectExpr("CAST(pmod(xxhash64(id), 9973) AS DOUBLE) AS v")
    want = np.quantile([r["v"] for r in df.collect()], [0.25, 0.75])
    sketched, calls = quartiles._sketched, []

    def misled(numbers, cells, ranks, size):
        calls.append(len(cells))
        return [[wrong * 9973] * 4 for _ in cells] if len(calls) == 1 else sketched(numbers, cells, ranks, size)

    monkeypatch.setattr(quartiles, "_sketched", misled)
    monkeypatch.setattr(quartiles, "MOST_VALUES", 1500)
    (got,) = quartiles.quartiles(df, df.schema.fields).first()["q"]
    assert [got["q1"], got["q3"]] == list(want) and len(calls) > 1


def test_rounds_go_on_until_few_values_are_left(spark, monkeypatch):
    monkeypatch.setattr(quartiles, "MOST_VALUES", 10)
    df = spark.range(30_000, numPartitions=4).selectExpr("CAST(id * id AS DOUBLE) AS v", "CAST(id % 3 AS INT) AS few")
    got = quartiles.quartiles(df, df.schema.fields, 64).first()["q"]
    square = [float(i * i) for i in range(30_000)]
    assert [got[0]["q1"], got[0]["q3"]] == pytest.approx(list(np.quantile(square, [0.25, 0.75])), rel=1e-14)
    assert (got[1]["q1"], got[1]["q3"]) == (0.0, 2.0)


@pytest.mark.parametrize("most", [10, 2_000_000])
def test_columns_of_many_values_begin_with_buckets(spark, monkeypatch, most):
    """No sketch where buckets tell the values apart; where they don't, or can't, the numbers stay exact."""
    monkeypatch.setattr(quartiles, "BUCKETS_FROM", 0)
    monkeypatch.setattr(quartiles, "MOST_VALUES", most)
    df = spark.range(20_000, numPartitions=3).selectExpr(
        "pmod(xxhash64(id), 99991) AS even", "exp(pmod(id, 400) - 200D) AS tail", "CASE WHEN id % 3 > 0 THEN -0.07D ELSE id * 0.01D END AS ties",
        "CASE WHEN id < 3 THEN double('inf') WHEN id < 6 THEN -1.7e308D ELSE id END AS wide", "CASE WHEN id % 2 = 0 THEN id * 1e-320D END AS tiny",
    )
    rows, sketched, cells = df.collect(), quartiles._sketched, []
    monkeypatch.setattr(quartiles, "_sketched", lambda numbers, c, *rest: cells.extend(c) or sketched(numbers, c, *rest))
    got = quartiles.quartiles(df, df.schema.fields).first()["q"]
    for at, name in enumerate(df.columns):
        held = [float(r[name]) for r in rows if r[name] is not None]
        assert got[at]["n"] == len(held)
        assert [got[at]["q1"], got[at]["q3"]] == pytest.approx(list(np.quantile(held, [0.25, 0.75])), rel=1e-14), name
    if most > 10:
        assert not any("x0" in c or "x2" in c for c in cells)


def test_extreme_doubles(spark):
    values = [-1.7e308, -1e308, -3.0, 0.0, 2.0, 5.0, 1e308, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    (got,) = quartiles.quartiles(df, df.schema.fields).first()["q"]
    # the quarter between neighbours, without a detour beyond the range of a double
    assert (got["q1"], got["q3"]) == (0.25 * -1e308 + 0.75 * -3.0, 0.75 * 5.0 + 0.25 * 1e308)


def test_duplicates_count_nulls_and_long_texts(spark):
    long = "y" * 100
    rows = [(None, "a"), (None, "a"), ("a", None), (long, "z"), (long, "z"), (long + "1", "z"), (None, None)]
    assert quality.duplicate_rows(spark.createDataFrame(rows, "x string, y string")).first()[0] == 2


def test_hot_duplicate_collapses(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS k")
    assert quality.duplicate_rows(df).first()[0] == 999


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_compared_in_full_only_where_fingerprints_repeat(spark, monkeypatch):
    """Without repeats nothing is grouped again; the counts are those of the full rows."""
    single = spark.range(500).selectExpr("id", "CAST(id AS STRING) AS t", "array(CAST(id AS DOUBLE)) AS a")
    rows = [(0.0, "a", None), (-0.0, "a", None), (float("nan"), None, [0.0]), (None, None, [-0.0]), (1.0, "b", [1.0]), (1.0, None, [1.0])]
    odd = spark.createDataFrame(rows * 2 + [(2.0, "c", None)], "d double, `a.b` string, x array<double>")
    cased = spark.sql("SELECT v COLLATE UTF8_LCASE AS v FROM VALUES ('a'), ('A'), ('b') AS t(v)")
    tables = {"single": single, "odd": odd, "cased": cased}
    for most in (quality.MOST_FINGERPRINTS, 0):
        monkeypatch.setattr(quality, "MOST_FINGERPRINTS", most)
        found = quality.duplicates_of(tables)
        assert {t: df.first()["duplicates"] for t, df in found.items()} == {"single": 0, "odd": 8, "cased": 1}
        assert "Exchange" not in physical(found["single"])
        # a fingerprint that says nothing costs time only
        with monkeypatch.context() as m:
            m.setattr(quality.values, "fingerprint", lambda fields: "7L")
            assert {t: df.first()["duplicates"] for t, df in quality.duplicates_of(tables).items()} == {"single": 0, "odd": 8, "cased": 1}


def test_quartiles_that_are_one_value_are_not_put_in_order(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 9 = 0 THEN id ELSE 5 END AS v", "7 AS w")
    found = quartiles.quartiles(df, df.schema.fields)
    assert [(r["q1"], r["q3"]) for r in found.first()["q"]][1] == (7.0, 7.0)
    constant = quartiles.quartiles(df, df.schema.fields[1:])
    assert "Exchange" not in physical(constant) and constant.first()["q"][0]["q3"] == 7.0
    assert quartiles.outlier_counts(df, df.schema.fields).first()["outliers"] == [0, 0]


@pytest.mark.parametrize("text,reads", [
    ("2024-1-5", 2), ("  2024/1/5", 2), ("5/1/2024", 2), ("20240105", 2), ("5 Jan 2024", 2), ("May 5, 2024", 2), ("12345-1-5", 0),
    ("99-99-9999", 1), ("9999/99/99", 1), ("555-010-0123", 0), ("1-1-1", 0), ("", 0), ("\t2024-01-05", 0), ("é2024-01-05", 0), (None, None),
])
def test_texts_that_may_be_dates_are_all_tried(spark, text, reads):
    df = spark.createDataFrame([(text, "x")], "s string, note string")
    tried = df.selectExpr(f"{values.each_text(['s', 'note'], values.date_reading)} AS r", f"{values.date_reading('s')} AS plain").first()
    assert tried["plain"] == reads
    assert ((tried["r"] or [None])[0] or 0) == (reads or 0)
    assert quality.missing_and_formats("t", df, ["s"]).first()["invalid_formats"] == (reads == 0)


def test_formats(spark):
    rows = [
        ("a@b.co", "2024-01-05"), ("é.x@b.co", "05/01/2024"), ("a@b", "Jan 5, 2024"),
        (None, None), ("a b@c.de", "soon"), ("", "2024-99-99"),
    ]
    df = spark.createDataFrame(rows, "email string, start_date string")
    got = {r["column_name"]: r["invalid_formats"] for r in quality.missing_and_formats("t", df).collect()}
    # A text in the accepted layout passes on its layout alone.
    assert got == {"email": 3, "start_date": 1}


@pytest.mark.parametrize("dates,wrong", [(90, 10), (89, 0), (100, 0), (0, 0)])
def test_date_columns_are_found_by_share(spark, dates, wrong):
    """From nine in ten filled cells on, a text column holds dates and the rest is malformed."""
    layouts = ("2024-01-05", " 2024/1/5 10:30", "5/1/2024", "31-12-2024", "20240105", "5 Jan 2024", "January 5, 2024", "2024-01-05T10:30:00Z")
    rows = [(layouts[i % len(layouts)] if i < dates else f"555-010-{i:04d}", None) for i in range(100)] + [(None, None)] * 50
    df = spark.createDataFrame(rows, "stamp string, note string")
    got = {r["column_name"]: r["invalid_formats"] for r in quality.missing_and_formats("t", df).collect()}
    assert got == {"stamp": wrong, "note": 0}
    kinds = {r["column_name"]: r["data_type"] for r in profile.profile_types({"t": df}).collect()}
    assert kinds == {"stamp": "DATETIME" if dates >= 90 else "TEXT", "note": "TEXT"}
    listed = quality.missing_and_formats("t", df, ["stamp"]).where("column_name = 'stamp'").first()
    assert listed["invalid_formats"] == 100 - dates


def test_layouts_of_digits_count_where_dates_are_expected(spark):
    """99-99-9999 has the layout of a date but isn't one: it passes a date check and
    doesn't make a column one of dates."""
    df = spark.createDataFrame([("99-99-9999",)] * 9 + [("x",)], "v string")
    assert quality.missing_and_formats("t", df).first()["invalid_formats"] == 0
    assert quality.missing_and_formats("t", df, ["v"]).first()["invalid_formats"] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    details = quality.column_details({"t": df})
    row = quality.health_scores(details).first()
    assert (row["health_score"], row["missing_count"], row["row_count"]) == (0.0, 0, 0)
    assert quality.recommendations(details).first()["recommendation"] == "Upload valid data to this table."


def test_recommendation_order_and_quiet_tables(spark):
    dirty = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    fine = spark.createDataFrame([(1,), (2,)], "a int")
    advice = quality.recommendations(quality.column_details({"dirty": dirty, "fine": fine})).orderBy("table_name", "seq").collect()
    assert [r["recommendation"] for r in advice] == [
        "Remove duplicate rows in table 'dirty'. Found 1 duplicates.",
        "Impute or investigate high null values in column 'b' (66.67% null).",
        "No critical issues found. Maintain current data load protocols.",
    ]


def test_orphans_with_a_hot_key(spark):
    parent = spark.range(1, 10).selectExpr("id", "CAST(id AS STRING) AS name")
    child = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 99 WHEN id % 10 = 1 THEN NULL ELSE id % 12 END AS parent_id"
    )
    rows = [r["parent_id"] for r in child.collect()]
    filled = [v for v in rows if v is not None]
    lost = [v for v in filled if not 1 <= v < 10]
    (got,) = quality.orphan_records({"p": parent, "c": child}, [("p", "id", "c", "parent_id")]).collect()
    assert (got["child_count"], got["orphan_count"]) == (len(filled), len(lost))
    assert got["orphan_percentage"] == pytest.approx(100 * len(lost) / len(filled), abs=0.005)
    assert got["sample_orphans"] == [str(v) for v in sorted(set(lost))][:5]


def test_orphans_refuse_mixed_types_and_skip_empty_sides(spark):
    numbers, texts = spark.range(3), spark.createDataFrame([("1",)], "k string")
    with pytest.raises(TypeError):
        quality.orphan_records({"p": numbers, "c": texts}, [("p", "id", "c", "k")])
    nothing = numbers.where("id < 0")
    for tables in ({"p": nothing, "c": numbers}, {"p": numbers, "c": nothing}):
        assert quality.orphan_records(tables, [("p", "id", "c", "id")]).collect() == []


def test_health_band_and_missing_mean(spark):
    df = spark.createDataFrame([(69.9,), (70.0,), (89.9,), (90.0,)], "health_score double")
    bands = [r[0] for r in df.select(quality.health_band(F.col("health_score"))).collect()]
    assert bands == ["red", "yellow", "yellow", "green"]
    assert quality.dataset_health(df.where("health_score < 0")).first()[0] == 100.0
    zero = spark.createDataFrame([(0.0,)], "health_score double")
    assert quality.dataset_health(zero).first()[0] == 0.0
