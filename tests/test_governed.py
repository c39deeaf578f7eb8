"""Governed queries: what is refused, and what comes out masked."""

import pytest

from quarrylens.functions import masking
from quarrylens.operators import lineage, sqlgov


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame(
        [(i, f"u{i}@x.org", 1000.0 + i, f"n{i % 3}") for i in range(6)], "id bigint, user_email string, salary double, name string"
    )
    return {"people": people, "my-orders": spark.range(6).selectExpr("id AS order_id", "id % 4 AS person_id")}


def run(spark, tables, sql, **options):
    return sqlgov.governed_query(spark, sql, tables, **options)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE people",
        "INSERT INTO people SELECT * FROM people",
        "WITH a AS (SELECT 1 AS x) INSERT INTO people SELECT * FROM a",
        "FROM people INSERT INTO people SELECT *",
        "CREATE TEMP VIEW v AS SELECT * FROM people",
        "BEGIN SELECT 1; END",
        "SET spark.sql.ansi.enabled=false",
        "SELECT TRANSFORM (id) USING 'cat' FROM people",
        "SELECT * FROM parquet.`/etc`",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT * FROM people JOIN text.`/etc/hostname` ON true",
        "SELECT (SELECT max(value) FROM text.`/etc/hostname`) FROM people",
        "SELECT * FROM IDENTIFIER('hidden')",
        "SELECT * FROM hidden",
        "SELECT * FROM people WHERE id IN (SELECT id FROM hidden)",
        "SELECT * FROM global_temp.hidden",
        "WITH c AS (SELECT * FROM hidden) SELECT * FROM c",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM people",
        "SELECT id FROM people WHERE try_reflect('java.lang.System', 'getProperty', 'user.home') = ''",
        "SELECT input_file_name() FROM people",
        "SELECT * FROM sql_keywords()",
        "SELECT helper(id) FROM people",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT * FROM r",
    ],
)
def test_refused(spark, tables, sql):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.udf.register("helper", lambda x: str(x))
    with pytest.raises(lineage.QueryRefused):
        run(spark, tables, sql)
    assert spark.catalog.tableExists("hidden") and not spark.catalog.tableExists("people")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT user_email AS v FROM people",
        "SELECT concat(name, ':', user_email) AS v FROM people",
        "SELECT v FROM (SELECT upper(user_email) AS v FROM people) WHERE v IS NOT NULL",
        "WITH c AS (SELECT user_email AS e FROM people), d AS (SELECT e AS v FROM c) SELECT v FROM d",
        "SELECT max(user_email) AS v FROM people GROUP BY name",
        "SELECT (SELECT max(p.user_email) FROM people p WHERE p.id = q.id) AS v FROM people q",
        "SELECT name AS v FROM people UNION ALL SELECT user_email FROM people",
        "SELECT v FROM people LATERAL VIEW explode(array(name, user_email)) AS v",
        "SELECT x.v FROM people p, LATERAL (SELECT p.user_email AS v) x",
        "SELECT first_value(user_email) OVER (PARTITION BY name ORDER BY id) AS v FROM people",
        "SELECT named_struct('a', user_email).a AS v FROM people",
        "SELECT substr(v, 2) AS v FROM (SELECT user_email AS v FROM people INTERSECT SELECT user_email FROM people)",
        "SELECT coalesce(user_email, name) AS v FROM people GROUP BY ROLLUP (user_email, name)",
        "SELECT a.user_email AS v FROM people a JOIN people b ON a.id = b.id",
        "SELECT v FROM people UNPIVOT (v FOR k IN (user_email, name))",
        "SELECT v.user_email AS v FROM (SELECT struct(*) AS v FROM people)",
        "SELECT CASE WHEN id > 2 THEN user_email END AS v FROM people WHERE id > 2",
        "SELECT concat('@', replace(user_email, '@', '#')) AS v FROM people",
        "SELECT map_values(map('k', user_email))[0] AS v FROM people",
    ],
)
def test_masked_by_lineage(spark, tables, sql):
    rows = run(spark, tables, sql).collect()
    assert rows and {r["v"] for r in rows} <= {"u*@x.org", "****@example.com", masking.WHOLLY_MASKED, None}


def test_salaries_are_hidden_in_sums_and_counts_stay(spark, tables):
    got = run(
        spark, tables,
        "SELECT name, sum(salary) AS total, avg(salary) + 1 AS mean, count(salary) AS n, count(DISTINCT user_email) AS m "
        "FROM people GROUP BY name ORDER BY name",
    ).collect()
    assert [tuple(r) for r in got] == [(f"n{i}", masking.WHOLLY_MASKED, masking.WHOLLY_MASKED, 2, 2) for i in range(3)]


def test_plain_columns_filters_and_literals_are_left(spark, tables):
    sql = (
        "-- FROM hidden\nSELECT o.order_id, 'my-orders and people' AS note, p.name FROM `my-orders` o JOIN people p "
        "ON o.person_id = p.id WHERE p.user_email = 'u1@x.org' ORDER BY p.user_email, order_id;"
    )
    assert [tuple(r) for r in run(spark, tables, sql).collect()] == [(1, "my-orders and people", "n1"), (5, "my-orders and people", "n1")]
    assert run(spark, tables, "SELECT count(*) AS n FROM my_orders").first()["n"] == 6
    ranked = run(spark, tables, "SELECT row_number() OVER (ORDER BY user_email DESC) AS n, rank() OVER (ORDER BY salary) AS r FROM people")
    assert {(r["n"], r["r"]) for r in ranked.collect()} == {(6 - i, i + 1) for i in range(6)}
    assert run(spark, tables, "SELECT id FROM range(100)").count() == sqlgov.MAX_ROWS
    # two columns of one name
    assert [tuple(r) for r in run(spark, tables, "SELECT id, user_email AS id FROM people WHERE id = 3").collect()] == [(3, "u*@x.org")]
    # in the sources, the filter sees the mask too
    assert run(spark, tables, sql, strict=True).count() == 0


def test_clashing_names_are_refused_and_own_views_come_back(spark, tables):
    df = spark.range(1)
    with pytest.raises(ValueError, match="one name"):
        run(spark, {"a-b": df, "a b": df}, "SELECT 1 AS x")
    spark.range(7).createOrReplaceTempView("people")
    try:
        assert run(spark, tables, "SELECT name FROM people").count() == 6
        assert spark.table("people").count() == 7
        with pytest.raises(lineage.QueryRefused):
            run(spark, {"t": df}, "SELECT * FROM people")
        assert spark.table("people").count() == 7
    finally:
        spark.catalog.dropTempView("people")
