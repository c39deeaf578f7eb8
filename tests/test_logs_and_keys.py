"""Logs keep every row, upserts refuse doubtful rows, nested values compare equal."""

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import values
from quarrylens.plans.catalog import SCHEMAS, CatalogStore, upsert_replace
from quarrylens.streaming import traces


def events(spark, n):
    return spark.range(n).select(
        F.current_timestamp().alias("timestamp"), F.lit("a").alias("primary_model"), F.lit("b").alias("fallback_model"),
        F.lit("e").alias("error_message"), F.col("id").alias("latency_ms"),
    )


def test_batch_stream_batch_restart(spark, tmp_path):
    store, source, checkpoint = CatalogStore(spark, str(tmp_path / "c")), str(tmp_path / "in"), str(tmp_path / "cp")

    def stream():
        rows = spark.readStream.schema(SCHEMAS["failover_events"]).parquet(source)
        traces.append_stream(store, "failover_events", rows, checkpoint).awaitTermination()

    events(spark, 3).write.parquet(source)
    store.append("failover_events", events(spark, 3))
    stream()
    store.append("failover_events", events(spark, 3))
    assert store.read_log("failover_events").count() == 9
    events(spark, 2).write.mode("append").parquet(source)
    stream()
    assert store.read_log("failover_events").count() == 11


def test_upsert_without_an_order_refuses_two_rows_of_a_key(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, upsert_replace(old, new, ["k"]).collect())) == [(1, "z"), (3, "c")]
    with pytest.raises(Exception, match="several rows of one key"):
        upsert_replace(old, new.union(new), ["k"]).collect()


def test_equal_nested_values_have_equal_keys(spark):
    d = spark.sql(
        "SELECT map('a', 1, 'b', 2) AS m, array(0.0D) AS z, struct(-0.0D AS x, map('k', 1) AS y) AS s"
        " UNION ALL SELECT map('b', 2, 'a', 1), array(-0.0D), struct(0.0D, map('k', 1))"
    )
    keys = [f"{values.equality_key(f.name, f.dataType)} AS {f.name}" for f in d.schema.fields]
    assert d.selectExpr(*keys).distinct().count() == 1


def test_blanks_around_a_date_do_not_count(spark):
    assert spark.sql("SELECT " + values.parses_as_date("'" + " " * 50 + "2024-01-05 '")).first()[0]
