"""Catalog store, ingestion, streaming logs and governed SQL."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.operators import sqlgov
from quarrylens.plans import catalog, catalog_queries as cq, ingest
from quarrylens.streaming import traces


@pytest.fixture()
def store(spark, tmp_path):
    return catalog.CatalogStore(spark, str(tmp_path / "catalog"))


def term(spark, rows):
    return spark.createDataFrame(
        [(t, d, "m", "u", "e") for t, d in rows], "term string, definition string, business_meaning string, business_usage string, example_val string"
    ).withColumn("created_at", F.lit(datetime(2024, 1, 1)).cast("timestamp"))


def test_upserts_and_versions(spark, store):
    assert store.read("glossary").count() == 0
    store.upsert("glossary", term(spark, [("A", "one"), ("B", "two")]))
    store.upsert("glossary", term(spark, [("B", "three"), ("B", "four"), ("C", "five")]), order=F.col("definition"))
    got = {r["term"]: r["definition"] for r in store.read("glossary").collect()}
    assert got == {"A": "one", "B": "three", "C": "five"}
    store.insert_missing("glossary", term(spark, [("A", "other"), ("D", "six")]))
    got = {r["term"]: r["definition"] for r in store.read("glossary").collect()}
    assert got == {"A": "one", "B": "three", "C": "five", "D": "six"}
    assert store._versions("glossary") == [1, 2, 3]


def test_an_unfinished_version_is_not_read(spark, store, tmp_path):
    store.upsert("glossary", term(spark, [("A", "one")]))
    term(spark, [("A", "half")]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        str(tmp_path / "catalog" / "glossary" / "v2")
    )
    assert store.read("glossary").first()["definition"] == "one"
    store.upsert("glossary", term(spark, [("B", "two")]))
    assert {r["term"] for r in store.read("glossary").collect()} == {"A", "B"}


def small_tables(spark):
    customers = spark.createDataFrame(
        [(100 + i, f"Name {i}", f"u{i}@x.org", "Premium") for i in range(1, 8)],
        "customer_id bigint, name string, email string, segment string",
    )
    orders = spark.createDataFrame(
        [(201, 101, 10.0, "SUCCESS"), (202, 101, 12.0, "PENDING"), (203, 103, 11.0, "FAILED"), (204, 104, 9.0, "SUCCESS")],
        "order_id bigint, customer_id bigint, amount double, status string",
    )
    return {"customers": customers, "orders": orders}


def test_ingest_twice_replaces(spark, store):
    tables = small_tables(spark)
    for _ in range(2):
        ingest.ingest(store, "crm", "CSV", "/data/crm", tables, now=datetime(2024, 1, 1))
    assert store.read("tables").count() == 2
    assert store.read("columns").count() == 8
    (rel,) = store.read("relationships").collect()
    assert (rel["source_table"], rel["target_table"], rel["source_column"]) == ("customers", "orders", "customer_id")
    assert rel["overlap_percentage"] == 1.0
    summary = cq.dataset_summary(*[store.read(t) for t in ("datasets", "tables", "columns", "relationships", "quality_metrics")]).first()
    assert (summary["total_tables"], summary["total_columns"], summary["relationships_found"], summary["row_count"]) == (2, 8, 1, 11)
    email = cq.describe_column(store.read("columns"), "customers", "email").first()
    assert email["is_pii"] == 1 and all("*" in v for v in email["sample_values"])
    assert {r["term"] for r in store.read("glossary").collect()} == {"AMOUNT", "STATUS"}
    kinds = {r["doc_type"]: r["n"] for r in store.read("documents").groupBy("doc_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"table": 2, "column": 8, "relationship": 1, "glossary": 2}
    assert [r["table_name"] for r in cq.tables_of_path(store.read("datasets"), store.read("tables"), "/data/crm").orderBy("table_name").collect()] == ["customers", "orders"]
    # A dataset that shrinks leaves nothing behind; other datasets stay.
    ingest.ingest(store, "other", "CSV", "/data/o", {"orders": tables["orders"]})
    ingest.ingest(store, "crm", "CSV", "/data/crm", {"customers": tables["customers"]})
    assert {(r["dataset"], r["table_name"]) for r in store.read("tables").collect()} == {("other", "orders"), ("crm", "customers")}
    assert store.read("relationships").count() == 0


def test_backfill_keeps_known_terms(spark, store):
    ingest.ingest(store, "crm", "CSV", "/data/crm", small_tables(spark))
    store.upsert("glossary", term(spark, [("STATUS", "written by hand")]))
    ingest.backfill_glossary(store)
    got = {r["term"]: r["definition"] for r in store.read("glossary").collect()}
    assert got["STATUS"] == "written by hand" and set(got) == {"AMOUNT", "STATUS"}


def test_streamed_traces_are_appended_once(spark, store, tmp_path):
    source = str(tmp_path / "answers")
    rows = [("Show email records", "mail bob@example.com", 5), ("Any null values?", "none", 7)]
    spark.createDataFrame(rows, "question string, answer string, latency_ms bigint").write.parquet(source)
    empty = F.array().cast("array<string>")

    def run():
        stream = spark.readStream.schema("question string, answer string, latency_ms bigint").parquet(source)
        shaped = traces.released_traces(stream).select(
            "question", "intent", empty.alias("plan"), empty.alias("tools_used"), empty.alias("context_retrieved"),
            "validation_status", "response", "latency_ms", F.current_timestamp().alias("timestamp"), F.lit("m").alias("model_used"),
        )
        traces.append_stream(store, "agent_logs", shaped, str(tmp_path / "checkpoint")).awaitTermination(120)

    run()
    run()
    got = {r["latency_ms"]: r for r in store.read_log("agent_logs").collect()}
    assert len(got) == 2 and store.read_log("agent_logs").count() == 2
    assert got[5]["validation_status"] == "PII_MASKED" and got[5]["response"] == "mail [REDACTED_EMAIL]"
    assert got[7]["intent"] == "QUALITY"
    latest = cq.latest(store.read_log("agent_logs"), "latency_ms", 1).first()
    assert latest["latency_ms"] == 7
    assert cq.last_event(store.read_log("failover_events"), "timestamp").collect() == []


def test_governed_query(spark):
    people = spark.range(200).selectExpr("id", "concat('u', id, '@x.org') AS email", "'555-0101' AS mobile_no")
    got = sqlgov.governed_query(spark, "-- all\nSELECT * FROM `my-people` ORDER BY id LIMIT 500;", {"my-people": people}).collect()
    assert len(got) == 50 and got[12]["email"] == "u**@x.org" and got[0]["mobile_no"] == "****-****-0101"
    alias = "SELECT email AS e FROM people WHERE id = 3"
    assert sqlgov.governed_query(spark, alias, {"people": people}).first()["e"] == "u*@x.org"
    assert sqlgov.governed_query(spark, alias, {"people": people}, strict=True).first()["e"] != "u3@x.org"
    assert not spark.catalog.tableExists("people")
    with pytest.raises(ValueError):
        sqlgov.governed_query(spark, "DROP TABLE people", {"people": people})


def test_sql_log(spark):
    columns = spark.createDataFrame([("Orders", "id"), ("Orders", "total"), ("users", "id")], "table_name string, column_name string")
    statements = [
        ("SELECT id FROM orders", None),
        ("select o.nope from ORDERS o join public.users on users.id = orders.total", None),
        ("SELECT orders.nope FROM orders", "Column 'nope' does not exist on table 'Orders'."),
        ("SELECT 1 FROM ghosts", "Table 'ghosts' referenced in SQL does not exist in the dataset catalog."),
        ("SELECT 1 -- FROM orders\n", "Could not extract any tables from the generated SQL query."),
        ("SELECT /* FROM\nghosts */ 1 FROM users", None),
    ]
    log = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(statements)], "sql_id int, sql_text string")
    got = {r["sql_id"]: r for r in sqlgov.sql_log_check(log, columns).collect()}
    for i, (_, message) in enumerate(statements):
        assert got[i]["message"] == message and got[i]["is_valid"] is (message is None)
    nothing = sqlgov.sql_log_check(log, columns.where("false")).where("sql_id = 0").first()
    assert nothing["is_valid"] is False


def test_scratch_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        assert session.fresh_dir(spark, "x").startswith(configured.rstrip("/"))


def test_a_part_of_the_catalog_is_the_same_as_in_the_whole(spark, store, tmp_path):
    tables = small_tables(spark)
    ingest.ingest(store, "d", "CSV", "p", tables)
    assert ingest.with_sources(["relationships"]) == ["columns", "relationships"]
    assert ingest.with_sources(["datasets"]) == list(ingest.PARTS)
    kept = catalog.CatalogStore(spark, str(tmp_path / "parts"))
    for step in ingest.with_sources(["relationships"]):  # one at a time, from what the store holds
        ingest.ingest(kept, "d", "CSV", "p", tables, parts=[step])
        got, want = (sorted(map(str, s.read(step).collect())) for s in (kept, store))
        assert got == want and got
    assert kept.read("datasets").count() == 0 and kept.read("quality_metrics").count() == 0


def test_log_check_carries_no_catalog(spark):
    """No row of the log holds the catalog, comments are taken out once, odd names are found."""
    columns = spark.createDataFrame(
        [("It's", "A\\b"), ("it's", "c"), ("t_1", "x1"), ("t_1", "y")], "table_name string, column_name string"
    )
    cases = [
        ("SELECT t_1.x1, t_1.z FROM db.t_1", "Column 'z' does not exist on table 't_1'."),
        ("SELECT 1t_1.y.z FROM T_1 -- join nowhere", "Table 'nowhere' referenced in SQL does not exist in the dataset catalog."),
        ("SELECT 1t_1.y.z FROM T_1 /* join nowhere */", None),
        ("SELECT 1 FROM a.b.", "Table '' referenced in SQL does not exist in the dataset catalog."),
        ("SELECT 1", sqlgov.NO_TABLE),
    ]
    log = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "sql_id int, sql_text string")
    checked = sqlgov.sql_log_check(log, columns)
    got = {r["sql_id"]: r["message"] for r in checked.collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}
    assert "Subquery" not in checked._jdf.queryExecution().executedPlan().toString()
