"""Questions in bulk."""

from __future__ import annotations

from quarrylens.plans import question_batch


def test_answer_batch(spark):
    docs = spark.createDataFrame(
        [("d1", "shop", "orders", "Table Name: orders"), ("d2", "shop", None, "Glossary Term: margin"), ("d3", "lab", "runs", "Table Name: runs")],
        "doc_id string, dataset string, table_name string, text string",
    )
    tables = spark.createDataFrame([("shop", "orders"), ("lab", "runs"), ("bare", "t")], "dataset string, table_name string")
    rows = [
        (1, "shop", "Which table holds orders?", "orders does", "main"),
        (2, "shop", "Which table holds orders?", "ask bob@example.com for the email", "Fallback"),
        (3, "lab", "margin email", "write to bob@example.com", "main"),
        (4, "bare", "margin", "[MASKED_PII_DATA]", "Fallback"),
        (5, "gone", "margin", "made up", "main"),
        (6, None, "margin", "made up", "main"),
        (7, "shop", None, "an answer", "main"),
        (8, "shop", "?!", None, "main"),
    ]
    asked = spark.createDataFrame(rows, "question_id int, dataset string, question string, answer string, model string")
    got = {r["question_id"]: r for r in question_batch.answer_batch(asked, question_batch.index_catalog(docs), docs, tables).collect()}
    assert sorted(got) == [r[0] for r in rows]
    assert got[1]["context"] == ["Table Name: orders", "Glossary Term: margin"] == got[2]["context"]
    assert got[1]["source_tables"] == ["orders"] and got[3]["source_tables"] == ["runs"]
    assert [got[i]["confidence"] for i in (1, 2, 4, 7)] == [0.9, 0.75, 0.65, 0.8]
    assert got[1]["intent"] == "METADATA" and got[1]["verdict"] == "PASSED" and got[1]["response"] == "orders does"
    assert got[3]["verdict"] == "REJECTED_RAW_DATA" and "bob" not in got[3]["response"]
    assert got[4]["context"] == [] and got[4]["verdict"] == "PII_MASKED"
    for i in (5, 6):
        assert got[i]["response"] == question_batch.NOTHING_FOUND and got[i]["confidence"] is None and got[i]["verdict"] == "PASSED"
    assert got[7]["context"] == [] == got[8]["context"]
