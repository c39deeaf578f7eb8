"""Questions in bulk: context from the catalog, confidence, checks, released answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylens.functions import questions as rules
from quarrylens.operators import tokenindex

# Fixed value: the answer where a dataset holds nothing about a question.
NOTHING_FOUND = "No relevant information found in the selected dataset."


def index_catalog(documents: DataFrame) -> tokenindex.TokenIndex:
    """The search index of catalog documents, scoped by dataset."""
    return tokenindex.build_index(documents, keep=["dataset", "table_name"])


def question_context(asked: DataFrame, index: tokenindex.TokenIndex, documents: DataFrame, k: int = 4) -> DataFrame:
    """query_id, context, source_tables for each row of `asked` (query_id, dataset,
    question) with hits: texts of its best k documents in order, tables behind them."""
    hits = tokenindex.search_index(index, asked, k=k, within=["dataset"])
    texts = hits.select("query_id", "rank", "doc_id", "table_name").join(documents.select("doc_id", "text"), "doc_id")
    found = texts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"),  # k at most
        F.array_sort(F.collect_set("table_name")).alias("source_tables"),
    )
    return found.select("query_id", F.transform("c", lambda x: x["text"]).alias("context"), "source_tables")


def answer_batch(
    questions: DataFrame, index: tokenindex.TokenIndex, documents: DataFrame, tables: DataFrame, k: int = 4
) -> DataFrame:
    """One row per row of `questions` (question_id, dataset, question, answer, model).

    Adds intent, is_numeric, the dataset's context, source_tables, confidence,
    verdict and the released response. A text asked many times of a dataset is
    searched once. A dataset that the catalog doesn't know and that gives no context
    gets NOTHING_FOUND, verdict PASSED and no confidence. Null texts ask nothing;
    a null dataset is an unknown one.
    """
    ask = F.sha2(F.to_json(F.struct("dataset", "question")), 256)
    q = questions.select("question_id", "dataset", "question", "answer", "model", ask.alias("query_id"))
    asked = q.select("query_id", "dataset", "question").distinct()
    known = tables.select(F.col("dataset").alias("d")).distinct()
    asked = asked.join(known, asked["dataset"] == F.col("d"), "left").select(
        "query_id", "dataset", "question", F.col("d").isNotNull().alias("known")
    )
    none = F.array().cast("array<string>")
    context = asked.select("query_id", "known").join(
        question_context(asked.select("query_id", "dataset", "question"), index, documents, k), "query_id", "left"
    ).select("query_id", "known", F.coalesce("context", none).alias("context"), F.coalesce("source_tables", none).alias("source_tables"))
    full = q.join(context, "query_id")
    text, answer = F.col("question"), F.col("answer")
    has_context = F.size("context") > 0
    grounded = has_context | F.col("known")
    return full.select(
        "question_id",
        "dataset",
        rules.question_intent(text).alias("intent"),
        rules.is_numeric_question(text).alias("is_numeric"),
        "context",
        "source_tables",
        F.when(grounded, rules.answer_confidence(F.col("model"), has_context)).alias("confidence"),
        F.when(grounded, rules.answer_verdict(text, answer)).otherwise("PASSED").alias("verdict"),
        F.when(grounded, rules.released_answer(text, answer)).otherwise(NOTHING_FOUND).alias("response"),
    )
