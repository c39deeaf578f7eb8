"""A corpus from raw documents to a training mix, one operator a stage.

Every stage gets what its predecessor kept; all but the last return the columns
of `documents`. Rows without a doc_id pass the stages that go by ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens import session
from quarrylens.llm import common, decontam, langid, linededup, minhash, mixing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter and those
    that fit none go."""
    return langid.keep_identified(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat."""
    return linededup.deduplicate_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group (five-word shingles,
    Jaccard similarity from 0.8)."""
    gone = minhash.near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(common.if_bounded(session.cut_lineage(gone)), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix_report(docs)


STAGES = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Learned models, sketches and draws: no SQL states these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = session.fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
