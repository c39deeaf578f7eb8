"""The corpus operators over their whole tables, and DuckDB SQL where it can
state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import (
    convrepair, decontam, htmltext, langid, licenses, linededup, minhash, mixing, pii, runs, shuffle, toxicity, vectors,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard similarity from 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n_words=3, num=17, den=20)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(_table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle.shard_report(_table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(_table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair_report(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_licenses, op3_surrogates, op4_main_text, op5_toxicity, op6_mix, op7_language, op8_lines,
        op9_vectors, op10_decontaminate, op11_shuffle, op12_runs, op13_repair,
    )
}

_REACH = """
ends AS (SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (
    SELECT x, y FROM ends
    UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x
), least AS (SELECT x, min(least(x, y)) AS component FROM reach GROUP BY x)"""

_KEY = (
    "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

ORACLE_SQL = {
    "op1_minhash": f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_KEY.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM w
), u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
    FROM u a JOIN u b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),{_REACH}
SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id,
    doc_id = coalesce(component, doc_id) AS kept
FROM s LEFT JOIN least ON x = doc_id""",
    "op8_lines": f"""
WITH l AS MATERIALIZED (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), k AS MATERIALIZED (
    SELECT *, {_KEY.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM l
), f AS (
    SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(last) FILTER (last <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (k) GROUP BY doc_id""",
    "op9_vectors": f"""
WITH RECURSIVE e AS MATERIALIZED (
    SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95
), c AS (SELECT a, count(*) AS n FROM link GROUP BY a),{_REACH}
SELECT vec_id, coalesce(c.n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
    vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN least ON x = vec_id""",
}
