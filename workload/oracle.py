"""DuckDB SQL that computes each registered query independently on the same tables."""

from __future__ import annotations

import re

from quarrylens.functions import masking, questions, text
from quarrylens.operators import glossary, quality, relations, sqlgov
from quarrylens.plans import catalog_queries as cq
from workload import queries as Q, views as V

rel = V.relation
LOGICAL = {"i": "INTEGER", "d": "FLOAT", "s": "TEXT", "t": "DATETIME", "a": "TEXT"}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def cell(column: str, kind: str) -> str:
    return f"CASE WHEN isnan({column}) THEN NULL ELSE {column} END" if kind == "d" else column


def parses(c: str) -> str:
    return (
        f"(try_strptime({c}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d/%m/%Y']) IS NOT NULL)"
    )


def mostly_dates(c: str) -> str:
    """At least 0.9 of the filled cells read as dates."""
    return f"(count({c}) > 0 AND count(*) FILTER (WHERE {c} IS NOT NULL AND {parses(c)}) >= 0.9::DOUBLE * count({c}))"


def view_columns(name: str) -> tuple[tuple[str, str], ...]:
    return V.COLUMNS[name]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- profiles --------------------------------------------------------------

ALL = {t: v for d in V.DATASETS for t, v in V.DATASETS[d].items()}


def facts(tables: dict[str, str]) -> str:
    """One row per column: the exact profile."""
    parts, column_id = [], 0
    for table, view in tables.items():
        for position, (c, k) in enumerate(view_columns(view)):
            v = cell(c, k)
            low_text = f"min({c})::VARCHAR" if k in "ist" else "NULL::VARCHAR"
            high_text = f"max({c})::VARCHAR" if k in "ist" else "NULL::VARCHAR"
            low_num = f"min({v})::DOUBLE" if k in "id" else "NULL::DOUBLE"
            high_num = f"max({v})::DOUBLE" if k in "id" else "NULL::DOUBLE"
            kind = lit(LOGICAL[k])
            if k == "s":
                kind = f"CASE WHEN {mostly_dates(c)} THEN 'DATETIME' ELSE 'TEXT' END"
            parts.append(
                f"SELECT {column_id} AS column_id, {lit(table)} AS table_name, {position} AS position, "
                f"{lit(c)} AS column_name, {kind} AS data_type, count(*) AS row_count, "
                f"count(*) - count({v}) AS null_count, count(DISTINCT {v}) AS distinct_count, "
                f"{low_text} AS min_text, {high_text} AS max_text, {low_num} AS min_num, {high_num} AS max_num "
                f"FROM {rel(view)}"
            )
            column_id += 1
    return union(parts)


PII = f"regexp_matches(lower(column_name), {lit('|'.join(masking.PII_NAME_PARTS))})"


def profile(tables: dict[str, str]) -> str:
    return f"""SELECT column_id, table_name, position, column_name, data_type, row_count, null_count,
        CASE WHEN row_count > 0 THEN round(null_count / row_count * 100, 2) ELSE 0.0::DOUBLE END AS null_percentage,
        distinct_count,
        CASE WHEN row_count > 0 THEN round(distinct_count / row_count, 2) ELSE 0.0::DOUBLE END AS uniqueness_ratio,
        row_count - distinct_count AS duplicate_count, min_text, max_text, min_num, max_num,
        {PII}::INT AS is_pii FROM ({facts(tables)})"""


def sample_value(column: str, kind: str) -> str:
    value = f"{column}::VARCHAR"
    return mask_sql(value, column) if masking.is_pii_name(column) else value


def samples(tables: dict[str, str], skip: set[str] = frozenset()) -> str:
    parts, column_id = [], 0
    for table, view in tables.items():
        keys = ", ".join(V.ORDER_KEYS[view])
        for c, k in view_columns(view):
            if c not in skip and k not in "a":
                parts.append(
                    f"SELECT {column_id} AS column_id, {lit(table)} AS table_name, {lit(c)} AS column_name, "
                    f"list(v ORDER BY n) AS sample_values FROM (SELECT {sample_value(c, k)} AS v, "
                    f"row_number() OVER (ORDER BY {keys}) AS n FROM {rel(view)} WHERE {cell(c, k)} IS NOT NULL) "
                    "WHERE n <= 5 HAVING count(*) > 0"
                )
            column_id += 1
    return union(parts)


def mask_sql(value: str, name: str) -> str:
    v = f"trim({value})"
    if "email" in name:
        parts = f"string_split({v}, '@')"
        hidden = (
            f"CASE WHEN len({parts}) = 2 THEN CASE WHEN length({parts}[1]) > 1 THEN "
            f"left({parts}[1], 1) || repeat('*', length({parts}[1]) - 1) ELSE '*' END || '@' || {parts}[2] "
            "ELSE '****@example.com' END"
        )
    elif "phone" in name or "mobile" in name:
        hidden = f"CASE WHEN length({v}) >= 4 THEN '****-****-' || right({v}, 4) ELSE '**********' END"
    elif "card" in name:
        hidden = f"CASE WHEN length({v}) >= 4 THEN '****-****-****-' || right({v}, 4) ELSE '****************' END"
    elif "password" in name or "secret" in name:
        hidden = "'********'"
    elif "salary" in name or "income" in name or "tax" in name:
        hidden = "'$XX,XXX'"
    else:
        hidden = "'[MASKED_PII_DATA]'"
    return f"CASE WHEN {value} IS NULL THEN NULL WHEN {v} = '' THEN '' ELSE {hidden} END"


# --- quality ---------------------------------------------------------------


def outlier_count(view: str, c: str, kind: str) -> str:
    v = cell(c, kind)
    return (
        f"(SELECT CASE WHEN max(n) < 5 OR max(q3) = max(q1) THEN 0 ELSE "
        "count(*) FILTER (WHERE v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)) END "
        f"FROM (SELECT {v} AS v FROM {rel(view)}), "
        f"(SELECT count({v}) AS n, quantile_cont({v}, 0.25)::DOUBLE AS q1, quantile_cont({v}, 0.75)::DOUBLE AS q3 FROM {rel(view)}))"
    )


def invalid_count(c: str, kind: str) -> str:
    if kind == "t":
        return "0"
    if "email" in c:
        return f"count(*) FILTER (WHERE NOT regexp_matches({c}, '^[\\p{{L}}\\p{{N}}_.-]+@[\\p{{L}}\\p{{N}}_.-]+\\.[\\p{{L}}\\p{{N}}_]+$'))"
    pattern = r"^\d{4}[-/]\d{2}[-/]\d{2}(?:\s\d{2}:\d{2}:\d{2})?$|^\d{2}[-/]\d{2}[-/]\d{4}$"
    wrong = f"count(*) FILTER (WHERE NOT regexp_matches({c}::VARCHAR, '{pattern}') AND NOT {parses(f'{c}::VARCHAR')})"
    if "date" in c:
        return wrong
    return f"CASE WHEN {mostly_dates(c)} THEN {wrong} ELSE 0 END" if kind == "s" else "0"


def details(tables: dict[str, str]) -> str:
    parts = []
    for table, view in tables.items():
        names = ", ".join(cell(c, k) + f" AS {c}" for c, k in view_columns(view))
        dup = (
            f"(SELECT count(*) FROM {rel(view)}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM (SELECT {names} FROM {rel(view)})))"
        )
        for position, (c, k) in enumerate(view_columns(view)):
            parts.append(
                f"SELECT {lit(table)} AS table_name, {position} AS position, {lit(c)} AS column_name, "
                f"count(*) AS row_count, count(*) - count({cell(c, k)}) AS missing, "
                f"{outlier_count(view, c, k) if k in 'id' else '0'} AS outliers, "
                f"{invalid_count(c, k)} AS invalid_formats, "
                f"{dup if position == 0 else '0'} AS duplicates FROM {rel(view)}"
            )
    return (
        "SELECT *, CASE WHEN row_count > 0 THEN round(missing / row_count * 100, 2) ELSE 0.0::DOUBLE END "
        f"AS missing_percentage FROM ({union(parts)})"
    )


def scores(details_sql: str) -> str:
    return f"""SELECT table_name, row_count::BIGINT AS row_count,
        CASE WHEN row_count = 0 THEN 0.0::DOUBLE ELSE round(greatest(least(100.0::DOUBLE - (
          least(missing_count / cells * 100 * 0.5::DOUBLE, 30.0::DOUBLE)
          + least(duplicate_count / row_count * 100 * 1.5::DOUBLE, 20.0::DOUBLE)
          + least(outlier_count / cells * 100 * 2.0::DOUBLE, 15.0::DOUBLE)
          + least(invalid_format_count / cells * 100 * 3.0::DOUBLE, 15.0::DOUBLE)), 100.0::DOUBLE), 0.0::DOUBLE), 1) END AS health_score,
        missing_count, duplicate_count, outlier_count, invalid_format_count
        FROM (SELECT table_name, max(row_count) AS row_count, max(row_count) * count(*) AS cells,
                sum(missing)::BIGINT AS missing_count, sum(duplicates)::BIGINT AS duplicate_count,
                sum(outliers)::BIGINT AS outlier_count, sum(invalid_formats)::BIGINT AS invalid_format_count
              FROM ({details_sql}) GROUP BY table_name)"""


def advice(details_sql: str) -> str:
    def fmt(template: str, *args: str) -> str:
        return f"printf({lit(template)}, {', '.join(args)})"

    rules = [
        (1, "duplicates > 0", fmt(quality.DUPLICATE_TEXT, "table_name", "duplicates::VARCHAR"), lit(quality.DUPLICATE_IMPACT)),
        (2, "missing_percentage > 20.0", fmt(quality.MISSING_TEXT, "column_name", "missing_percentage::VARCHAR"), fmt(quality.MISSING_IMPACT, "column_name")),
        (3, "invalid_formats > 0", fmt(quality.FORMAT_TEXT, "column_name", "invalid_formats::VARCHAR"), fmt(quality.FORMAT_IMPACT, "column_name")),
        (4, "outliers > 5", fmt(quality.OUTLIER_TEXT, "column_name", "outliers::VARCHAR"), fmt(quality.OUTLIER_IMPACT, "column_name")),
    ]
    found = union(
        [
            f"SELECT table_name, position * 10 + {rank} AS seq, {t} AS recommendation, {i} AS business_impact "
            f"FROM d WHERE row_count > 0 AND {cond}"
            for rank, cond, t, i in rules
        ]
    )
    return f"""WITH d AS MATERIALIZED ({details_sql}), found AS MATERIALIZED ({found})
        SELECT * FROM found UNION ALL
        SELECT table_name, 0 AS seq,
               CASE WHEN max(row_count) = 0 THEN {lit(quality.EMPTY_TABLE_TEXT)} ELSE {lit(quality.NO_ISSUE_TEXT)} END,
               CASE WHEN max(row_count) > 0 THEN {lit(quality.NO_ISSUE_IMPACT)} END
        FROM d WHERE table_name NOT IN (SELECT table_name FROM found) GROUP BY table_name"""


QUALITY = {v: v for v in Q.QUALITY_VIEWS}
QUALITY_EMPTY = {**QUALITY, "empty_orders": "empty_orders"}
QUALITY_DETAILS = details(QUALITY)
QUALITY_EMPTY_DETAILS = details(QUALITY_EMPTY)


def orphans() -> str:
    parts = []
    for p, pk, c, ck in Q.FOREIGN_KEYS:
        gone = f"{ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {rel(p)} WHERE {pk} IS NOT NULL)"
        parts.append(
            f"SELECT {lit(p)} AS parent_table, {lit(pk)} AS parent_column, {lit(c)} AS child_table, {lit(ck)} AS child_column, "
            f"count({ck}) AS child_count, count(*) FILTER (WHERE {gone}) AS orphan_count, "
            f"(SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT DISTINCT {ck} AS k FROM {rel(c)} WHERE {gone} ORDER BY k LIMIT 5)) AS sample_orphans "
            f"FROM {rel(c)}"
        )
    return (
        "SELECT parent_table, parent_column, child_table, child_column, child_count, orphan_count, "
        "round(orphan_count / child_count * 100, 2) AS orphan_percentage, sample_orphans "
        f"FROM ({union(parts)}) WHERE orphan_count > 0"
    )


def orphans_typed() -> str:
    """The pairs of keys of different types, each side cast to the type both have in common."""
    casts = {  # pair: (common type, text of a key)
        ("c_custkey", "buyer_key"): ("BIGINT", "{}::VARCHAR"),
        ("archive", "ledger", "total_key"): ("DECIMAL(18, 4)", "{}::VARCHAR"),
        ("archive", "invoices", "total_key"): ("DOUBLE", "{}::VARCHAR"),
        ("invoices", "ledger", "total_key"): ("DOUBLE", "{}::VARCHAR"),
        ("archive", "ledger", "day_key"): ("TIMESTAMP", "strftime({}, '%Y-%m-%d %H:%M:%S')"),
    }
    parts = []
    for p, pk, c, ck in Q.TYPED_KEYS:
        kind, shown = casts.get((p, c, ck)) or casts[pk, ck]
        parent = f"SELECT {pk}::{kind} AS k FROM {rel(p)} WHERE {pk} IS NOT NULL"
        parts.append(
            f"SELECT {lit(p)} AS parent_table, {lit(pk)} AS parent_column, {lit(c)} AS child_table, {lit(ck)} AS child_column, "
            f"count(k) AS child_count, count(k) FILTER (WHERE k NOT IN ({parent})) AS orphan_count, "
            f"(SELECT string_agg({shown.format('k')}, ',' ORDER BY k) FROM (SELECT DISTINCT {ck}::{kind} AS k FROM {rel(c)} "
            f"WHERE {ck}::{kind} NOT IN ({parent}) ORDER BY k LIMIT 5)) AS sample_orphans FROM (SELECT {ck}::{kind} AS k FROM {rel(c)})"
        )
    return (
        "SELECT *, round(orphan_count / child_count * 100, 2) AS orphan_percentage "
        f"FROM ({union(parts)}) WHERE orphan_count > 0"
    )


def overlaps_typed() -> str:
    pairs = (
        ("ledger", "archive", "total_key", "DECIMAL(18, 4)"), ("ledger", "archive", "day_key", "TIMESTAMP"),
        ("ledger", "invoices", "total_key", "DOUBLE"), ("archive", "invoices", "total_key", "DOUBLE"),
    )
    parts = []
    for a, b, c, kind in pairs:
        left, right = (f"SELECT DISTINCT {c}::{kind} AS v FROM {rel(t)} WHERE {c} IS NOT NULL" for t in (a, b))
        parts.append(
            f"SELECT {lit(a)} AS table_1, {lit(c)} AS column_1, {lit(b)} AS table_2, {lit(c)} AS column_2, "
            f"(SELECT count(*) FROM ({left})) AS a_distinct, (SELECT count(*) FROM ({right})) AS b_distinct, "
            f"(SELECT count(*) FROM ({left} INTERSECT {right})) AS shared"
        )
    return (
        "SELECT *, CASE WHEN least(a_distinct, b_distinct) > 0 THEN shared / least(a_distinct, b_distinct) ELSE 0.0::DOUBLE END AS overlap "
        f"FROM ({union(parts)})"
    )


# --- relationships ---------------------------------------------------------

CANDIDATES = """SELECT * FROM (SELECT *, uniqueness_ratio > 0.9 AND null_count = 0 AS is_pk FROM prof)
    WHERE is_pk OR lower(column_name) LIKE '%id' OR lower(column_name) LIKE '%key'
       OR lower(column_name) LIKE '%\\_code' ESCAPE '\\' OR lower(column_name) IN ('id', 'uuid', 'uid', 'code')"""

PAIRS = """SELECT a.column_id AS a_id, b.column_id AS b_id, a.table_name AS t1, a.column_name AS c1,
       b.table_name AS t2, b.column_name AS c2, a.is_pk AS pk1, b.is_pk AS pk2,
       a.distinct_count AS d1, b.distinct_count AS d2, a.row_count - a.null_count AS f1,
       b.row_count - b.null_count AS f2, a.n = b.n AS same_name
    FROM (SELECT *, regexp_replace(lower(column_name), '^(tbl_|t_)', '') AS n FROM cand) a
    JOIN (SELECT *, regexp_replace(lower(column_name), '^(tbl_|t_)', '') AS n FROM cand) b
      ON a.column_id < b.column_id AND a.table_name <> b.table_name AND a.data_type = b.data_type
     AND (a.n = b.n OR (ends_with(a.n, b.n) AND length(b.n) > 2) OR (ends_with(b.n, a.n) AND length(a.n) > 2))"""


def overlaps(tables: dict[str, str]) -> str:
    """Distinct and shared values of every pair whose names and kinds could match."""
    columns = [(t, v, c, k) for t, v in tables.items() for c, k in view_columns(v)]
    parts = []
    for i, (t1, v1, c1, k1) in enumerate(columns):
        for t2, v2, c2, k2 in columns[i + 1:]:
            short = min(len(c1), len(c2))
            if t1 == t2 or k1 != k2 or k1 == "a":
                continue
            if not (c1 == c2 or (short > 2 and (c1.endswith(c2) or c2.endswith(c1)))):
                continue
            left = f"SELECT DISTINCT {cell(c1, k1)} AS v FROM {rel(v1)} WHERE {cell(c1, k1)} IS NOT NULL"
            right = f"SELECT DISTINCT {cell(c2, k2)} AS v FROM {rel(v2)} WHERE {cell(c2, k2)} IS NOT NULL"
            parts.append(
                f"SELECT {lit(t1)} AS t1, {lit(c1)} AS c1, {lit(t2)} AS t2, {lit(c2)} AS c2, "
                f"(SELECT count(*) FROM ({left})) AS a_distinct, (SELECT count(*) FROM ({right})) AS b_distinct, "
                f"(SELECT count(*) FROM ({left} INTERSECT {right})) AS shared"
            )
    if not parts:
        return "SELECT NULL::VARCHAR AS t1, NULL::VARCHAR AS c1, NULL::VARCHAR AS t2, NULL::VARCHAR AS c2, 0 AS a_distinct, 0 AS b_distinct, 0 AS shared"
    return union(parts)


def relation_ctes(tables: dict[str, str]) -> str:
    return f"""prof AS MATERIALIZED ({profile(tables)}), cand AS MATERIALIZED ({CANDIDATES}), pairs AS MATERIALIZED ({PAIRS}),
    over AS MATERIALIZED (SELECT p.*, o.a_distinct, o.b_distinct, o.shared,
        CASE WHEN least(o.a_distinct, o.b_distinct) > 0 THEN o.shared / least(o.a_distinct, o.b_distinct) ELSE 0.0::DOUBLE END AS overlap
        FROM pairs p JOIN ({overlaps(tables)}) o USING (t1, c1, t2, c2)),
    based AS (SELECT *, 0.5::DOUBLE + CASE WHEN same_name THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN pk1 OR pk2 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS base FROM over),
    conf AS (SELECT *, least(greatest(CASE WHEN overlap > 0.8 THEN base + 0.2::DOUBLE WHEN overlap > 0.3 THEN base + 0.1::DOUBLE
        WHEN overlap = 0 THEN base - 0.3::DOUBLE ELSE base END, 0.0::DOUBLE), 1.0::DOUBLE) AS confidence FROM based),
    kept AS (SELECT *, pk1 OR d1 >= 0.95::DOUBLE * d2 AS u1, pk2 OR d2 >= 0.95::DOUBLE * d1 AS u2,
        pk1 OR d1 >= 0.95::DOUBLE * f1 AS r1, pk2 OR d2 >= 0.95::DOUBLE * f2 AS r2
        FROM conf WHERE confidence >= 0.4::DOUBLE),
    typed AS MATERIALIZED (SELECT *, u2 AND NOT u1 AS flip,
        CASE WHEN u1 AND u2 THEN 'one-to-one' WHEN u1 THEN 'one-to-many' WHEN u2 THEN 'many-to-one' ELSE 'many-to-many' END AS type,
        CASE WHEN r1 AND r2 THEN 'one-to-one' WHEN r1 THEN 'one-to-many' WHEN r2 THEN 'many-to-one' ELSE 'many-to-many' END AS type_by_rows
        FROM kept),
    rels AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a_id, b_id)::INT - 1 AS position,
        CASE WHEN flip THEN t2 ELSE t1 END AS source_table, CASE WHEN flip THEN c2 ELSE c1 END AS source_column,
        CASE WHEN flip THEN t1 ELSE t2 END AS target_table, CASE WHEN flip THEN c1 ELSE c2 END AS target_column,
        round(confidence, 2) AS confidence, type,
        CASE WHEN flip THEN 'second-to-first' ELSE 'first-to-second' END AS direction,
        round(overlap, 2) AS overlap_percentage,
        printf('SELECT * FROM %s JOIN %s ON %s.%s = %s.%s',
            CASE WHEN flip THEN t2 ELSE t1 END, CASE WHEN flip THEN t1 ELSE t2 END,
            CASE WHEN flip THEN t2 ELSE t1 END, CASE WHEN flip THEN c2 ELSE c1 END,
            CASE WHEN flip THEN t1 ELSE t2 END, CASE WHEN flip THEN c1 ELSE c2 END) AS join_suggestion,
        printf('Matched by column names ''%s'' / ''%s'' with estimated %s%% value overlap.', c1, c2,
            trunc(overlap * 100)::INT::VARCHAR) AS reason
        FROM typed)"""


RELATIONS = relation_ctes(ALL)
PAIR_OUT = "t1 AS table_1, c1 AS column_1, t2 AS table_2, c2 AS column_2"


# --- the stored catalog ----------------------------------------------------


def rels_of(dataset: str) -> str:
    return f"WITH {relation_ctes(V.DATASETS[dataset])} SELECT {lit(dataset)} AS dataset, * FROM rels"


COLUMN_TEXT = f"CASE WHEN length(column_name) % {Q.BLANK_EVERY} = 0 THEN '' ELSE printf({lit(cq.COLUMN_TEXT)}, column_name) END"
TABLE_TEXT = f"printf({lit(cq.TABLE_TEXT)}, table_name)"


def catalog_columns(*datasets: str, with_samples: bool = False) -> str:
    parts = []
    for d in datasets or tuple(V.DATASETS):
        base = f"SELECT {lit(d)} AS dataset, *, {COLUMN_TEXT} AS description FROM ({profile(V.DATASETS[d])})"
        if with_samples:
            base = f"SELECT c.*, s.sample_values FROM ({base}) c LEFT JOIN ({samples(V.DATASETS[d])}) s USING (column_id)"
        parts.append(base)
    return union([f"({p})" for p in parts])


def catalog_tables(*datasets: str) -> str:
    parts = []
    for d in datasets or tuple(V.DATASETS):
        for t, v in V.DATASETS[d].items():
            names = "[" + ", ".join(lit(c) for c, _ in view_columns(v)) + "]"
            parts.append(
                f"SELECT {lit(d)} AS dataset, {lit(t)} AS table_name, (SELECT count(*) FROM {rel(v)}) AS row_count, "
                f"printf({lit(cq.TABLE_TEXT)}, {lit(t)}) AS description, {names} AS columns"
            )
    return union(parts)


def catalog_quality(*datasets: str) -> str:
    parts = []
    for d in datasets or tuple(V.DATASETS):
        parts.append(f"(SELECT {lit(d)} AS dataset, * FROM ({scores(details(V.DATASETS[d]))}))")
    return union(parts)


def terms(columns_sql: str, order: str = "column_id") -> str:
    pattern = "|".join(glossary.TERM_NAME_PARTS)
    return f"""SELECT upper(column_name) AS term, printf({lit(glossary.DEFINITION)}, column_name) AS definition,
        printf({lit(glossary.MEANING)}, replace(column_name, '_', ' ')) AS business_meaning,
        {lit(glossary.USAGE)} AS business_usage, coalesce(sample_values[1], 'N/A') AS example_val
        FROM ({columns_sql}) WHERE regexp_matches(lower(column_name), {lit(pattern)})
        QUALIFY row_number() OVER (PARTITION BY lower(column_name) ORDER BY {order}) = 1"""


# A term's example never comes from a double column of the test tables' samples
# except prices; numbers print alike there.


def documents(dataset: str, terms_sql: str) -> str:
    columns, tables = catalog_columns(dataset), catalog_tables(dataset)
    return f"""SELECT printf('ds_%s_tbl_%s', dataset, table_name) AS doc_id, 'table' AS doc_type, dataset, table_name,
          printf('Table Name: %s\nDescription: %s\nColumns: %s', table_name, description, array_to_string(columns, ', ')) AS text
        FROM ({tables})
      UNION ALL SELECT printf('ds_%s_col_%s_%s', dataset, table_name, column_name), 'column', dataset, table_name,
          printf('Column Name: %s\nTable: %s\nData Type: %s\nPrivacy: %s\nDescription: %s', column_name, table_name, data_type,
            CASE WHEN is_pii = 1 THEN {lit(masking.PII_LABEL)} ELSE {lit(masking.NON_PII_LABEL)} END, description)
        FROM ({columns})
      UNION ALL SELECT printf('ds_%s_rel_%s', dataset, position::VARCHAR), 'relationship', dataset, source_table,
          printf('Relationship: Table %s links to %s on keys (%s -> %s). Confidence: %s. Type: %s. Details: %s',
            source_table, target_table, source_column, target_column, confidence::VARCHAR, type, reason)
        FROM ({rels_of(dataset)})
      UNION ALL SELECT printf('ds_%s_glossary_%s', {lit(dataset)}, term), 'glossary', {lit(dataset)}, NULL,
          printf('Glossary Term: %s\nDefinition: %s\nBusiness Meaning: %s\nUsage Context: %s', term, definition, business_meaning, business_usage)
        FROM ({terms_sql})"""


def token_hits(source: str, key: str, queries: tuple[str, ...], k: int, keep: str = "") -> str:
    extra = f", {keep}" if keep else ""
    parts = []
    for number, q in enumerate(queries):
        tokens = list(dict.fromkeys(re.findall(r"\w+", q.lower())))
        listed = "[" + ", ".join(lit(t) for t in tokens) + "]"
        inside = " + ".join(f"contains(low, {lit(t)})::INT" for t in tokens)
        parts.append(
            f"SELECT {number} AS query_id, {key}{extra}, len(list_intersect({listed}, words)) / {len(tokens)} "
            f"+ 0.2::DOUBLE * ({inside}) AS score FROM prepared"
        )
    return f"""SELECT query_id, {key}{extra}, rank, score, round(1.0::DOUBLE - score, 3) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key})::INT AS rank FROM (
          WITH prepared AS MATERIALIZED (SELECT {key}{extra}, lower(text) AS low,
             list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS words FROM ({source}))
          {union(parts)})) WHERE rank <= {k}"""


def asked_hits(source: str, asked: str, k: int, keep: str, within: str = "true") -> str:
    """Best k documents of each question of a table (query_id, question, dataset)."""
    words = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
    return f"""SELECT query_id, doc_id, {keep}, rank, score, round(1.0::DOUBLE - score, 3) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
          WITH prepared AS MATERIALIZED (SELECT doc_id, {keep}, lower(coalesce(text, '')) AS low, {words.format("coalesce(text, '')")} AS words
                 FROM ({source})),
               asked AS MATERIALIZED (SELECT *, {words.format("coalesce(question, '')")} AS t FROM ({asked}))
          SELECT query_id, doc_id, {', '.join('prepared.' + c for c in keep.split(', '))}, len(list_intersect(t, words)) / len(t)
            + 0.2::DOUBLE * len(list_filter(t, lambda x: contains(low, x))) AS score
          FROM prepared JOIN asked ON len(t) > 0 AND {within})) WHERE rank <= {k}"""


def question_pipeline(documents_sql: str, tables_sql: str) -> str:
    """Context, confidence, verdict and released answer of each logged question."""
    log = f"SELECT event_id AS question_id, {Q.ASKED_DATASET} AS dataset, question, answer, model FROM ({V.VIEW_SQL['question_log']})"
    asked = f"SELECT DISTINCT dataset || '|' || question AS query_id, dataset, question FROM ({log})"
    hits = asked_hits(documents_sql, asked, 4, "dataset, table_name, text", "prepared.dataset = asked.dataset")
    confidence = """round(greatest(0.90::DOUBLE - CASE WHEN contains(model, 'Fallback') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
        - CASE WHEN len(context) > 0 THEN 0.0::DOUBLE ELSE 0.10::DOUBLE END, 0.50::DOUBLE), 2)"""
    return f"""WITH found AS MATERIALIZED (SELECT query_id, list(text ORDER BY rank) AS context,
            coalesce(list_sort(list_distinct(list(table_name))), []) AS source_tables FROM ({hits}) GROUP BY query_id),
          answered AS (SELECT l.* EXCLUDE (query_id), coalesce(context, []) AS context, coalesce(source_tables, []) AS source_tables,
            dataset IN (SELECT dataset FROM ({tables_sql})) OR len(coalesce(context, [])) > 0 AS grounded
            FROM (SELECT *, dataset || '|' || question AS query_id FROM ({log})) l LEFT JOIN found USING (query_id))
        SELECT question_id, dataset, {intent('question')} AS intent, {mentions('question', questions.NUMERIC_PHRASES)} AS is_numeric,
          context, source_tables, CASE WHEN grounded THEN {confidence} END AS confidence,
          CASE WHEN grounded THEN {VERDICT} ELSE 'PASSED' END AS verdict,
          CASE WHEN grounded THEN {RELEASED} ELSE 'No relevant information found in the selected dataset.' END AS response FROM answered"""


def knn(k: int, where: str = "true", keep: str = "") -> str:
    return f"""SELECT query_id, rank, vec_id{keep}, round(distance, 6) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM (
          SELECT q.vec_id AS query_id, e.vec_id{', e.label' if keep else ''},
            list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(e.embedding, q.embedding),
              lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), lambda a, b: a + b) AS distance
          FROM (SELECT * FROM embeddings WHERE {where}) e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= {k}"""


# --- texts, questions and logged SQL ---------------------------------------


def scrub(c: str) -> str:
    for pattern, label in text.SCRUB_PATTERNS.values():
        c = f"regexp_replace({c}, '{pattern}', '{label}', 'g')"
    return c


def mentions(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {lit(p)})" for p in phrases) + ")"


def intent(c: str) -> str:
    cases = " ".join(f"WHEN {mentions(c, p)} THEN '{name}'" for name, p in questions.INTENT_PHRASES)
    return f"CASE {cases} ELSE '{questions.OTHER_INTENT}' END"


REJECT = (
    "((contains(lower(question), 'email') OR contains(lower(answer), 'select')) "
    "AND contains(answer, '@') AND NOT contains(answer, '[REDACTED_EMAIL]'))"
)
VERDICT = (
    f"CASE WHEN {REJECT} THEN 'REJECTED_RAW_DATA' WHEN contains(answer, '[MASKED_') OR contains(answer, '[REDACTED_') "
    "THEN 'PII_MASKED' ELSE 'PASSED' END"
)
RELEASED = f"CASE WHEN {REJECT} THEN {lit(questions.DENIAL)} ELSE answer END"

CLEAN_SQL = "regexp_replace(regexp_replace(sql_text, '--.*?\\n', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')"
REFS = (
    "list_sort(list_distinct(list_transform(regexp_extract_all("
    f"{CLEAN_SQL}, '(?i)(?:FROM|JOIN)\\s+[`\"\\[]?([\\p{{L}}\\p{{N}}_.-]+)[`\"\\]]?', 1), "
    "lambda t: string_split(t, '.')[-1])))"
)
COLUMN_PAIRS = (
    "list_sort(list_distinct(regexp_extract_all("
    f"lower({CLEAN_SQL}), '([\\p{{L}}_][\\p{{L}}\\p{{N}}_]*\\.[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*)', 1)))"
)
TRACE = f"""SELECT event_id AS latency_ms, question, {intent('question')} AS intent,
    {VERDICT} AS validation_status, {RELEASED} AS response, model AS model_used
    FROM (SELECT * REPLACE ({scrub('answer')} AS answer) FROM ({V.VIEW_SQL['question_log']}))"""
SECRET_FREE = "message"
for _s in Q.SECRETS:
    SECRET_FREE = f"replace({SECRET_FREE}, {lit(_s)}, '[REDACTED_API_KEY]')"


def sql_check() -> str:
    names = {t: sorted(c for c, _ in view_columns(v)) for t, v in V.DATASETS["shop"].items()}
    tables = "[" + ", ".join(lit(t) for t in names) + "]"
    pairs = "[" + ", ".join(lit(f"{t}.{c}") for t, cs in names.items() for c in cs) + "]"
    return f"""WITH r AS (SELECT sql_id, {REFS} AS refs, {COLUMN_PAIRS} AS pairs FROM ({V.VIEW_SQL['sql_log']})),
      u AS (SELECT *, list_filter(refs, lambda t: NOT list_contains({tables}, lower(t))) AS unknown,
        list_filter(pairs, lambda p: list_contains(list_transform(refs, lambda t: lower(t)), string_split(p, '.')[1])
          AND NOT list_contains({pairs}, p)) AS bad FROM r),
      m AS (SELECT sql_id, CASE WHEN len(refs) = 0 THEN {lit(sqlgov.NO_TABLE)}
        WHEN len(unknown) > 0 THEN printf({lit(sqlgov.UNKNOWN_TABLE)}, unknown[1])
        WHEN len(bad) > 0 THEN printf({lit(sqlgov.UNKNOWN_COLUMN)}, string_split(bad[1], '.')[2], string_split(bad[1], '.')[1]) END AS message FROM u)
      SELECT sql_id, message IS NULL AS is_valid, message FROM m"""


MASKED_EVENTS = V.VIEW_SQL["dirty_events"]


def contexts() -> str:
    line = (
        "'  - ' || column_name || ' (' || data_type || ')' || CASE WHEN is_pii = 1 THEN ' (PII - SENSITIVE)' ELSE '' END "
        "|| ': ' || description"
    )
    sampled = (
        "'  - ' || column_name || ' (' || data_type || '): ' || description || ' | Samples: [' || "
        "array_to_string(sample_values[1:3], ', ') || ']'"
    )
    return f"""SELECT t.dataset, t.table_name, 'Table: ' || t.table_name || chr(10) || 'Description: ' || t.description || chr(10)
          || 'Columns:' || chr(10) || l.lines AS context, 'plain' AS variant
        FROM ({catalog_tables()}) t JOIN (SELECT dataset, table_name, string_agg({line}, chr(10) ORDER BY position) AS lines
          FROM ({catalog_columns()}) GROUP BY ALL) l USING (dataset, table_name)
      UNION ALL SELECT t.dataset, t.table_name, 'Table: ' || t.table_name || ' (Row count: ' || t.row_count || ', Description: '
          || t.description || ')' || chr(10) || l.lines, 'samples'
        FROM ({catalog_tables('activity')}) t JOIN (SELECT dataset, table_name, string_agg({sampled}, chr(10) ORDER BY position) AS lines
          FROM ({catalog_columns('activity', with_samples=True)}) WHERE data_type <> 'FLOAT' GROUP BY ALL) l USING (dataset, table_name)"""


def build() -> dict[str, str]:
    events_details = details({"dirty_events": "dirty_events"})
    dataset_rows = union(
        [
            f"SELECT {lit(d)} AS dataset, " + " + ".join(f"(SELECT count(*) FROM {rel(v)})" for v in V.DATASETS[d].values()) + " AS row_count"
            for d in V.DATASETS
        ]
    )
    shop_cols, shop_tabs = catalog_columns("shop"), catalog_tables("shop")
    all_joined = f"""SELECT c.dataset, c.table_name, c.column_id, c.column_name, c.data_type, c.description AS column_desc, t.description AS table_desc
        FROM ({catalog_columns()}) c JOIN ({catalog_tables()}) t USING (dataset, table_name)"""
    shop_documents = documents("shop", terms(catalog_columns("shop", with_samples=True)))
    catalog_hits = token_hits(shop_documents, "doc_id", Q.CATALOG_QUERIES, 4, "table_name")
    every_term = union(
        [f"(SELECT term, definition, business_meaning, business_usage FROM ({terms(catalog_columns(d, with_samples=True))}))" for d in V.DATASETS]
    )
    uploaded = union(
        [
            f"SELECT {lit(d)} AS name, 'PARQUET' AS type, 'tables/{d}' AS file_path, DATE '2024-06-01' + {i} AS day"
            for i, d in enumerate(V.DATASETS)
        ]
    )
    sql: dict[str, str] = {
        "scan_csv": f"SELECT c_custkey, c_name, c_nationkey, {cell('c_acctbal', 'd')} AS c_acctbal, c_mktsegment FROM {rel('dirty_customer')}",
        "scan_json": None,
        "flatten_nested": None,
        "crawl_tables": union([f"SELECT {lit(t)} AS table_name, count(*) AS row_count, {len(view_columns(v))} AS column_count FROM {rel(v)}" for t, v in ALL.items()]),
        "profile_schema_only": None,
        "scan_folder": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "row_cap": """SELECT l_linenumber, count(*) AS n, max(l_orderkey) AS last_order FROM (
            SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000) GROUP BY l_linenumber""",
        "dataset_row_count": dataset_rows,
        "upsert_replace": """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders
              QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
            SELECT c_custkey, coalesce('order ' || o_orderkey, c_name) AS c_name, coalesce(o_totalprice, c_acctbal) AS c_acctbal
            FROM customer LEFT JOIN o ON c_custkey = o_custkey""",
        "upsert_ignore": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer",
        "append_rows": f"SELECT t.*, e.message AS error_message FROM ({TRACE}) t JOIN ({V.VIEW_SQL['error_log']}) e ON t.latency_ms = e.event_id",
        "profile_types": f"SELECT table_name, column_name, data_type, row_count - null_count AS filled_count FROM ({facts(ALL)})",
        "profile_columns": profile(ALL),
        "profile_minmax": "SELECT table_name, column_name, min_text, max_text, min_num, max_num FROM ("
        + facts({v: v for v in ("dirty_customer", "dirty_events", "lineitem", "orders", "documents")}) + ")",
        "profile_samples": "SELECT table_name, column_name, array_to_string(sample_values, '|') AS samples FROM ("
        + samples({v: v for v in ("dirty_events", "dirty_customer", "orders")}, {"value", "c_acctbal", "o_totalprice"}) + ")",
        "pii_columns": f"""SELECT table_name, column_name, {PII}::INT AS is_pii,
            CASE WHEN {PII} THEN {lit(masking.PII_LABEL)} ELSE {lit(masking.NON_PII_LABEL)} END AS label, row_count - null_count AS filled_count
            FROM ({facts({v: v for v in ("dirty_events", "dirty_customer", "lineitem", "documents")})})""",
        "mask_values": "SELECT event_id, "
        + ", ".join(f"{mask_sql(f'{c}::VARCHAR', c)} AS {c}" for c in ("user_email", "user_phone", "card_no", "salary"))
        + f", {mask_sql('event_type', 'secret_word')} AS secret_word, {mask_sql('user_id::VARCHAR', 'passport')} AS passport, "
        f"{mask_sql('user_id::VARCHAR', 'phone')} AS short_phone FROM {rel('dirty_events')}",
        "masked_query": f"""SELECT event_id, {mask_sql('user_email', 'user_email')} AS user_email, {mask_sql('user_phone', 'user_phone')} AS user_phone,
            {mask_sql('salary::VARCHAR', 'salary')} AS salary, event_type FROM (SELECT * FROM {rel('dirty_events')}
            WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 50)""",
        "masked_query_strict": f"""SELECT contact, count(*) AS n FROM (SELECT {mask_sql('user_email', 'user_email')} AS contact
            FROM {rel('dirty_events')}) WHERE contact IS NOT NULL GROUP BY contact ORDER BY n DESC, contact LIMIT 50""",
        "scrub_text": f"SELECT doc_id, {scrub('text')} AS scrubbed FROM documents",
        "scrub_pages": f"SELECT page_id, {scrub('html')} AS scrubbed FROM pages",
        "pii_hit_counts": "SELECT lang, source, count(*) AS documents, "
        + ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {k}_hits" for k, (p, _) in text.SCRUB_PATTERNS.items())
        + " FROM documents GROUP BY lang, source",
        "redact_keys": f"SELECT event_id, regexp_replace({SECRET_FREE}, '{text.KEY_PATTERN}', 'key=[REDACTED]', 'g') AS message FROM ({V.VIEW_SQL['error_log']})",
        "response_audit": f"SELECT event_id, {VERDICT} AS verdict, {RELEASED} AS released FROM ({V.VIEW_SQL['question_log']})",
        "quality_missing": f"SELECT table_name, sum(missing)::BIGINT AS missing_count, max(row_count) AS row_count FROM ({QUALITY_DETAILS}) GROUP BY table_name",
        "quality_duplicates": f"SELECT table_name, sum(duplicates)::BIGINT AS duplicates FROM ({QUALITY_DETAILS}) GROUP BY table_name",
        "quality_email_format": f"SELECT column_name, invalid_formats FROM ({events_details}) WHERE column_name = 'user_email'",
        "quality_date_format": f"SELECT column_name, invalid_formats FROM ({events_details}) WHERE column_name IN ('event_date', 'logged_at', 'ts')",
        "quality_column_details": f"SELECT table_name, column_name, missing, missing_percentage, outliers, invalid_formats FROM ({QUALITY_DETAILS})",
        "health_score": scores(QUALITY_EMPTY_DETAILS),
        "health_score_empty": f"""SELECT s.*, CASE WHEN row_count = 0 THEN {lit(quality.EMPTY_TABLE_TEXT)} END AS recommendation
            FROM ({scores(details({v: v for v in ('empty_orders', 'dirty_customer')}))}) s""",
        "quality_recommendations": advice(QUALITY_EMPTY_DETAILS),
        "orphan_records": orphans(),
        "orphan_records_typed": orphans_typed(),
        "dataset_health": f"SELECT coalesce(round(avg(health_score), 1), 100.0::DOUBLE) AS health_score FROM ({scores(QUALITY_DETAILS)})",
        "health_band": f"SELECT table_name, CASE WHEN health_score < 70 THEN 'red' WHEN health_score < 90 THEN 'yellow' ELSE 'green' END AS band FROM ({scores(QUALITY_EMPTY_DETAILS)})",
        "top_recommendations": f"SELECT table_name, recommendation FROM ({advice(QUALITY_DETAILS)}) WHERE NOT contains(recommendation, 'No critical issues') ORDER BY table_name, seq LIMIT 5",
        "key_candidates": f"WITH prof AS ({profile(ALL)}) SELECT table_name, column_name, data_type, distinct_count, is_pk FROM ({CANDIDATES})",
        "name_matched_pairs": f"WITH prof AS ({profile(ALL)}), cand AS ({CANDIDATES}), pairs AS ({PAIRS}) SELECT {PAIR_OUT}, same_name FROM pairs",
        "value_overlap": f"WITH {RELATIONS} SELECT {PAIR_OUT}, a_distinct, b_distinct, shared, overlap FROM over",
        "value_overlap_typed": overlaps_typed(),
        "relationship_confidence": f"WITH {RELATIONS} SELECT {PAIR_OUT}, round(confidence, 2) AS confidence FROM kept",
        "relationship_cardinality": f"""WITH {RELATIONS} SELECT CASE WHEN flip THEN t2 ELSE t1 END AS table_1, CASE WHEN flip THEN c2 ELSE c1 END AS column_1,
            CASE WHEN flip THEN t1 ELSE t2 END AS table_2, CASE WHEN flip THEN c1 ELSE c2 END AS column_2, type,
            CASE WHEN flip THEN 'second-to-first' ELSE 'first-to-second' END AS direction, type_by_rows FROM typed""",
        "discover_relationships": f"WITH {RELATIONS} SELECT * FROM rels",
        "relationship_edges": f"""WITH {RELATIONS} SELECT source_table, target_table, source_column, target_column, confidence, type FROM rels
            QUALIFY row_number() OVER (PARTITION BY source_table, target_table ORDER BY position DESC) = 1""",
        "relationship_degrees": f"""WITH {RELATIONS}, e AS (SELECT DISTINCT source_table, target_table FROM rels)
            SELECT table_name, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
              SELECT source_table AS table_name, 1 AS o, 0 AS i FROM e UNION ALL SELECT target_table, 0, 1 FROM e) GROUP BY table_name""",
        "schema_explorer": f"""SELECT t.table_name, t.row_count, t.description, c.column_list FROM ({shop_tabs}) t LEFT JOIN (
            SELECT table_name, string_agg(concat_ws('/', column_name, data_type, description, is_pii::VARCHAR), '; ' ORDER BY position) AS column_list
            FROM ({shop_cols}) GROUP BY table_name) c USING (table_name)""",
        "catalog_search": f"""SELECT dataset, table_name, column_name, data_type, column_desc, table_desc FROM ({all_joined})
            WHERE column_name ILIKE '%KEY%' OR column_desc ILIKE '%KEY%' OR table_name ILIKE '%KEY%' OR table_desc ILIKE '%KEY%'
            ORDER BY dataset, column_id LIMIT 20""",
        "describe_table": f"""SELECT t.dataset, t.table_name, t.row_count, t.description AS table_desc, c.position, c.column_name, c.data_type,
            c.description AS column_desc, c.is_pii, c.distinct_count, c.null_count FROM ({shop_tabs}) t JOIN ({shop_cols}) c USING (dataset, table_name)
            WHERE t.table_name = 'customer'""",
        "describe_column": f"""SELECT dataset, data_type, null_count, distinct_count, min_text, max_text, description, is_pii, null_percentage,
            uniqueness_ratio, duplicate_count, array_to_string(sample_values, '|') AS samples
            FROM ({catalog_columns('activity', with_samples=True)}) WHERE column_name = 'user_email'""",
        "list_relationships": f"SELECT * EXCLUDE (dataset) FROM ({rels_of('shop')})",
        "list_quality": union(
            [
                f"""(SELECT {lit(d)} AS dataset, s.*, x.details, y.recommendations FROM ({scores(details(V.DATASETS[d]))}) s
                JOIN (SELECT table_name, string_agg(concat_ws(':', column_name, missing, outliers, invalid_formats), ' ' ORDER BY position) AS details
                  FROM ({details(V.DATASETS[d])}) GROUP BY table_name) x USING (table_name)
                JOIN (SELECT table_name, string_agg(recommendation, ' / ' ORDER BY seq) AS recommendations
                  FROM ({advice(details(V.DATASETS[d]))}) GROUP BY table_name) y USING (table_name))"""
                for d in ("shop", "activity")
            ]
        ),
        "dataset_summary": f"""SELECT d.name, d.type, r.row_count::BIGINT AS row_count, t.n AS total_tables, c.n AS total_columns,
            coalesce(x.n, 0) AS relationships_found, coalesce(round(h.v, 1), 100.0::DOUBLE) AS health_score
            FROM ({uploaded}) d JOIN ({dataset_rows}) r ON r.dataset = d.name
            LEFT JOIN (SELECT dataset, count(*) AS n FROM ({catalog_tables()}) GROUP BY 1) t ON t.dataset = d.name
            LEFT JOIN (SELECT dataset, count(*) AS n FROM ({catalog_columns()}) GROUP BY 1) c ON c.dataset = d.name
            LEFT JOIN (SELECT dataset, count(*) AS n FROM ({union([f'({rels_of(d)})' for d in V.DATASETS])}) GROUP BY 1) x ON x.dataset = d.name
            LEFT JOIN (SELECT dataset, avg(health_score) AS v FROM ({catalog_quality()}) GROUP BY 1) h ON h.dataset = d.name""",
        "glossary_search": f"""SELECT * FROM ({union([f"({terms(catalog_columns(d, with_samples=True))})" for d in V.DATASETS])})
            WHERE term ILIKE '%price%' OR definition ILIKE '%price%' OR business_meaning ILIKE '%price%' ORDER BY term""",
        "catalog_kpis": f"""SELECT 3::BIGINT AS total_datasets, (SELECT count(*) FROM ({shop_tabs})) AS total_tables,
            (SELECT count(*) FROM ({shop_cols})) AS total_columns, (SELECT count(*) FROM ({rels_of('shop')})) AS total_relationships,
            (SELECT coalesce(round(avg(health_score), 1), 100.0::DOUBLE) FROM ({catalog_quality('shop')})) AS health_score,
            (SELECT count(*) FROM events) AS questions_handled""",
        "catalog_coverage": f"""SELECT count(*) FILTER (WHERE description <> '') AS described_columns, count(*) AS total_columns,
            CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE description <> '') / count(*) * 100, 1) ELSE 0.0::DOUBLE END AS coverage FROM ({shop_cols})""",
        "tables_by_size": f"SELECT table_name, row_count FROM ({shop_tabs}) ORDER BY row_count DESC, table_name",
        "table_health": f"""SELECT table_name, health_score, CASE WHEN health_score < 70 THEN 'red' WHEN health_score < 90 THEN 'yellow' ELSE 'green' END AS band
            FROM ({catalog_quality('shop')})""",
        "latest_events": "SELECT event_id, user_id, event_type, value, props FROM events ORDER BY event_id DESC LIMIT 20",
        "last_event": f"SELECT * FROM ({V.VIEW_SQL['error_log']}) ORDER BY event_id DESC LIMIT 1",
        "list_datasets": f"""SELECT d.name, d.type, d.file_path, r.row_count::BIGINT AS row_count, strftime(d.day, '%Y-%m-%d') AS uploaded_at,
            CASE WHEN d.name = 'corpus' THEN (SELECT string_agg(table_name, ',' ORDER BY table_name) FROM ({catalog_tables('corpus')})) END AS table_names
            FROM ({uploaded}) d JOIN ({dataset_rows}) r ON r.dataset = d.name""",
        "tables_of_path": f"SELECT table_name FROM ({catalog_tables('corpus')}) JOIN ({uploaded}) ON name = dataset WHERE file_path = 'tables/corpus'",
        "explorer_view": f"""SELECT table_name, column_name, data_type, array_to_string(sample_values[1:3], ', ') AS sample_text, null_count, distinct_count,
            CASE WHEN is_pii = 1 THEN 'SENSITIVE' ELSE 'PUBLIC' END AS pii_status, description
            FROM ({catalog_columns('activity', with_samples=True)}) WHERE data_type <> 'FLOAT'""",
        "relationship_view": f"""SELECT source_table || '.' || source_column AS source_asset, target_table || '.' || target_column AS target_asset,
            type AS cardinality, trunc(confidence * 100)::INT || '%' AS confidence_level, join_suggestion, reason FROM ({rels_of('shop')})""",
        "glossary_candidates": f"""SELECT table_name, column_name, data_type, distinct_count FROM ({profile(ALL)})
            WHERE regexp_matches(lower(column_name), {lit('|'.join(glossary.TERM_NAME_PARTS))})""",
        "glossary_terms": terms(
            "SELECT f.column_id, f.column_name, s.sample_values FROM ("
            + facts({v: v for v in ("dirty_events", "orders", "part", "conversations")})
            + ") f LEFT JOIN (" + samples({v: v for v in ("dirty_events", "orders", "part", "conversations")}) + ") s USING (column_id)"
        ),
        "glossary_backfill": f"""WITH every AS MATERIALIZED ({catalog_columns(with_samples=True)}),
              known AS (SELECT term, 'kept definition' AS definition, 'kept meaning' AS business_meaning, 'kept usage' AS business_usage, example_val
                FROM ({terms("SELECT * FROM every WHERE table_name = 'orders'")}))
            SELECT * FROM known UNION ALL SELECT * FROM ({terms('SELECT * FROM every', 'dataset, column_id')}) WHERE term NOT IN (SELECT term FROM known)""",
        "build_documents": shop_documents,
        "rebuild_documents": documents("corpus", every_term),
        "token_search": f"SELECT query_id, rank, doc_id, round(score, 6) AS score, distance FROM ({token_hits('SELECT * FROM documents', 'doc_id', Q.SEARCH_QUERIES, 5)})",
        "token_search_scoped": "SELECT query_id, rank, doc_id, lang, round(score, 6) AS score, distance FROM ("
        + token_hits("SELECT * FROM documents WHERE lang = 'de'", "doc_id", Q.SEARCH_QUERIES, 3, "lang") + ")",
        "catalog_document_search": f"SELECT query_id, rank, doc_id, distance FROM ({catalog_hits})",
        "hit_sources": f"SELECT DISTINCT query_id, table_name FROM ({catalog_hits}) WHERE table_name IS NOT NULL",
        "token_index_search": "SELECT query_id, rank, doc_id, lang, round(score, 6) AS score, distance FROM (" + asked_hits(
            "SELECT * FROM documents",
            "SELECT conv_id * 1000 + turn AS query_id, min(text) AS question FROM conversations WHERE conv_id % 100 = 0 GROUP BY ALL",
            5, "lang") + ")",
        "question_pipeline": question_pipeline(shop_documents, catalog_tables()),
        "vector_knn": knn(10),
        "vector_knn_filtered": knn(4, "label = 3", ", label"),
        "schema_context": contexts(),
        "question_numeric": f"SELECT event_id, {mentions('question', questions.NUMERIC_PHRASES)} AS is_numeric FROM ({V.VIEW_SQL['question_log']})",
        "question_intent": f"""SELECT event_id, {intent('question')} AS intent FROM (SELECT event_id, question FROM ({V.VIEW_SQL['question_log']})
            UNION ALL SELECT -conv_id * 1000 - turn, text FROM conversations)""",
        "answer_confidence": f"""SELECT event_id, round(greatest(0.90::DOUBLE - CASE WHEN contains(model, 'Fallback') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
            - CASE WHEN has_context THEN 0.0::DOUBLE ELSE 0.10::DOUBLE END, 0.50::DOUBLE), 2) AS confidence FROM ({V.VIEW_SQL['question_log']})""",
        "template_descriptions": f"""SELECT dataset, table_name, NULL::VARCHAR AS column_name, {TABLE_TEXT} AS description FROM ({catalog_tables()})
            UNION ALL SELECT dataset, table_name, column_name, printf({lit(cq.COLUMN_TEXT)}, column_name) FROM ({catalog_columns()})""",
        "quality_summary_text": f"""SELECT dataset, table_name, '- Table **' || table_name || '**:' || chr(10) || '  - Health Score: **' || health_score || '%**' || chr(10)
            || '  - Missing Values: ' || missing_count || chr(10) || '  - Duplicate Rows: ' || duplicate_count || chr(10)
            || '  - Outliers: ' || outlier_count || chr(10) || '  - Format Mismatches: ' || invalid_format_count AS summary FROM ({catalog_quality()})""",
        "schema_overview_text": f"""SELECT dataset, table_name, -1 AS position, '- **' || table_name || '** (' || len(columns) || ' columns: '
              || array_to_string(columns[1:6], ', ') || CASE WHEN len(columns) > 6 THEN '...' ELSE '' END || ')' AS line FROM ({catalog_tables()})
            UNION ALL SELECT dataset, table_name, position, '- **' || column_name || '** (' || data_type || ')'
              || CASE WHEN description <> '' THEN ' — *' || description || '*' ELSE '' END FROM ({catalog_columns()})""",
        "sql_table_refs": f"SELECT sql_id, unnest({REFS}) AS table_name FROM ({V.VIEW_SQL['sql_log']})",
        "sql_log_check": sql_check(),
    }
    for key, names in (
        ("quality_outliers", ("dirty_customer", "events", "documents", "lineitem")), ("quality_outliers_large", V.BASE_TABLES),
    ):
        sql[key] = union(
            [
                f"SELECT {lit(v)} AS table_name, {lit(c)} AS column_name, {outlier_count(v, c, k)} AS outliers"
                for v in names
                for c, k in view_columns(v)
                if k in "id"
            ]
        )
    sql["flatten_nested"] = """SELECT c_custkey AS id, [c_mktsegment, c_name] AS tags, c_name AS who_name,
        c_nationkey AS who_place_nation, c_mktsegment AS who_place_segment FROM customer"""
    types = {"i": "bigint", "d": "double", "s": "string", "t": "timestamp_ntz", "a": "array<float>"}
    narrow = {"c_nationkey": "int", "label": "int"}
    sql["profile_schema_only"] = union(
        [
            f"SELECT {lit(v)} AS table_name, {p} AS position, {lit(c)} AS column_name, {lit(narrow.get(c, types[k]))} AS data_type, "
            f"count(*) AS row_count, 0::BIGINT AS null_count, 0::BIGINT AS distinct_count, 0.0::DOUBLE AS null_percentage, 0.0::DOUBLE AS uniqueness_ratio, "
            f"0::BIGINT AS duplicate_count, {int(masking.is_pii_name(c))} AS is_pii FROM {rel(v)}"
            for v in ("dirty_events", "customer", "embeddings")
            for p, (c, k) in enumerate(view_columns(v))
        ]
    )
    sql["scan_json"] = """SELECT c_custkey AS id, c_acctbal AS account_balance, c_mktsegment AS account_segment FROM customer"""
    return {k: v for k, v in sql.items() if v is not None}


ORACLE_SQL = build()
