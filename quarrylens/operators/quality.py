"""Table health: missing cells, duplicate rows, outliers, malformed values, orphans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quarrylens import session
from quarrylens.functions import values
from quarrylens.operators import quartiles
from quarrylens.operators.profile import Tables, union_all

DatetimeColumns = Mapping[str, Iterable[str]]

# Recommendation texts and the sentence on business impact beside each.
EMPTY_TABLE_TEXT = "Upload valid data to this table."
EMPTY_TABLE_ERROR = "Table is empty"
NO_ISSUE_TEXT = "No critical issues found. Maintain current data load protocols."
NO_ISSUE_IMPACT = "Operational analytics present no immediate business warning flags."
DUPLICATE_TEXT = "Remove duplicate rows in table '%s'. Found %s duplicates."
DUPLICATE_IMPACT = "Duplicate records may artificially inflate metric computations and report totals."
MISSING_TEXT = "Impute or investigate high null values in column '%s' (%s%% null)."
MISSING_IMPACT = "Missing attributes in '%s' prevent complete user segment profiling."
FORMAT_TEXT = "Enforce validation constraints or clean '%s' (found %s invalid records)."
FORMAT_IMPACT = (
    "Mismatched formats in '%s' cause failures in downstream database loads or scheduling APIs."
)
OUTLIER_TEXT = "Review numeric outliers in '%s' (%s records fall outside 1.5*IQR)."
OUTLIER_IMPACT = (
    "Extreme outliers in '%s' distort average aggregate analyses and machine learning predictions."
)

HIGH_MISSING = 20.0
MANY_OUTLIERS = 5
# Tables whose quartiles are sought at the same time.
TABLES_AT_ONCE = 8
# Fingerprints of rows that may repeat another, sent to every task up to this many;
# a table with more of them is grouped whole.
MOST_FINGERPRINTS = 1_000_000
FINGERPRINT = "__fingerprint"


MEASURES = ("row_count", "missing", "outliers", "invalid_formats", "duplicates")


def missing_and_formats(
    table: str, df: DataFrame, datetime_columns: Iterable[str] = ()
) -> DataFrame:
    """Rows, missing cells and format violations per column, from one aggregate.

    Columns named e-mail or date are held to that format, and so is a text column
    most of whose cells read as dates (`values.DATE_SHARE`): it is found in the same
    pass, and its other cells are the violations. `datetime_columns` adds columns.
    """
    known_dates = set(datetime_columns)
    cells, aggregates, rows, texts = [], ["count(1) AS n"], [], []
    for position, f in enumerate(df.schema.fields):
        rule = values.format_rule(f.name, f.name in known_dates)
        # Time stamps and dates are well formed by type.
        if isinstance(f.dataType, values.TEMPORAL) and rule == "date":
            rule = None
        text, invalid = values.cell_text(f.name, f.dataType), "0L"
        cells.append(f"{values.clean(f.name, f.dataType)} AS c{position}")
        aggregates.append(f"count(c{position}) AS n{position}")
        if rule == "email":
            aggregates.append(f"count_if({values.bad_email(f'f{position}')}) AS i{position}")
            cells.append(f"{text} AS f{position}")
            invalid = f"i{position}"
        elif rule == "date" or isinstance(f.dataType, T.StringType):
            reading = f"get(readings, {len(texts)})"
            texts.append(text)
            aggregates += [
                f"count_if({reading} = {values.LOOKS_LIKE_DATE}) AS l{position}",
                f"count_if({reading} = {values.READS_AS_DATE}) AS d{position}",
            ]
            dated = "true" if rule else values.mostly_dates(f"d{position}", f"n{position}")
            invalid = f"CASE WHEN {dated} THEN n{position} - d{position} - l{position} ELSE 0L END"
        rows.append(
            f"struct({values.literal(table)} AS table_name, {position} AS position, "
            f"{values.literal(f.name)} AS column_name, n AS row_count, "
            f"n - n{position} AS missing, 0L AS outliers, {invalid} AS invalid_formats, "
            "0L AS duplicates)"
        )
    if texts:
        cells.append(f"{values.each_text(texts, values.date_reading)} AS readings")
    return df.selectExpr(*cells).selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def _addition(table: str, position: str, **amounts: str) -> list[str]:
    """A row that adds to one column's measures and carries zero elsewhere."""
    return [
        f"{values.literal(table)} AS table_name",
        f"{position} AS position",
        "CAST(NULL AS STRING) AS column_name",
        *[f"{amounts.get(m, '0L')} AS {m}" for m in MEASURES],
    ]


def outliers(table: str, df: DataFrame) -> DataFrame | None:
    """(position, outliers) rows for the numeric columns, zero for columns without."""
    fields = quartiles.numeric_fields(df)
    if not fields:
        return None
    positions = ", ".join(str(df.columns.index(f.name)) for f in fields)
    return (
        quartiles.outlier_counts(df, fields)
        .selectExpr(f"inline(arrays_zip(array({positions}), outliers)) AS (p, n)")
        .selectExpr(*_addition(table, "p", outliers="n"))
    )


def outliers_of(tables: Tables) -> dict[str, DataFrame]:
    """The outliers of all tables that have numbers; their rounds run side by side."""
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        counted = pool.map(lambda item: (item[0], outliers(*item)), tables.items())
    return {table: found for table, found in counted if found is not None}


def _grouped_duplicates(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One row: how many rows repeat another. Rows are grouped on typed keys in which
    long text stands as its digest, and hot duplicates collapse on the map side."""
    keys = [f"k{i}" for i in range(len(fields))]
    return (
        df.selectExpr(*[f"{values.equality_key(f.name, f.dataType)} AS {k}" for k, f in zip(keys, fields)])
        .groupBy(*keys)
        .agg(F.expr("count(1) AS copies"))
        .selectExpr("coalesce(sum(copies - 1), 0L) AS duplicates")
    )


def duplicates_of(tables: Tables) -> dict[str, DataFrame]:
    """One row per table: how many rows repeat an earlier, fully equal row (nulls equal).

    Equal rows have equal fingerprints, so the first shuffle, one for all tables and run
    while the plan is built, carries eight bytes a row. Only rows whose fingerprint is
    there twice are then compared in full; where those are too many, the whole table is.
    """
    prints = {t: values.fingerprint(df.schema.fields) for t, df in tables.items()}
    printed = [
        df.selectExpr(f"{n} AS t", f"{prints[t]} AS {FINGERPRINT}") for n, (t, df) in enumerate(tables.items())
    ]
    repeated = session.cut_lineage(
        union_all(printed).groupBy("t", FINGERPRINT).agg(F.expr("count(1) AS copies")).where("copies > 1")
    )
    listed = {r["t"]: r["n"] for r in repeated.groupBy("t").agg(F.expr("count(1) AS n")).collect()}
    counted = {}
    for n, (table, df) in enumerate(tables.items()):
        if n not in listed:
            counted[table] = df.sparkSession.range(0, 1, 1, 1).selectExpr("0L AS duplicates")
            continue
        rows = df
        if listed[n] <= MOST_FINGERPRINTS:
            again = F.broadcast(repeated.where(f"t = {n}").select(FINGERPRINT))
            rows = df.selectExpr("*", f"{prints[table]} AS {FINGERPRINT}").join(again, FINGERPRINT, "left_semi")
        counted[table] = _grouped_duplicates(rows, df.schema.fields)
    return counted


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier, fully equal row (nulls equal)."""
    return duplicates_of({"t": df})["t"]


def column_details(
    tables: Tables,
    *,
    datetime_columns: DatetimeColumns | None = None,
) -> DataFrame:
    """Per column: rows, missing, missing %, outliers, invalid formats.

    `duplicates` is a table measure; it rides on the first column.
    """
    parts = []
    for table, df in tables.items():
        parts.append(missing_and_formats(table, df, (datetime_columns or {}).get(table, ())))
    parts += [
        found.selectExpr(*_addition(table, "0", duplicates="duplicates"))
        for table, found in duplicates_of(tables).items()
    ]
    parts += outliers_of(tables).values()
    merged = (
        union_all(parts)
        .groupBy("table_name", "position")
        .agg(
            F.max("column_name").alias("column_name"),
            *[F.sum(m).alias(m) for m in MEASURES],
        )
    )
    share = F.when(
        F.col("row_count") > 0, F.round(F.col("missing") / F.col("row_count") * 100, 2)
    ).otherwise(0.0)
    return merged.withColumn("missing_percentage", share)


def _deduction(ratio: Column, weight: float, most: float) -> Column:
    return F.least(ratio * 100 * weight, F.lit(most))


def health_scores(details: DataFrame) -> DataFrame:
    """One row per table from its column details; empty tables score zero."""
    table = details.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("missing").alias("missing_count"),
        F.sum("duplicates").alias("duplicate_count"),
        F.sum("outliers").alias("outlier_count"),
        F.sum("invalid_formats").alias("invalid_format_count"),
    )
    cells = F.col("row_count") * F.col("column_count")
    lost = (
        _deduction(F.col("missing_count") / cells, 0.5, 30.0)
        + _deduction(F.col("duplicate_count") / F.col("row_count"), 1.5, 20.0)
        + _deduction(F.col("outlier_count") / cells, 2.0, 15.0)
        + _deduction(F.col("invalid_format_count") / cells, 3.0, 15.0)
    )
    score = F.round(F.greatest(F.least(100.0 - lost, F.lit(100.0)), F.lit(0.0)), 1)
    return table.withColumn(
        "health_score", F.when(F.col("row_count") == 0, 0.0).otherwise(score)
    ).select(
        "table_name", "row_count", "health_score", "missing_count", "duplicate_count",
        "outlier_count", "invalid_format_count",
    )


def recommendations(details: DataFrame) -> DataFrame:
    """(table_name, seq, recommendation, business_impact), in reading order."""

    def advice(rank: int, applies: str, text: str, amount: str, impact: str, subject: str) -> Column:
        filled = F.format_string(text, subject, F.expr(f"CAST({amount} AS STRING)"))
        reason = F.format_string(impact, subject) if "%s" in impact else F.lit(impact)
        return F.when(
            F.expr(applies),
            F.struct(
                F.expr(f"position * 10 + {rank}").alias("seq"),
                filled.alias("recommendation"),
                reason.alias("business_impact"),
            ),
        )

    per_column = F.array_compact(
        F.array(
            advice(1, "duplicates > 0", DUPLICATE_TEXT, "duplicates", DUPLICATE_IMPACT, "table_name"),
            advice(
                2,
                f"missing_percentage > {HIGH_MISSING}",
                MISSING_TEXT,
                "missing_percentage",
                MISSING_IMPACT,
                "column_name",
            ),
            advice(3, "invalid_formats > 0", FORMAT_TEXT, "invalid_formats", FORMAT_IMPACT, "column_name"),
            advice(4, f"outliers > {MANY_OUTLIERS}", OUTLIER_TEXT, "outliers", OUTLIER_IMPACT, "column_name"),
        )
    )
    # At most four entries per column of a table.
    per_table = (
        details.select("table_name", "row_count", per_column.alias("advice"))
        .groupBy("table_name")
        .agg(F.max("row_count").alias("row_count"), F.flatten(F.collect_list("advice")).alias("advice"))
    )

    def single(text: str, impact: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(0).alias("seq"),
                F.lit(text).alias("recommendation"),
                impact.alias("business_impact"),
            )
        )

    shown = (
        F.when(F.col("row_count") == 0, single(EMPTY_TABLE_TEXT, F.lit(None).cast("string")))
        .when(F.size("advice") == 0, single(NO_ISSUE_TEXT, F.lit(NO_ISSUE_IMPACT)))
        .otherwise(F.col("advice"))
    )
    return per_table.select("table_name", F.inline(shown))


def orphan_records(
    tables: Tables, relationships: Sequence[tuple[str, str, str, str]], samples: int = 5
) -> DataFrame:
    """Child rows whose key is absent from the parent, per relationship.

    `relationships` holds (parent table, parent column, child table, child
    column). Both sides meet in one grouped shuffle on (relationship, key),
    summed on the map side first: a key that holds a third of the child rows
    costs one row per task. Only relationships with orphans are reported.

    Keys of different types meet in the form their types have in common
    (`values.common_form`): decimals of any scale, decimals with doubles, whole
    doubles with whole numbers, dates with time stamps. Others are refused.
    """
    sides, forms = [], []
    for number, (parent, parent_key, child, child_key) in enumerate(relationships):
        types = [tables[t].schema[k].dataType for t, k in ((parent, parent_key), (child, child_key))]
        form = values.common_form(*types)
        if form is None:
            raise TypeError(
                f"{parent}.{parent_key} and {child}.{child_key} have no type in common: "
                + ", ".join(t.simpleString() for t in types)
            )
        forms.append(form)
        for table, key, is_parent in ((parent, parent_key, True), (child, child_key, False)):
            dtype = tables[table].schema[key].dataType
            slots = [
                f"{c} AS {s}"
                for c, s in zip(values.form_values(key, dtype, form, whole_text=True), values.SLOTS)
            ]
            sides.append(
                tables[table]
                .where(f"{values.clean(key, dtype)} IS NOT NULL")
                .selectExpr(
                    f"{number} AS rel",
                    *slots,
                    f"{0 if is_parent else 1}L AS child_rows",
                    f"{str(is_parent).lower()} AS in_parent",
                )
            )
    keys = (
        union_all(sides)
        .groupBy("rel", *values.SLOTS)
        .agg(F.sum("child_rows").alias("child_rows"), F.bool_or("in_parent").alias("in_parent"))
    )
    lost = ~F.col("in_parent")
    totals = keys.groupBy("rel").agg(
        F.sum("child_rows").alias("child_count"),
        F.sum(F.when(lost, F.col("child_rows")).otherwise(0)).alias("orphan_count"),
        F.bool_or("in_parent").alias("has_parent"),
    )
    numeric = (values.WHOLE, values.EXACT, values.DECIMAL)
    by_number = [n for n, form in enumerate(forms) if form.partition(":")[0] in numeric]
    number = F.when(
        F.col("rel").isin(by_number), F.coalesce(F.col("v_int").cast("double"), "v_num", F.col("v_text").try_cast("double"))
    )
    rank = F.row_number().over(W.partitionBy("rel").orderBy(number, *values.SLOTS))
    shown = "CASE rel " + " ".join(f"WHEN {n} THEN {values.shown_key(f)}" for n, f in enumerate(forms)) + " END"
    first = (
        # Same columns as the totals above, so that both share one shuffle.
        keys.where(lost & (F.col("child_rows") > 0))
        .select("rel", *values.SLOTS, rank.alias("rank"))
        .where(F.col("rank") <= samples)
        .groupBy("rel")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", F.expr(shown).alias("key"))
                )
            ).alias("sample")
        )
    )
    facts = (
        totals.withColumn("sample", F.lit(None).cast(first.schema["sample"].dataType))
        .unionByName(first, allowMissingColumns=True)
        .groupBy("rel")
        .agg(
            F.max("child_count").alias("child_count"),
            F.max("orphan_count").alias("orphan_count"),
            F.bool_or("has_parent").alias("has_parent"),
            F.max("sample").alias("sample"),
        )
    )
    named = F.array(
        *[
            F.struct(
                *[
                    F.lit(v).alias(n)
                    for n, v in zip(
                        ("parent_table", "parent_column", "child_table", "child_column"), r
                    )
                ]
            )
            for r in relationships
        ]
    )
    return (
        facts.where(F.col("has_parent") & (F.col("orphan_count") > 0))
        .withColumn("names", F.get(named, F.col("rel")))
        .select(
            "names.*",
            "child_count",
            "orphan_count",
            F.round(F.col("orphan_count") / F.col("child_count") * 100, 2).alias(
                "orphan_percentage"
            ),
            F.transform("sample", lambda x: x["key"]).alias("sample_orphans"),
        )
    )


def dataset_health(scores: DataFrame) -> DataFrame:
    """Mean of the table scores; 100.0 where nothing was scored."""
    return scores.agg(
        F.coalesce(F.round(F.avg("health_score"), 1), F.lit(100.0)).alias("health_score")
    )


def health_band(score: Column) -> Column:
    return F.when(score < 70, "red").when(score < 90, "yellow").otherwise("green")


def top_recommendations(advice: DataFrame, order_by: Sequence[str], size: int = 5) -> DataFrame:
    return (
        advice.where(~F.contains("recommendation", F.lit("No critical issues")))
        .orderBy(*order_by)
        .limit(size)
    )
