"""Column profiles of whole tables.

A profile takes ungrouped aggregates for the cheap facts, and long-form
shuffles of typed values or of words of them for exact distinct counts. `approximate=True` folds the distinct counts into the first pass.
Every function takes an ordered `{table name: DataFrame}`; that order is the
catalog order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarrylens.functions import masking, values

Tables = Mapping[str, DataFrame]
OrderKeys = Mapping[str, Sequence[str]]
DATES = "__dates"


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def catalog_columns(tables: Tables) -> Iterator[tuple[int, str, int, T.StructField]]:
    """(column id over the whole catalog, table, position in table, field)."""
    column_id = 0
    for table, df in tables.items():
        for position, field in enumerate(df.schema.fields):
            yield column_id, table, position, field
            column_id += 1


def columns_by_table(tables: Tables) -> dict[str, list[tuple[int, int, T.StructField]]]:
    grouped: dict[str, list[tuple[int, int, T.StructField]]] = {}
    for column_id, table, position, field in catalog_columns(tables):
        grouped.setdefault(table, []).append((column_id, position, field))
    return grouped


def _extremes(field: T.StructField) -> dict[str, str]:
    """Typed minimum and maximum: text for ordered text-like types and whole
    numbers, doubles for every number, nothing for nested values."""
    column, dtype = values.clean(field.name, field.dataType), field.dataType
    if isinstance(dtype, values.FRACTIONAL + (T.DecimalType,) + values.COMPLEX + (T.BinaryType,)):
        text = "CAST(NULL AS STRING)"
    elif isinstance(dtype, T.BooleanType):
        text = "initcap(CAST({0}({1}) AS STRING))"
    else:
        text = "CAST({0}({1}) AS STRING)"
    number = (
        "CAST({0}({1}) AS DOUBLE)" if isinstance(dtype, values.NUMERIC) else "CAST(NULL AS DOUBLE)"
    )
    return {
        f"{side}_{kind}": form.format(side, column)
        for kind, form in (("text", text), ("num", number))
        for side in ("min", "max")
    }


def _with_dates(df: DataFrame, texts: list[str]) -> DataFrame:
    return df.selectExpr("*", f"{values.each_text(texts, values.parses_as_date)} AS {DATES}") if texts else df


def _texts_apart(tables: Tables) -> Iterator[tuple[str, list[tuple[int, int, T.StructField]]]]:
    for table, columns in columns_by_table(tables).items():
        for wanted in (False, True):
            some = [c for c in columns if isinstance(c[2].dataType, T.StringType) == wanted]
            if some:
                yield table, some


def column_facts(
    tables: Tables, rsd: float | None = None, extremes: bool = True, dates: bool = False
) -> DataFrame:
    """One row per column from ungrouped aggregates, two per table at most.

    `rsd` adds approximate distinct counts, `dates` whether most values of a
    string column read as dates (`values.DATE_SHARE`). Texts have an aggregate of
    their own: among them the numbers would lose their fast one.
    """
    parts = []
    for table, columns in _texts_apart(tables):
        aggregates, rows = ["count(1) AS n"], []
        texts = [values.quote(f.name) for _, _, f in columns if dates and isinstance(f.dataType, T.StringType)]
        for column_id, position, field in columns:
            column = values.clean(field.name, field.dataType)
            measures = {"filled": f"count({column})"}
            if extremes:
                measures |= _extremes(field)
            shown = {}
            if dates:
                is_text = isinstance(field.dataType, T.StringType)
                measures["dated"] = f"count_if(get({DATES}, {texts.index(column)}))" if is_text else "0L"
                shown["date_like"] = values.mostly_dates(f"dated_{position}", f"filled_{position}")
            measures["distinct_count"] = (
                "CAST(NULL AS BIGINT)" if rsd is None else f"approx_count_distinct({column}, {rsd})"
            )
            aggregates += [f"{m} AS {name}_{position}" for name, m in measures.items()]
            rows.append(
                f"struct({column_id} AS column_id, {values.literal(table)} AS table_name, "
                f"{position} AS position, {values.literal(field.name)} AS column_name, "
                f"'{values.logical_type(field.dataType)}' AS data_type, "
                f"{values.literal(field.dataType.simpleString())} AS storage_type, "
                f"n AS row_count, n - filled_{position} AS null_count, "
                + ", ".join(
                    [f"{m}_{position} AS {m}" for m in measures if m not in ("filled", "dated")]
                    + [f"{e} AS {m}" for m, e in shown.items()]
                )
                + ")"
            )
        parts.append(
            _with_dates(tables[table], texts).selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")
        )
    return union_all(parts)


def _cells(df: DataFrame, first: int, parts: Sequence[str]) -> DataFrame:
    """(part, v): one row per filled cell of parts of one type, numbered from `first`."""
    listed = df.selectExpr(f"posexplode(array({', '.join(parts)})) AS (place, v)").where("v IS NOT NULL")
    return listed.selectExpr(f"place + {first} AS part", "v")


def distinct_counts(tables: Tables) -> DataFrame:
    """Exact distinct non-null values per column, nested and long values included.

    Columns are counted by parts (`values.distinct_parts`). Whole numbers are grouped
    in words of 64 neighbours with a bit for each, so that keys, days and prices take
    far fewer rows than they have values, and never more. Equal values and words of one
    part meet in the map-side aggregate first, so a value that fills a third of a table
    is shuffled once per task.
    """
    owners: list[int] = []
    listed: dict[str, list[DataFrame]] = {}
    for table, columns in columns_by_table(tables).items():
        by_slot: dict[str, list[tuple[int, str]]] = {}
        for column_id, _, f in columns:
            for slot, part in values.distinct_parts(f.name, f.dataType):
                by_slot.setdefault(slot, []).append((column_id, part))
        for slot, parts in by_slot.items():
            listed.setdefault(slot, []).append(_cells(tables[table], len(owners), [p for _, p in parts]))
            owners += [column_id for column_id, _ in parts]
    counted = []
    for slot, cells in listed.items():
        if slot == values.WORDS:
            words = union_all(cells).selectExpr("part", "shiftright(v, 6) AS word", "shiftleft(1L, CAST(v & 63 AS INT)) AS bits")
            held = words.groupBy("part", "word").agg(F.expr("bit_or(bits) AS bits"))
            counted.append(held.groupBy("part").agg(F.expr("sum(bit_count(bits)) AS n")))
        else:
            counted.append(union_all(cells).distinct().groupBy("part").agg(F.expr("count(1) AS n")))
    owner = f"array({', '.join(map(str, owners))})[part] AS column_id"
    return union_all(counted).selectExpr(owner, "n").groupBy("column_id").agg(F.expr("sum(n) AS distinct_count"))


def _first_values(df: DataFrame, column: str, keys: Sequence[str], size: int) -> DataFrame:
    """A bounded prefix of a column's non-null values, in key order if there is one."""
    kept = df.where(f"{column} IS NOT NULL")
    return (kept.orderBy(*[values.quote(k) for k in keys]) if keys else kept).limit(size)


def date_like_columns(
    tables: Tables, order_by: OrderKeys, sample: int
) -> DataFrame:
    """(column_id, date_like) for string columns: do most of the first values in
    the given order, a top-k per column, read as dates?"""
    ordered = []
    for table, columns in columns_by_table(tables).items():
        for i, f in ((i, f) for i, _, f in columns if isinstance(f.dataType, T.StringType)):
            column = values.quote(f.name)
            first = _first_values(tables[table], column, order_by[table], sample)
            ordered.append(first.selectExpr(f"{i} AS column_id", f"{values.parses_as_date(column)} AS parses"))
    if not ordered:
        session = next(iter(tables.values())).sparkSession
        return session.createDataFrame([], "column_id int, date_like boolean")
    return union_all(ordered).groupBy("column_id").agg(F.expr(f"{values.mostly_dates('count_if(parses)', 'count(1)')} AS date_like"))


def _merge(facts: DataFrame, *extras: DataFrame | None) -> DataFrame:
    """Bring facts of one column together with one small shuffle instead of joins."""
    whole = facts
    for extra in extras:
        if extra is not None:
            whole = whole.unionByName(extra, allowMissingColumns=True)
    names = [c for c in whole.columns if c != "column_id"]
    return whole.groupBy("column_id").agg(*[F.expr(f"max({c}) AS {c}") for c in names])


PROFILE_COLUMNS = (
    "column_id",
    "table_name",
    "position",
    "column_name",
    "CASE WHEN date_like THEN 'DATETIME' ELSE data_type END AS data_type",
    "storage_type",
    "row_count",
    "null_count",
    "CASE WHEN row_count > 0 THEN round(null_count / row_count * 100, 2) ELSE 0D END AS null_percentage",
    "coalesce(distinct_count, 0L) AS distinct_count",
    "CASE WHEN row_count > 0 THEN round(coalesce(distinct_count, 0L) / row_count, 2) ELSE 0D END"
    " AS uniqueness_ratio",
    "row_count - coalesce(distinct_count, 0L) AS duplicate_count",
    "min_text",
    "max_text",
    "min_num",
    "max_num",
    f"CAST(lower(column_name) RLIKE '{'|'.join(masking.PII_NAME_PARTS)}' AS INT) AS is_pii",
)


def profile_columns(
    tables: Tables,
    *,
    approximate: bool = False,
    rsd: float = 0.05,
    order_by: OrderKeys | None = None,
    type_sample: int | None = None,
) -> DataFrame:
    """The profile of every column of every table, one row per column.

    String columns are typed by all their values, in the one pass of the other
    facts; or, where asked for, by the first `type_sample` in the order of `order_by`.
    """
    if type_sample is not None and not set(tables) <= set(order_by or {}):
        raise ValueError("a type sample needs an order for each table")
    return _merge(
        column_facts(tables, rsd if approximate else None, dates=type_sample is None),
        None if approximate else distinct_counts(tables),
        None if type_sample is None else date_like_columns(tables, order_by, type_sample),
    ).selectExpr(*PROFILE_COLUMNS)


def profile_types(tables: Tables) -> DataFrame:
    """Logical type per column by all its values, with the filled cells behind the verdict."""
    whole = column_facts(tables, extremes=False, dates=True)
    return whole.selectExpr(
        "table_name",
        "column_name",
        "CASE WHEN date_like THEN 'DATETIME' ELSE data_type END AS data_type",
        "row_count - null_count AS filled_count",
    )


def profile_schema_only(tables: Tables) -> DataFrame:
    """Profile rows from the schema alone: zeros, no samples, PII by name.

    The row count still comes from the source where it can be counted.
    """
    parts = []
    for table, df in tables.items():
        rows = [
            f"struct({position} AS position, {values.literal(f.name)} AS column_name, "
            f"{values.literal(f.dataType.simpleString())} AS data_type)"
            for position, f in enumerate(df.schema.fields)
        ]
        parts.append(
            df.selectExpr("count(1) AS row_count").selectExpr(
                f"{values.literal(table)} AS table_name",
                "row_count",
                f"inline(array({', '.join(rows)}))",
            )
        )
    return union_all(parts).select(
        "table_name",
        "position",
        "column_name",
        "data_type",
        "row_count",
        F.expr("0L AS null_count"),
        F.expr("0L AS distinct_count"),
        F.expr("0D AS null_percentage"),
        F.expr("0D AS uniqueness_ratio"),
        F.expr("0L AS duplicate_count"),
        masking.pii_name_flag(F.col("column_name")).cast("int").alias("is_pii"),
    )


def crawl_tables(tables: Tables) -> DataFrame:
    """Row and column count of every table of a source."""
    return union_all(
        [
            df.selectExpr("count(1) AS row_count").selectExpr(
                f"{values.literal(table)} AS table_name", "row_count", f"{len(df.columns)} AS column_count"
            )
            for table, df in tables.items()
        ]
    )


def _sample_text(field: T.StructField) -> Column:
    column = values.quoted(field.name)
    if isinstance(field.dataType, values.COMPLEX):
        text = F.to_json(column)
    elif isinstance(field.dataType, T.BooleanType):
        text = F.initcap(column.cast("string"))
    else:
        text = column.cast("string")
    return masking.masked(text, field.name) if masking.is_pii_name(field.name) else text


def profile_samples(
    tables: Tables,
    order_by: OrderKeys | None = None,
    size: int = 5,
    complete: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """(column_id, sample_values) of every column with values: the first
    non-null ones, masked for PII columns.

    With an order, a column is a bounded top-k over two pruned columns, and
    columns known to be `complete` (no nulls) share one top-k per table: its
    first rows. Without an order, scans are read from their start until there
    are enough values. Either way a list never exceeds `size` values.
    """
    parts, taken = [], []
    for table, columns in columns_by_table(tables).items():
        keys = (order_by or {}).get(table, ())
        shared = set((complete or {}).get(table, ()))
        groups = [[(i, f) for i, _, f in columns if f.name in shared]]
        groups += [[(i, f)] for i, _, f in columns if f.name not in shared]
        for group in filter(None, groups):
            if group[0][1].name in shared:
                rows = tables[table]
                rows = (rows.orderBy(*[values.quote(k) for k in keys]) if keys else rows).limit(size)
            else:
                field = group[0][1]
                rows = _first_values(tables[table], values.clean(field.name, field.dataType), keys, size)
            texts = [_sample_text(f).alias(f"s{i}") for i, f in group]
            if not keys:
                for place, row in enumerate(rows.select(*texts).collect()):
                    taken += [(i, place, row[f"s{i}"]) for i, _ in group]
                continue
            # The prefix is one sorted partition, so running ids keep its order.
            pairs = ", ".join(f"{i}, s{i}" for i, _ in group)
            parts.append(
                rows.select(F.expr("monotonically_increasing_id() AS place"), *texts)
                .selectExpr("place", f"stack({len(group)}, {pairs}) AS (column_id, v)")
                .select("column_id", "place", "v")
            )
    if taken or not parts:
        session = next(iter(tables.values())).sparkSession
        parts.append(session.createDataFrame(taken, "column_id int, place bigint, v string"))
    return (
        union_all(parts)
        .groupBy("column_id")
        .agg(F.expr("array_sort(collect_list(struct(place, v))) AS ordered"))
        .selectExpr("column_id", "transform(ordered, x -> x.v) AS sample_values")
    )


def named_columns(tables: Tables, by_column_id: DataFrame) -> DataFrame:
    """Table and column names in place of the column id."""
    entries = ", ".join(
        f"{i}, struct({values.literal(t)} AS table_name, {values.literal(f.name)} AS column_name)"
        for i, t, _, f in catalog_columns(tables)
    )
    rest = [c for c in by_column_id.columns if c != "column_id"]
    return by_column_id.selectExpr(f"map({entries})[column_id] AS name", *rest).select("name.*", *rest)
