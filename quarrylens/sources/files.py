"""CSV and JSON scans with the type and nesting rules of the catalog.

Scans cover whole files. A row cap is available on request, never by default.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarrylens.functions.values import quoted

# CSV texts that stand for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}


def table_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def row_cap(df: DataFrame, rows: int | None) -> DataFrame:
    """A prefix of the rows, only where the caller asks for one."""
    return df if rows is None else df.limit(rows)


def _typed(column: Column, kind: str) -> Column:
    return {
        "bigint": column.try_cast("bigint"),
        "double": column.try_cast("double"),
        "boolean": F.lower(column).try_cast("boolean"),
    }.get(kind, column)


def infer_text_types(df: DataFrame) -> dict[str, str]:
    """Narrowest type that fits every filled cell of each text column.

    One aggregate over the data, two flags per column brought back.
    """
    checks = []
    for i, name in enumerate(df.columns):
        c = quoted(name)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(WHOLE_NUMBER) & c.try_cast("bigint").isNotNull()).alias(f"w{i}"),
            F.count_if(c.rlike(NUMBER)).alias(f"d{i}"),
            F.count_if(c.rlike(TRUTH)).alias(f"b{i}"),
        ]
    got = df.agg(*checks).first()
    kinds = {}
    for i, name in enumerate(df.columns):
        filled = got[f"n{i}"]
        if filled == 0:
            # A column without values carries no type; it reads as numbers.
            kinds[name] = "double"
        elif got[f"w{i}"] == filled:
            kinds[name] = "bigint"
        elif got[f"d{i}"] == filled:
            kinds[name] = "double"
        elif got[f"b{i}"] == filled:
            kinds[name] = "boolean"
        else:
            kinds[name] = "string"
    return kinds


def scan_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    rows: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV file or folder with header.

    The missing-value texts are nulled first; then cells take the types of the
    schema (null where one doesn't fit), or those inferred from every row.
    Quoted line breaks are kept, which reads a file in one task; files without
    any are split with `multi_line=False`.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    fields: list[T.StructField] = []
    if schema is not None:
        fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))
    raw = row_cap(reader.csv(path), rows)
    text = raw.select(
        *[F.when(~quoted(c).isin(*NA_TOKENS), quoted(c)).alias(c) for c in raw.columns]
    )
    if schema is not None:
        return text.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in fields])
    kinds = infer_text_types(text)
    return text.select(*[_typed(quoted(c), kinds[c]).alias(c) for c in text.columns])


def flatten_nested(df: DataFrame) -> DataFrame:
    """Nested objects as dotted column names; arrays stay cells."""

    def leaves(path: Sequence[str], dtype: T.DataType) -> list[Column]:
        if isinstance(dtype, T.StructType) and dtype.fields:
            return [leaf for f in dtype.fields for leaf in leaves([*path, f.name], f.dataType)]
        column = quoted(path[0])
        for part in path[1:]:
            column = column.getField(part)
        return [column.alias(".".join(path))]

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves([f.name], f.dataType)])


def _first_array_key(spark: SparkSession, path: str, schema: T.StructType) -> str | None:
    """First list-valued key in file order (Spark's inferred fields are sorted by
    name); in a folder, that of the file whose path comes first."""
    documents = spark.read.text(path, wholetext=True)
    listed = documents.select(F.json_object_keys("value").alias("keys"), F.col("_metadata.file_path").alias("file"))
    keys = listed.orderBy("file").first()
    if keys is None or keys["keys"] is None:
        return None
    arrays = {f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)}
    return next((k for k in keys["keys"] if k in arrays), None)


def scan_json(
    spark: SparkSession,
    path: str,
    *,
    record_path: str | None = None,
    lines: bool = False,
    schema: T.StructType | str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """A JSON document as flat rows.

    A root list gives one row per element; a root object gives the elements of
    `record_path` or of its first list-valued key, or else one row. With
    `lines=True` every line is a record and large files are split.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if lines:
        return row_cap(flatten_nested(reader.json(path)), rows)
    df = reader.option("multiLine", True).json(path)
    if "_corrupt_record" in df.columns:
        raise ValueError(f"{path}: expected a JSON object or a list of objects")
    key = record_path or _first_array_key(spark, path, df.schema)
    if key is not None:
        element = df.schema[key].dataType
        if isinstance(element, T.ArrayType) and df.where(F.size(quoted(key)) > 0).isEmpty():
            return spark.createDataFrame([], element.elementType if isinstance(element.elementType, T.StructType) else T.StructType())
        if not (isinstance(element, T.ArrayType) and isinstance(element.elementType, T.StructType)):
            raise ValueError(f"{path}: '{key}' does not hold a list of objects")
        df = df.select(F.inline(quoted(key)))
    return row_cap(flatten_nested(df), rows)


def scan_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Choose the scan by file extension."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind == "csv":
        return scan_csv(spark, path, **options)
    if kind == "json":
        return scan_json(spark, path, **options)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"unsupported file type: {path}")


def scan_folder(
    spark: SparkSession, folder: str, table: str, kind: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """`<folder>/<table>.<kind>`, reduced to the columns asked for."""
    df = scan_file(spark, f"{folder.rstrip('/')}/{table}.{kind}")
    return df if columns is None else df.select(*[quoted(c) for c in columns])


def folder_tables(spark: SparkSession, folder: str, tables: Sequence[str], kind: str) -> dict[str, DataFrame]:
    return {t: scan_folder(spark, folder, t, kind) for t in tables}
