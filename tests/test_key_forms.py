"""Keys of different types: which pairs meet, in what form, and what is equal there."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from quarrylens.functions import values
from quarrylens.operators import quality, relations

DAY, NOON = dt.date(2024, 1, 5), dt.datetime(2024, 1, 5, 12)
MIDNIGHT = dt.datetime(2024, 1, 5)

# parent type, parent keys, child type, child keys, orphans among the child keys as text
CASES = [
    ("decimal(10,2)", ["1.50", "-0.30", "100.00"], "decimal(12,4)", ["1.5000", "-0.3000", "100.0000", "1.5001"], ["1.5001"]),
    ("decimal(38,0)", ["7", "1"], "decimal(38,20)", ["7", "1.5", "1"], ["1.5"]),
    ("decimal(38,0)", ["10", "0"], "decimal(38,38)", ["0", "0.25"], ["0.25"]),
    ("decimal(10,2)", ["0.10", "2.00"], "double", [0.1, 2.0, 0.30000000000000004], ["0.30000000000000004"]),
    ("double", [0.1, -0.0], "decimal(10,2)", ["0.10", "0.00", "0.20"], ["0.2"]),
    ("bigint", [1, 2, 9007199254740993], "double", [1.0, 2.0, 9007199254740992.0, 2.5, float("nan"), None, 1e300], ["2.5", "9007199254740992", "1.0E300"]),
    ("double", [1.0, float("inf")], "int", [1, 2], ["2"]),
    ("int", [1, 100], "decimal(10,3)", ["1.000", "100", "100.5", "10"], ["10", "100.5"]),
    ("decimal(20,0)", ["5", "40"], "bigint", [5, 4, 40], ["4"]),
    ("float", [0.5, 0.1], "double", [0.5, 0.1], ["0.1"]),
    ("date", [DAY], "timestamp", [MIDNIGHT, NOON], ["2024-01-05 12:00:00"]),
    ("timestamp", [MIDNIGHT], "date", [DAY, dt.date(2024, 1, 6)], ["2024-01-06 00:00:00"]),
    ("timestamp_ntz", [MIDNIGHT], "date", [DAY, dt.date(1969, 12, 31)], ["1969-12-31 00:00:00"]),
    ("timestamp_ntz", [NOON], "timestamp", [NOON, MIDNIGHT], ["2024-01-05 00:00:00"]),
    ("date", [DAY], "date", [DAY, dt.date(2024, 1, 6)], ["2024-01-06"]),
    ("boolean", [True], "boolean", [True, False], ["false"]),
    ("string", ["a", "x" * 80], "string", ["a", "x" * 80, "A"], ["A"]),
    ("array<int>", [[1], []], "array<int>", [[1], [], [2]], ["[2]"]),
]


def column(spark, kind, keys):
    rows = [(Decimal(k) if kind.startswith("decimal") and k is not None else k,) for k in keys]
    return spark.createDataFrame(rows, f"k {kind}")


@pytest.mark.parametrize("parent,parents,child,children,lost", CASES)
def test_orphans_across_types(spark, parent, parents, child, children, lost):
    tables = {"p": column(spark, parent, parents), "c": column(spark, child, children)}
    (got,) = quality.orphan_records(tables, [("p", "k", "c", "k")]).collect()
    filled = [k for k in children if k is not None and k == k]
    assert (got["child_count"], got["orphan_count"], got["sample_orphans"]) == (len(filled), len(lost), lost)


@pytest.mark.parametrize("parent,parents,child,children,lost", CASES)
def test_overlap_across_types(spark, parent, parents, child, children, lost):
    tables = {"p": column(spark, parent, parents), "c": column(spark, child, children)}
    side = "struct<id:int,table_name:string,column_name:string>"
    pairs = spark.createDataFrame([((0, "p", "k"), (1, "c", "k"))], f"a {side}, b {side}")
    (got,) = relations.value_overlap(tables, pairs).collect()
    filled = {str(k) if isinstance(k, list) else k for k in children if k is not None and k == k}
    assert (got["a_distinct"], got["b_distinct"], got["shared"]) == (len(parents), len(filled), len(filled) - len(lost))


def test_a_column_in_pairs_of_several_forms(spark):
    """Each pair is compared in its own form; a pair without any shares nothing."""
    tables = {
        "a": column(spark, "decimal(10,2)", ["0.10", "7.00"]), "b": column(spark, "double", [0.1, 7.0, 8.0]),
        "c": column(spark, "decimal(12,4)", ["0.1000"]), "d": column(spark, "bigint", [7]), "e": column(spark, "string", ["7"]),
        "f": column(spark, "array<int>", [[7]]),
    }
    side = "struct<id:int,table_name:string,column_name:string>"
    listed = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("d", "e"), ("e", "f")]
    at = {t: (i, t, "k") for i, t in enumerate(tables)}
    pairs = spark.createDataFrame([(at[x], at[y]) for x, y in listed], f"a {side}, b {side}")
    got = {(r["a_id"], r["b_id"]): (r["a_distinct"], r["b_distinct"], r["shared"]) for r in relations.value_overlap(tables, pairs).collect()}
    want = [(2, 3, 2), (2, 1, 1), (3, 1, 1), (2, 1, 1), (3, 1, 1), (1, 1, 0), (1, 1, 0)]
    assert got == {(at[x][0], at[y][0]): w for (x, y), w in zip(listed, want)}


def test_pairs_without_a_common_form():
    kinds = {
        "number": T.LongType(), "text": T.StringType(), "time": T.TimestampType(), "flag": T.BooleanType(), "bytes": T.BinaryType(),
        "list": T.ArrayType(T.LongType()), "other list": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.LongType()),
    }
    for a, x in kinds.items():
        for b, y in kinds.items():
            assert (values.common_form(x, y) is not None) == (a == b)
