"""Relationship rules against nested loops over small catalogs."""

import itertools
import re

from quarrylens import session
from quarrylens.operators import profile, relations


def loop_pairs(columns):
    found = set()
    clean = lambda n: re.sub(r"^(tbl_|t_)", "", n.lower())
    for (i, t1, c1, d1), (j, t2, c2, d2) in itertools.combinations(columns, 2):
        a, b = clean(c1), clean(c2)
        if t1 != t2 and d1 == d2 and (
            a == b or (a.endswith(b) and len(b) > 2) or (b.endswith(a) and len(a) > 2)
        ):
            found.add((i, j, a == b))
    return found


def test_name_pairs_match_a_nested_loop(spark):
    names = ["id", "customer_id", "_id", "t_customer_id", "tbl_key", "key", "mer_id", "paid", "valid", "code", "zip_code", "Customer_ID"]
    columns = [(3 * n + t, f"t{t}", name, ("INTEGER", "TEXT")[(n + t) % 5 == 0]) for n, name in enumerate(names) for t in range(3)]
    columns.sort()
    rows = [(*c, 10, 0, 1.0, 10, True) for c in columns]
    candidates = spark.createDataFrame(
        rows,
        "column_id int, table_name string, column_name string, data_type string, distinct_count bigint, "
        "null_count bigint, uniqueness_ratio double, row_count bigint, is_pk boolean",
    )
    got = relations.name_matched_pairs(candidates).selectExpr("a.id AS i", "b.id AS j", "same_name").collect()
    assert {(r["i"], r["j"], r["same_name"]) for r in got} == loop_pairs(columns)
    assert len(got) == len(loop_pairs(columns))


def test_overlap_over_many_columns_and_a_hot_value(spark):
    """More key columns than one word of bits, and a value that fills a third."""
    sizes = {f"t{n}": 5 + n % 7 for n in range(70)}
    tables = {
        name: spark.range(60).selectExpr(f"IF(id % 3 = 0, 0, id % {size}) AS shared_id") for name, size in sizes.items()
    }
    held = {name: {0} | {i % size for i in range(60) if i % 3} for name, size in sizes.items()}
    profile_rows = [
        (n, t, "shared_id", "INTEGER", len(held[t]), 0, 0.1, 60, False) for n, t in enumerate(tables)
    ]
    candidates = spark.createDataFrame(
        profile_rows,
        "column_id int, table_name string, column_name string, data_type string, distinct_count bigint, "
        "null_count bigint, uniqueness_ratio double, row_count bigint, is_pk boolean",
    ).where("column_id < 2 OR column_id > 60")
    got = relations.value_overlap(tables, relations.name_matched_pairs(candidates)).collect()
    kept = [n for n in range(70) if n < 2 or n > 60]
    assert len(got) == len(kept) * (len(kept) - 1) // 2
    for r in got:
        a, b = held[f"t{r['a_id']}"], held[f"t{r['b_id']}"]
        assert (r["a_distinct"], r["b_distinct"], r["shared"]) == (len(a), len(b), len(a & b))


def test_wide_catalog_uses_several_words(spark, monkeypatch):
    monkeypatch.setattr(relations, "WORD_BITS", 2)
    tables = {f"t{n}": spark.range(n, n + 4).selectExpr("id AS k_id") for n in range(5)}
    found = relations.discover_relationships(profile.profile_columns(tables), tables).collect()
    shares = {(r["source_table"], r["target_table"]): r["overlap_percentage"] for r in found}
    assert shares[("t0", "t1")] == 0.75 and shares[("t0", "t3")] == 0.25
    assert shares[("t0", "t4")] == 0.0 and len(shares) == 10


def test_flipped_direction_keeps_its_label(spark):
    tables = {
        "facts": spark.range(100).selectExpr("id % 10 AS part_id", "id AS x"),
        "parts": spark.range(20).selectExpr("id AS part_id"),
    }
    (r,) = relations.discover_relationships(profile.profile_columns(tables), tables).collect()
    assert (r["source_table"], r["target_table"], r["type"], r["direction"]) == (
        "parts", "facts", "many-to-one", "second-to-first",
    )


def test_no_pairs(spark):
    tables = {"a": spark.range(3).selectExpr("id AS p_id"), "b": spark.range(3).selectExpr("id AS q_key")}
    assert relations.discover_relationships(profile.profile_columns(tables), tables).collect() == []


def test_last_edge_wins(spark):
    rows = [(0, "a", "x", "b", "y", 0.5, "one-to-one"), (1, "a", "z", "b", "y", 0.9, "one-to-many")]
    df = spark.createDataFrame(
        rows,
        "position int, source_table string, source_column string, target_table string, target_column string, "
        "confidence double, type string",
    )
    (edge,) = relations.relationship_edges(df).collect()
    assert (edge["source_column"], edge["confidence"]) == ("z", 0.9)


def test_overlap_reads_values_once(spark):
    """The result is read off a stored histogram: no value is grouped or shuffled again."""
    tables = {t: spark.range(n).selectExpr("id AS x_id", "CAST(id AS STRING) AS y_code") for t, n in (("a", 40), ("b", 30), ("c", 9))}
    tables["d"] = spark.createDataFrame([(float("nan"), None), (2.0, "7"), (2.5, "x"), (None, "7")], "x_id double, y_code string")
    made = relations.name_matched_pairs(relations.key_candidates(profile.profile_columns(tables)))
    made = session.cut_lineage(made)
    found = relations.value_overlap(tables, made)
    names = {i: (t, c) for i, t, _, f in profile.catalog_columns(tables) for c in [f.name]}
    held = {i: {r[0] for r in tables[t].where(f"{c} IS NOT NULL").select(c).collect() if r[0] == r[0]} for i, (t, c) in names.items()}
    rows = found.collect()
    got = {(r["a_id"], r["b_id"]): (r["a_distinct"], r["b_distinct"], r["shared"]) for r in rows}
    want = {(r["a"], r["b"]): (len(held[r["a"]]), len(held[r["b"]]), len(held[r["a"]] & held[r["b"]])) for r in made.selectExpr("a.id a", "b.id b").collect()}
    assert got == want and len(got) == len(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "y_code" not in plan and "bit_or" not in plan


def test_overlap_of_keys_that_share_words_in_part(spark):
    """Dense, sparse, negative and farthest whole numbers, doubles and days beside them."""
    far = "CASE id % 3 WHEN 0 THEN -9223372036854775808L + id WHEN 1 THEN 9223372036854775807L - id ELSE id * 1000003 END"
    tables = {
        "a": spark.range(-70, 400).selectExpr("id AS x_id"),
        "b": spark.range(0, 900, 3).selectExpr("id AS x_id"),
        "c": spark.range(128, 192).selectExpr("CAST(id AS INT) AS x_id"),
        "d": spark.range(500).selectExpr(f"{far} AS x_id"),
        "e": spark.range(250, 600).selectExpr(f"{far} AS x_id"),
        "f": spark.range(300).selectExpr("CASE WHEN id % 2 = 0 THEN id / 2D ELSE id + 0.5D END AS x_id"),
        "g": spark.range(3).selectExpr("CAST(NULL AS BIGINT) AS x_id"),
    }
    held = [{r[0] for r in df.collect() if r[0] is not None} for df in tables.values()]
    side = "struct<id:int,table_name:string,column_name:string>"
    asked = [(i, j) for i in range(7) for j in range(i + 1, 7)]
    pairs = spark.createDataFrame([((i, "abcdefg"[i], "x_id"), (j, "abcdefg"[j], "x_id")) for i, j in asked], f"a {side}, b {side}")
    got = {(r["a_id"], r["b_id"]): (r["a_distinct"], r["b_distinct"], r["shared"]) for r in relations.value_overlap(tables, pairs).collect()}
    assert got == {(i, j): (len(held[i]), len(held[j]), len(held[i] & held[j])) for i, j in asked}


def test_dense_keys_meet_in_words(spark):
    """A row for 64 neighbours is grouped, not one for each value."""
    tables = {t: spark.range(6400, numPartitions=2).selectExpr("id AS x_id") for t in "ab"}
    cells = {"a": [(0, "x_id")], "b": [(1, "CASE WHEN x_id < 640 THEN x_id END")]}
    counted = relations._whole_numbers(tables, cells, [0, 0])
    assert {(tuple(r["members"]), r["n"]) for r in counted.collect()} == {((0, 1), 640), ((0,), 5760)}
    side = "struct<id:int,table_name:string,column_name:string>"
    pairs = spark.createDataFrame([((0, "a", "x_id"), (1, "b", "x_id"))], f"a {side}, b {side}")
    assert relations.value_overlap(tables, pairs).first()["shared"] == 6400
