"""CSV and JSON rules, extension dispatch and JDBC reader options."""

import json

import pytest

from quarrylens.sources import files, jdbc


def test_csv_types_and_missing_values(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(
        'id,score,flag,name,none,odd\n1,1.5,True,"Smith, ""Al""",,1\n2,NA,False,NA,NULL,x\n3,-2e3,true,n/a,nan,007\n'
    )
    df = files.scan_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "score": "double", "flag": "boolean", "name": "string", "none": "double", "odd": "string",
    }
    rows = df.orderBy("id").collect()
    assert [r["score"] for r in rows] == [1.5, None, -2000.0]
    assert [r["name"] for r in rows] == ['Smith, "Al"', None, None]
    assert files.table_name(str(path)) == "people"
    assert files.scan_csv(spark, str(path), rows=2).count() == 2


def test_nullable_whole_numbers_stay_whole(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,5\n2,\n")
    assert dict(files.scan_csv(spark, str(tmp_path / "t.csv")).dtypes)["v"] == "bigint"


def write(tmp_path, name, value):
    (tmp_path / name).write_text(json.dumps(value, indent=1))
    return str(tmp_path / name)


def test_json_roots(spark, tmp_path):
    records = [{"a": 1, "s": {"city": "X", "deep": {"z": True}}, "tags": ["p"]}, {"a": 2, "s": {"city": "Y", "deep": {"z": False}}, "tags": []}]
    listed = files.scan_json(spark, write(tmp_path, "list.json", records))
    assert sorted(listed.columns) == ["a", "s.city", "s.deep.z", "tags"]
    assert listed.count() == 2
    # The first list in file order, although another sorts before it.
    nested = {"meta": {"n": 1}, "zeta": records, "alpha": [{"other": 1}]}
    first = files.scan_json(spark, write(tmp_path, "nested.json", nested))
    assert sorted(first.columns) == ["a", "s.city", "s.deep.z", "tags"] and first.count() == 2
    chosen = files.scan_json(spark, write(tmp_path, "chosen.json", nested), record_path="alpha")
    assert [tuple(r) for r in chosen.collect()] == [(1,)]
    single = files.scan_json(spark, write(tmp_path, "one.json", {"a": 1, "b": {"c": 2}}))
    assert [r.asDict() for r in single.collect()] == [{"a": 1, "b.c": 2}]


def test_json_without_records(spark, tmp_path):
    with pytest.raises(ValueError):
        files.scan_json(spark, write(tmp_path, "plain.json", {"a": [1, 2]}))


def test_extension_dispatch(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k\n1\n")
    assert files.scan_folder(spark, str(tmp_path), "t", "csv", ["k"]).collect()[0]["k"] == 1
    assert list(files.folder_tables(spark, str(tmp_path), ["t"], "csv")) == ["t"]
    with pytest.raises(ValueError):
        files.scan_file(spark, "data.xlsx")


def test_jdbc_options():
    plain = jdbc.table_options("jdbc:sqlite:/data/shop.db", "orders")
    assert plain["dbtable"] == "`orders`" and "partitionColumn" not in plain
    split = jdbc.table_options("jdbc:postgresql://host/db", "orders", split_column="id", bounds=(0, 10**9), partitions=64)
    assert split["dbtable"] == '"orders"' and split["numPartitions"] == "64"
    with pytest.raises(ValueError):
        jdbc.dialect("jdbc:oracle:thin")


def test_csv_keeps_quoted_breaks_and_types_with_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,x\n1,"two\nlines",inf\n2,NA,1.5\n')
    rows = files.scan_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines", float("inf")), (2, None, 1.5)]
    typed = files.scan_csv(spark, str(tmp_path / "a.csv"), schema="id int, note string, x double").orderBy("id").collect()
    assert [tuple(r) for r in typed] == [tuple(r) for r in rows]


def test_json_with_an_empty_list_is_an_empty_table(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1, "items": []}')
    assert files.scan_json(spark, str(tmp_path / "a.json")).collect() == []
