"""Test tables and the views derived from them by a fixed rule on the key.

Every view is written twice: as a DataFrame here, and as SQL in `VIEW_SQL`.
The raw tables hold no nulls, duplicates or orphans, so the views put some in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
PREFIXED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Columns by view as (name, kind); kinds: i int, d double, s text, t time stamp, a array.
COLUMNS: dict[str, tuple[tuple[str, str], ...]] = {
    "region": (("r_regionkey", "i"), ("r_name", "s")),
    "nation": (("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")),
    "customer": (
        ("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "d"),
        ("c_mktsegment", "s"),
    ),
    "supplier": (("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "d")),
    "part": (
        ("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"),
        ("p_retailprice", "d"),
    ),
    "orders": (
        ("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "d"),
        ("o_orderdate", "t"), ("o_orderpriority", "s"),
    ),
    "lineitem": (
        ("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"),
        ("l_quantity", "d"), ("l_extendedprice", "d"), ("l_discount", "d"), ("l_tax", "d"),
        ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t"),
    ),
    "events": (
        ("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "d"),
        ("props", "s"),
    ),
    "documents": (("doc_id", "i"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "i")),
    "embeddings": (("vec_id", "i"), ("embedding", "a"), ("label", "i")),
    "pages": (("page_id", "i"), ("url", "s"), ("html", "s")),
    "benchmark": (("item_id", "i"), ("text", "s")),
    "labels": (("doc_id", "i"), ("quality", "i"), ("toxic", "i")),
    "conversations": (("conv_id", "i"), ("turn", "i"), ("role", "s"), ("text", "s")),
}
COLUMNS["dirty_customer"] = COLUMNS["customer"]
COLUMNS["partial_customer"] = COLUMNS["customer"]
COLUMNS["orders_nullfk"] = COLUMNS["orders"]
COLUMNS["empty_orders"] = COLUMNS["orders"]
COLUMNS["dirty_events"] = COLUMNS["events"] + (
    ("user_email", "s"), ("event_date", "s"), ("logged_at", "s"), ("user_phone", "s"),
    ("card_no", "s"), ("salary", "d"),
)


def _bare_name(column: str) -> str:
    return column.split("_", 1)[1]


for _t in PREFIXED:
    COLUMNS[f"bare_{_t}"] = tuple((_bare_name(c), k) for c, k in COLUMNS[_t])

# The row order that "first values" refers to.
ORDER_KEYS: dict[str, list[str]] = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ],
    "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
    "dirty_customer": ["c_custkey"], "partial_customer": ["c_custkey"],
    "orders_nullfk": ["o_orderkey"], "empty_orders": ["o_orderkey"],
    "dirty_events": ["event_id"],
}
for _t in PREFIXED:
    ORDER_KEYS[f"bare_{_t}"] = [_bare_name(k) for k in ORDER_KEYS[_t]]

# Datasets of the checked catalog: table name in the catalog -> view behind it.
DATASETS: dict[str, dict[str, str]] = {
    "shop": {t: f"bare_{t}" for t in PREFIXED},
    "activity": {"events": "dirty_events"},
    "corpus": {t: t for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")},
}


_schemas: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A base table; its footer is read for the schema only once."""
    path = f"{sf_dir}/{table}.parquet"
    if (sf_dir, table) not in _schemas:
        _schemas[sf_dir, table] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[sf_dir, table]).parquet(path)


def _dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    dirty = read(spark, sf_dir, "customer").withColumns(
        {
            "c_acctbal": F.when(key % 11 == 0, None)
            .when(key % 13 == 0, float("nan"))
            .when(key % 97 == 0, balance * 1000)
            .otherwise(balance),
            "c_mktsegment": F.when(key % 4 != 0, F.col("c_mktsegment")),
        }
    )
    # Every fiftieth row twice, from one scan of the table.
    copies = F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dirty.select("*", F.explode(copies).alias("copy")).drop("copy")


def _dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    domain = F.when(key % 40 == 0, "example.com").otherwise("@example.com")
    return read(spark, sf_dir, "events").withColumns(
        {
            "user_email": F.when(
                key % 9 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), domain)
            ),
            "event_date": F.when(key % 60 == 0, "not a date").otherwise(stamp),
            "logged_at": F.when((key > 500) & (key % 70 == 0), "unknown").otherwise(stamp),
            "user_phone": F.concat(
                F.lit("555-010-"), F.lpad((key % 10000).cast("string"), 4, "0")
            ),
            "card_no": F.lpad(key.cast("string"), 16, "0"),
            "salary": F.col("value"),
        }
    )


QUESTION_TEMPLATES = (
    "What is the average value of %s events?",
    "How many null values does the %s table have?",
    "Which tables join with %s on a foreign key?",
    "Write a query for %s rows",
    "What is the meaning of %s?",
    "Which column holds %s?",
    "Show all customer email records for %s",
    "Tell me about %s customers",
)
ANSWERS = (
    "Plain summary of the catalog.",
    "Reach the user at jane.doe@example.com today.",
    "Reach the user at [REDACTED_EMAIL] today.",
    "The value is [MASKED_PII_DATA].",
    "select * from users -- ask bob@example.com",
)


def _chosen(index: Column, options: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index % len(options) + 1).cast("int"))


def _question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.replace(_chosen(key, QUESTION_TEMPLATES), F.lit("%s"), F.col("event_type")).alias("question"),
        _chosen(key, ANSWERS).alias("answer"),
        F.when(key % 3 == 0, "Fallback rules").otherwise("main model").alias("model"),
        (key % 4 != 0).alias("has_context"),
    )


SQL_TEMPLATES = (
    "SELECT custkey FROM customer WHERE custkey = %s",
    "SELECT * FROM orders JOIN lineitem ON orders.orderkey = lineitem.orderkey WHERE orders.orderkey = %s",
    "SELECT count(*) FROM shop.nation WHERE nation.nationkey = %s",
    "-- recent rows from events\nSELECT * /* not FROM part */ FROM `supplier` WHERE suppkey = %s",
    "SELECT * FROM missing_table WHERE id = %s",
    "SELECT Customer.nickname FROM customer WHERE customer.custkey = %s",
    "SELECT %s",
)


def _sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("sql_id"),
        F.replace(_chosen(key, SQL_TEMPLATES), F.lit("%s"), key.cast("string")).alias("sql_text"),
    )


def _error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("GET /v1?key=k-"), key, F.lit("_z failed")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("token SECRET-TOKEN-1 refused for "), key))
        .otherwise(F.concat(F.col("event_type"), F.lit(" timed out")))
        .alias("message"),
    )


_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dirty_customer": _dirty_customer,
    "dirty_events": _dirty_events,
    "partial_customer": lambda s, d: read(s, d, "customer").where(F.col("c_custkey") % 7 != 0),
    "orders_nullfk": lambda s, d: read(s, d, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey"))
    ),
    "empty_orders": lambda s, d: read(s, d, "orders").where(F.col("o_orderkey") < 0),
    # the same keys in other types
    "ledger": lambda s, d: read(s, d, "orders").selectExpr(
        "o_orderkey AS entry_id", "CAST(o_custkey AS DOUBLE) AS buyer_key", "CAST(o_totalprice AS DECIMAL(12, 2)) AS total_key",
        "CAST(o_orderdate AS DATE) AS day_key",
    ),
    "archive": lambda s, d: read(s, d, "orders").where("o_orderkey % 5 <> 0 AND month(o_orderdate) <> 3").selectExpr(
        "o_custkey AS buyer_key", "CAST(o_totalprice AS DECIMAL(18, 4)) AS total_key", "o_orderdate AS day_key"
    ),
    "invoices": lambda s, d: read(s, d, "orders").where("o_orderkey % 7 <> 0").selectExpr("o_totalprice AS total_key"),
    "question_log": _question_log,
    "sql_log": _sql_log,
    "error_log": _error_log,
}
_BARE_SOURCES = {"customer": "dirty_customer", "orders": "orders_nullfk"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE_TABLES:
        return read(spark, sf_dir, name)
    if name.startswith("bare_"):
        table = name.removeprefix("bare_")
        source = view(spark, sf_dir, _BARE_SOURCES.get(table, table))
        return source.select(*[F.col(c).alias(_bare_name(c)) for c, _ in COLUMNS[table]])
    return _BUILDERS[name](spark, sf_dir)


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in names}


def dataset_tables(spark: SparkSession, sf_dir: str, dataset: str) -> dict[str, DataFrame]:
    return {t: view(spark, sf_dir, v) for t, v in DATASETS[dataset].items()}


def dataset_order(dataset: str) -> dict[str, list[str]]:
    return {t: ORDER_KEYS[v] for t, v in DATASETS[dataset].items()}


# --- the same views as SQL -------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(options: tuple[str, ...]) -> str:
    return "[" + ", ".join(_text(o) for o in options) + f"][(event_id % {len(options)} + 1)::INT]"


VIEW_SQL: dict[str, str] = {
    "dirty_customer": """
        SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'NaN'::DOUBLE
                    WHEN c_custkey % 97 = 0 THEN c_acctbal * 1000 ELSE c_acctbal END AS c_acctbal,
               CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment
        FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 50 = 0)""",
    "dirty_events": """
        SELECT *,
               CASE WHEN event_id % 9 <> 0 THEN 'u' || user_id ||
                    CASE WHEN event_id % 40 = 0 THEN 'example.com' ELSE '@example.com' END END AS user_email,
               CASE WHEN event_id % 60 = 0 THEN 'not a date'
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_date,
               CASE WHEN event_id > 500 AND event_id % 70 = 0 THEN 'unknown'
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS logged_at,
               '555-010-' || lpad((event_id % 10000)::VARCHAR, 4, '0') AS user_phone,
               lpad(event_id::VARCHAR, 16, '0') AS card_no,
               value AS salary
        FROM events""",
    "partial_customer": "SELECT * FROM customer WHERE c_custkey % 7 <> 0",
    "orders_nullfk": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS o_custkey,
               o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""",
    "empty_orders": "SELECT * FROM orders WHERE o_orderkey < 0",
    "ledger": """
        SELECT o_orderkey AS entry_id, o_custkey::DOUBLE AS buyer_key, o_totalprice::DECIMAL(12, 2) AS total_key,
               o_orderdate::DATE AS day_key FROM orders""",
    "archive": """
        SELECT o_custkey AS buyer_key, o_totalprice::DECIMAL(18, 4) AS total_key, o_orderdate AS day_key
        FROM orders WHERE o_orderkey % 5 <> 0 AND month(o_orderdate) <> 3""",
    "invoices": "SELECT o_totalprice AS total_key FROM orders WHERE o_orderkey % 7 <> 0",
    "question_log": f"""
        SELECT event_id, replace({_pick(QUESTION_TEMPLATES)}, '%s', event_type) AS question,
               {_pick(ANSWERS)} AS answer,
               CASE WHEN event_id % 3 = 0 THEN 'Fallback rules' ELSE 'main model' END AS model,
               event_id % 4 <> 0 AS has_context
        FROM events""",
    "sql_log": f"""
        SELECT event_id AS sql_id, replace({_pick(SQL_TEMPLATES)}, '%s', event_id::VARCHAR) AS sql_text
        FROM events""",
    "error_log": """
        SELECT event_id,
               CASE WHEN event_id % 3 = 0 THEN 'GET /v1?key=k-' || event_id || '_z failed'
                    WHEN event_id % 3 = 1 THEN 'token SECRET-TOKEN-1 refused for ' || event_id
                    ELSE event_type || ' timed out' END AS message
        FROM events""",
}
for _t in PREFIXED:
    _source = _BARE_SOURCES.get(_t, _t)
    _from = f"({VIEW_SQL[_source]})" if _source in VIEW_SQL else _source
    VIEW_SQL[f"bare_{_t}"] = (
        "SELECT " + ", ".join(f"{c} AS {_bare_name(c)}" for c, _ in COLUMNS[_t]) + f" FROM {_from}"
    )


def relation(name: str) -> str:
    """A FROM item for a base table or a view."""
    return name if name in BASE_TABLES else f"({VIEW_SQL[name]})"
