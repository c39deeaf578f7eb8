"""Key relationships between tables, from names, types, uniqueness and shared values.

Everything up to the pair list works on the profile, one row per column. Only
the value overlap touches table data, and it reads nothing but the columns
that occur in a pair.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrylens import session
from quarrylens.functions import values
from quarrylens.operators.profile import Tables, union_all

# Key-like column names and the table prefixes dropped from names.
KEY_SUFFIXES = ("_id", "id", "_key", "key", "_code")
KEY_NAMES = ("id", "uuid", "uid", "code")
NAME_PREFIX = r"^(tbl_|t_)"

PK_RATIO = 0.9
MIN_SUFFIX = 3
MIN_CONFIDENCE = 0.4
UNIQUE_SHARE = 0.95
WORD_BITS = 62
# Columns of a table whose values share a task's hash map; few of them keep it small.
COLUMNS_AT_ONCE = 3


def key_candidates(profile: DataFrame) -> DataFrame:
    """Columns that look like keys by name, or behave like one by uniqueness."""
    lowered = F.lower("column_name")
    named = reduce(or_, [F.endswith(lowered, F.lit(s)) for s in KEY_SUFFIXES])
    named = named | lowered.isin(*KEY_NAMES)
    is_pk = (F.col("uniqueness_ratio") > PK_RATIO) & (F.col("null_count") == 0)
    return profile.withColumn("is_pk", is_pk).where(named | F.col("is_pk"))


def _side(candidates: DataFrame, name: str, prefix: str, *extra: Column) -> DataFrame:
    clean_name = F.regexp_replace(F.lower("column_name"), prefix, "")
    return candidates.select(
        F.struct(
            F.col("column_id").alias("id"),
            "table_name",
            "column_name",
            clean_name.alias("clean_name"),
            F.col("data_type").alias("type"),
            F.col("distinct_count").alias("distinct"),
            "is_pk",
            "row_count",
            "null_count",
        ).alias(name),
        F.col("data_type"),
        *extra,
    )


def name_matched_pairs(candidates: DataFrame, prefix: str = NAME_PREFIX) -> DataFrame:
    """Pairs (a, b) of candidates of different tables, a first in catalog order.

    Names match if equal, or if one ends with the other and the shorter has
    at least three letters. Every name is exploded into its endings, so the
    match is an equi-join instead of a comparison of all column pairs.
    """
    clean_name = F.regexp_replace(F.lower("column_name"), prefix, "")
    length = F.length(clean_name)
    endings = F.array_union(
        F.array(clean_name),
        F.when(
            length > MIN_SUFFIX,
            F.transform(
                F.sequence(F.lit(2), length - MIN_SUFFIX + 1),
                lambda i: F.substring(clean_name, i, length),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    longer = _side(candidates, "x", prefix, F.explode(endings).alias("ending"))
    shorter = _side(candidates, "y", prefix, clean_name.alias("ending"))
    matched = longer.join(shorter, ["data_type", "ending"]).where(
        F.col("x.table_name") != F.col("y.table_name")
    )
    ahead = F.col("x.id") < F.col("y.id")
    return (
        matched.select(
            F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("a"),
            F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("b"),
        )
        .groupBy(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
        .agg(F.first("a").alias("a"), F.first("b").alias("b"))
        .select("a", "b", (F.col("a.clean_name") == F.col("b.clean_name")).alias("same_name"))
    )


def _whole_numbers(
    tables: Tables, listed: Mapping[str, Sequence[tuple[int, str]]], forms: Sequence[int]
) -> DataFrame:
    """(members, n): how many whole numbers are held by just these columns.

    `listed` gives the entries of each table with their values, `forms` the form of every
    entry. A word of 64 neighbours is shuffled with a bit for each number that is there,
    so dense keys take far fewer rows than they have values, and never more.
    """
    parts = []
    for table, cells in listed.items():
        exploded = tables[table].selectExpr(f"posexplode(array({', '.join(value for _, value in cells)})) AS (place, v)")
        parts.append(
            exploded.where("v IS NOT NULL").selectExpr(
                f"array({', '.join(str(n) for n, _ in cells)})[place] AS entry",
                "shiftright(v, 6) AS word",
                "shiftleft(1L, CAST(v & 63 AS INT)) AS bits",
            )
        )
    held = (
        union_all(parts)
        .groupBy("entry", "word")
        .agg(F.bit_or("bits").alias("bits"))
        .selectExpr("*", f"array({', '.join(map(str, forms))})[entry] AS form")
        # at most one element per key column
        .groupBy("form", "word")
        .agg(F.array_sort(F.collect_list(F.struct("entry", "bits"))).alias("held"))
        .select("held")
    )
    # a word that all its columns hold alike needs no look at its numbers
    alike = "array_min(held.bits) = array_max(held.bits)"
    each = "transform(sequence(0, 63), i -> struct(filter(held, h -> getbit(h.bits, i) = 1).entry AS members, 1L AS n))"
    return (
        held.selectExpr(
            f"inline(CASE WHEN {alike} THEN array(struct(held.entry AS members, CAST(bit_count(held[0].bits) AS BIGINT) AS n)) ELSE {each} END)"
        )
        .where("size(members) > 0")
        .groupBy("members")
        .agg(F.sum("n").alias("n"))
        .select("n", "members")
    )


def value_overlap(tables: Tables, pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, a_distinct, b_distinct, shared, overlap) for every pair.

    Each value is shuffled once per column and form, however many pairs the
    column is in: values are grouped with a bit set of the columns that hold them,
    and pairs are read off the small histogram of these sets. Whole numbers are grouped
    in words of 64 neighbours first (`_whole_numbers`). A pair is compared in the
    form its types have in common (`values.common_form`), so most columns have one
    form; a pair without any shares nothing.
    """
    spark = pairs.sparkSession
    # Metadata: one row per pair of key-like columns.
    listed = pairs.select(
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in ("id", "table_name", "column_name")]
    ).distinct().collect()
    columns: dict[tuple[int, str], tuple[str, str]] = {}
    forms = []
    for r in sorted(listed):
        named = {r[f"{side}_id"]: (r[f"{side}_table_name"], r[f"{side}_column_name"]) for side in "ab"}
        types = {i: tables[t].schema[c].dataType for i, (t, c) in named.items()}
        common = values.common_form(types[r["a_id"]], types[r["b_id"]])
        own = {i: common or values.common_form(t, t) for i, t in types.items()}
        forms.append((r["a_id"], r["b_id"], own[r["a_id"]], own[r["b_id"]], common is not None))
        columns |= {(i, own[i]): named[i] for i in named}
    if not columns:
        return spark.createDataFrame(
            [], "a_id int, b_id int, a_distinct bigint, b_distinct bigint, shared bigint, overlap double"
        )
    words = [f"w{i}" for i in range(-(-len(columns) // WORD_BITS))]
    entry = {key: n for n, key in enumerate(sorted(columns))}
    place = {n: divmod(n, WORD_BITS) for n in entry.values()}

    number = {form: n for n, form in enumerate(sorted({form for _, form in columns}))}
    # Per slot: rows have no empty slots to be hashed.
    cells: dict[str, dict[str, list[str]]] = {slot: {} for slot in values.SLOTS}
    whole: dict[str, list[tuple[int, str]]] = {}
    for (column_id, form), (table, column) in sorted(columns.items()):
        word, bit = place[entry[column_id, form]]
        masks = [f"{1 << bit if w == word else 0}L" for w in range(len(words))]
        dtype = tables[table].schema[column].dataType
        for (slot, slot_type), value in zip(values.SLOTS.items(), values.form_values(column, dtype, form)):
            if value == values.no_value(slot_type):
                continue
            if slot == values.WHOLE_SLOT:
                whole.setdefault(table, []).append((entry[column_id, form], value))
            else:
                cells[slot].setdefault(table, []).append(", ".join([*masks, str(number[form]), value]))
    by_slot = []
    for slot, listed in cells.items():
        holders = [
            tables[t].selectExpr(f"stack({len(some)}, {', '.join(some)}) AS ({', '.join([*words, 'form', slot])})")
            for t, all_cells in listed.items()
            for some in (all_cells[i : i + COLUMNS_AT_ONCE] for i in range(0, len(all_cells), COLUMNS_AT_ONCE))
        ]
        if holders:
            by_slot.append(
                union_all(holders)
                .where(f"{slot} IS NOT NULL")
                .groupBy("form", slot)
                .agg(*[F.bit_or(w).alias(w) for w in words])
                .groupBy(*words)
                .agg(F.count(F.lit(1)).alias("n"))
            )
    flags = ", ".join(
        f"CASE WHEN {words[word]} & {1 << bit}L <> 0 THEN {n} END"
        for n, (word, bit) in place.items()
    )
    by_members = [counted.selectExpr("n", f"array_compact(array({flags})) AS members") for counted in by_slot]
    if whole:
        by_members.append(_whole_numbers(tables, whole, [number[form] for _, form in sorted(columns)]))
    # One row per set of columns; what follows reads it twice.
    held = session.cut_lineage(union_all(by_members).groupBy("members").agg(F.sum("n").alias("n")))

    single = held.select(F.explode("members").alias("id"), "n").groupBy("id").agg(
        F.sum("n").alias("distinct")
    )
    by_left = spark.createDataFrame(
        [(a, b, entry[a, f], entry[b, g], comparable) for a, b, f, g, comparable in forms],
        "a_id int, b_id int, a_entry int, b_entry int, comparable boolean",
    )
    shared = (
        held.where(F.size("members") > 1)
        .select(F.explode("members").alias("a_entry"), "members", "n")
        .join(by_left.where("comparable"), "a_entry")
        .where(F.array_contains("members", F.col("b_entry")))
        .groupBy("a_id", "b_id")
        .agg(F.sum("n").alias("shared"))
    )
    a_count = single.select(F.col("id").alias("a_entry"), F.col("distinct").alias("a_distinct"))
    b_count = single.select(F.col("id").alias("b_entry"), F.col("distinct").alias("b_distinct"))
    smaller = F.least("a_distinct", "b_distinct")
    zero = F.lit(0).cast("bigint")
    return (
        by_left.join(a_count, "a_entry", "left")
        .join(b_count, "b_entry", "left")
        .join(shared, ["a_id", "b_id"], "left")
        .select(
            "a_id",
            "b_id",
            F.coalesce("a_distinct", zero).alias("a_distinct"),
            F.coalesce("b_distinct", zero).alias("b_distinct"),
            F.coalesce("shared", zero).alias("shared"),
        )
        .withColumn("overlap", F.when(smaller > 0, F.col("shared") / smaller).otherwise(0.0))
    )


def confidence(same_name: Column, any_pk: Column, overlap: Column) -> Column:
    """0.5, raised by equal names and a primary key, moved by the value overlap."""
    score = F.lit(0.5) + F.when(same_name, 0.2).otherwise(0.0)
    score = score + F.when(any_pk, 0.15).otherwise(0.0)
    score = (
        F.when(overlap > 0.8, score + 0.2)
        .when(overlap > 0.3, score + 0.1)
        .when(overlap == 0, score - 0.3)
        .otherwise(score)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def scored_pairs(pairs: DataFrame, overlap: DataFrame | None) -> DataFrame:
    """Pairs with overlap and confidence, weak ones dropped. No values: overlap 0."""
    if overlap is None:
        scored = pairs.withColumn("overlap", F.lit(0.0))
    else:
        scored = pairs.join(
            overlap.select("a_id", "b_id", "overlap"),
            (F.col("a.id") == F.col("a_id")) & (F.col("b.id") == F.col("b_id")),
        ).drop("a_id", "b_id")
    any_pk = F.col("a.is_pk") | F.col("b.is_pk")
    return scored.withColumn(
        "confidence", confidence(F.col("same_name"), any_pk, F.col("overlap"))
    ).where(F.col("confidence") >= MIN_CONFIDENCE)


def with_cardinality(scored: DataFrame, cardinality: str = "distinct") -> DataFrame:
    """Add `type` and the source/target columns, unique side first.

    By default a side is unique if it is a primary key or holds nearly as many
    distinct values as the other side. `cardinality="uniqueness"` compares its
    distinct values with its own filled rows instead.
    """
    if cardinality == "uniqueness":
        a_other = F.col("a.row_count") - F.col("a.null_count")
        b_other = F.col("b.row_count") - F.col("b.null_count")
    else:
        a_other, b_other = F.col("b.distinct"), F.col("a.distinct")
    a_unique = F.col("a.is_pk") | (F.col("a.distinct") >= UNIQUE_SHARE * a_other)
    b_unique = F.col("b.is_pk") | (F.col("b.distinct") >= UNIQUE_SHARE * b_other)
    typed = scored.withColumns({"a_unique": a_unique, "b_unique": b_unique})
    flip = F.col("b_unique") & ~F.col("a_unique")
    return typed.select(
        F.col("a.id").alias("a_id"),
        F.col("b.id").alias("b_id"),
        F.when(flip, F.col("b")).otherwise(F.col("a")).alias("source"),
        F.when(flip, F.col("a")).otherwise(F.col("b")).alias("target"),
        F.col("a.column_name").alias("first_column"),
        F.col("b.column_name").alias("second_column"),
        "overlap",
        "confidence",
        F.when(F.col("a_unique") & F.col("b_unique"), "one-to-one")
        .when(F.col("a_unique"), "one-to-many")
        .when(F.col("b_unique"), "many-to-one")
        .otherwise("many-to-many")
        .alias("type"),
        F.when(flip, "second-to-first").otherwise("first-to-second").alias("direction"),
    )


def described(typed: DataFrame) -> DataFrame:
    """Final relationship rows, numbered in catalog order of the pair."""
    source, target = F.col("source"), F.col("target")
    join_text = F.format_string(
        "SELECT * FROM %s JOIN %s ON %s.%s = %s.%s",
        source["table_name"], target["table_name"],
        source["table_name"], source["column_name"],
        target["table_name"], target["column_name"],
    )
    reason = F.format_string(
        "Matched by column names '%s' / '%s' with estimated %s%% value overlap.",
        "first_column",
        "second_column",
        (F.col("overlap") * 100).cast("int").cast("string"),
    )
    # One row per relationship of the catalog: a metadata-sized window.
    position = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("a_id", "b_id")) - 1
    return typed.select(
        position.alias("position"),
        source["table_name"].alias("source_table"),
        source["column_name"].alias("source_column"),
        target["table_name"].alias("target_table"),
        target["column_name"].alias("target_column"),
        F.round("confidence", 2).alias("confidence"),
        "type",
        "direction",
        F.round("overlap", 2).alias("overlap_percentage"),
        join_text.alias("join_suggestion"),
        reason.alias("reason"),
    )


def discover_relationships(
    profile: DataFrame,
    tables: Tables | None = None,
    *,
    prefix: str = NAME_PREFIX,
    cardinality: str = "distinct",
) -> DataFrame:
    """Relationships of one dataset from its profile and, if given, its values.

    Hand in a stored profile: it is read once for the pair list and again in
    the result.
    """
    pairs = name_matched_pairs(key_candidates(profile), prefix)
    overlap = value_overlap(tables, pairs) if tables is not None else None
    return described(with_cardinality(scored_pairs(pairs, overlap), cardinality))


def relationship_edges(relationships: DataFrame) -> DataFrame:
    """One directed edge per table pair; the last relationship wins."""
    last = F.max_by(
        F.struct("source_column", "target_column", "confidence", "type"), F.col("position")
    )
    return (
        relationships.groupBy("source_table", "target_table")
        .agg(last.alias("edge"))
        .select("source_table", "target_table", "edge.*")
    )


def table_degrees(edges: DataFrame) -> DataFrame:
    """Incoming and outgoing edges per table."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("source_table").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("target_table").alias("table_name"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return ends.groupBy("table_name").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")
    )
