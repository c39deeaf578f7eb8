"""Exact quartiles by distributed selection, and the outlier fences built on them.

A quartile lies between two order statistics. Each is enclosed in an interval of
values that surely holds both, at first the whole range. A round is one scan: it
counts the values below and inside a candidate part of the interval, which becomes
the interval if it holds the ranks, and sketches the values inside, from whose
quantiles the next candidate comes. Sketches only say where to look: a candidate
that misses leaves the rest of the interval, and the numbers are exact whatever the
sketches say. Rounds go on until at most MOST_VALUES are left to put in order, or
all that are left are equal; equal values count as one.

Columns of many values begin with a cheaper round without sketches: one scan counts
them in buckets of equal width, and the interval is what the buckets with the ranks
hold. Where most values share a bucket, sketches go on from there.

The rounds run while the plan is built and bring back a few numbers per column;
the order of the values left is part of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from quarrylens.functions import values

QUARTILES = (0.25, 0.75)
MIN_VALUES = 5
FENCE = 1.5
SKETCH_SIZE = 4096
#: Values of one interval that one task puts in order.
MOST_VALUES = 2_000_000
# Columns of more values are first counted in this many buckets of equal width.
BUCKETS = 4096
BUCKETS_FROM = 100_000
# Sketches of all tasks are merged in this many groups before the last merge.
MERGE_GROUPS = 256


def rank_error(sketch_size: int) -> float:
    """Normalized rank error of a KLL sketch at 99 % confidence."""
    return 2.296 / sketch_size**0.9021


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, values.NUMERIC)]


def _number(field: T.StructField) -> str:
    return f"CAST({values.clean(field.name, field.dataType)} AS DOUBLE)"


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


@dataclass
class Search:
    """Where the two order statistics of one quartile of one column are."""

    column: int
    quartile: int
    n: int
    low: float
    high: float
    below: int = 0
    held: int = 0

    @property
    def place(self) -> float:
        return (self.n - 1) * QUARTILES[self.quartile]

    @property
    def ended(self) -> bool:
        return self.held <= MOST_VALUES or self.low == self.high

    def inside(self) -> str:
        return f"x{self.column} BETWEEN {_double(self.low)} AND {_double(self.high)}"


def _sketched(numbers: DataFrame, cells: Sequence[str], ranks: Sequence[Sequence[float]], size: int) -> list[list[float] | None]:
    """Of each cell expression the quantiles at its ranks; none without values."""
    first = [e for k, c in enumerate(cells) for e in (f"count({c}) AS n{k}", f"kll_sketch_agg_double({c}, {size}) AS s{k}")]
    again = [e for k in range(len(cells)) for e in (f"sum(n{k}) AS n{k}", f"kll_merge_agg_double(s{k}, {size}) AS s{k}")]
    # in two levels: one sketch per task would be too much for a single merge
    merged = numbers.withColumn("part", F.spark_partition_id() % MERGE_GROUPS).groupBy("part").agg(*map(F.expr, first)).selectExpr(*again)
    asked = [
        f"CASE WHEN n{k} > 0 THEN kll_sketch_get_quantile_double(s{k}, array({', '.join(f'{r!r}D' for r in rs)})) END AS q{k}"
        for k, rs in enumerate(ranks)
    ]
    return list(merged.selectExpr(*asked).first())


def _around(search: Search, size: int) -> list[float]:
    """Relative ranks in the interval between which both order statistics should lie."""
    slack = 4.0 * rank_error(size) + 1 / search.held
    ranks = (math.floor(search.place) - search.below, math.ceil(search.place) - search.below + 1)
    return [min(max(r / search.held + d, 0.0), 1.0) for r, d in zip(ranks, (-slack, slack))]


def _narrow(numbers: DataFrame, searches: Sequence[Search], size: int) -> None:
    """One round: candidates from sketches of the intervals, then what they hold."""
    # both quartiles of a column share a sketch as long as they share an interval
    ranks: dict[str, list[float]] = {}
    asked = []
    for s in searches:
        cell = f"CASE WHEN {s.inside()} THEN x{s.column} END" if s.held < s.n else f"x{s.column}"
        asked.append((cell, len(ranks.setdefault(cell, []))))
        ranks[cell] += _around(s, size)
    found = dict(zip(ranks, _sketched(numbers, list(ranks), list(ranks.values()), size)))
    candidates = [found[cell][k : k + 2] if found[cell] else [s.low, s.high] for s, (cell, k) in zip(searches, asked)]
    counts = []
    for k, (s, (low, high)) in enumerate(zip(searches, candidates)):
        x = f"x{s.column}"
        counts += [f"count_if({x} < {_double(low)}) AS b{k}", f"count_if({x} <= {_double(high)}) AS t{k}"]
    row = numbers.selectExpr(*counts).first()
    for k, (s, (low, high)) in enumerate(zip(searches, candidates)):
        below, upto = row[f"b{k}"], row[f"t{k}"]
        first, second = math.floor(s.place), math.ceil(s.place)
        end = s.below + s.held
        if second < below:  # missed: both lie before the candidate
            s.high, s.held = math.nextafter(low, -math.inf), below - s.below
        elif first >= upto:
            s.low, s.below, s.held = math.nextafter(high, math.inf), upto, end - upto
        elif first < below:
            s.high, s.held = high, upto - s.below
        elif second >= upto:
            s.low, s.below, s.held = low, below, end - below
        else:
            s.low, s.high, s.below, s.held = low, high, below, upto - below


def _scale(search: Search) -> float:
    """Buckets per unit of a column's range; infinite where buckets can't be told apart."""
    width = search.high - search.low
    return BUCKETS / width if math.isfinite(width) and width >= 1e-290 else math.inf


def _bucketed(numbers: DataFrame, searches: Sequence[Search]) -> None:
    """The first round of searches that still hold the whole range of their columns."""
    ranges = {s.column: (s.low, _scale(s)) for s in searches}
    place = {column: k for k, column in enumerate(ranges)}
    low, scale = (f"array({', '.join(_double(r[k]) for r in ranges.values())})[place]" for k in (0, 1))
    buckets = (
        numbers.selectExpr(f"posexplode(array({', '.join(f'x{c}' for c in ranges)})) AS (place, v)")
        .where("v IS NOT NULL")
        .selectExpr("place", f"floor((v - {low}) * {scale}) AS bucket", "v")
        .groupBy("place", "bucket")
        .agg(F.expr("count(1) AS n"), F.expr("min(v) AS low"), F.expr("max(v) AS high"))
        .selectExpr("*", "sum(n) OVER (PARTITION BY place ORDER BY bucket) AS upto")
    )
    ranks = [(place[s.column], r) for s in searches for r in (math.floor(s.place), math.ceil(s.place))]
    asked = " OR ".join(f"(place = {p} AND upto - n <= {r} AND {r} < upto)" for p, r in ranks)
    rows = buckets.where(asked).collect()
    for s, k in zip(searches, range(0, len(ranks), 2)):
        first, last = (next(b for b in rows if b["place"] == p and b["upto"] - b["n"] <= r < b["upto"]) for p, r in ranks[k : k + 2])
        s.low, s.high, s.below = first["low"], last["high"], first["upto"] - first["n"]
        s.held = last["upto"] - s.below


def quartiles(df: DataFrame, fields: Sequence[T.StructField], sketch_size: int = SKETCH_SIZE) -> DataFrame:
    """One row with an array of (n, q1, q3), one entry per field."""
    numbers = df.selectExpr(*[f"{_number(f)} AS x{i}" for i, f in enumerate(fields)])
    at = range(len(fields))
    facts = numbers.selectExpr(*[e for i in at for e in (f"count(x{i}) AS n{i}", f"min(x{i}) AS lo{i}", f"max(x{i}) AS hi{i}")]).first()
    searches = [
        Search(i, q, facts[f"n{i}"], facts[f"lo{i}"], facts[f"hi{i}"], held=facts[f"n{i}"])
        for i in at if facts[f"n{i}"] for q in range(len(QUARTILES))
    ]
    todo = [s for s in searches if s.low != s.high]
    many = [s for s in todo if s.n > BUCKETS_FROM and math.isfinite(_scale(s))]
    if many:
        todo = [s for s in todo if s not in many]
        _bucketed(numbers, many)
        todo += [s for s in many if not s.ended]
    while todo:
        before = [s.held for s in todo]
        _narrow(numbers, todo, sketch_size)
        # what a round leaves whole is few values, or one value that outweighs the others
        todo = [s for s, held in zip(todo, before) if not s.ended and s.held < held]

    # an interval of a single value is that quartile; the values of the others are put in order
    known = {s.column * len(QUARTILES) + s.quartile: _double(s.low) for s in searches if s.low == s.high}
    searches = [s for s in searches if s.low != s.high]
    picks = [known.get(slot, f"try_element_at(m, {slot})") for slot in range(len(fields) * len(QUARTILES))]
    items = [f"struct({facts[f'n{i}']}L AS n, {picks[2 * i]} AS q1, {picks[2 * i + 1]} AS q3)" for i in at]
    if not searches:
        empty = F.expr("CAST(map() AS map<int, double>) AS m")
        return df.sparkSession.range(1).select(empty).selectExpr(f"array({', '.join(items)}) AS q")
    inside = [s.inside() for s in searches]
    stacked = ", ".join(
        f"{s.column * len(QUARTILES) + s.quartile}, CASE WHEN {c} THEN x{s.column} END, {s.below}L, {_double(s.place)}"
        for s, c in zip(searches, inside)
    )
    ranked = (
        numbers.where(" OR ".join(f"({c})" for c in inside))
        .selectExpr(f"stack({len(searches)}, {stacked}) AS (slot, v, below, place)")
        .where("v IS NOT NULL")
        .groupBy("slot", "place", "below", "v")
        .agg(F.expr("count(1) AS copies"))
        .selectExpr("slot", "place", "v", "below + sum(copies) OVER (PARTITION BY slot ORDER BY v) AS upto")
    )
    picked = ranked.groupBy("slot", "place").agg(
        F.expr("min(CASE WHEN upto > floor(place) THEN v END) AS lo"), F.expr("min(CASE WHEN upto > ceil(place) THEN v END) AS hi"),
    ).selectExpr(
        "slot", "CASE WHEN lo = hi THEN lo ELSE (1 - (place - floor(place))) * lo + (place - floor(place)) * hi END AS value",
    )
    # At most one entry per quartile and numeric column.
    found = picked.agg(F.expr("map_from_entries(collect_list(struct(slot, value))) AS m"))
    return found.selectExpr(f"array({', '.join(items)}) AS q")


def fences(quartile_row: DataFrame) -> DataFrame:
    """One row, one array: (low, high) per field, null where the rule does not apply."""
    return quartile_row.selectExpr(
        f"transform(q, x -> CASE WHEN x.n >= {MIN_VALUES} AND x.q3 - x.q1 <> 0 THEN struct("
        f"x.q1 - {FENCE}D * (x.q3 - x.q1) AS low, x.q3 + {FENCE}D * (x.q3 - x.q1) AS high) END) AS fences"
    )


def outlier_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One row with an array of outlier counts, one per field.

    The fences, two numbers per field, are constants of the counting scan.
    """
    bounds = fences(quartiles(df, fields)).first()["fences"]
    counts = [
        f"count_if({_number(f)} < {_double(b['low'])} OR {_number(f)} > {_double(b['high'])})" if b else "0L"
        for f, b in zip(fields, bounds)
    ]
    return df.selectExpr(f"array({', '.join(counts)}) AS outliers")
