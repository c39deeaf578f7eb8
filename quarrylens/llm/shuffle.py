"""Uniform shuffle of a table into shards of exact sizes.

Hypergeometric communication matrix: how many rows of source partition p go to
shard j is drawn exactly as a uniform shuffle would deal them, given the rows
of each partition and the size of each shard. The partitions are halved again
and again: the left half of a node draws its rows of shard 0, then of shard 1
from what is left, and so on (multivariate hypergeometric), the right half
takes the rest. The leaves are the rows of the matrix.

Each partition permutes its rows locally and deals them by its matrix row, the
exchange moves them, and a second permutation orders each shard: a shard is
cut into buckets by a fresh hash of (partition, local place), a bucket sorts its
rows by it, and sums over the bucket counts give gapless slots. No task holds
a shard; a bucket has about BUCKET_ROWS rows, whatever keys or texts repeat.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common

N_SHARDS = 16
BUCKET_ROWS = 100_000
#: Splits of the partition tree that one task makes before its subtrees are dealt out.
TREE_HEAD = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _uniform(*parts: Column | str) -> Column:
    """A number from [0, 1) for each combination of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` rows out of `total`, `marked` of them marked, are marked.

    Exact inversion of u: the probabilities around the mode follow from their
    ratios and are summed up to where they vanish beside the rest (nine standard
    deviations and 40, below one part in 10^17). A draw takes a number of steps in
    the order of the standard deviation.
    """

    def from_parameters(h: Column) -> Column:
        t, k, n, u = h["t"], h["k"], h["n"], h["u"]
        spread = F.sqrt(n * (k / F.greatest(t, F.lit(1.0))) * ((t - k) / F.greatest(t, F.lit(1.0))))
        low, high = F.greatest(F.lit(0.0), n - (t - k)), F.least(n, k)
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (k + 1) / (t + 2)).cast("double")))
        reach = F.ceil(spread * 9 + 40).cast("double")
        shape = F.struct(
            t.alias("t"), k.alias("k"), n.alias("n"), u.alias("u"), mode.alias("m"),
            F.least(high - mode, reach).cast("int").alias("up"), F.least(mode - low, reach).cast("int").alias("down"),
        )
        return _let(shape, from_shape)

    def from_shape(g: Column) -> Column:
        t, k, n, m = g["t"], g["k"], g["n"], g["m"]

        def above(w: Column, i: Column) -> Column:  # weight of m + i from that of m + i - 1
            x = m + i - 1
            return w * (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))

        def below(w: Column, i: Column) -> Column:  # weight of m - i from that of m - i + 1
            x = m - i + 1
            return w * x * (t - k - n + x) / ((k - x + 1) * (n - x + 1))

        def walk(steps: Column, ratio: Callable[[Column, Column], Column], first: Column, goal: Column | None) -> Column:
            """(weight, running sum, step at which the sum passed the goal or 0)."""
            state = F.struct(F.lit(1.0).alias("w"), first.alias("s"), F.lit(0).alias("at"))

            def step(acc: Column, i: Column) -> Column:
                def moved(w: Column) -> Column:
                    s = acc["s"] + w
                    at = F.lit(0) if goal is None else F.when((acc["at"] == 0) & (s > goal), i).otherwise(acc["at"])
                    return F.struct(w.alias("w"), s.alias("s"), at.alias("at"))

                return _let(ratio(acc["w"], i), moved)

            indexes = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(indexes, state, step)

        def chosen(sums: Column) -> Column:
            goal = g["u"] * (1 + sums["up"] + sums["down"])
            up = walk(g["up"], above, F.lit(1.0), goal)["at"]
            down = walk(g["down"], below, 1 + sums["up"], goal)["at"]
            return (m + F.when(goal < 1, 0).when(goal < 1 + sums["up"], up).otherwise(-down)).cast("long")

        sums = F.struct(
            walk(g["up"], above, F.lit(0.0), None)["s"].alias("up"), walk(g["down"], below, F.lit(0.0), None)["s"].alias("down")
        )
        return _let(sums, chosen)

    numbers = F.struct(*[c.cast("double").alias(n) for n, c in zip("tknu", (total, marked, drawn, u))])
    return _let(numbers, from_parameters)


def _left_share(sizes: Column, rows: Column, total: Column, draw_key: Column, seed: int) -> Column:
    """How many rows of each shard fall to `rows` out of the `total` rows of a node."""
    start = F.struct(rows.cast("long").alias("rows"), total.cast("long").alias("total"), F.array().cast("array<long>").alias("taken"))

    def next_shard(acc: Column, j: Column) -> Column:
        def dealt(h: Column) -> Column:
            return F.struct(
                (acc["rows"] - h).alias("rows"), (acc["total"] - F.get(sizes, j)).alias("total"), F.array_append(acc["taken"], h).alias("taken")
            )

        return _let(hypergeometric(acc["total"], F.get(sizes, j), acc["rows"], _uniform(F.lit(seed), draw_key, j)), dealt)

    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, next_shard, lambda acc: acc["taken"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def communication_matrix(counts: DataFrame, n_shards: int, n_partitions: int, seed: int) -> DataFrame:
    """part, ends: of each source partition the running sums of its rows by shard.

    `counts` has part (0 .. n_partitions - 1) and n, one row per partition that has
    rows: as many as Spark schedules scan tasks, which is what the root holds as one list.
    """
    root = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 0)
    total = _sum(F.col("parts.n"))
    root = root.withColumn("total", total).select(
        "parts",
        F.transform(
            F.sequence(F.lit(0), F.lit(n_shards - 1)),
            lambda j: F.floor(F.col("total") / n_shards) + F.when(j < F.col("total") % n_shards, 1).otherwise(0),
        ).alias("sizes"),
    )
    nodes = root
    for depth in range(max(1, n_partitions - 1).bit_length() + 1):
        if depth == TREE_HEAD:
            nodes = nodes.repartition(F.get("parts.part", F.lit(0)))
        half = F.floor(F.size("parts") / 2).cast("int")
        left = F.slice("parts", F.lit(1), half)
        share = _left_share(F.col("sizes"), _sum(F.transform(left, lambda p: p["n"])), _sum(F.col("sizes")), F.get("parts.part", half), seed)
        split = nodes.withColumn("share", F.when(half > 0, share)).withColumn("half", half)
        children = F.when(
            F.col("half") > 0,
            F.array(
                F.struct(F.slice("parts", F.lit(1), F.col("half")).alias("parts"), F.col("share").alias("sizes")),
                F.struct(
                    F.slice("parts", F.col("half") + 1, F.size("parts")).alias("parts"),
                    F.zip_with("sizes", "share", lambda a, b: a - b).alias("sizes"),
                ),
            ),
        ).otherwise(F.array(F.struct("parts", "sizes")))
        nodes = split.select(F.inline(children))
    ends = F.transform(
        F.sequence(F.lit(1), F.size("sizes")), lambda j: _sum(F.slice("sizes", F.lit(1), j))
    )
    return nodes.select(F.get("parts.part", F.lit(0)).alias("part"), ends.alias("ends"))


def shuffle_rows(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of a table with `shard` and `slot`, every deal of them equally likely.

    Shard sizes differ by one at most, the first shards have the longer ones; slots
    of a shard count from 0 without gaps. Equal rows are rows of their own, each
    dealt independently; nulls and any column may repeat. The columns `shard` and
    `slot` of the input are replaced. An empty table gives an empty one.

    The rows are written once, locally permuted, in the shared folder, and moved
    once. A lost executor repeats its tasks with the same outcome. The same files,
    seed and split sizes give the same deal; another layout gives another one.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    inner = [f"c{i}" for i in range(len(columns))]
    plain = rows.select(*[rows[c].alias(i) for c, i in zip(columns, inner)])
    local = plain.withColumn("r", F.rand(seed)).sortWithinPartitions("r").drop("r")
    local = local.withColumn("id", F.monotonically_increasing_id())
    placed = local.select(
        *inner, F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    )
    placed = session.cut_lineage(placed)
    counts = session.cut_lineage(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    known = counts.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows")).first()
    n_buckets = max(1, -(-(known["rows"] or 0) // (n_shards * bucket_rows)))
    matrix = session.cut_lineage(communication_matrix(counts, n_shards, known["parts"], seed))

    shard = F.size(F.filter("ends", lambda e: e <= F.col("place")))
    order = F.xxhash64(F.lit(seed + 1), "part", "place")
    # the bucket is the leading part of the order, so buckets follow one another
    bucket = F.shiftright(F.shiftrightunsigned(order, 32) * n_buckets, 32)

    def dealt(of: DataFrame) -> DataFrame:
        d = of.join(matrix, "part").withColumn("shard", shard).withColumn("order", order)
        return d.withColumn("bucket", bucket).drop("ends")

    sums = dealt(placed.select("part", "place")).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    unsigned = F.col("order").bitwiseXOR(F.lit(-(1 << 63)))
    inside = Window.partitionBy("shard", "bucket").orderBy(unsigned, "part", "place")
    out = dealt(placed).withColumn("inner", F.row_number().over(inside) - 1).join(sums, ["shard", "bucket"])
    return out.select(
        *[F.col(i).alias(c) for c, i in zip(columns, inner)], "shard", (F.col("base") + F.col("inner")).cast("long").alias("slot")
    )


def shard_report(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per document.

    The law is `rows`: counts of shards differ by one at most. A null text has no
    bytes: size 1, crc32 0. Equal texts aren't kept together; a uniform shuffle
    deals each row by itself. `grown_shard` is null: a further shard would deal
    all rows anew.
    """
    d = common.only(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    sized = d.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_rows(sized, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
