"""Mix sources to target weights in fixed-length blocks of words.

The words of a source, documents one after the other, are cut into blocks of
`block_words`. Each output shard draws its source counts from a multinomial;
what the draws leave of a source's slots is dealt out in closing shards, so a
source gets its slots exactly. Slot i of a source lies in epoch i div n, at
place i mod n of that epoch's pseudorandom permutation of the n whole blocks
(a keyed Feistel network, walked until it falls inside), and the rest block
ends the epoch. Blocks join slots by (source, index), so a source with a third
of all words is as many small groups as it has blocks.

Offsets are prefix sums in three levels (hash buckets of a source, equal
documents of one input task, rows), so no source and no group of copies is sorted
in one task. Documents lie in the order of a hash of id and text, so the mix is the
same whatever files or tasks the rows come in. Draws go down a tree over the sources:
a shard's slots fall on the TOP nodes at most that the driver lists, then on the FAN
children of each node at most, so any number of sources is drawn alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 256
SHARD_SLOTS = 1024
BUCKET_DOCS = 20_000
#: Nodes of the draw's tree that the driver lists, and children of a node below them.
TOP = 4096
FAN = 64
#: Neighbouring shards summed first in the prefix sums over a source's shards.
RUN_SHARDS = 4096


def source_targets(sized: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_no, source_size, target: one row per source.

    Water level: sources fill up in the order of cap by weight; the level is
    that of the first source in this order that its share doesn't fill.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("source_no", F.row_number().over(order).cast("long") - 1)
    s = s.withColumn("w", F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS)).cast("int")).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("full_at", F.col("cap") / F.col("w"))
    filling = Window.orderBy("full_at", "source_no")
    everyone = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("due", F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.col("due") / F.col("open"))
    s = s.withColumn(
        "level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(everyone)["level"]
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return s.select("source", "source_no", "source_size", target.alias("target"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """Row key, hash of id and text, doc_id, source and words of each document.
    The row key tells rows apart; only between equal rows does it decide an order."""
    d = common.only(docs, "doc_id", "source", "text")
    return d.select(
        F.monotonically_increasing_id().alias("row_no"), F.xxhash64("doc_id", "text").alias("own"), "doc_id", "source",
        common.words(F.col("text")).alias("w"),
    ).withColumn("size", F.size("w").cast("long"))


def _before(df: DataFrame, group: list[str], order: list[str], n: str) -> Column:
    """Sum of `n` over the rows of the group ahead of each row."""
    ahead = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(df[n]).over(ahead), F.lit(0))


def _offsets(sized: DataFrame, n_rows: int) -> DataFrame:
    """sized plus `start`, the first word of a document within its source; rows
    without words have none."""
    n_buckets = max(1, -(-n_rows // BUCKET_DOCS))
    d = sized.withColumn("bucket", F.pmod("own", F.lit(n_buckets))).withColumn("task", F.shiftright("row_no", 33))
    filled = d.where("size > 0")
    equal = ["source_no", "bucket", "own", "task"]
    copies = filled.groupBy(*equal).agg(F.sum("size").alias("n"))
    sums = copies.groupBy("source_no", "bucket").agg(F.sum("n").alias("n"))
    sums = sums.select("source_no", "bucket", _before(sums, ["source_no"], ["bucket"], "n").alias("base"))
    copies = copies.select(*equal, _before(copies, ["source_no", "bucket"], ["own", "task"], "n").alias("upto"))
    filled = filled.withColumn("inner", _before(filled, equal, ["row_no"], "size"))
    starts = filled.join(copies, equal).join(sums, ["source_no", "bucket"])
    starts = starts.withColumn("start", F.col("base") + F.col("upto") + F.col("inner"))
    none = d.where("size = 0").withColumn("start", F.lit(None).cast("long"))
    return starts.select(*sized.columns, "start").unionByName(none.select(*sized.columns, "start"))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place i of a keyed permutation of 0..n-1, for each row its own n and key."""
    half = np.ceil(np.log2(np.maximum(n, 4)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = place.astype(np.uint64), np.arange(len(place))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (_mix64(right + k + np.uint64(r << 56)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _block_of(seed: int):
    @F.pandas_udf("long")
    def block(place: pd.Series, whole: pd.Series, source_no: pd.Series, epoch: pd.Series) -> pd.Series:
        i, n = place.to_numpy(np.int64), whole.to_numpy(np.int64)
        key = _mix64((source_no.to_numpy(np.int64) * 1_000_003 + epoch.to_numpy(np.int64) * 7919 + seed).astype(np.uint64))
        out = i.copy()
        inside = i < n
        out[inside] = permuted(i[inside], n[inside], key[inside])
        return pd.Series(out)

    return block


def _draws(slots: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """shard, source_no, drawn: multinomial counts of every shard in proportion
    to the sources' slots; and the number of shards.

    A level of the tree holds the slots of `source_no div FAN`, and so on up to
    at most TOP nodes. A multinomial over the nodes, then one over the children
    of each node, is the multinomial over the sources.
    """
    spark = slots.sparkSession
    level = slots.select(F.col("source_no").alias("node"), "slots")
    width, lower = (level.agg(F.max("node")).head()[0] or 0) + 1, []
    while width > TOP:
        kids = level.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(
            F.sum("slots").alias("slots"), F.sort_array(F.collect_list(F.struct(F.col("node").alias("no"), "slots"))).alias("kids")
        )
        kids = session.cut_lineage(kids)
        lower.append(kids.select("node", "kids"))
        level, width = kids.select("node", "slots"), -(-width // FAN)
    rows = level.orderBy("node").collect()  # TOP at most
    numbers = np.array([r["node"] for r in rows], np.int64)
    weights = np.array([r["slots"] for r in rows], np.float64)
    total = int(sum(r["slots"] for r in rows))
    n_shards = -(-total // shard_slots)

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                size = min(shard_slots, total - shard * shard_slots)
                got = np.random.default_rng([seed, shard]).multinomial(size, weights / weights.sum())
                yield pd.DataFrame({"shard": shard, "node": numbers[got > 0], "drawn": got[got > 0]})

    def split(depth: int):
        def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                shard, node, drawn = [], [], []
                for row in pdf.itertuples():
                    share = np.array([kid["slots"] for kid in row.kids], np.float64)
                    got = np.random.default_rng([seed, row.shard, depth, row.node]).multinomial(row.drawn, share / share.sum())
                    for i in np.flatnonzero(got):
                        shard.append(row.shard), node.append(row.kids[i]["no"]), drawn.append(got[i])
                yield pd.DataFrame({"shard": shard, "node": node, "drawn": drawn}, dtype=np.int64)

        return below

    shape = "shard long, node long, drawn long"
    drawn = spark.range(n_shards).mapInPandas(draws, shape)
    for depth, kids in reversed(list(enumerate(lower, 1))):
        drawn = drawn.join(kids, "node").select("shard", "node", "drawn", "kids").mapInPandas(split(depth), shape)
    return drawn.withColumnRenamed("node", "source_no"), n_shards


def draw_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, source_no, epoch, block, words: every slot of the mix.

    `words` is the block's length, less in the last slot of a source.
    """
    t = targets.where("source_size > 0").withColumn("due", F.floor("target"))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words)).withColumn("whole", F.floor(F.col("source_size") / block_words))
    t = t.withColumn("epochs", F.floor(F.col("due") / F.col("source_size")))
    t = t.withColumn("slots", F.col("epochs") * F.col("n_blocks") + F.ceil((F.col("due") - F.col("epochs") * F.col("source_size")) / block_words))
    drawn, n_shards = _draws(t.select("source_no", "slots"), shard_slots, seed)
    drawn = session.cut_lineage(drawn.withColumn("run", F.expr(f"shard div {RUN_SHARDS}")))
    runs = drawn.groupBy("source_no", "run").agg(F.sum("drawn").alias("n"))
    runs = runs.select("source_no", "run", _before(runs, ["source_no"], ["run"], "n").alias("base"))
    first = F.col("base") + _before(drawn, ["source_no", "run"], ["shard"], "drawn")
    placed = drawn.groupBy("source_no").agg(F.sum("drawn").alias("placed"))
    drawn = drawn.join(runs, ["source_no", "run"]).join(t.select("source_no", "slots"), "source_no").withColumn("first", first)
    drawn = drawn.select("shard", "source_no", "first", F.least(F.col("drawn"), F.col("slots") - F.col("first")).alias("n")).where("n > 0")
    rest = t.join(placed, "source_no", "left").select("source_no", F.coalesce("placed", F.lit(0)).alias("placed"), "slots").where("placed < slots")
    rest = rest.withColumn("first", F.explode(F.expr(f"sequence(placed, slots - 1, {shard_slots})")))
    rest = rest.select(
        (F.lit(n_shards) + F.floor((F.col("first") - F.col("placed")) / shard_slots)).alias("shard"), "source_no", "first",
        F.least(F.lit(shard_slots), F.col("slots") - F.col("first")).alias("n"),
    )
    s = drawn.union(rest).join(t, "source_no")
    s = s.withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    s = s.withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks"))).withColumn("place", F.col("slot") % F.col("n_blocks"))
    s = s.withColumn("block", _block_of(seed)("place", "whole", "source_no", "epoch"))
    left = F.col("due") - F.col("epoch") * F.col("source_size") - F.col("place") * block_words
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    return s.select("shard", "slot", "source_no", "epoch", "block", F.least(length, left).alias("words"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """Each document under the blocks that it lies in, with the words from..to of
    the source that are its own there."""
    first, last = f"start div {block_words}", f"(start + size - 1) div {block_words}"
    p = placed.withColumn("block", F.explode_outer(F.expr(f"CASE WHEN size > 0 THEN sequence({first}, {last}) END")))
    return p.withColumn("from", F.greatest("start", F.col("block") * block_words)).withColumn(
        "to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    )


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sized = session.cut_lineage(sized_documents(docs).drop("w"))
    targets = session.cut_lineage(source_targets(sized))
    numbered = sized.join(targets.select("source", "source_no"), sized["source"].eqNullSafe(targets["source"])).select(
        "row_no", "own", "doc_id", "size", "source_no"
    )
    return _offsets(numbered, sized.count()), targets


def mix_report(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of `docs`.

    Null and blank texts have size 0 and nothing taken; a null source is one
    source, after the others; rows that repeat an id are documents of their
    own. The same rows and seed give the same mix in whatever files they lie.
    """
    placed, targets = _prepared(docs)
    slots = draw_slots(targets, block_words, shard_slots, seed)
    uses = slots.groupBy("source_no", "block").agg(F.collect_list("words").alias("uses"))  # as many as epochs
    pieces = _pieces(placed, block_words).join(uses, ["source_no", "block"], "left")
    used = F.aggregate(
        F.coalesce("uses", F.array().cast("array<long>")), F.lit(0).cast("long"),
        lambda acc, w: acc + F.greatest(
            F.lit(0).cast("long"), F.least(F.col("to"), F.col("block") * block_words + w) - F.col("from")
        ),
    )
    sums = pieces.groupBy("row_no", "doc_id", "source_no", "size").agg(F.sum(used).alias("taken"))
    return sums.join(targets, "source_no").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_blocks(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42
) -> DataFrame:
    """The mix itself: shard, slot, source, text of every slot, words joined by
    one space. A block's text is at most `block_words` words, whatever its documents.
    """
    sized = session.cut_lineage(sized_documents(docs))
    targets = session.cut_lineage(source_targets(sized))
    placed = sized.join(targets.select(F.col("source").alias("s"), "source_no"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    offsets = _offsets(placed.drop("w"), sized.count()).select("row_no", "start")
    pieces = _pieces(placed.join(offsets, "row_no"), block_words).where("size > 0")
    pieces = pieces.select("source_no", "block", "from", F.expr("slice(w, cast(`from` - start + 1 AS int), cast(`to` - `from` AS int))").alias("w"))
    blocks = pieces.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("from", "w"))).alias("p"))
    blocks = blocks.select("source_no", "block", F.flatten("p.w").alias("w"))
    slots = draw_slots(targets, block_words, shard_slots, seed)
    out = slots.join(blocks, ["source_no", "block"]).join(targets.select("source_no", "source"), "source_no")
    return out.select("shard", "slot", "source", F.array_join(F.expr("slice(w, 1, cast(words AS int))"), " ").alias("text"))
