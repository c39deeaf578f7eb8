"""Near duplicates by bottom-k sketches of one hash function.

A document keeps the k smallest hashes of its distinct shingles. The retained
values, inverted into lists, generate overlaps: documents of Jaccard similarity
t share at least `least_overlap` retained values, so it is enough to list each
document under its rarest ones (the prefix principle: with s values, s - c + 1
of them, in the one order by frequency). A passage that a third of the corpus
shares is frequent and thus falls out of the prefixes. The sketch of the union
estimates the similarity; pairs above the confidence bound are verified on the
full sets.

Equal sets are one class before anything is paired. The listed documents' full
sets get the same prefix rule exactly: with its shingles in order of frequency, a
document of n meets its partners among the first n - t n + 1, and a pair that
first meets where a and b have oa and ob rarer ones shares none of these. Within
a list, documents are first linked with the one that has the fewest rarer
shingles (the original of a family of edited copies); only members that the
verified links leave in different components are then paired with each other,
under the same exact bound. So a tight group of n copies costs n comparisons and
no link between components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common
from quarrylens.llm.components import connected_components

SKETCH = 64
DEVIATIONS = 5.0


def least_overlap(threshold: float, k: int = SKETCH) -> int:
    """Retained values that a pair at the threshold shares but for a chance of
    about 3 in 10 million (five standard deviations below the mean)."""
    return max(1, math.floor(k * threshold - DEVIATIONS * math.sqrt(k * threshold * (1 - threshold))))


def _required(n: Column, num: int, den: int, k: int) -> Column:
    """Overlap each document can insist on: exact while no partner's set is cut."""
    whole = F.ceil(n * num / den)
    return F.when(n * den <= k * num, whole).otherwise(F.lit(least_overlap(num / den, k))).cast("int")


def sketches(docs: DataFrame, n_words: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, the digest of the set (d1, d2) and its k smallest hashes."""
    d = common.only(docs, "doc_id", "text")
    d = d.select("doc_id", common.words(common.ascii_lower(F.col("text"))).alias("w"))
    d = d.select("doc_id", F.sort_array(F.array_distinct(common.shingle_hashes("w", n_words))).alias("h"))
    return d.select(
        "doc_id", F.size("h").cast("long").alias("n_shingles"),
        F.xxhash64("h").alias("d1"), F.xxhash64(F.lit(1), "h").alias("d2"),
        F.slice("h", 1, k).alias("sketch"),
    )


def _lists(reps: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(v, id, n): each class under those of its rarest retained values that
    some other class retains too."""
    held = reps.select("id", "n", "d1", F.explode("sketch").alias("v"))
    frequent = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = held.join(frequent, "v").groupBy("id", "n", "d1").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    kept = F.least(F.col("n"), F.lit(k)).cast("int")
    prefix = kept - _required(F.col("n"), num, den, k) + 1
    left = F.greatest(prefix - (kept - F.size("vs")), F.lit(0))
    listed = shared.select("id", "n", F.explode(F.slice("vs", F.lit(1), left)).alias("e"))
    return listed.select("id", "n", F.col("e.v").alias("v"))


def _ids(pairs: DataFrame) -> DataFrame:
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return session.cut_lineage(ids.distinct())


def _verified(pairs: DataFrame, reps: DataFrame, sets: Callable, num: int, den: int, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch lets them through and whose full sets agree."""
    pairs = session.cut_lineage(pairs.select("a", "b").distinct())
    sk = common.those(reps.select("id", "sketch"), _ids(pairs))
    p = (
        pairs.join(sk.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sk.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    )
    p = p.withColumn("u", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k))
    p = p.withColumn("x", F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")))
    whole = F.size("u") < k
    enough = F.when(whole, F.col("x") * den >= F.size("u") * num).otherwise(F.col("x") >= least_overlap(num / den, k))
    p = session.cut_lineage(p.where(enough).select("a", "b").distinct())
    full = sets(_ids(p))
    q = (
        p.join(full.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a")
        .join(full.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    )
    q = q.withColumn("x", F.size(F.array_intersect("ha", "hb")).cast("long"))
    q = q.where(F.col("x") * den >= (F.size("ha") + F.size("hb") - F.col("x")) * num)
    return session.cut_lineage(q.select("a", "b"))


def _prefixes(full: DataFrame, num: int, den: int) -> DataFrame:
    """(v, id, n, o): each document of `full` under those of its rarest shingles
    that some other of them has too; o of its n shingles are rarer than v."""
    # beside explode these would be computed anew for each of its rows
    held = full.select("id", F.xxhash64("h").alias("set"), F.size("h").alias("n"), "h")
    held = held.select("id", "set", "n", F.explode_outer("h").alias("v"))
    frequent = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = held.join(frequent, "v").groupBy("id", "set", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    own = F.col("n") - F.size("vs")
    left = F.greatest(F.col("n") - F.ceil(F.col("n") * num / den) + 1 - own, F.lit(0)).cast("int")
    e = shared.select("id", "n", own.alias("own"), F.posexplode(F.slice("vs", F.lit(1), left)).alias("at", "e"))
    return e.select(F.col("e.v").alias("v"), "id", "n", (F.col("own") + F.col("at")).alias("o"))


def _may_link(num: int, den: int) -> Column:
    """Whether a (na, oa) and b (nb, ob) can reach num / den without their rarer shingles."""
    most = F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
    return most * den >= (F.col("na") + F.col("nb") - most) * num


def _named(lists: DataFrame, end: str) -> list[Column]:
    return [F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("o").alias(f"o{end}")]


def _stars(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Each member of a list with the one that has the fewest rarer shingles."""
    leaders = lists.groupBy("v").agg(F.min(F.struct("o", "id", "n")).alias("m")).select("v", "m.*")
    pairs = lists.select("v", *_named(lists, "b")).join(leaders.select("v", *_named(leaders, "a")), "v")
    return pairs.where("a <> b").where(_may_link(num, den))


def _crossing(lists: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a list that lie in different components and may yet be linked."""
    placed = lists.join(labels, lists["id"] == labels["node"], "left").withColumn("c", F.coalesce("component", "id"))
    open_lists = placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v")
    placed = session.cut_lineage(placed.join(open_lists, "v").select("v", "id", "n", "o", "c"))
    both = placed.select("v", *_named(placed, "a"), F.col("c").alias("ca")).join(
        placed.select("v", *_named(placed, "b"), F.col("c").alias("cb")), "v"
    )
    return both.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _may_link(num, den))


def near_duplicates(
    docs: DataFrame, n_words: int = 5, num: int = 4, den: int = 5, k: int = SKETCH
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs`.

    Shingles are `n_words` words long; documents link where their sets' Jaccard
    similarity is at least num / den. Null, empty and blank texts have empty
    sets and link with nothing. Rows that repeat a doc_id are one node. A null
    doc_id links with nothing, has no component and is not kept. Other columns
    of `docs` are not read.
    """
    table = session.cut_lineage(sketches(docs, n_words, k))
    filled = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    reps = session.cut_lineage(
        filled.join(classes, ["d1", "d2"]).where("doc_id = id")
        .select("id", F.col("n_shingles").alias("n"), "d1", "d2", "sketch").dropDuplicates(["id", "d1", "d2"])
    )
    lists = _lists(reps, num, den, k)

    def sets(ids: DataFrame) -> DataFrame:
        few = common.only(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
        few = common.those(few, ids).select("id", common.words(common.ascii_lower(F.col("text"))).alias("w"))
        return few.select("id", F.array_distinct(common.shingle_hashes("w", n_words)).alias("h"))

    lists = session.cut_lineage(_prefixes(sets(session.cut_lineage(lists.select("id").distinct())), num, den))
    links = _verified(_stars(lists, num, den), reps, sets, num, den, k)
    crossing = _crossing(lists, connected_components(links), num, den)
    links = links.union(_verified(crossing, reps, sets, num, den, k))
    labels = connected_components(links)
    member = table.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    member = member.withColumn("id", F.when(F.col("n_shingles") > 0, F.col("id")).otherwise(F.col("doc_id")))
    out = member.join(labels, member["id"] == labels["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
