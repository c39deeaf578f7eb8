"""Periodic runs of words: stretches that repeat with a short period.

Dictionary of basic factors. Level by level the factors of 1, 2, 4, ... words
get names, each from the pair of names of its halves. Of every factor the
successor, its next occurrence in the document, is looked up within twice the
factor's length. Positions i, i + 1, ... whose successors lie at one distance d
propose period d.

With L the least power of two that is at least d, a stretch of length 3 d or
more shows its period at level L: d + L < 3 d, so one factor of L words and its
copy d further lie inside, and no copy is nearer, or both distances would divide
the stretch into a smaller period. Conversely, the positions of one distance d
with L / 2 < d <= L extend from the first word of a maximal stretch to L + d
words before its end. So each run is proposed once, at one level, with its
whole extent and its smallest period.

A factor that occurs once in its document has no successor at any later level;
its position is left out there, which leaves little to name in most texts.
Documents are independent rows. A text is read whole by one task: its words
are a few arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from quarrylens.llm import common

LEAST_WORDS = 24
LEAST_REPEATS = 3
#: Words that are worked on at once; one longer text is a part of its own.
PART_WORDS = 1_000_000

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def find_runs(
    words: np.ndarray, doc: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, length and period of every run, by position, then period.

    `words` are numbers of words, `doc` the ascending numbers of their documents;
    positions count over all of them, and no run leaves its document.
    """
    n = len(words)
    name = np.empty(n, np.int64)
    at = np.arange(n)
    key = doc * (int(words.max(initial=0)) + 1) + words
    found, length = [], 1
    while len(at):
        order = np.argsort(key, kind="stable")
        key, pos = key[order], at[order]
        same = key[1:] == key[:-1]
        gap = pos[1:] - pos[:-1]
        near = np.flatnonzero(same & (gap <= length) & (2 * gap > length))
        if len(near):
            first, period = pos[near], gap[near]
            by = np.lexsort((first, period))
            first, period = first[by], period[by]
            begins = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (first[1:] != first[:-1] + 1)])
            ends = np.r_[begins[1:], len(first)] - 1
            reach = first[ends] - first[begins] + length + period[begins]
            kept = reach >= np.maximum(least_words, least_repeats * period[begins])
            found.append((first[begins][kept], reach[kept], period[begins][kept]))
        recurs = np.zeros(len(pos), bool)
        recurs[1:] |= same
        recurs[:-1] |= same
        number = np.r_[0, np.cumsum(~same)]
        name.fill(-1)
        name[pos[recurs]] = number[recurs]
        at = np.sort(pos[recurs])
        at = at[at + length < n]
        at = at[(name[at + length] >= 0) & (doc[at] == doc[at + length])]
        key = name[at] * (int(number[-1]) + 1) + name[at + length]
        length *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, reach, period = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((period, start))
    return start[by], reach[by], period[by]


def _parts(texts: Sequence[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in parts of bounded size."""
    part, size = [], 0
    for text in texts:
        words = (text or b"").split()  # splits exactly at \x20 and \x09-\x0D
        if part and size + len(words) > PART_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def _runs_of(part: list[list[bytes]], least_words: int, least_repeats: int) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Runs of each text, all runs with positions in their text, and the texts without repeats."""
    sizes = np.array([len(w) for w in part], np.int64)
    base = np.r_[0, np.cumsum(sizes)]
    flat = [w for words in part for w in words]
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    doc = np.repeat(np.arange(len(part)), sizes)
    numbers = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    start, reach, period = find_runs(numbers, doc, least_words, least_repeats)
    owner = doc[start]
    counts = np.bincount(owner, minlength=len(part))
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + reach, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    texts = []
    for i, words in enumerate(part):
        if counts[i]:
            words = [w for w, gone in zip(words, dropped[base[i] : base[i + 1]]) if not gone]
        texts.append(b" ".join(words))
    return counts.tolist(), np.stack([start - base[owner], reach, period]), texts


def periodic_runs(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
    least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS,
) -> DataFrame:
    """The columns `keep`, `runs` and `collapsed`, one row per row of `docs`.

    `runs` are the (start, length, period) of the maximal stretches of at least
    `least_words` words and `least_repeats` periods, by start, then period; words
    count from 0 between blanks. `collapsed` has the words joined by one space,
    of each run only those of its first period (a word goes if any run repeats it).

    Null, empty and blank texts have no runs and an empty `collapsed`. A text
    of any length is read whole. Rows that repeat, null ids and further columns
    are of no account: each row stands by itself. An empty table gives none.
    """
    if least_repeats < 3:
        raise ValueError("a period shows itself from three repeats on")
    given = docs.select(*[docs[c] for c in keep], docs[text].cast("binary").alias("__text"))
    kept = [f for f in given.schema.fields if f.name != "__text"]
    schema = T.StructType([*kept, T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.BinaryType())])
    listed = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for part in _parts(batch.column("__text").to_pylist()):
                counts, runs, texts = _runs_of(part, least_words, least_repeats)
                ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                fields = [pa.array(column, pa.int64()) for column in runs]
                own = batch.slice(row, len(part))
                row += len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[own.column(f.name) for f in kept],
                        pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(listed.value_type))),
                        pa.array(texts, pa.binary()),
                    ],
                    names=[f.name for f in schema.fields],
                )

    found = given.mapInArrow(work, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from some word on.

    With h the crc32 of the id and g = h div 10, rows of h mod 10 = 0 repeat the
    p = 1 + (n - a) div (3 + g mod 8) words from a = g mod n on, to the end.
    Rows without an id or a word stay as they are.
    """
    d = common.only(docs, "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, common.words(F.col("text")))
    d = d.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w"))

    def repeated(w: Column, n: Column, g: Column) -> Column:
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat(
            F.slice(w, F.lit(1), a),
            F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a),
        )

    made = F.array_join(repeated(F.col("w"), F.size("w"), F.col("g")), " ")
    return d.select("doc_id", F.when(F.size("w") > 0, made).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent and digests, of the
    planted texts of `documents`."""
    found = periodic_runs(planted(docs))

    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    # runs come by start, then period: the first of equal exponents stays
    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period",
        F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
