"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """Runs of characters other than blanks; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def shingle_hashes(words_col: str, n: int) -> Column:
    """Hash of each run of n words, by position; of the whole sequence where it
    is shorter; none for no words."""
    parts = ", ".join(f"get(`{words_col}`, i + {k})" for k in range(n))
    return F.expr(
        f"CASE WHEN size(`{words_col}`) = 0 THEN cast(array() AS array<bigint>) ELSE "
        f"transform(sequence(0, greatest(size(`{words_col}`) - {n}, 0)), i -> xxhash64({parts})) END"
    )


def held_out(doc_id: Column) -> Column:
    """The fold that no learner may see: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads; whatever else the table holds can't clash."""
    return df.select(*[df[n] for n in names])


#: Rows of ids and the like that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def if_bounded(written: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if it is of bounded size, which
    leaves the texts it is joined to in place."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def those(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` (id and others) whose id is among `ids`, a written table of
    distinct ids."""
    return docs.join(if_bounded(ids), "id", "left_semi")
