"""Repair of conversation structure at the least cost.

A sound conversation is empty, or an optional system turn followed by pairs of
user and assistant turns. Weighted CYK interval parsing: the grammar has a
nonterminal X[p, q] for every way (p, q) through the states

    0 start, 1 after the system turn, 2 after a user turn, 3 after a pair

with the binary rules X[p, q] -> X[p, r] X[r, q], the terminal rules of a turn
(keep, rerole, delete) and the closure of the insertions before and after it.
A span of turns has one cell per nonterminal: the least (cost, audit), the audit
having one letter for each edit in order. Two audits of one span and one cost never
extend each other (the letters fix the cost), so the least of both parts is the
least of the whole. Since the nonterminals name all states a split can have, any
split of a span gives its cells: spans of 1, 2, 4, ... turns are combined bottom-up.

Conversations are cut where the range partitions of the sorted turns end, each
piece is parsed by its own task, and the few pieces of a conversation are combined
by the same rules: a conversation with a third of all turns is many pieces.
Only digests of texts take part in the parse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: Moves of the automaton: the role initial that leads from one state to another.
MOVES = {(0, 1): "s", (0, 2): "u", (1, 2): "u", (3, 2): "u", (2, 3): "a"}
#: Turns of the spans whose cells are remembered.
SHORT = 8
#: Sub-groups of one repeated turn, so that its first occurrence is sought by several tasks.
SALTS = 64
BATCH_ROWS = 5_000

Cells = dict[tuple[int, int], tuple[int, str]]


def product(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                cell = (cost + other[0], audit + other[1])
                if (p, q) not in out or cell < out[p, q]:
                    out[p, q] = cell
    return out


def _insertions() -> Cells:
    cells: Cells = {(p, p): (0, "") for p in range(4)}
    once = cells | {edge: (INSERT, "I") for edge, initial in MOVES.items() if initial != "s"}
    for _ in range(3):
        cells = product(cells, once)
    return cells


INSERTIONS = _insertions()


@lru_cache(maxsize=64)
def turn_cells(symbol: str) -> Cells:
    """Cells of one turn: its role initial (o: another), in capitals if its text is
    truncated; x if it must go."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        for edge, initial in MOVES.items():
            if initial == symbol.lower():
                cells[edge] = (KEEP + more, "K")
            elif initial != "s":
                cells[edge] = (REROLE + more, "R")
    return product(product(INSERTIONS, cells), INSERTIONS)


def combined(spans: list[Cells]) -> Cells:
    """Cells of neighbouring spans together, pair by pair, by growing length."""
    while len(spans) > 1:
        pairs = [product(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[2 * len(pairs) :]
    return spans[0]


@lru_cache(maxsize=1 << 16)
def _short_cells(symbols: str) -> Cells:
    return combined([turn_cells(s) for s in symbols])


def span_cells(symbols: str) -> Cells:
    return combined([_short_cells(symbols[i : i + SHORT]) for i in range(0, len(symbols), SHORT)])


def best(cells: Cells) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation: from the start to a state that may end it."""
    return min(cells[0, q] for q in (0, 3) if (0, q) in cells)


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and a digest of both."""
    t = common.only(turns, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    t = t.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return t.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256))


def _entries(turns: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text): initial, faults, copies,
    and whether it is the first of its role and text."""
    shown = F.btrim("text", F.lit(common.BLANKS))
    t = turns.select(
        "conv_id", "turn", "role", "digest", (shown == "").alias("blank"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    e = t.groupBy("conv_id", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")
    )
    spread = F.xxhash64("turn")
    here = Window.partitionBy("conv_id", "digest", F.pmod(spread, F.lit(SALTS))).orderBy(F.col("turn").asc_nulls_first())
    e = e.withColumn("leads", F.row_number().over(here) == 1)
    # the leaders of the sub-groups meet, at most SALTS of them; all others stay spread
    among = Window.partitionBy("conv_id", "digest", F.when(~F.col("leads"), spread)).orderBy(F.col("turn").asc_nulls_first())
    return e.withColumn("first", F.col("leads") & (F.row_number().over(among) == 1)).drop("leads")


SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
LEGAL = ("su", "ua", "au")


def _piece_schema(conv_id: T.StructField) -> T.StructType:
    cell = T.StructType(
        [T.StructField(n, t) for n, t in (("p", T.IntegerType()), ("q", T.IntegerType()), ("cost", T.LongType()), ("audit", T.StringType()))]
    )
    return T.StructType(
        [
            T.StructField("conv_id", conv_id.dataType), T.StructField("part", T.IntegerType()),
            *[T.StructField(n, T.LongType()) for n in (*SUMS, "first_turn", "last_turn")],
            T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()),
            T.StructField("cells", T.ArrayType(cell)),
        ]
    )


def _report_schema(conv_id: T.StructField) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return T.StructType([T.StructField("conv_id", conv_id.dataType), *longs, T.StructField("audit", T.StringType())])


def _in_batches(rows: Iterable[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    shape, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, shape)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, shape)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield from batch.slice(at, BATCH_ROWS).to_pylist()


class _Piece:
    """The turns of one conversation that lie in one partition."""

    def __init__(self, conv_id: object, part: int):
        self.row = {"conv_id": conv_id, "part": part, **dict.fromkeys(SUMS, 0)}
        self.row |= dict.fromkeys(("first_turn", "last_turn", "first_initial", "last_initial"))
        self.symbols: list[str] = []

    def add(self, e: dict) -> None:
        row, copies, initial = self.row, e["copies"], e["role"][:1]
        if e["turn"] is not None:
            row["turns"] += row["last_turn"] != e["turn"]
            row["last_turn"] = e["turn"]
            if row["first_turn"] is None:
                row["first_turn"] = e["turn"]
        row["illegal"] += copies - 1  # copies of one turn are neighbours of one role
        if row["first_initial"] is None:
            row["first_initial"] = initial
        else:
            row["illegal"] += row["last_initial"] + initial not in LEGAL
        row["last_initial"] = initial
        if e["blank"]:
            row["blank"] += copies
            self.symbols.append("x" * copies)
            return
        row["duplicate"] += copies - e["first"]
        if e["first"]:
            row["truncated"] += e["truncated"]
            symbol = initial if initial and initial in "sua" else "o"
            self.symbols.append(symbol.upper() if e["truncated"] else symbol)
        self.symbols.append("x" * (copies - e["first"]))

    def done(self) -> dict:
        cells = span_cells("".join(self.symbols))
        return self.row | {"cells": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()]}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    piece = None
    for e in _rows(batches):
        if piece is None or piece.row["conv_id"] != e["conv_id"]:
            if piece is not None:
                yield piece.done()
            piece = _Piece(e["conv_id"], e["part"])
        piece.add(e)
    if piece is not None:
        yield piece.done()


def _report(pieces: list[dict]) -> dict:
    """One conversation from its pieces, in order: as many as partitions hold turns of it."""
    out = {n: sum(p[n] for p in pieces) for n in SUMS}
    first = last = None
    for a, b in zip(pieces, pieces[1:]):
        out["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    for p in pieces:
        if p["first_turn"] is not None:
            out["turns"] -= last == p["first_turn"]
            first, last = p["first_turn"] if first is None else first, p["last_turn"]
    cost, audit = best(combined([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in p["cells"]} for p in pieces]))
    gaps = 0 if first is None else last - first + 1 - out["turns"]
    return {"conv_id": pieces[0]["conv_id"], "gaps": gaps, "cost": cost, "audit": audit} | {n: out[n] for n in SUMS[:4]}


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    held: list[dict] = []
    for piece in _rows(batches):
        if held and held[0]["conv_id"] != piece["conv_id"]:
            yield _report(held)
            held = []
        held.append(piece)
    if held:
        yield _report(held)


def parse_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per
    conversation that has turns.

    Turns are taken by number, nulls first, those of one number by role and text
    digest; a null role or text is one space, a null conv_id one conversation. Equal
    rows are turns of their own. Further columns are not read; an empty table gives
    no rows. Texts of any length enter as digest and flags.
    """
    entries = _entries(_turns(turns))
    order = ["conv_id", "turn", "role", "digest"]
    placed = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    conv_id = placed.schema["conv_id"]
    piece, report = _piece_schema(conv_id), _report_schema(conv_id)
    pieces = placed.mapInArrow(lambda batches: _in_batches(_pieces(batches), piece), piece)
    gathered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return gathered.mapInArrow(lambda batches: _in_batches(_reports(batches), report), report)


def _next_state(state: int, edit: str, role: str) -> tuple[int, str]:
    """State and role after an edit that leaves a turn."""
    if edit == "K":
        initial = role[:1]
        return {"s": 1, "u": 2, "a": 3}[initial], role
    return (3, "assistant") if state == 2 else (2, "user")


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    conv_id, audit, at, state, seq = None, "", 0, 0, 0

    def left(edit: str, role: str, text: str) -> dict:
        nonlocal state, seq
        state, new_role = _next_state(state, edit, role)
        seq += 1
        return {"conv_id": conv_id, "seq": seq - 1, "role": new_role, "text": text, "edit": edit}

    def inserted() -> Iterator[dict]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield left("I", "", "")

    for row in _rows(batches):
        if not row["is_turn"]:
            conv_id, audit, at, state, seq = row["conv_id"], row["text"], 0, 0, 0
            yield from inserted()
            continue
        edit = audit[at]
        at += 1
        if edit != "D":
            yield left(edit, row["role"], row["text"])
        yield from inserted()


def repaired_turns(turns: DataFrame, parsed: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, edit (K, R or I): the turns of the repaired conversations.

    `parsed` is what `parse_conversations` says of the same turns. The turns of a
    conversation come in order, in one partition, and stream through their task one
    batch after the other.
    """
    none = F.lit(None)
    audits = parsed.select(
        "conv_id", F.lit(False).alias("is_turn"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
        F.col("audit").alias("text"), none.cast("string").alias("digest"),
    )
    rows = _turns(turns).select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", "text", "digest")
    rows = audits.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "turn", "role", "digest")
    rows = rows.drop("digest")
    text = [T.StructField(n, T.StringType()) for n in ("role", "text", "edit")]
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("seq", T.LongType()), *text])
    return rows.mapInArrow(lambda batches: _in_batches(_repairs(batches), schema), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    conv_id, digest = None, None
    for row in _rows(batches):
        if row["seq"] == 0:
            if digest is not None:
                yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}
            conv_id, digest = row["conv_id"], hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{row['role']}:{row['text']}".encode())
    if digest is not None:
        yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` of the turns, joined by line feeds.

    Takes the rows as `repaired_turns` leaves them, in order within a partition.
    """
    schema = T.StructType([T.StructField("conv_id", repaired.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    return repaired.mapInArrow(lambda batches: _in_batches(_digests(batches), schema), schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults planted by crc32(`conv_id:turn`) % 20: dropped, emptied,
    without sentence ends, repeated, given to the user; nulls count as one space."""
    t = common.only(turns, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(named.cast("binary")) % 20
    t = t.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fault.alias("fault"),
    ).where("fault <> 0")
    return t.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """What the damaged conversations lack, the cheapest repair and its digest: one
    row per conversation of the table, also of those that lost all turns."""
    turns = damaged(conversations)
    parsed = session.cut_lineage(parse_conversations(turns))
    digests = conversation_digests(repaired_turns(turns, parsed))
    every = conversations.select(conversations["conv_id"].alias("id")).distinct()

    def same(other: DataFrame):
        return every["id"].eqNullSafe(other["conv_id"])

    joined = every.join(parsed, same(parsed), "left").drop("conv_id").join(digests, same(digests), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
