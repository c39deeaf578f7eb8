"""Uniform shuffle, periodic runs and conversation repair against plain Python."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import convrepair, queries, runs, shuffle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# --- shuffle ---------------------------------------------------------------


@pytest.mark.parametrize("total,marked,drawn", [(50, 20, 13), (7, 7, 3), (9, 0, 4), (1, 1, 1), (400, 3, 390), (30, 29, 15)])
def test_draws_follow_the_hypergeometric_law(spark, total, marked, drawn):
    n = 20_000
    at = (F.col("id") + 0.5) / n
    got = spark.range(n).select(shuffle.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), at).alias("h"))
    counts = {r.h: r["count"] for r in got.groupBy("h").count().collect()}
    for h in range(total + 1):
        p = math.comb(marked, h) * math.comb(total - marked, drawn - h) / math.comb(total, drawn) if h <= drawn else 0
        assert abs(counts.get(h, 0) - n * p) <= 2


def test_large_draws_stay_near_their_mean(spark):
    total, marked, drawn = 10**10, 3 * 10**9, 4 * 10**6
    got = spark.range(20).select(
        shuffle.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), (F.col("id") + 0.5) / 20).alias("h")
    )
    assert all(abs(r.h - 1_200_000) < 5 * 917 for r in got.collect())


def test_matrix_sums(spark):
    rng = random.Random(3)
    for n_parts in (1, 2, 7, 300):
        sizes = {p: rng.choice([1, 2, 50, 4000]) for p in range(0, 2 * n_parts, 2)}
        counts = spark.createDataFrame(list(sizes.items()), "part int, n long")
        got = {r.part: np.diff(r.ends, prepend=0) for r in shuffle.communication_matrix(counts, 5, n_parts, 1).collect()}
        assert {p: int(x.sum()) for p, x in got.items()} == sizes
        total = sum(sizes.values())
        assert sum(got.values()).tolist() == [total // 5 + (j < total % 5) for j in range(5)]
        assert min(x.min() for x in got.values()) >= 0


def dealt(rows, n_shards, **options):
    by = collections.defaultdict(dict)
    for r in shuffle.shuffle_rows(rows, n_shards, **options).collect():
        assert r.slot not in by[r.shard]
        by[r.shard][r.slot] = r[0]
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    return [[by[s][i] for i in range(len(by[s]))] for s in range(n_shards) if by[s]]


def test_shuffle_is_a_permutation(spark):
    table = spark.range(0, 1003, 1, 7)
    shards = dealt(table, 4, bucket_rows=20)
    assert sorted(itertools.chain(*shards)) == list(range(1003))
    assert [len(s) for s in shards] == [251, 251, 251, 250]
    assert dealt(table, 4, bucket_rows=20) == shards
    assert dealt(table, 4, bucket_rows=20, seed=5) != shards
    # no memory of the order or the partition the rows came from
    flat = list(itertools.chain(*shards))
    assert abs(np.corrcoef(flat, range(1003))[0, 1]) < 0.12
    homes = collections.Counter((s, x * 7 // 1003) for s, rows in enumerate(shards) for x in rows)
    assert sum((homes[s, p] - 35.8) ** 2 / 35.8 for s in range(4) for p in range(7)) < 43  # chi square, 18 degrees


def test_every_deal_of_few_rows_occurs(spark):
    seen = set()
    for seed in range(60):
        seen.add(tuple(map(tuple, dealt(spark.range(0, 3, 1, 2), 2, seed=seed))))
        if len(seen) == 6:
            break
    assert len(seen) == 6


def test_shard_report_of_odd_rows(spark, docs_of):
    rows = [(None, "same")] * 40 + [(7, "same")] * 40 + [(1, None), (2, ""), (3, "ä" * 200_000), (4, "x")]
    got = shuffle.shard_report(docs_of(*rows), 16).collect()
    assert len(got) == 84 and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    counts = collections.Counter(r.shard for r in got)
    assert sorted(counts) == list(range(16)) and set(counts.values()) == {5, 6}
    by = {r.doc_id: (r["size"], r.text_crc32) for r in got}
    assert by == {
        None: (5, zlib.crc32(b"same")), 7: (5, zlib.crc32(b"same")), 1: (1, 0), 2: (1, 0),
        3: (400_001, zlib.crc32(("ä" * 200_000).encode())), 4: (2, zlib.crc32(b"x")),
    }
    assert shuffle.shard_report(docs_of((1, "x")).limit(0)).count() == 0
    named = spark.createDataFrame([(1, "a", 9, "p", 2)], "part int, shard string, place int, bucket string, c0 int")
    assert [tuple(r) for r in shuffle.shuffle_rows(named, 3).collect()] == [(1, 9, "p", 2, 0, 0)]


# --- runs ------------------------------------------------------------------


def runs_by_comparing(w, least, repeats):
    found = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, repeats * q) and i > start:
                found.append((start, i - start + q, q))
            i += i == start or 1
    smallest = [r for r in found if not any(s[2] < r[2] and s[0] <= r[0] and s[0] + s[1] >= r[0] + r[1] for s in found)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,repeats", [(24, 3), (1, 3), (6, 4)])
def test_runs_of_random_words(least, repeats):
    rng = random.Random(least)
    docs = []
    for i in range(250):
        n, letters = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(n + 1), rng.randrange(1, 20)
            w[at:at] = (w[at : at + p] or [9]) * rng.randrange(2, 6)
        docs.append(w)
    flat = np.array([x for w in docs for x in w], np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
    start, reach, period = runs.find_runs(flat, owner, least, repeats)
    base = np.r_[0, np.cumsum([len(w) for w in docs])]
    got = collections.defaultdict(list)
    for s, length, q in zip(start.tolist(), reach.tolist(), period.tolist()):
        got[owner[s]].append((s - base[owner[s]], length, q))
    for i, w in enumerate(docs):
        assert got[i] == runs_by_comparing(w, least, repeats), w


def run_row(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if w and h is not None and h % 10 == 0:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = runs_by_comparing(w, 24, 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2],
        sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_run_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_runs(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    checked = [r for r in docs if len(r.text or "") < 12_000]
    assert sum(got[r.doc_id][1] > 0 for r in checked) > 5
    for r in checked:
        assert got[r.doc_id] == run_row(r.doc_id, r.text)


def test_runs_of_odd_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(runs, "PART_WORDS", 50)
    texts = [None, "", " \t\n\x0b\f\r ", "one", "a b " * 12, "a b " * 30, "x " * 23, "x " * 24, "p q r " * 9 + "z " + "p q r " * 9]
    rows = [*enumerate(texts), (None, "k " * 40), (4, texts[4]), (4, texts[4])]
    got = runs.run_report(docs_of(*rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(run_row(i, t)) for i, t in rows)
    assert runs.run_report(docs_of((1, "x")).limit(0)).count() == 0
    long = "w0 " + " ".join(f"v{i % 40_000}" for i in range(130_000))
    (r,) = runs.periodic_runs(docs_of((1, long)), keep=("doc_id", "kept")).collect()
    assert [tuple(x) for x in r.runs] == [(1, 130_000, 40_000)] and r.kept == "x"
    assert len(r.collapsed.split()) == 40_001


# --- conversations ---------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"
SOUND = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """(blank, duplicate, truncated, illegal), and for each row whether it must go and is truncated."""
    seen, counts, facts = set(), [0, 0, 0, 0], []
    for _, role, text in rows:
        shown = text.strip(BLANKS)
        kind = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        facts.append((kind in (0, 1), kind == 2))
    counts[3] = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return counts, facts


def cheapest(rows, facts):
    """The least (cost, audit, turns), all edits of each prefix compared by the state they end in."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}

    def closed(best):
        todo = list(best)
        while todo:
            at = todo.pop()
            cost, audit, turns = best[at]
            for i, role in names.items():
                to = moves.get((at, i))
                if to is not None and (to not in best or (cost + 2, audit + "I") < best[to][:2]):
                    best[to] = (cost + 2, audit + "I", (*turns, (role, "")))
                    todo.append(to)
        return best

    best = closed({0: (0, "", ())})
    for (_, role, text), (gone, cut) in zip(rows, facts):
        after = {}

        def offer(to, made):
            if to not in after or made[:2] < after[to][:2]:
                after[to] = made

        for at, (cost, audit, turns) in best.items():
            offer(at, (cost + 3, audit + "D", turns))
            if not gone:
                if (at, role[:1]) in moves:
                    offer(moves[at, role[:1]], (cost + cut, audit + "K", (*turns, (role, text))))
                for i, name in names.items():
                    if (at, i) in moves:
                        offer(moves[at, i], (cost + 2 + cut, audit + "R", (*turns, (name, text))))
        best = closed(after)
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def ordered(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x[1], x[2])))


def repair_row(conv_id, rows):
    rows = ordered(rows)
    (blank, duplicate, truncated, illegal), facts = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, left = cheapest(rows, facts)
    assert SOUND.match("".join(r[:1] for r, _ in left))
    text = "\n".join(f"{r}:{t}" for r, t in left)
    return (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(rows):
    filled = lambda v: " " if v is None else v
    out = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        h = zlib.crc32(f"{filled(conv_id)}:{filled(turn)}".encode()) % 20
        role, text = filled(role), filled(text)
        out[conv_id] += []
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        out[conv_id] += [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
    return out


def expected(rows):
    return sorted((repair_row(c, r) for c, r in damage(rows).items()), key=str)


def conversations(spark, rows):
    extra = [(*r, "x", 1, False) for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, digest string, part int, first boolean")


def made_up(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv_id in range(n):
        for turn in range(rng.randrange(1, 9)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["One.", "Two?", "Three", "", "  ", None, "Four! \t", "Five" + str(rng.randrange(50)), "ok."])
            rows.append((conv_id, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, text))
    return rows


def test_letters_of_one_span_never_extend_each_other():
    """Cells against every audit of short conversations."""
    for symbols in itertools.product("suaoSx", repeat=3):
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "o": "tool"}.get(c.lower(), "user"), "t") for i, c in enumerate(symbols)]
        facts = [(c == "x", c.isupper()) for c in symbols]
        assert convrepair.best(convrepair.span_cells("".join(symbols))) == cheapest(rows, facts)[:2]


def test_spans_are_the_same_however_they_are_cut():
    rng = random.Random(1)
    for _ in range(60):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(symbols))
        whole = convrepair.span_cells(symbols)
        assert convrepair.product(convrepair.span_cells(symbols[:cut]), convrepair.span_cells(symbols[cut:])) == whole


def test_repair_of_made_up_conversations(spark):
    rows = made_up(150, 4) + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None), (900, None, "user", "A")]
    got = convrepair.repair_report(conversations(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert convrepair.repair_report(conversations(spark, rows).limit(0)).count() == 0


def test_one_conversation_in_many_pieces(spark):
    rng = random.Random(8)
    hot = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"Turn {t}."])) for t in range(1500)]
    rows = hot + [(1, 3, "user", "Same.")] * 200 + [(2, 0, "user", "Long " * 200_000), (2, 1, "assistant", "Fine.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = convrepair.damaged(conversations(spark, rows))
        parsed = convrepair.parse_conversations(turns)
        got = convrepair.repair_report(conversations(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got), key=str) == expected(rows)
    repaired = convrepair.repaired_turns(turns, parsed).where("conv_id = 2").orderBy("seq").collect()
    assert [(r.seq, r.role, r.text) for r in repaired] == [
        (i, role, text) for i, (role, text) in enumerate(cheapest(ordered(damage(rows)[2]), faults(ordered(damage(rows)[2]))[1])[2])
    ]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_repair_query_against_plain_python(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_repair(spark, SF_DIR).collect()), key=str) == expected(rows)
