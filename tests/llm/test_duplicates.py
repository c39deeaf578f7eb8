"""Near duplicates, repeated lines, passages: small cases and brute force."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import components, decontam, licenses, linededup, minhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = (text or "").translate(LOW).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def linked(texts, n, num, den):
    """Component of each id by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in texts}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            x = len(sets[a] & sets[b])
            if a < b and x and den * x >= num * (len(sets[a]) + len(sets[b]) - x):
                low, high = sorted((find(a), find(b)))
                label[high] = low
    return {i: find(i) for i in sets}


def family(n, words, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 20])):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,num,den", [(3, 17, 20), (5, 4, 5)])
def test_near_duplicates_against_all_pairs(spark, docs_of, n, num, den):
    texts = family(60, 200, 1) + family(20, 30, 2) + ["A b c", "a B c", "a b", "b a", "one", "", None, "  \t "]
    texts += ["shared passage of words " * 3 + f"own {i} text {i * 7} here {i * 3} and {i + 5} there" for i in range(30)]
    rows = list(enumerate(texts))
    want = linked(rows, n, num, den)
    got = minhash.near_duplicates(docs_of(*rows), n, num, den).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(shingles(texts[r.doc_id], n))


def test_near_duplicates_of_odd_tables(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    got = minhash.near_duplicates(docs_of((5, text), (5, text), (None, text), (9, None), (7, text))).collect()
    rows = sorted((str(r.doc_id), r.component_id, r.kept) for r in got)
    assert rows == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("9", 9, True), ("None", None, False)]
    assert minhash.near_duplicates(docs_of((1, "x")).limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_against_brute_force(spark, docs_of, monkeypatch):
    long = "This line is long enough to be counted as repeated, "
    texts = [f"{long}a\nown {i}\n  {long.upper()}A \n{long}{i % 3}\n\n{long}a" for i in range(12)] + [None, "", "\n", "x"]
    rows = list(enumerate(texts))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := line.strip(" \t\v\f\r").translate(LOW)) >= 40:
                held[k].add(i)
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(s := held.get(x.strip(" \t\v\f\r").translate(LOW), ())) < 5 or max(s) == i]
        want[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())

    def check(**options):
        got = linededup.line_report(docs_of(*rows), **options).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want

    check()
    monkeypatch.setattr(linededup, "SHARD_LINES", 1)  # several shards, several passes
    check(index_bytes=40)


def test_rows_of_one_id_are_one_document(spark, docs_of):
    line = "a line of more than forty characters that several rows hold"
    few = linededup.line_report(docs_of((1, line), (1, line), (1, line), (2, line), (3, line))).collect()
    assert [r.n_dropped for r in few] == [0] * 5
    many = linededup.line_report(docs_of(*[(i % 5, line) for i in range(10)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in many) == [(i, int(i < 4)) for i in range(5) for _ in range(2)]


def test_line_index_holds_all_and_only_its_keys():
    import numpy as np

    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 5000))
    shard = (h1.view(np.uint64) % np.uint64(3)).astype(int)
    rows = [
        linededup.LineIndex.build(s, h1[shard == s], h2[shard == s], np.arange(5000)[shard == s], -h1[shard == s]) for s in range(3)
    ]
    index = linededup.LineIndex(3, rows)
    slot = index.find(h1, h2)
    assert sorted(slot) == list(range(5000))
    assert (index.counts[slot] == np.arange(5000)).all() and (index.lasts[slot] == -h1).all()
    assert (index.find(h1, h2 + 1) == -1).all() and (index.find(h2, h1) == -1).all()
    assert (linededup.LineIndex(1, []).find(h1, h2) == -1).all()


def test_lines_keep_columns_and_nulls(spark, docs_of):
    docs = docs_of(*[(i, "the very same line that is longer than forty characters") for i in range(6)], (None, None))
    got = linededup.deduplicate_lines(docs)
    assert got.schema == docs.schema
    assert sorted((str(r.doc_id), r.text, r.kept) for r in got.collect())[-2:] == [
        ("5", "the very same line that is longer than forty characters", "x"), ("None", None, "x"),
    ]
    assert linededup.deduplicate_lines(docs.limit(0)).count() == 0


def item(n, seed):
    rng = random.Random(seed)
    return " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))


def test_decontamination(spark, docs_of):
    items = {0: item(20, 1), 1: item(60, 2), 2: item(30, 3), 3: None, 4: "", 5: item(20, 1)}
    bench = spark.createDataFrame([(*x, "z") for x in items.items()], "item_id long, text string, doc_id string")
    words = items[1].split()
    edited = " ".join([*words[:30], "new", *words[31:]])
    far = " ".join(w if i % 8 else "other" for i, w in enumerate(words))
    docs = docs_of(
        (1, f"before {items[0].upper().replace(' ', '!! ')} after"), (2, f"a b c {edited} d"), (3, far), (4, "clean text " * 50), (5, None),
        (6, ""), (7, item(400, 9) + " " + items[2] + " " + item(10, 8)), (8, " ".join(words[:30])), (None, items[2]),
    )
    got = decontam.contaminated(docs, bench).collect()
    found = {(r.doc_id, r.item_id): (round(r.similarity, 3), r.start) for r in got}
    assert found == {
        (1, 0): (1.0, 1), (1, 5): (1.0, 1), (2, 1): (round(51 / 61, 3), 3), (7, 2): (1.0, 400), (None, 2): (1.0, 0),
    }
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 8]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_simhash_blocks_hold_the_radius(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(decontam.RADIUS + 1)):
            b ^= 1 << bit
        signed = [x - (1 << 64) if x >> 63 else x for x in (a, b)]
        pairs.append((i, *signed))
    df = spark.createDataFrame(pairs, "item_id long, fp long, other long")
    blocks = decontam.item_blocks(df)
    probes = decontam._by_block(df.select("item_id", F.col("other").alias("fp")), "fp")
    hits = blocks.join(probes.drop("fp"), ["item_id", "block", "value"]).select("item_id").distinct()
    assert hits.count() == 300


def test_license_versions_and_tags(spark, docs_of):
    gpl3 = licenses.TEMPLATES["GPL-3.0"][1]
    notices = {
        "GPL-2.0-or-later": gpl3.replace("version 3", "version 2"), "AGPL-3.0": gpl3.replace("GNU", "GNU Affero"), "GPL-3.0": gpl3,
        "LGPL-3.0": gpl3.replace("GNU", "GNU Lesser"), "LGPL-2.1": gpl3.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1"),
        "MIT": "SPDX-License-Identifier: MIT", "Zlib": "/* SPDX-License-Identifier: Zlib */", "BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
        "BSL-1.0": licenses.TEMPLATES["BSL-1.0"][0], "EPL-2.0": licenses.TEMPLATES["EPL-2.0"][0],
    }
    docs = docs_of(*[(i, f"{item(30, i)} {text} {item(40, i + 50)}") for i, text in enumerate(notices.values())])
    got = {(r.doc_id, r.license) for r in licenses.licenses(docs).collect()}
    assert got == set(enumerate(notices))
    tag = docs_of((1, "SPDX-License-Identifier: GPL-2.0-or-later"), (2, "SPDX-License-Identifier: GPL-2.0-only"))
    assert {(r.doc_id, r.license) for r in licenses.licenses(tag).collect()} == {(1, "GPL-2.0-or-later"), (2, "GPL-2.0")}


def test_unrelated_notices_stand_beside_each_other(spark, docs_of):
    bsd = licenses.TEMPLATES["BSD-2-Clause"][0].replace("met: ", "met: 1. ")
    docs = docs_of(*[(i, f"{item(4 * i + 1, i)} {licenses.TEMPLATES['GPL-3.0'][1]} {bsd} {item(90, i + 99)}") for i in range(16)])
    got = {(r.doc_id, r.license) for r in licenses.licenses(docs).collect()}
    assert got == {(i, name) for i in range(16) for name in ("GPL-3.0", "BSD-2-Clause")}


def test_licenses(spark, docs_of):
    mit = licenses.TEMPLATES["MIT"][2]
    docs = docs_of(
        (1, "text\nReleased under the MIT License."), (2, f"{item(100, 1)} {mit.upper()} {item(90, 2)}"), (3, "no licence here"),
        (4, None), (5, ""), (6, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3. and more"),
        (None, "Licensed under CC BY-NC 4.0."),
    )
    got = {(r.doc_id, r.license, round(r.containment, 2), r.template_no) for r in licenses.licenses(docs).collect()}
    assert got == {(1, "MIT", 1.0, 0), (2, "MIT", 1.0, 2), (6, "GPL-3.0", 1.0, 0), (None, "CC-BY-NC-4.0", 1.0, 0)}
    assert licenses.licenses(docs.limit(0)).count() == 0
