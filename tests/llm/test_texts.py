"""Learners, page text, personal data, mixing, vectors."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import htmltext, langid, learning, mixing, pii, toxicity, vectors

SYLLABLES = {"en": "th er on an re", "de": "ch sch ung ei zu"}


def prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(docs_of):
    return docs_of(*[(i, prose(lang, 60, i), lang, "s") for i in range(80) for lang in ["en" if i % 2 else "de"]])


def test_language(spark, docs_of, labelled):
    model = langid.train(labelled)
    got = langid.identify(labelled, model).collect()
    want = {r.doc_id: r.lang for r in labelled.collect()}
    assert all(r.lang_pred == want[r.doc_id] for r in got) and {r.held_out for r in got} == {True, False}
    odd = docs_of((1, None), (2, ""), (3, "123 !"), (4, prose("de", 5000, 1)), (None, prose("en", 9, 2)), (4, prose("de", 5000, 1)))
    pred = sorted((str(r.doc_id), r.lang_pred, 0 <= r.score <= 1) for r in langid.identify(odd, model).collect())
    assert pred == [("1", "und", True), ("2", "und", True), ("3", "und", True), ("4", "de", True), ("4", "de", True), ("None", "en", True)]
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3
    empty = labelled.limit(0)
    assert langid.train(empty) == {} and langid.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_language_learns_nothing_from_the_held_out_fold(spark, labelled):
    swapped = labelled.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert langid.train(swapped)["langs"].tolist() == ["de", "en"]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    gamma, expected, log_z = langid.forward_backward(emit, lengths, trans)
    import itertools

    total = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        z, g, e = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(emit[c, i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            z += p
            for i in range(n):
                g[i, y[i]] += p
            for i in range(n - 1):
                e[y[i], y[i + 1]] += p
        assert np.allclose(gamma[c], g / z)
        total += e / z
    assert np.allclose(expected, total)
    z0 = np.log(sum(np.exp(sum(emit[0, i, y[i]] for i in range(4)) + sum(trans[y[i], y[i + 1]] for i in range(3))) for y in itertools.product(range(3), repeat=4)))
    assert np.isclose(log_z[0] + np.log(3), z0)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters(20, rng).items()}
    word = np.array([*rng.integers(0, 20, 30), 0])
    grams = np.concatenate([rng.integers(0, toxicity.GRAMS, (30, 6)), np.zeros((1, 6), int)])
    ids = rng.integers(0, 30, (5, 7))
    ids[0, 4:] = -1
    y, weight = np.array([0, 1, 1, 0, 1.0]), np.full(5, 0.2)
    _, grad = toxicity.loss_and_gradients(p, word, grams, ids, y, weight)
    for k in ("uf", "ub", "wf", "wb", "bf", "bb", "v", "w", "c"):
        at = (0,) * p[k].ndim
        sides = []
        for step in (1e-5, -2e-5):
            p[k][at] += step
            sides.append(toxicity.loss_and_gradients(p, word, grams, ids, y, weight)[0])
        p[k][at] += 1e-5
        assert np.isclose((sides[0] - sides[1]) / 2e-5, grad[k][at], atol=1e-7)


def test_long_runs_are_read_whole(spark, docs_of):
    assert learning.letter_words("ab Cd " + "x" * 24) == ["ab", "cd", "x" * 24]
    run = "".join(np.random.default_rng(2).choice(list("abcdefghij"), 1000))
    assert learning.letter_words("½ x²y ③ 7 Ⅷ _") == ["x", "y"]
    pieces = learning.letter_words(run)
    assert max(map(len, pieces)) <= learning.WIDTH
    assert {run[i : i + 8] for i in range(993)} == {p[i : i + 8] for p in pieces for i in range(len(p) - 7)}
    # the languages differ in the middle of a run only
    texts = {"aa": "m" * 12 + "pq" * 20 + "m" * 12, "bb": "m" * 12 + "rs" * 20 + "m" * 12}
    docs = docs_of(*[(i, texts[k], k, "s") for i in range(40) for k in ["aa" if i % 2 else "bb"]])
    got = {r.lang_pred for r in langid.identify(docs.where("doc_id % 2 = 1"), langid.train(docs)).collect()}
    assert got == {"aa"} and {r.lang_pred for r in langid.identify(docs.where("doc_id % 2 = 0"), langid.train(docs)).collect()} == {"bb"}


def test_toxicity(spark, docs_of):
    rows, labels = [], []
    for i in range(200):
        words = prose("en", 150, i).split()
        if i % 4 == 0:
            words[i % 150] = "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, None if i == 7 else int(i % 4 == 0)))
    docs, lab = docs_of(*rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in got.values() if r.held_out]
    assert held and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.85
    # one word at the very end of a long text counts
    odd = docs_of((1, None), (2, ""), (3, prose("en", 6000, 5) + " idiot"), (None, prose("en", 6000, 6)))
    odd = {r.doc_id: r for r in toxicity.score_toxicity(odd, model).collect()}
    assert odd[3].predicted == 1 and odd[3].score > odd[None].score and 0 <= odd[1].score == odd[2].score <= 1
    assert toxicity.train(docs, lab.limit(0)) == {}
    assert {r.score for r in toxicity.score_toxicity(docs, {}).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_scores_stand_for_the_whole_table(spark, docs_of):
    # one text in 21 is toxic; of those with the word, a third
    rows = [(i, "you idiot there" if i % 21 == 0 or i % 21 in (5, 11) else "good day there") for i in range(2100)]
    docs, lab = docs_of(*rows), spark.createDataFrame([(i, int(i % 21 == 0)) for i in range(2100)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab, per_label=60)
    got = toxicity.score_toxicity(docs.union(docs_of((-1, None))), model).collect()
    by_text = {r.doc_id: r.score for r in got}
    assert abs(by_text[21] - 1 / 3) < 0.1 and by_text[1] < 0.05 and abs(by_text[-1] - 1 / 21) < 0.01
    assert sum(r.predicted for r in got) == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<html><head><title>T</title></head><body></body></html>", ""),
        (
            "<body><header>Site</header><nav><a href=/>Home</a></nav><article><h1>Big &amp; title</h1><p>First\n <b>bo</b>ld, "
            "long enough.<br>More<p>Second&nbsp;para.<div class='ad'>Buy now!</div><ul><li>one<li>two</ul><form>Mail</form>"
            "<section id=comments><p>Great post, thanks for all of it.</section></article><aside>Other</aside><footer>(c)</footer>"
            "<script>var a = '<p>no</p>'</script>",
            "Big & title First bold, long enough. More Second para. one two",
        ),
        (
            "<div id=menu><a href=a>A</a></div><div id=content><h1>Head</h1><p>A long paragraph about something, with words.</p>"
            "<!-- <p>no</p> --><p>Short.</p></div><div class=sidebar><p>Sidebar text of some length, as it happens.</p></div>",
            "Head A long paragraph about something, with words. Short.",
        ),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


LONG = "A long paragraph about something that happened, told in many words and without any links at all."


@pytest.mark.parametrize(
    "wrapper",
    ["content-sidebar-wrap", "has-sidebar", "elementor-widget elementor-widget-text-editor", "header-fixed page", "overflow-hidden", "sidebar-layout"],
)
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_main_text_in_wrappers_with_boilerplate_words(wrapper, inner):
    comment = "<div id=comments><div class=comment-body><p>Great post, thanks for all of it, and more of this.</p></div></div>"
    page = f"<div class='{wrapper}'><div class=nav><a href=/>Home</a></div><{inner}><p>{LONG}</p><p>{LONG}</p></{inner}>{comment}</div>"
    assert htmltext.main_text(page) == f"{LONG} {LONG}"


@pytest.mark.parametrize(
    "tag",
    ["<img alt='Today's news'>", "<img alt=Today's>", "<img src=a ' title=\"x > y\">", "<img data=5\">", "<img alt='Today's news' src='a.png'>"],
)
def test_main_text_with_stray_quotes(tag):
    page = f"<article><p>{LONG}</p>{tag}<p>{LONG}</p><p>It's {LONG}</p></article>"
    assert htmltext.main_text(page) == f"{LONG} {LONG} It's {LONG}"


def test_min_cut_against_all_labellings():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        odds = list(rng.normal(size=n))
        edges = {(a, b): float(rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(y):
            return sum(o * (not k) if o > 0 else -o * k for o, k in zip(odds, y)) + sum(w * (y[a] != y[b]) for (a, b), w in edges.items())

        best = min(cost(y) for y in itertools.product((False, True), repeat=n))
        assert np.isclose(cost(htmltext.min_cut(odds, edges)), best)


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, 5), (2, None, "<article><p>A " + "long " * 50_000 + "</p></article>", 5), (2, "v", "<p>x &lt; y, surely.</p>", 5)],
        "page_id long, url string, html string, text long",
    )
    got = sorted((r.page_id, r.n_chars) for r in htmltext.extract_main_text(pages).collect())
    assert got == [(1, 0), (2, 14), (2, 250_001)]


def test_personal_data(spark, docs_of):
    docs = docs_of(
        (1, "Mail Ann.B@Example.com or ann.b@example.com, call +1 (743) 555-3824 or +1 743 555 3824. IP 10.0.0.1!"),
        (2, 'TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF" 4785380592391139$$$'), (3, None), (4, ""), (5, "nothing, 12 here"),
        (6, "Mrs. Anna Schmidt met Mr. Otto Kern; Mrs. Anna Schmidt left. Госпожа Анна Иванова"), (6, "nothing"), (None, "a@b.org"),
    )
    got = collections.defaultdict(list)
    for r in pii.replace_personal_data(docs, "k").collect():
        got[r.doc_id].append((r.text, r.n_entities))
    (one, n), = got[1]
    m = re.fullmatch(r"Mail (\S+) or (\S+), call (\+\d \(\d{3}\) \d{3}-\d{4}) or (\+\d \d{3} \d{3} \d{4})\. IP (\d+(?:\.\d+){3})!", one)
    assert n == 5 and m[1].lower() == m[2] and m[1] != "Ann.B@Example.com" and m[1][0].isupper()
    assert re.sub(r"\D", "", m[3]) == re.sub(r"\D", "", m[4]) != "17435553824" and m[5] != "10.0.0.1"
    (two, n), = got[2]
    assert n == 2 and re.fullmatch(r'TOKEN = "[0-9A-F]{40}" \d{16}\$\$\$', two) and "24BE" not in two
    assert got[3] == [(None, 0)] and got[4] == [("", 0)] and got[5] == [("nothing, 12 here", 0)]
    six, = [t for t, n in got[6] if n]
    m = re.fullmatch(r"Mrs\. (\w+ \w+) met Mr\. (\w+ \w+); Mrs\. (\w+ \w+) left\. Госпожа ([а-яА-Я]+ [а-яА-Я]+)", six)
    assert m[1] == m[3] and m[1].split()[0] in pii.NAMES["latin"]["f"] and m[2].split()[0] in pii.NAMES["latin"]["m"]
    assert m[4].split()[0] in pii.NAMES["cyrillic"]["f"]
    assert got[None][0][1] == 1 and "a@b.org" not in got[None][0][0]
    assert pii.replace_personal_data(docs.limit(0)).count() == 0


def test_whole_names_are_replaced(spark, docs_of):
    names = ["Mr John Peter Smith", "Dr. Anna-Maria Schulz", "Mr McDonald", "Mr O'Brien", "MR SMITH", "Frau von der Leyen", "Prof. Dr. Ines K. Adam-Roy", "Mme d'Arc", "DR. JOHN SMITH"]
    docs = docs_of(*[(i, f"met {n} today") for i, n in enumerate(names)], (50, "MS Word and Mr Kern and The others"))
    got = {r.doc_id: r for r in pii.replace_personal_data(docs, "k").collect()}
    for i, n in enumerate(names):
        assert got[i].n_entities == 1 and got[i].text.startswith("met " + n.split()[0]) and got[i].text.endswith(" today")
        parts = re.sub(r"^((Mr|MR|Dr\.|DR\.|Frau|Prof\.|Mme) )+", "", n)
        assert not {p for p in re.findall(r"\w{3,}", parts)} & set(re.findall(r"\w+", got[i].text)), got[i].text
    assert re.fullmatch(r"met MR [A-Z]+ today", got[4].text) and got[50].text.startswith("MS Word and Mr ") and got[50].text.endswith(" and The others")


def test_persons_are_one_whatever_their_titles(spark, docs_of):
    text = "Dr. Anna Keller, Frau Anna Keller, FRAU ANNA KELLER; Dr. Kai Kern, Herr Kai Kern, Frau Kai Kern; Prof. Uwe Ohm"
    (got,) = pii.replace_personal_data(docs_of((1, text)), "k").collect()
    keller, kern, _ = got.text.split("; ")
    a, b, c = (x.split(" ", 1)[1] for x in keller.split(", "))
    assert got.n_entities == 7 and a == b and c == a.upper() and a.split()[0] in pii.NAMES["latin"]["f"]
    assert len({x.split(" ", 1)[1] for x in kern.split(", ")}) == 3


def test_surrogates_end_where_no_value_is_free(spark, docs_of):
    (got,) = pii.replace_personal_data(docs_of((1, "password: ____________ and token: ___________1"))).collect()
    assert got.text.startswith("password: ____________ and token: ") and got.n_entities == 1
    found = spark.createDataFrame([("ssn", str(i)) for i in range(10)] + [("secret", "____")], "kind string, canon string")
    got = pii.surrogates(found, "k").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == 11 and not {r.surrogate for r in got} & {r.canon for r in got}


def test_surrogates_are_distinct(spark):
    names = [("person", f"f:name{i} other{i % 7}") for i in range(900)] + [("phone", f"{i:03d}") for i in range(300)]
    found = spark.createDataFrame(names, "kind string, canon string")
    got = pii.surrogates(found, "k").collect()
    assert len(got) == 1200 and len({(r.kind, r.surrogate) for r in got}) == 1200
    assert not {(r.kind, r.surrogate) for r in got} & set(names)


def test_mix(spark, docs_of):
    rng = np.random.default_rng(2)
    rows = [(i, prose("en", int(rng.integers(0, 700)), i), "en", [None, "a", "b", "c", "d"][i % 5]) for i in range(200)]
    rows += [(1, "one two", "en", "a"), (1, "one two", "en", "a"), (999, None, "en", "z"), (None, "x y z", "en", None)]
    docs = docs_of(*rows)
    got = mixing.mix_report(docs, block_words=16, shard_slots=64).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs, 16, 64).collect()), key=str)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    # shares by hand: until none is above twice its size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, due, want = set(order), 1.5 * sum(size.values()), {}
    while True:
        level = due / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * size[s]
            due -= want[s]
        free -= set(over)
    want |= {s: level * weight[s] for s in free}
    assert all(np.isclose(want[s], target[s]) for s in order)
    assert all(0 <= target[s] - taken[s] < 1 for s in order)
    blocks = mixing.mixed_blocks(docs, 16, 64).collect()
    words = collections.Counter()
    for b in blocks:
        assert len(b.text.split()) <= 16
        words[b.source] += len(b.text.split())
    assert words == +taken
    assert mixing.mix_report(docs.limit(0)).count() == 0


def _mixed_rows(df):
    return sorted(map(tuple, mixing.mix_report(df, 16, 64).collect()), key=str)


def test_mix_is_the_same_in_any_files(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 40)
    monkeypatch.setattr(mixing, "RUN_SHARDS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, prose("en", int(rng.integers(0, 300)), i), "en", [None, "a", "b"][i % 3]) for i in range(150)]
    rows += [(7, "the same row " * 20, "en", "a")] * 60 + [(None, "", "en", "a")] * 40  # a third of all, and empty ones
    docs = docs_of(*rows)
    one, many = _mixed_rows(docs.coalesce(1)), _mixed_rows(docs.repartition(7))
    assert len(one) == 250 and one == many
    assert _mixed_rows(docs.repartition(5, "text")) == one


def test_mix_draws_down_a_tree_of_sources(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "TOP", 4)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = docs_of(*[(i, prose("en", 40 + i % 30, i), "en", f"s{i % 100:02}") for i in range(300)])
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in mixing.mix_report(docs, 16, 64).collect():
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(target) == 100 and all(0 <= target[s] - taken[s] < 1 for s in target)
    slots = spark.createDataFrame([(i, 1 + 9 * (i == 50)) for i in range(100)], "source_no long, slots long")
    drawn, n_shards = mixing._draws(slots, 8, 1)
    by_shard = collections.Counter()
    for r in drawn.collect():
        by_shard[r.shard] += r.drawn
    assert n_shards == 14 and sum(by_shard.values()) == 109 and max(by_shard.values()) == 8


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(out) == list(range(n))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    near = np.concatenate([x[:40] + rng.normal(size=(40, 16)) * 0.05, np.repeat(x[50:51], 30, 0), x[60:61] * 3, x[70] + rng.normal(size=(60, 16)) * 0.03])
    all_x = np.concatenate([x, near])
    rows = [(i, v.tolist()) for i, v in enumerate(all_x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in vectors.similar_vectors(df).collect()}
    z = all_x / np.linalg.norm(all_x, axis=1)[:, None]
    links = z @ z.T >= 0.95
    np.fill_diagonal(links, False)
    label = vectors._roots(len(z), *np.nonzero(links))
    found = sum(got[i].n_links for i in range(len(z)))
    assert found <= links.sum() and found >= 0.97 * links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in range(len(z)))
    assert np.mean([got[i].component_id == label[i] for i in range(len(z))]) > 0.97
    for i, _ in odd:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept == (i is not None)
    assert vectors.similar_vectors(df.limit(0)).count() == 0
