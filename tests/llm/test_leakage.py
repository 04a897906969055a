"""Leaks against a plain search, with changed words, markup, lead-ins and short quotes."""

import random

from tracewright.llm import leakage as L

rng = random.Random(5)
VOCABULARY = [f"word{i}" for i in range(300)]
LEAD = "please read the next lines with great care and then say in your own words what they mean to you"
ITEMS = [(i, (LEAD + "\n\n" if i % 2 else "") + " ".join(rng.choice(VOCABULARY) for _ in range(60))) for i in range(20)]


def text(item, a, b):
    return " ".join(L.words_of(ITEMS[item][1].split("\n\n")[-1])[a:b])


def noise(n):
    return " ".join(f"other{rng.randrange(5000)}" for _ in range(n))


def plain(doc, least=20):
    """Items of which some window of `least` words stands in the document unchanged."""
    words = L.words_of(doc)
    seen = {tuple(words[k : k + least]) for k in range(len(words) - least + 1)}
    out = []
    for i, t in ITEMS:
        w = L.words_of(t.split("\n\n")[-1])
        if any(tuple(w[k : k + least]) in seen for k in range(len(w) - least + 1)):
            out.append(i)
    return out


def index_of(items):
    """The index of items of which every other one opens with LEAD."""
    return L.LeakIndex(items, leads=[len(L.words_of(LEAD)) if t.startswith(LEAD) else 0 for _, t in items])


def test_against_plain_search():
    index = index_of(ITEMS)
    for k in range(150):
        i, j = rng.randrange(20), rng.randrange(20)
        a, n = rng.randrange(0, 30), rng.choice([5, 12, 18, 20, 22, 30])
        doc = f"{noise(rng.randrange(30))} {text(i, a, a + n)} {noise(rng.randrange(1, 30))} {text(j, 0, rng.choice([6, 25]))}"
        assert index.leaks(doc) == plain(doc), k


def test_changes_dont_hide_a_passage():
    index = index_of(ITEMS)
    words = text(3, 0, 40).split()
    words[12] = "changed"
    words[27] = "also"
    assert index.leaks(noise(9) + " " + " ".join(words)) == [3]
    assert index.leaks(text(4, 0, 30).upper().replace(" ", ",  ")) == [4]
    assert index.leaks("<p>" + text(4, 0, 30).replace("word1", "<em>word1</em>").replace(" ", "&nbsp;\n", 3) + "</p>") == [4]


def test_lead_ins_and_quotes():
    index = index_of(ITEMS)
    assert index.leaks(LEAD) == [] and index.leaks(LEAD + " " + noise(30)) == []
    assert index.leaks(text(5, 10, 26)) == []


def test_items_that_share_text():
    items = [(1, text(6, 0, 50)), (2, "start " + text(6, 10, 45) + " end"), (3, text(6, 0, 50))]
    assert L.LeakIndex(items).leaks(noise(5) + " " + text(6, 12, 40)) == [1, 2, 3]


def test_frame(spark):
    docs = spark.createDataFrame([(1, text(7, 0, 30), 9), (1, text(7, 0, 30), 9), (2, None, 9), (3, "", 9), (4, noise(40_000), 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (99, None)], "item_id long, text string")
    assert [tuple(r) for r in L.find_leaks(docs, items).collect()] == [(1, 7)]
    assert L.find_leaks(docs, items.limit(0)).count() == 0 and L.find_leaks(docs.limit(0), items).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, text(i, 0, 30)) for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(L, "BLOCK_WORDS", 200)
    assert {tuple(r) for r in L.find_leaks(docs, items).collect()} == {(i, i) for i in range(20)}


def test_shared_bodies_are_matches():
    body = text(6, 10, 45)
    assert L.LeakIndex([(i, text(6, 0, 50)) for i in range(6)]).leaks(text(6, 0, 50)) == list(range(6))
    quoting = [(i, f"{noise(8)} {body} {noise(8)}") for i in range(6)]
    assert L.LeakIndex(quoting).leaks(noise(5) + " " + body) == list(range(6))


def test_lead_ins_over_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, LEAD), (2, text(5, 0, 30))], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for words in (50, 2_000, 400_000):
        monkeypatch.setattr(L, "BLOCK_WORDS", words)
        assert [tuple(r) for r in L.find_leaks(docs, items).collect()] == [(2, 5)]


def test_lead_lengths(spark):
    items = spark.createDataFrame([*ITEMS, (50, LEAD + " " + ITEMS[1][1]), (51, ITEMS[1][1])], "item_id long, text string")
    got = {r["item_id"]: r["lead"] for r in L.lead_lengths(items).collect()}
    n = len(L.words_of(LEAD))
    assert all(got[i] == (n if i % 2 else 0) for i in range(20)) and got[50] == got[51] == n
    four = spark.createDataFrame([(i, t) for i, t in ITEMS if i < 8], "item_id long, text string")
    assert {r["lead"] for r in L.lead_lengths(four).collect()} == {0}


def test_positions():
    for t in ("A <b>wo</b>rd &amp; ﬁne Éa\u0301 x", "plain, words here", "", "İstanbul <p>x</p>ß 1_2"):
        where, words = L._positions(t), L.words_of(t)
        assert len(where) == len(words) and all(0 <= a < b <= len(t) for a, b in where)
    t = "Keep this, <em>then</em> drop these words. And keep"
    assert L.without_spans(t, [(3, 5)], 0.9)[0] == "Keep this, <em>then</em> . And keep"


def test_clean(spark):
    long_ = noise(60)
    docs = spark.createDataFrame([(1, text(7, 0, 30)), (2, None), (3, long_ + ", " + text(8, 0, 25) + ". Fin <b>e</b>"), (4, "short")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for few in (L.FEW_SPANS, 0):
        L.FEW_SPANS, kept = few, L.FEW_SPANS
        got = {r["doc_id"]: r for r in L.clean_documents(docs, items).collect()}
        L.FEW_SPANS = kept
        assert got[1]["dropped"] and got[1]["text"] is None and got[1]["coverage"] == 1
        assert got[3]["text"] == long_ + ", . Fin <b>e</b>" and got[3]["removed_words"] == 25 and not got[3]["dropped"]
        assert got[2]["text"] is None and not got[2]["dropped"] and got[4]["text"] == "short"
    assert L.clean_documents(docs, items.limit(0)).filter("removed_words > 0").count() == 0


def test_three_of_twenty_words_may_change():
    index = index_of(ITEMS)
    words = text(3, 0, 40).split()
    for k in (6, 13, 20, 27, 34):
        words[k] = "changed"
    assert index.leaks(" ".join(words)) == [3]
    for k in (9, 16, 23, 30):
        words[k] = "changed"
    assert index.leaks(" ".join(words)) == []
