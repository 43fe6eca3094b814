import random

import pytest

from lodestrata.llm import leaks as L

NOUNS = [a + b + c for a in ("ket", "lad", "tar", "no", "pul", "cra", "lan") for b in ("te", "der", "pa", "lo", "ley") for c in ("l", "k", "mer", "st", "ning")]
VERBS = "sealed painted rented copied swapped moved borrowed counted emptied folded".split()
STOCK = "Read the following passage about the recording with care and then answer the question below it in one sentence."


def sentence(r):
    return f"The {r.choice(NOUNS)} was {r.choice(VERBS)} near a {r.choice(NOUNS)} while another {r.choice(NOUNS)} {r.choice(VERBS)} {r.randrange(90)} pieces of the {r.choice(NOUNS)}."


def fixture():
    r = random.Random(4)
    items = [(i, f"{STOCK} {' '.join(sentence(r) for _ in range(3))}") for i in range(20)]
    words = ["sample", "metric", "filter", "window", "report", "branch", "update", "vector"]
    plain = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs, want = [], set()
    for i in range(120):
        text = plain(40)
        if i % 10 == 0:  # a sentence or more, in another form
            k = r.randrange(20)
            got = items[k][1][len(STOCK) :].split()
            part = got[: 18 + r.randrange(20)]
            part = [w for j, w in enumerate(part) if j % 11 != 7]
            form = r.choice([str.upper, lambda s: s.replace("a", "а"), lambda s: f"**{s}**", lambda s: s.replace(" ", "\n"), lambda s: s])
            text = f"{text} {form(' '.join(part))} {plain(20)}"
            want.add((i, k))
        elif i % 10 == 1:
            text = f"{text} {STOCK}"  # stock wording only
        elif i % 10 == 2:
            text = f"{text} {' '.join(items[r.randrange(20)][1].split()[-6:])}"  # a short quote
        elif i % 10 == 3:
            text = f"{text} {sentence(r)}"  # the same style
        docs.append((i, text))
    return docs, items, want


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, t string, item_id int")
    e = spark.createDataFrame([(i, t, "en") for i, t in items], "item_id long, text string, lang string")
    return {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, e).collect()}


def test_finds_altered_passages_only(spark):
    docs, items, want = fixture()
    copies = docs + [(1000, docs[0][1]), (1001, None), (1002, ""), (1003, "x " * 5000 + docs[0][1] + " y" * 5000)]
    extra = {(k, i) for d, i in want if d == 0 for k in (1000, 1003)}
    assert run(spark, copies, items + [(77, None), (78, "")]) == want | extra


def test_empty(spark):
    docs, items, _ = fixture()
    assert run(spark, docs[:3], []) == set()
    assert run(spark, [], items[:3]) == set()


def test_align_prices_gaps():
    import numpy as np

    t = np.arange(20)
    own = np.ones(20, bool)
    assert L.align(t, t, own, 1.0)[0] == 20
    assert L.align(np.r_[-1, t[:8], -1, t[8:], -1], t, own, 1.0) == (19.0, 1, 21)
    assert L.align(np.delete(t, 5), t, own, 1.0)[0] == 18
    own[:10] = False
    assert L.align(t, t, own, 1.0)[0] == 10


def test_words_ignore_formatting():
    assert L.words("Тhe <b>LEFT‑hand</b>\u200b `cable`\n> _one_") == L.words("the left-hand cable one")
    assert L.words(None) == []


def test_recall_against_every_run_of_twelve_own_words(spark):
    sf = "/root/testdata/sf0.01"
    docs, ev = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    items = L.prepare(ev, L.Settings())
    runs = {}
    for k, (t, o) in enumerate(zip(items.tokens, items.own)):
        for j in range(len(t) - 11):
            if o[j : j + 12].all():
                runs.setdefault(t[j : j + 12].tobytes(), set()).add(items.ids[k])
    want = set()
    for r in docs.collect():
        c = L._coded(r["text"], items.vocabulary).astype(items.tokens[0].dtype)
        want |= {(r["doc_id"], i) for j in range(len(c) - 11) for i in runs.get(c[j : j + 12].tobytes(), ())}
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, ev).collect()}
    assert len(want) > 20 and len(got & want) >= 0.97 * len(want)


def test_too_many_items_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    ev = spark.range(5).selectExpr("id as item_id", "concat('word', id, ' more words') as text")
    with pytest.raises(ValueError, match="more than 3"):
        L.find_leaks(docs, ev, L.Settings(most_items=3))
