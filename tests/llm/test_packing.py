import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import packing as P


def fill(plan, histogram):
    """Tokens of each container, by giving every rank of every length its place."""
    import numpy as np

    got = {}
    for n, count in histogram.items():
        key = n * P.RANK_BITS + np.arange(count)
        at = np.searchsorted(plan.key, key, "right") - 1
        for c in plan.first[at] + (key - plan.key[at]) // plan.per[at]:
            got[int(c)] = got.get(int(c), 0) + n
    return got


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=15))
def test_every_item_has_a_place_and_no_container_overflows(histogram):
    plan = P.solve(histogram, 40, rounds=30)
    got = fill(plan, histogram)
    assert sum(got.values()) == sum(n * c for n, c in histogram.items())
    assert max(got.values()) <= 40 and set(got) == set(range(plan.containers))


def test_close_to_the_bound_and_about_as_good_as_first_fit_at_worst():
    r = random.Random(1)
    for lo, hi in ((1, 60), (20, 70), (30, 50)):
        histogram = {}
        items = [r.randint(lo, hi) for _ in range(3000)]
        for n in items:
            histogram[n] = histogram.get(n, 0) + 1
        bins = []
        for n in sorted(items, reverse=True):
            at = next((k for k, room in enumerate(bins) if room >= n), None)
            if at is None:
                bins.append(100 - n)
            else:
                bins[at] -= n
        plan = P.solve(histogram, 100)
        assert plan.lower_bound <= plan.containers <= len(bins) * 1.01 + 5


def test_best_configuration_against_enumeration():
    import numpy as np

    lengths, value, demand = np.array([3, 5, 7]), np.array([2.0, 4.1, 5.9]), np.array([9, 9, 9])
    c = P.price_best(lengths, value, demand, 17)
    best = max(2.0 * a + 4.1 * b + 5.9 * d for a in range(6) for b in range(4) for d in range(3) if 3 * a + 5 * b + 7 * d <= 17)
    assert sum(value[j] * n for j, n in c.items()) == pytest.approx(best)


def test_documents(spark):
    texts = [(i, ("word " * n).strip() if n else "") for i, n in enumerate([0, 1, 5, 63, 64, 65, 200, 3, 3, 3, 30, 30, 30, 40])] + [(99, None), (6, "word " * 70)]
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, salt string, n_tokens int")
    rows = P.pack(d, capacity=64).collect()
    total, per = {}, {}
    for r in rows:
        if r["container_id"] is None:
            assert r["n_tokens"] == 0 and r["doc_id"] in (0, 99)
            continue
        per.setdefault(r["container_id"], []).append(r)
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    counts = {r["doc_id"]: r["n"] for r in P.token_counts(d, "doc_id", "text", P.VOCABULARY).groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert total == {k: v for k, v in counts.items() if v}
    for c in per.values():
        c.sort(key=lambda r: r["place"])
        assert sum(r["n_tokens"] for r in c) <= 64 and c[0]["place"] == 0
        assert all(b["place"] == a["place"] + a["n_tokens"] for a, b in zip(c, c[1:]))
    assert len([r for r in rows if r["doc_id"] == 3]) == 1  # not longer than a container, so never cut


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_audit_tells_broken_containers(spark):
    d = spark.createDataFrame([(i, "word " * (i % 50 + 1)) for i in range(60)], "doc_id long, text string")
    counts = P.token_counts(d, "doc_id", "text", P.VOCABULARY)
    good = P.pack(d, capacity=64)
    assert all(r["holds"] for r in P.audit(good, counts, 64, 0.3).collect())
    bad = {r["rule"] for r in P.audit(good.where("doc_id <> 7"), counts, 64, 0.3).collect() if not r["holds"]}
    assert "every token once" in bad
    assert "no container over capacity" in {r["rule"] for r in P.audit(good.selectExpr("0L as container_id", "doc_id", "piece", "n_tokens", "place"), counts, 64).collect() if not r["holds"]}
