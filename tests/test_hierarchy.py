import random

import pytest

from lodestrata.operators import hierarchy as H

SCHEMA = "hierarchy string, node_id string, parent_id string, size int, note string"


def links(spark, rows):
    d = spark.createDataFrame([("h", n, p, 7, "x") for n, p in rows], SCHEMA)  # extra columns, one with a clashing name
    return H.parent_links(d)


def brute(rows):
    par = {}
    for n, p in rows:
        if n is not None:
            par.setdefault(n, set())
            if p:
                par[n].add(p)
    par = {n: (min(ps) if ps and min(ps) in par else None) for n, ps in par.items()}
    out = {}
    for n in par:
        seen, k, depth = {n}, n, 0
        while par[k] is not None and depth >= 0:
            k, depth = par[k], depth + 1
            if k in seen:
                depth = -1
                break
            seen.add(k)
        out[n] = (k, depth) if depth >= 0 else ("", -1)
    return par, out


def check(spark, rows):
    par, want = brute(rows)
    sets = H.nested_sets(links(spark, rows), with_path=True)
    got = {r["node_id"]: r for r in sets.collect()}
    assert {n: (r["root_id"], r["depth"]) for n, r in got.items()} == want
    below = {n: 0 for n in par}
    pairs = set()
    for n in par:
        if want[n][1] < 0:
            assert got[n]["path"] is None and got[n]["pre_lo"] is None
            continue
        k, path = n, [n]
        while par[k] is not None:
            k = par[k]
            path.append(k)
            below[k] += 1
            pairs.add((k, n))
        assert got[n]["path"] == "/".join(reversed(path))
    for n in par:
        if want[n][1] >= 0:
            assert got[n]["size"] == below[n] + 1 == got[n]["pre_hi"] - got[n]["pre_lo"] + 1
    found = [(r["node_id"], r["descendant_id"]) for r in H.descendant_pairs(sets, bucket=3).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs


def test_trees_cycles_and_what_hangs_below(spark):
    check(spark, [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("e", ""), ("u", "nowhere")])


def test_repeats_conflicts_and_nulls(spark):
    check(spark, [("a", None), ("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("c", "a"), (None, "a"), ("d", None), ("d", "c")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    r = random.Random(seed)
    n = 60
    rows = [(f"n{i}", f"n{r.randrange(n)}" if r.random() < 0.2 else f"n{r.randrange(i)}" if i and r.random() < 0.9 else None) for i in range(n)]
    check(spark, rows)


def test_long_chain_and_broad_parent(spark):
    check(spark, [("c0", None)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 9)] + [(f"k{i}", "c0") for i in range(200)])


def test_empty(spark):
    assert H.nested_sets(links(spark, [])).count() == 0


def test_chain_of_ten_thousand(spark):
    n = 10_000
    d = spark.range(n).selectExpr("'h' as hierarchy", "concat('c', id) as node_id", "case when id > 0 then concat('c', id - 1) end as parent_id")
    rows = H.nested_sets(H.parent_links(d)).collect()
    assert len(rows) == n and all(r["root_id"] == "c0" for r in rows)
    assert all(int(r["node_id"][1:]) == r["depth"] == r["pre_lo"] and r["size"] == n - r["depth"] for r in rows)


def test_one_parent_of_ninety_percent(spark):
    d = spark.range(20_000).selectExpr("'h' as hierarchy", "cast(id as string) as node_id", "case when id = 0 then null when id % 10 > 0 then '0' else cast(id - 10 as string) end as parent_id")
    got = H.nested_sets(H.parent_links(d))
    assert got.where("depth < 0").count() == 0 and got.where("node_id = '0'").first()["size"] == 20_000
    assert got.select("pre_lo").distinct().count() == 20_000
