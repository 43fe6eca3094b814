import random

from lodestrata.llm.nearest_time import match_nearest

SCHEMA = "session_id string, i int, t double, k string, rt string"


def run(spark, left, right, tol):
    make = lambda rows: spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, match_nearest(make(left), make(right), tol).collect()), key=repr)


def brute(left, right, tol):
    out = set()
    for s, i, t in set(left):
        c = [(abs(t - u), u, j) for r, j, u in right if r == s and s is not None and t is not None and u is not None and t == t and u == u and abs(t - u) <= tol]
        if c:
            d, u, _ = min(c)
            out.add((s, i, min(j for r, j, v in right if r == s and v == u)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(2)
    right = [(s, i, round(100 + r.random() * 3, 4)) for s in "ab" for i in range(400)] + [("hot", i, 5.0 + i % 3 * 0.001) for i in range(500)]
    left = [(s, i, 100 + r.random() * 3) for s in "abz" for i in range(150)] + [("hot", i, 5.0002) for i in range(300)]
    for tol in (0.004, 0.0005, 0.25):
        assert run(spark, left, right, tol) == brute(left, right, tol)


def test_ties_copies_nulls_and_chunk_borders(spark):
    right = [("a", 5, 1.024), ("a", 3, 1.024), ("a", 9, 1.026), ("a", 1, None), ("a", 2, float("nan")), (None, 1, 1.0), ("a", 7, 2.048), ("a", 3, 1.024)]
    left = [("a", 1, 1.025), ("a", 1, 1.025), ("a", 2, 1.0240001), ("a", 3, None), ("a", 4, 2.0445), ("a", 5, 2.0435), (None, 6, 1.0)]
    assert run(spark, left, right, 0.004) == [("a", 1, 3), ("a", 2, 3), ("a", 4, 7)]


def test_empty(spark):
    assert run(spark, [], [("a", 1, 1.0)], 0.1) == run(spark, [("a", 1, 1.0)], [], 0.1) == []
