import random

from lodestrata.operators import series as S
from pyspark.sql import functions as F


def brute(rows, width):
    """The row before each, by key and time."""
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, i) for kk, t, i in rows if kk == k)
        for a, b in zip([None, *own], own):
            out[k, b] = a
    return out


def test_neighbours_across_chunks_of_a_key_with_most_rows(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.9 else None if r.random() < 0.3 else "b", round(r.uniform(-50, 400), 1), i) for i in range(500)]
    d = spark.createDataFrame([(*x, "clash") for x in rows], "k string, t double, i int, c string")
    got = {(x["k"], (x["t"], x["i"])): None if x["p"] is None else (x["p"]["t"], x["p"]["i"]) for x in S.neighbour(d, ["k"], ["t", "i"], [], "p", width=10.0).collect()}
    assert got == brute(rows, 10.0)


def test_a_hot_key_is_many_tasks(spark):
    d = spark.range(20_000).selectExpr("case when id % 10 = 0 then concat('k', id % 70) else 'hot' end as k", "cast(id as double) as t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        x = d.withColumn("__c", F.floor(F.col("t") / 100.0)).repartition(16, "k", "__c")
        sizes = [r["n"] for r in x.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert S.rate_jitter(d, ["k"]).where("k = 'hot'").first()["n"] == 18_000


def test_dedupe_and_resample(spark):
    rows = [("a", 0.0, 0, 1.0), ("a", 0.0, 1, 5.0), ("a", 3600.0, 2, 3.0), ("a", 7200.5, 3, 7.0), ("n", 5.0, 4, 2.0)]
    d = spark.createDataFrame(rows, "s string, t double, i int, v double")
    assert sorted(r["i"] for r in S.dedupe(d, ["s"], ["t", "i"]).collect()) == [0, 2, 3, 4]
    got = {(r["s"], r["k"]): r["value"] for r in S.resample(d.where("i <> 1"), ["s"], "v", 1800.0).collect()}
    assert got["a", 0] == 1.0 and got["a", 1] == 2.0 and got["a", 2] == 3.0 and got["n", 0] == 2.0 and max(k for n, k in got if n == "a") == 4
    assert S.rate_jitter(d.limit(0), ["s"]).count() == 0


def test_running_sums_runs_and_sessions_across_chunks(spark):
    r = random.Random(8)
    rows = [("hot" if i % 10 else None, round(r.uniform(-20, 300), 2), i, r.randrange(3)) for i in range(400)]
    d = spark.createDataFrame([(*x, "clash") for x in rows], "k string, t double, i int, v int, session string").drop("session")
    got = {x["i"]: x["s"] for x in S.running(d, ["k"], ["t", "i"], "v", "s", width=7.0).collect()}
    for k in ("hot", None):
        total, new, before = 0, 0, None
        sessions = {x["i"]: x["session"] for x in S.sessions(d, ["k"], ["t", "i"], 1.5).collect()}
        for t, i, v in sorted((t, i, v) for kk, t, i, v in rows if kk == k):
            total += v
            new += before is not None and t - before > 1.5
            before = t
            assert got[i] == total and sessions[i] == new
    runs = S.runs(d, ["k"], ["t", "i"], F.col("v") > 0).collect()
    want = 0
    for k in ("hot", None):
        states = [v > 0 for t, i, v in sorted((t, i, v) for kk, t, i, v in rows if kk == k)]
        want += sum(a != b for a, b in zip([None, *states], states))
    assert len(runs) == want and sum(x["n"] for x in runs) == 400
