import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import percentiles as P

SCHEMA = "g string, h string, value double, v int, part string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(g, h, v, 1, "clash") for g, h, v in rows], SCHEMA).repartition(parts)


def errors(rows, got, g):
    vals = np.sort([v for k, _, v in rows if k == g and v is not None and np.isfinite(v)])
    for r in got:
        if r["g"] != g:
            continue
        assert r["n"] == len(vals)
        target = r["p"] * (len(vals) - 1) + 1
        lo, hi = np.searchsorted(vals, r["value"], "left") + 1, np.searchsorted(vals, r["value"], "right")
        assert lo <= hi, "a value of the data"
        yield max(lo - target, target - hi, 0)


@pytest.mark.parametrize("kind", ["smooth", "ties", "two humps", "negative"])
def test_rank_error_is_within_the_bound(spark, kind):
    r = random.Random(kind)
    draw = {"smooth": lambda: r.lognormvariate(0, 2), "ties": lambda: float(r.randrange(7)) if r.random() < 0.9 else r.random(), "two humps": lambda: r.gauss(r.choice([-5, 50]), 1), "negative": lambda: -r.paretovariate(1)}[kind]
    rows = [("a", "x", draw()) for _ in range(4000)] + [("b", "x", draw()) for _ in range(30)]
    s = P.summarize(frame(spark, rows), [("s", ("g",))], "value", eps=0.02)
    assert s.where("g = 'a'").count() < 2000
    got = P.quantiles(s, ["g"], [0.0, 0.05, 0.5, 0.95, 1.0]).collect()
    assert len(got) == 10
    assert max(errors(rows, got, "a")) <= 0.02 * 4000
    assert max(errors(rows, got, "b")) <= 1


def test_combined_days_equal_the_whole_within_the_added_bounds(spark):
    r = random.Random(5)
    rows = [("a", f"d{r.randrange(12)}", r.gauss(0, 1)) for _ in range(3000)]
    days = P.summarize(frame(spark, rows), [("d", ("g", "h"))], "value", eps=0.01)
    whole = P.combine(days.select("g", "v", "up", "down", "eps"), ["g"], eps=0.01)
    got = P.quantiles(whole, ["g"], [0.1, 0.5, 0.9]).collect()
    assert {round(x["eps"], 6) for x in got} == {0.02}
    assert max(errors(rows, got, "a")) <= 0.02 * 3000


def test_several_scopes_nulls_and_non_finite(spark):
    rows = [("a", None, 1.0), ("a", None, float("nan")), ("a", "x", float("inf")), ("a", "x", None), ("b", "x", -0.0), ("b", "x", 0.0), (None, None, 3.0)]
    s = P.summarize(frame(spark, rows, 1), [("one", ("g",)), ("two", ("g", "h"))], "value")
    got = {(r["scope"], r["g"], r["h"]): (r["n"], r["value"]) for r in P.quantiles(s, ["scope", "g", "h"], [0.5]).collect()}
    assert got == {("one", "a", None): (1, 1.0), ("one", "b", None): (2, 0.0), ("one", None, None): (1, 3.0), ("two", "a", None): (1, 1.0), ("two", "b", "x"): (2, 0.0), ("two", None, None): (1, 3.0)}


def test_empty(spark):
    s = P.summarize(frame(spark, [], 1), [("s", ("g",))], "value")
    assert s.count() == 0 and P.quantiles(s, ["g"], [0.5]).count() == 0
    assert P.summarize(frame(spark, [("a", "x", None)], 1), [("s", ("g",))], "value").agg(F.count("*")).first()[0] == 0


def test_levels_follow_the_partitions():
    assert P.levels_of(1) == P.levels_of(64) == [1]
    assert P.levels_of(65) == [2, 1] and P.levels_of(1_000_000) == [15_625, 245, 4, 1]


def test_many_partitions_and_groups_over_batches(spark):
    r = random.Random(9)
    rows = [("a" if i % 10 else f"g{i % 70}", "x", r.gauss(0, 1)) for i in range(30_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        s = P.summarize(frame(spark, rows, 130), [("s", ("g",))], "value", eps=0.02)
        got = P.quantiles(s, ["g"], [0.05, 0.5, 0.95]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * len({g for g, _, _ in rows})
    assert max(errors(rows, got, "a")) <= 0.02 * 27_000
