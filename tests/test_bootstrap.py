import numpy as np

from lodestrata.operators import robust as R


def test_interval_against_numpy(spark):
    r = np.random.default_rng(5)
    groups = {"a": r.normal(50, 9, 202), "b": r.exponential(30, 180), "c": r.normal(0, 1, 207), "one": np.array([7.0])}
    rows = [(k, i, float(x)) for k, v in groups.items() for i, x in enumerate(v)] + [("a", 999, float("nan"))]
    d = spark.createDataFrame(rows, "k string, i long, v double")
    got = {x["k"]: x for x in R.bootstrap_mean_ci(d, ["k"], "v", "i").collect()}
    assert got["one"]["lo"] == got["one"]["hi"] == 7.0
    for k in "abc":
        v = groups[k]
        lo, hi = np.percentile(v[np.random.default_rng(0).integers(0, len(v), (2000, len(v)))].mean(axis=1), [2.5, 97.5])
        assert got[k]["n"] == len(v) and abs(got[k]["lo"] - lo) < 0.1 * (hi - lo) and abs(got[k]["hi"] - hi) < 0.1 * (hi - lo)


def test_blocks_and_parts_do_not_change_the_interval(spark):
    d = spark.createDataFrame([("a", i, float(i * i % 97)) for i in range(300)], "k string, i long, v double")
    a, b = (R.bootstrap_mean_ci(d, ["k"], "v", "i", 200, block=x, part=y).first() for x, y in ((64, 7), (1 << 17, 50)))
    assert np.allclose([a["lo"], a["hi"]], [b["lo"], b["hi"]])


def test_draws_are_with_replacement():
    n = 202
    for b in range(20):
        i = R.mixed(R.mixed(np.arange(n)) ^ R.mixed(np.array([b * R.SEED_STEP + 12345]) & 0xFFFFFFFF)) % n
        assert 0.5 < len(set(i)) / n < 0.76  # 1 - 1 / e is 0.63
