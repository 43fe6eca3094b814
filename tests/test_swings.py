import numpy as np
import pytest

from pyspark.sql import functions as F

from lodestrata.operators import estimators as E
from lodestrata.operators import evaluation, latent, segmentation, trajectory
from lodestrata.operators import rotations as R
from lodestrata.sources import manifest, synthetic


@pytest.fixture(scope="module")
def swing():
    return synthetic.swing()


def test_generator_agrees_with_itself(swing):
    t, p, q = swing["t"], swing["position"], swing["orientation"]
    k = swing["phases"][2] - 5
    acc = np.gradient(np.gradient(p, t, axis=0), t, axis=0)[5 : k - 5] + [0, 0, synthetic.G]
    assert np.allclose(R.rotate(R.conjugate(q), np.array([0, 0, 1.0]))[0], swing["accel"][0] / synthetic.G)
    assert np.abs(R.rotate(R.conjugate(q[5 : k - 5]), acc) - swing["accel"][5 : k - 5]).max() < 2.5
    found = E.Filter().run(t, swing["gyro"], swing["accel"])
    assert evaluation.orientation_error(found, q).max() < 5


def test_arm_and_paths_of_a_perfect_swing(swing):
    q, t = swing["orientation"], swing["t"]
    lo, hi = swing["phases"][0], swing["phases"][2] - 3
    arm, rank, rms = E.arm_of(t[lo:hi], q[lo:hi], swing["gyro"][lo:hi], swing["accel"][lo:hi])
    assert rank >= 2 and abs(np.linalg.norm(arm) - 0.45) < 0.05
    path, how = trajectory.hybrid(t, q, swing["gyro"], swing["accel"], (lo, hi))
    assert how == "lever" and evaluation.position_error(path, swing["position"][lo : hi + 1]).max() < 0.1
    assert trajectory.hybrid(t, q, swing["gyro"], swing["accel"] * 40, (lo, hi))[1] == "assumed"


def test_levels_of_error_grade_the_results(spark):
    r = evaluation.summary(evaluation.orientation_results(synthetic.cases(spark, ["ideal", "worn"], 2, 2))).collect()
    mean = {(x["algorithm"], x["level"]): x["mean"] for x in r if x["metric"] == "mean_deg"}
    assert {x["n"] for x in r} == {4} and len(mean) == 2 * len(E.FILTERS)
    assert mean["gyro", "ideal"] < 2 < mean["gyro", "worn"] < 60
    e = {(x["metric"], x["level"]): x["mean"] for x in evaluation.summary(evaluation.event_results(synthetic.cases(spark, ["ideal"], 4, 2))).collect()}
    assert e["impact_ms", "ideal"] <= 15 and e["failed", "ideal"] == 0 and e["top_ms", "ideal"] < 60
    p = {x["algorithm"]: x["mean"] for x in evaluation.summary(evaluation.trajectory_results(synthetic.cases(spark, ["ideal"], 2, 2))).collect()}
    assert p["hybrid"] < 30 and set(p) == {"hybrid", "lever", "rests"}
    s = {x["scale"]: x["value"] for x in evaluation.sweep_results(synthetic.sweep(spark, (0, 3), 1), swings_each=1).collect()}
    assert s[0.0] < s[3.0]


def test_gates_and_case_means(spark):
    d = spark.createDataFrame([("t", "a", "l", 0, 0, "m", 1.0), ("t", "a", "l", 0, 0, "m", 3.0), ("t", "a", "l", 0, 1, "m", 8.0), ("t", "a", "l", 0, 2, "m", float("nan"))], evaluation.RESULT)
    s = evaluation.summary(d)
    assert s.first()["mean"] == 4.0 and s.first()["n"] == 3
    assert evaluation.mean_of_case_means(d.where("not isnan(value)"), ["track"], ["seed", "k"]).first()["mean"] == 5.0
    b = spark.createDataFrame([("t", "l", "m", 3.5), ("t", "l", "other", 1.0)], "track string, level string, metric string, max_value double")
    assert {(r["metric"], r["mean"]) for r in evaluation.gate_violations(s, b).collect()} == {("m", 4.0), ("other", None)}


def test_phases_lie_near_the_truth(swing):
    p = segmentation.segment(swing["t"], swing["gyro"], swing["accel"])
    assert p[0] < p[1] < p[2] < p[3] and p[4] == "collision"
    assert abs(swing["t"][p[2]] - swing["t"][swing["phases"][2]]) <= 0.02
    assert abs(swing["t"][p[1]] - swing["t"][swing["phases"][1]]) <= 0.05


def test_a_hint_overrides_and_few_samples_have_none(swing):
    k = int(swing["phases"][2]) + 2
    assert segmentation.segment(swing["t"], swing["gyro"], swing["accel"], hint=k)[2] == k
    assert segmentation.segment(swing["t"][:10], swing["gyro"][:10], swing["accel"][:10]) is None


def test_smoothing_and_filter():
    x = np.arange(10.0)
    for m in (1, 2, 3, 12):
        assert len(segmentation.smooth(x, m)) == 10
    assert np.allclose(segmentation.smooth(np.ones(5), 9), 1)
    fs = 400
    t = np.arange(800) / fs
    b, a = segmentation.butterworth2(35, fs)
    assert np.abs(segmentation.both_ways(np.sin(2 * np.pi * 2 * t), b, a)[200:600]).max() < 0.02
    fast = np.sin(2 * np.pi * 120 * t)
    assert abs(np.abs(segmentation.both_ways(fast, b, a)[200:600]).max() / np.abs(fast).max() - 1) < 0.05


def test_rest_bias_and_address(swing):
    g, a = swing["gyro"] + 0.01, swing["accel"]
    rest = segmentation.rest_mask(g, a, 200)
    assert rest[:20].all() and not rest[swing["phases"][1] + 20 : swing["phases"][2]].any()
    assert np.allclose(segmentation.gyro_bias(g, rest), 0.01, atol=0.05)
    at, mean, quality = segmentation.address_window(g, a, 200)
    assert at < 80 and quality == "good" and abs(np.linalg.norm(mean) - synthetic.G) < 0.5


def test_dead_reckoning_of_a_move_between_rests():
    t = np.arange(0, 3, 0.005)
    v = np.where((t > 1) & (t < 2), np.sin(np.pi * (t - 1)) ** 2, 0.0)
    acc = np.c_[np.gradient(v, t) + 0.05, 0 * t, 0 * t]
    rest = (t < 1) | (t > 2)
    p = trajectory.dead_reckon(t, acc, rest)
    assert abs(p[-1, 0] - 0.5) < 0.03
    far = np.c_[np.gradient(v, t) - np.gradient(np.roll(v, 0), t) + 0.05, 0 * t, 0 * t]
    assert np.abs(trajectory.constrained(t, far, rest)).max() < 0.01


def test_plane_and_circle():
    a = np.linspace(0, 4, 60)
    c = trajectory.plane_circle(np.c_[np.cos(a) * 2 + 1, np.sin(a) * 2, 0.5 * np.cos(a) * 0 + 3])
    assert abs(c.radius - 2) < 1e-6 and np.allclose(c.normal, [0, 0, 1]) and np.allclose(c.center, [1, 0, 3])
    assert trajectory.plane_circle(np.zeros((2, 3))) is None


def test_slip():
    e = np.eye(3)
    assert trajectory.slip_score([(e[0], 3), (e[0], 3)], e[0]) == (0.0, False)
    assert trajectory.slip_score([(e[0], 3), (e[1], 3)], e[0])[1]


def test_latent_regression_and_validity(spark):
    r = np.random.default_rng(0)
    z = r.standard_normal((400, 3))
    x, y = z @ r.standard_normal((3, 20)) + 0.01 * r.standard_normal((400, 20)), z @ r.standard_normal((3, 6))
    d = spark.createDataFrame([(i, a.tolist(), b.tolist(), "clash") for i, (a, b) in enumerate(zip(x, y))] + [(900, None, [0.0] * 6, ""), (901, [float("nan")] * 20, [0.0] * 6, "")], "id int, x array<double>, y array<double>, residual string")
    m = latent.fit(d, "x", "y", (20, 6), "id")
    got = latent.predict(d.where("id < 900"), m, "x", ["id", "y"]).collect()
    assert np.mean([np.abs(np.subtract(g["prediction"], g["y"])).mean() for g in got]) < 0.1
    assert sum(g["validity"] == "ok" for g in got) > 300
    far = spark.createDataFrame([(1, [1e6] * 20)], "id int, x array<double>")
    assert latent.predict(far, m, "x", ["id"]).first()["validity"] == "abstain"
    with pytest.raises(ValueError, match="no rows"):
        latent.fit(d.where("id > 1000"), "x", "y", (20, 6), "id")
    out = latent.held_out_groups(d.where("id < 400").withColumn("g", (F.col("id") % 2).cast("string")), "g", "x", "y", (20, 6), "id", ["0", "1"]).collect()
    assert {g["g"]: g["n"] for g in out} == {"0": 200, "1": 200} and all(g["mean_abs_error"] < 0.2 for g in out)


def test_personal_lines(spark):
    rows = [("few", 1.0, 1.0), ("few", 2.0, 9.0), *[("flat", 1.0, 3.0)] * 5, *[("line", float(i), 2.0 * i + 1) for i in range(6)], ("line", 1.0, float("nan")), ("line", None, 1.0), ("none", None, None)]
    got = {r["k"]: (r["n"], round(r["slope"], 9), round(r["offset"], 9)) for r in latent.personal_lines(spark.createDataFrame(rows, "k string, p double, m double"), ["k"], "p", "m").collect()}
    assert got == {"few": (2, 1.0, 0.0), "flat": (5, 1.0, 2.0), "line": (6, 1.85, 0.85), "none": (0, 1.0, 0.0)}


def test_errors_in_order(swing):
    t, g, a = synthetic.inject(swing["t"], swing["gyro"], swing["accel"], synthetic.Errors(), 1)
    assert np.allclose(g, swing["gyro"]) and np.allclose(a, swing["accel"])
    _, g, _ = synthetic.inject(swing["t"], swing["gyro"], swing["accel"], synthetic.Errors(clip=2.0, dropout=0.3, step=0.5), 1)
    assert np.abs(g).max() <= 2 and np.allclose(g % 0.5 % 0.5, 0)


def test_swings_sweep_and_latent_on_spark(spark, data):
    s = synthetic.swings(spark, 3)
    assert s.select("swing_id").distinct().count() == 3
    assert synthetic.sweep(spark).count() == 30
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    m = latent.fit(e.withColumn("y", F.slice("embedding", 1, 5)), "embedding", "y", (64, 5), "vec_id")
    assert latent.predict(e, m, "embedding", ["vec_id"]).count() == e.count()
    assert len(latent.student(e, "embedding", "label", 64, width=8).first()["coefficients"]) == 8
    assert len(latent.random_features(e, "embedding", 64).first()["hidden"]) == 128


def test_manifest(spark):
    schema = "record_id string, subject_pseudonym string, device struct<model:string>, capture_mode string, handedness string, wrist string, rates struct<accelerometer_hz:double,device_motion_hz:double>, session struct<captured_at_date:string>, capture struct<path:string,sha256:string>, reference struct<impact_timestamp_source:string>"
    good = ("a", "s", ("m",), "compat", "left", "lead", (100.0, 100.0), ("2026-01-01",), ("p", "0" * 64), ("slow_mo",))
    rows = [good, ("b", None, ("m",), "fast", "left", "lead", (100.0, 100.0), ("1.1.26",), ("p", "zz"), ("",)), ("c", *good[1:]), ("c", *good[1:])]
    d = spark.createDataFrame(rows, schema)
    m = spark.createDataFrame([("a", "1" * 64, 150.0, 101.0)], "record_id string, sha256 string, accelerometer_hz double, device_motion_hz double")
    got = {(r["record_id"], r["rule"]) for r in manifest.violations(d, m).collect()}
    assert got == {("a", "tampered hash"), ("a", "wrong accelerometer_hz"), ("b", "missing subject_pseudonym"), ("b", "unknown capture_mode"), ("b", "malformed hash"), ("b", "malformed date"), ("b", "missing reference.impact_timestamp_source"), ("c", "repeated record_id")}
    a, b = (spark.createDataFrame(r, "label string, seal string") for r in ([("x", "1"), ("y", "2"), ("z", "3")], [("x", "1"), ("y", "9"), ("w", "4")]))
    assert {r["label"]: r["status"] for r in manifest.verify_seals(a, b).collect()} == {"x": "ok", "y": "changed", "z": "missing", "w": "unsealed"}
