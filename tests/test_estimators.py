import numpy as np
import pytest

from lodestrata.operators import estimators as E
from lodestrata.operators import rotations as R
from lodestrata.streaming import cues


@pytest.mark.parametrize("name", sorted(E.FILTERS))
def test_rest_keeps_gravity_up_and_quaternions_unit(name):
    n = 100
    q = E.FILTERS[name]().run(np.arange(n) / 100, np.zeros((n, 3)), np.tile([0, 0, E.G], (n, 1)))
    assert np.allclose(np.linalg.norm(q, axis=1), 1) and abs(E.rotate(q[-1], np.array([0, 0, 1.0]))[2]) > 0.999


def test_gyro_integration_of_a_quarter_turn():
    n = 201
    g = np.tile([0, 0, np.pi / 2], (n, 1))
    q = E.Filter().run(np.arange(n) / 200, g, np.tile([0, 0, E.G], (n, 1)))
    assert np.allclose(E.rotate(q[-1], np.array([1.0, 0, 0])), [0, 1, 0], atol=1e-6)


def test_nan_readings_do_not_spread():
    f = E.Mahony()
    f.reset(np.array([0, 0, E.G]))
    assert np.isfinite(f.update(np.array([np.nan, 0, np.inf]), np.array([0, np.nan, 1.0]), 0.01)).all()


def test_fits_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = 2 * x[:, 0] - 3 * x[:, 1] + 1 + r.normal(size=300) * 0.01
    p = np.c_[x, 0.5 * x[:, 0] + r.normal(size=300) * 0.001]
    d = spark.createDataFrame([("g", *map(float, a), float(b), float(c)) for a, b, c in zip(x, y, p[:, 2])], "k string, a double, b double, y double, c double")
    fit = E.ridge(d, ["k"], ["a", "b"], "y").first()
    assert np.allclose(fit["coefficients"], [2, -3], atol=0.01) and abs(fit["intercept"] - 1) < 0.01
    n = E.plane_fit(d, ["k"], ["a", "b", "c"]).first()["normal"]
    assert np.allclose(n, np.array([-0.5, 0, 1]) / np.linalg.norm([-0.5, 0, 1]), atol=0.01)


def turning(n=400, seed=3):
    """Times, rates and orientations of a smooth turn."""
    t = np.arange(n) / 400
    w = np.c_[np.sin(9 * t), np.cos(7 * t), 2 * np.sin(5 * t + 1)] * 4 * np.minimum(1, t / 0.3)[:, None] ** 3
    q = np.empty((n, 4))
    q[0] = R.unit(np.array([0.9, 0.2, -0.3, 0.1]))
    for i in range(1, n):
        q[i] = R.unit(R.multiply(q[i - 1], R.exponential((w[i] + w[i - 1]) / 2 * (t[i] - t[i - 1]))))
    return t, w, q


def test_lever_arm_recovers_the_arm_under_gravity(spark):
    t, w, q = turning()
    dw, arm = np.gradient(w, t, axis=0), np.array([0.3, -0.2, 0.5])
    a = np.cross(w, np.cross(w, arm)) + np.cross(dw, arm) + R.rotate(R.conjugate(q), np.array([0, 0, E.G]))
    got, rank, rms = E.arm_of(t, q, w, a)
    assert rank == 3 and np.allclose(got, arm, atol=1e-3) and rms < 0.05
    d = spark.createDataFrame([("s", float(x), *map(float, p), *map(float, z)) for x, p, z in zip(t, w, a)], "k string, t double, gx double, gy double, gz double, ax double, ay double, az double")
    row = E.lever_arm(d, ["k"], "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], "gyro").first()
    assert row["n"] == 400 and row["rank"] == 3 and np.allclose(row["arm"], arm, atol=0.03)
    a[::40] += 80  # a few wrong readings
    assert np.allclose(E.arm_of(t, q, w, a)[0], arm, atol=0.12)


def test_kalman_learns_a_bias_and_finds_the_vertical():
    n = 2000
    f = E.Kalman()
    a = np.tile(R.rotate(R.exponential(np.array([0.2, 0, 0])), np.array([0, 0, E.G])), (n, 1))
    q = f.run(np.arange(n) / 100, np.tile([0.02, -0.01, 0.0], (n, 1)), a)
    assert np.degrees(np.arccos(R.unit(R.rotate(q[-1], a[-1]))[2])) < 0.5
    assert np.allclose(f.bias[..., :2], [0.02, -0.01], atol=0.006)


def test_smoothing_takes_off_what_drifts():
    t, w, q = turning(800)
    a = R.rotate(R.conjugate(q), np.array([0, 0, E.G]))
    biased = w + 0.05
    plain = E.Filter().run(t, biased, a)
    both = E.smooth_both_ways("gyro", t, biased, a)
    assert np.allclose(R.norm(both), 1) and np.allclose(both[-1], plain[-1])
    assert np.allclose(E.smooth_both_ways("mahony", t, w, a)[0][:1], E.Mahony().run(t, w, a)[0][:1], atol=0.2)


def test_series_stepped_together_equal_each_by_itself():
    r = np.random.default_rng(2)
    sizes = [5, 1, 40, 17]
    t = np.concatenate([np.cumsum(r.uniform(0.005, 0.02, n)) for n in sizes])
    g, a = r.normal(size=(len(t), 3)), r.normal(size=(len(t), 3)) + [0, 0, 9]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    for name, make in E.FILTERS.items():
        q = make().run_many(t, g, a, starts)
        for s, n in zip(starts, sizes):
            assert np.allclose(q[s : s + n], make().run(t[s : s + n], g[s : s + n], a[s : s + n])), name


def test_spans_of_a_long_group_give_what_the_whole_gives(spark):
    r = np.random.default_rng(4)
    n = 3000
    t = np.arange(n) / 50
    w = np.c_[np.sin(t), np.cos(0.7 * t), 0.5 * np.sin(0.3 * t)] * 0.5
    q = E.Filter().run(t, w, np.tile([0, 0, E.G], (n, 1)))
    a = R.rotate(R.conjugate(q), np.array([0, 0, E.G])) + r.normal(size=(n, 3)) * 0.05
    rows = [("s", float(x), *map(float, p), *map(float, z)) for x, p, z in zip(t, w, a)]
    d = spark.createDataFrame(rows + rows[:40] + [("u", 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.8), ("u", None, 0.0, 0.0, 0.0, 0.0, 0.0, 9.8)], "k string, t double, gx double, gy double, gz double, ax double, ay double, az double")
    arg = (["k"], "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], ["gyro", "complementary", "mahony"])
    one = {(x["k"], x["filter"]): x for x in E.orientations(d, *arg).collect()}
    cut = {(x["k"], x["filter"]): x for x in E.orientations(d, *arg, span=10.0, margin=5.0).collect()}
    assert set(one) == set(cut) and all(one[k]["n"] == cut[k]["n"] == (n if k[0] == "s" else 1) for k in one)
    for k in one:
        assert abs(one[k]["turn_deg"] - cut[k]["turn_deg"]) < 1.0 and abs(one[k]["tilt_deg"] - cut[k]["tilt_deg"]) < 0.5
    assert abs(one["s", "gyro"]["turn_deg"] - np.degrees(R.geodesic(q[0], q[-1]))) < 1e-6


def test_rotations():
    r = np.random.default_rng(0)
    q, p, v = R.unit(r.normal(size=(50, 4))), R.unit(r.normal(size=(50, 4))), r.normal(size=(50, 3))
    assert np.allclose(np.einsum("nij,nj->ni", R.matrix(q), v), R.rotate(q, v))
    assert np.allclose(np.abs(R.dot(R.exponential(R.logarithm(q)), q)), 1)
    assert np.allclose(R.rotate(R.shortest(v, R.UP), v), R.norm(v)[:, None] * R.UP)
    assert np.allclose(R.geodesic(q, R.slerp(q, p, np.full(50, 0.25))), R.geodesic(q, p) / 4)
    swing, twist = R.swing_twist(q, np.array([0, 0, 1.0]))
    assert np.allclose(R.multiply(swing, twist), q) and np.allclose(twist[:, 1:3], 0)
    assert np.allclose(R.rotate(R.mirror(q), v * [-1, 1, 1]), R.rotate(q, v) * [-1, 1, 1])
    yaw = R.exponential(np.array([0, 0, 0.7]))
    assert np.allclose(R.yaw_between(q, R.multiply(yaw, q)), yaw)
    assert R.six(q).shape == (50, 6) and np.allclose(R.shortest(-R.UP, R.UP)[0], 0)


def test_stream_equals_batch(spark, data):
    from lodestrata.plans import motion_queries as M

    a = sorted(map(tuple, M.QUERIES["stream_transition_cue"](spark, data).collect()))
    assert a == sorted(map(tuple, M.QUERIES["batch_transition_cue"](spark, data).collect()))


def test_one_cue_a_session():
    t = np.arange(0, 3, 0.01)
    w = np.where(t < 1, 4.0, 0.1)
    w[150:160] = np.linspace(0.1, 12, 10)
    w[200:210] = np.linspace(0.1, 12, 10)
    assert len(cues.cues_of(t, w)[1]) == 1
