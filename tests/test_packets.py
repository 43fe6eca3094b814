import numpy as np

from lodestrata.operators import estimators as E
from lodestrata.operators import measures as M
from lodestrata.operators import packets as P
from lodestrata.operators import rotations as R
from lodestrata.streaming import cues
from pyspark.sql import functions as F


def test_normalized_equals_rotations(spark):
    r = np.random.default_rng(1)
    q, g, a = R.unit(r.normal(size=4)), r.normal(size=(6, 3)), r.normal(size=(6, 3))
    rows = [(i, *map(float, x), *map(float, y), i % 2 == 1, i == 4) for i, (x, y) in enumerate(zip(g, a))]
    d = spark.createDataFrame(rows, "i int, gx double, gy double, gz double, ax double, ay double, az double, left boolean, done boolean")
    got = P.normalized(d, ["gx", "gy", "gz"], ["ax", "ay", "az"], [F.lit(float(x)) for x in q], F.col("left"), F.col("done")).orderBy("i").collect()
    for i, row in enumerate(got):
        x, y = (g[i], a[i]) if i == 4 else (R.rotate(q, g[i]), R.rotate(q, a[i]))
        if i % 2:
            x, y = x * [1, -1, -1], y * [-1, 1, 1]
        assert np.allclose([row["gx"], row["gy"], row["gz"], row["ax"], row["ay"], row["az"]], [*x, *y])


def test_bias_within_bounds_and_only_if_it_helps(spark):
    rows = [("in", 0.1, True)] * 5 + [("cut", 0.5, True)] * 5 + [("none", 0.2 * (-1) ** i, True) for i in range(6)] + [("moving", 3.0, False), ("null", None, True)]
    got = {r["k"]: (round(r["bias"][0], 6), round(r["gain"], 3), r["n"]) for r in P.bounded_bias(spark.createDataFrame(rows, "k string, x double, rest boolean"), ["k"], ["x"], F.col("rest")).collect()}
    assert got == {"in": (0.1, 1.0, 5), "cut": (0.2, 0.64, 5), "none": (0.0, 0.0, 6), "moving": (0.0, 0.0, 0), "null": (0.0, 0.0, 1)}


def test_resonance_is_taken_off(spark):
    n, dt, om, z = 4000, 1e-4, 2 * np.pi * 60, 0.3
    u = (np.arange(n) * dt > 0.05).astype(float)
    y, v = np.zeros(n), 0.0
    for i in range(1, n):
        v += dt * om**2 * (u[i - 1] - y[i - 1] - 2 * z / om * v)
        y[i] = y[i - 1] + dt * v
    d = spark.createDataFrame([("s", i * dt, float(x)) for i, x in enumerate(y)], "k string, t double, v double")
    got = np.array([r["straight"] for r in P.without_resonance(d, ["k"], "t", "v", 60.0, z).orderBy("t").collect()])
    assert np.abs(y - u).max() > 0.3 and np.abs(got - u)[600:].max() < 0.05


def test_channels_of_a_turn_about_the_axis(spark):
    n = 400
    t = np.arange(n) / 200
    w = np.where((t > 0.5) & (t < 1.5), 2.0, 0.0)
    d = spark.createDataFrame([(k, float(x), float(y) if k == "twist" else 0.0, 0.0, 0.0 if k == "twist" else float(y), 0.0, 0.0, 9.80665) for k in ("twist", "swing") for x, y in zip(t, w)], "k string, t double, gx double, gy double, gz double, ax double, ay double, az double")
    got = {r["k"]: r for r in P.segment_channels(d, ["k"], "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], flt="gyro").collect()}
    assert abs(got["twist"]["twist_range"] - np.degrees(2)) < 1 and got["twist"]["swing_range"] < 0.1 and abs(got["twist"]["twist_rate"] - np.degrees(2)) < 1
    assert got["swing"]["twist_range"] < 0.1 and abs(got["swing"]["swing_range"] - np.degrees(2)) < 1


def test_measures_on_small_frames(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first()["x"]
    arr = lambda *v: F.array(*(F.lit(x) for x in v)).cast("array<double>")
    assert f(M.fuse_confidence(arr(0.2, None, 0.6))) == 0.4 and f(M.fuse_confidence(F.array().cast("array<double>"))) == 0.2
    assert abs(f(M.fuse_confidence(arr(0.2, 0.8), arr(3.0, 1.0))) - 0.35) < 1e-12 and f(M.fuse_confidence(arr(0.99))) == 0.95
    assert f(M.reasons_in_order(F.array(F.lit("b"), F.lit(""), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("c")))) == ["b", "a", "c"]
    assert f(M.blended(F.lit(0.0), F.lit(10.0), F.lit(0.9))) == 3.0
    assert f(M.truncate_at_paragraph(F.lit("a" * 36 + "\n\n" + "b" * 40), 10)) == "a" * 36 and f(M.truncate_at_paragraph(F.lit("x"), 10)) == "x"
    assert f(M.parent_classes(F.lit("class A(B, c.D, metaclass=M)"))) == ["B", "c.D"] and f(M.parent_classes(F.lit("public class A extends B implements C {"))) == ["B"]
    s = spark.createDataFrame([("k", 1.0), ("k", 5.0), ("k", None), ("j", 1.0)], "k string, t double")
    w = spark.createDataFrame([("k", 0.0, 3.0, "w1"), ("k", 5.0, 5.0, "w2"), ("k", 9.0, 2.0, "w3"), ("k", None, 1.0, "w4")], "k string, lo double, hi double, name string")
    assert {(r["t"], r["name"]) for r in M.in_windows(s, w, ["k"], "t", "lo", "hi", 2.0).collect()} == {(1.0, "w1"), (5.0, "w2")}


def test_cues_wait_two_seconds_and_drop_what_is_late():
    t = np.arange(0, 8, 0.01)
    w = np.where((t % 2.5) < 0.6, 4.0, 0.1)
    for b in (100, 160, 350, 600):
        w[b : b + 10] = np.linspace(0.1, 12, 10)
    state, found = cues.cues_of(t, w)
    at = [c[0] for c in found]
    assert len(at) >= 2 and all(y - x >= cues.REFRACTORY for x, y in zip(at, at[1:])) and state[5] == at[-1]
    half = 355
    first, a = cues.cues_of(t[:half], w[:half])
    _, b = cues.cues_of(t[half:], w[half:], first)
    assert a + b == found


def test_streamed_filter_equals_the_batch(spark, data, tmp_path):
    m = spark.read.parquet(f"{data}/motion.parquet").where("session_id is not null and t is not null").selectExpr("session_id", "t", "cast(coalesce(gyro_x, 0) as double) gx", "cast(coalesce(gyro_y, 0) as double) gy", "cast(coalesce(gyro_z, 0) as double) gz", "cast(coalesce(gravity_x, 0) as double) ax", "cast(coalesce(gravity_y, 0) as double) ay", "cast(coalesce(gravity_z, 0) as double) az").dropDuplicates(["session_id", "t"])
    m.repartition(1).sortWithinPartitions("t").write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "in"))
    from lodestrata.session import Workspace

    got = cues.drain(cues.streamed_orientations(s), Workspace(spark), "o").toPandas().sort_values(["session_id", "t"])
    want = m.toPandas().sort_values(["session_id", "t"]).reset_index(drop=True)
    assert len(got) == len(want)
    starts = np.flatnonzero(np.r_[True, want["session_id"].to_numpy()[1:] != want["session_id"].to_numpy()[:-1]])
    q = E.FILTERS["complementary"]().run_many(want["t"].to_numpy(), want[["gx", "gy", "gz"]].to_numpy(), want[["ax", "ay", "az"]].to_numpy(), starts)
    assert np.allclose(got[["qw", "qx", "qy", "qz"]].to_numpy(), q, atol=1e-9)
