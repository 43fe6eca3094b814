import math
import random

from lodestrata.operators import spikes as S

SCHEMA = "session_id string, i int, t double, x float, y float, k string, c int, impossible string"


def series(n=600, sd=0.01, seed=3, session="a", rate=100.0):
    r = random.Random(seed)
    return [[session, i, 100 + i / rate, r.gauss(0, sd) + 3 * math.sin(i / 40), r.gauss(0.5, sd)] for i in range(n)]


def found(spark, rows, **kw):
    d = spark.createDataFrame([(*r, "clash", 1, "no") for r in rows], SCHEMA)
    return {(r["session_id"], r["i"]): sorted(r["reasons"]) for r in S.implausible(d, ["x", "y"], 40.0, True, **kw).collect()}


def test_each_kind(spark):
    rows = series()
    rows[100][4] += 0.4  # one reading
    rows[200][3] -= 0.5
    rows[201][3] -= 0.6  # two in succession
    for i in range(300, 330):
        rows[i][4] = rows[300][4]  # held
    rows[400][3] = float("inf")
    rows[401][4] = 999.0
    rows[402][3] = None  # a null is no case
    rows[450][2] = rows[449][2] - 1  # clock steps back
    for i in range(500, 504):
        rows[i][2] = rows[500][2]
    want = {100: ["spike"], 200: ["spike"], 201: ["spike"], 400: ["impossible"], 401: ["impossible"], 450: ["clock"], **{i: ["stuck"] for i in range(300, 330)}, **{i: ["clock"] for i in range(500, 504)}}
    assert found(spark, rows) == {("a", i): w for i, w in want.items()}


def test_copies_order_and_gaps_change_nothing(spark):
    rows = series()
    rows[100][4] += 0.4
    for i in range(350, 600):
        rows[i][2] += 5  # a gap, after which the movement is elsewhere
        rows[i][3] += 2
    shuffled = rows + rows[50:150]
    random.Random(1).shuffle(shuffled)
    assert found(spark, rows) == found(spark, shuffled) == {("a", 100): ["spike"]}


def test_movement_is_none(spark):
    rows = [[s, i, i / 100, 8 * math.sin(i / 3) + random.Random(i).gauss(0, 0.01), 0.1 * (i % 7)] for s in ("m",) for i in range(400)]
    assert not {k for k, v in found(spark, rows).items() if "spike" in v}


def test_chunk_borders(spark):
    rows = series(n=S.CHUNK + 400, seed=9)
    rows[S.CHUNK][4] += 0.5
    rows[S.CHUNK - 1][3] += 0.5
    for i in range(S.CHUNK - 30, S.CHUNK - 10):
        rows[i][4] = 0.25
    got = found(spark, rows)
    assert set(got) == {("a", i) for i in (S.CHUNK, S.CHUNK - 1, *range(S.CHUNK - 30, S.CHUNK - 10))}


def test_empty_small_and_null(spark):
    assert found(spark, []) == {}
    assert found(spark, [["a", 0, 1.0, 1.0, 1.0], ["a", 1, None, None, None], [None, 2, 1.0, 1.0, 1.0], ["a", None, 1.0, 500.0, 1.0]]) == {}
    assert found(spark, [["a", 0, 1.0, float("nan"), 1.0]]) == {("a", 0): ["impossible"]}


def test_a_long_run_that_chance_explains_is_none(spark):
    r = random.Random(5)
    level, rows = 0.0, []
    for i in range(9000):  # a coarse sensor that changes every fortieth reading or so
        if r.random() < 0.025:
            level = round(r.gauss(0, 0.3), 1)
        rows.append(["a", i, i / 100, level, r.gauss(0, 0.01)])
    for i in range(3000, 3300):
        rows[i][3] = 0.7
    for i in range(5000, 7500):
        rows[i][3] = 0.2
    got = found(spark, rows)
    assert not any("stuck" in v for (_, i), v in got.items() if i < 4800)
    assert all(("a", i) in got for i in range(5000, 7500))
