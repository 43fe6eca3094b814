import math

from lodestrata.operators import grid as G

ROWS = "stream string, session_id string, t double, v double, slot string, n int"
MODES = "session_id string, capture_mode string, received_at timestamp"


def build(spark, rows, modes):
    d = spark.createDataFrame([("s", k, t, v, "extra", 1) for k, t, v in rows], ROWS)
    h = spark.createDataFrame([(k, m, None) for k, m in modes], MODES)
    return G.occupied_slots(d.select("stream", "session_id", "t", "v"), ["stream", "session_id"], G.latest_mode(h), {"highrate": 0.05}, 0.25, values=["v"])


def test_missing_slots_against_brute_force(spark):
    rows = [("a", t, 1.0) for t in (0.01, 0.02, 0.31, 0.9, -0.2, 0.9)] + [("b", t, 1.0) for t in (1.0, 3.1, None, float("nan"), float("inf"))] + [("c", 5.0, None)] + [(None, 1.0, 1.0)]
    slots = build(spark, rows, [("a", "High-Rate"), ("a", "high_rate"), ("b", None)])
    got = {(r["session_id"], r["slot"]) for r in G.missing_slots(slots.where("session_id is not null"), ["stream", "session_id"]).collect()}
    want = set()
    for k, w in (("a", 0.05), ("b", 0.25)):
        have = {math.floor(t / w) for s, t, _ in rows if s == k and t is not None and math.isfinite(t)}
        want |= {(k, x) for x in range(min(have), max(have)) if x not in have}
    assert got == want


def test_chunks_and_long_gaps(spark):
    rows = [("a", float(t), 1.0) for t in (0, 1, 5000, 5001, 30000)]
    slots = build(spark, rows, [])
    assert G.missing_slots(slots, ["stream", "session_id"]).count() == 30000 * 4 + 1 - 5


def test_interpolates_short_gaps_marks_long_ones_and_extends(spark):
    slots = build(spark, [("a", 0.1, 1.0), ("a", 0.85, 4.0), ("a", 3.1, None)], [])
    bounds = spark.createDataFrame([("s", "a", -2, 13)], "stream string, session_id string, lo long, hi long")
    g = {r["slot"]: (r["state"], r["v"]) for r in G.regular_grid(slots, ["stream", "session_id"], ["v"], max_fill=2, bounds=bounds).collect()}
    assert sorted(g) == list(range(-2, 14))
    assert g[0] == ("observed", 1.0) and g[1] == ("interpolated", 2.0) and g[2] == ("interpolated", 3.0)
    assert g[3] == ("observed", 4.0) and g[4] == ("missing", None) and g[12] == ("observed", None)
    assert g[-2][0] == g[13][0] == "outside"


def test_empty(spark):
    slots = build(spark, [], [])
    assert G.missing_slots(slots, ["stream", "session_id"]).count() == 0
    assert G.regular_grid(slots, ["stream", "session_id"], ["v"]).count() == 0
