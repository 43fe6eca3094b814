import json

import numpy as np
import pytest

from lodestrata.sources import captures as C
from lodestrata.sources import mocap, source_code

HEAD = {"session_id": "2d59da44-cbfe-40e9-afbb-7b83bf45f700", "capture_mode": "high_rate", "handedness": "left", "wrist": "trail", "accelerometer_hz": 800.0, "device_motion_hz": 200.0, "started_at_unix": 1.5, "ended_at_unix": 2.5, "device_model": "W", "system_version": "9"}


def blob(**kw):
    r = np.random.default_rng(1)
    return C.encode(HEAD, 10 + np.arange(8) / 800, r.normal(size=(8, 3)), 10 + np.arange(4) / 200, r.normal(size=(4, 13)), **kw)


@pytest.mark.parametrize("kw", [{}, {"compress": True}, {"preview": (0.5, 0.25, np.zeros((64, 3)))}])
def test_round_trip(kw):
    c = C.decode(blob(**kw))
    assert c["session_id"] == HEAD["session_id"] and c["wrist"] == "trail" and len(c["accel"]) == 8 and c["motion"].shape == (4, 13)
    assert np.allclose(c["accel_t"], 10 + np.arange(8) / 800, atol=1e-6)


def corrupted():
    b = blob()
    yield b[:50]
    yield b"XXXX" + b[4:]
    yield b[:-1]
    yield b[:-4] + b"\0\0\0\1"
    yield blob(compress=True)[:-6]


@pytest.mark.parametrize("b", list(corrupted()))
def test_corruption(b):
    with pytest.raises(C.CaptureError):
        C.decode(b)


def test_read_packed_and_sniff(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(blob())
    (tmp_path / "b.bin").write_bytes(b"junk")
    d = C.read_packed(spark, str(tmp_path))
    assert sorted(r["error"] or "" for r in d.collect()) == ["", "truncated header"]
    assert C.samples(d, "accel").count() == 8 and C.samples(d, "motion").count() == 4
    (tmp_path / "c.json").write_text(' {"a": 1}')
    f = C.sniff(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(r["format"] for r in f.collect()) == ["json", "packed", "unknown"]


def test_read_json(spark, tmp_path):
    m = [{"timestamp": i / 100, "rotationRate": {"x": 0.0, "y": 0.0, "z": 0.0}} for i in range(5)]
    a = [{"timestamp": i / 800, "x": 0.0, "y": 0.0, "z": 1.0} for i in range(5)]
    for k, x in enumerate([{"schemaVersion": "capture-v1", "accelerometer800Hz": a, "deviceMotion200Hz": m}, {"schemaVersion": "capture-v1", "accelerometer800Hz": a}, {"schemaVersion": "other", "accelerometer800Hz": a, "deviceMotion200Hz": m}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(x))
    assert sorted(r["error"] or "" for r in C.read_json(spark, str(tmp_path)).collect()) == ["", "missing stream", "unknown schema"]


def test_mocap(spark, tmp_path):
    (tmp_path / "s.asf").write_text(":bonedata\n begin\n id 1\n name hip\n direction 0.5 -1 0\n length 2.5\n axis 0 0 20 XYZ\n dof rx ry\n end\n begin\n id 2\n name leg\n direction 1 0 0\n length 1\n axis 0 0 0 XYZ\n end\n:hierarchy\n begin\n root hip\n hip leg\n end\n")
    got = {r["name"]: r for r in mocap.read_skeleton(spark, str(tmp_path / "s.asf")).collect()}
    assert got["leg"]["parent"] == "hip" and got["hip"]["dof"] == ["rx", "ry"] and got["hip"]["direction"] == [0.5, -1.0, 0.0] and got["leg"]["dof"] == []
    (tmp_path / "m.amc").write_text("#c\n:DEGREES\n1\nroot 1 2 3\nhip 4\n2\nroot 5 6 7\n")
    f = sorted((r["frame"], r["bone"], r["channels"]) for r in mocap.read_frames(spark, str(tmp_path / "m.amc")).collect())
    assert f == [(1, "hip", [4.0]), (1, "root", [1.0, 2.0, 3.0]), (2, "root", [5.0, 6.0, 7.0])]


def test_source_scan_and_symbols(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os, sys as s\nfrom . import b\nclass A(B):\n    def m(self, x: int) -> int:\n        'doc'\n        def inner(): pass\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("x = 1\n")
    (tmp_path / "bad.py").write_text("def (:\n")
    f = source_code.scan_tree(spark, str(tmp_path), [".py"])
    assert f.count() == 2
    s = {(r["name"], r["node_type"], r["parent"]) for r in source_code.symbols(f).collect()}
    assert s == {("A", "class", None), ("m", "method", "A"), ("inner", "function", "m")}
    assert {(r["module"], r["name"]) for r in source_code.imports(f).collect()} == {("os", None), ("sys", None), (".", "b")}
    assert source_code.stale(f, f.where("file_path like '%a.py'")).count() == 1
