"""Capture files: the packed binary layout, version 2, and the JSON layout, version 1."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
MAGIC, VERSION, BASE, PREVIEW = b"GMPC", 2, 136, 780
ZLIB, HAS_PREVIEW = 1, 2
HEADER = struct.Struct("<4sHHI4B2f2I16s2d4f32s16s2I")
MODES, HANDS, WRISTS = ("compat", "high_rate"), ("right", "left"), ("lead", "trail")
PREVIEW_HEAD = struct.Struct("<2f2H")

HEADER_FIELDS = "path string, session_id string, capture_mode string, handedness string, wrist string, accelerometer_hz double, device_motion_hz double, started_at_unix double, ended_at_unix double, mount array<double>, device_model string, system_version string, preview_confidence double, preview_quality double, error string"
ACCEL_FIELDS = "array<struct<i:int,t:double,x:float,y:float,z:float>>"
MOTION_NAMES = ("gyro_x", "gyro_y", "gyro_z", "gravity_x", "gravity_y", "gravity_z", "user_accel_x", "user_accel_y", "user_accel_z", "attitude_w", "attitude_x", "attitude_y", "attitude_z")
MOTION_FIELDS = f"array<struct<i:int,t:double,{','.join(f'{n}:float' for n in MOTION_NAMES)}>>"


class CaptureError(ValueError):
    """A file that breaks the format."""


def to_micros(t: np.ndarray) -> np.ndarray:
    """Steps in whole microseconds, the first 0."""
    return np.r_[0, np.rint(np.diff(t) * 1e6)].astype("<u4")


def to_times(t0: float, steps: np.ndarray) -> np.ndarray:
    return t0 + np.cumsum(steps.astype(np.float64)) * 1e-6


def encode(header: dict, accel_t: np.ndarray, accel: np.ndarray, motion_t: np.ndarray, motion: np.ndarray, compress: bool = False, preview: tuple[float, float, np.ndarray] | None = None) -> bytes:
    """A packed capture; accel is n x 3, motion n x 13 in the order of MOTION_NAMES, preview (confidence, quality, 64 x 3)."""
    groups = [motion[:, 0:3], motion[:, 3:6], motion[:, 6:9], motion[:, 9:13]]
    raw = b"".join([struct.pack("<2d", accel_t[0], motion_t[0]), to_micros(accel_t).tobytes(), accel.astype("<f4").tobytes(), to_micros(motion_t).tobytes(), *(np.ascontiguousarray(g).astype("<f4").tobytes() for g in groups)])
    size = BASE + (PREVIEW if preview else 0)
    head = HEADER.pack(MAGIC, VERSION, size, ZLIB * compress | HAS_PREVIEW * bool(preview), MODES.index(header["capture_mode"]), HANDS.index(header["handedness"]), WRISTS.index(header["wrist"]), 0, header["accelerometer_hz"], header["device_motion_hz"], len(accel_t), len(motion_t), uuid.UUID(header["session_id"]).bytes, header["started_at_unix"], header["ended_at_unix"], *header.get("mount", (1.0, 0.0, 0.0, 0.0)), header["device_model"].encode()[:32], header["system_version"].encode()[:16], len(raw), zlib.crc32(raw))
    block = b"" if preview is None else PREVIEW_HEAD.pack(preview[0], preview[1], 64, 0) + np.asarray(preview[2], "<f4").reshape(64, 3).tobytes()
    return head + block + (zlib.compress(raw) if compress else raw)


def decode(data: bytes) -> dict:
    """The fields of a packed capture; CaptureError where any rule of the format is broken."""
    if len(data) < BASE:
        raise CaptureError("truncated header")
    v = HEADER.unpack_from(data)
    magic, version, size, flags, mode, hand, wrist = v[:7]
    if magic != MAGIC or version != VERSION:
        raise CaptureError("bad magic or version")
    if size != BASE + (PREVIEW if flags & HAS_PREVIEW else 0) or len(data) < size:
        raise CaptureError("bad header size")
    if mode >= len(MODES) or hand >= len(HANDS) or wrist >= len(WRISTS):
        raise CaptureError("unknown code")
    n, m = v[10], v[11]
    if n < 2 or m < 2:
        raise CaptureError("too few samples")
    raw = data[size:]
    if flags & ZLIB:
        try:
            raw = zlib.decompress(raw)
        except zlib.error as e:
            raise CaptureError("bad compression") from e
    if len(raw) != v[21] or len(raw) != 16 + 16 * n + 56 * m:
        raise CaptureError("bad payload size")
    if zlib.crc32(raw) != v[22]:
        raise CaptureError("bad checksum")
    at = 16

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += count * 4
        return out

    t0, u0 = struct.unpack_from("<2d", raw)
    at_, accel = take(n, "<u4"), None
    accel = take(3 * n, "<f4").reshape(n, 3)
    mt = take(m, "<u4")
    motion = np.hstack([take(3 * m, "<f4").reshape(m, 3) for _ in range(3)] + [take(4 * m, "<f4").reshape(m, 4)])
    if at_[0] or mt[0] or (at_[1:] == 0).any() or (mt[1:] == 0).any():
        raise CaptureError("times do not rise")
    if not (np.isfinite(accel).all() and np.isfinite(motion).all()):
        raise CaptureError("non-finite channel")
    confidence = quality = None
    if flags & HAS_PREVIEW:
        confidence, quality, points, _ = PREVIEW_HEAD.unpack_from(data, BASE)
        if points != 64:
            raise CaptureError("bad preview")
    return {
        "session_id": str(uuid.UUID(bytes=v[12])), "capture_mode": MODES[mode], "handedness": HANDS[hand], "wrist": WRISTS[wrist], "accelerometer_hz": v[8], "device_motion_hz": v[9], "started_at_unix": v[13], "ended_at_unix": v[14],
        "mount": list(v[15:19]), "device_model": v[19].rstrip(b"\0").decode(), "system_version": v[20].rstrip(b"\0").decode(), "preview_confidence": confidence, "preview_quality": quality,
        "accel_t": to_times(t0, at_), "accel": accel, "motion_t": to_times(u0, mt), "motion": motion,
    }


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: header fields, accel and motion arrays, and error, which is null for sound files."""
    names = [f.split()[0] for f in HEADER_FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"]):
                try:
                    c = decode(bytes(data))
                except (CaptureError, UnicodeDecodeError) as e:
                    rows.append({**dict.fromkeys([*names, "accel", "motion"]), "path": p, "error": str(e)})
                    continue
                accel = [{"i": i, "t": t, "x": x, "y": y, "z": z} for i, (t, (x, y, z)) in enumerate(zip(c.pop("accel_t"), c.pop("accel")))]
                motion = [{"i": i, "t": t, **dict(zip(MOTION_NAMES, r))} for i, (t, r) in enumerate(zip(c.pop("motion_t"), c.pop("motion")))]
                rows.append({"path": p, **c, "error": None, "accel": accel, "motion": motion})
            yield pd.DataFrame(rows, columns=[*names, "accel", "motion"], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, f"{HEADER_FIELDS}, accel {ACCEL_FIELDS}, motion {MOTION_FIELDS}")


def samples(captures: DataFrame, stream: str) -> DataFrame:
    """The rows of one of the two streams of sound files."""
    return captures.where("error is null").select("session_id", F.explode(stream).alias("s")).select("session_id", "s.*")


JSON_SCHEMA = (
    "schemaVersion string, sessionID string, startedAtUnix double, endedAtUnix double, handedness string, wrist string, captureMode string, mountExtrinsicWXYZ array<double>, "
    "device struct<model:string,systemVersion:string,accelerometerHz:double,deviceMotionHz:double>, accelerometer800Hz array<struct<timestamp:double,x:double,y:double,z:double>>, "
    "deviceMotion200Hz array<struct<timestamp:double,rotationRate:struct<x:double,y:double,z:double>,gravity:struct<x:double,y:double,z:double>,userAcceleration:struct<x:double,y:double,z:double>,attitudeWXYZ:struct<w:double,x:double,y:double,z:double>>>"
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Captures in JSON with error: null, or the first rule broken (schema, a stream of fewer than two rows, non-finite, rate)."""
    d = spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path)
    short = lambda c: F.coalesce(F.size(c), F.lit(0)) < 2
    bad = F.exists("accelerometer800Hz", lambda s: s["x"].isNull() | F.isnan(s["x"]) | s["y"].isNull() | F.isnan(s["y"]) | s["z"].isNull() | F.isnan(s["z"]) | s["timestamp"].isNull())
    times = F.transform("deviceMotion200Hz", lambda s: s["timestamp"])
    rate = (F.size("deviceMotion200Hz") - 1) / (F.array_max(times) - F.array_min(times))
    error = F.when(~F.coalesce(F.col("schemaVersion").endswith("-v1"), F.lit(False)), "unknown schema").when(short("accelerometer800Hz") | short("deviceMotion200Hz"), "missing stream").when(bad, "non-finite").when(~rate.between(40, 240), "implausible rate")
    return d.withColumn("error", error)


def sniff(files: DataFrame) -> DataFrame:
    """Adds format to binary files: 'packed' by the first bytes, 'json' by an opening brace, else 'unknown'."""
    head = F.substring("content", 1, 4)
    return files.withColumn("format", F.when(head == F.lit(MAGIC), "packed").when(F.ltrim(F.substring("content", 1, 64).cast("string")).startswith("{"), "json").otherwise("unknown"))
