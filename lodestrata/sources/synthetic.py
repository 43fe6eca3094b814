"""Synthetic swings in closed form, sensor errors in order, and grids of runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import rotations as R

G = 9.80665
SAMPLES = "swing_id string, i int, t double, gx double, gy double, gz double, ax double, ay double, az double, px double, py double, pz double, qw double, qx double, qy double, qz double"
COLUMNS = [c.split()[0] for c in SAMPLES.split(", ")]


@dataclass(frozen=True)
class Swing:
    """Durations in seconds, the arc's radius in metres, the turn to the top and past impact and the plane's tilt in degrees; casting: the rate peaks before impact."""

    fs: float = 200.0
    radius: float = 0.45
    address: float = 0.30
    back: float = 0.75
    down: float = 0.25
    follow: float = 0.55
    top_deg: float = 110.0
    past_deg: float = 130.0
    tilt_deg: float = 55.0
    casting: bool = False


def _quintic(span: float, begin: Sequence[float], end: Sequence[float]) -> np.poly1d:
    """The polynomial of degree five with given place, rate and acceleration at 0 and at span."""
    rows, values = [], []
    for at, given in ((0.0, begin), (span, end)):
        for order, v in enumerate(given):
            rows.append([0.0] * order + [np.prod(range(n - order + 1, n + 1), dtype=float) * at ** (n - order) for n in range(order, 6)])
            values.append(v)
    return np.poly1d(np.linalg.solve(np.array(rows), np.array(values))[::-1])


def swing(p: Swing = Swing()) -> dict[str, np.ndarray]:
    """t, gyro, accel, position, orientation and the places of address, top, impact and finish of a swing about one axis.

    The angle is a spline of quintics through address, top, impact and finish, at rest but for impact; the acceleration
    rings after impact.
    """
    top, past = np.radians(p.top_deg), np.radians(p.past_deg)
    fastest = 2.1 * top / p.down
    at_top, at_impact = (0.0, -1.2 * top / p.down**2), (-fastest, 0.35 * fastest / p.down if p.casting else 0.0)
    knots = [(p.address, (0.0, 0.0, 0.0)), (p.address + p.back, (top, *at_top)), (p.address + p.back + p.down, (0.0, *at_impact)), (p.address + p.back + p.down + p.follow, (-past, 0.0, 0.0))]
    t = np.arange(0, knots[-1][0] + 0.25, 1 / p.fs)
    angle, rate, acc = np.zeros((3, len(t)))
    for (a, begin), (b, end) in zip(knots, knots[1:]):
        f = _quintic(b - a, begin, end)
        on = (t >= a) & (t < b)
        for out, d in ((angle, 0), (rate, 1), (acc, 2)):
            out[on] = np.polyder(f, d)(t[on] - a) if d else f(t[on] - a)
    angle[t >= knots[-1][0]] = -past
    # the plane: its axis leans back from the horizontal; the arm hangs down along its slope at address
    slope = np.radians(p.tilt_deg)
    axis, hang = np.array([0.0, -np.sin(slope), np.cos(slope)]), np.array([0.0, -np.cos(slope), -np.sin(slope)])
    q = R.multiply(R.exponential(angle[:, None] * axis), R.IDENTITY)
    arm = p.radius * R.rotate(q, hang)
    along = np.cross(axis, arm)
    world = acc[:, None] * along - (rate**2)[:, None] * arm + np.array([0, 0, G])
    accel = R.rotate(R.conjugate(q), world)
    k = int(np.abs(t - knots[2][0]).argmin())
    since = t[k:] - t[k]
    accel[k:] += (25 * G * np.exp(-since / 0.015) * np.sin(2 * np.pi * 60 * since))[:, None] * R.unit(np.array([1.0, 0.2, 0.4]))
    turned = int(np.argmax(angle))
    busy = np.flatnonzero(np.abs(rate) >= 0.04 * np.abs(rate).max())
    return {"t": t, "gyro": rate[:, None] * axis, "accel": accel, "position": arm, "orientation": q, "phases": np.array([max(busy[0] - 1, 0), turned, k, min(busy[-1] + 1, len(t) - 1)])}


def varied(k: int, seed: int, fs: float = 200.0) -> Swing:
    """The swing of a number: durations, top and tilt vary by seed and number; every fourth casts."""
    r = np.random.default_rng([seed, k])
    u = r.random(5)
    return Swing(fs=fs, back=0.6 + 0.3 * u[0], down=0.2 + 0.1 * u[1], top_deg=95 + 30 * u[2], tilt_deg=45 + 20 * u[3], radius=0.4 + 0.3 * u[4], casting=k % 4 == 3)


def swings(spark: SparkSession, n: int, seed: int = 1, fs: float = 200.0) -> DataFrame:
    """n swings in long form with their true positions and orientations, each made where its row lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                s = swing(varied(int(k), seed, fs))
                d = pd.DataFrame(np.c_[s["t"], s["gyro"], s["accel"], s["position"], s["orientation"]], columns=COLUMNS[2:])
                yield d.assign(swing_id=f"s{k}", i=np.arange(len(d), dtype="int32"))[COLUMNS]

    return spark.range(n).mapInPandas(run, SAMPLES)


@dataclass(frozen=True)
class Errors:
    """Sensor errors, zero by default; scaled() multiplies those that grade a sweep."""

    mount_deg: float = 0.0
    misalign: float = 0.0
    scale: float = 0.0
    bias: float = 0.0
    walk: float = 0.0
    g_sensitivity: float = 0.0
    noise: float = 0.0
    clip: float = float("inf")
    step: float = 0.0
    jitter: float = 0.0
    dropout: float = 0.0

    def scaled(self, k: float) -> Errors:
        return replace(self, mount_deg=self.mount_deg * min(k, 0.5), misalign=self.misalign * k, bias=self.bias * k, walk=self.walk * k, noise=self.noise * k)


#: Levels of error by name, from none to a worn sensor on a loose strap.
LEVELS = {
    "ideal": Errors(),
    "lab": Errors(misalign=0.001, bias=0.002, noise=0.002),
    "consumer": Errors(misalign=0.005, scale=0.005, bias=0.02, walk=2e-5, noise=0.01, clip=35.0, step=0.001),
    "consumer_wrist": Errors(mount_deg=4.0, misalign=0.005, scale=0.005, bias=0.02, walk=2e-5, noise=0.015, clip=35.0, step=0.001, jitter=2e-4, dropout=0.002),
    "worn": Errors(mount_deg=12.0, misalign=0.02, scale=0.02, bias=0.08, walk=1e-4, g_sensitivity=2e-4, noise=0.05, clip=20.0, step=0.01, jitter=1e-3, dropout=0.02),
}


def inject(t: np.ndarray, gyro: np.ndarray, accel: np.ndarray, e: Errors, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The errors in the order in which a sensor makes them: mount, misalignment, scale, bias and walk, g-sensitivity, noise, clipping, steps, jitter, held samples."""
    r = np.random.default_rng(seed)
    n = len(t)
    mount = R.exponential(np.array([0.0, 0.0, np.radians(e.mount_deg)]))
    g, x = R.rotate(mount, gyro), R.rotate(mount, accel)
    m = np.eye(3) + e.misalign * r.standard_normal((3, 3)) * (1 - np.eye(3))
    g, x = g @ m.T * (1 + e.scale * r.standard_normal(3)), x @ m.T * (1 + e.scale * r.standard_normal(3))
    g = g + e.bias * r.standard_normal(3) + np.cumsum(e.walk * r.standard_normal((n, 3)), axis=0) + e.g_sensitivity * x
    g, x = g + e.noise * r.standard_normal((n, 3)), x + 10 * e.noise * r.standard_normal((n, 3))
    g, x = np.clip(g, -e.clip, e.clip), np.clip(x, -e.clip * 10, e.clip * 10)
    if e.step:
        g, x = np.round(g / e.step) * e.step, np.round(x / e.step) * e.step
    if e.jitter:
        t = np.maximum.accumulate(t + e.jitter * r.standard_normal(n))
    held = r.random(n) < e.dropout
    held[:1] = False
    last = np.maximum.accumulate(np.where(held, 0, np.arange(n)))
    return t, g[last], x[last]


def sweep(spark: SparkSession, scales: Sequence[float] = (0, 0.5, 1, 1.5, 2, 3), seeds: int = 5) -> DataFrame:
    """(scale, seed): the grid of a degradation sweep, a row per run."""
    return spark.createDataFrame([(float(s),) for s in scales], "scale double").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))


def cases(spark: SparkSession, levels: Sequence[str], swings_each: int = 4, seeds: int = 8) -> DataFrame:
    """(level, seed, k): the grid of an evaluation, a row per swing to be made."""
    d = spark.createDataFrame([(x,) for x in levels], "level string")
    return d.select("level", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).select("level", "seed", F.explode(F.sequence(F.lit(0), F.lit(swings_each - 1))).alias("k"))
