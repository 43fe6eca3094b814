"""Trajectories of one swing: integration with rests, constrained fits, planes and circles, and a mixture of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import estimators as E
from lodestrata.operators import rotations as R
from lodestrata.operators.segmentation import G, rest_mask, runs_of, segment


def world_acceleration(q: np.ndarray, accel: np.ndarray) -> np.ndarray:
    """Acceleration in the world without gravity."""
    return R.rotate(q, accel) - np.array([0, 0, G])


def integrate(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Running trapezoid, 0 at the first sample."""
    return np.vstack([np.zeros(y.shape[1]), np.cumsum(0.5 * (y[1:] + y[:-1]) * np.diff(t)[:, None], axis=0)])


def dead_reckon(t: np.ndarray, a: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Positions from velocities that vanish in rests: between two of them the velocity's drift is taken off as a line."""
    v = integrate(a, t)
    stretches = runs_of(rest)
    if stretches:
        # the drift known at rests, a line between them and constant beyond the outer ones
        places = np.concatenate([np.arange(lo, hi + 1) for lo, hi in stretches])
        v = v - np.column_stack([np.interp(t, t[places], v[places, k]) for k in range(v.shape[1])])
        v[places] = 0.0
    return integrate(v, t)


def constrained(t: np.ndarray, a: np.ndarray, rest: np.ndarray, closing: float = 10.0) -> np.ndarray:
    """Positions with a constant bias and a start velocity per axis such that velocities at rests vanish and the last rest lies where the first did."""
    v, x = integrate(a, t), t - t[0]
    p, at = integrate(v, t), np.flatnonzero(rest)
    if len(at) < 2:
        return p
    first, last = at[0], at[-1]
    m = np.r_[np.c_[np.ones(len(at)), x[at]], [[closing * (x[last] - x[first]), closing * (x[last] ** 2 - x[first] ** 2) / 2]]]
    free = np.linalg.lstsq(m, -np.r_[v[at], closing * (p[last] - p[first])[None]], rcond=None)[0]
    return p + np.outer(x, free[0]) + np.outer(x**2 / 2, free[1])


@dataclass(frozen=True)
class Circle:
    normal: np.ndarray
    center: np.ndarray
    radius: float
    rms: float


def plane_circle(p: np.ndarray) -> Circle | None:
    """The plane of least squares (normal upward) and in it the circle of Kasa's fit; None for fewer than three points."""
    if len(p) < 3:
        return None
    mid = p.mean(axis=0)
    _, _, vt = np.linalg.svd(p - mid, full_matrices=False)
    normal = vt[2] if vt[2][2] >= 0 else -vt[2]
    u = (p - mid) @ vt[:2].T
    m = np.c_[2 * u, np.ones(len(u))]
    sol = np.linalg.lstsq(m, (u**2).sum(axis=1), rcond=None)[0]
    r = float(np.sqrt(max(sol[2] + sol[0] ** 2 + sol[1] ** 2, 0)))
    rms = float(np.sqrt(np.mean((np.hypot(u[:, 0] - sol[0], u[:, 1] - sol[1]) - r) ** 2)))
    return Circle(normal, mid + sol[:2] @ vt[:2], r, rms)


def lever_positions(q: np.ndarray, arm: np.ndarray) -> np.ndarray:
    p = R.rotate(q, arm)
    return p - p[0]


@dataclass(frozen=True)
class Trust:
    """When an arm explains a swing. Residual in m/s2 at which an arm counts half; lengths in metres between
    which an arm is plausible; the length assumed where it is not; least trust with which an arm stands alone; angle in
    degrees and ratio of lengths at which two halves differ by one unit; score from which the strap has slipped."""

    residual: float = 12.0
    shortest: float = 0.15
    longest: float = 1.5
    assumed: float = 1.0
    alone: float = 0.6
    angle: float = 25.0
    ratio: float = 1.4
    slipped: float = 0.6


RULES = Trust()


def arm_trust(arm: np.ndarray, rank: int, rms: float, rules: Trust = RULES) -> float:
    """From 0 to 1: how far a fitted arm can be believed, by its residual, its length and what the motion determines of it."""
    size = float(np.linalg.norm(arm))
    outside = max(0.0, np.log(rules.shortest / max(size, 1e-9)), np.log(max(size, 1e-9) / rules.longest))
    return float(rank / 3 / (1 + (rms / rules.residual) ** 2) * np.exp(-outside))


def slip_score(parts: Sequence[tuple[np.ndarray, int]], whole: np.ndarray, rules: Trust = RULES) -> tuple[float, bool]:
    """(score, slipped): how unlikely it is that one arm serves both halves of a swing, by direction and length; whole is the arm of both together."""
    (a, ra), (b, rb) = parts
    sizes = [max(float(np.linalg.norm(x)), 1e-9) for x in (a, b, whole)]
    turn = lambda x, y, m, n: float(np.degrees(np.arctan2(np.linalg.norm(np.cross(x, y)), x @ y))) if min(m, n) > 1e-6 else 0.0
    angle = max(turn(a, b, sizes[0], sizes[1]), turn(a, whole, sizes[0], sizes[2]), turn(b, whole, sizes[1], sizes[2]))
    away = (angle / rules.angle) ** 2 + (np.log(sizes[0] / sizes[1]) / np.log(rules.ratio)) ** 2
    score = float(1 - np.exp(-away))
    return score, min(ra, rb) >= 2 and score >= rules.slipped


def hybrid(t: np.ndarray, q: np.ndarray, gyro: np.ndarray, accel: np.ndarray, span: tuple[int, int], rules: Trust = RULES) -> tuple[np.ndarray, str]:
    """(positions from address to finish, how): 'lever' where the rigid arm can be believed, else a 'mixture' of it and the constrained path by its trust.

    An arm whose length is not plausible has the assumed one, in its own direction: 'assumed'.
    """
    lo, hi = span
    part = slice(lo, hi + 1)
    arm, rank, rms = E.arm_of(t[part], q[part], gyro[part], accel[part])
    belief = arm_trust(arm, rank, rms, rules)
    size = float(np.linalg.norm(arm))
    plausible = rules.shortest <= size <= rules.longest
    if hi - lo + 1 < 16 or (plausible and belief >= rules.alone):
        return lever_positions(q[part], arm), "lever"
    if not plausible:
        return lever_positions(q[part], arm / max(size, 1e-9) * rules.assumed if size > 1e-9 else np.array([0.0, 0.0, -rules.assumed])), "assumed"
    rest = rest_mask(gyro[part], accel[part], 1 / max(float(np.median(np.diff(t))), 1e-6))
    rest[[0, -1]] = True
    path = constrained(t[part], world_acceleration(q[part], accel[part]), rest)
    return belief * lever_positions(q[part], arm) + (1 - belief) * (path - path[0]), "mixture"


SCHEMA = "n long, source string, how string, rank int, rms double, radius double, span_m double, slip double, slipped boolean, normal array<double>, circle_radius double"


def trajectory_groups(d: DataFrame, keys: Sequence[str], t: str, gyro: Sequence[str], accel: Sequence[str], flt: str = "gated") -> DataFrame:
    """One row per group: its phases' source, the trajectory's kind, the lever's fit, slip of the strap, plane and circle; nulls below 20 samples."""
    kinds = dict(d.dtypes)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t).drop_duplicates(t)
        x, w, a = (np.nan_to_num(pdf[c].to_numpy(float), posinf=0, neginf=0) for c in (t, list(gyro), list(accel)))
        row = dict.fromkeys(names) | {"n": len(x)}
        p = segment(x, w, a)
        if p:
            q = E.FILTERS[flt]().run(x, w, a)
            lo, hi = p[0], p[3]
            mid = (lo + hi) // 2
            path, how = hybrid(x, q, w, a, (lo, hi))
            fit = lambda i, j: E.arm_of(x[i : j + 1], q[i : j + 1], w[i : j + 1], a[i : j + 1])
            arm, rank, rms = fit(lo, hi)
            row |= {"source": p[4], "how": how, "rank": rank, "rms": rms, "radius": float(np.linalg.norm(arm)), "span_m": float(np.linalg.norm(path.max(axis=0) - path.min(axis=0)))}
            if mid - lo >= 5 and hi - mid >= 5:
                row["slip"], row["slipped"] = slip_score([fit(lo, mid)[:2], fit(mid, hi)[:2]], arm)
            c = plane_circle(path)
            if c is not None:
                row |= {"normal": list(c.normal), "circle_radius": c.radius}
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *(row[n] for n in names)]], columns=[*keys, *names])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + SCHEMA
    return d.where(F.col(t).isNotNull()).select(*keys, t, *gyro, *accel).groupBy(*keys).applyInPandas(run, schema)
