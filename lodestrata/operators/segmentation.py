"""Segmentation of a swing's samples into address, top, impact and finish, and the kernels it uses.

One group is a swing, a few thousand rows; the decisions depend on one another, so a group is one function call.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

G = 9.80665
PHASES = "address int, top int, impact int, finish int, source string, confidence double"


def smooth(x: np.ndarray, size: int) -> np.ndarray:
    """Moving mean of size samples, the ends repeated beyond the edges."""
    if size <= 1 or not len(x):
        return np.asarray(x, float)
    p = np.pad(np.asarray(x, float), (size // 2, (size - 1) // 2), mode="edge")
    c = np.cumsum(np.r_[0.0, p])
    return (c[size:] - c[:-size]) / size


def butterworth2(cut: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the second-order high-pass filter, by the bilinear transform."""
    k = np.tan(np.pi * min(cut, 0.45 * fs) / fs)
    d = 1 + np.sqrt(2) * k + k * k
    return np.array([1, -2, 1]) / d, np.array([1, 2 * (k * k - 1) / d, (1 - np.sqrt(2) * k + k * k) / d])


def both_ways(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter forward and backward, with odd extension at the ends."""

    def once(v: np.ndarray) -> np.ndarray:
        y = np.empty_like(v)
        z1 = z2 = 0.0
        for i, s in enumerate(v):
            o = b[0] * s + z1
            z1, z2 = b[1] * s - a[1] * o + z2, b[2] * s - a[2] * o
            y[i] = o
        return y

    n = min(12, len(x) - 1)
    v = np.r_[2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]] if n > 0 else x
    y = once(once(v)[::-1])[::-1]
    return y[n : len(y) - n] if n > 0 else y


def transient(accel: np.ndarray, fs: float, cut: float = 35.0) -> np.ndarray:
    """The fast part of the acceleration's size; for a few samples or a low rate, its distance from the mean."""
    a = np.linalg.norm(accel, axis=1)
    if len(a) < 16 or fs < 2.5 * cut:
        return np.abs(a - a.mean())
    return smooth(np.abs(both_ways(a, *butterworth2(cut, fs))), 3)


def main_axis(gyro: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = (gyro - gyro.mean(axis=0)) * weight[:, None]
    return np.linalg.eigh(w.T @ w)[1][:, -1]


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each stretch of true."""
    e = np.flatnonzero(np.diff(np.r_[0, mask.astype(int), 0]))
    return list(zip(e[::2], e[1::2] - 1))


def rest_mask(gyro: np.ndarray, accel: np.ndarray, fs: float) -> np.ndarray:
    """Samples at rest: near 1 g, slow and steady, in stretches of at least .05 s."""
    m = max(round(0.10 * fs), 1)
    var = lambda x: np.maximum(smooth(x * x, m) - smooth(x, m) ** 2, 0)
    a = np.linalg.norm(accel, axis=1)
    calm = (np.abs(a - G) <= 0.08 * G) & (np.linalg.norm(gyro, axis=1) <= 0.25) & (sum(var(gyro[:, k]) for k in range(3)) <= 0.03) & (var(a) <= 0.35)
    out = np.zeros(len(a), bool)
    for lo, hi in runs_of(calm):
        if hi - lo + 1 >= max(round(0.05 * fs), 1):
            out[lo : hi + 1] = True
    return out


def gyro_bias(gyro: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return gyro[rest].mean(axis=0) if rest.any() else np.zeros(3)


def address_window(gyro: np.ndarray, accel: np.ndarray, fs: float) -> tuple[int, np.ndarray, str]:
    """(centre, mean gravity, quality) of the calmest window of .2 s, early ones preferred; outliers of its acceleration left out."""
    n = len(gyro)
    m = int(np.clip(round(0.2 * fs), 1, n))
    a = np.linalg.norm(accel, axis=1)
    rms = np.sqrt(smooth((gyro**2).sum(axis=1), m))
    off = np.abs(smooth(a, m) - G) / G
    score = rms + 3 * off + 0.02 * np.arange(n) / max(n - 1, 1)
    lo, hi = m // 2, n - (m - 1) // 2
    at = lo + int(np.argmin(score[lo:hi]))
    w = accel[at - m // 2 : at + (m - 1) // 2 + 1]
    d = np.linalg.norm(w - np.median(w, axis=0), axis=1)
    sigma = 1.4826 * np.median(np.abs(d - np.median(d)))
    keep = d <= np.median(d) + 3 * sigma if sigma > 1e-9 else np.ones(len(d), bool)
    quality = "good" if off[at] < 0.08 and rms[at] < 0.35 else "usable" if off[at] < 0.15 and rms[at] < 0.75 else "poor"
    return at, w[keep].mean(axis=0), quality


def back_below(x: np.ndarray, start: int, level: float) -> int:
    """The last place up to start that is at or below a level; 0 without one."""
    below = np.flatnonzero(x[: start + 1] <= level)
    return int(below[-1]) if len(below) else 0


def on_below(x: np.ndarray, start: int, level: float) -> int:
    below = np.flatnonzero(x[start:] <= level)
    return int(start + below[0]) if len(below) else len(x) - 1


def impact_hint(t: np.ndarray, accel: np.ndarray, after: float) -> float | None:
    """The time of the strongest fast acceleration after a time, from a stream of at least 400 Hz; None where nothing stands out."""
    if len(t) < 16:
        return None
    fs = 1 / max(np.median(np.diff(t)), 1e-9)
    if fs < 400:
        return None
    x = transient(accel, fs)
    later = np.flatnonzero(t > after)
    if not len(later):
        return None
    k = later[int(np.argmax(x[later]))]
    return float(t[k]) if x[k] >= max(4 * np.median(x), 0.3 * x.max()) else None


def segment(t: np.ndarray, gyro: np.ndarray, accel: np.ndarray, hint: int | None = None) -> tuple[int, int, int, int, str, float] | None:
    """(address, top, impact, finish, source, confidence) in places of the samples; None for fewer than 20.

    source is 'collision', 'hint', 'kinematic' or 'unavailable'; the four places strictly rise.
    """
    n = len(t)
    if n < 20:
        return None
    fs = 1 / max(float(np.median(np.diff(t))), 1e-6)
    size = max(3, int(0.015 * fs))
    speed = smooth(np.linalg.norm(gyro, axis=1), size)
    axis = main_axis(gyro, speed)
    s = smooth(gyro @ axis, size)
    k = int(speed.argmax())
    peak = float(speed[k])
    hi, lo = 0.10 * peak, 0.04 * peak
    moving = np.flatnonzero(speed > hi)
    first, last = (int(moving[0]), int(moving[-1])) if len(moving) else (0, n - 1)
    side = np.sign(s[k]) or 1.0
    turned = np.flatnonzero(s[: k + 1] * side < 0)
    coarse = int(turned[-1]) if len(turned) else int(np.abs(s[: k + 1]).argmin())
    fast = transient(accel, fs)
    mid = max(float(np.median(fast)), 1e-9)
    a, b = max(int(first - 0.05 * fs), coarse, 0), min(int(last + 0.10 * fs), n - 1)
    part = fast[a : b + 1]
    snr = float(part.max() / mid) if len(part) else 0.0
    impact, source, confidence = None, "kinematic", 0.45 if fs < 120 else 0.55
    if hint is not None and coarse < hint <= b:
        impact, source, confidence = int(hint), "hint", 0.9
    elif fs >= 120 and snr > 4:
        top_after = float(fast[k : b + 1].max()) if k <= b else float(part.max())
        tops = [i for i in range(max(a, 1), min(b, n - 2) + 1) if fast[i] >= fast[i - 1] and fast[i] >= fast[i + 1] and fast[i] >= max(3 * mid, 0.30 * top_after)]
        close = [i for i in tops if abs(i - k) <= 0.12 * fs] or [i for i in tops if i >= k]
        if close:
            impact = max(close, key=lambda i: fast[i])
        else:
            i = a + int(part.argmax())
            if fast[i] >= max(3 * mid, 0.15 * top_after) and speed[i] >= 0.25 * peak:
                impact = i
        if impact is not None:
            source, confidence = "collision", float(np.clip((snr - 4) / 8, 0.35, 1))
    if impact is None:
        size_a = np.linalg.norm(accel, axis=1)
        mix = 0.55 * speed / max(peak, 1e-9) + 0.45 * size_a / max(size_a.max(), 1e-9)
        impact = coarse + int(mix[coarse:].argmax())
        if snr <= 1.5 and peak < 1:
            source, confidence = "unavailable", 0.15
    rev = np.flatnonzero(np.sign(s[1:impact]) * np.sign(s[: max(impact - 1, 0)]) < 0) if impact > 1 else np.array([], int)
    top = int(rev[-1]) + 1 if len(rev) else coarse
    top = max(0, min(top, impact - max(1, int(0.05 * fs))))
    address = back_below(speed, back_below(speed, first, hi), lo)
    if top - address < 0.35 * fs:
        quiet = [r for r in runs_of(speed[: max(top, 1)] <= lo) if r[1] - r[0] + 1 >= max(2, int(0.04 * fs))]
        address = quiet[-1][1] if quiet else address
    address = max(0, min(address, top - max(1, int(0.15 * fs))))
    f0, f1 = min(n - 1, impact + max(1, int(0.15 * fs))), min(n - 1, int(impact + 1.20 * fs))
    calm = [r for r in runs_of(speed[f0 : f1 + 1] < lo) if r[1] - r[0] + 1 >= max(2, int(0.04 * fs))]
    finish = f0 + calm[0][0] if calm else f1
    finish = max(finish, min(f1, on_below(speed, min(last, n - 1), lo)))
    top = max(top, address + 1)
    impact = max(impact, top + 1)
    finish = max(finish, impact + 1)
    if finish > n - 1:
        finish = n - 1
        impact, top, address = min(impact, n - 2), min(top, n - 3), min(address, n - 4)
    return int(address), int(top), int(impact), int(finish), source, confidence


def features(t: np.ndarray, gyro: np.ndarray, accel: np.ndarray, p: tuple) -> dict[str, float]:
    """Durations, their ratio and peaks of a segmented swing."""
    address, top, impact, finish = p[:4]
    speed = np.linalg.norm(gyro, axis=1)
    k = top + int(speed[top : impact + 1].argmax())
    back, down = t[top] - t[address], t[impact] - t[top]
    return {"tempo_s": float(t[impact] - t[address]), "backswing_s": float(back), "downswing_s": float(down), "rhythm": float(back / max(down, 1e-9)), "peak_omega_rad_s": float(speed[k]), "peak_omega_to_impact_s": float(t[impact] - t[k]), "follow_s": float(t[finish] - t[impact])}


FEATURES = ("tempo_s", "backswing_s", "downswing_s", "rhythm", "peak_omega_rad_s", "peak_omega_to_impact_s", "follow_s")


def segment_groups(d: DataFrame, keys: Sequence[str], t: str, gyro: Sequence[str], accel: Sequence[str]) -> DataFrame:
    """(keys, n, phases, features) of each group; groups of fewer than 20 samples have nulls. Null and non-finite readings count as 0."""
    kinds = dict(d.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t).drop_duplicates(t)
        x, w, a = (np.nan_to_num(pdf[c].to_numpy(float), posinf=0, neginf=0) for c in (t, list(gyro), list(accel)))
        p = segment(x, w, a)
        f = features(x, w, a, p) if p else dict.fromkeys(FEATURES)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(pdf), *(p or [None] * 6), *(f[c] for c in FEATURES)]], columns=[*keys, "n", "address", "top", "impact", "finish", "source", "confidence", *FEATURES])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", n long, {PHASES}, " + ", ".join(f"{c} double" for c in FEATURES)
    return d.where(F.col(t).isNotNull()).select(*keys, t, *gyro, *accel).groupBy(*keys).applyInPandas(run, schema)
