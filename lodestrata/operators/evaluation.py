"""Errors of filters, segmentation and trajectories against swings whose truth is known."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import estimators as E
from lodestrata.operators import rotations as R
from lodestrata.operators import trajectory as T
from lodestrata.operators.segmentation import rest_mask, segment
from lodestrata.sources import synthetic

PHASES = ("address", "top", "impact", "finish")
RESULT = "track string, algorithm string, level string, seed int, k int, metric string, value double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def orientation_error(estimate: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Degrees between two series of orientations, the heading of the estimate aligned first."""
    return np.degrees(R.geodesic(R.multiply(R.yaw_between(estimate, truth), estimate), truth))


def position_error(estimate: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Distances between two paths from their first points, the heading of the estimate aligned first."""
    a, b = estimate - estimate[0], truth - truth[0]
    yaw = np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a[:, :2] * b[:, :2]).sum())
    return np.linalg.norm(R.rotate(R.exponential(np.array([0.0, 0.0, yaw])), a) - b, axis=1)


def _swings(pdf: pd.DataFrame) -> Iterator[tuple]:
    for level, seed, k in zip(pdf["level"], pdf["seed"], pdf["k"]):
        s = synthetic.swing(synthetic.varied(int(k), int(seed)))
        yield level, int(seed), int(k), s, synthetic.inject(s["t"], s["gyro"], s["accel"], synthetic.LEVELS[level], 1000 * int(seed) + int(k))


def orientation_results(cases: DataFrame, filters: Sequence[str] = tuple(E.FILTERS)) -> DataFrame:
    """Mean and greatest angle in degrees per case and filter; the swings of a batch are stepped together."""

    def run(batches):
        for b in batches:
            rows, made = [], list(_swings(b))
            if not made:
                continue
            t, g, a = (np.concatenate([m[4][i] for m in made]) for i in range(3))
            size = [len(m[3]["t"]) for m in made]
            starts = np.r_[0, np.cumsum(size)[:-1]]
            for name in filters:
                q = E.FILTERS[name]().run_many(t, g, a, starts)
                for (level, seed, k, s, _), at, n in zip(made, starts, size):
                    off = orientation_error(q[at : at + n], s["orientation"])
                    rows += [("orientation", name, level, seed, k, "mean_deg", off.mean()), ("orientation", name, level, seed, k, "max_deg", off.max())]
            yield pd.DataFrame(rows, columns=NAMES)

    return cases.mapInPandas(run, RESULT)


def sweep_results(grid: DataFrame, flt: str = "gated", level: str = "consumer_wrist", swings_each: int = 4) -> DataFrame:
    """(scale, seed, k, value): mean angle in degrees of a filter over swings whose errors are a level's, scaled."""

    def run(batches):
        for b in batches:
            rows = []
            for scale, seed in zip(b["scale"], b["seed"]):
                for k in range(swings_each):
                    s = synthetic.swing(synthetic.varied(k, int(seed)))
                    t, g, a = synthetic.inject(s["t"], s["gyro"], s["accel"], synthetic.LEVELS[level].scaled(float(scale)), 1000 * int(seed) + k)
                    rows.append((scale, seed, k, float(orientation_error(E.FILTERS[flt]().run(t, g, a), s["orientation"]).mean())))
            yield pd.DataFrame(rows, columns=["scale", "seed", "k", "value"])

    return grid.mapInPandas(run, "scale double, seed int, k int, value double")


def event_results(cases: DataFrame) -> DataFrame:
    """Milliseconds between the found and the true place of each phase; 'failed' is one where none was found."""

    def run(batches):
        for b in batches:
            rows = []
            for level, seed, k, s, (t, g, a) in _swings(b):
                p = segment(t, g, a)
                rows.append(("events", "segmental", level, seed, k, "failed", float(p is None)))
                if p:
                    rows += [("events", "segmental", level, seed, k, f"{name}_ms", abs(float(s["t"][p[i]] - s["t"][s["phases"][i]])) * 1000) for i, name in enumerate(PHASES)]
            yield pd.DataFrame(rows, columns=NAMES)

    return cases.mapInPandas(run, RESULT)


def trajectory_results(cases: DataFrame, flt: str = "gated") -> DataFrame:
    """Centimetres between the found and the true path from address to finish, by kind of trajectory."""

    def run(batches):
        for b in batches:
            rows = []
            for level, seed, k, s, (t, g, a) in _swings(b):
                q = E.FILTERS[flt]().run(t, g, a)
                lo, hi = int(s["phases"][0]), int(s["phases"][3])
                part = slice(lo, hi + 1)
                rest = rest_mask(g, a, 1 / float(np.median(np.diff(s["t"]))))
                world = T.world_acceleration(q, a)
                paths = {"hybrid": T.hybrid(s["t"], q, g, a, (lo, hi))[0], "lever": T.lever_positions(q[part], E.arm_of(s["t"][part], q[part], g[part], a[part])[0]), "rests": T.dead_reckon(s["t"], world, rest)[part]}
                for name, path in paths.items():
                    off = position_error(path, s["position"][part]) * 100
                    rows.append(("trajectory", name, level, seed, k, "mean_cm", float(off.mean())))
            yield pd.DataFrame(rows, columns=NAMES)

    return cases.mapInPandas(run, RESULT)


def summary(results: DataFrame, by: Sequence[str] = ("track", "algorithm", "level", "metric")) -> DataFrame:
    """(by, mean, p95, max, n) of finite values."""
    ok = results.where(F.abs(F.nanvl("value", F.lit(float("inf")))) < float("inf"))
    return ok.groupBy(*by).agg(F.avg("value").alias("mean"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("max"), F.count("*").alias("n"))


def mean_of_case_means(results: DataFrame, by: Sequence[str], case: Sequence[str]) -> DataFrame:
    """(by, mean, n_cases): each case counts once, however many values it has."""
    per = results.groupBy(*by, *case).agg(F.avg("value").alias("__m"))
    return per.groupBy(*by).agg(F.avg("__m").alias("mean"), F.count("*").alias("n_cases"))


def gate_violations(summaries: DataFrame, budgets: DataFrame) -> DataFrame:
    """(track, algorithm, level, metric, mean, max_value): summaries above the budget of their track, level and metric; a budget without summary has a null mean."""
    s = summaries.select("track", "level", "metric", "algorithm", "mean")
    d = budgets.select("track", "level", "metric", "max_value").join(s, ["track", "level", "metric"], "left")
    return d.where("mean is null or mean > max_value").select("track", "algorithm", "level", "metric", "mean", "max_value")
