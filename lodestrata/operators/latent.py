"""Latent regression: robust principal components of observations and targets, joined by ridge regression, with calibrated validity.

All that is fitted comes from aggregates: sketches of each place's median and spread, one matrix of second moments whose
size the vectors' lengths fix, and quantiles of the residuals of rows held out. Only those reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.estimators import added

# Residual beyond which an observation is foreign, spreads to which its components are clipped, the residual it then has at least.
FOREIGN, CLIP, FOREIGN_RESIDUAL = 2.5, 6.0, 0.8
# Share of a personal line that is its own rather than the identity; pairs it needs; spread below which only the offset is its own.
OWN_SHARE, OWN_PAIRS, OWN_SPREAD = 0.85, 3, 1e-6


@dataclass(frozen=True)
class Components:
    center: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    spread: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.axes

    def decode(self, z: np.ndarray) -> np.ndarray:
        return (z @ self.axes.T) * self.scale + self.center

    def residual(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.norm((x - self.decode(self.encode(x))) / (self.scale + 1e-9), axis=1) / np.sqrt(x.shape[1])


@dataclass(frozen=True)
class Model:
    observed: Components
    target: Components
    weights: np.ndarray
    intercept: np.ndarray
    ok: float = float("inf")
    degraded: float = float("inf")

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(targets, residuals, foreign): foreign observations are clipped before they are decoded."""
        r = self.observed.residual(x)
        foreign = ~(r <= FOREIGN)
        limit = CLIP * np.sqrt(self.observed.spread)
        z = np.nan_to_num(self.observed.encode(x))
        z = np.where(foreign[:, None], np.clip(z, -limit, limit), z)
        return self.target.decode(z @ self.weights + self.intercept), np.where(foreign, np.maximum(np.nan_to_num(r, nan=9.0, posinf=9.0), FOREIGN_RESIDUAL), r), foreign


def center_and_scale(d: DataFrame, vector: str, size: int, accuracy: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Median and 1.4826 * MAD (1e-6 at least) of each place of vectors of a size, from quantile sketches."""
    places = d.where(F.size(vector) == size).select(F.posexplode(F.col(vector).cast("array<double>")).alias("p", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    c = places.groupBy("p").agg(F.percentile_approx("v", 0.5, accuracy).alias("c"))
    s = places.join(F.broadcast(c), "p").groupBy("p").agg(F.first("c").alias("c"), F.percentile_approx(F.abs(F.col("v") - F.col("c")), 0.5, accuracy).alias("s"))
    rows = {r["p"]: (r["c"], max(1.4826 * r["s"], 1e-6)) for r in s.collect()}
    return np.array([rows.get(k, (0.0, 1.0))[0] for k in range(size)]), np.array([rows.get(k, (0.0, 1.0))[1] for k in range(size)])


def _leading(cov: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    val, vec = np.linalg.eigh(cov)
    k = max(1, min(k, int((val > 1e-12).sum()), max(n - 1, 1)))
    return vec[:, ::-1][:, :k], np.maximum(val[::-1][:k], 0.0)


def held_out(key: str, share: int = 4) -> Column:
    """Whether a row is one of those that calibrate, by a hash of its key: one of so many."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(share)) == 0


def fit(d: DataFrame, x: str, y: str, sizes: tuple[int, int], key: str, k_in: int = 10, k_out: int = 4, penalty: float = 1e-3) -> Model:
    """The model of y by x, both vectors of fixed sizes; a quarter of the rows, by a hash of the key, is held out for the calibration.

    Vectors of other sizes or with null or non-finite places are left out. Rows are read three times, only aggregates move.
    """
    finite = lambda c: ~F.exists(F.col(c).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    d = d.where((F.size(x) == sizes[0]) & (F.size(y) == sizes[1]) & finite(x) & finite(y))
    train = d.where(~held_out(key))
    (cx, sx), (cy, sy) = center_and_scale(train, x, sizes[0]), center_and_scale(train, y, sizes[1])
    total = sum(sizes) + 1

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = np.zeros((total, total)), 0
        for b in batches:
            if len(b):
                z = np.c_[(np.vstack(b["x"]) - cx) / sx, (np.vstack(b["y"]) - cy) / sy, np.ones(len(b))]
                m, n = m + z.T @ z, n + len(z)
        yield pd.DataFrame({"m": [m.tobytes()], "n": [n]})

    m, n = added(train.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).mapInPandas(moments, "m binary, n long"))
    if not n:
        raise ValueError("no rows to fit")
    m = m.reshape(total, total) / n
    mean = m[-1, :-1]
    cov = (m[:-1, :-1] - np.outer(mean, mean)) * n / max(n - 1, 1)
    p = sizes[0]
    (ax, vx), (ay, vy) = _leading(cov[:p, :p], k_in, n), _leading(cov[p:, p:], k_out, n)
    inner, cross = ax.T @ cov[:p, :p] @ ax * n, ax.T @ cov[:p, p:] @ ay * n
    w = np.linalg.solve(inner + penalty * np.eye(len(inner)), cross)
    model = Model(Components(cx, sx, ax, vx), Components(cy, sy, ay, vy), w, mean[p:] @ ay - mean[:p] @ ax @ w)
    q = predict(d.where(held_out(key)), model, x, []).agg(F.percentile_approx("residual", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), 10_000).alias("q")).first()["q"]
    if not q:
        return model
    ok = max(q[1], q[0] + 1e-6)
    return Model(model.observed, model.target, w, model.intercept, ok, max(q[2], 1.05 * ok))


def predict(d: DataFrame, model: Model, vector: str, keys: Sequence[str]) -> DataFrame:
    """(keys, prediction, residual, validity) of vectors of the model's length; the model, of fixed size, is broadcast.

    validity is ok, degraded or abstain by the residual's place among those held out; foreign observations are never ok.
    """
    held = d.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<prediction:array<double>,residual:double,foreign:boolean>")
    def run(x: pd.Series) -> pd.DataFrame:
        y, r, f = held.value.predict(np.vstack(x).astype(float))
        return pd.DataFrame({"prediction": list(y), "residual": r, "foreign": f})

    size = len(model.observed.center)
    d = d.where(F.size(vector) == size).withColumn("r", run(F.col(vector).cast("array<double>")))
    validity = F.when(F.col("r.residual") > model.degraded, "abstain").when((F.col("r.residual") > model.ok) | F.col("r.foreign"), "degraded").otherwise("ok")
    return d.select(*keys, "r.prediction", "r.residual", validity.alias("validity"))


def personal_lines(d: DataFrame, keys: Sequence[str], predicted: str, measured: str) -> DataFrame:
    """(keys, n, slope, offset): the line from predicted to measured per group, drawn towards the identity, from sums.

    Pairs with a null or non-finite value do not count; groups of too few pairs have the identity, those without spread an offset.
    """
    x, y = F.col(predicted).cast("double"), F.col(measured).cast("double")
    ok = F.coalesce((F.abs(F.nanvl(x, F.lit(float("inf")))) < float("inf")) & (F.abs(F.nanvl(y, F.lit(float("inf")))) < float("inf")), F.lit(False))
    x, y = F.when(ok, x), F.when(ok, y)
    g = d.groupBy(*keys).agg(F.count(x).alias("n"), F.stddev_pop(x).alias("__sd"), F.avg(y - x).alias("__off"), F.regr_slope(y, x).alias("__a"), F.regr_intercept(y, x).alias("__b"))
    few, flat = F.col("n") < OWN_PAIRS, F.col("__sd") < OWN_SPREAD
    slope = F.when(few | flat, 1.0).otherwise(OWN_SHARE * F.col("__a") + 1 - OWN_SHARE)
    return g.select(*keys, "n", slope.alias("slope"), F.when(few, 0.0).when(flat, F.col("__off")).otherwise(OWN_SHARE * F.col("__b")).alias("offset"))


def random_features(d: DataFrame, vector: str, size: int, width: int = 128, seed: int = 11) -> DataFrame:
    """Adds hidden: tanh of a fixed random projection, the first layer of a small regression on a device."""
    r = np.random.default_rng(seed)
    w, b = r.standard_normal((size, width)) / np.sqrt(size), r.standard_normal(width) * 0.1

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.tanh(np.vstack(x).astype(float) @ w + b)))

    return d.where(F.size(vector) == size).withColumn("hidden", run(F.col(vector).cast("array<double>")))


def held_out_groups(d: DataFrame, group: str, x: str, y: str, sizes: tuple[int, int], key: str, groups: Sequence[str], **settings) -> DataFrame:
    """(group, n, mean_abs_error, mean_residual, ok_share): each of the named groups predicted by a model of all the others."""
    out = None
    for g in groups:
        rest, own = d.where(~F.col(group).eqNullSafe(F.lit(g))), d.where(F.col(group) == g)
        p = predict(own, fit(rest, x, y, sizes, key, **settings), x, [group, F.col(y).cast("array<double>").alias("__y")])
        off = F.aggregate(F.zip_with("prediction", "__y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / sizes[1]
        p = p.groupBy(group).agg(F.count("*").alias("n"), F.avg(off).alias("mean_abs_error"), F.avg("residual").alias("mean_residual"), F.avg((F.col("validity") == "ok").cast("int")).alias("ok_share"))
        out = p if out is None else out.unionByName(p)
    return out


def student(d: DataFrame, vector: str, target: str, size: int, width: int = 64, penalty: float = 1e-2) -> DataFrame:
    """(n, coefficients, intercept): ridge regression of a number on the random features of a vector, the last layer of a small regression on a device; from one matrix of sums."""
    h = random_features(d.where(F.col(target).isNotNull()), vector, size, width).select("hidden", F.col(target).cast("double").alias("y"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = np.zeros((width + 2, width + 2)), 0
        for b in batches:
            if len(b):
                z = np.c_[np.vstack(b["hidden"]), b["y"].to_numpy(float), np.ones(len(b))]
                m, n = m + z.T @ z, n + len(z)
        yield pd.DataFrame({"m": [m.tobytes()], "n": [n]})

    m, n = added(h.mapInPandas(sums, "m binary, n long"))
    schema = "n long, coefficients array<double>, intercept double"
    if not n:
        return d.sparkSession.createDataFrame([], schema)
    m = m.reshape(width + 2, width + 2)
    mean = m[-1, :-1] / n
    cov = m[:-1, :-1] - n * np.outer(mean, mean)
    w = np.linalg.solve(cov[:-1, :-1] + penalty * np.eye(width), cov[:-1, -1])
    return d.sparkSession.createDataFrame([(n, w.tolist(), float(mean[-1] - mean[:-1] @ w))], schema)
