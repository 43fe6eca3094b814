"""Orientation filters and small fits per group.

Filters are recursions over time. A portion of rows holds many groups, whose samples are stepped together as rows of an
array; groups of long duration are cut into spans that overlap by a margin, and the turns of their spans multiply.
Fits whose sums are small go through ordinary aggregation and solve a matrix of fixed size per group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.batches import by_groups, whole_groups
from lodestrata.operators.rotations import IDENTITY, UP, conjugate, dot, exponential, logarithm, multiply, norm, rotate, shortest, skew, slerp, unit

G = 9.80665
#: Rows that are stepped together at least.
PORTION = 200_000


def trust(accel: np.ndarray, gyro: np.ndarray, before: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """How far an acceleration can be taken for gravity: near 1 g, slow, steady."""
    a = norm(accel)
    jerk = norm(gyro - before) / dt
    return np.where(a < 1e-9, 0.0, np.exp(-(((a - G) / 0.5) ** 2) - (norm(gyro) / 0.8) ** 2 - (jerk / 5) ** 2))


def lean(q: np.ndarray, accel: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The orientation with a share of its tilt against the acceleration taken off, in the world's frame."""
    back = logarithm(shortest(rotate(q, accel), UP))
    return multiply(exponential(back * np.where(norm(accel) < 1e-9, 0.0, share)[..., None]), q)


class Filter:
    """reset() and update(gyro, accel, dt): the same steps for a batch and for a stream, for one series or for rows of several."""

    #: Arrays of the state, a row a series.
    state = ("q", "bias", "before")

    def reset(self, accel: np.ndarray) -> None:
        accel = np.nan_to_num(np.asarray(accel, float), posinf=0, neginf=0)
        self.q = np.where(norm(accel)[..., None] > 1e-9, shortest(accel, UP), IDENTITY)
        self.bias, self.before = np.zeros(accel.shape), np.zeros(accel.shape)

    def keep(self, n: int) -> None:
        """Goes on with the first n series only."""
        for name in self.state:
            setattr(self, name, getattr(self, name)[:n])

    def update(self, gyro: np.ndarray, accel: np.ndarray, dt: float | np.ndarray) -> np.ndarray:
        gyro, accel = np.nan_to_num(gyro, posinf=0, neginf=0), np.nan_to_num(accel, posinf=0, neginf=0)
        last = self.q
        q = unit(self.step(gyro, accel, np.maximum(np.asarray(dt, float), 1e-6)))
        self.q = np.where(dot(q, last)[..., None] >= 0, q, -q)
        self.before = gyro
        return self.q

    def step(self, gyro: np.ndarray, accel: np.ndarray, dt: np.ndarray) -> np.ndarray:
        return multiply(self.q, exponential(gyro * dt[..., None]))

    def run(self, t: np.ndarray, gyro: np.ndarray, accel: np.ndarray) -> np.ndarray:
        """The orientations of one series."""
        return self.run_many(np.asarray(t, float), np.asarray(gyro, float), np.asarray(accel, float), np.zeros(min(len(t), 1), int))

    def run_many(self, t: np.ndarray, gyro: np.ndarray, accel: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The orientations of several series in succession, which begin at starts; a step takes the next sample of each."""
        out = np.empty((len(t), 4))
        if not len(t):
            return out
        size = np.diff(np.r_[starts, len(t)])
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        self.reset(accel[starts])
        out[starts] = self.q
        longer = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # series with more than so many samples
        n = len(starts)
        for k in range(1, int(size[0])):
            if longer[k] < n:
                n = int(longer[k])
                self.keep(n)
            at = starts[:n] + k
            out[at] = self.update(gyro[at], accel[at], t[at] - t[at - 1])
        return out


class Complementary(Filter):
    def step(self, gyro, accel, dt):
        return lean(unit(super().step(gyro, accel, dt)), accel, 1 - np.exp(-2 * dt))


class Mahony(Filter):
    kp, ki = 2.0, 0.05

    def step(self, gyro, accel, dt):
        e = np.cross(unit(accel), rotate(conjugate(self.q), UP)) * (norm(accel) > 1e-9)[..., None]
        self.bias = self.bias - self.ki * e * dt[..., None]
        return multiply(self.q, exponential((gyro - self.bias + self.kp * e) * dt[..., None]))


class Madgwick(Filter):
    beta = 0.1

    def step(self, gyro, accel, dt):
        w, x, y, z = np.moveaxis(self.q, -1, 0)
        f = np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=-1) - unit(accel)
        # the gradient of half the squared distance f, place by place
        down = np.stack([-2 * y * f[..., 0] + 2 * x * f[..., 1], 2 * z * f[..., 0] + 2 * w * f[..., 1] - 4 * x * f[..., 2], -2 * w * f[..., 0] + 2 * z * f[..., 1] - 4 * y * f[..., 2], 2 * x * f[..., 0] + 2 * y * f[..., 1]], axis=-1)
        turn = 0.5 * multiply(self.q, np.concatenate([np.zeros_like(gyro[..., :1]), gyro], axis=-1))
        return self.q + (turn - self.beta * unit(down) * (norm(accel) > 1e-9)[..., None]) * dt[..., None]


class Gated(Filter):
    """Corrects tilt and learns the bias at rest only, as far as the acceleration is trusted."""

    def step(self, gyro, accel, dt):
        rest = (np.abs(norm(accel) - G) <= 0.06 * G) & (norm(gyro) <= 0.25)
        self.bias = self.bias + (np.where(rest, 1 - np.exp(-dt / 0.5), 0.0))[..., None] * (gyro - self.bias)
        q = unit(multiply(self.q, exponential((gyro - self.bias) * dt[..., None])))
        return lean(q, accel, np.where(rest, 1 - np.exp(-3 * trust(accel, gyro, self.before, dt) * dt), 0.0))


class Kalman(Filter):
    """An extended Kalman filter of the error of orientation and bias: the gyro predicts, the direction of gravity corrects."""

    state = ("q", "bias", "before", "p")
    # Initial variances of angle and bias; noise of gyro, bias and direction; the greatest factor on it and the greatest correction.
    angle0, bias0, gyro_noise, bias_noise, direction_noise, most_noise, most_turn = 0.0625, 0.04, 0.03, 0.001, 0.05, 1e6, 0.5

    def reset(self, accel):
        super().reset(accel)
        self.p = np.broadcast_to(np.diag([self.angle0] * 3 + [self.bias0] * 3), (*self.q.shape[:-1], 6, 6)).copy()

    def step(self, gyro, accel, dt):
        w, h = gyro - self.bias, dt[..., None, None]
        q = unit(multiply(self.q, exponential(w * dt[..., None])))
        move = np.zeros(self.p.shape)
        move[..., range(6), range(6)] = 1.0
        move[..., :3, :3] -= skew(w) * h
        move[..., :3, 3:] = -np.eye(3) * h
        p = move @ self.p @ np.swapaxes(move, -1, -2)
        p[..., range(3), range(3)] += (self.gyro_noise * dt[..., None]) ** 2
        p[..., range(3, 6), range(3, 6)] += self.bias_noise**2 * dt[..., None]
        up = rotate(conjugate(q), UP)
        see = np.concatenate([skew(up), np.zeros((*up.shape[:-1], 3, 3))], axis=-1)
        sure = np.maximum(trust(accel, gyro, self.before, dt), 1 / self.most_noise)
        noise = np.eye(3) * (self.direction_noise**2 / sure)[..., None, None]
        gain = p @ np.swapaxes(see, -1, -2) @ np.linalg.inv(see @ p @ np.swapaxes(see, -1, -2) + noise)
        gain = gain * (norm(accel) > 1e-9)[..., None, None]
        x = np.einsum("...ij,...j->...i", gain, unit(accel) - up)
        turn = x[..., :3] * np.minimum(1.0, self.most_turn / np.maximum(norm(x[..., :3]), 1e-12))[..., None]
        left = np.eye(6) - gain @ see
        self.p = left @ p @ np.swapaxes(left, -1, -2) + gain @ noise @ np.swapaxes(gain, -1, -2)
        self.bias = self.bias + x[..., 3:]
        return multiply(q, exponential(turn))


class Rested(Filter):
    """The gyro alone, less the mean of its readings at rest so far."""

    state = ("q", "bias", "before", "n")

    def reset(self, accel):
        super().reset(accel)
        self.n = np.zeros(self.q.shape[:-1])

    def step(self, gyro, accel, dt):
        rest = (np.abs(norm(accel) - G) <= 0.06 * G) & (norm(gyro) <= 0.25)
        self.n = self.n + rest
        self.bias = self.bias + np.where(rest, 1 / np.maximum(self.n, 1), 0.0)[..., None] * (gyro - self.bias)
        return multiply(self.q, exponential((gyro - self.bias) * dt[..., None]))


FILTERS: dict[str, Callable[[], Filter]] = {"gyro": Filter, "rested": Rested, "complementary": Complementary, "mahony": Mahony, "madgwick": Madgwick, "kalman": Kalman, "gated": Gated}


def smooth_both_ways(name: str, t: np.ndarray, gyro: np.ndarray, accel: np.ndarray) -> np.ndarray:
    """A filter run forward, and backward from where it ended, blended from the one at the end to the other at the start."""
    forward = FILTERS[name]().run(t, gyro, accel)
    if len(t) < 2:
        return forward
    f = FILTERS[name]()
    f.reset(accel[-1])
    f.q = forward[-1]
    back = np.empty_like(forward)
    back[-1] = f.q
    for i in range(len(t) - 2, -1, -1):
        back[i] = f.update(-gyro[i + 1], accel[i], t[i + 1] - t[i])
    return slerp(back, forward, np.arange(len(t)) / (len(t) - 1))


def spans(d: DataFrame, keys: Sequence[str], t: str, span: float, margin: float) -> DataFrame:
    """The rows with __c, their span of that duration counted from the first time of their group; rows of a margin before the next one are in both, and not __own there."""
    first = d.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min(t).alias("__t0"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    since = F.col(t) - F.col("__t0")
    own = F.floor(since / span)
    both = F.when(since >= (own + 1) * span - margin, F.array(F.struct(own.alias("c"), F.lit(True).alias("own")), F.struct((own + 1).alias("c"), F.lit(False).alias("own"))))
    names = d.columns
    d = d.join(first, on).select(*names, F.explode(F.coalesce(both, F.array(F.struct(own.alias("c"), F.lit(True).alias("own"))))).alias("__s"))
    return d.select(*names, F.col("__s.c").alias("__c"), F.col("__s.own").alias("__own"))


def orientations(d: DataFrame, keys: Sequence[str], t: str, gyro: Sequence[str], accel: Sequence[str], filters: Sequence[str] = tuple(FILTERS), span: float = 600.0, margin: float = 30.0) -> DataFrame:
    """(keys, filter, n, turn_deg, tilt_deg): for each filter the angle turned from first to last and the last tilt of gravity.

    Rows with null t are left out and of equal times one counts; other nulls count as zero readings. A group that lasts
    longer than span seconds is several tasks: a span begins with the margin before it, in which a filter finds the
    vertical again, and what its heading turns within the span does not depend on where it began. Shorter groups are exact.
    """
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        first = np.zeros(len(pdf), bool)
        first[starts] = True
        x = pdf[t].to_numpy(float)
        pdf = pdf[first | np.r_[True, x[1:] != x[:-1]]]
        starts = np.flatnonzero(first[first | np.r_[True, x[1:] != x[:-1]]])
        x, g, a = (np.nan_to_num(pdf[c].to_numpy(float), posinf=0, neginf=0) for c in (t, list(gyro), list(accel)))
        own = pdf["__own"].to_numpy(bool)
        ends = np.r_[starts[1:], len(pdf)] - 1
        n = np.add.reduceat(own.astype(int), starts)
        begin = starts + np.maximum((ends - starts + 1) - n - 1, 0)  # the last row of the margin
        out = []
        for name in filters:
            q = FILTERS[name]().run_many(x, g, a, starts)
            turn = multiply(conjugate(q[begin]), q[ends])
            last = rotate(q[ends], a[ends])
            tilt = np.where(norm(a[ends]) > 1e-9, np.degrees(np.arccos(np.clip(unit(last)[:, 2], -1, 1))), np.nan)
            out.append(pdf.iloc[starts][[*keys, "__c"]].assign(filter=name, n=n, turn=list(turn), tilt=tilt))
        out = pd.concat(out, ignore_index=True)
        return out[out["n"] > 0]

    rows = spans(d.where(F.col(t).isNotNull()).select(*keys, t, *gyro, *accel), keys, t, span, margin)
    parts = by_groups(rows, [*keys, "__c"], [t]).mapInPandas(whole_groups([*keys, "__c"], run, PORTION), f"{schema}, __c long, filter string, n long, turn array<double>, tilt double")

    @F.pandas_udf("array<double>")
    def product(turns: pd.Series) -> pd.Series:
        out = []
        for qs in turns:
            q = IDENTITY
            for p in qs:
                q = unit(multiply(q, np.asarray(p)))
            out.append(list(q))
        return pd.Series(out)

    def joined(p: DataFrame, by: Sequence) -> DataFrame:
        order = F.transform(F.array_sort(F.collect_list(F.struct("__c", "turn"))), lambda x: x["turn"])
        p = p.groupBy(*by).agg(F.sum("n").alias("n"), F.max_by("tilt", "__c").alias("tilt"), order.alias("turn"))
        return p.withColumn("turn", product("turn"))

    # turns of spans multiply in any grouping: first a few thousand spans at a time, then those
    p = joined(parts, [*keys, "filter", F.floor(F.col("__c") / 4096).alias("__d")]).withColumnRenamed("__d", "__c")
    p = joined(p, [*keys, "filter"])
    return p.select(*keys, "filter", "n", F.degrees(2 * F.acos(F.least(F.abs(F.col("turn")[0]), F.lit(1.0)))).alias("turn_deg"), F.col("tilt").alias("tilt_deg"))


def covariance(d: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, mean_<a>, cov_<a>_<b>): population moments from sums, over rows without nulls or non-finite values."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return d.where(ok).groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns), *(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cov_{a}_{b}") for a, b in pairs))


def plane_fit(d: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, normal, flatness): the direction of least spread, z upward, and its share of the whole; from 3 x 3 moments."""
    a, b, c = columns
    m = covariance(d, keys, columns)

    @F.pandas_udf("struct<normal:array<double>,flatness:double>")
    def solve(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        s = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]).transpose(2, 0, 1)
        val, vec = np.linalg.eigh(s)
        n = vec[:, :, 0] * np.where(vec[:, 2:3, 0] < 0, -1.0, 1.0)
        total = val.sum(axis=1)
        return pd.DataFrame({"normal": list(n), "flatness": np.where(total > 0, val[:, 0] / np.where(total > 0, total, 1), 0.0)})

    fit = solve(*(f"cov_{p}_{q}" for p, q in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))))
    return m.where("n >= 3").withColumn("f", fit).select(*keys, "n", "f.normal", "f.flatness")


def ridge(d: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, penalty: float = 1e-3) -> DataFrame:
    """(keys, n, coefficients, intercept): ridge regression from the moments of features and target."""
    cols = [*features, target]
    m = covariance(d, keys, cols)
    p = len(features)
    feature_pairs = [(i, j) for i in range(p) for j in range(i, p)]
    name = lambda i, j: f"cov_{cols[min(i, j)]}_{cols[max(i, j)]}"

    @F.pandas_udf("struct<coefficients:array<double>,intercept:double>")
    def solve(n: pd.Series, means: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
        out = []
        for k, mean, q, r in zip(n, means, xx, xy):
            s = np.zeros((p, p))
            for (i, j), v in zip(feature_pairs, q):
                s[i, j] = s[j, i] = v
            w = np.linalg.solve(s * k + penalty * np.eye(p), np.asarray(r) * k)
            out.append((list(w), float(mean[-1] - np.asarray(mean[:-1]) @ w)))
        return pd.DataFrame(out, columns=["coefficients", "intercept"])

    f = solve("n", F.array(*(f"mean_{c}" for c in cols)), F.array(*(F.col(name(i, j)) for i, j in feature_pairs)), F.array(*(F.col(name(i, p)) for i in range(p))))
    return m.withColumn("f", f).select(*keys, "n", "f.coefficients", "f.intercept")


def arm_of(t: np.ndarray, q: np.ndarray, gyro: np.ndarray, accel: np.ndarray, robust: float = 1.345) -> tuple[np.ndarray, int, float]:
    """(arm, rank, rms): the rigid arm L with ([w]x[w]x + [dw]x) L = acceleration without gravity, by weighted least squares.

    Gravity is taken off by the orientation q. Small singular values are cut; a second pass gives residuals beyond robust
    times their spread less weight. rms is over the weighted rows.
    """
    dw = np.gradient(gyro, t, axis=0)
    m = skew(gyro) @ skew(gyro) + skew(dw)
    rhs = accel - rotate(conjugate(q), np.array([0.0, 0.0, G]))
    weight = (gyro**2).sum(axis=1) + norm(dw)
    weight = np.sqrt(weight / max(float(weight.max()), 1e-12))
    arm, rank, rms = np.zeros(3), 0, 0.0
    for k in range(2):
        big, y = (m * weight[:, None, None]).reshape(-1, 3), (rhs * weight[:, None]).reshape(-1)
        u, s, vt = np.linalg.svd(big, full_matrices=False)
        keep = s > 0.01 * s[0] if s[0] > 0 else np.zeros(3, bool)
        arm = vt.T @ (np.where(keep, 1 / (s + 1e-6 * s[0] + 1e-300), 0) * (u.T @ y))
        rank, off = int(keep.sum()), big @ arm - y
        rms = float(np.sqrt(np.mean(off**2)))
        if k == 0:
            size = norm(off.reshape(-1, 3))
            limit = robust * 1.4826 * float(np.median(size))
            if limit < 1e-9:
                break
            weight = weight * np.sqrt(np.minimum(1.0, limit / np.maximum(size, 1e-12)))
    return arm, rank, rms


def lever_arm(d: DataFrame, keys: Sequence[str], t: str, gyro: Sequence[str], accel: Sequence[str], flt: str = "gated") -> DataFrame:
    """(keys, n, arm, rank, rms) of arm_of() per group, with the orientation of a filter; accel holds gravity, as a sensor reads it.

    Null and non-finite readings count as 0; fewer than five rows have no arm. A group is a swing or a session and one task.
    """
    kinds = dict(d.dtypes)
    names = [*keys, "n", "arm", "rank", "rms"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[t]).sort_values(t).drop_duplicates(t)
        head = [pdf[k].iloc[0] if len(pdf) else None for k in keys]
        if len(pdf) < 5:
            return pd.DataFrame([(*head, len(pdf), None, 0, None)] if len(pdf) else [], columns=names)
        w, a, x = (np.nan_to_num(pdf[c].to_numpy(float), posinf=0, neginf=0) for c in (list(gyro), list(accel), t))
        arm, rank, rms = arm_of(x, FILTERS[flt]().run(x, w, a), w, a)
        return pd.DataFrame([(*head, len(pdf), list(arm), rank, rms)], columns=names)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, arm array<double>, rank int, rms double"
    return d.select(*keys, t, *gyro, *accel).groupBy(*keys).applyInPandas(run, schema)


def added(parts: DataFrame, fan_in: int = 32) -> tuple[np.ndarray, int]:
    """The sum of arrays (m binary, n long) of one size, a row a partition, in two steps before the driver sees some of them."""

    def add(batches):
        m, n = 0.0, 0
        for b in batches:
            for x, k in zip(b["m"], b["n"]):
                m, n = m + np.frombuffer(x), n + int(k)
        if n:
            yield pd.DataFrame({"m": [m.tobytes()], "n": [n]})

    rows = parts.repartition(fan_in).mapInPandas(add, "m binary, n long").coalesce(4).mapInPandas(add, "m binary, n long").collect()
    return sum((np.frombuffer(r["m"]) for r in rows), np.zeros(1) if not rows else 0.0), sum(r["n"] for r in rows)


def manifold_scores(d: DataFrame, vector: str, keys: Sequence[str], rank: int = 6) -> DataFrame:
    """(keys, score, residual, confidence) of vectors against the main directions of their robustly scaled population.

    Medians and MADs of each place, then the second-moment matrix, whose size is fixed by the vectors' length, come
    from aggregation; only that matrix is decomposed on the driver.
    """
    places = d.select(F.posexplode(vector).alias("p", "v")).where(F.col("v").isNotNull())
    c = places.groupBy("p").agg(F.median("v").alias("c"))
    s = places.join(F.broadcast(c), "p").groupBy("p").agg(F.first("c").alias("c"), F.greatest(1.4826 * F.median(F.abs(F.col("v") - F.col("c"))), F.lit(1e-6)).alias("s"))
    rows = s.orderBy("p").collect()
    center, scale = np.array([r["c"] for r in rows]), np.array([r["s"] for r in rows])
    size = len(rows)

    def moments(batches):
        m, n = np.zeros((size, size)), 0
        for b in batches:
            z = (np.vstack(b["x"]).astype(float) - center) / scale if len(b) else np.zeros((0, size))
            m, n = m + z.T @ z, n + len(z)
        yield pd.DataFrame({"m": [m.tobytes()], "n": [n]})

    total, n = added(d.where(F.size(vector) == size).select(F.col(vector).cast("array<double>").alias("x")).mapInPandas(moments, "m binary, n long"))
    val, vec = np.linalg.eigh(total.reshape(size, size) / max(n - 1, 1) if n else np.zeros((size, size)))
    k = min(rank, size, max(n - 1, 1))
    val, vec = val[::-1][:k], vec[:, ::-1][:, :k]

    @F.pandas_udf("struct<score:double,residual:double,confidence:double>")
    def rate(x: pd.Series) -> pd.DataFrame:
        z = (np.vstack(x).astype(float) - center) / scale
        t = z @ vec
        score = np.sqrt((t**2 / np.maximum(val, 1e-12)).sum(1) / k)
        residual = np.linalg.norm(z - t @ vec.T, axis=1) / np.sqrt(size)
        return pd.DataFrame({"score": score, "residual": residual, "confidence": np.clip(1 / (1 + 0.5 * score + residual), 0.05, 0.95)})

    return d.where(F.size(vector) == size).withColumn("r", rate(F.col(vector).cast("array<double>"))).select(*keys, "r.*")
