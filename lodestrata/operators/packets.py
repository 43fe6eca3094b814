"""Sensor packets in the frame of a right-handed wearer, corrections of their readings, and features of their channels, as column expressions and windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import estimators as E
from lodestrata.operators import rotations as R


def turned(vector: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    """A vector in the frame that a quaternion (w, x, y, z) turns it to."""
    w, x, y, z = q
    a, b, c = vector
    return [
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c,
        2 * (x * y + w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - w * x) * c,
        2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (1 - 2 * (x * x + y * y)) * c,
    ]


def normalized(d: DataFrame, gyro: Sequence[str], accel: Sequence[str], mount: Sequence[Column], left: Column, done: Column) -> DataFrame:
    """The readings turned by the mount's quaternion and, of a left-handed wearer, mirrored across x; rows that are done already stay.

    A mirror turns accelerations as vectors and rates as axes the other way. A null mount is none; null flags are false.
    """
    q = [F.coalesce(c, F.lit(v)) for c, v in zip(mount, (1.0, 0.0, 0.0, 0.0))]
    left, done = F.coalesce(left, F.lit(False)), F.coalesce(done, F.lit(False))
    out = {}
    for names, signs in ((gyro, (1, -1, -1)), (accel, (-1, 1, 1))):
        for name, v, s in zip(names, turned([F.col(n).cast("double") for n in names], q), signs):
            out[name] = F.when(done, F.col(name).cast("double")).when(left, s * v).otherwise(v)
    return d.withColumns(out)


def bounded_bias(d: DataFrame, keys: Sequence[str], gyro: Sequence[str], rest: Column, limit: float = 0.2, least: float = 0.05) -> DataFrame:
    """(keys, n, bias, gain): per axis the constant within limits that leaves the rates at rest smallest, in the sense of squares, and the share by
    which it lessens them; zero where that is below least. The minimum of a square within bounds is the mean, cut to them."""
    agg = [F.count(F.when(rest, 1)).alias("n")]
    for g in gyro:
        v = F.when(rest & (F.abs(F.nanvl(F.col(g).cast("double"), F.lit(float("inf")))) < float("inf")), F.col(g).cast("double"))
        agg += [F.avg(v).alias(f"__m_{g}"), F.avg(v * v).alias(f"__s_{g}")]
    x = d.groupBy(*keys).agg(*agg)
    best = {g: F.when(F.col(f"__m_{g}").isNull(), 0.0).otherwise(F.least(F.greatest(F.col(f"__m_{g}"), F.lit(-limit)), F.lit(limit))) for g in gyro}
    before = sum((F.coalesce(F.col(f"__s_{g}"), F.lit(0.0)) for g in gyro), F.lit(0.0))
    after = sum((F.coalesce(F.col(f"__s_{g}") - 2 * best[g] * F.col(f"__m_{g}") + best[g] * best[g], F.lit(0.0)) for g in gyro), F.lit(0.0))
    gain = F.coalesce(1 - F.try_divide(after, before), F.lit(0.0))
    return x.select(*keys, "n", F.when(gain >= least, F.array(*best.values())).otherwise(F.array(*(F.lit(0.0) for _ in gyro))).alias("bias"), F.when(gain >= least, gain).otherwise(0.0).alias("gain"))


def without_resonance(d: DataFrame, keys: Sequence[str], t: str, value: str, frequency: float, damping: float) -> DataFrame:
    """Adds straight: what drove a second-order sensor of a frequency in Hz and a damping to give value, from differences to the two rows before."""
    w = Window.partitionBy(*keys).orderBy(t)
    omega = 2 * np.pi * frequency
    dt = F.col(t) - F.lag(t).over(w)
    d = d.withColumn("__r", F.coalesce(F.try_divide(F.col(value) - F.lag(value).over(w), dt), F.lit(0.0))).withColumn("__dt", dt)
    accel = F.coalesce(F.try_divide(F.col("__r") - F.lag("__r").over(w), F.col("__dt")), F.lit(0.0))
    return d.withColumn("straight", F.col(value) + 2 * damping / omega * F.col("__r") + accel / omega**2).drop("__r", "__dt")


def simple_phases(d: DataFrame, keys: Sequence[str], t: str, rate: str, still: float = 0.5, moving: float = 1.5) -> DataFrame:
    """(keys, address, top, impact, finish): times by absolute thresholds of the rate: the last still row before the first moving one, the slowest row between
    that and the fastest, the fastest, and the first still row after it; null where a threshold is never met. Ties go to the earlier row."""
    w = Window.partitionBy(*keys)
    r = F.col(rate)
    x = d.where(r.isNotNull() & F.col(t).isNotNull()).select(*keys, F.col(t).alias("__t"), r.alias("__r"))
    x = x.withColumn("__start", F.min(F.when(F.col("__r") > moving, F.col("__t"))).over(w)).withColumn("__impact", F.min_by("__t", F.struct(-F.col("__r"), F.col("__t"))).over(w))
    between = (F.col("__t") > F.col("__start")) & (F.col("__t") < F.col("__impact"))
    return x.groupBy(*keys).agg(
        F.max(F.when((F.col("__t") < F.col("__start")) & (F.col("__r") <= still), F.col("__t"))).alias("address"),
        F.min_by(F.when(between, F.col("__t")), F.when(between, F.struct("__r", "__t"))).alias("top"),
        F.max(F.when(F.col("__start").isNotNull(), F.col("__impact"))).alias("impact"),
        F.min(F.when((F.col("__t") > F.col("__impact")) & F.col("__start").isNotNull() & (F.col("__r") <= still), F.col("__t"))).alias("finish"),
    )


def peak_sequence(d: DataFrame, keys: Sequence[str], t: str, channels: Sequence[str]) -> DataFrame:
    """(keys, sequence): the channels in the order in which their sizes peak, by commas; of several equal peaks the first counts, of equal times the first name."""
    at = [F.struct(F.min_by(t, F.struct(-F.abs(c), F.col(t))).alias("t"), F.lit(c).alias("c")) for c in channels]
    g = d.groupBy(*keys).agg(*(x.alias(f"__p{i}") for i, x in enumerate(at)))
    peaks = F.array_sort(F.filter(F.array(*(f"__p{i}" for i in range(len(at)))), lambda x: x["t"].isNotNull()))
    return g.select(*keys, F.array_join(F.transform(peaks, lambda x: x["c"]), ",").alias("sequence"))


def release_profile(d: DataFrame, keys: Sequence[str], t: str, rate: str) -> DataFrame:
    """(keys, peak, peak_t, half_share): the greatest rate, when it first occurs, and the share of rows at half of it or more."""
    g = d.where(F.col(rate).isNotNull()).withColumn("__peak", F.max(rate).over(Window.partitionBy(*keys))).groupBy(*keys)
    return g.agg(F.max(rate).alias("peak"), F.min_by(t, F.struct(-F.col(rate), F.col(t))).alias("peak_t"), F.avg((F.col(rate) >= F.col("__peak") / 2).cast("int")).alias("half_share"))


def linear_proxy(columns: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """A weighted sum of columns; null where one is."""
    return sum((F.col(c) * w for c, w in zip(columns, weights)), F.lit(bias))


def segment_channels(d: DataFrame, keys: Sequence[str], t: str, gyro: Sequence[str], accel: Sequence[str], axis: Sequence[float] = (1.0, 0.0, 0.0), flt: str = "gated") -> DataFrame:
    """(keys, n, twist_range, swing_range, twist_rate): how far, in degrees, a segment turns about its own axis and away from where it began, and the greatest
    rate of the former in degrees a second. Groups in a portion of rows are stepped together; null readings count as zero."""
    kinds = dict(d.dtypes)
    along = np.asarray(axis, float) / np.linalg.norm(axis)

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        x, g, a = (np.nan_to_num(pdf[c].to_numpy(float), posinf=0, neginf=0) for c in (t, list(gyro), list(accel)))
        q = E.FILTERS[flt]().run_many(x, g, a, starts)
        rows = []
        for b, e in zip(starts, np.r_[starts[1:], len(pdf)]):
            swing, twist = R.swing_twist(R.multiply(R.conjugate(q[b]), q[b:e]), along)
            angle = np.unwrap(2 * np.arctan2(R.dot(twist[:, 1:], along), twist[:, 0]))
            step = np.maximum(np.diff(x[b:e]), 1e-6)
            rows.append((e - b, np.degrees(np.ptp(angle)), np.degrees(R.norm(R.logarithm(swing)).max()), np.degrees(np.abs(np.diff(angle) / step).max()) if e - b > 1 else 0.0))
        out = pdf.iloc[starts][list(keys)].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(rows, columns=["n", "twist_range", "swing_range", "twist_rate"])], axis=1)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, twist_range double, swing_range double, twist_rate double"
    rows = E.by_groups(d.where(F.col(t).isNotNull()).select(*keys, t, *gyro, *accel), keys, [t])
    return rows.mapInPandas(E.whole_groups(keys, run, E.PORTION), schema)
