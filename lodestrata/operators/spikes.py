"""Implausible readings: spikes, stuck values, impossible values and faulty clocks, per source.

A source's normal behaviour is kept as quantile sketches of its second differences, merged across
partitions per source and hour; readings are then judged in chunks of a source's rows with a margin
on either side, so that no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk, and of a margin. A run counts as stuck from rules.run_factor times the longest that chance explains; at the
#: greatest chance of a repeat that is judged, and for a million million readings, that is 2 * (1 + log(1e12) / -log(0.98)) = 2738 rows.
CHUNK, HALO = 65536, 2816
MOST_CHANCE = 0.98


@dataclass(frozen=True)
class Rules:
    """fence: interquartile ranges (as standard deviations) a jump must exceed; movement: times the change of the
    readings around it; run_factor: times the longest run expected by chance, 2 at most; least_run: the least
    length from which a run counts as stuck; same_t: rows in succession that share a clock value."""

    fence: float = 8.0
    movement: float = 2.0
    run_factor: float = 2.0
    least_run: int = 10
    same_t: int = 4


def _chunked(rows: DataFrame, key: str, axes: Sequence[str], limit: float) -> DataFrame:
    """Rows by chunk (k, c), each row of a margin also in the neighbouring chunk; v0, v1, ... are null where impossible."""
    at = F.floor(F.col("i") / CHUNK)
    off = F.col("i") - at * CHUNK
    chunks = F.when((off < HALO) & (at > 0), F.array(at, at - 1)).when(off >= CHUNK - HALO, F.array(at, at + 1)).otherwise(F.array(at))
    fits = [F.abs(F.nanvl(F.col(a).cast("double"), F.lit(float("inf")))) <= limit for a in axes]
    impossible = F.lit(False)
    for f in fits:
        impossible = impossible | F.coalesce(~f, F.lit(False))
    d = rows.where(F.col(key).isNotNull() & F.col("i").isNotNull())
    d = d.select(F.col(key).alias("k"), F.col("i").cast("long").alias("i"), F.nanvl(F.col("t").cast("double"), F.lit(None)).alias("t"), *(F.when(f, F.col(a).cast("double")).alias(f"v{n}") for n, (a, f) in enumerate(zip(axes, fits))), impossible.alias("impossible"))
    return d.select("k", "i", "t", *(f"v{n}" for n in range(len(axes))), "impossible", F.explode(chunks).alias("c")).repartition("k", "c")


def normal_behaviour(d: DataFrame, n_axes: int) -> DataFrame:
    """Per (k, c): spread of the noise, resolution, chance of a repeat and median time step, of the chunk's source and hour."""
    w = Window.partitionBy("k", "c").orderBy("i")
    vs = [f"v{n}" for n in range(n_axes)]
    d = d.select("k", "c", "i", "t", *vs, F.lag("i").over(w).alias("seen")).where("seen is null or seen <> i")
    d = d.select("k", "c", "t", *vs, F.lag(F.struct("t", *vs)).over(w).alias("p"), F.lag(F.struct("t", *vs), 2).over(w).alias("q"), F.lead(F.struct(*vs)).over(w).alias("x"), F.min("t").over(Window.partitionBy("k", "c")).alias("from"), (F.floor(F.col("i") / CHUNK) == F.col("c")).alias("core")).where("core")
    hour = F.coalesce(F.floor(F.col("from") / 3600), F.lit(-1))
    # a chunk lies in one hour, that of its first reading; an hour has few chunks
    aggs = [F.collect_set("c").alias("chunks"), F.count("*").alias("n"), F.percentile_approx(F.when(F.col("t") > F.col("p.t"), F.col("t") - F.col("p.t")), 0.5, 1000).alias("dt")]
    for v in vs:
        p, q, x = F.col(f"p.{v}"), F.col(f"q.{v}"), F.col(f"x.{v}")
        aggs += [
            F.percentile_approx(F.col(v) - (p + x) / 2, F.array(F.lit(0.25), F.lit(0.75)), 1000).alias(f"q_{v}"),
            F.min(F.when(F.col(v) != p, F.abs(F.col(v) - p))).alias(f"res_{v}"),
            F.count_if(F.col(v) != p).alias(f"runs_{v}"),
            F.count_if((F.col(v) == p) & (p != q)).alias(f"again_{v}"),
        ]
    stats = d.groupBy("k", hour.alias("hour")).agg(*aggs)
    out = ["n", "dt"]
    for v in vs:
        # 1.349 standard deviations to an interquartile range, sqrt(3 / 2) for the second difference; at least half the resolution
        spread = (F.col(f"q_{v}")[1] - F.col(f"q_{v}")[0]) / (1.349 * 1.5**0.5)
        stats = stats.withColumn(f"sd_{v}", F.greatest(spread, F.coalesce(F.col(f"res_{v}"), F.lit(0.0)) / 2))
        chance = F.greatest(F.col(f"again_{v}") / F.greatest(F.col(f"runs_{v}"), F.lit(1)), F.lit(1e-3))
        stats = stats.withColumn(f"long_{v}", F.when(chance < MOST_CHANCE, 1 + F.log(F.greatest("n", F.lit(2))) / -F.log(chance)).otherwise(float("inf")))
        out += [f"sd_{v}", f"long_{v}"]
    return stats.select("k", F.explode("chunks").alias("c"), *out)


class _Series:
    """The known readings of one axis in order, with neighbours inside their chunk."""

    def __init__(self, v: np.ndarray, t: np.ndarray, g: np.ndarray, dt: np.ndarray):
        self.v, self.t, self.g, self.dt = v, t, g, dt

    def shift(self, a: np.ndarray, by: int) -> np.ndarray:
        """The value by places before (after, if negative), NaN beyond the chunk."""
        out = np.full(len(a), np.nan)
        if abs(by) < len(a):
            if by > 0:
                out[by:] = np.where(self.g[by:] == self.g[:-by], a[:-by], np.nan)
            else:
                out[:by] = np.where(self.g[:by] == self.g[-by:], a[-by:], np.nan)
        return out

    def near(self, a: int, b: int) -> np.ndarray:
        """Whether the readings at places a and b around each exist with no time gap between them; unknown times count as near."""
        va, vb = (self.v if x == 0 else self.shift(self.v, -x) for x in (a, b))
        ta, tb = (self.t if x == 0 else self.shift(self.t, -x) for x in (a, b))
        with np.errstate(invalid="ignore"):
            return ~np.isnan(va) & ~np.isnan(vb) & ~(tb - ta > (b - a + 3) * self.dt)

    def change(self, a: int) -> np.ndarray:
        """The change from place a to the next, 0 across a gap."""
        va, vb = (self.v if x == 0 else self.shift(self.v, -x) for x in (a, a + 1))
        return np.where(self.near(a, a + 1), np.abs(vb - va), 0.0)


def _spikes(s: _Series, sd: np.ndarray, rules: Rules) -> np.ndarray:
    n = len(s.v)
    at = {j: s.shift(s.v, -j) for j in range(-3, 6) if j}
    at[0] = s.v
    change = {j: s.change(j) for j in (-3, -2, 0, 1, 2, 3, 4)}
    before = np.maximum(change[-2], change[-3])
    code = np.zeros(n, np.int8)
    with np.errstate(invalid="ignore"):
        for size in (1, 2, 3):  # of several that hold, the longest
            sign = np.sign(s.v - at[-1])
            away = np.minimum.reduce([sign * (at[b] - at[e]) for b in range(size) for e in (-1, size)])
            move = np.maximum.reduce([before, change[size], change[size + 1]])
            code[s.near(-1, size) & (away > np.maximum(rules.fence * sd, rules.movement * move))] = size
        # beside a gap or the end of the source one neighbour has to do, against twice the allowance
        left = s.near(-1, 0) & s.near(-2, -1) & (at[-1] != at[-2]) & ~s.near(0, 1) & (np.abs(s.v - at[-1]) > 2 * np.maximum(rules.fence * sd, rules.movement * before))
        right = s.near(0, 1) & s.near(1, 2) & (at[1] != at[2]) & ~s.near(-1, 0) & (np.abs(s.v - at[1]) > 2 * np.maximum(rules.fence * sd, rules.movement * np.maximum(change[1], change[2])))
    code[(code == 0) & (left | right)] = 1
    c = code.astype(float)
    with np.errstate(invalid="ignore"):
        return (code >= 1) | (s.shift(c, 1) >= 2) | (s.shift(c, 2) >= 3)


def _run_lengths(v: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each place the length of the run of equal values it lies in."""
    if not len(v):
        return np.zeros(0, np.int64)
    run = np.cumsum(np.r_[True, (v[1:] != v[:-1]) | (g[1:] != g[:-1])]) - 1
    return np.bincount(run)[run]


def _judge(n_axes: int, clock: bool, rules: Rules):
    def judge(d: pd.DataFrame) -> pd.DataFrame:
        k, c, i = d["k"].to_numpy(), d["c"].to_numpy(), d["i"].to_numpy()
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        once = new | np.r_[True, i[1:] != i[:-1]]
        g = np.cumsum(new)[once]
        d = d[once]
        t, dt, n = d["t"].to_numpy(float), d["dt"].to_numpy(float), len(d)
        spike, stuck, bad_clock = (np.zeros(n, bool) for _ in range(3))
        for a in range(n_axes):
            v = d[f"v{a}"].to_numpy(float)
            at = np.flatnonzero(~np.isnan(v))
            if not len(at):
                continue
            spike[at] |= _spikes(_Series(v[at], t[at], g[at], dt[at]), d[f"sd_v{a}"].to_numpy(float)[at], rules)
            need = np.maximum(rules.least_run, np.ceil(rules.run_factor * d[f"long_v{a}"].to_numpy(float)[at]))
            stuck[at] |= _run_lengths(v[at], g[at]) >= need
        if clock:
            at = np.flatnonzero(~np.isnan(t))
            bad_clock[at] = (_run_lengths(t[at], g[at]) >= rules.same_t) | np.r_[False, (t[at][1:] < t[at][:-1]) & (g[at][1:] == g[at][:-1])][: len(at)]
        impossible = d["impossible"].to_numpy(bool)
        core = d["c"].to_numpy() == d["i"].to_numpy() // CHUNK
        out = pd.DataFrame({"k": d["k"].to_numpy(), "i": d["i"].to_numpy(), "impossible": impossible, "spike": spike, "stuck": stuck, "clock": bad_clock})
        return out[core & (impossible | spike | stuck | bad_clock)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            k, c = b["k"].to_numpy(), b["c"].to_numpy()
            last = np.flatnonzero((k != k[-1]) | (c != c[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = b.iloc[cut:]  # the rest of its chunk may follow
            if cut:
                yield judge(b.iloc[:cut])
        if held is not None:
            yield judge(held)

    return run


def implausible(rows: DataFrame, axes: Sequence[str], limit: float, clock: bool, key: str = "session_id", rules: Rules = Rules()) -> DataFrame:
    """(key, i, reasons) of the rows of rows(key, i, t, axes) that cannot be real.

    reasons is an array of 'impossible' (non-finite or beyond limit), 'spike' (one to three readings in succession
    that leave both neighbours by more than the source's noise and movement allow, no time gap between them),
    'stuck' (an axis unchanged far longer than the source's own chance of repeats explains) and, where clock is
    set, 'clock' (t below that of the row before in i, or shared by rules.same_t rows in succession).
    Exact copies of a row count once; nulls are no cases and are skipped as neighbours; rows without key or i are
    left out; sources of a few rows have no spikes or stuck values. Empty input gives an empty result.
    The judgement needs each axis' neighbours without its nulls, so it runs over sorted Arrow batches of chunks.
    """
    d = _chunked(rows, key, axes, limit)
    stats = normal_behaviour(d, len(axes))
    d = d.join(stats, ["k", "c"], "left").sortWithinPartitions("k", "c", "i")
    kind = dict(d.dtypes)["k"]
    found = d.mapInPandas(_judge(len(axes), clock, rules), f"k {kind}, i long, impossible boolean, spike boolean, stuck boolean, clock boolean")
    why = F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("impossible", "spike", "stuck", "clock"))))
    return found.select(F.col("k").alias(key), "i", why.alias("reasons"))
