"""Percentiles with bounded error from mergeable rank-interval summaries.

A summary of a group is a set of tuples (v, up, down) of distinct values: the running sum of up from the
least value is a number of values certainly <= v, the running sum of down from the greatest a number
certainly >= v. In this form merging is a union, exact in itself; an error comes from compressing only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.batches import by_groups, whole_groups
from lodestrata.session import partitions_of

#: Partitions whose summaries are merged at a time.
FAN_IN = 64
BATCH_ROWS = 200_000


def _keep(v: np.ndarray, count: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, up, down) of distinct sorted values with their numbers, thinned to blocks of step * n ranks; every up and down moves to a kept neighbour."""
    low = np.cumsum(count)
    n = low[-1]
    block = np.r_[-1, np.floor((low[1:] - 1) / max(1.0, step * n))]
    last = np.flatnonzero(np.r_[block[1:] != block[:-1], True] | (count >= max(1.0, step * n)))
    low, high = low[last], n - low[last] + count[last]  # numbers <= and >= each kept value
    return v[last], np.diff(np.r_[0, low]), -np.diff(np.r_[high, 0])


def _partition_summaries(scopes: Sequence[tuple[str, tuple[str, ...]]], value: str, step: float):
    names = sorted({c for _, cols in scopes for c in cols})

    def of(pdf: pd.DataFrame, part: int) -> Iterator[pd.DataFrame]:
        for scope, cols in scopes:
            g = pdf.groupby([*cols, value], sort=True, dropna=False).size().reset_index(name="up")
            code = g.groupby(list(cols), sort=False, dropna=False).ngroup().to_numpy()
            up, v = g["up"].to_numpy(), g[value].to_numpy()
            total = np.bincount(code, weights=up)
            # groups of fewer than 1 / step values keep all of them, the others are thinned one by one
            wide = np.flatnonzero(total * step > 1)
            keep, down = ~np.isin(code, wide), up.copy()
            rows = np.arange(len(g))
            for k in wide:
                at = rows[code == k]
                kept, a, b = _keep(v[at], up[at], step)
                at = at[np.searchsorted(v[at], kept)]
                keep[at], up[at], down[at] = True, a, b
            out = g.loc[keep, list(cols)]
            yield pd.DataFrame({"scope": scope, **{c: out[c] if c in cols else None for c in names}, "part": part, "v": v[keep], "up": up[keep], "down": down[keep]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        part = None

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal part
            pdf = pd.concat(held, ignore_index=True)
            part = int(pd.util.hash_pandas_object(pdf.head(50), index=False).sum() % np.uint64(2**40)) if part is None else part + 1
            out = list(of(pdf, part))
            if out:
                yield pd.concat(out, ignore_index=True)

        for b in batches:
            if len(b):
                held.append(b)
                rows += len(b)
            if rows >= BATCH_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return run, names


def levels_of(partitions: int) -> list[int]:
    """Numbers of buckets in which the summaries of that many partitions are merged in turn; the last is one."""
    out = []
    while partitions > FAN_IN:
        partitions = -(-partitions // FAN_IN)
        out.append(partitions)
    return [*out, 1]


def _merged(group: Sequence[str], step: float):
    def f(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v, up, down = pdf["v"].to_numpy(float), pdf["up"].to_numpy(np.int64), pdf["down"].to_numpy(np.int64)
        first = np.zeros(len(v), bool)
        first[starts] = True
        at = np.flatnonzero(first | np.r_[True, v[1:] != v[:-1]])
        up, down, v, first = np.add.reduceat(up, at), np.add.reduceat(down, at), v[at], first[at]
        total, starts = np.cumsum(up), np.flatnonzero(first)
        code = np.cumsum(first) - 1
        before = (total - up)[starts]
        n = np.diff(np.r_[before, total[-1]])[code]
        width = np.maximum(1.0, n * step)
        block = np.where(first, -1, np.floor((total - before[code] - 1) / width))
        keep = np.flatnonzero(np.r_[block[1:] != block[:-1], True] | np.r_[first[1:], True] | first | (up >= width))
        out = pdf.iloc[at[keep]][list(group)].reset_index(drop=True)
        # what is dropped adds its up to the kept one above it and its down to the one below
        return out.assign(v=v[keep], up=np.diff(np.r_[0, total[keep]]), down=np.add.reduceat(down, keep))

    return whole_groups(group, f)


def compress(d: DataFrame, group: Sequence[str], step: float) -> DataFrame:
    """Merges the tuples (group, v, up, down) of a group and keeps the first, the last of each block of step * n ranks and
    those that hold a block's ranks by themselves, so at most twice 1 / step.

    A dropped tuple's up goes to the kept one above it, its down to the kept one below, so both running sums stay
    lower bounds, and a rank between kept values is uncertain by at most a block more. One shuffle and one sort.
    """
    d = d.select(*group, "v", "up", "down")
    return by_groups(d, group, ["v"]).mapInPandas(_merged(group, step), d.schema)


def summarize(values: DataFrame, scopes: Sequence[tuple[str, tuple[str, ...]]], value: str, eps: float = 0.005) -> DataFrame:
    """Summaries (scope, <group columns>, v, up, down, eps) of value for several groupings at once, ranks known within eps * n.

    scopes: (name, group columns); the columns a scope does not use are null in its rows. Each partition is
    summarised for itself, then the summaries are merged and compressed, FAN_IN partitions to a bucket and as many times
    as that takes, so no task sees a group's rows, nor more than a share of its summaries. Null and non-finite values do not count; a group
    without others, like an empty table, has no rows. Repeated values are one tuple. A null group column is a group.
    """
    names = sorted({c for _, cols in scopes for c in cols})
    x = F.col(value).cast("double")
    d = values.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*names, (x + 0.0).alias(value))
    levels = levels_of(partitions_of(d))
    step = eps / (len(levels) + 1)
    run, _ = _partition_summaries(scopes, value, step)
    types = dict(d.dtypes)
    d = d.mapInPandas(run, f"scope string, {', '.join(f'{c} {types[c]}' for c in names)}, part long, v double, up long, down long")
    group = ["scope", *names]
    for k, n in enumerate(levels[:-1]):
        d = d.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(n)) if k == 0 else F.pmod("part", F.lit(n)))
        d = compress(d, [*group, "part"], step)
    return compress(d, group, step).withColumn("eps", F.lit(eps))


def combine(summaries: DataFrame, group: Sequence[str], eps: float = 0.005) -> DataFrame:
    """One summary per group of several, say of days; its eps is the worst of theirs plus the one of this step."""
    worst = summaries.groupBy(*group).agg(F.max("eps").alias("worst"))
    d = compress(summaries.select(*group, "v", "up", "down"), list(group), eps)
    keys = [d[g].eqNullSafe(worst[g]) for g in group]
    return d.join(worst, keys).select(*(d[g] for g in group), "v", "up", "down", (F.col("worst") + eps).alias("eps"))


def quantiles(summaries: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group, p, n, value, eps): for each p the value whose rank is certainly nearest to p * (n - 1) + 1, the least of several."""

    def f(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v, up, down = pdf["v"].to_numpy(float), pdf["up"].to_numpy(np.int64), pdf["down"].to_numpy(np.int64)
        size = np.diff(np.r_[starts, len(v)])
        code = np.repeat(np.arange(len(starts)), size)
        total, back = np.cumsum(up), np.cumsum(down[::-1])[::-1]
        ends = starts + size - 1
        low = total - (total - up)[starts][code]
        n = low[ends]
        first = n[code] - (back - (back - down)[ends][code]) + 1
        head, out = pdf.iloc[starts], []
        for p in probs:
            target = (p * (n - 1) + 1)[code]
            off = np.maximum(np.maximum(target - low, first - target), 0.0)
            hit = np.flatnonzero(off == np.minimum.reduceat(off, starts)[code])
            best = hit[np.searchsorted(hit, starts)]
            out.append(head[list(group)].assign(p=float(p), n=n, value=v[best], eps=head["eps"]))
        return pd.concat(out, ignore_index=True)

    types = dict(summaries.dtypes)
    d = by_groups(summaries.select(*group, "v", "up", "down", "eps"), group, ["v"])
    return d.mapInPandas(whole_groups(group, f), ", ".join(f"{c} {types[c]}" for c in group) + ", p double, n long, value double, eps double")
