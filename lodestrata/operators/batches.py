"""Sorted rows in Arrow batches, handed to a function by whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def group_starts(pdf: pd.DataFrame, group: Sequence[str]) -> np.ndarray:
    """Where the groups of sorted rows begin; nulls are equal."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for c in group:
        x = pdf[c]
        null = x.isna().to_numpy()
        x = x.to_numpy()
        with np.errstate(invalid="ignore"):
            new[1:] |= ((x[1:] != x[:-1]) & ~(null[1:] & null[:-1])) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def whole_groups(group: Sequence[str], f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], rows: int = 0):
    """For mapInPandas: f over sorted rows in portions of at least that many, cut so that no group is split; it gets the rows and where groups begin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            if not len(b):
                continue
            edge = pd.concat([held[-1].tail(1), b], ignore_index=True) if held else b
            last = int(group_starts(edge, group)[-1]) - (1 if held else 0)
            n += len(b)
            if last < (0 if held else 1) or n < rows:
                held.append(b)
                continue
            done = pd.concat([*held, b.iloc[:last]], ignore_index=True)
            held = [b.iloc[last:]]
            n = len(held[0])
            yield f(done, group_starts(done, group))
        if held:
            done = pd.concat(held, ignore_index=True)
            yield f(done, group_starts(done, group))

    return run


def by_groups(d: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with each group in one partition, sorted by group and order."""
    return d.repartition(*group).sortWithinPartitions(*group, *order)
