"""Robust and weighted statistics, bootstraps, strata and gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def summary(d: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, sd, median, p95, max) of the finite values; sd is 0 for one value, all null for none."""
    v = finite(value)
    return d.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias("sd"), F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.max(v).alias("max"))


def weighted_median(d: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "center") -> DataFrame:
    """(keys, name): the least value at which the running weight reaches half; weights of 0 or less are left out."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = d.where(finite(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    d = d.select(*keys, value, F.sum("__w").over(w).alias("__run"), F.sum("__w").over(Window.partitionBy(*keys)).alias("__all"))
    return d.where(F.col("__run") >= F.col("__all") / 2).groupBy(*keys).agg(F.min(value).alias(name))


def weighted_mad(d: DataFrame, keys: Sequence[str], value: str, weight: str, center: DataFrame, name: str = "mad") -> DataFrame:
    """(keys, name): weighted median of the distances from center(keys, center)."""
    off = d.join(center, list(keys)).withColumn("__off", F.abs(F.col(value) - F.col("center")))
    return weighted_median(off, keys, "__off", weight, name)


def robust_prior(d: DataFrame, keys: Sequence[str], value: str, weight: str, floor: float, least: int = 5, reject: float = 4.0) -> DataFrame:
    """(keys, n, center, scale, n_out, lo, hi, validity): weighted median and 1.4826 * MAD, refitted without outliers.

    Fewer than least rows, before or after the rejection, abstain with null center and scale.
    """
    d = d.where(finite(value).isNotNull() & (F.col(weight) > 0))

    def fit(x: DataFrame) -> DataFrame:
        c = weighted_median(x, keys, value, weight)
        m = weighted_mad(x, keys, value, weight, c)
        return c.join(m, list(keys)).select(*keys, "center", F.greatest(1.4826 * F.col("mad"), F.lit(floor)).alias("scale"))

    one = fit(d)
    kept = d.join(one, list(keys)).where(F.abs(F.col(value) - F.col("center")) <= reject * F.col("scale")).drop("center", "scale")
    n = d.groupBy(*keys).agg(F.count("*").alias("n"))
    m = kept.groupBy(*keys).agg(F.count("*").alias("m"))
    out = n.join(m, list(keys), "left").join(fit(kept), list(keys), "left")
    ok = (F.col("n") >= least) & (F.coalesce("m", F.lit(0)) >= least)
    c, s = F.when(ok, F.col("center")), F.when(ok, F.col("scale"))
    n_out = F.col("n") - F.coalesce("m", F.lit(0))
    return out.select(*keys, "n", c.alias("center"), s.alias("scale"), n_out.alias("n_out"), (c - 1.5 * s).alias("lo"), (c + 1.5 * s).alias("hi"), F.when(~ok, "abstain").when(n_out > 0, "degraded").otherwise("ok").alias("validity"))


# Multipliers of a 32-bit integer mixer; below 2**31, so that SQL's 64-bit integers hold the products.
MIX = (569420461, 1935289751)
SEED_STEP = 1640531527


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixer of 32-bit numbers held as 64-bit ones; different numbers stay different."""
    for shift, by in zip((16, 15), MIX):
        x = ((x ^ (x >> shift)) * by) & 0xFFFFFFFF
    return x ^ (x >> 15)


def bootstrap_mean_ci(d: DataFrame, keys: Sequence[str], value: str, order: str, resamples: int = 2000, seed: int = 12345, block: int = 1 << 17, part: int = 50) -> DataFrame:
    """(keys, n, mean, lo, hi): percentile bootstrap of the mean, rows drawn with replacement; the bounds are the mean for one value.

    Draw i of resample b is row mixed(mixed(i) ^ mixed(b * SEED_STEP + seed)) mod n, rows counted by order, then value. A
    task has one block of a group's values and part of the resamples; it repeats the draws and sums those in its block.
    """
    w = Window.partitionBy(*keys).orderBy(order, "__v")
    d = d.where(finite(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("__v"))
    d = d.select(*keys, "__v", (F.row_number().over(w) - 1).cast("long").alias("__i"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    blocks = d.groupBy(*keys, "__n", F.floor(F.col("__i") / block).alias("__k")).agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__a"))
    tasks = blocks.select(*keys, "__n", "__k", F.col("__a.__v").alias("__a"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(part))).alias("__b"))
    kinds = dict(d.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                v, n, low = np.asarray(r["__a"], dtype=np.float64), int(r["__n"]), int(r["__k"]) * block
                b = np.arange(r["__b"], min(r["__b"] + part, resamples), dtype=np.int64)
                per = mixed((b * SEED_STEP + seed) & 0xFFFFFFFF)
                total = np.zeros(len(b))
                for at in range(0, n, block):
                    i = mixed(np.arange(at, min(at + block, n), dtype=np.int64) & 0xFFFFFFFF)
                    for k in range(len(b)):
                        x = mixed(i ^ per[k]) % n - low
                        total[k] += v[x if n <= block else x[(x >= 0) & (x < len(v))]].sum()
                yield pd.DataFrame({**{c: [r[c]] * len(b) for c in keys}, "__b": b, "__t": total})

    spark = d.sparkSession
    spread = tasks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys, "__k", "__b")
    sums = spread.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "__b long", "__t double"]))
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"))
    means = sums.groupBy(*keys, "__b").agg(F.sum("__t").alias("__t")).join(base, list(keys)).select(*keys, (F.col("__t") / F.col("n")).alias("__m"))
    ci = means.groupBy(*keys).agg(F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return base.join(ci, list(keys)).select(*keys, "n", "mean", F.when(F.col("n") == 1, F.col("mean")).otherwise(F.col("q")[0]).alias("lo"), F.when(F.col("n") == 1, F.col("mean")).otherwise(F.col("q")[1]).alias("hi"))


def strata(d: DataFrame, labels: Sequence[Column]) -> DataFrame:
    """Each row once for each of its labels that is not null: overlapping strata."""
    return d.withColumn("stratum", F.explode(F.array_compact(F.array(*labels))))


def streak(d: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column) -> DataFrame:
    """(keys, streak): how many of the last rows in succession are bad."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = d.select(*keys, F.row_number().over(w).alias("__r"), bad.alias("__b"))
    return d.groupBy(*keys).agg((F.max("__r") - F.coalesce(F.max(F.when(~F.coalesce(F.col("__b"), F.lit(False)), F.col("__r"))), F.lit(0))).alias("streak"))


def decay(d: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys, decay): median of the second half less that of the first; the middle row of an odd number is in the second."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = d.select(*keys, F.col(value).alias("__v"), F.row_number().over(w).alias("__r"), F.floor(F.count("*").over(Window.partitionBy(*keys)) / 2).alias("__h"))
    return d.groupBy(*keys).agg((F.median(F.when(F.col("__r") > F.col("__h"), F.col("__v"))) - F.median(F.when(F.col("__r") <= F.col("__h"), F.col("__v")))).alias("decay"))


def ema(d: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, start: float = 0.5, keep: float = 0.9) -> DataFrame:
    """(keys, score): s <- keep * s + (1 - keep) * value over the rows in order, in closed form."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = d.select(*keys, F.col(value).alias("__v"), F.row_number().over(w).alias("__r"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    return d.groupBy(*keys).agg((start * F.pow(F.lit(keep), F.max("__n")) + F.sum((1 - keep) * F.pow(F.lit(keep), F.col("__n") - F.col("__r")) * F.col("__v"))).alias("score"))


def gate(values: DataFrame, budgets: DataFrame, keys: Sequence[str], value: str, most: str) -> DataFrame:
    """Adds status: 'pass', 'fail' beyond the budget, 'missing' where a budget has no value."""
    j = budgets.join(values, list(keys), "left")
    return j.withColumn("status", F.when(F.col(value).isNull(), "missing").when(F.col(value) > F.col(most), "fail").otherwise("pass"))


def worst(*c: Column) -> Column:
    """The worst of validities: abstain, then degraded, then ok; null counts as abstain."""
    some = F.array(*(F.coalesce(x, F.lit("abstain")) for x in c))
    return F.when(F.array_contains(some, "abstain"), "abstain").when(F.array_contains(some, "degraded"), "degraded").otherwise("ok")


def band_score(value: Column, lo: Column, hi: Column) -> Column:
    """1 inside a band, falling linearly to 0 over two widths outside."""
    width = F.greatest(hi - lo, F.lit(1e-9))
    out = F.greatest(lo - value, value - hi, F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - out / (2 * width))
