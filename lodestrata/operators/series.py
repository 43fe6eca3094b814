"""Ordered analytics of time series, each over frames of one key ordered by t (and a tie breaker)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def clean(c: Column) -> Column:
    """Null where not finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def neighbour(d: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], name: str, ahead: bool = False, width: float = 3600.0) -> DataFrame:
    """Adds name, a struct of order and carry of the row before, or of the one after; null at the ends.

    Windows run over chunks of a key, width of order[0] wide, and the row at a chunk's edge is handed to the next one, so a key that
    has a great part of all rows is many tasks; only one row a chunk goes through a window of the whole key. Rows whose
    order[0] is null or not finite are chunks of their own.
    """
    c = F.floor(F.when(F.abs(F.nanvl(F.col(order[0]).cast("double"), F.lit(float("inf")))) < float("inf"), F.col(order[0]).cast("double")) / width)
    row, step = F.struct(*order, *carry), F.lead if ahead else F.lag
    d = d.withColumn("__c", c)
    inner = step(row).over(Window.partitionBy(*keys, "__c").orderBy(*order))
    edge = d.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__c").alias("__kc")).agg((F.min(row) if ahead else F.max(row)).alias("__edge"))
    edge = edge.withColumn("__out", step("__edge").over(Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy("__kc"))).drop("__edge")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__c").eqNullSafe(F.col("__kc"))]
    names = [x for x in d.columns if x != "__c"]
    return d.withColumn("__in", inner).join(edge, on, "left").select(*names, F.coalesce("__in", "__out").alias(name))


def running(d: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, width: float = 3600.0) -> DataFrame:
    """Adds name, the sum of value up to each row of its key, the row included: sums within chunks of order[0] plus the sums of the chunks before, so
    a key that has a great part of all rows is many tasks. Rows of equal order are summed one by one; a null order[0] comes first."""
    c = F.floor(F.when(F.abs(F.nanvl(F.col(order[0]).cast("double"), F.lit(float("inf")))) < float("inf"), F.col(order[0]).cast("double")) / width)
    d = d.withColumn("__c", c)
    within = F.sum(value).over(Window.partitionBy(*keys, "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    part = d.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__c").alias("__kc")).agg(F.sum(value).alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy("__kc").rowsBetween(Window.unboundedPreceding, -1))
    part = part.withColumn("__before", before).drop("__s")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__c").eqNullSafe(F.col("__kc"))]
    names = [x for x in d.columns if x != "__c"]
    return d.withColumn("__in", within).join(part, on, "left").select(*names, (F.coalesce("__in", F.lit(0)) + F.coalesce("__before", F.lit(0))).alias(name))


def rate_jitter(d: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """(keys, n, fs, jitter_cv, gap_fraction): rate from the median step, population spread over median of the positive
    steps (0 below three rows), share of steps beyond two and a half medians."""
    d = neighbour(d.where(F.col(t).isNotNull()).select(*keys, t), keys, [t], [], "__p").withColumn("__dt", F.col(t) - F.col("__p")[t])
    med = d.groupBy(*keys).agg(F.count("*").alias("n"), F.median("__dt").alias("med"), F.median(F.when(F.col("__dt") > 0, F.col("__dt"))).alias("mpos"), F.stddev_pop(F.when(F.col("__dt") > 0, F.col("__dt"))).alias("sd"))
    gaps = d.join(med.select(*keys, "med"), list(keys)).groupBy(*keys).agg(F.avg(F.when(F.col("__dt") > 2.5 * F.col("med"), 1.0).when(F.col("__dt").isNotNull(), 0.0)).alias("gap_fraction"))
    return med.join(gaps, list(keys)).select(*keys, "n", F.try_divide(F.lit(1.0), "med").alias("fs"), F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce(F.try_divide("sd", "mpos"), F.lit(0.0))).alias("jitter_cv"), F.coalesce("gap_fraction", F.lit(0.0)).alias("gap_fraction"))


def dedupe(d: DataFrame, keys: Sequence[str], order: Sequence[str], t: str = "t", least: float = 1e-9) -> DataFrame:
    """Rows whose time is more than least after that of the row before; the first row of a key stays. order begins with a number."""
    extra = [] if t in order else [t]
    d = neighbour(d, keys, order, extra, "__p")
    step = F.col(t) - F.col("__p")[t]
    return d.where(step.isNull() | (step > least)).drop("__p")


def resample(d: DataFrame, keys: Sequence[str], value: str, step: float, t: str = "t") -> DataFrame:
    """(keys, k, t, value) on the grid t0 + k * step up to the last time, linear between neighbours."""
    first = d.groupBy(*(F.col(k).alias(f"__f{i}") for i, k in enumerate(keys))).agg(F.min(t).alias("__t0"))
    d = neighbour(d.select(*keys, F.col(t).alias("__t"), F.col(value).alias("__v")), keys, ["__t"], ["__v"], "__n", ahead=True)
    d = d.join(first, [F.col(k).eqNullSafe(F.col(f"__f{i}")) for i, k in enumerate(keys)]).select(*keys, "__t", "__v", F.col("__n.__t").alias("__t2"), F.col("__n.__v").alias("__v2"), "__t0")
    lo = F.ceil((F.col("__t") - F.col("__t0")) / step)
    hi = F.when(F.col("__t2").isNull(), F.floor((F.col("__t") - F.col("__t0")) / step)).otherwise(F.ceil((F.col("__t2") - F.col("__t0")) / step) - 1)
    d = d.withColumn("__lo", lo).withColumn("__hi", hi).where("__hi >= __lo").withColumn("k", F.explode(F.sequence("__lo", "__hi")))
    at = F.col("__t0") + F.col("k") * step
    part = (at - F.col("__t")) / (F.col("__t2") - F.col("__t"))
    return d.select(*keys, "k", at.alias("t"), F.when(F.col("__t2").isNull(), F.col("__v")).otherwise(F.col("__v") + part * (F.col("__v2") - F.col("__v"))).alias("value"))


def align(probe: DataFrame, other: DataFrame, keys: Sequence[str], value: str, t: str = "t", tie: str = "id") -> DataFrame:
    """Adds to each row of probe the value of other interpolated at its time, the nearest one beyond the ends; null without other."""
    o = other.select(*keys, F.col(t).alias("__t"), F.lit(None).cast("bigint").alias(tie), F.lit(0).alias("__side"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__o"))
    p = probe.select(*keys, F.col(t).alias("__t"), F.col(tie).cast("bigint").alias(tie), F.lit(1).alias("__side"), F.lit(None).cast(o.schema["__o"].dataType).alias("__o"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side")
    u = o.unionByName(p).select("*", F.last("__o", True).over(w).alias("a"))
    back = Window.partitionBy(*keys).orderBy(F.desc("__t"), "__side")
    u = u.select("*", F.last("__o", True).over(back).alias("b")).where("__side = 1")
    lerp = F.when(F.col("b.t") == F.col("a.t"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("__t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")) * (F.col("b.v") - F.col("a.v")))
    return u.select(*keys, tie, F.col("__t").alias("t"), F.coalesce(lerp, F.col("a.v"), F.col("b.v")).alias("value"), F.col("a.t").alias("t_before"), F.col("b.t").alias("t_after"))


def moving_mean(value: str, w, size: int) -> Column:
    """Zero-padded mean of size rows: the sum of those there are over size."""
    return F.sum(value).over(w.rowsBetween(-(size // 2), (size - 1) // 2)) / size


def moving_mean_edge(value: str, keys: Sequence[str], order: Sequence[str], size: int) -> Column:
    """Edge-padded mean: places beyond the ends repeat the end values."""
    w, whole = by(keys, order), Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = size // 2, (size - 1) // 2
    rn, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    before, after = F.greatest(F.lit(lo) - (rn - 1), F.lit(0)), F.greatest(F.lit(hi) - (n - rn), F.lit(0))
    return (F.sum(value).over(w.rowsBetween(-lo, hi)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / size


def moving_var(value: str, w, size: int) -> Column:
    """Mean of squares less squared mean over the rows there are, at least 0."""
    f = w.rowsBetween(-(size // 2), (size - 1) // 2)
    m = F.avg(value).over(f)
    return F.greatest(F.avg(F.col(value) * F.col(value)).over(f) - m * m, F.lit(0.0))


def trapezoid(value: str, t: str, w) -> Column:
    """Running integral, 0 at the first row. To be summed over w."""
    return F.coalesce(0.5 * (F.col(value) + F.lag(value).over(w)) * (F.col(t) - F.lag(t).over(w)), F.lit(0.0))


def gradient(value: str, w) -> Column:
    """Central difference in rows, one-sided at the ends; null for a single row."""
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.coalesce((after - before) / 2, after - F.col(value), F.col(value) - before)


def unwrap(d: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, period: float) -> DataFrame:
    """Adds unwrapped: multiples of period added so that successive values differ by at most half of it."""
    names = d.columns
    d = neighbour(d, keys, order, [value], "__p")
    jump = F.col(value) - F.col("__p")[value]
    d = running(d.withColumn("__turn", F.coalesce(-F.round(jump / period), F.lit(0.0))), keys, order, "__turn", "__turns")
    return d.select(*names, (F.col(value) + period * F.col("__turns")).alias("unwrapped"))


def runs(d: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column) -> DataFrame:
    """(keys, run, state, first, last, n): gaps and islands of equal states, first and last in the values of order[0]."""
    d = neighbour(d.withColumn("__s", state), keys, order, ["__s"], "__p")
    d = d.withColumn("__new", F.when(F.col("__p").isNotNull() & F.col("__p.__s").eqNullSafe(F.col("__s")), 0).otherwise(1))
    d = running(d, keys, order, "__new", "run")
    return d.groupBy(*keys, "run").agg(F.first("__s").alias("state"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def rest_mask(d: DataFrame, keys: Sequence[str], order: Sequence[str], calm: Column, least: int) -> DataFrame:
    """Adds rest: calm rows in runs of at least least, an opening of the mask."""
    w = by(keys, order)
    d = d.withColumn("__c", F.coalesce(calm, F.lit(False))).withColumn("__new", F.when(F.lag("__c").over(w).eqNullSafe(F.col("__c")), 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(w))
    return d.withColumn("rest", F.col("__c") & (F.count("*").over(Window.partitionBy(*keys, "__run")) >= least)).drop("__c", "__new", "__run")


def signed_log(c: Column, scale: float) -> Column:
    return F.signum(c) * F.log1p(F.abs(c) / scale) * scale


def sessions(d: DataFrame, keys: Sequence[str], order: Sequence[str], gap: float, t: str = "t") -> DataFrame:
    """Adds session: a number that grows where a row is more than gap after the one before."""
    names = d.columns
    d = neighbour(d, keys, order, [] if t in order else [t], "__p")
    d = d.withColumn("__new", F.when(F.col(t) - F.col("__p")[t] > gap, 1).otherwise(0))
    return running(d, keys, order, "__new", "session").select(*names, "session")


def phase_normalize(d: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, points: int) -> DataFrame:
    """(keys, k, value): the series of a key resampled to points places, linear in the row number; one row repeats."""
    w = by(keys, order)
    d = d.select(*keys, (F.row_number().over(w) - 1).alias("__i"), F.col(value).alias("__v"), F.lead(value).over(w).alias("__v2"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    step = (F.col("__n") - 1) / F.lit(points - 1)
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("__x", F.col("k") * step)
    at = F.least(F.floor("__x"), F.greatest(F.col("__n") - 2, F.lit(0)))
    return d.where(F.col("__i") == at).select(*keys, "k", F.coalesce(F.col("__v") + (F.col("__x") - F.col("__i")) * (F.col("__v2") - F.col("__v")), F.col("__v")).alias("value"))


def last_before(d: DataFrame, keys: Sequence[str], t: str, hit: Column, name: str) -> DataFrame:
    """Adds the time of the last row up to each one at which hit holds."""
    return d.withColumn(name, F.max(F.when(hit, F.col(t))).over(by(keys, [t])))
