"""Reports, consistency and moments of measurements; windows of samples; scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.robust import finite


def in_windows(samples: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, bucket: float) -> DataFrame:
    """The samples that lie in windows(keys, lo, hi, ...) of their keys, both ends included, with the windows' columns.

    Times are cut into buckets of a width, in which a window stands as often as it reaches; a hot key is many buckets.
    Null bounds hold nothing.
    """
    w = windows.where(F.col(lo) <= F.col(hi)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    s = samples.withColumn("__b", F.floor(F.col(at) / bucket))
    return s.join(w, [*keys, "__b"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__b")


def zip_by_position(a: DataFrame, b: DataFrame, keys: Sequence[str], order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Rows of a and b of the same keys and the same place in their orders, with that place from 1; what has no partner is left out."""
    place = lambda d, o: d.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*o)))
    return place(a, order_a).join(place(b, order_b), [*keys, "place"])


def skewness(c: str) -> Column:
    """Third central moment over the cubed population deviation; the denominator is at least 1e-9."""
    m = F.avg(c)
    third = F.avg(F.pow(F.col(c), 3)) - 3 * m * F.avg(F.pow(F.col(c), 2)) + 2 * m * m * m
    return third / (F.pow(F.stddev_pop(c), 3) + 1e-9)


def correlation(a: str, b: str) -> Column:
    """Population covariance over the product of deviations; the denominator is at least 1e-9."""
    return F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b) + 1e-9)


def part_energies(d: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, parts: int = 4) -> DataFrame:
    """(keys, part, energy): sums of squares over equal parts of each key's rows, in order; nulls count 0."""
    n, rn = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    part = F.floor(rn * parts / n).cast("int")
    return d.select(*keys, part.alias("part"), F.coalesce(F.col(value) ** 2, F.lit(0.0)).alias("__e")).groupBy(*keys, "part").agg(F.sum("__e").alias("energy"))


def needs_fixed_rate(d: DataFrame, keys: Sequence[str], t: str = "t", repeats: float = 0.01, spread: float = 0.08) -> DataFrame:
    """(keys, repeat_share, cv, needed): whether more than a share of the steps stand still or the positive ones spread by more than a share of their mean."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    x = d.where(F.col(t).isNotNull()).select(*keys, step.alias("__s"))
    pos = F.when(F.col("__s") > 0, F.col("__s"))
    g = x.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("__s") <= 1e-9, 1.0).when(F.col("__s").isNotNull(), 0.0)), F.lit(0.0)).alias("repeat_share"), F.coalesce(F.try_divide(F.stddev_pop(pos), F.avg(pos)), F.lit(0.0)).alias("cv"))
    return g.withColumn("needed", (F.col("repeat_share") > repeats) | (F.col("cv") > spread))


def fixed_rate(median_step: Column, declared: Column, lo: float = 40.0, hi: float = 800.0, near: float = 0.15) -> Column:
    """The rate to resample to: that of the median step within bounds, or the declared one where it is near."""
    fs = F.least(F.greatest(F.try_divide(F.lit(1.0), median_step), F.lit(lo)), F.lit(hi))
    return F.when(F.abs(declared - fs) / F.greatest(fs, F.lit(1.0)) < near, declared).otherwise(fs)


def session_consistency(d: DataFrame, keys: Sequence[str], value: str, lo: str, hi: str, least: int = 2) -> DataFrame:
    """(keys, n, consistency): the share of finite values within their window, of groups with enough of them."""
    v = finite(value)
    inside = F.when(v.isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull(), ((v >= F.col(lo)) & (v <= F.col(hi))).cast("int"))
    return d.groupBy(*keys).agg(F.count(inside).alias("n"), F.avg(inside).alias("consistency")).where(F.col("n") >= least)


def focus(d: DataFrame, keys: Sequence[str], z: str, priority: str, name: str, boost: Column) -> DataFrame:
    """(keys, name): of each key the metric farthest from its centre, boosts added; of several the first by priority and name."""
    return d.where(finite(z).isNotNull()).groupBy(*keys).agg(F.min_by(name, F.struct(-(F.abs(z) + boost), F.col(priority), F.col(name))).alias(name))


def group_deltas(d: DataFrame, cohort: str, group: str, flag: str, value: str) -> DataFrame:
    """(cohort, delta, n_groups): within each group the mean where flag holds less that where it does not, then the median over a cohort's groups that have both."""
    v = finite(value)
    g = d.groupBy(cohort, group).agg(F.avg(F.when(F.col(flag), v)).alias("a"), F.avg(F.when(~F.col(flag), v)).alias("b")).where("a is not null and b is not null")
    return g.groupBy(cohort).agg(F.median(F.col("a") - F.col("b")).alias("delta"), F.count("*").alias("n_groups"))


def dispersion(value: str) -> Column:
    """Interquartile range over the absolute median; null for a median of 0."""
    v = finite(value)
    return F.try_divide(F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25)), F.abs(F.median(v)))


def top_reasons(d: DataFrame, reasons: str, order: Sequence, last: int = 50, k: int = 3) -> DataFrame:
    """(reason, n): the k most frequent reasons of the last entries in an order; ties by reason. Both numbers are the feature."""
    return d.orderBy(*order).limit(last).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def stratification(d: DataFrame, dimensions: Sequence[str], subject: str) -> DataFrame:
    """(dimension, stratum, n, n_subjects): counts over each dimension by itself, from one reading of the rows."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("stratum")) for c in dimensions)))
    return d.select(F.col(subject).alias("__s"), each.alias("e")).groupBy("e.dimension", "e.stratum").agg(F.count("*").alias("n"), F.countDistinct("__s").alias("n_subjects"))


def fuse_confidence(parts: Column, weights: Column | None = None, lo: float = 0.05, hi: float = 0.95, default: float = 0.2) -> Column:
    """The mean of an array of confidences, weighted where weights are given, within bounds; the default for none. Nulls do not count."""
    pairs = F.filter(F.arrays_zip(parts.alias("c"), (weights if weights is not None else F.transform(parts, lambda _: F.lit(1.0))).alias("w")), lambda x: x["c"].isNotNull() & x["w"].isNotNull())
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, x: s + f(x))
    mean = F.try_divide(total(lambda x: x["c"] * x["w"]), total(lambda x: x["w"]))
    return F.when(mean.isNull(), default).otherwise(F.least(F.greatest(mean, F.lit(lo)), F.lit(hi)))


def reasons_in_order(*reasons: Column) -> Column:
    """Several arrays of reasons as one: each reason once, where it comes first; nulls and empty ones left out."""
    return F.array_distinct(F.filter(F.flatten(F.array(*(F.coalesce(r, F.array().cast("array<string>")) for r in reasons))), lambda x: x.isNotNull() & (x != "")))


def parent_classes(signature: Column) -> Column:
    """The classes a signature extends: those in parentheses after a class's name, or after extends, without arguments by keyword."""
    inner = F.coalesce(F.nullif(F.regexp_extract(signature, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1), F.lit("")), F.regexp_extract(signature, r"\bextends\s+([\w.<>, ]+?)(?:\s+implements\b|\s*\{|$)", 1))
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("="))


def nesting(text: Column) -> Column:
    """The deepest indent of a text in steps of four spaces."""
    deep = F.transform(F.split(text, "\r?\n"), lambda x: F.when(F.trim(x) != "", F.length(F.regexp_extract(x, "^( *)", 1))).otherwise(0))
    return F.floor(F.array_max(deep) / 4).cast("int")


def truncate_at_paragraph(text: Column, tokens: int) -> Column:
    """A text cut to so many tokens of four characters, at the end of a paragraph where one ends in the last fifth of that."""
    most = tokens * 4
    head = F.substring(text, 1, most)
    last = F.length(head) - F.locate("\n\n", F.reverse(head)) - 1
    return F.when(F.length(text) <= most, text).when((F.locate("\n\n", F.reverse(head)) > 0) & (last > 0.8 * most), F.substring(head, F.lit(1), last.cast("int"))).otherwise(head)


def json_text(*columns: str) -> Column:
    """The columns as one JSON text; non-finite numbers are null, as JSON has none."""
    return F.to_json(F.struct(*columns))


def epoch_ms(at: Column) -> Column:
    """Milliseconds since 1970 of a time, rounded down."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / 1000)


def duration_ms(begin: Column, end: Column) -> Column:
    return epoch_ms(end) - epoch_ms(begin)


def context_sections(items: DataFrame, keys: Sequence[str], section: str, order: Sequence[str], tokens: str, budget: int, shares: dict[str, float]) -> DataFrame:
    """The items of each key that fit a budget of tokens, of which each section has a share: in order, as long as the sum before an item is below it."""
    share = F.coalesce(*(F.when(F.col(section) == s, F.lit(float(budget) * x)) for s, x in shares.items()), F.lit(0.0))
    before = F.coalesce(F.sum(tokens).over(Window.partitionBy(*keys, section).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("before", before).where(F.col("before") < share)


def blended(bases: Column, other: Column, weight: Column, most: float = 0.30) -> Column:
    """A value moved towards another by a weight that is bounded."""
    return bases + F.least(F.greatest(weight, F.lit(0.0)), F.lit(most)) * (other - bases)
