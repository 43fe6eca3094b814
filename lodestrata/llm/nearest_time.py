"""Matching records by nearest time: nearest-neighbour intervals and a partitioned interval index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_intervals(right: DataFrame, key: str, t: str, row: str, tolerance: float, chunk: float = 1.024) -> DataFrame:
    """(key, rt, row, lo, hi): each distinct time of right with the interval in which it is the nearest one.

    lo and hi are the midpoints to the neighbours, or null where the neighbour is further than two tolerances
    and so never the nearest within the tolerance. The least row of equal times is kept. The window runs over
    chunks of time with a margin of two tolerances, so a source of very many rows is many tasks.
    """
    finite = F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    d = right.where(F.col(key).isNotNull() & F.col(row).isNotNull() & finite).select(F.col(key).alias("k"), F.col(t).cast("double").alias("rt"), F.col(row).alias("r"))
    at, margin = F.floor(F.col("rt") / chunk), 2.0 * tolerance * 1.001
    near = F.array_distinct(F.array(at, F.floor((F.col("rt") - margin) / chunk), F.floor((F.col("rt") + margin) / chunk)))
    d = d.select("k", "rt", "r", F.explode(near).alias("c")).groupBy("k", "c", "rt").agg(F.min("r").alias("r"))
    w = Window.partitionBy("k", "c").orderBy("rt")
    d = d.select("k", "c", "rt", "r", F.lag("rt").over(w).alias("p"), F.lead("rt").over(w).alias("n")).where(F.col("c") == at)
    return d.select("k", "rt", "r", ((F.col("p") + F.col("rt")) / 2).alias("lo"), ((F.col("rt") + F.col("n")) / 2).alias("hi"))


def match_nearest(left: DataFrame, right: DataFrame, tolerance: float, key: str = "session_id", t: str = "t", left_row: str = "i", right_row: str = "i", names: tuple[str, str] = ("left_row", "right_row")) -> DataFrame:
    """(key, names[0], names[1]) of each row of left with the row of right of the same key nearest in time, at most tolerance away.

    Of equal times on the right the least row is taken, of two equally distant times the earlier. Null or
    non-finite times and null keys match nothing; exact copies on either side count once; an empty side gives
    an empty result. Intervals are put into buckets two tolerances wide (one to two buckets each), so a left
    row meets the few intervals of its bucket, whatever the number of rows of its key.
    """
    width = 2.0 * tolerance
    iv = nearest_intervals(right, key, t, right_row, tolerance)
    lo = F.greatest(F.coalesce("lo", F.lit(float("-inf"))), F.col("rt") - tolerance)
    hi = F.least(F.coalesce("hi", F.lit(float("inf"))), F.col("rt") + tolerance)
    a, b = F.floor(lo / width), F.floor(hi / width)
    index = iv.select("k", "rt", "r", "lo", "hi", F.explode(F.when(a == b, F.array(a)).otherwise(F.sequence(a, b))).alias("b"))
    finite = F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    rows = left.where(F.col(key).isNotNull() & finite).select(F.col(key).alias("k"), F.col(left_row).alias("l"), F.col(t).cast("double").alias("lt"))
    rows = rows.withColumn("b", F.floor(F.col("lt") / width)).repartition("k", "b").distinct()
    hit = rows.join(index, ["k", "b"])
    hit = hit.where((F.abs(F.col("lt") - F.col("rt")) <= tolerance) & (F.col("lo").isNull() | (F.col("lt") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("lt") <= F.col("hi"))))
    return hit.select(F.col("k").alias(key), F.col("l").alias(names[0]), F.col("r").alias(names[1]))
