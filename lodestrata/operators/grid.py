"""Irregular readings onto a regular time grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def spelling(c: Column | str) -> Column:
    """A label without case, spaces, hyphens and underscores."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s_-]+", ""))


def latest_mode(headers: DataFrame, key: str = "session_id", mode: str = "capture_mode", at: str = "received_at") -> DataFrame:
    """(key, mode) of the last delivery of each header that names a mode; the spelling is normalised."""
    h = headers.where(F.col(key).isNotNull() & F.col(mode).isNotNull())
    return h.groupBy(key).agg(F.max_by(spelling(mode), F.struct(F.col(at), spelling(mode))).alias("mode"))


def occupied_slots(readings: DataFrame, keys: Sequence[str], modes: DataFrame, widths: Mapping[str, float], default: float, t: str = "t", values: Sequence[str] = (), mode_key: str = "session_id") -> DataFrame:
    """(keys, slot, width, n[, value means]) of the slots floor(t / width) that hold a reading.

    widths has the grid width by normalised mode, default that of all other, null and missing modes. A reading
    with null or non-finite t counts nowhere; a null or non-finite value counts as a reading, but not for the mean.
    Readings are added up by slot before the modes are joined, so a source of very many readings is small by then.
    """
    all_widths = sorted({*widths.values(), default})
    finite = F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    slot = [F.floor(F.col(t) / F.lit(w)).alias(f"__slot{k}") for k, w in enumerate(all_widths)]
    d = readings.where(finite).select(*keys, *slot, *values).groupBy(*keys, *(f"__slot{k}" for k in range(len(all_widths))))
    known = {v: F.when(F.abs(F.nanvl(F.col(v).cast("double"), F.lit(float("inf")))) < float("inf"), F.col(v).cast("double")) for v in values}
    d = d.agg(F.count("*").alias("n"), *(a for v, x in known.items() for a in (F.sum(x).alias(f"__s_{v}"), F.count(x).alias(f"__n_{v}"))))
    width = F.lit(default)
    for m, w in widths.items():
        width = F.when(F.col("mode") == m, F.lit(w)).otherwise(width)
    d = d.join(modes.select(mode_key, "mode"), mode_key, "left").withColumn("width", width)
    pick = F.coalesce(*(F.when(F.col("width") == w, F.col(f"__slot{k}")) for k, w in enumerate(all_widths)))
    d = d.withColumn("slot", pick.cast("long")).groupBy(*keys, "slot", "width")
    return d.agg(F.sum("n").alias("n"), *((F.sum(f"__s_{v}") / F.nullif(F.sum(f"__n_{v}"), F.lit(0))).alias(v) for v in values))


def with_next(slots: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Adds next_slot and next_<carry> of the following occupied slot, null for the last of a source.

    The window runs over chunks of a source's slots; the first slot of each chunk is handed to the one before,
    so no task holds a whole source.
    """
    d = slots.withColumn("__chunk", F.floor(F.col("slot") / CHUNK))
    inner = Window.partitionBy(*keys, "__chunk").orderBy("slot")
    row = F.struct("slot", *carry)
    d = d.withColumn("__in", F.lead(row).over(inner))
    first = d.groupBy(*keys, "__chunk").agg(F.min(row).alias("__first"))
    first = first.withColumn("__out", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__chunk"))).drop("__first")
    d = d.join(first, [*keys, "__chunk"], "left").withColumn("__next", F.coalesce("__in", "__out"))
    return d.select(*slots.columns, F.col("__next.slot").alias("next_slot"), *(F.col(f"__next.{c}").alias(f"next_{c}") for c in carry))


def slots_between(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Two generators in turn (block, slot) for lo..hi inclusive: no array is longer than a block of 8192."""
    return F.explode(F.sequence(lo, hi, F.lit(8192).cast("long"))), F.explode(F.sequence(F.col("__block"), F.least(F.col("__block") + 8191, F.col("__hi"))))


def missing_slots(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, slot) of every empty slot between the first and the last occupied one of a source."""
    d = with_next(slots.select(*keys, "slot"), keys).where("next_slot > slot + 1")
    blocks, each = slots_between(F.col("slot") + 1, F.col("next_slot") - 1)
    d = d.select(*keys, (F.col("next_slot") - 1).alias("__hi"), blocks.alias("__block"))
    return d.select(*keys, each.alias("slot"))


def regular_grid(slots: DataFrame, keys: Sequence[str], values: Sequence[str], max_fill: int = 4, bounds: DataFrame | None = None) -> DataFrame:
    """A row for every slot from the first to the last: (keys, slot, width, n, state, values).

    slots is what occupied_slots() gives. state is 'observed' for a slot with readings, 'interpolated' for one in
    a gap of at most max_fill slots (values linear between the gap's ends, null where an end has none), 'missing'
    in a longer gap (values null) and 'outside' for slots added up to bounds. bounds: (keys, lo, hi) slots to
    extend to; it never cuts. One source row gives one row; no source, none.
    """
    d = with_next(slots, keys, carry=values)
    gap = F.col("next_slot") - F.col("slot")
    seen = slots.select(*keys, "slot", "width", "n", F.lit("observed").alias("state"), *values)
    blocks, each = slots_between(F.col("slot") + 1, F.col("next_slot") - 1)
    g = d.where(gap > 1).withColumn("__hi", F.col("next_slot") - 1).withColumn("__block", blocks).withColumn("__at", each)
    short = gap - 1 <= max_fill
    part = (F.col("__at") - F.col("slot")) / gap
    fill = g.select(*keys, F.col("__at").alias("slot"), "width", F.lit(0).cast("long").alias("n"), F.when(short, "interpolated").otherwise("missing").alias("state"), *(F.when(short, F.col(v) + part * (F.col(f"next_{v}") - F.col(v))).alias(v) for v in values))
    out = seen.unionByName(fill)
    if bounds is not None:
        ends = slots.groupBy(*keys).agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.first("width").alias("width")).join(bounds, list(keys))
        sides = [ends.where(F.col("lo") < F.col("first")).select(*keys, "width", F.col("lo").alias("__lo"), (F.col("first") - 1).alias("__hi")), ends.where(F.col("hi") > F.col("last")).select(*keys, "width", (F.col("last") + 1).alias("__lo"), F.col("hi").alias("__hi"))]
        blocks, each = slots_between(F.col("__lo"), F.col("__hi"))
        out_of = sides[0].unionByName(sides[1]).withColumn("__block", blocks).withColumn("slot", each)
        out = out.unionByName(out_of.select(*keys, "slot", "width", F.lit(0).cast("long").alias("n"), F.lit("outside").alias("state"), *(F.lit(None).cast("double").alias(v) for v in values)))
    return out
