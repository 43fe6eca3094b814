"""Checks of a manifest of recordings, as violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOWED = {"capture_mode": ("high_rate", "compat"), "handedness": ("right", "left"), "wrist": ("lead", "trail")}
REQUIRED = ("record_id", "subject_pseudonym", "device.model", "capture.path", "capture.sha256", "reference.impact_timestamp_source")


def violations(records: DataFrame, measured: DataFrame | None = None, floor_hz: float = 2.0) -> DataFrame:
    """(record_id, rule): missing fields, unknown codes, repeated ids, malformed hashes and dates; with measured(record_id,
    sha256, accelerometer_hz, device_motion_hz) also hashes that differ and rates further off than max(floor, a tenth)."""
    c = F.col
    rules = [F.when(c(f).isNull() | (c(f) == ""), F.lit(f"missing {f}")) for f in REQUIRED]
    rules += [F.when(c(f).isNotNull() & ~c(f).isin(*v), F.lit(f"unknown {f}")) for f, v in ALLOWED.items()]
    rules.append(F.when(~c("capture.sha256").rlike("^[0-9a-f]{64}$"), F.lit("malformed hash")))
    rules.append(F.when(~c("session.captured_at_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("malformed date")))
    d = records
    if measured is not None:
        m = measured.select(c("record_id"), c("sha256").alias("__sha"), c("accelerometer_hz").alias("__a"), c("device_motion_hz").alias("__m"))
        d = records.join(m, "record_id", "left")
        rules.append(F.when(c("__sha") != c("capture.sha256"), F.lit("tampered hash")))
        for f, got in (("accelerometer_hz", "__a"), ("device_motion_hz", "__m")):
            rules.append(F.when(F.abs(c(f"rates.{f}") - c(got)) > F.greatest(F.lit(floor_hz), c(got) / 10), F.lit(f"wrong {f}")))
    found = d.select("record_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    twice = records.groupBy("record_id").count().where("record_id is not null and count > 1").select("record_id", F.lit("repeated record_id").alias("rule"))
    return found.unionByName(twice).distinct()


def verify_seals(sealed: DataFrame, recomputed: DataFrame, key: str = "label") -> DataFrame:
    """(key, status): 'ok', 'changed', 'missing' where a sealed case is not there, 'unsealed' where one was added."""
    a, b = sealed.select(key, F.col("seal").alias("__a")), recomputed.select(key, F.col("seal").alias("__b"))
    d = a.join(b, key, "full")
    return d.select(key, F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unsealed").when(F.col("__a") != F.col("__b"), "changed").otherwise("ok").alias("status"))
