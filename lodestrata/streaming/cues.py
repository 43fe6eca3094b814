"""Streaming: idempotent deliveries and a causal cue with state per session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.operators.estimators import FILTERS
from lodestrata.session import Workspace

STATE = "started boolean, t double, w double, peak double, top boolean, cued double, n long"
#: Seconds after a cue in which there is no other.
REFRACTORY = 2.0
OUT = "session_id string, cue_t double, rush double, confidence double"


def step(state: tuple, t: float, w: float) -> tuple[tuple, tuple | None]:
    """One sample of the angular rate w: the state after it and the cue it gives, none within two seconds of the last.

    A session starts at 1.2 rad/s; the top is reached when a rate above 2.5 has fallen below .55; after it an angular
    acceleration above 95 rad/s2 is a rush of its share of 171, and one of at least .72 is a cue; the top has to be reached anew for another.
    """
    started, last_t, last_w, peak, top, cued, n = state
    if not started and w < 1.2:
        return (False, t, w, 0.0, False, cued, 0), None
    dt = max(t - last_t, 1e-3) if started else 1e-3
    n, peak = n + 1, max(peak, w)
    if peak > 2.5 and w < 0.55:
        top = True
    cue = None
    if started and top and t - cued >= REFRACTORY:
        acc = (w - last_w) / dt
        rush = min(1.0, acc / 171) if acc > 95 else 0.0
        if rush >= 0.72:
            cued, top = t, False
            cue = (t, rush, min(0.86, 0.15 + 0.48 * min(1, n / 120) + 0.23 * min(1, peak / 8)))
            peak = 0.0
    return (True, t, w, peak, top, cued, n), cue


EMPTY = (False, -1e300, 0.0, 0.0, False, -1e300, 0)


def cues_of(t: np.ndarray, w: np.ndarray, state: tuple = EMPTY) -> tuple[tuple, list[tuple]]:
    found = []
    for a, b in zip(t, w):
        state, cue = step(state, float(a), float(b))
        if cue:
            found.append(cue)
    return state, found


def transition_cues(samples: DataFrame, silence_ms: int | None = None) -> DataFrame:
    """(session_id, cue_t, rush, confidence) of streamed samples(session_id, t, w).

    Samples are taken in order of t within a batch; those of a later batch that are not after the last one taken come too late and are left
    out. The state of a session is of fixed size; on a stream without end silence_ms says after how long without samples it ends. A stream that is
    drained needs none, and would not come to an end with one.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values("t")
        before = tuple(state.get) if state.exists else EMPTY
        pdf = pdf[pdf["t"] > before[1]] if state.exists else pdf
        now, found = cues_of(pdf["t"].to_numpy(), pdf["w"].to_numpy(), before)
        state.update(now)
        if silence_ms:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame([(key[0], *c) for c in found], columns=["session_id", "cue_t", "rush", "confidence"])

    return samples.groupBy("session_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout)


def streamed_orientations(samples: DataFrame, flt: str = "complementary", silence_ms: int | None = None) -> DataFrame:
    """(session_id, t, qw, qx, qy, qz) of streamed samples(session_id, t, gx, gy, gz, ax, ay, az): a filter whose state is carried from batch to batch.

    Order and late samples as in transition_cues(); the same steps as over a whole table.
    """
    names = ["gx", "gy", "gz", "ax", "ay", "az"]

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values("t").drop_duplicates("t")
        f, last = FILTERS[flt](), None
        if state.exists:
            last, q, bias, before = state.get
            f.q, f.bias, f.before = np.array(q), np.array(bias), np.array(before)
            pdf = pdf[pdf["t"] > last]
        rows = []
        for t, *v in pdf[["t", *names]].to_numpy(float):
            gyro, accel = np.array(v[:3]), np.array(v[3:])
            if last is None:
                f.reset(accel)
            else:
                f.update(gyro, accel, t - last)
            last = t
            rows.append((key[0], t, *f.q))
        if last is not None:
            state.update((float(last), f.q.tolist(), f.bias.tolist(), f.before.tolist()))
            if silence_ms:
                state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(rows, columns=["session_id", "t", "qw", "qx", "qy", "qz"])

    return samples.groupBy("session_id").applyInPandasWithState(run, "session_id string, t double, qw double, qx double, qy double, qz double", "t double, q array<double>, bias array<double>, before array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout)


def batch_cues(samples: DataFrame) -> DataFrame:
    """The same over a whole table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        _, found = cues_of(pdf["t"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame([(pdf["session_id"].iloc[0], *c) for c in found], columns=["session_id", "cue_t", "rush", "confidence"])

    return samples.groupBy("session_id").applyInPandas(run, OUT)


def idempotent(deliveries: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once, as long as its repeats come within the delay."""
    return deliveries.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """All that is available now of a stream, written and read again."""
    q = stream.writeStream.format("parquet").option("path", f"{ws.base}/{name}").option("checkpointLocation", f"{ws.base}/{name}-progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return ws.spark.read.schema(stream.schema).parquet(f"{ws.base}/{name}")
