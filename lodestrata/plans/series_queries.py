"""Time-series queries over events, with t in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import series as S
from lodestrata.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"
W = "(PARTITION BY user_id ORDER BY t, event_id)"
KEY, ORDER = ["user_id"], ["t", "event_id"]


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"WITH {E}{',' if not sql.lstrip().startswith('SELECT') else ''} {sql}"
        return f

    return put


@query("""s AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM e),
m AS (SELECT user_id, count(*) AS n, median(dt) AS med, median(dt) FILTER (dt > 0) AS mpos, stddev_pop(dt) FILTER (dt > 0) AS sd FROM s GROUP BY 1),
g AS (SELECT user_id, avg(CASE WHEN dt > 2.5 * med THEN 1.0::DOUBLE WHEN dt IS NOT NULL THEN 0.0::DOUBLE END) AS gf FROM s JOIN m USING (user_id) GROUP BY 1)
SELECT user_id, n, round(1.0 / nullif(med, 0), 9) AS fs, round(CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE coalesce(sd / nullif(mpos, 0), 0.0::DOUBLE) END, 6) AS jitter_cv, round(coalesce(gf, 0.0::DOUBLE), 6) AS gap_fraction FROM m JOIN g USING (user_id)""")
def ts_rate_jitter(spark, d):
    return S.rate_jitter(events(spark, d), KEY).select("user_id", "n", F.round("fs", 9).alias("fs"), F.round("jitter_cv", 6).alias("jitter_cv"), F.round("gap_fraction", 6).alias("gap_fraction"))


@query(f"SELECT event_id FROM (SELECT *, t - lag(t) OVER {W} AS s FROM e) WHERE s IS NULL OR s > 60")
def ts_dedupe(spark, d):
    return S.dedupe(events(spark, d), KEY, ORDER, least=60.0).select("event_id")


@query("""p AS (SELECT user_id, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2, min(t) OVER (PARTITION BY user_id) AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
q AS (SELECT *, CAST(ceil((t - t0) / 3600.0::DOUBLE) AS BIGINT) AS lo, CAST(CASE WHEN t2 IS NULL THEN floor((t - t0) / 3600.0::DOUBLE) ELSE ceil((t2 - t0) / 3600.0::DOUBLE) - 1 END AS BIGINT) AS hi FROM p),
r AS (SELECT *, unnest(generate_series(lo, hi)) AS k FROM q WHERE hi >= lo)
SELECT user_id, k, round(CASE WHEN t2 IS NULL THEN value ELSE value + (t0 + k * 3600.0::DOUBLE - t) / (t2 - t) * (v2 - value) END, 5) AS value FROM r""")
def ts_resample_linear(spark, d):
    return S.resample(events(spark, d), KEY, "value", 3600.0).select("user_id", "k", F.round("value", 5).alias("value"))


_TWO = """a AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'click'), o AS (SELECT user_id, t, value FROM e WHERE event_type = 'error'),
lo AS (SELECT a.*, o.t AS t1, o.value AS v1 FROM a ASOF LEFT JOIN o ON a.user_id = o.user_id AND a.t >= o.t),
hi AS (SELECT a.event_id, o.t AS t2, o.value AS v2 FROM a ASOF LEFT JOIN o ON a.user_id = o.user_id AND a.t <= o.t)"""


@query(_TWO + " SELECT event_id, round(coalesce(CASE WHEN t1 = t2 THEN v1 ELSE v1 + (t - t1) / (t2 - t1) * (v2 - v1) END, v1, v2), 5) AS value FROM lo JOIN hi USING (event_id)")
def ts_align_two_rates(spark, d):
    e = events(spark, d)
    return S.align(e.where("event_type = 'click'"), e.where("event_type = 'error'"), KEY, "value", tie="event_id").select("event_id", F.round("value", 5).alias("value"))


@query(_TWO + " SELECT event_id, round(CASE WHEN t2 IS NULL OR t - t1 <= t2 - t THEN t1 ELSE t2 END, 6) AS nearest FROM lo JOIN hi USING (event_id) WHERE coalesce(t1, t2) IS NOT NULL AND (t1 IS NOT NULL OR t2 IS NOT NULL)")
def ts_nearest_event(spark, d):
    e = events(spark, d)
    a = S.align(e.where("event_type = 'click'"), e.where("event_type = 'error'"), KEY, "value", tie="event_id")
    near = F.when(F.col("t_after").isNull() | (F.col("t") - F.col("t_before") <= F.col("t_after") - F.col("t")), F.col("t_before")).otherwise(F.col("t_after"))
    return a.where("t_before is not null or t_after is not null").select("event_id", F.round(near, 6).alias("nearest"))


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS m FROM e")
def ts_moving_mean_zero_pad(spark, d):
    return events(spark, d).select("event_id", F.round(S.moving_mean("value", S.by(KEY, ORDER), 5), 6).alias("m"))


@query("""n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
sum(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round((s + greatest(3 - (rn - 1), 0) * f + greatest(2 - (n - rn), 0) * l) / 6, 6) AS m FROM n""")
def ts_moving_mean_edge_pad(spark, d):
    return events(spark, d).select("event_id", F.round(S.moving_mean_edge("value", KEY, ORDER, 6), 6).alias("m"))


@query("SELECT event_id, round(greatest(avg(value * value) OVER w - (avg(value) OVER w) * (avg(value) OVER w), 0.0::DOUBLE), 7) AS v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def ts_moving_var(spark, d):
    return events(spark, d).select("event_id", F.round(S.moving_var("value", S.by(KEY, ORDER), 5), 7).alias("v"))


@query(f"s AS (SELECT user_id, coalesce(0.5 * (value + lag(value) OVER {W}) * (t - lag(t) OVER {W}), 0.0::DOUBLE) AS a FROM e) SELECT user_id, round(sum(a), 2) AS area FROM s GROUP BY 1")
def ts_trapezoid(spark, d):
    return events(spark, d).select("user_id", S.trapezoid("value", "t", S.by(KEY, ORDER)).alias("a")).groupBy("user_id").agg(F.round(F.sum("a"), 2).alias("area"))


@query(f"SELECT event_id, round(coalesce((lead(value) OVER {W} - lag(value) OVER {W}) / 2, lead(value) OVER {W} - value, value - lag(value) OVER {W}), 6) AS g FROM e")
def ts_gradient(spark, d):
    return events(spark, d).select("event_id", F.round(S.gradient("value", S.by(KEY, ORDER)), 6).alias("g"))


@query(f"a AS (SELECT *, value % 7 AS x FROM e), s AS (SELECT *, coalesce(-round((x - lag(x) OVER {W}) / 7.0::DOUBLE), 0.0::DOUBLE) AS turn FROM a) SELECT event_id, round(x + 7 * sum(turn) OVER {W}, 5) AS unwrapped FROM s")
def ts_unwrap(spark, d):
    e = events(spark, d).withColumn("x", F.col("value") % 7)
    return S.unwrap(e, KEY, ORDER, "x", 7.0).select("event_id", F.round("unwrapped", 5).alias("unwrapped"))


@query("SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS day, max(value) AS peak, arg_max(event_id, (value, -t)) AS at FROM e GROUP BY 1, 2")
def ts_peak_in_window(spark, d):
    e = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day"))
    return e.agg(F.max("value").alias("peak"), F.max_by("event_id", F.struct("value", -F.col("t"))).alias("at"))


@query(f"SELECT event_id FROM (SELECT *, lag(value) OVER {W} AS p, lead(value) OVER {W} AS n FROM e) WHERE value > 50 AND value >= p AND value >= n")
def ts_local_maxima(spark, d):
    w = S.by(KEY, ORDER)
    return events(spark, d).select("event_id", "value", F.lag("value").over(w).alias("p"), F.lead("value").over(w).alias("n")).where("value > 50 and value >= p and value >= n").select("event_id")


@query(f"c AS (SELECT *, value - 50 AS x FROM e), z AS (SELECT user_id, t, x * lag(x) OVER {W} < 0 AS hit FROM c) SELECT user_id, round(max(t) FILTER (hit), 6) AS last_crossing FROM z GROUP BY 1")
def ts_zero_crossing(spark, d):
    e = events(spark, d).withColumn("x", F.col("value") - 50)
    e = e.select("user_id", "t", (F.col("x") * F.lag("x").over(S.by(KEY, ORDER)) < 0).alias("hit"))
    return e.groupBy("user_id").agg(F.round(F.max(F.when(F.col("hit"), F.col("t"))), 6).alias("last_crossing"))


@query("p AS (SELECT user_id, arg_max(t, (value, -t)) AS tp, max(value) AS peak FROM e GROUP BY 1), a AS (SELECT user_id, max(e.t) AS below_hi FROM e JOIN p USING (user_id) WHERE e.t <= tp AND value <= 0.5::DOUBLE * peak GROUP BY 1), b AS (SELECT user_id, max(e.t) AS start FROM e JOIN p USING (user_id) JOIN a USING (user_id) WHERE e.t <= below_hi AND value <= 0.1::DOUBLE * peak GROUP BY 1) SELECT user_id, round(tp, 6) AS at, round(start, 6) AS start FROM p LEFT JOIN b USING (user_id)")
def ts_hysteresis_span(spark, d):
    """Back from the peak to the last value below half of it, and from there to the last below a tenth."""
    e = events(spark, d)
    p = e.groupBy("user_id").agg(F.max_by("t", F.struct("value", -F.col("t"))).alias("tp"), F.max("value").alias("peak"))
    e = e.join(p, "user_id")
    a = e.where("t <= tp and value <= 0.5D * peak").groupBy("user_id").agg(F.max("t").alias("below_hi"))
    b = e.join(a, "user_id").where("t <= below_hi and value <= 0.1D * peak").groupBy("user_id").agg(F.max("t").alias("start"))
    return p.join(b, "user_id", "left").select("user_id", F.round("tp", 6).alias("at"), F.round("start", 6).alias("start"))


_RUN = f"q AS (SELECT *, value < 50 AS s FROM e), r AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER {W} THEN 0 ELSE 1 END AS new FROM q), g AS (SELECT *, sum(new) OVER {W} AS run FROM r)"


@query(_RUN + ", i AS (SELECT user_id, run, min(t) AS first, max(t) AS last, count(*) AS n FROM g WHERE s GROUP BY 1, 2) SELECT user_id, round(first, 6) AS first, round(last, 6) AS last, n FROM i WHERE n >= 3")
def ts_quiet_runs(spark, d):
    r = S.runs(events(spark, d), KEY, ORDER, F.col("value") < 50).where("state and n >= 3")
    return r.select("user_id", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "n")


@query(_RUN + " SELECT event_id, s AND count(*) OVER (PARTITION BY user_id, run) >= 3 AS rest FROM g")
def ts_rest_mask(spark, d):
    return S.rest_mask(events(spark, d), KEY, ORDER, F.col("value") < 50, 3).select("event_id", "rest")


@query("SELECT event_id, round(sign(value - 50) * ln(1 + abs(value - 50) / 10.0::DOUBLE) * 10, 6) AS x FROM e")
def ts_signed_log(spark, d):
    return events(spark, d).select("event_id", F.round(S.signed_log(F.col("value") - 50, 10.0), 6).alias("x"))


@query("""n AS (SELECT user_id, row_number() OVER w - 1 AS i, value AS v, lead(value) OVER w AS v2, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
k AS (SELECT *, CAST(range AS INTEGER) AS k, range * ((n - 1) / 15.0::DOUBLE) AS x FROM n, range(16))
SELECT user_id, k, round(coalesce(v + (x - i) * (v2 - v), v), 5) AS value FROM k WHERE i = least(floor(x), greatest(n - 2, 0))""")
def ts_phase_normalize(spark, d):
    return S.phase_normalize(events(spark, d), KEY, ORDER, "value", 16).select("user_id", "k", F.round("value", 5).alias("value"))


@query(f"s AS (SELECT *, CASE WHEN t - lag(t) OVER {W} > 7200 THEN 1 ELSE 0 END AS new FROM e), g AS (SELECT *, CAST(sum(new) OVER {W} AS BIGINT) AS session FROM s) SELECT user_id, session, count(*) AS n, round(max(t) - min(t), 4) AS duration, max(value) AS peak, arg_max(event_id, (value, -t)) AS peak_event, round(avg(value), 9) AS mean FROM g GROUP BY 1, 2")
def ts_session_features(spark, d):
    e = S.sessions(events(spark, d), KEY, ORDER, 7200.0).groupBy("user_id", "session")
    return e.agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 4).alias("duration"), F.max("value").alias("peak"), F.max_by("event_id", F.struct("value", -F.col("t"))).alias("peak_event"), F.round(F.avg("value"), 9).alias("mean"))


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER {W} AS rn FROM e) WHERE rn % 2 = 1")
def ts_decimate(spark, d):
    """Every other sample of a source, the first one kept."""
    return events(spark, d).select("event_id", F.row_number().over(S.by(KEY, ORDER)).alias("rn")).where("rn % 2 = 1").select("event_id")


@query("SELECT user_id, make_timestamp(CAST(floor(t / 86400) * 86400 * 1000000 AS BIGINT)) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2, 3")
def ts_tumbling_windows(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


