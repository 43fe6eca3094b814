"""Statistics, gates, quality and report queries over metrics, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import robust as R
from lodestrata.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
M = "m AS (SELECT DISTINCT swing_id, subject_pseudonym AS subject, name, value, units, kind, confidence, validity, residual, captured_at, array_to_string(reasons, '|') AS why FROM metrics), f AS (SELECT * FROM m WHERE isfinite(value))"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics")
    return m.select("swing_id", F.col("subject_pseudonym").alias("subject"), "name", "value", "units", "kind", "confidence", "validity", "residual", "captured_at", F.array_join("reasons", "|").alias("why")).distinct()


def query(sql: str, views: str = M):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = (f"WITH {views}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}") if views else sql
        return f

    return put


def rounded(d: DataFrame, keys: list[str], digits: int, *names: str) -> DataFrame:
    return d.select(*keys, *(F.round(n, digits).alias(n) for n in names))


@query("SELECT name, count(f.value) AS n, round(avg(value), 9) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 9) AS sd, round(median(value), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95, round(max(value), 9) AS max FROM f GROUP BY name")
def stats_summary(spark, d):
    return rounded(R.summary(metrics(spark, d), ["name"], "value"), ["name", "n"], 9, "mean", "sd", "median", "p95", "max")


@query("SELECT subject, name, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.75), 9) AS p75 FROM f GROUP BY 1, 2")
def stats_percentile_bands(spark, d):
    q = metrics(spark, d).where(R.finite("value").isNotNull()).groupBy("subject", "name").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("subject", "name", *(F.round(F.col("q")[k], 9).alias(n) for k, n in enumerate(("p25", "p50", "p75"))))


@query("c AS (SELECT subject, name, avg(value) AS mean FROM f GROUP BY 1, 2) SELECT name, count(*) AS cases, round(avg(mean), 9) AS mean_of_means FROM c GROUP BY 1")
def stats_case_means(spark, d):
    c = metrics(spark, d).groupBy("subject", "name").agg(F.avg(R.finite("value")).alias("mean")).where("mean is not null")
    return c.groupBy("name").agg(F.count("*").alias("cases"), F.round(F.avg("mean"), 9).alias("mean_of_means"))


_WM = "g AS (SELECT l_returnflag AS k, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2), r AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v) AS run, sum(w) OVER (PARTITION BY k) AS tot FROM g), c AS (SELECT k, min(v) AS center FROM r WHERE run >= tot / 2 GROUP BY k)"


@query(f"SELECT k AS l_returnflag, center FROM c", _WM)
def stats_weighted_median(spark, d):
    return R.weighted_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("o AS (SELECT l_returnflag AS k, abs(l_extendedprice - center) AS v, sum(l_quantity) AS w FROM lineitem JOIN c ON k = l_returnflag WHERE l_quantity > 0 GROUP BY 1, 2), s AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v) AS run, sum(w) OVER (PARTITION BY k) AS tot FROM o) SELECT k AS l_returnflag, round(min(v), 4) AS mad FROM s WHERE run >= tot / 2 GROUP BY k", _WM)
def stats_weighted_mad(spark, d):
    l = table(spark, d, "lineitem")
    c = R.weighted_median(l, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return R.weighted_mad(l, ["l_returnflag"], "l_extendedprice", "l_quantity", c).select("l_returnflag", F.round("mad", 4).alias("mad"))


def _usable(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).where("validity in ('ok', 'degraded')").where(R.finite("value").isNotNull())
    return m.select("subject", "name", "value", F.round(F.col("confidence") * F.when(F.col("validity") == "degraded", 0.65).otherwise(1.0), 6).alias("weight"))


def _fit_sql(src: str, out: str) -> str:
    return f"""{out}_g AS (SELECT subject, name, value, sum(weight) AS w FROM {src} GROUP BY 1, 2, 3),
{out}_r AS (SELECT subject, name, value, sum(w) OVER (PARTITION BY subject, name ORDER BY value) AS run, sum(w) OVER (PARTITION BY subject, name) AS tot FROM {out}_g),
{out}_c AS (SELECT subject, name, min(value) AS center FROM {out}_r WHERE run >= tot / 2 GROUP BY 1, 2),
{out}_o AS (SELECT subject, name, abs(value - center) AS o, sum(weight) AS w FROM {src} JOIN {out}_c USING (subject, name) GROUP BY 1, 2, 3),
{out}_s AS (SELECT subject, name, o, sum(w) OVER (PARTITION BY subject, name ORDER BY o) AS run, sum(w) OVER (PARTITION BY subject, name) AS tot FROM {out}_o),
{out} AS (SELECT subject, name, any_value(center) AS center, greatest(1.4826 * min(o), 0.02) AS scale FROM {out}_s JOIN {out}_c USING (subject, name) WHERE run >= tot / 2 GROUP BY 1, 2)"""


_PRIOR = f"""u AS (SELECT subject, name, value, round(confidence * CASE WHEN validity = 'degraded' THEN 0.65 ELSE 1.0 END, 6) AS weight FROM f WHERE validity IN ('ok', 'degraded')), u2 AS (SELECT * FROM u WHERE weight > 0),
{_fit_sql('u2', 'a')}, kept AS (SELECT u2.* FROM u2 JOIN a USING (subject, name) WHERE abs(value - center) <= 4 * scale), {_fit_sql('kept', 'b')},
n AS (SELECT subject, name, count(*) AS n FROM u2 GROUP BY 1, 2), k AS (SELECT subject, name, count(*) AS m FROM kept GROUP BY 1, 2),
prior AS (SELECT n.subject, n.name, n, n >= 5 AND coalesce(m, 0) >= 5 AS ok, center, scale, n - coalesce(m, 0) AS n_out FROM n LEFT JOIN k USING (subject, name) LEFT JOIN b USING (subject, name))"""


@query(_PRIOR + " SELECT subject, name, n, round(CASE WHEN ok THEN center END, 6) AS center, round(CASE WHEN ok THEN scale END, 6) AS scale, n_out, CASE WHEN NOT ok THEN 'abstain' WHEN n_out > 0 THEN 'degraded' ELSE 'ok' END AS validity FROM prior")
def stats_robust_prior(spark, d):
    p = R.robust_prior(_usable(spark, d), ["subject", "name"], "value", "weight", 0.02)
    return p.select("subject", "name", "n", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"), "n_out", "validity")


_SCORE = """b AS (SELECT name, p25, p50, p75 FROM ideal_bands), p AS (SELECT subject_pseudonym AS subject, name, max(center) AS center, max(scale) AS scale FROM metric_priors WHERE center IS NOT NULL GROUP BY 1, 2),
j AS (SELECT f.swing_id, f.name, value, coalesce(p.center, b.p50) AS c, coalesce(p.scale, greatest((b.p75 - b.p25) / 1.349, 0.02)) AS s, CASE WHEN p.center IS NOT NULL THEN 'personal' WHEN b.p50 IS NOT NULL THEN 'template' ELSE 'none' END AS source FROM f LEFT JOIN p ON p.subject = f.subject AND p.name = f.name LEFT JOIN b ON b.name = f.name)"""


@query(_SCORE + " SELECT swing_id, name, source, round((value - c) / s, 5) AS z, abs(value - c) <= 1.5 * s AS in_window FROM j")
def stats_prior_score_fallback(spark, d):
    m = metrics(spark, d).where(R.finite("value").isNotNull()).select("swing_id", "subject", "name", "value")
    p = table(spark, d, "metric_priors").where("center is not null").groupBy(F.col("subject_pseudonym").alias("subject"), "name").agg(F.max("center").alias("pc"), F.max("scale").alias("ps"))
    b = F.broadcast(table(spark, d, "ideal_bands").select("name", "p25", "p50", "p75"))
    j = m.join(p, ["subject", "name"], "left").join(b, "name", "left")
    c, s = F.coalesce("pc", "p50"), F.coalesce(F.col("ps"), F.greatest((F.col("p75") - F.col("p25")) / 1.349, F.lit(0.02)))
    source = F.when(F.col("pc").isNotNull(), "personal").when(F.col("p50").isNotNull(), "template").otherwise("none")
    return j.select("swing_id", "name", source.alias("source"), F.round((F.col("value") - c) / s, 5).alias("z"), (F.abs(F.col("value") - c) <= 1.5 * s).alias("in_window"))


def _mixed_sql(x: str, src: str, out: str) -> str:
    """CTEs that replace column x of src by its mixed number."""
    a, b = R.MIX
    return f"""{out}_1 AS (SELECT * REPLACE ((xor({x}, {x} >> 16) * {a}) & 4294967295 AS {x}) FROM {src}), {out}_2 AS (SELECT * REPLACE ((xor({x}, {x} >> 15) * {b}) & 4294967295 AS {x}) FROM {out}_1),
{out} AS (SELECT * REPLACE (xor({x}, {x} >> 15) AS {x}) FROM {out}_2)"""


@query(f"""d AS (SELECT o_orderpriority AS k, CAST(o_totalprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey, o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE isfinite(CAST(o_totalprice AS DOUBLE))),
i0 AS (SELECT k, n, i AS x FROM d), {_mixed_sql('x', 'i0', 'ix')},
b0 AS (SELECT CAST(range AS BIGINT) AS b, CAST((range * {R.SEED_STEP} + 12345) & 4294967295 AS BIGINT) AS y FROM range(2000)), {_mixed_sql('y', 'b0', 'bx')},
p0 AS (SELECT k, n, b, xor(x, y) AS x FROM ix, bx), {_mixed_sql('x', 'p0', 'px')},
m AS (SELECT px.k, b, avg(d.v) AS m FROM px JOIN d ON d.k IS NOT DISTINCT FROM px.k AND d.i = px.x % px.n GROUP BY 1, 2),
q AS (SELECT k, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY k)
SELECT g.k AS o_orderpriority, g.n, round(g.mean, 4) AS mean, round(q.lo, 3) AS lo, round(q.hi, 3) AS hi FROM (SELECT k, count(*) AS n, avg(v) AS mean FROM d GROUP BY k) g JOIN q USING (k)""", "z AS (SELECT 1)")
def stats_bootstrap_orders(spark, d):
    """Intervals of the mean price of the orders of each priority, from 2000 resamples drawn with replacement."""
    b = R.bootstrap_mean_ci(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey")
    return b.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query("s AS (SELECT swing_id, name, value, unnest([kind, kind || ':' || validity, CASE WHEN confidence < 0.5 THEN 'unsure' END]) AS stratum FROM f) SELECT stratum, name, count(*) AS n, round(avg(value), 9) AS mean FROM s WHERE stratum IS NOT NULL GROUP BY 1, 2")
def stats_overlapping_strata(spark, d):
    m = metrics(spark, d).where(R.finite("value").isNotNull())
    s = R.strata(m, [F.col("kind"), F.concat("kind", F.lit(":"), "validity"), F.when(F.col("confidence") < 0.5, F.lit("unsure"))])
    return s.groupBy("stratum", "name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())", "")
def stats_grouping_sets(spark, d):
    o = table(spark, d, "orders")
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[a], [b], [a, b], []], a, b).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))


_O = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"r AS (SELECT o_custkey, row_number() OVER {_O} AS r, o_totalprice < 100000 AS bad FROM orders) SELECT o_custkey, CAST(max(r) - coalesce(max(r) FILTER (NOT bad), 0) AS BIGINT) AS streak FROM r GROUP BY 1", "z AS (SELECT 1)")
def stats_streak(spark, d):
    return R.streak(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice") < 100000).select("o_custkey", F.col("streak").cast("long").alias("streak"))


@query(f"r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER {_O} AS r, count(*) OVER (PARTITION BY o_custkey) // 2 AS h FROM orders) SELECT o_custkey, round(median(v) FILTER (r > h) - median(v) FILTER (r <= h), 4) AS decay FROM r GROUP BY 1", "z AS (SELECT 1)")
def stats_decay(spark, d):
    return R.decay(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", F.round("decay", 4).alias("decay"))


@query(f"r AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v, row_number() OVER {_O} AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, round(0.6::DOUBLE * pow(0.9::DOUBLE, max(n)) + sum((1 - 0.9::DOUBLE) * pow(0.9::DOUBLE, n - r) * v), 9) AS score FROM r GROUP BY 1", "z AS (SELECT 1)")
def stats_ema(spark, d):
    o = table(spark, d, "orders").withColumn("won", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return R.ema(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "won", start=0.6).select("o_custkey", F.round("score", 9).alias("score"))


@query("SELECT event_type, count(*) AS n, CAST(count_if(value >= 50) AS BIGINT) AS ok, round(count_if(value >= 50) / count(*), 6) AS success, round(avg(value), 9) AS mean FROM events GROUP BY 1", "")
def stats_task_metrics(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("ok"), F.round(F.avg("value"), 9).alias("mean"))
    return e.select("event_type", "n", "ok", F.round(F.coalesce(F.try_divide("ok", "n"), F.lit(0.0)), 6).alias("success"), "mean")


@query("r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, count(*) AS n, round(avg(value), 9) AS recent FROM r WHERE r <= 10 GROUP BY 1", "z AS (SELECT 1)")
def stats_trend(spark, d):
    """Means of the last ten of each user: the window is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("recent"))


@query("a AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT user_id, v[CAST(floor((len(v) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_lower FROM a", "z AS (SELECT 1)")
def stats_nearest_lower_p95(spark, d):
    """The value at place floor((n - 1) * 0.95), not interpolated."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    e = table(spark, d, "events").select("user_id", "value", (F.row_number().over(w) - 1).alias("r"), F.floor((F.count("*").over(Window.partitionBy("user_id")) - 1) * 0.95).alias("k"))
    return e.where("r = k").select("user_id", F.col("value").alias("p95_lower"))


_BUDGETS = [("tempo_s", 1.1), ("rhythm", 3.5), ("plane_angle_deg", 60.0), ("downswing_s", 0.2), ("unknown_metric", 1.0)]


@query(f"b(name, most) AS (VALUES {', '.join(map(str, _BUDGETS))}), s AS (SELECT name, median(value) AS median FROM f GROUP BY 1) SELECT b.name, CAST(most AS DOUBLE) AS most, round(median, 6) AS median, CASE WHEN median IS NULL THEN 'missing' WHEN median > most THEN 'fail' ELSE 'pass' END AS status FROM b LEFT JOIN s USING (name)")
def gates_budget(spark, d):
    b = spark.createDataFrame(_BUDGETS, "name string, most double")
    s = R.summary(metrics(spark, d), ["name"], "value").select("name", "median")
    return R.gate(s, b, ["name"], "median", "most").select("name", "most", F.round("median", 6).alias("median"), "status")


@query("""c AS (SELECT DISTINCT session_id, lower(regexp_replace(capture_mode, '[\\s_-]+', '', 'g')) AS mode, handedness, wrist, device_model, ended_at_unix FROM captures),
x AS (SELECT count(DISTINCT session_id) AS n, count(DISTINCT device_model) AS models, count(DISTINCT session_id) FILTER (mode = 'highrate') AS high, count(DISTINCT session_id) FILTER (mode = 'compat') AS compat, count(DISTINCT handedness) AS hands, count(DISTINCT wrist) AS wrists, count(DISTINCT session_id) FILTER (ended_at_unix IS NOT NULL) AS ended FROM c)
SELECT criterion, v AS actual, need AS required, v >= need AS passed FROM (SELECT unnest(['sessions', 'models', 'high_rate', 'compat', 'hands', 'wrists', 'ended']) AS criterion, unnest([n, models, high, compat, hands, wrists, ended]) AS v, unnest(CAST([30, 2, 1, 1, 2, 2, greatest(3, (n + 9) // 10)] AS BIGINT[])) AS need FROM x)""", "z AS (SELECT 1)")
def gates_release(spark, d):
    """One row per criterion of a release: enough sessions, models, modes, hands, wrists and finished recordings."""
    from lodestrata.operators.grid import spelling

    c = table(spark, d, "captures").withColumn("mode", spelling("capture_mode"))
    n = lambda cond=None: F.countDistinct(F.when(cond, F.col("session_id")) if cond is not None else F.col("session_id"))
    x = c.agg(n().alias("n"), F.countDistinct("device_model").alias("models"), n(F.col("mode") == "highrate").alias("high"), n(F.col("mode") == "compat").alias("compat"), F.countDistinct("handedness").alias("hands"), F.countDistinct("wrist").alias("wrists"), n(F.col("ended_at_unix").isNotNull()).alias("ended"))
    rows = [("sessions", "n", "30"), ("models", "models", "2"), ("high_rate", "high", "1"), ("compat", "compat", "1"), ("hands", "hands", "2"), ("wrists", "wrists", "2"), ("ended", "ended", "greatest(3, (n + 9) div 10)")]
    return x.selectExpr("stack(7, " + ", ".join(f"'{a}', {b}, cast({c} as bigint)" for a, b, c in rows) + ") as (criterion, actual, required)").withColumn("passed", F.col("actual") >= F.col("required"))


_LAYERS = """q AS (SELECT swing_id, name, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 'abstain' ELSE 'ok' END AS reading, CASE WHEN confidence IS NULL OR confidence < 0.35 THEN 'abstain' WHEN confidence < 0.6 THEN 'degraded' ELSE 'ok' END AS trust, coalesce(validity, 'abstain') AS stated, why FROM m),
w AS (SELECT *, CASE WHEN 'abstain' IN (reading, trust, stated) THEN 'abstain' WHEN 'degraded' IN (reading, trust, stated) THEN 'degraded' ELSE 'ok' END AS overall FROM q)"""


def _layers(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    reading = F.when(R.finite("value").isNull(), "abstain").otherwise("ok")
    trust = F.when(F.col("confidence").isNull() | (F.col("confidence") < 0.35), "abstain").when(F.col("confidence") < 0.6, "degraded").otherwise("ok")
    m = m.select("swing_id", "name", reading.alias("reading"), trust.alias("trust"), F.coalesce("validity", F.lit("abstain")).alias("stated"), "why")
    return m.withColumn("overall", R.worst(F.col("reading"), F.col("trust"), F.col("stated")))


@query(_LAYERS + " SELECT swing_id, name, reading, trust, stated FROM w")
def quality_layers(spark, d):
    return _layers(spark, d).select("swing_id", "name", "reading", "trust", "stated")


@query(_LAYERS + " SELECT name, overall, count(*) AS n FROM w GROUP BY 1, 2")
def quality_worst_of(spark, d):
    return _layers(spark, d).groupBy("name", "overall").agg(F.count("*").alias("n"))


@query("x AS (SELECT DISTINCT swing_id, r FROM (SELECT swing_id, unnest(string_split(why, '|')) AS r FROM m WHERE why <> '')) SELECT swing_id, string_agg(r, '|' ORDER BY r) AS reasons FROM x WHERE r <> '' GROUP BY 1")
def quality_reason_union(spark, d):
    m = metrics(spark, d).where("why <> ''").select("swing_id", F.explode(F.split("why", r"\|")).alias("r")).where("r <> ''")
    return m.groupBy("swing_id").agg(F.array_join(F.array_sort(F.collect_set("r")), "|").alias("reasons"))


@query("""SELECT swing_id, name, issue FROM (SELECT swing_id, name, unnest([CASE WHEN value IS NULL OR NOT isfinite(value) THEN 'value_not_finite' END, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END,
CASE WHEN coalesce(validity, '') NOT IN ('ok', 'degraded', 'abstain') THEN 'unknown_validity' END, CASE WHEN coalesce(kind, '') NOT IN ('measured', 'derived', 'inferred', 'proxy') THEN 'unknown_kind' END, CASE WHEN validity = 'abstain' AND why = '' THEN 'abstain_without_reason' END]) AS issue FROM m) WHERE issue IS NOT NULL""")
def quality_metric_validation(spark, d):
    issues = F.array_compact(F.array(
        F.when(R.finite("value").isNull(), F.lit("value_not_finite")), F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), F.lit("confidence_out_of_range")),
        F.when(~F.coalesce("validity", F.lit("")).isin("ok", "degraded", "abstain"), F.lit("unknown_validity")), F.when(~F.coalesce("kind", F.lit("")).isin("measured", "derived", "inferred", "proxy"), F.lit("unknown_kind")),
        F.when((F.col("validity") == "abstain") & (F.col("why") == ""), F.lit("abstain_without_reason")),
    ))
    return metrics(spark, d).select("swing_id", "name", F.explode(issues).alias("issue"))


_RULES = [("rhythm", "low", 1.8), ("rhythm", "high", 4.5), ("tempo_s", "high", 1.6), ("downswing_s", "high", 0.45), ("plane_angle_deg", "low", 40.0)]


@query(f"r(name, side, bound) AS (VALUES {', '.join(map(str, _RULES))}) SELECT swing_id, name, name || '_' || side AS code, round(value - bound, 6) AS excess FROM f JOIN r USING (name) WHERE CASE WHEN side = 'low' THEN value < bound ELSE value > bound END")
def rules_findings(spark, d):
    r = F.broadcast(spark.createDataFrame(_RULES, "name string, side string, bound double"))
    m = metrics(spark, d).where(R.finite("value").isNotNull()).join(r, "name").where(F.when(F.col("side") == "low", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound")))
    return m.select("swing_id", "name", F.concat_ws("_", "name", "side").alias("code"), F.round(F.col("value") - F.col("bound"), 6).alias("excess"))


@query("s AS (SELECT swing_id, f.name, greatest(0.0::DOUBLE, 1 - greatest(p25 - value, value - p75, 0.0::DOUBLE) / (2 * greatest(p75 - p25, 1e-9))) AS s FROM f JOIN ideal_bands b ON b.name = f.name) SELECT swing_id, count(*) AS n, round(avg(s), 9) AS score FROM s GROUP BY 1")
def report_reference_score(spark, d):
    b = F.broadcast(table(spark, d, "ideal_bands").select("name", "p25", "p75"))
    m = metrics(spark, d).where(R.finite("value").isNotNull()).join(b, "name")
    return m.groupBy("swing_id").agg(F.count("*").alias("n"), F.round(F.avg(R.band_score(F.col("value"), F.col("p25"), F.col("p75"))), 9).alias("score"))


@query("""p AS (SELECT l_orderkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY 1)
SELECT l_orderkey, metric, round(value, 4) AS value FROM (SELECT l_orderkey, unnest(['quantity', 'price', 'discount']) AS metric, unnest([quantity, price, discount]) AS value FROM p)""", "z AS (SELECT 1)")
def report_tall(spark, d):
    """A wide report as rows of one metric each."""
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    return p.unpivot("l_orderkey", ["quantity", "price", "discount"], "metric", "value").select("l_orderkey", "metric", F.round("value", 4).alias("value"))


#: Sizes below which a value is sealed with a factor; the last holds every double.
_SCALES = [(10.0 ** (13 + 10 * k), 10.0 ** (5 - 10 * k)) for k in range(29)] + [(float("inf"), 1e-290)]
_SEALED = "CASE WHEN value IS NULL THEN 'null' WHEN isnan(value) THEN 'nan' WHEN isinf(value) AND value > 0 THEN 'inf' WHEN isinf(value) THEN '-inf' " + " ".join(f"WHEN abs(value) < {lim!r}::DOUBLE THEN '{k}:' || CAST(CAST(round(value * {f!r}::DOUBLE) AS BIGINT) AS VARCHAR)" for k, (lim, f) in enumerate(_SCALES[:-1])) + f" ELSE '29:' || CAST(CAST(round(value * 1e-290::DOUBLE) AS BIGINT) AS VARCHAR) END"


def sealed(value: str):
    """A value as text: its kind where it is no finite number, else its scale and eight digits or more; every value has one."""
    v = F.col(value)
    out = F.when(v.isNull(), "null").when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    for k, (limit, factor) in enumerate(_SCALES):
        out = out.when(F.abs(v) < limit, F.concat(F.lit(f"{k}:"), F.round(v * F.lit(factor)).cast("long").cast("string")))
    return out


@query(f"h AS (SELECT swing_id, sha256(string_agg(name || '=' || t, ';' ORDER BY name, t)) AS seal, count(*) AS n FROM (SELECT swing_id, name, {_SEALED} AS t FROM m) GROUP BY 1) SELECT * FROM h")
def protocol_holdout_seal(spark, d):
    """A fingerprint of all metrics of each swing, null and non-finite ones included, to be compared with a sealed one."""
    m = metrics(spark, d).select("swing_id", "name", F.concat_ws("=", "name", sealed("value")).alias("t"))
    return m.groupBy("swing_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "t"))), lambda x: x["t"]), ";"), 256).alias("seal"), F.count("*").alias("n"))
