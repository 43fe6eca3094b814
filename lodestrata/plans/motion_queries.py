"""Sequential estimators, fits, source extraction and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import estimators as E
from lodestrata.operators import evaluation, latent, packets, segmentation, trajectory
from lodestrata.session import Workspace, table
from lodestrata.sources import source_code, synthetic
from lodestrata.streaming import cues

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
GYRO, ACCEL = ["gyro_x", "gyro_y", "gyro_z"], ["ax", "ay", "az"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _motion(spark, d):
    m = table(spark, d, "motion").where("t is not null").select("session_id", "i", "t", *GYRO, *((F.col(f"gravity_{c}") + F.col(f"user_accel_{c}")) * E.G for c in "xyz")).distinct().toDF("session_id", "i", "t", *GYRO, *ACCEL)
    return m


@query()
def filt_suite(spark, d):
    """Every filter over every session."""
    return E.orientations(_motion(spark, d), ["session_id"], "t", GYRO, ACCEL)


@query()
def filt_gyro_integrate(spark, d):
    return E.orientations(_motion(spark, d), ["session_id"], "t", GYRO, ACCEL, ["gyro"])


@query()
def traj_lever_arm(spark, d):
    return E.lever_arm(_motion(spark, d), ["session_id"], "t", GYRO, ACCEL)


@query()
def seg_phases(spark, d):
    """Phases and features of every session."""
    return segmentation.segment_groups(_motion(spark, d), ["session_id"], "t", GYRO, ACCEL)


@query()
def traj_hybrid(spark, d):
    return trajectory.trajectory_groups(_motion(spark, d), ["session_id"], "t", GYRO, ACCEL)


def _cases(spark):
    return synthetic.cases(spark, ["ideal", "consumer", "consumer_wrist"]).repartition(2 * spark.sparkContext.defaultParallelism)


@query()
def bench_events(spark, d):
    """Errors of the four phases in milliseconds, by level of sensor error, over synthetic swings with known phases."""
    return evaluation.summary(evaluation.event_results(_cases(spark)))


@query()
def bench_orientation(spark, d):
    """Errors of every filter in degrees, heading aligned, by level of sensor error."""
    return evaluation.summary(evaluation.orientation_results(_cases(spark)))


@query()
def bench_trajectory(spark, d):
    """Errors of three kinds of trajectory in centimetres, heading aligned, by level of sensor error."""
    return evaluation.summary(evaluation.trajectory_results(_cases(spark)))


@query()
def bench_gates(spark, d):
    """Summaries beyond their budgets: impact within 15 ms, orientation within 6 degrees, position within 17 cm."""
    s = evaluation.event_results(_cases(spark)).unionByName(evaluation.orientation_results(_cases(spark), ["gated"])).unionByName(evaluation.trajectory_results(_cases(spark)).where("algorithm = 'hybrid'"))
    # The budgets.
    budgets = spark.createDataFrame([(track, level, metric, most) for track, metric, most in (("events", "impact_ms", 15.0), ("orientation", "mean_deg", 6.0), ("trajectory", "mean_cm", 17.0)) for level in ("ideal", "consumer", "consumer_wrist")], "track string, level string, metric string, max_value double")
    return evaluation.gate_violations(evaluation.summary(s), budgets)


@query()
def bench_degradation(spark, d):
    """Mean error of orientation over a sweep of scaled sensor errors."""
    return evaluation.sweep_results(synthetic.sweep(spark).repartition(2 * spark.sparkContext.defaultParallelism)).groupBy("scale").agg(F.avg("value").alias("mean_deg"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_q, round(covar_pop(l_quantity, l_extendedprice), 3) AS cov_qp, round(covar_pop(l_quantity, l_discount), 6) AS cov_qd, round(covar_pop(l_discount, l_discount), 8) AS cov_dd FROM x GROUP BY 1""")
def vec_covariance(spark, d):
    c = E.covariance(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])
    return c.select("l_returnflag", "n", F.round("mean_l_quantity", 6).alias("mean_q"), F.round("cov_l_quantity_l_extendedprice", 3).alias("cov_qp"), F.round("cov_l_quantity_l_discount", 6).alias("cov_qd"), F.round("cov_l_discount_l_discount", 8).alias("cov_dd"))


@query()
def fit_plane_moments(spark, d):
    return E.plane_fit(_motion(spark, d), ["session_id"], GYRO)


@query("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem GROUP BY 1""")
def fit_ridge_xtx(spark, d):
    r = E.ridge(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice", 0.0)
    return r.select("l_returnflag", "n", F.round(F.col("coefficients")[0], 3).alias("slope"), F.round("intercept", 1).alias("intercept"))


@query()
def vec_manifold_score(spark, d):
    return E.manifold_scores(table(spark, d, "embeddings"), "embedding", ["vec_id", "label"])


@query()
def latent_prediction(spark, d):
    """The second half of each embedding predicted from the first, with its validity."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    m = latent.fit(e, "x", "y", (32, 32), "vec_id")
    return latent.predict(e, m, "x", ["vec_id"]).select("vec_id", F.size("prediction").alias("places"), "residual", "validity")


@query()
def latent_leave_group_out(spark, d):
    """For each label the error of a model of the other labels."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    labels = [r[0] for r in e.select("label").distinct().orderBy("label").collect()]  # a class each, a handful
    return latent.held_out_groups(e, "label", "x", "y", (32, 32), "vec_id", labels)


@query("""WITH m AS (SELECT DISTINCT swing_id, subject_pseudonym, name, value FROM metrics),
x AS (SELECT m.subject_pseudonym AS subject, b.p50 AS x, m.value AS y FROM m JOIN ideal_bands b USING (name) WHERE m.value IS NOT NULL AND isfinite(m.value)),
g AS (SELECT subject, count(*) AS n, stddev_pop(x) AS sd, avg(y - x) AS o, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM x GROUP BY 1)
SELECT subject, n, round(CASE WHEN n < 3 OR sd < 1e-6 THEN 1.0 ELSE 0.85 * a + 0.15 END, 4) AS slope, round(CASE WHEN n < 3 THEN 0.0 WHEN sd < 1e-6 THEN o ELSE 0.85 * b END, 3) AS offset_ FROM g""")
def personal_calibration(spark, d):
    """The line from ideal to measured values of each subject, drawn towards the identity."""
    m = table(spark, d, "metrics").select("swing_id", F.col("subject_pseudonym").alias("subject"), "name", "value").distinct()
    b = table(spark, d, "ideal_bands").select("name", "p50")
    x = m.join(F.broadcast(b), "name").where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return latent.personal_lines(x, ["subject"], "p50", "value").select("subject", "n", F.round("slope", 4).alias("slope"), F.round("offset", 3).alias("offset_"))


@query()
def edge_student(spark, d):
    """The last layer of a small regression of the label on random features of the embedding."""
    return latent.student(table(spark, d, "embeddings"), "embedding", "label", 64)


@query()
def source_symbols(spark, d):
    """Symbols found in the sources themselves, in five languages."""
    return source_code.symbols(table(spark, d, "files"))


@query()
def source_imports(spark, d):
    return source_code.imports(table(spark, d, "files"))


@query()
def source_exports(spark, d):
    return source_code.exports(table(spark, d, "files"))


@query()
def source_relations(spark, d):
    """Calls, instantiations, inheritance and decorations found in the sources."""
    return source_code.relations(table(spark, d, "files"))


@query()
def source_import_resolution(spark, d):
    """The file each import means."""
    f = table(spark, d, "files")
    return source_code.resolve_imports(source_code.imports(f), f)


@query()
def source_graph_edges(spark, d):
    """Edges of the graph built from sources alone."""
    return source_code.source_graph(table(spark, d, "files"))[1]


def _stream(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("SELECT DISTINCT session_id FROM captures WHERE session_id IS NOT NULL")
def stream_session_dedupe(spark, d):
    s = cues.idempotent(_stream(spark, d, "captures").where("session_id is not null"), "session_id", "received_at", "400 days")
    return cues.drain(s.select("session_id"), Workspace(spark), "sessions")


def _rates(m):
    """Angular rates of rows with a time and three finite readings; other rows are left out, as a rate of them is not known."""
    finite = [F.abs(F.nanvl(F.col(c).cast("double"), F.lit(float("inf")))) < float("inf") for c in GYRO]
    w = F.sqrt(sum(F.col(c).cast("double") ** 2 for c in GYRO))
    return m.where("t is not null and session_id is not null").where(finite[0] & finite[1] & finite[2]).select("session_id", "t", w.alias("w"))


@query()
def stream_transition_cue(spark, d):
    return cues.drain(cues.transition_cues(_rates(_stream(spark, d, "motion"))), Workspace(spark), "cues")


@query()
def stream_orientation(spark, d):
    """The orientation of every session at each time, by a filter over a stream."""
    m = _stream(spark, d, "motion").where("session_id is not null and t is not null")
    m = m.select("session_id", "t", *(F.coalesce(F.col(g).cast("double"), F.lit(0.0)).alias(n) for g, n in zip(GYRO, ("gx", "gy", "gz"))), *((F.coalesce(F.col(f"gravity_{c}") + F.col(f"user_accel_{c}"), F.lit(0.0)) * E.G).cast("double").alias(f"a{c}") for c in "xyz"))
    return cues.drain(cues.streamed_orientations(m), Workspace(spark), "orientations").groupBy("session_id").agg(F.count("*").alias("n"), F.max_by("qw", "t").alias("last_qw"))


@query()
def traj_segment_channels(spark, d):
    """Twist and swing of the forearm in each session."""
    return packets.segment_channels(_motion(spark, d), ["session_id"], "t", GYRO, ACCEL)


@query()
def batch_transition_cue(spark, d):
    return cues.batch_cues(_rates(table(spark, d, "motion")))
