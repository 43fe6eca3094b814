"""Queries of reports, consistency, moments, windows and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import measures as M
from lodestrata.operators import packets as P
from lodestrata.session import Workspace, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_M = "m AS (SELECT DISTINCT swing_id, subject_pseudonym AS subject, name, value, kind, validity, confidence, captured_at FROM metrics)"
_FIN = "value IS NOT NULL AND isfinite(value)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _metrics(spark, d):
    return table(spark, d, "metrics").select("swing_id", F.col("subject_pseudonym").alias("subject"), "name", "value", "kind", "validity", "confidence", "captured_at").distinct()


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), w AS (SELECT user_id, event_id AS window_id, t AS lo, t + 86400.0 AS hi FROM e WHERE event_id % 10 = 0)
SELECT w.window_id, count(*) AS n FROM e JOIN w ON e.user_id = w.user_id AND e.t BETWEEN w.lo AND w.hi GROUP BY 1""")
def range_window_samples(spark, d):
    """How many events of a user lie within a day after each tenth event."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    w = e.where("event_id % 10 = 0").select("user_id", F.col("event_id").alias("window_id"), F.col("t").alias("lo"), (F.col("t") + 86400.0).alias("hi"))
    return M.in_windows(e, w, ["user_id"], "t", "lo", "hi", 86400.0).groupBy("window_id").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier), b AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer)
SELECT k, CAST(place AS INTEGER) AS place, s_suppkey, c_custkey FROM a JOIN b USING (k, place)""")
def zip_positions(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal")
    return M.zip_by_position(a, b, ["k"], ["s_suppkey"], [F.desc("c_acctbal"), "c_custkey"]).select("k", "place", "s_suppkey", "c_custkey")


@query("""SELECT l_returnflag, round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / (stddev_pop(l_quantity) ** 3 + 1e-9), 4) AS skew,
round(covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice) + 1e-9), 6) AS corr FROM lineitem GROUP BY 1""")
def stats_skew_correlation(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag")
    return g.agg(F.round(M.skewness("l_quantity"), 4).alias("skew"), F.round(M.correlation("l_quantity", "l_extendedprice"), 6).alias("corr"))


@query("""WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CAST(floor(rn * 4 / n) AS INTEGER) AS part, round(sum(value * value), 4) AS energy FROM x GROUP BY 1, 2""")
def ts_part_energies(spark, d):
    e = M.part_energies(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value")
    return e.select("user_id", "part", F.round("energy", 4).alias("energy"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM events),
g AS (SELECT user_id, coalesce(avg(CASE WHEN s <= 1e-9 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END), 0) AS r, coalesce(stddev_pop(s) FILTER (s > 0) / nullif(avg(s) FILTER (s > 0), 0), 0) AS cv FROM s GROUP BY 1)
SELECT user_id, round(r, 6) AS repeat_share, round(cv, 6) AS cv, r > 0.01 OR cv > 0.08 AS needed FROM g""")
def ts_needs_fixed_rate(spark, d):
    e = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return M.needs_fixed_rate(e, ["user_id"]).select("user_id", F.round("repeat_share", 6).alias("repeat_share"), F.round("cv", 6).alias("cv"), "needed")


@query("""WITH h AS (SELECT session_id, max(device_motion_hz) AS declared FROM captures WHERE session_id IS NOT NULL GROUP BY 1),
s AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS s FROM (SELECT DISTINCT session_id, t FROM motion WHERE session_id IS NOT NULL AND isfinite(t))),
g AS (SELECT session_id, median(s) AS med FROM s GROUP BY 1), f AS (SELECT g.session_id, declared, least(greatest(1.0 / nullif(med, 0), 40.0), 800.0) AS fs FROM g LEFT JOIN h USING (session_id))
SELECT session_id, round(CASE WHEN abs(declared - fs) / greatest(fs, 1.0) < 0.15 THEN declared ELSE fs END, 3) AS fs FROM f""")
def ts_fixed_rate(spark, d):
    from pyspark.sql import Window

    h = table(spark, d, "captures").where("session_id is not null").groupBy("session_id").agg(F.max("device_motion_hz").alias("declared"))
    m = table(spark, d, "motion").where("session_id is not null and t is not null and not isnan(t) and abs(t) < double('infinity')").select("session_id", "t").distinct()
    s = m.select("session_id", (F.col("t") - F.lag("t").over(Window.partitionBy("session_id").orderBy("t"))).alias("s"))
    g = s.groupBy("session_id").agg(F.median("s").alias("med")).join(h, "session_id", "left")
    return g.select("session_id", F.round(M.fixed_rate(F.col("med"), F.col("declared")), 3).alias("fs"))


@query(f"""WITH {_M}, p AS (SELECT subject_pseudonym AS subject, name, max(window_lo) AS lo, max(window_hi) AS hi FROM metric_priors GROUP BY 1, 2)
SELECT subject, name, count(*) AS n, round(avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS consistency FROM m JOIN p USING (subject, name) WHERE {_FIN} AND lo IS NOT NULL AND hi IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def stats_session_consistency(spark, d):
    p = table(spark, d, "metric_priors").groupBy(F.col("subject_pseudonym").alias("subject"), "name").agg(F.max("window_lo").alias("lo"), F.max("window_hi").alias("hi"))
    c = M.session_consistency(_metrics(spark, d).join(p, ["subject", "name"]), ["subject", "name"], "value", "lo", "hi")
    return c.select("subject", "name", "n", F.round("consistency", 6).alias("consistency"))


@query(f"""WITH {_M}, p AS (SELECT subject_pseudonym AS subject, name, max(center) AS c, max(scale) AS s FROM metric_priors GROUP BY 1, 2),
z AS (SELECT subject, name, (value - c) / s AS z, length(name) AS priority FROM m JOIN p USING (subject, name) WHERE {_FIN} AND c IS NOT NULL AND s > 0)
SELECT subject, arg_min(name, ROW(-(abs(z) + CASE WHEN contains(name, 'tempo') THEN 0.5 ELSE 0.0 END), priority, name)) AS name FROM z GROUP BY 1""")
def stats_focus_metric(spark, d):
    p = table(spark, d, "metric_priors").groupBy(F.col("subject_pseudonym").alias("subject"), "name").agg(F.max("center").alias("c"), F.max("scale").alias("s"))
    x = _metrics(spark, d).join(p, ["subject", "name"]).where("s > 0 and c is not null").select("subject", "name", ((F.col("value") - F.col("c")) / F.col("s")).alias("z"), F.length("name").alias("priority"))
    return M.focus(x, ["subject"], "z", "priority", "name", F.when(F.col("name").contains("tempo"), 0.5).otherwise(0.0))


@query(f"""WITH {_M}, g AS (SELECT name, subject, avg(value) FILTER (confidence >= 0.6) AS a, avg(value) FILTER (confidence < 0.6) AS b FROM m WHERE {_FIN} AND confidence IS NOT NULL GROUP BY 1, 2)
SELECT name, round(median(a - b), 6) AS delta, count(*) AS n_groups FROM g WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def stats_cohort_deltas(spark, d):
    x = _metrics(spark, d).where("confidence is not null").withColumn("sure", F.col("confidence") >= 0.6)
    return M.group_deltas(x, "name", "subject", "sure", "value").select("name", F.round("delta", 6).alias("delta"), "n_groups")


@query(f"WITH {_M} SELECT name, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / nullif(abs(median(value)), 0), 6) AS dispersion FROM m WHERE {_FIN} GROUP BY 1")
def stats_dispersion(spark, d):
    m = _metrics(spark, d).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return m.groupBy("name").agg(F.round(M.dispersion("value"), 6).alias("dispersion"))


@query("""WITH x AS (SELECT DISTINCT swing_id, name, reasons, captured_at FROM metrics), l AS (SELECT reasons FROM x WHERE len(reasons) > 0 ORDER BY captured_at DESC, swing_id, name LIMIT 50)
SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM l) GROUP BY 1 ORDER BY n DESC, reason LIMIT 3""")
def report_top_reasons(spark, d):
    x = table(spark, d, "metrics").select("swing_id", "name", "reasons", "captured_at").distinct().where(F.size("reasons") > 0)
    return M.top_reasons(x, "reasons", [F.desc("captured_at"), "swing_id", "name"])


@query("""SELECT dimension, stratum, count(*) AS n, count(DISTINCT session_id) AS n_subjects FROM (
SELECT session_id, 'handedness' AS dimension, handedness AS stratum FROM captures UNION ALL SELECT session_id, 'wrist', wrist FROM captures UNION ALL SELECT session_id, 'capture_mode', capture_mode FROM captures UNION ALL SELECT session_id, 'device_model', device_model FROM captures
UNION ALL SELECT session_id, 'system_version', system_version FROM captures UNION ALL SELECT session_id, 'schema_version', schema_version FROM captures) GROUP BY 1, 2""")
def report_stratification(spark, d):
    return M.stratification(table(spark, d, "captures"), ["handedness", "wrist", "capture_mode", "device_model", "system_version", "schema_version"], "session_id")


_TABLES = ("files", "symbols", "graph_edges", "metrics", "captures")


@query(" UNION ALL ".join(f"SELECT '{t}' AS store, count(*) AS n FROM {t}" for t in _TABLES))
def store_statistics(spark, d):
    out = None
    for t in _TABLES:
        x = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("store"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT repo, language, count(*) AS n, count(DISTINCT file_path) AS n_paths, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS chars FROM files GROUP BY 1, 2")
def registry_statistics(spark, d):
    return table(spark, d, "files").groupBy("repo", "language").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("n_paths"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"))


@query(f"WITH {_M} SELECT name, count(*) AS n, CAST(count_if(validity = 'ok') AS BIGINT) AS n_ok, round(count_if(validity = 'ok') / count(*), 6) AS ok_share FROM m GROUP BY 1 ORDER BY ok_share, name")
def report_improvement(spark, d):
    """Metrics by the share of valid values, the least first."""
    g = _metrics(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("validity") == "ok").alias("n_ok"))
    return g.withColumn("ok_share", F.round(F.try_divide("n_ok", "n"), 6)).orderBy("ok_share", "name")


@query(f"WITH {_M}, g AS (SELECT kind, validity, count(*) AS n FROM m GROUP BY 1, 2) SELECT kind, validity, n, round(sum(CASE WHEN validity = 'ok' THEN n ELSE 0 END) OVER (PARTITION BY kind) / sum(n) OVER (PARTITION BY kind), 6) AS pass_rate FROM g")
def report_verification(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("kind")
    g = _metrics(spark, d).groupBy("kind", "validity").agg(F.count("*").alias("n"))
    return g.withColumn("pass_rate", F.round(F.sum(F.when(F.col("validity") == "ok", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w), 6))


@query(f"WITH {_M} SELECT name, validity, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.95), 2) AS p95, max(value) AS max, count(*) AS n FROM m WHERE {_FIN} GROUP BY 1, 2")
def stats_error_summary(spark, d):
    m = _metrics(spark, d).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return m.groupBy("name", "validity").agg(F.round(F.avg("value"), 2).alias("mean"), F.round(F.percentile("value", F.lit(0.95)), 2).alias("p95"), F.max("value").alias("max"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT swing_id, list(confidence ORDER BY name) AS c FROM (SELECT DISTINCT swing_id, name, confidence FROM metrics WHERE confidence IS NOT NULL AND isfinite(confidence)) GROUP BY 1)
SELECT swing_id, round(least(greatest(list_sum(c) / len(c), 0.05), 0.95), 6) AS fused FROM g""")
def quality_fused_confidence(spark, d):
    x = table(spark, d, "metrics").where("confidence is not null and not isnan(confidence)").select("swing_id", "name", "confidence").distinct()
    g = x.groupBy("swing_id").agg(F.collect_list(F.col("confidence").cast("double")).alias("c"))
    return g.select("swing_id", F.round(M.fuse_confidence(F.col("c")), 6).alias("fused"))


@query("""WITH r AS (SELECT swing_id, name, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS i FROM (SELECT DISTINCT swing_id, name, reasons FROM metrics)),
f AS (SELECT swing_id, reason, min(name) AS name, arg_min(i, name) AS i FROM r WHERE reason IS NOT NULL AND reason <> '' GROUP BY 1, 2)
SELECT swing_id, string_agg(reason, ',' ORDER BY name, i) AS reasons FROM f GROUP BY 1""")
def quality_reasons_in_order(spark, d):
    """The reasons of a swing's metrics by name, each once, where it comes first."""
    x = table(spark, d, "metrics").select("swing_id", "name", "reasons").distinct()
    g = x.groupBy("swing_id").agg(F.array_sort(F.collect_list(F.struct("name", "reasons"))).alias("r"))
    all_ = F.flatten(F.transform(F.filter("r", lambda x: x["reasons"].isNotNull()), lambda x: x["reasons"]))
    return g.select("swing_id", F.array_join(M.reasons_in_order(all_), ",").alias("reasons")).where("reasons <> ''")


@query(r"""WITH s AS (SELECT DISTINCT file_path, name, signature, coalesce(nullif(regexp_extract(signature, '^\s*class\s+\w+\s*\(([^)]*)\)', 1), ''), regexp_extract(signature, '\bextends\s+([\w.<>, ]+?)(?:\s+implements\b|\s*\{|$)', 1)) AS x FROM symbols WHERE signature IS NOT NULL AND node_type = 'class')
SELECT file_path, name, array_to_string(list_filter(list_transform(string_split(x, ','), lambda v: trim(v)), lambda v: v <> '' AND NOT contains(v, '=')), ',') AS parents FROM s""")
def text_parent_classes(spark, d):
    s = table(spark, d, "symbols").where("signature is not null and node_type = 'class'").select("file_path", "name", "signature").distinct()
    return s.select("file_path", "name", F.array_join(M.parent_classes(F.col("signature")), ",").alias("parents"))


@query("""SELECT DISTINCT file_path, CAST(floor(list_max(list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: CASE WHEN trim(x, ' ') <> '' THEN length(regexp_extract(x, '^( *)', 1)) ELSE 0 END)) / 4) AS INTEGER) AS nesting FROM files WHERE content IS NOT NULL""")
def text_nesting(spark, d):
    return table(spark, d, "files").where("content is not null").select("file_path", M.nesting(F.col("content")).alias("nesting")).distinct()


@query("""WITH x AS (SELECT doc_id, text, substr(text, 1, 400) AS head FROM documents WHERE text IS NOT NULL), y AS (SELECT *, strpos(reverse(head), chr(10) || chr(10)) AS p FROM x)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN p > 0 AND length(head) - p - 1 > 320 THEN substr(head, 1, length(head) - p - 1) ELSE head END AS head FROM y""")
def text_truncate_paragraph(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", M.truncate_at_paragraph(F.col("text"), 100).alias("head"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01') // 1000 AS BIGINT) AS since_ms FROM events")
def scalar_times(spark, d):
    return table(spark, d, "events").select("event_id", M.epoch_ms(F.col("ts")).alias("ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), M.duration_ms(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).alias("since_ms"))


@query("SELECT o_orderkey, CAST(trunc(o_totalprice / 7) AS BIGINT) AS cut, CAST(floor(-o_totalprice / 7) AS BIGINT) AS down, CAST(round_even(CAST(o_orderkey AS DOUBLE) / 2, 0) AS BIGINT) AS even FROM orders")
def scalar_rounding(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 7).cast("long").alias("cut"), F.floor(-F.col("o_totalprice") / 7).alias("down"), F.bround(F.col("o_orderkey") / 2, 0).cast("long").alias("even"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS text FROM events")
def scalar_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), M.json_text("event_id", "event_type").alias("text"))


@query("""WITH RECURSIVE n AS (SELECT file_path || ':' || name AS id, min(node_type) AS label, min(name) AS name, CAST(min(length(coalesce(docstring, '')) + length(name)) // 4 AS BIGINT) AS tokens FROM symbols WHERE file_path IS NOT NULL AND name IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM graph_edges), t AS (SELECT id FROM n WHERE label = 'class' AND starts_with(name, 'Warm')),
i AS (SELECT t.id AS task, 'target' AS section, t.id AS item FROM t UNION SELECT t.id, 'dependencies', e.dst FROM t JOIN e ON e.src = t.id UNION SELECT t.id, 'related', e.src FROM t JOIN e ON e.dst = t.id),
x AS (SELECT task, section, item, n.tokens, coalesce(sum(n.tokens) OVER (PARTITION BY task, section ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i JOIN n ON n.id = i.item)
SELECT task, section, item, tokens, CAST(before AS BIGINT) AS before FROM x WHERE before < CASE section WHEN 'target' THEN 40 WHEN 'dependencies' THEN 30 ELSE 20 END""")
def context_assembly(spark, d):
    """For each class of a name what of itself, its dependencies and its dependents fits a budget of tokens, with a share for each."""
    s = table(spark, d, "symbols").where("file_path is not null and name is not null")
    n = s.groupBy(F.concat_ws(":", "file_path", "name").alias("id")).agg(F.min("node_type").alias("label"), F.min("name").alias("name"), F.floor(F.min(F.length(F.coalesce("docstring", F.lit(""))) + F.length("name")) / 4).alias("tokens"))
    e = table(spark, d, "graph_edges").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    t = n.where("label = 'class' and startswith(name, 'Warm')").select(F.col("id").alias("task"))
    own = t.select("task", F.lit("target").alias("section"), F.col("task").alias("item"))
    deps = t.join(e, F.col("task") == F.col("src")).select("task", F.lit("dependencies").alias("section"), F.col("dst").alias("item"))
    rel = t.join(e, F.col("task") == F.col("dst")).select("task", F.lit("related").alias("section"), F.col("src").alias("item"))
    items = own.unionByName(deps).unionByName(rel).distinct().join(n.select(F.col("id").alias("item"), "tokens"), "item")
    return M.context_sections(items, ["task"], "section", ["item"], "tokens", 100, {"target": 0.4, "dependencies": 0.3, "related": 0.2}).select("task", "section", "item", "tokens", "before")


@query(f"WITH {_M}, p AS (SELECT subject_pseudonym AS subject, name, max(center) AS c, max(confidence) AS w FROM metric_priors GROUP BY 1, 2) SELECT swing_id, name, round(value + least(greatest(w, 0), 0.30) * (c - value), 6) AS blended FROM m JOIN p USING (subject, name) WHERE {_FIN} AND c IS NOT NULL AND w IS NOT NULL")
def series_bounded_blend(spark, d):
    p = table(spark, d, "metric_priors").groupBy(F.col("subject_pseudonym").alias("subject"), "name").agg(F.max("center").alias("c"), F.max("confidence").alias("w"))
    x = _metrics(spark, d).join(p, ["subject", "name"]).where("value is not null and not isnan(value) and abs(value) < double('infinity') and c is not null and w is not null")
    return x.select("swing_id", "name", F.round(M.blended(F.col("value"), F.col("c"), F.col("w")), 6).alias("blended"))


@query("""WITH e AS (SELECT user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events), w AS (SELECT user_id, unnest(generate_series(s // 3600 * 3600 - 82800, s // 3600 * 3600, 3600)) AS start FROM e)
SELECT user_id, start, count(*) AS n FROM w GROUP BY 1, 2""")
def window_sliding(spark, d):
    """Events of a user in windows of a day that begin every hour."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.window("ts", "1 day", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


@query("SELECT feedback_id, kind FROM (SELECT event_id AS feedback_id, event_type AS kind FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 50 = 1)")
def feedback_log(spark, d):
    """Two appends to a log of JSON lines, read again."""
    at = f"{Workspace(spark).base}/feedback"
    e = table(spark, d, "events").select(F.col("event_id").alias("feedback_id"), F.col("event_type").alias("kind"))
    for k in (0, 1):
        e.where(F.col("feedback_id") % 50 == k).write.mode("append").json(at)
    return spark.read.schema("feedback_id long, kind string").json(at)


@query("SELECT version, name, p25, p50, p75, CAST(row_number() OVER (ORDER BY p75 - p25 DESC, name) AS INTEGER) AS rank FROM ideal_bands")
def ranked_catalogue(spark, d):
    """The bands of the template, the widest first; a fixed table of a few rows."""
    from pyspark.sql import Window

    return table(spark, d, "ideal_bands").select("version", "name", "p25", "p50", "p75", F.row_number().over(Window.orderBy(F.desc(F.col("p75") - F.col("p25")), "name")).alias("rank"))


@query(f"WITH {_M}, k AS (SELECT subject, count(DISTINCT swing_id) AS n FROM m GROUP BY 1 HAVING count(DISTINCT swing_id) >= 5) SELECT m.swing_id, m.subject, m.value FROM m JOIN k USING (subject) WHERE name = 'tempo_s' AND value >= 0.5 AND isfinite(value)")
def filter_subjects(spark, d):
    """Values of one metric above a threshold, of subjects with enough swings."""
    m = _metrics(spark, d)
    k = m.groupBy("subject").agg(F.countDistinct("swing_id").alias("n")).where("n >= 5").select("subject")
    return m.where("name = 'tempo_s' and value >= 0.5 and not isnan(value) and value < double('infinity')").join(k, "subject", "left_semi").select("swing_id", "subject", "value")


_G = "g AS (SELECT DISTINCT session_id, i, t, CAST(gyro_x AS DOUBLE) AS x, CAST(gyro_y AS DOUBLE) AS y, CAST(gyro_z AS DOUBLE) AS z FROM motion WHERE session_id IS NOT NULL AND isfinite(t) AND isfinite(gyro_x) AND isfinite(gyro_y) AND isfinite(gyro_z))"


def _gyro(spark, d):
    m = table(spark, d, "motion").where("session_id is not null and t is not null and not isnan(t) and abs(t) < double('infinity')")
    ok = [F.abs(F.nanvl(F.col(f"gyro_{c}").cast("double"), F.lit(float("inf")))) < float("inf") for c in "xyz"]
    return m.where(ok[0] & ok[1] & ok[2]).select("session_id", "i", "t", *(F.col(f"gyro_{c}").cast("double").alias(c) for c in "xyz")).distinct()


@query(f"""WITH {_G}, h AS (SELECT session_id, bool_or(handedness = 'left') AS l FROM captures WHERE session_id IS NOT NULL GROUP BY 1)
SELECT g.session_id, i, round(x, 6) AS x, round(CASE WHEN l THEN y ELSE 0 - y END, 6) AS y, round(CASE WHEN l THEN z ELSE 0 - z END, 6) AS z FROM g LEFT JOIN h USING (session_id)""")
def packet_normalize(spark, d):
    """Rates turned by a half about x, the mount, and mirrored for left-handed wearers."""
    h = table(spark, d, "captures").where("session_id is not null").groupBy("session_id").agg(F.bool_or(F.col("handedness") == "left").alias("l"))
    g = _gyro(spark, d).join(h, "session_id", "left").withColumns({"ax": F.lit(0.0), "ay": F.lit(0.0), "az": F.lit(0.0)})
    n = P.normalized(g, ["x", "y", "z"], ["ax", "ay", "az"], [F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)], F.col("l"), F.lit(False))
    return n.select("session_id", "i", *(F.round(F.col(c) + F.lit(0.0), 6).alias(c) for c in "xyz"))


@query(f"""WITH {_G}, r AS (SELECT * FROM g WHERE sqrt(x * x + y * y + z * z) <= 0.5),
a AS (SELECT session_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x * x) + avg(y * y) + avg(z * z) AS s FROM r GROUP BY 1),
b AS (SELECT *, least(greatest(mx, -0.2), 0.2) AS bx, least(greatest(my, -0.2), 0.2) AS by_, least(greatest(mz, -0.2), 0.2) AS bz FROM a),
c AS (SELECT *, 1 - (s - 2 * (bx * mx + by_ * my + bz * mz) + bx * bx + by_ * by_ + bz * bz) / nullif(s, 0) AS gain FROM b)
SELECT session_id, n, round(CASE WHEN gain >= 0.05 THEN bx ELSE 0 END, 6) AS bx, round(CASE WHEN gain >= 0.05 THEN gain ELSE 0 END, 5) AS gain FROM c""")
def packet_bounded_bias(spark, d):
    b = P.bounded_bias(_gyro(spark, d).withColumn("w", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).where("w <= 0.5"), ["session_id"], ["x", "y", "z"], F.lit(True))
    return b.select("session_id", "n", F.round(F.col("bias")[0], 6).alias("bx"), F.round("gain", 5).alias("gain"))


@query(f"""WITH {_G}, u AS (SELECT session_id, t, min(x) AS x FROM g GROUP BY 1, 2), a AS (SELECT *, t - lag(t) OVER w AS dt, coalesce((x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0), 0) AS r FROM u WINDOW w AS (PARTITION BY session_id ORDER BY t)),
b AS (SELECT *, coalesce((r - lag(r) OVER (PARTITION BY session_id ORDER BY t)) / nullif(dt, 0), 0) AS q FROM a)
SELECT session_id, t, round(x + 2 * 0.7 / (2 * pi() * 60) * r + q / (2 * pi() * 60) ** 2, 4) AS straight FROM b""")
def packet_without_resonance(spark, d):
    u = _gyro(spark, d).groupBy("session_id", "t").agg(F.min("x").alias("x"))
    return P.without_resonance(u, ["session_id"], "t", "x", 60.0, 0.7).select("session_id", "t", F.round("straight", 4).alias("straight"))


_RATE = "w AS (SELECT session_id, t, max(sqrt(x * x + y * y + z * z)) AS w FROM g GROUP BY 1, 2)"


def _rate(spark, d):
    return _gyro(spark, d).groupBy("session_id", "t").agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("w"))


@query(f"""WITH {_G}, {_RATE}, s AS (SELECT *, min(t) FILTER (w > 1.5) OVER (PARTITION BY session_id) AS start FROM w), p AS (SELECT session_id, arg_min(t, ROW(-w, t)) AS impact FROM w GROUP BY 1), x AS (SELECT * FROM s JOIN p USING (session_id))
SELECT session_id, max(t) FILTER (t < start AND w <= 0.5) AS address, arg_min(t, ROW(w, t)) FILTER (t > start AND t < impact) AS top, max(impact) FILTER (start IS NOT NULL) AS impact, min(t) FILTER (t > impact AND start IS NOT NULL AND w <= 0.5) AS finish FROM x GROUP BY 1""")
def seg_simple_phases(spark, d):
    return P.simple_phases(_rate(spark, d), ["session_id"], "t", "w")


@query(f"""WITH {_G}, p AS (SELECT session_id, arg_min(t, ROW(-abs(x), t)) AS tx, arg_min(t, ROW(-abs(y), t)) AS ty, arg_min(t, ROW(-abs(z), t)) AS tz FROM g GROUP BY 1),
u AS (SELECT session_id, tx AS t, 'x' AS c FROM p UNION ALL SELECT session_id, ty, 'y' FROM p UNION ALL SELECT session_id, tz, 'z' FROM p)
SELECT session_id, string_agg(c, ',' ORDER BY t, c) AS sequence FROM u GROUP BY 1""")
def feature_peak_sequence(spark, d):
    return P.peak_sequence(_gyro(spark, d), ["session_id"], "t", ["x", "y", "z"])


@query(f"WITH {_G}, {_RATE}, m AS (SELECT *, max(w) OVER (PARTITION BY session_id) AS peak FROM w) SELECT session_id, round(max(w), 6) AS peak, arg_min(t, ROW(-w, t)) AS peak_t, round(avg(CASE WHEN w >= peak / 2 THEN 1.0 ELSE 0.0 END), 6) AS half_share FROM m GROUP BY 1")
def feature_release_profile(spark, d):
    return P.release_profile(_rate(spark, d), ["session_id"], "t", "w").select("session_id", F.round("peak", 6).alias("peak"), "peak_t", F.round("half_share", 6).alias("half_share"))


@query("SELECT l_orderkey, l_linenumber, round(2.5 + 0.5 * l_quantity - 3.0 * l_discount, 6) AS proxy FROM lineitem")
def feature_linear_proxy(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.linear_proxy(["l_quantity", "l_discount"], [0.5, -3.0], 2.5), 6).alias("proxy"))


@query(f"WITH {_M}, v AS (SELECT swing_id, name, max(CAST(round(value * 1000) AS BIGINT)) AS v FROM m WHERE {_FIN} AND abs(value) < 1e12 GROUP BY 1, 2) SELECT swing_id, string_agg(name || '=' || v, ';' ORDER BY name) AS features FROM v GROUP BY 1")
def feature_export(spark, d):
    """The finite metrics of a swing as one text of names and thousandths, in order of name."""
    m = _metrics(spark, d).where("value is not null and not isnan(value) and abs(value) < 1e12")
    v = m.groupBy("swing_id", "name").agg(F.max(F.round(F.col("value") * 1000).cast("long")).alias("v"))
    g = v.groupBy("swing_id").agg(F.array_sort(F.collect_list(F.struct("name", "v"))).alias("f"))
    return g.select("swing_id", F.array_join(F.transform("f", lambda x: F.concat(x["name"], F.lit("="), x["v"].cast("string"))), ";").alias("features"))


@query("SELECT session_id, CAST(count(*) AS BIGINT) AS n FROM captures WHERE session_id IS NOT NULL GROUP BY 1")
def session_metrics_log(spark, d):
    """Metrics of sessions, written as a JSON file each and read again."""
    at = f"{Workspace(spark).base}/sessions"
    g = table(spark, d, "captures").where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"))
    g.withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(16))).write.partitionBy("part").json(at)
    return spark.read.schema("session_id string, n long").json(at).select("session_id", "n")
