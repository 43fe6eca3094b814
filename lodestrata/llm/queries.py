"""The package's queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import docpairs, leaks, nearest_time, packing, parsing, percentiles, pii
from lodestrata.session import Workspace, table

TOLERANCE = 0.004
PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
SCOPES = (("name_day", ("name", "day")), ("name_subject", ("name", "subject")))
EPS = 0.0025


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    checked = parsing.checked_files(table(spark, d, "files")).where("valid is not null")
    return checked.groupBy("file_path").agg(F.max_by("valid", parsing.last_version()).alias("valid")).where("not valid").select("file_path")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    return parsing.checked_files(table(spark, d, "files")).select("file_path", "parsed_at", "language", "valid", "stage")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return parsing.invalid_rates(files, parsing.checked_files(files))


def _documented(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.function_docs(table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _documented(spark, d).select("file_path", "name").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each documented function with its code, its documentation and what the symbol table has of it: of those that share a name, that of its line."""
    files = parsing.versions(table(spark, d, "files")).where("content is not null").groupBy("file_path").agg(F.max_by("content", parsing.last_version()).alias("content"))
    s = table(spark, d, "symbols").where("node_type <> 'class'").groupBy("file_path", "name").agg(F.collect_set(F.struct("start_line", "node_type", "signature")).alias("symbols"))
    f = _documented(spark, d).withColumn("shared", F.count("*").over(Window.partitionBy("file_path", "name")) > 1)
    p = f.join(files, "file_path").join(s, ["file_path", "name"], "left")
    p = p.withColumn("here", F.expr("filter(symbols, x -> x.start_line = start_line)")).withColumn("here", F.expr("case when shared or size(here) > 0 then here else symbols end"))
    p = p.withColumns({"kind": F.array_max("here.node_type"), "signature": F.array_max("here.signature")})
    code = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n")
    return p.select("file_path", "name", "language", F.coalesce("kind", "node_type", F.lit("function")).alias("node_type"), "signature", code.alias("code"), F.col("doc").alias("documentation"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each metric once: deliveries of a row are exact copies."""
    m = table(spark, d, "metrics").select("swing_id", "name", F.col("subject_pseudonym").alias("subject"), "value", "captured_at")
    return m.distinct().select("name", "subject", F.to_date("captured_at").alias("day"), "value")


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return Workspace(spark).save(percentiles.summarize(_metrics(spark, d), SCOPES, "value", EPS), "summaries")


def _all_scopes(s: DataFrame) -> DataFrame:
    """Summaries by name and day, by name and subject, and by name, the last combined from the days."""
    days = s.where("scope = 'name_day'").select("name", "v", "up", "down", "eps")
    names = percentiles.combine(days, ["name"], EPS).select(F.lit("name").alias("scope"), "name", F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("subject"), "v", "up", "down", "eps")
    return s.unionByName(names)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = percentiles.quantiles(_all_scopes(_summaries(spark, d)), ["scope", "name", "day", "subject"], PROBS)
    ideal = table(spark, d, "ideal_bands").select("name", F.col("p50").alias("ideal_p50"))
    prior = table(spark, d, "metric_priors").groupBy("name", F.col("subject_pseudonym").alias("subject")).agg(F.max("center").alias("prior_center"))
    q = q.join(F.broadcast(ideal), "name", "left").join(prior, ["name", "subject"], "left")
    return q.select("scope", "name", "day", "subject", "p", "n", "value", "eps", F.when(F.col("p") == 0.5, F.col("ideal_p50")).alias("ideal_p50"), F.when((F.col("p") == 0.5) & (F.col("scope") == "name_subject"), F.col("prior_center")).alias("prior_center"))


def p5_error_audit(spark: SparkSession, d: str) -> DataFrame:
    """For every percentile whether the true ranks of its value, counted over all rows, meet the bound."""
    q = percentiles.quantiles(_all_scopes(_summaries(spark, d)), ["scope", "name", "day", "subject"], PROBS)
    per = q.groupBy("scope", "name", "day", "subject").agg(F.collect_list(F.struct("p", "value", "n", "eps")).alias("qs"))
    m = _metrics(spark, d).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    day, subject = F.col("day"), F.col("subject")
    null = F.lit(None)
    each = F.array(F.struct(F.lit("name").alias("scope"), null.cast("date").alias("day"), null.cast("string").alias("subject")), F.struct(F.lit("name_day").alias("scope"), day.alias("day"), null.cast("string").alias("subject")), F.struct(F.lit("name_subject").alias("scope"), null.cast("date").alias("day"), subject.alias("subject")))
    m = m.select("name", "value", F.explode(each).alias("g")).select("name", "value", "g.*").groupBy("scope", "name", "day", "subject", "value").agg(F.count("*").alias("c"))
    on = [m[c].eqNullSafe(per[c]) for c in ("scope", "name", "day", "subject")]
    r = m.join(per, on).select(*(m[c] for c in ("scope", "name", "day", "subject")), m["value"].alias("x"), "c", F.explode("qs").alias("q"))
    r = r.groupBy("scope", "name", "day", "subject", "q").agg(F.sum(F.when(F.col("x") < F.col("q.value"), F.col("c")).otherwise(0)).alias("less"), F.sum(F.when(F.col("x") <= F.col("q.value"), F.col("c")).otherwise(0)).alias("upto"))
    target = F.col("q.p") * (F.col("q.n") - 1) + 1
    off = F.greatest(F.col("less") + 1 - target, target - F.col("upto"), F.lit(0.0))
    return r.select("scope", "name", "day", "subject", "q.p", "q.n", (off <= F.greatest(F.col("q.eps") * F.col("q.n"), F.lit(1.0))).alias("within_bound"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_time.match_nearest(table(spark, d, "motion"), table(spark, d, "accel"), TOLERANCE, names=("motion_i", "accel_i"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return p8_pack(spark, d).where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers keep the rules of packing, a row a rule, over all documents."""
    docs, ws = table(spark, d, "documents"), Workspace(spark)
    counts = ws.save(packing.token_counts(docs, "doc_id", "text", packing.VOCABULARY), "counts")
    return packing.audit(ws.save(packing.pack(docs), "packed"), counts)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    spans = pii.find_personal(table(spark, d, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.kind", F.col("s.start").alias("start_pos"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(table(spark, d, "documents")).select("doc_id", "redacted", F.size("spans").alias("n_found"))


QUERIES = {f.__name__: f for f in (p1_found, p1_files, p1_rates, p3_found, p3_pairs, p5_percentiles, p5_error_audit, p6_found, p8_pack, p8_containers, p8_audit, p9_found, p9_leaks, p10_found, p10_redacted)}

ORACLE = {
    "p5_error_audit": """
WITH m AS (SELECT DISTINCT swing_id, name, subject_pseudonym AS subject, value, captured_at FROM metrics),
ok AS (SELECT name, subject, CAST(captured_at AS DATE) AS day FROM m WHERE value IS NOT NULL AND isfinite(value)),
g AS (SELECT 'name' AS scope, name, CAST(NULL AS DATE) AS day, CAST(NULL AS VARCHAR) AS subject, count(*) AS n FROM ok GROUP BY name
      UNION ALL SELECT 'name_day', name, day, NULL, count(*) FROM ok GROUP BY name, day
      UNION ALL SELECT 'name_subject', name, NULL, subject, count(*) FROM ok GROUP BY name, subject)
SELECT g.*, p, true AS within_bound FROM g, (VALUES (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE)) AS q(p)""",
    "p8_audit": "SELECT unnest(['no container over capacity', 'containers near the bound', 'places follow each other', 'every token once', 'only longer items are cut']) AS rule, true AS holds",
    "p6_found": f"""
WITH a AS (SELECT session_id, t, min(i) AS i FROM accel WHERE session_id IS NOT NULL AND i IS NOT NULL AND isfinite(t) GROUP BY 1, 2),
m AS (SELECT DISTINCT session_id, i, t FROM motion WHERE session_id IS NOT NULL AND isfinite(t)),
lo AS (SELECT m.session_id, m.i AS mi, m.t, a.i AS ai, m.t - a.t AS gap FROM m ASOF JOIN a ON m.session_id = a.session_id AND m.t >= a.t),
hi AS (SELECT m.session_id, m.i AS mi, m.t, a.i AS ai, a.t - m.t AS gap FROM m ASOF JOIN a ON m.session_id = a.session_id AND m.t <= a.t),
c AS (SELECT *, 0 AS side FROM lo UNION ALL SELECT *, 1 FROM hi),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, mi, t ORDER BY gap, side) AS k FROM c WHERE gap <= {TOLERANCE}::DOUBLE)
SELECT session_id, mi AS motion_i, ai AS accel_i FROM r WHERE k = 1""",
}
