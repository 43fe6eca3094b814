"""Queries p2, p4 and p7: hierarchies, implausible readings and regular grids over the capture and code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import grid, hierarchy, spikes
from lodestrata.session import Workspace, table

WIDTHS, OTHER_WIDTH = {"highrate": 0.05}, 0.25
STREAM = ["stream", "session_id"]
#: Full scale in g and rad/s beyond which no wrist sensor reads.
ACCEL_LIMIT, GYRO_LIMIT = 40.0, 70.0


def _sets(spark: SparkSession, d: str, with_path: bool = False) -> DataFrame:
    return hierarchy.nested_sets(hierarchy.code_links(table(spark, d, "symbols"), table(spark, d, "graph_edges")), with_path)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).select("hierarchy", "node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its path from the root and the number of its descendants; null for nodes without root."""
    return _sets(spark, d, with_path=True).select("hierarchy", "node_id", "path", (F.col("size") - 1).alias("n_descendants"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    sets = Workspace(spark).save(_sets(spark, d), "sets")
    return hierarchy.descendant_pairs(sets).select("hierarchy", "node_id", "descendant_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    a = spikes.implausible(table(spark, d, "accel"), ["x", "y", "z"], ACCEL_LIMIT, clock=True)
    m = spikes.implausible(table(spark, d, "motion"), ["gyro_x", "gyro_y", "gyro_z"], GYRO_LIMIT, clock=False)
    return a.select(F.lit("accel").alias("stream"), "session_id", F.col("i").cast("int").alias("i"), "reasons").unionByName(m.select(F.lit("motion").alias("stream"), "session_id", F.col("i").cast("int").alias("i"), "reasons"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_reasons(spark, d).select("stream", "session_id", "i")


def _slots(spark: SparkSession, d: str, values: bool) -> DataFrame:
    names = ["x", "y", "z"] if values else []
    accel = table(spark, d, "accel").select(F.lit("accel").alias("stream"), "session_id", "t", *names)
    motion = table(spark, d, "motion").select(F.lit("motion").alias("stream"), "session_id", "t", *(F.col(f"gyro_{n}").alias(n) for n in names))
    rows = accel.unionByName(motion).where("session_id is not null")
    return grid.occupied_slots(rows, STREAM, grid.latest_mode(table(spark, d, "captures")), WIDTHS, OTHER_WIDTH, values=names)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.missing_slots(_slots(spark, d, False), STREAM)


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid: means of accel axes or angular rates by slot, gaps of up to four slots interpolated, longer ones marked."""
    return grid.regular_grid(_slots(spark, d, True), STREAM, ["x", "y", "z"])


def p7_grid_states(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with its states and the mean of one axis, in steps of an odd width, on whose edges no mean falls."""
    return p7_grid(spark, d).select(*STREAM, "slot", "n", "state", F.floor(F.col("x") * 313.7).alias("step"))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p4_found, p4_reasons, p7_found, p7_grid, p7_grid_states)}

_LINKS = """
nest AS (SELECT 'nesting' AS hierarchy, file_path || ':' || name AS node_id, min(file_path || ':' || nullif(parent, '')) AS p
         FROM symbols WHERE file_path IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT source_id, target_id FROM graph_edges WHERE lower(trim(edge_type)) = 'extends'),
ext AS (SELECT 'extends' AS hierarchy, node_id, min(p) AS p FROM (
          SELECT source_id AS node_id, nullif(target_id, '') AS p FROM ends UNION ALL SELECT target_id, NULL FROM ends)
        WHERE node_id IS NOT NULL GROUP BY 1, 2),
raw AS (SELECT * FROM nest UNION ALL SELECT * FROM ext),
links AS (SELECT r.hierarchy, r.node_id, q.node_id AS p FROM raw r LEFT JOIN raw q ON r.hierarchy = q.hierarchy AND r.p = q.node_id),
tree AS (SELECT hierarchy, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM links WHERE p IS NULL
         UNION ALL
         SELECT l.hierarchy, l.node_id, t.root_id, t.depth + 1, t.path || '/' || l.node_id FROM links l JOIN tree t ON l.hierarchy = t.hierarchy AND l.p = t.node_id)"""
_PAIRS = """,
up AS (SELECT l.hierarchy, l.p AS node_id, l.node_id AS descendant_id FROM links l JOIN tree t USING (hierarchy, node_id) WHERE l.p IS NOT NULL
       UNION ALL
       SELECT u.hierarchy, l.p, u.descendant_id FROM up u JOIN links l ON l.hierarchy = u.hierarchy AND l.node_id = u.node_id WHERE l.p IS NOT NULL)"""
_SLOTS = """
modes AS (SELECT session_id, arg_max(lower(regexp_replace(capture_mode, '[\\s_-]+', '', 'g')), received_at) AS mode
          FROM captures WHERE session_id IS NOT NULL AND capture_mode IS NOT NULL GROUP BY 1),
readings AS (SELECT 'accel' AS stream, session_id, t, x, y, z FROM accel UNION ALL SELECT 'motion', session_id, t, gyro_x, gyro_y, gyro_z FROM motion),
timed AS (SELECT r.*, CASE WHEN mode = 'highrate' THEN 0.05::DOUBLE ELSE 0.25::DOUBLE END AS width
          FROM readings r LEFT JOIN modes USING (session_id) WHERE r.session_id IS NOT NULL AND isfinite(t)),
slots AS (SELECT stream, session_id, CAST(floor(t / width) AS BIGINT) AS slot FROM timed GROUP BY 1, 2, 3),
nexts AS (SELECT *, lead(slot) OVER (PARTITION BY stream, session_id ORDER BY slot) AS nxt FROM slots)"""
ORACLE = {
    "p2_found": f"WITH RECURSIVE {_LINKS} SELECT l.hierarchy, l.node_id, coalesce(t.root_id, '') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth FROM links l LEFT JOIN tree t USING (hierarchy, node_id)",
    "p2_paths": f"WITH RECURSIVE {_LINKS}{_PAIRS}, n AS (SELECT hierarchy, node_id, count(*) AS c FROM up GROUP BY 1, 2) SELECT l.hierarchy, l.node_id, t.path, CASE WHEN t.path IS NOT NULL THEN CAST(coalesce(n.c, 0) AS BIGINT) END AS n_descendants FROM links l LEFT JOIN tree t USING (hierarchy, node_id) LEFT JOIN n USING (hierarchy, node_id)",
    "p2_descendants": f"WITH RECURSIVE {_LINKS}{_PAIRS} SELECT * FROM up",
    "p7_found": f"WITH {_SLOTS} SELECT stream, session_id, unnest(generate_series(slot + 1, nxt - 1)) AS slot FROM nexts WHERE nxt > slot + 1",
    "p7_grid_states": f"""WITH {_SLOTS}, g AS (SELECT stream, session_id, CAST(floor(t / width) AS BIGINT) AS slot, count(*) AS n, avg(CAST(x AS DOUBLE)) FILTER (isfinite(x)) AS x FROM timed GROUP BY 1, 2, 3),
nx AS (SELECT *, lead(slot) OVER w AS nxt, lead(x) OVER w AS x2 FROM g WINDOW w AS (PARTITION BY stream, session_id ORDER BY slot)), e AS (SELECT *, unnest(generate_series(slot + 1, nxt - 1)) AS at_ FROM nx WHERE nxt > slot + 1)
SELECT stream, session_id, slot, n, 'observed' AS state, CAST(floor(x * 313.7) AS BIGINT) AS step FROM g
UNION ALL SELECT stream, session_id, at_, 0, CASE WHEN nxt - slot - 1 <= 4 THEN 'interpolated' ELSE 'missing' END, CASE WHEN nxt - slot - 1 <= 4 THEN CAST(floor((x + (at_ - slot) / (nxt - slot) * (x2 - x)) * 313.7) AS BIGINT) END FROM e""",
}
