"""Graph queries over the code graph."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.names import module_of
from lodestrata.operators.graph import PropertyGraph, TaskGraph, code_graph, load_json, save_json
from lodestrata.session import Workspace, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VIEWS = """
sym AS (SELECT file_path, name, min(node_type) AS label, min(start_line) AS s, min(end_line) AS e, min(docstring) AS docstring
        FROM symbols WHERE file_path IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
nodes AS (SELECT file_path || ':' || name AS id, label, name, file_path, e - s + 1 AS lines, docstring FROM sym
          UNION ALL SELECT DISTINCT file_path, 'module', file_path, file_path, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM files WHERE file_path IS NOT NULL),
edges AS (SELECT DISTINCT source_id AS src, target_id AS dst, lower(trim(edge_type)) AS rel FROM graph_edges)"""


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query by its name; sql follows the views of the graph."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}"
        return f

    return put


def graph(spark: SparkSession, d: str) -> PropertyGraph:
    return code_graph(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "graph_edges"))


@query("""SELECT 'label' AS kind, label AS key, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY rel
UNION ALL SELECT 'total', 'label', count(*) FROM nodes UNION ALL SELECT 'total', 'relation', count(*) FROM edges""")
def graph_statistics(spark, d):
    return graph(spark, d).statistics()


_CASES = {
    "eq": ("label", "method", "label IS NOT DISTINCT FROM 'method'"),
    "ne": ("lines", 9, "lines IS DISTINCT FROM 9"),
    "contains": ("docstring", "because", "docstring IS NOT NULL AND docstring <> '' AND contains(docstring, 'because')"),
    "starts_with": ("name", "decode", "name <> '' AND starts_with(name, 'decode')"),
    "ends_with": ("name", "Edge", "name <> '' AND ends_with(name, 'Edge')"),
    "in": ("label", ["class", "function"], "coalesce(label IN ('class', 'function'), false)"),
    "not_in": ("lines", [5, 7, 9], "NOT coalesce(lines IN (5, 7, 9), false)"),
    "gt": ("lines", -1, "lines IS NOT NULL AND lines <> 0 AND lines > -1"),
    "lt": ("lines", 12, "lines IS NOT NULL AND lines <> 0 AND lines < 12"),
}
for _op, (_field, _value, _sql) in _CASES.items():

    def _where(spark, d, op=_op, field=_field, value=_value):
        return graph(spark, d).select().where(field, op, value).ids()

    QUERIES[f"graph_where_{_op}"] = _where
    ORACLE[f"graph_where_{_op}"] = f"WITH {VIEWS} SELECT id FROM nodes WHERE {_sql}"


@query("SELECT id AS _id, label AS _label, name, lines, CAST(NULL AS VARCHAR) AS owner FROM nodes WHERE label = 'class'")
def graph_collect_properties(spark, d):
    return graph(spark, d).select("class").collect_properties("name", "lines", "owner")


@query("SELECT id, name FROM nodes WHERE id IN (SELECT dst FROM edges WHERE rel = 'contains' AND src IN (SELECT id FROM nodes WHERE label = 'module' AND ends_with(id, '.ts')))")
def graph_outgoing(spark, d):
    return graph(spark, d).select("module").where("id", "ends_with", ".ts").outgoing("contains").nodes.select("id", "name")


@query("SELECT id AS _id, label AS _label, name FROM nodes WHERE id IN (SELECT src FROM edges WHERE rel = 'extends' AND dst IN (SELECT id FROM nodes WHERE label = 'class'))")
def graph_incoming(spark, d):
    return graph(spark, d).select("class").incoming("extends").collect_properties("name")


@query("""m AS (SELECT src AS id FROM edges WHERE rel = 'contains' AND dst IN (SELECT id FROM nodes WHERE label = 'class'))
SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE rel = 'imports' AND dst IN (SELECT n.id FROM nodes n JOIN m USING (id)))""")
def graph_two_hop_dependents(spark, d):
    return graph(spark, d).select("class").incoming("contains").incoming("imports").ids()


@query("""x AS (SELECT DISTINCT src, dst, rel FROM edges WHERE rel IN ('extends', 'contains'))
SELECT c.id, c.name, coalesce((SELECT string_agg(n.name, ',' ORDER BY n.name) FROM x JOIN nodes n ON n.id = x.dst WHERE x.rel = 'extends' AND x.src = c.id), '') AS parents,
coalesce((SELECT string_agg(n.name, ',' ORDER BY n.name) FROM x JOIN nodes n ON n.id = x.src WHERE x.rel = 'extends' AND x.dst = c.id), '') AS children,
coalesce((SELECT string_agg(n.name, ',' ORDER BY n.name) FROM x JOIN nodes n ON n.id = x.dst AND n.label = 'method' WHERE x.rel = 'contains' AND x.src = c.id), '') AS methods
FROM nodes c WHERE c.label = 'class'""")
def graph_class_hierarchy(spark, d):
    return graph(spark, d).hierarchy()


_BFS = """walk AS (SELECT id, 0 AS dist FROM nodes WHERE {start}
UNION SELECT n.id, w.dist + 1 FROM walk w JOIN ({steps}) s ON s.a = w.id JOIN nodes n ON n.id = s.b WHERE w.dist < {depth})
SELECT id, CAST(min(dist) AS INTEGER) AS dist FROM walk GROUP BY id"""


@query("""walk AS (SELECT id, 0 AS dist FROM nodes WHERE label = 'function' AND ends_with(file_path, '.go')
UNION SELECT n.id, w.dist + 1 FROM walk w JOIN edges e ON e.src = w.id AND e.rel = 'calls' JOIN nodes n ON n.id = e.dst WHERE w.dist < 3),
d AS (SELECT id, CAST(min(dist) AS INTEGER) AS dist FROM walk GROUP BY id)
SELECT d.id, min(u.id) AS parent, d.dist FROM d LEFT JOIN edges e ON e.dst = d.id AND e.rel = 'calls' LEFT JOIN d u ON u.id = e.src AND u.dist = d.dist - 1 GROUP BY d.id, d.dist""", recursive=True)
def graph_call_tree(spark, d):
    """What the functions of Go files call, three calls deep, each once below the least caller."""
    g = graph(spark, d)
    return g.tree(g.select("function").where("file_path", "ends_with", ".go").ids(), 3, ["calls"])


_DIRECT = """d AS (SELECT DISTINCT n.id, e.src AS affected FROM nodes n JOIN edges e ON e.dst = n.id WHERE e.rel IN ('calls', 'extends', 'implements')),
i AS (SELECT DISTINCT d.id, e.src AS affected FROM d JOIN edges e ON e.dst = d.affected WHERE e.rel = 'calls' AND d.id <> e.src) """


@query(_DIRECT + "SELECT id, affected FROM d")
def graph_impact_direct(spark, d):
    return graph(spark, d).impact().where("kind = 'direct'").drop("kind")


@query(_DIRECT + "SELECT i.id, i.affected FROM i LEFT JOIN d ON d.id = i.id AND d.affected = i.affected WHERE d.id IS NULL")
def graph_impact_indirect(spark, d):
    return graph(spark, d).impact().where("kind = 'indirect'").drop("kind")


@query("""s AS (SELECT id FROM nodes WHERE label = 'class' AND starts_with(name, 'Cold')),
a AS (SELECT DISTINCT n.id FROM s JOIN edges e ON e.dst = s.id JOIN nodes n ON n.id = e.src),
b AS (SELECT DISTINCT n.id FROM a JOIN edges e ON e.dst = a.id JOIN nodes n ON n.id = e.src)
SELECT id, CAST(min(k) AS INTEGER) AS dist FROM (SELECT id, 1 AS k FROM a UNION ALL SELECT id, 2 FROM b) WHERE id NOT IN (SELECT id FROM s) GROUP BY id""")
def graph_affected_components(spark, d):
    g = graph(spark, d)
    return g.affected(g.select("class").where("name", "starts_with", "Cold").ids())


@query(r"""m AS (SELECT DISTINCT string_split(replace(regexp_replace(file_path, '\.[^./]+$', ''), '/', '.'), '.') AS p FROM nodes),
x AS (SELECT p, CAST(unnest(generate_series(1, len(p))) AS INTEGER) AS depth FROM m)
SELECT DISTINCT CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], '.') END AS parent, array_to_string(p[1:depth], '.') AS child, depth FROM x""".replace("\\\\", "\\"))
def graph_module_hierarchy(spark, d):
    return graph(spark, d).modules()


@query("SELECT 'node' AS kind, id, label, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS rel FROM nodes UNION ALL SELECT 'edge', NULL, NULL, src, dst, rel FROM edges")
def graph_export(spark, d):
    return graph(spark, d).export()


@query("""SELECT 0 AS part, 'digraph {' AS line UNION ALL SELECT 3, '}' UNION ALL SELECT 1, '"' || replace(id, '"', '\\"') || '" [label="' || replace(coalesce(name, ''), '"', '\\"') || '"];' FROM nodes
UNION ALL SELECT 2, '"' || replace(coalesce(src, ''), '"', '\\"') || '" -> "' || replace(coalesce(dst, ''), '"', '\\"') || '" [label="' || replace(coalesce(rel, ''), '"', '\\"') || '"];' FROM edges""")
def graph_dot(spark, d):
    return graph(spark, d).dot()


@query("SELECT id, label FROM nodes")
def graph_json_round_trip(spark, d):
    """The nodes of a graph that was written as JSON and read again."""
    at = f"{Workspace(spark).base}/graph"
    save_json(graph(spark, d), at)
    return load_json(spark, at).nodes.select("id", "label")


@query("SELECT src, dst, rel FROM edges WHERE contains(lower(src), 'orient') OR contains(lower(dst), 'orient')")
def edge_substring_search(spark, d):
    hit = F.lower("src").contains("orient") | F.lower("dst").contains("orient")
    return graph(spark, d).edges.where(F.coalesce(hit, F.lit(False)))


@query("SELECT src, dst, rel FROM edges WHERE rel = 'calls' AND src = dst")
def edge_filtered_scan(spark, d):
    return graph(spark, d).edges.where("rel = 'calls' and src = dst")


@query("""c AS (SELECT DISTINCT n.id, n.name, n.file_path FROM nodes n JOIN edges e ON e.src = n.id AND e.rel = 'contains' JOIN nodes m ON m.id = e.dst AND m.label = 'method' AND m.name LIKE 'decode%' WHERE n.label = 'class') SELECT id, name, file_path FROM c""")
def graph_by_method_name(spark, d):
    """Classes by the name of a method they hold."""
    g = graph(spark, d)
    methods = g.select("method").where("name", "starts_with", "decode").ids()
    hit = g.edges.where("rel = 'contains'").join(methods.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return g.select("class").nodes.join(hit, "id", "left_semi").select("id", "name", "file_path")


@query("SELECT DISTINCT n.id, n.name FROM nodes n JOIN edges e ON e.src = n.id AND e.rel = 'extends' JOIN nodes p ON p.id = e.dst AND contains(p.name, 'Edge')")
def graph_by_extends(spark, d):
    """Nodes by the name of what they extend."""
    g = graph(spark, d)
    bases = g.select().where("name", "contains", "Edge").ids()
    hit = g.edges.where("rel = 'extends'").join(bases.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return g.nodes.join(hit, "id", "left_semi").select("id", "name")


_BOTH = "SELECT src AS a, dst AS b FROM edges WHERE rel IN ('extends', 'imports') UNION SELECT dst, src FROM edges WHERE rel IN ('extends', 'imports')"


@query(_BFS.format(start="label = 'class' AND starts_with(name, 'Cold')", steps=_BOTH, depth=2), recursive=True)
def graph_khop_subgraph(spark, d):
    g = graph(spark, d)
    return g.distances(g.select("class").where("name", "starts_with", "Cold").ids(), 2, "both", ["extends", "imports"])


@query(f"""st AS (SELECT DISTINCT s.a, s.b FROM ({_BOTH}) s JOIN nodes n ON n.id = s.b),
pw AS (SELECT DISTINCT id AS start, id, 0 AS len, [id] AS path FROM nodes WHERE label = 'class'
UNION ALL SELECT w.start, st.b, w.len + 1, min(list_append(w.path, st.b)) FROM pw w JOIN st ON st.a = w.id WHERE w.len < 9 GROUP BY w.start, st.b, w.len),
least AS (SELECT start, id, min(len) AS len FROM pw GROUP BY 1, 2)
SELECT start, id AS "end", CAST(len AS INTEGER) AS length, path FROM pw JOIN least USING (start, id, len) WHERE id IN (SELECT id FROM nodes WHERE label = 'class')""", recursive=True)
def graph_shortest_path(spark, d):
    """The least of the shortest paths from each class to each class, at most ten nodes, over inheritance and imports."""
    g = graph(spark, d)
    classes = g.select("class").ids()
    return g.shortest_paths(classes, classes, 9, "both", ["extends", "imports"])


@query("""e AS (SELECT DISTINCT src, dst FROM edges WHERE rel IN ('extends', 'imports')),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) SELECT * FROM c""", recursive=True)
def graph_transitive_closure(spark, d):
    return graph(spark, d).closure(["extends", "imports"])


@query("SELECT id FROM nodes WHERE contains(lower(name), 'orient') OR coalesce(contains(lower(docstring), 'orient'), false)")
def graph_full_text_search(spark, d):
    return graph(spark, d).search("Orient", ["name", "docstring"]).select("id")


@query("SELECT src, dst, rel FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)")
def graph_dangling_edges(spark, d):
    return graph(spark, d).dangling()


ORACLE["graph_edge_first_wins"] = "SELECT id, source_id, target_id, lower(trim(edge_type)) AS rel, properties FROM graph_edges QUALIFY row_number() OVER (PARTITION BY source_id, target_id, lower(trim(edge_type)) ORDER BY id) = 1"


def graph_edge_first_wins(spark, d):
    """Of repeated edges the first one inserted, by id, with its properties."""
    e = table(spark, d, "graph_edges").select("source_id", "target_id", F.lower(F.trim("edge_type")).alias("rel"), "id", "properties")
    return e.groupBy("source_id", "target_id", "rel").agg(F.min("id").alias("id"), F.min_by("properties", "id").alias("properties")).select("id", "source_id", "target_id", "rel", "properties")


QUERIES["graph_edge_first_wins"] = graph_edge_first_wins


@query("""last AS (SELECT name, max(file_path) AS file_path FROM sym GROUP BY name),
t AS (SELECT DISTINCT dst FROM edges)
SELECT t.dst, coalesce(n.id, l.file_path || ':' || l.name, 'external:' || t.dst) AS resolved FROM t LEFT JOIN (SELECT DISTINCT id FROM nodes) n ON n.id = t.dst LEFT JOIN last l ON l.name = t.dst""")
def edge_priority_resolution(spark, d):
    """Targets as node id, else as the name of a symbol (in the last file that has it), else external."""
    g = graph(spark, d)
    t = g.edges.select("dst").distinct()
    ids = g.nodes.select("id").distinct()
    last = g.nodes.where("label <> 'module'").groupBy("name").agg(F.max("file_path").alias("file"))
    t = t.join(ids, F.col("dst") == F.col("id"), "left").join(last, F.col("dst") == F.col("name"), "left")
    return t.select("dst", F.coalesce("id", F.when(F.col("file").isNotNull(), F.concat("file", F.lit(":"), "name")), F.concat(F.lit("external:"), "dst")).alias("resolved"))


ORACLE["longest_prefix_resolution"] = r"""
WITH p AS (SELECT DISTINCT replace(regexp_replace(file_path, '\.[^./]+$', ''), '/', '.') AS module FROM files),
k AS (SELECT module, string_split(module, '.') AS parts FROM p),
x AS (SELECT module, array_to_string(parts[1:i], '.') AS prefix, i FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM k)),
known AS (SELECT prefix FROM x GROUP BY prefix HAVING count(DISTINCT module) >= 3)
SELECT p.module, b.prefix, CAST(coalesce(b.i, 0) AS INTEGER) AS depth FROM p LEFT JOIN (SELECT module, max(i) AS i, arg_max(prefix, i) AS prefix FROM x JOIN known USING (prefix) GROUP BY module) b USING (module)"""


def longest_prefix_resolution(spark, d):
    """Each module's longest dotted prefix that at least three modules share; null and 0 without one."""
    m = table(spark, d, "files").select(module_of(F.col("file_path")).alias("module")).distinct()
    parts = F.split("module", r"\.")
    x = m.withColumn("i", F.explode(F.sequence(F.lit(1), F.size(parts) - 1))).withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("i")), "."))
    known = x.groupBy("prefix").agg(F.countDistinct("module").alias("c")).where("c >= 3").select("prefix")
    best = x.join(known, "prefix").groupBy("module").agg(F.max("i").alias("depth"), F.max_by("prefix", "i").alias("prefix"))
    return m.join(best, "module", "left").select("module", "prefix", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


QUERIES["longest_prefix_resolution"] = longest_prefix_resolution

# task graphs: classes wait for what they extend; status, priority and tokens follow from their ids
def _plan(spark: SparkSession, d: str) -> TaskGraph:
    g = graph(spark, d)
    n = F.length("id")
    t = g.select("class").ids().distinct().select("id", F.when(n % 5 == 0, "failed").when(n % 2 == 0, "completed").otherwise("pending").alias("status"), (n % 10).alias("priority"), (n % 7 * 10).alias("tokens"))
    e = g.edges.where("rel = 'extends'").join(t.select(F.col("id").alias("src")), "src", "left_semi")
    return TaskGraph(t, e.select(F.col("src").alias("task_id"), F.col("dst").alias("depends_on")).distinct())


_T = f"""WITH RECURSIVE {VIEWS}, tasks AS (SELECT DISTINCT id, CASE WHEN length(id) % 5 = 0 THEN 'failed' WHEN length(id) % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, CAST(length(id) % 10 AS INTEGER) AS priority, length(id) % 7 * 10 AS tokens FROM nodes WHERE label = 'class'),
deps AS (SELECT DISTINCT src AS task_id, dst AS depends_on FROM edges WHERE rel = 'extends' AND src IN (SELECT id FROM tasks)), known AS (SELECT * FROM deps WHERE depends_on IN (SELECT id FROM tasks))"""
_CYCLE = ", reach AS (SELECT task_id AS a, depends_on AS b FROM known UNION SELECT r.a, k.depends_on FROM reach r JOIN known k ON k.task_id = r.b), bad AS (SELECT id FROM tasks WHERE id IN (SELECT a FROM reach WHERE a = b OR b IN (SELECT a FROM reach WHERE a = b))), walk AS (SELECT id, 0 AS level FROM tasks WHERE id NOT IN (SELECT id FROM bad) AND id NOT IN (SELECT task_id FROM known) UNION SELECT k.task_id, w.level + 1 FROM walk w JOIN known k ON k.depends_on = w.id WHERE k.task_id NOT IN (SELECT id FROM bad)), levels AS (SELECT t.id, coalesce(max(w.level), -1) AS level FROM tasks t LEFT JOIN walk w USING (id) GROUP BY t.id)"
_PATHS = ", p AS (SELECT id, CAST(0 AS BIGINT) AS cost, [id] AS path FROM levels WHERE level = 0 UNION SELECT k.task_id, p.cost + CASE WHEN t.tokens > 0 THEN t.tokens ELSE 1 END, list_append(p.path, k.task_id) FROM p JOIN known k ON k.depends_on = p.id JOIN tasks t ON t.id = p.id WHERE k.task_id NOT IN (SELECT id FROM bad)) SELECT id, cost, path FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost DESC, path) = 1"
for _name, _f, _sql in (
    ("dag_topo_levels", lambda s, d: _plan(s, d).levels(), _T + _CYCLE + " SELECT id, CAST(level AS INTEGER) AS level FROM levels"),
    ("dag_max_parallelism", lambda s, d: _plan(s, d).levels().where("level >= 0").groupBy("level").agg(F.count("*").alias("width")).agg(F.max("width").alias("max_parallelism")), _T + _CYCLE + " SELECT max(width) AS max_parallelism FROM (SELECT level, count(*) AS width FROM levels WHERE level >= 0 GROUP BY level)"),
    ("dag_ready", lambda s, d: _plan(s, d).ready(), _T + " SELECT id, priority FROM tasks WHERE status = 'pending' AND id NOT IN (SELECT task_id FROM deps WHERE depends_on NOT IN (SELECT id FROM tasks WHERE status = 'completed'))"),
    ("dag_blocked_closure", lambda s, d: _plan(s, d).blocked(), _T + ", r AS (SELECT task_id AS id FROM known WHERE depends_on IN (SELECT id FROM tasks WHERE status = 'failed') UNION SELECT k.task_id FROM r JOIN known k ON k.depends_on = r.id) SELECT DISTINCT id FROM r JOIN tasks USING (id) WHERE status NOT IN ('completed', 'failed')"),
    ("dag_unknown_dependencies", lambda s, d: _plan(s, d).unknown(), _T + " SELECT task_id, depends_on FROM deps WHERE depends_on NOT IN (SELECT id FROM tasks)"),
    ("dag_critical_path", lambda s, d: _plan(s, d).critical_path(), _T + _CYCLE + _PATHS),
    ("dag_validate", lambda s, d: _plan(s, d).validate(), _T + _CYCLE + " SELECT 'unknown dependency' AS rule, task_id FROM deps WHERE depends_on NOT IN (SELECT id FROM tasks) UNION SELECT 'depends on itself', task_id FROM deps WHERE task_id = depends_on UNION SELECT 'cycle', id FROM levels WHERE level < 0"),
):
    QUERIES[_name], ORACLE[_name] = _f, _sql
