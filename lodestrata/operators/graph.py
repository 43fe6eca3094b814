"""A property graph of DataFrames: selection, hops, neighbourhoods, closures and task graphs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.names import module_of
from lodestrata.functions.predicates import where
from lodestrata.session import Workspace


@dataclass(frozen=True)
class Selection:
    """Selected nodes of a graph; each step returns a new selection, a set of nodes."""

    graph: PropertyGraph
    nodes: DataFrame

    def where(self, field: str, op: str, value: Any) -> Selection:
        return Selection(self.graph, self.nodes.where(where(field, op, value)))

    def filter(self, predicate: Column) -> Selection:
        return Selection(self.graph, self.nodes.where(predicate))

    def outgoing(self, rel: str | None = None) -> Selection:
        return self._hop("src", "dst", rel)

    def incoming(self, rel: str | None = None) -> Selection:
        return self._hop("dst", "src", rel)

    def _hop(self, near: str, far: str, rel: str | None) -> Selection:
        """The nodes one edge away; each once, ends that are no nodes left out."""
        edges = self.graph.edges if rel is None else self.graph.edges.where(F.col("rel") == rel)
        ids = edges.join(self.nodes.select(F.col("id").alias(near)), near, "left_semi").select(F.col(far).alias("id")).distinct()
        return Selection(self.graph, self.graph.nodes.join(ids, "id", "left_semi"))

    def collect_properties(self, *fields: str) -> DataFrame:
        """_id, _label and the named fields; a field that nodes do not have is null."""
        have = set(self.nodes.columns)
        return self.nodes.select(F.col("id").alias("_id"), F.col("label").alias("_label"), *(F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields))

    def ids(self) -> DataFrame:
        return self.nodes.select("id")

    def count(self) -> int:
        return self.nodes.count()

    def limit(self, n: int) -> Selection:
        """The first n by id."""
        return Selection(self.graph, self.nodes.orderBy("id").limit(n))


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(id, label, name, ...) and edges(src, dst, rel)."""

    nodes: DataFrame
    edges: DataFrame

    def select(self, label: str | None = None) -> Selection:
        return Selection(self, self.nodes if label is None else self.nodes.where(F.col("label") == label))

    def statistics(self) -> DataFrame:
        """(kind, key, n): nodes by label, edges by relation, and the totals."""
        by_label = self.nodes.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), "key", "n")
        by_rel = self.edges.groupBy(F.col("rel").alias("key")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "key", "n")
        totals = by_label.unionByName(by_rel).groupBy(F.lit("total").alias("kind"), F.col("kind").alias("key")).agg(F.sum("n").alias("n"))
        return by_label.unionByName(by_rel).unionByName(totals.select("kind", "key", "n"))

    def search(self, query: str, fields: Sequence[str]) -> DataFrame:
        """Nodes one of whose fields contains the query in any case."""
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(F.col(f)).contains(query.lower()), F.lit(False))
        return self.nodes.where(hit)

    def dangling(self) -> DataFrame:
        """Edges with an end that is no node."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "rel"))

    def hierarchy(self) -> DataFrame:
        """(id, name, parents, children, methods) of each class, as sorted texts; empty where there are none."""
        ids = self.nodes.select("id", F.col("name").alias("other"), F.col("label").alias("other_label"))
        ext = self.edges.where("rel = 'extends'").select("src", "dst").distinct()
        holds = self.edges.where("rel = 'contains'").select("src", "dst").distinct()
        part = lambda e, near, far: e.join(ids, F.col(far) == F.col("id")).select(F.col(near).alias("id"), "other", "other_label")
        text = lambda d, name: d.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias(name))
        c = self.nodes.where("label = 'class'").select("id", "name")
        c = c.join(text(part(ext, "src", "dst"), "parents"), "id", "left").join(text(part(ext, "dst", "src"), "children"), "id", "left")
        c = c.join(text(part(holds, "src", "dst").where("other_label = 'method'"), "methods"), "id", "left")
        return c.select("id", "name", *(F.coalesce(x, F.lit("")).alias(x) for x in ("parents", "children", "methods")))

    def impact(self, rels: Sequence[str] = ("calls", "extends", "implements"), further: Sequence[str] = ("calls",)) -> DataFrame:
        """(id, affected, kind): 'direct' for sources of an edge of rels into a node, 'indirect' one hop of further away and not direct.

        The result is all pairs; a node that a great part of all edges enter has as many rows, spread by both ends.
        """
        e = self.edges.where(F.col("rel").isin(list(rels))).select("src", "dst").distinct()
        direct = self.nodes.select("id").join(e, F.col("id") == F.col("dst")).select("id", F.col("src").alias("affected")).distinct()
        e2 = self.edges.where(F.col("rel").isin(list(further))).select(F.col("dst").alias("affected"), F.col("src").alias("further")).distinct()
        more = direct.join(e2, "affected").select("id", F.col("further").alias("affected")).distinct()
        more = more.where("id <> affected").join(direct, ["id", "affected"], "left_anti")
        return direct.withColumn("kind", F.lit("direct")).unionByName(more.withColumn("kind", F.lit("indirect")))

    def tree(self, start: DataFrame, depth: int | None, rels: Sequence[str], ws: Workspace | None = None) -> DataFrame:
        """(id, parent, dist): the nodes within depth edges of start(id) along the relations, each once, at its least depth, below the least node that leads to it."""
        d = self.distances(start, depth, "out", rels, ws)
        e = self.steps("out", rels)
        up = d.select(F.col("id").alias("a"), F.col("dist").alias("above"))
        parents = e.join(up, "a").join(d.withColumnRenamed("id", "b"), "b").where("above = dist - 1").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        return d.join(parents, "id", "left").select("id", "parent", "dist")

    def affected(self, start: DataFrame, hops: int = 2) -> DataFrame:
        """(id, dist): nodes that depend on start(id), at most hops edges against their direction."""
        return self.distances(start, hops, "in").where("dist > 0")

    def modules(self, path: str = "file_path") -> DataFrame:
        """(parent, child, depth): the tree of dotted module names of the nodes' files; a child is the longer name, a top one has a null parent."""
        m = self.nodes.select(module_of(F.col(path)).alias("m")).where("m is not null").distinct()
        parts = F.split("m", r"\.")
        x = m.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
        name = lambda n: F.array_join(F.slice("p", F.lit(1), n), ".")
        return x.select(F.when(F.col("depth") > 1, name(F.col("depth") - 1)).alias("parent"), name(F.col("depth")).alias("child"), "depth").distinct()

    def export(self) -> DataFrame:
        """(kind, id, label, src, dst, rel): nodes and edges as one table, the form in which a graph is stored and read again."""
        n = self.nodes.select(F.lit("node").alias("kind"), "id", "label", *(F.lit(None).cast("string").alias(c) for c in ("src", "dst", "rel")))
        e = self.edges.select(F.lit("edge").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("id", "label")), "src", "dst", "rel")
        return n.unionByName(e)

    def dot(self) -> DataFrame:
        """(part, line): the graph as lines of a DOT file, to be written in order of part; quotes in names are escaped."""
        q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        n = self.nodes.select(F.lit(1).alias("part"), F.concat(q("id"), F.lit(" [label="), q("name"), F.lit("];")).alias("line"))
        e = self.edges.select(F.lit(2).alias("part"), F.concat(q("src"), F.lit(" -> "), q("dst"), F.lit(" [label="), q("rel"), F.lit("];")).alias("line"))
        ends = self.nodes.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "part int, line string")
        return ends.unionByName(n).unionByName(e)

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """The graph with nodes replaced by those of the same id, and edges added that it does not have."""
        kept = self.nodes.join(nodes.select("id"), "id", "left_anti")
        new = edges.select("src", "dst", "rel").distinct().join(self.edges, ["src", "dst", "rel"], "left_anti")
        return PropertyGraph(kept.unionByName(nodes, allowMissingColumns=True), self.edges.select("src", "dst", "rel").unionByName(new))

    def steps(self, direction: str, rels: Sequence[str] | None = None) -> DataFrame:
        e = self.edges if rels is None else self.edges.where(F.col("rel").isin(list(rels)))
        out, back = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
        return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()

    def distances(self, start: DataFrame, depth: int | None, direction: str = "both", rels: Sequence[str] | None = None, ws: Workspace | None = None) -> DataFrame:
        """(id, dist): nodes at most depth edges from start(id), all that can be reached where depth is None; breadth first, each round joins the new frontier only.

        The true neighbourhood: a node counts with its least distance. A start that is no node is left out, as are ends that are none.
        """
        ws = ws or Workspace(self.nodes.sparkSession)
        nodes = self.nodes.select("id").distinct()
        steps = self.steps(direction, rels)
        seen = frontier = ws.save(nodes.join(start.select("id").distinct(), "id", "left_semi").withColumn("dist", F.lit(0)), "d0")
        for k in count(1) if depth is None else range(1, depth + 1):
            nxt = frontier.join(steps, frontier["id"] == steps["a"]).select(F.col("b").alias("id")).distinct()
            nxt = nxt.join(seen.select("id"), "id", "left_anti").join(nodes, "id", "left_semi").withColumn("dist", F.lit(k))
            frontier = ws.save(nxt, f"d{k}")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen

    def shortest_paths(self, start: DataFrame, end: DataFrame, depth: int, direction: str = "out", rels: Sequence[str] | None = None, ws: Workspace | None = None) -> DataFrame:
        """(start, end, length, path): for each start(id) and each end(id) within depth edges the shortest path, as node ids from start to end.

        Breadth first from every start by itself; of paths equally short the lexicographically least. It is found along
        the way, as its beginning is the least path to the node before. Starts and ends that are no nodes are left out.
        """
        ws = ws or Workspace(self.nodes.sparkSession)
        nodes = self.nodes.select("id").distinct()
        steps = self.steps(direction, rels).join(nodes.withColumnRenamed("id", "b"), "b", "left_semi")
        first = nodes.join(start.select("id").distinct(), "id", "left_semi")
        seen = frontier = ws.save(first.select(F.col("id").alias("start"), "id", F.lit(0).alias("length"), F.array("id").alias("path")), "s0")
        for k in range(1, depth + 1):
            nxt = frontier.join(steps, frontier["id"] == steps["a"]).select("start", F.col("b").alias("id"), "path")
            nxt = nxt.join(seen.select("start", "id"), ["start", "id"], "left_anti").groupBy("start", "id").agg(F.min("path").alias("path"))
            frontier = ws.save(nxt.select("start", "id", F.lit(k).alias("length"), F.concat("path", F.array("id")).alias("path")), f"s{k}")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen.join(end.select("id").distinct(), "id", "left_semi").select("start", F.col("id").alias("end"), "length", "path")

    def closure(self, rels: Sequence[str], ws: Workspace | None = None) -> DataFrame:
        """(src, dst): every pair joined by a path of the relations, by doubling; cycles end it as nothing new appears."""
        ws = ws or Workspace(self.nodes.sparkSession)
        e = self.edges.where(F.col("rel").isin(list(rels))).select("src", "dst").distinct()
        all_ = new = ws.save(e, "c0")
        k = 0
        while True:
            k += 1
            two = new.select("src", F.col("dst").alias("mid")).join(all_.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
            two = two.unionByName(all_.select("src", F.col("dst").alias("mid")).join(new.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")).distinct()
            new = ws.save(two.join(all_, ["src", "dst"], "left_anti"), f"c{k}")
            if new.isEmpty():
                return all_
            all_ = all_.unionByName(new)


def save_json(graph: PropertyGraph, path: str) -> None:
    graph.export().write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> PropertyGraph:
    d = spark.read.schema("kind string, id string, label string, src string, dst string, rel string").json(path)
    return PropertyGraph(d.where("kind = 'node'").select("id", "label", F.col("id").alias("name")), d.where("kind = 'edge'").select("src", "dst", "rel"))


def code_graph(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> PropertyGraph:
    """Modules and their symbols; relations in lower case, repeated edges once."""
    s = symbols.where("file_path is not null and name is not null").groupBy("file_path", "name").agg(F.min("node_type").alias("label"), F.min("start_line").alias("start_line"), F.min("end_line").alias("end_line"), F.min("docstring").alias("docstring"))
    n = s.select(F.concat_ws(":", "file_path", "name").alias("id"), "label", "name", "file_path", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "docstring")
    m = files.where("file_path is not null").select("file_path").distinct().select(F.col("file_path").alias("id"), F.lit("module").alias("label"), F.col("file_path").alias("name"), "file_path", F.lit(None).cast("int").alias("lines"), F.lit(None).cast("string").alias("docstring"))
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lower(F.trim("edge_type")).alias("rel")).distinct()
    return PropertyGraph(n.unionByName(m), e)


# ---------------------------------------------------------------- task graphs


@dataclass(frozen=True)
class TaskGraph:
    """tasks(id, status, priority, tokens) and deps(task_id, depends_on)."""

    tasks: DataFrame
    deps: DataFrame

    def _known(self) -> DataFrame:
        return self.deps.join(self.tasks.select(F.col("id").alias("depends_on")), "depends_on", "left_semi").select("task_id", "depends_on").distinct()

    def unknown(self) -> DataFrame:
        """Dependencies on tasks that do not exist; they are reported, not taken for a cycle."""
        return self.deps.join(self.tasks.select(F.col("id").alias("depends_on")), "depends_on", "left_anti").select("task_id", "depends_on")

    def levels(self) -> DataFrame:
        """(id, level): one more than the highest level of a task's dependencies; -1 for tasks on or behind a cycle."""
        ws = Workspace(self.tasks.sparkSession)
        deps = self._known()
        open_ = ws.save(self.tasks.select("id"), "open")
        done, k = None, 0
        while True:
            waiting = deps.join(open_.select(F.col("id").alias("depends_on")), "depends_on", "left_semi").select(F.col("task_id").alias("id")).distinct()
            ready = ws.save(open_.join(waiting, "id", "left_anti").withColumn("level", F.lit(k)), f"l{k}")
            done = ready if done is None else done.unionByName(ready)
            if ready.isEmpty():
                return done.unionByName(open_.withColumn("level", F.lit(-1)))
            open_ = ws.save(open_.join(ready, "id", "left_anti"), f"o{k}")
            k += 1

    def ready(self) -> DataFrame:
        """Pending tasks all of whose dependencies exist and are completed, the highest priority first."""
        fine = self.tasks.where("status = 'completed'").select(F.col("id").alias("depends_on"))
        held = self.deps.join(fine, "depends_on", "left_anti").select(F.col("task_id").alias("id")).distinct()
        return self.tasks.where("status = 'pending'").join(held, "id", "left_anti").select("id", "priority").orderBy(F.desc("priority"), "id")

    def blocked(self) -> DataFrame:
        """Tasks that depend, however far, on a failed one and are not finished themselves."""
        g = PropertyGraph(self.tasks.select("id"), self.deps.select(F.col("depends_on").alias("src"), F.col("task_id").alias("dst"), F.lit("before").alias("rel")))
        failed = self.tasks.where("status = 'failed'").select("id")
        reached = g.distances(failed, depth=None, direction="out").where("dist > 0").select("id")
        return self.tasks.join(reached, "id", "left_semi").where("status not in ('completed', 'failed')").select("id")

    def critical_path(self) -> DataFrame:
        """(id, cost, path): the greatest sum of tokens (at least 1 each) of tasks before each one along one chain, and that chain to the task; the least one of several."""
        ws = Workspace(self.tasks.sparkSession)
        deps, lv = self._known(), self.levels()
        t = ws.save(self.tasks.join(lv, "id").select("id", F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(1).cast("long").alias("w"), "level"), "t")
        top = t.agg(F.max("level")).first()[0] or 0
        done = t.where("level = 0").select("id", "w", F.lit(0).cast("long").alias("cost"), F.array("id").alias("path"))
        for k in range(1, top + 1):
            d = deps.join(t.where(F.col("level") == k).select(F.col("id").alias("task_id"), F.col("w").alias("own")), "task_id")
            best = F.min_by(F.struct("through", "path"), F.struct(-F.col("through"), "path"))
            nxt = d.join(done.select(F.col("id").alias("depends_on"), (F.col("cost") + F.col("w")).alias("through"), "path"), "depends_on").groupBy(F.col("task_id").alias("id"), F.col("own").alias("w")).agg(best.alias("b"))
            nxt = ws.save(nxt.select("id", "w", F.col("b.through").alias("cost"), F.concat("b.path", F.array("id")).alias("path")), f"p{k}")
            done = done.unionByName(nxt)
        return done.select("id", "cost", "path")

    def validate(self) -> DataFrame:
        """(rule, task_id): unknown dependencies, dependencies on oneself and tasks on or behind a cycle."""
        unknown = self.unknown().select(F.lit("unknown dependency").alias("rule"), "task_id")
        own = self.deps.where("task_id = depends_on").select(F.lit("depends on itself").alias("rule"), "task_id")
        return unknown.unionByName(own).unionByName(self.levels().where("level < 0").select(F.lit("cycle").alias("rule"), F.col("id").alias("task_id"))).distinct()

    def complete(self, ids: DataFrame) -> TaskGraph:
        """The graph with the tasks of ids(id) completed."""
        return self._marked(ids, "completed")

    def fail(self, ids: DataFrame) -> TaskGraph:
        """The graph with the tasks of ids(id) failed and all that wait for them blocked."""
        g = self._marked(ids, "failed")
        return g._marked(g.blocked(), "blocked")

    def _marked(self, ids: DataFrame, status: str) -> TaskGraph:
        t = self.tasks.join(ids.select("id", F.lit(True).alias("__m")).distinct(), "id", "left")
        return TaskGraph(t.withColumn("status", F.when(F.col("__m"), status).otherwise(F.col("status"))).drop("__m"), self.deps)

    def without(self, ids: DataFrame) -> TaskGraph:
        """The graph without the tasks of ids(id) and their dependencies."""
        gone = ids.select("id").distinct()
        deps = self.deps.join(gone.withColumnRenamed("id", "task_id"), "task_id", "left_anti").join(gone.withColumnRenamed("id", "depends_on"), "depends_on", "left_anti")
        return TaskGraph(self.tasks.join(gone, "id", "left_anti"), deps.select("task_id", "depends_on"))
