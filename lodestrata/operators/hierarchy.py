"""Parent-child links to full hierarchies, as nested sets.

Both directions take the logarithm of the height in rounds. Upward, a node hands the size gathered so far to the
ancestor twice as far away each round, which adds up to the sizes of the subtrees; sibling ranges are prefix sums of
those sizes; downward, each node adds up the offsets on its way from the root, likewise over doubled distances, and
so has its preorder number, depth and root. What no root reaches is on a cycle or below one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import Workspace

SALTS = 64


def parent_links(rows: DataFrame, group: str = "hierarchy", node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """One row per node, (hierarchy, node_id, parent_id).

    A null node is left out. A null or empty parent, or one that is no node, makes a root. Of several
    parents of a node the least is kept, so repeated rows and conflicting ones give one result.
    """
    d = rows.select(F.col(group).alias("hierarchy"), F.col(node).alias("node_id"), F.col(parent).alias("parent_id")).where(F.col("node_id").isNotNull())
    d = d.withColumn("parent_id", F.when(F.col("parent_id") != "", F.col("parent_id")))
    nodes = d.groupBy("hierarchy", "node_id").agg(F.min("parent_id").alias("parent_id"))
    ids = nodes.select("hierarchy", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    return nodes.join(ids, ["hierarchy", "parent_id"], "left").select("hierarchy", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))


def subtree_sizes(links: DataFrame, ws: Workspace) -> DataFrame:
    """(hierarchy, node_id, more): the number of descendants of each node that has any, of links in the form of parent_links().

    Round k holds the nodes that have an ancestor 2**k steps up, that ancestor, and how many nodes lie less than 2**k steps
    below them. Those numbers are added up at the ancestor; nodes on a cycle or below one are given some number.
    """
    key = ["hierarchy", "node_id"]
    open_ = ws.save(links.where("parent_id is not null").select(*key, F.col("parent_id").alias("at"), F.lit(1).cast("long").alias("size")), "up0")
    given, left, k = [], open_.count(), 0
    while left:
        got = ws.save(open_.groupBy("hierarchy", F.col("at").alias("node_id")).agg(F.sum("size").alias("more")), f"given{k}")
        given.append(got)
        above = open_.select("hierarchy", F.col("node_id").alias("at"), F.col("at").alias("at2"))
        moved = open_.join(above, ["hierarchy", "at"]).join(got, key, "left")
        nxt = ws.save(moved.select(*key, F.col("at2").alias("at"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), f"up{k + 1}")
        ws.drop(f"up{k}")
        was, left = left, nxt.count()
        open_, k = nxt, k + 1
        if was == left:  # depths have no holes, so what is left hangs on cycles
            break
    if not given:
        return links.sparkSession.createDataFrame([], "hierarchy string, node_id string, more long")
    total = given[0]
    for g in given[1:]:
        total = total.unionByName(g)
    return total.groupBy(*key).agg(F.sum("more").alias("more"))


def nested_sets(links: DataFrame, with_path: bool = False, ws: Workspace | None = None) -> DataFrame:
    """(hierarchy, node_id, parent_id, root_id, depth, size, pre_lo, pre_hi[, path]) of links in the form of parent_links().

    The descendants of a node are the nodes of its hierarchy and root with pre_lo < pre <= pre_hi (pre is a
    node's own pre_lo). A root has depth 0. A node on a cycle or below one has root_id '', depth -1 and null
    ranges. Empty input gives an empty result. Rounds in either direction: the logarithm of the greatest height; the
    tables of a round are dropped after the next one.
    """
    ws = ws or Workspace(links.sparkSession)
    key = ["hierarchy", "node_id"]
    links = ws.save(links, "links")
    sized = links.join(subtree_sizes(links, ws), key, "left").select(*key, "parent_id", (1 + F.coalesce("more", F.lit(0))).alias("size"))
    # Sibling offsets: a prefix sum of sizes in two steps, so that a parent of very many children is no single task.
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(SALTS)))
    sized = ws.save(sized, "sized")
    kids = sized.where("parent_id is not null")
    per_salt = kids.groupBy("hierarchy", "parent_id", "salt").agg(F.sum("size").alias("block"))
    before = per_salt.select("hierarchy", "parent_id", "salt", (F.sum("block").over(Window.partitionBy("hierarchy", "parent_id").orderBy("salt")) - F.col("block")).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("hierarchy", "parent_id", "salt").orderBy("node_id")) - F.col("size")
    kids = kids.withColumn("inner", inner).join(before, ["hierarchy", "parent_id", "salt"])
    # Downward: at is the ancestor reached so far, off and depth the sums of the steps down from it.
    path = [F.array("node_id").alias("path")] if with_path else []
    known = [ws.save(sized.where("parent_id is null").select(*key, "parent_id", "size", F.col("node_id").alias("at"), F.lit(0).cast("long").alias("off"), F.lit(0).alias("depth"), *path), "known0")]
    open_ = ws.save(kids.select(*key, "parent_id", "size", F.col("parent_id").alias("at"), (1 + F.col("base") + F.col("inner")).alias("off"), F.lit(1).alias("depth"), *path), "down0")
    left, k = open_.count(), 0
    while left:
        more = F.concat("path2", "path").alias("path")
        closed = known[0]
        for d in known[1:]:
            closed = closed.unionByName(d)
        up = closed.withColumn("end", F.lit(True)).unionByName(open_.withColumn("end", F.lit(False)))
        up = up.select("hierarchy", F.col("node_id").alias("at"), F.col("at").alias("at2"), F.col("off").alias("off2"), F.col("depth").alias("depth2"), "end", *([F.col("path").alias("path2")] if with_path else []))
        moved = open_.join(up, ["hierarchy", "at"]).select(*key, "parent_id", "size", F.col("at2").alias("at"), (F.col("off") + F.col("off2")).alias("off"), (F.col("depth") + F.col("depth2")).alias("depth"), "end", *([more] if with_path else []))
        end, open_ = ws.split(moved, f"down{k + 1}", "end")
        ws.drop(f"down{k}/end=false" if k else "down0")
        known.append(end)
        was, left, k = left, open_.count(), k + 1
        if was == left:
            break
    done = known[0]
    for d in known[1:]:
        done = done.unionByName(d)
    out = ["hierarchy", "node_id", "parent_id", F.col("at").alias("root_id"), F.col("depth").cast("int").alias("depth"), "size", F.col("off").alias("pre_lo"), (F.col("off") + F.col("size") - 1).alias("pre_hi"), *([F.array_join("path", "/").alias("path")] if with_path else [])]
    none = F.lit(None).cast("long")
    lost = open_.select("hierarchy", "node_id", "parent_id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), none.alias("size"), none.alias("pre_lo"), none.alias("pre_hi"), *([F.lit(None).cast("string").alias("path")] if with_path else []))
    return done.select(*out).unionByName(lost)


def descendant_pairs(sets: DataFrame, bucket: int = 1024) -> DataFrame:
    """(hierarchy, root_id, node_id, descendant_id): a range join of nested_sets() with itself, over buckets of preorder numbers.

    A range is cut into buckets, so beside the pairs it returns a node meets at most two buckets of others.
    """
    s = sets.where("depth >= 0")
    lo, hi = F.col("pre_lo") + 1, F.col("pre_hi")
    ranges = s.where(hi >= lo).select("hierarchy", "root_id", "node_id", "pre_lo", "pre_hi", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))).alias("bucket"))
    points = s.select("hierarchy", "root_id", F.col("node_id").alias("descendant_id"), F.col("pre_lo").alias("pre"), F.floor(F.col("pre_lo") / bucket).alias("bucket"))
    pairs = ranges.join(points, ["hierarchy", "root_id", "bucket"])
    return pairs.where((F.col("pre") > F.col("pre_lo")) & (F.col("pre") <= F.col("pre_hi"))).select("hierarchy", "root_id", "node_id", "descendant_id")


def code_links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The two hierarchies of a code graph, as parent_links(): 'nesting' of symbols in their file, 'extends' of classes."""
    s = symbols.where("file_path is not null and name is not null")
    nest = s.select(F.lit("nesting").alias("hierarchy"), F.concat_ws(":", "file_path", "name").alias("node_id"), F.when(F.col("parent") != "", F.concat_ws(":", "file_path", "parent")).alias("parent_id"))
    e = edges.where(F.lower(F.trim("edge_type")) == "extends").select("source_id", "target_id")
    up = e.select(F.lit("extends").alias("hierarchy"), F.col("source_id").alias("node_id"), F.col("target_id").alias("parent_id"))
    ends = e.select(F.lit("extends").alias("hierarchy"), F.col("target_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    return parent_links(nest.unionByName(up).unionByName(ends))
