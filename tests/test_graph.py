from lodestrata.operators.graph import PropertyGraph, TaskGraph


def graph(spark):
    n = spark.createDataFrame([(x, "class", x.upper()) for x in "abcdef"], "id string, label string, name string")
    e = spark.createDataFrame([("a", "b", "extends"), ("b", "c", "extends"), ("c", "a", "extends"), ("d", "a", "calls"), ("e", "d", "calls"), ("a", "gone", "calls"), ("f", "f", "calls")], "src string, dst string, rel string")
    return PropertyGraph(n, e)


def ids(d, c="id"):
    return sorted(r[c] for r in d.collect())


def test_hops_are_sets_without_dangling_ends(spark):
    g = graph(spark)
    assert ids(g.select("class").where("id", "eq", "a").outgoing().ids()) == ["b"]
    assert ids(g.select().where("id", "eq", "a").incoming().ids()) == ["c", "d"]
    assert ids(g.dangling(), "dst") == ["gone"]
    assert g.select().limit(0).count() == 0


def test_distances_grow_with_depth_and_survive_cycles(spark):
    g = graph(spark)
    start = spark.createDataFrame([("e",), ("absent",)], "id string")
    near = {k: {r["id"]: r["dist"] for r in g.distances(start, k, "out").collect()} for k in (0, 1, 3, 9)}
    assert near[0] == {"e": 0} and near[1] == {"e": 0, "d": 1} and near[9] == {"e": 0, "d": 1, "a": 2, "b": 3, "c": 4}
    assert near[1].items() <= near[3].items()


def test_closure_of_a_cycle(spark):
    got = {(r["src"], r["dst"]) for r in graph(spark).closure(["extends"]).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"}


def test_impact(spark):
    got = {(r["id"], r["affected"], r["kind"]) for r in graph(spark).impact(["calls"]).collect()}
    assert ("a", "d", "direct") in got and ("a", "e", "indirect") in got and ("f", "f", "direct") in got


def test_task_levels_of_a_diamond_and_a_cycle(spark):
    t = spark.createDataFrame([(x, "pending", 1, 2) for x in "abcdxy"], "id string, status string, priority int, tokens int")
    d = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("a", "nobody")], "task_id string, depends_on string")
    g = TaskGraph(t, d)
    assert {r["id"]: r["level"] for r in g.levels().collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": -1, "y": -1}
    assert ids(g.unknown(), "depends_on") == ["nobody"]
    assert {r["id"]: r["cost"] for r in g.critical_path().collect()} == {"a": 0, "b": 2, "c": 2, "d": 4}
    assert g.ready().count() == 0


def test_tree_holds_each_node_once(spark):
    g = graph(spark)
    got = {(r["id"], r["parent"], r["dist"]) for r in g.tree(spark.createDataFrame([("e",)], "id string"), 5, ["calls"]).collect()}
    assert got == {("e", None, 0), ("d", "e", 1), ("a", "d", 2)}
    assert {(r["id"], r["dist"]) for r in g.affected(spark.createDataFrame([("a",)], "id string")).collect()} == {("c", 1), ("d", 1), ("b", 2), ("e", 2)}


def test_upsert_replaces_nodes_and_adds_edges_once(spark):
    g = graph(spark).upsert(spark.createDataFrame([("a", "class", "new"), ("z", "class", "Z")], "id string, label string, name string"), spark.createDataFrame([("a", "b", "extends"), ("z", "a", "calls"), ("z", "a", "calls")], "src string, dst string, rel string"))
    assert {r["id"]: r["name"] for r in g.nodes.collect()}["a"] == "new" and g.nodes.count() == 7 and g.edges.count() == 8


def test_failing_blocks_what_waits_and_completing_readies(spark):
    t = spark.createDataFrame([(f"t{i}", "pending", i, 1) for i in range(40)], "id string, status string, priority int, tokens int")
    g = TaskGraph(t, spark.createDataFrame([(f"t{i}", f"t{i - 1}") for i in range(1, 40)], "task_id string, depends_on string"))
    one = spark.createDataFrame([("t3",)], "id string")
    s = {r["id"]: r["status"] for r in g.fail(one).tasks.collect()}
    assert s["t3"] == "failed" and s["t39"] == "blocked" and s["t2"] == "pending"
    assert ids(g.complete(spark.createDataFrame([("t0",)], "id string")).ready()) == ["t1"]
    assert ids(g.without(one).ready()) == ["t0", "t4"]
    assert g.validate().count() == 0


def test_critical_path_is_the_least_of_the_longest(spark):
    t = spark.createDataFrame([(x, "pending", 1, 2) for x in "abcd"], "id string, status string, priority int, tokens int")
    g = TaskGraph(t, spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "task_id string, depends_on string"))
    assert {r["id"]: "".join(r["path"]) for r in g.critical_path().collect()} == {"a": "a", "b": "ab", "c": "ac", "d": "abd"}
