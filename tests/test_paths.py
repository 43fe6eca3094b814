from lodestrata.operators.graph import PropertyGraph


def test_least_of_the_shortest_paths(spark):
    n = spark.createDataFrame([(x, "class") for x in "abcdefgz"], "id string, label string")
    e = [("a", "c"), ("a", "b"), ("b", "e"), ("c", "d"), ("b", "d"), ("e", "f"), ("d", "f"), ("f", "a"), ("a", "gone"), ("gone", "z"), ("g", "g")]
    g = PropertyGraph(n, spark.createDataFrame([(*x, "calls") for x in e], "src string, dst string, rel string"))
    ids = lambda s: spark.createDataFrame([(x,) for x in s], "id string")
    got = lambda *a: {(r["start"], r["end"]): (r["length"], "".join(r["path"])) for r in g.shortest_paths(*a).collect()}
    assert got(ids("acgx"), ids("afgz"), 9, "out") == {("a", "a"): (0, "a"), ("a", "f"): (3, "abdf"), ("c", "a"): (3, "cdfa"), ("c", "f"): (2, "cdf"), ("g", "g"): (0, "g")}
    assert got(ids("a"), ids("f"), 2, "out") == {}
    assert got(ids("a"), ids("df"), 9, "both") == {("a", "d"): (2, "abd"), ("a", "f"): (1, "af")}
