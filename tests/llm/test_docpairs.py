import datetime as dt

import pytest

from lodestrata.llm import docpairs as D

PY = '''# head
def a(tol):
    """Keeps the best rows."""
    async def inner(x): 'Never shrinks the window.'
class K:
    """Not a function."""
    def plain(self): pass
    @deco
    def m(self,
          q: int = (1, 2)) -> int:
        r"""TODO: write documentation for this."""
        return 1
    def merge_rows(self, tol):
        """Merge rows.

        Args:
            tol:
        """
'''
JS = """// file header

/** Returns the nearest frame to the top. */
export async function nearest(a) { return if_(a) }
// not attached

function bare() {}
/**
 * TODO
 */
const later = (x) => { foo(x) };
// Cheap; safe to call twice.
const twice = async (a, b) => {
  // Splits at midnight.
  function split(x) {}
};
class A {
  // Sums every second value.
  @dec()
  static async total(x) { if (x) { return `a ${x} {` } }
  /* Half-open. */ other() {}
  // Folds in place.
  fold(a, b) { return a }
}
"""
TS = "/** Parses the header line. */\nfunction head<T>(a: T): Promise<T[]> { return a }\nclass B {\n  /** Tells apart the two clocks. */\n  private m(a: number): number { return a ? head(a) : 1 }\n}\n// Rounds to even.\nconst r = (a: number): number => a\n"
GO = "package a\n\n// Opens the journal read-only.\nfunc (s *T[K]) Open(p string) (int, error) { return 0, nil }\n\n// open open.\nfunc open() {}\n\n// Ties go to the older one.\n// limit:\nfunc Max(limit int) {}\n"
JAVA = "class A {\n  /**\n   * Drops rows without a clock.\n   * @param x the rows\n   */\n  @Override\n  @X(1)\n  public List<String> drop(int x) throws E { return new Foo(x) {}; }\n  // Unchecked.\n  int b(int y);\n  /** Builds it. */\n  public A(int x) { }\n}\n"


def pairs(spark, files):
    t = dt.datetime(2026, 1, 1)
    f = spark.createDataFrame([(p, c, t, "clash", "x") for p, c in files], "file_path string, content string, parsed_at timestamp, name string, kind string")
    return {(r["file_path"], r["name"]): r for r in D.function_docs(f).collect()}


def test_all_languages(spark):
    got = pairs(spark, [("a.py", PY), ("a.js", JS), ("a.ts", TS), ("a.go", GO), ("A.java", JAVA), ("bad.py", "def f(:\n"), ("crlf.go", GO.replace("\n", "\r\n")), ("e.ts", ""), ("n.py", None)])
    assert set(got) == {("a.py", "a"), ("a.py", "inner"), ("a.js", "nearest"), ("a.js", "twice"), ("a.js", "split"), ("a.js", "total"), ("a.js", "fold"), ("a.ts", "head"), ("a.ts", "m"), ("a.ts", "r"), ("a.go", "Open"), ("a.go", "Max"), ("crlf.go", "Open"), ("crlf.go", "Max"), ("A.java", "drop"), ("A.java", "b")}
    assert got["A.java", "drop"]["doc"].startswith("Drops rows without a clock.") and got["a.py", "a"]["end_line"] >= 4
    assert got["a.js", "total"]["node_type"] == "method" and got["a.js", "twice"]["end_line"] - got["a.js", "twice"]["start_line"] == 3


def test_empty(spark):
    assert pairs(spark, []) == {}


@pytest.mark.parametrize(
    ("doc", "says"),
    [("TODO", False), ("N/A", False), ("...", False), ("----------", False), ("", False), ("This is the function pick strap, which will pick strap.", False), ("Picks the strap.", False), ("FIXME add a proper description here before the next review", False), ("Documentation to be added later by whoever touches this code", False), ("Auto-generated by the tool on 2026-01-01.\nDo not edit this by hand.", False), ("Args:\n  tol: \n  limit:", False), ("noqa: C901", False), ("Never shrinks the queue.", True), ("Not thread-safe.", True), ("TODO once it settles: keeps only the newest row.", True), ("Empty input gives zero.", True), ("In g, not in metres.", True), ("Args:\n  tol: seconds between rows", True)],
)
def test_informative(doc, says):
    assert D.informative(repr(doc), "python", "pick_strap", "tol limit") is says


FORMS = """
// Halves the window.
const a = x => x / 2
// Waits for the strap.
const b = async x => await x
// Reads the header twice.
const c = async function (p) { return p }
// Yields every third row.
const d = function* (p) { yield p }
class K {
  // Counts the idle turns.
  count = 0
  // Folds both halves.
  foo() { return 1 }
  // Maps over the open ones.
  map<U>(f) { return f }
}
"""
TYPED = """
// Serves the newest request.
const f: Handler<Map<string, number>> = (x) => x
// Splits on blank lines.
export const g: (a: string) => void = async (a) => { h(a) }
class K {
  private n = 0
  // Sorts by clock.
  sort<T extends Array<number>>(a: T): { x: T } { return { x: a } }
  // Drops stale entries.
  drop = (a: number): void => { this.n = a }
}
"""


def test_forms_of_binding(spark):
    got = pairs(spark, [("a.js", FORMS.replace("function* (p)", "function* (p)").replace("map<U>(f)", "map(f)")), ("b.ts", TYPED)])
    assert {n for p, n in got if p == "a.js"} == {"a", "b", "c", "d", "foo", "map"}
    assert {n for p, n in got if p == "b.ts"} == {"f", "g", "sort", "drop"}
    assert got["b.ts", "sort"]["end_line"] == got["b.ts", "sort"]["start_line"]


def test_two_hundred_and_one_parameters_and_type_parameters(spark):
    names = [f"alpha{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(201)]
    js = f"/** {names[-1]} and {names[150]}. */\nfunction wide({', '.join(names)}) {{ }}\n"
    ts = f"/** Chains them in order. */\nfunction many<{', '.join(n.upper() for n in names)}>(x: number) {{ }}\n"
    assert set(pairs(spark, [("w.js", js), ("w.ts", ts)])) == {("w.ts", "many")}


def test_last_version_counts_and_extents(spark):
    old, new = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    py = "class A:\n    def m(self):\n        '''Keeps the rest.'''\n        if x:\n            y = 1\n\nclass B:\n    z = 1\n\ndef tail(): 'Ends the stream.'\n"
    rows = [("v.py", py, new), ("v.py", py, new), ("v.py", "def gone():\n    'Was here once.'\n", old), ("w.py", "def was():\n    'Held the lock.'\n", old), ("w.py", "def was(:\n", new)]
    f = spark.createDataFrame(rows, "file_path string, content string, parsed_at timestamp")
    got = {r["name"]: (r["start_line"], r["end_line"]) for r in D.function_docs(f).collect()}
    assert got == {"m": (2, 6), "tail": (10, 10)}


def test_annotations_over_lines(spark):
    java = "class A {\n  /** Tells both apart. */\n  @X(\n    a = 1,\n    b = 2\n  )\n  @Override\n  public Map<String, List<U>> tell(int a) { return null; }\n  int x = a > foo(b);\n}\n"
    assert set(pairs(spark, [("A.java", java)])) == {("A.java", "tell")}


def found(spark, rows):
    """(file, name, start, end, documentation) of every function, sorted."""
    t = dt.datetime(2026, 1, 1)
    f = spark.createDataFrame([(p, c, a[0] if a else t) for p, c, *a in rows], "file_path string, content string, parsed_at timestamp")
    return sorted((r["file_path"], r["name"], r["start_line"], r["end_line"], r["doc"]) for r in D.function_docs(f).collect())


def test_functions_that_share_a_name(spark):
    py = "class A:\n    def run(self):\n        'TODO'\nclass B:\n    def run(self):\n        'Keeps the newest row only.'\nclass C:\n    def run(self):\n        'Drops stale rows first.'\n"
    java = "class A {\n  /** Reads. */\n  int read() { return 1; }\n  /** Waits for straps. */\n  int read(int a) { return 1; }\n}\n"
    ts = "abstract class A {\n  // Tells the clocks apart.\n  a(x: number): void\n  // Splits at midnight.\n  a(x: string): void\n  a(x: any): void { }\n  /** Folds both halves. */\n  abstract foo(a: number): void\n  /** Skips every third. */\n  bar(b: string): string { return b }\n}\n"
    assert found(spark, [("a.py", py), ("a.py", py), ("A.java", java), ("a.ts", ts)]) == [
        ("A.java", "read", 5, 5, "Waits for straps."),
        ("a.py", "run", 5, 6, "Keeps the newest row only."),
        ("a.py", "run", 8, 9, "Drops stale rows first."),
        ("a.ts", "a", 3, 3, "Tells the clocks apart."),
        ("a.ts", "a", 5, 5, "Splits at midnight."),
        ("a.ts", "bar", 10, 10, "Skips every third."),
        ("a.ts", "foo", 8, 8, "Folds both halves."),
    ]


def test_versions_without_content_or_of_unknown_validity(spark):
    later, deep = dt.datetime(2026, 1, 2), f"def deep():\n    'Held the lock.'\n    return {'-' * 200_000}1\n"
    py = "def kept():\n    'Held the lock.'\n"
    got = found(spark, [("n.py", py), ("n.py", None, later), ("d.py", deep), ("b.py", "def f(:\n"), ("b.py", deep, later), ("b.py", None, later)])
    assert [x[:2] for x in got] == [("d.py", "deep"), ("n.py", "kept")]


def test_comments_by_declarations_of_several_lines(spark):
    java = "class A {\n  @Override\n  // Drops stale entries.\n  public void below() { }\n  /** Keeps order of ties. */\n  public static Map<String, Integer>\n      spread(int a) { return null; }\n  /* Half-open. */ void other() {}\n  void next() {}\n  @X int y;\n  /** Whole days. */\n  @X(\n    // not this one\n    1)\n  // In UTC.\n  void both() {}\n  @X void one() {}\n  /** Sorts by clock. */\n  void two() {}\n}\n"
    js = "/** Keeps order of ties. */\n// eslint-disable-next-line complexity\nfunction st(a) { }\n/** Not this. */\n// TODO\nfunction no(a) { }\n"
    got = {x[1]: x[4] for x in found(spark, [("A.java", java), ("a.js", js)])}
    assert set(got) == {"below", "spread", "both", "two", "st"} and got["both"].split("\n") == ["Whole days. ", "In UTC."] and got["two"] == "Sorts by clock."


def test_functions_that_are_values(spark):
    js = "const o = {\n  // Halves the window.\n  pa: (x) => x,\n  // Waits for straps.\n  pb: async x => x,\n  // Folds idle turns.\n  pc: function* (x) { yield x },\n  in: {\n    // Sorts by clock.\n    pd: async function (x) {\n      return x\n    },\n  },\n}\n// Maps both ends.\nconst long = (a) =>\n  a.map((b) => b + 1)\n    .filter(Boolean)\nlong(2)\n"
    ts = "type T = {\n  // Not a function.\n  ta: (x: number) => void\n}\ninterface I {\n  // Nor this.\n  tb: (x: number) => void\n}\nconst c: { tc: (x: number) => void } = {\n  // Ends the stream.\n  tc: (x: number): void => { x },\n}\n"
    go = "package a\n\n// Opens read-only.\nvar open = func(p string) int { return 0 }\n\n// Closes in turn.\nvar shut func(int) int = func(a int) int {\n\treturn a\n}\n\nfunc b() {\n\t// Ties go to the older one.\n\tpick := func(a, b int) int { return a }\n\t// Of two.\n\tx, y := 1, func() {}\n\t// Of a call.\n\trun(func() {})\n\t_, _, _ = pick, x, y\n}\n\ntype I interface {\n\t// Waits for straps.\n\tWait(a int) error\n}\n"
    java = "class L {\n  /** Ties go to the older one. */\n  Function<Integer, Integer> pick = x -> x + 1;\n  /** Whole days only. */\n  BiFunction<A, B, C> pair = (a, b) -> {\n    return a;\n  };\n  /** No function. */\n  int n = (a) + foo(b);\n}\n"
    py = "def two(a):\n    ('Held '\n     'the lock.')\n    (a)\ndef none(a):\n    ('Held the lock.', a)\n"
    got = [(n, a, z) for _, n, a, z, _ in found(spark, [("a.js", js), ("b.ts", ts), ("c.go", go), ("d.java", java), ("e.py", py)])]
    assert got == [("long", 16, 18), ("pa", 3, 3), ("pb", 5, 5), ("pc", 7, 7), ("pd", 10, 12), ("tc", 11, 11), ("Wait", 23, 23), ("open", 4, 4), ("pick", 13, 13), ("shut", 7, 9), ("pair", 5, 7), ("pick", 3, 3), ("two", 1, 4)]


def test_pairs_of_functions_that_share_a_name(spark, tmp_path):
    from lodestrata.llm import queries as Q

    java = "class A {\n  /** Reads twice. */\n  int read() { return 1; }\n  /** Waits for straps. */\n  int read(int a) { return 2; }\n}\n"
    spark.createDataFrame([("A.java", java, dt.datetime(2026, 1, 1))], "file_path string, content string, parsed_at timestamp").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([("A.java", "read", "method", 5, "int read(int a)")], "file_path string, name string, node_type string, start_line int, signature string").write.parquet(f"{tmp_path}/symbols.parquet")
    got = sorted((r["code"].strip(), r["signature"], r["documentation"]) for r in Q.p3_pairs(spark, str(tmp_path)).collect())
    assert got == [("int read() { return 1; }", None, "Reads twice."), ("int read(int a) { return 2; }", "int read(int a)", "Waits for straps.")]
    assert [tuple(r) for r in Q.p3_found(spark, str(tmp_path)).collect()] == [("A.java", "read")]
