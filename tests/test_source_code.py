from lodestrata.operators.graph import PropertyGraph
from lodestrata.sources import source_code as S

FILES = {
    "app/core/base.py": "class Base:\n    def run(self): return helper(1)\n\ndef helper(x):\n    return Other(x)\n",
    "app/core/__init__.py": "",
    "app/main.py": "from .core.base import Base, helper\nfrom . import util\nimport os.path\nimport app.core.base.deep\n@wrap\nclass Main(Base):\n    async def go(self):\n        self.run()\n",
    "app/util.py": "def _own(): pass\n",
    "web/a.ts": "import { B, type C } from './lib/b';\nimport x from 'left-pad';\nexport class A extends B implements I, J {\n  m(a: number): void { helper(new Thing(a)); }\n}\nexport const f = (q) => g(q);\nexport { one, two as three };\n",
    "web/lib/b.ts": "export default class B { }\nexport function helper() { }\nconst z = require('../a');\n",
    "go/m.go": "package m\n\nimport (\n  \"fmt\"\n  q \"go/lib\"\n)\n\ntype Box struct { n int }\n\nfunc (b *Box) Open(p string) error { return close(p) }\n\nfunc close(p string) error { fmt.Println(p); return nil }\n",
    "j/X.java": "package j;\nimport java.util.List;\nimport static j.Y.of;\npublic class X extends Y implements Z {\n  @Override public int m(int a) { return of(a) + new Y(a).n(); }\n}\n",
    "bad.py": "def f(:\n",
    "note.txt": "class Nothing {}",
}


def frame(spark):
    rows = [(p, c) for p, c in FILES.items()] + [("web/a.ts", FILES["web/a.ts"]), (None, "x = 1"), ("n.py", None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "file_path string, content string, name string")


def test_symbols_of_five_languages(spark):
    got = {(r["file_path"], r["name"], r["node_type"], r["parent"]) for r in S.symbols(frame(spark)).collect()}
    assert got == {
        ("app/core/base.py", "Base", "class", None), ("app/core/base.py", "run", "method", "Base"), ("app/core/base.py", "helper", "function", None),
        ("app/main.py", "Main", "class", None), ("app/main.py", "go", "method", "Main"), ("app/util.py", "_own", "function", None),
        ("web/a.ts", "A", "class", None), ("web/a.ts", "m", "method", "A"), ("web/a.ts", "f", "function", None), ("web/lib/b.ts", "B", "class", None), ("web/lib/b.ts", "helper", "function", None),
        ("go/m.go", "Box", "class", None), ("go/m.go", "Open", "method", "Box"), ("go/m.go", "close", "function", None),
        ("j/X.java", "X", "class", None), ("j/X.java", "m", "method", "X"),
    }


def test_imports_and_exports(spark):
    got = {(r["file_path"], r["module"], r["name"]) for r in S.imports(frame(spark)).collect()}
    assert {m for p, m, n in got if p == "app/main.py"} == {".core.base", ".", "os.path", "app.core.base.deep"}
    assert {(m, n) for p, m, n in got if p == "web/a.ts"} == {("./lib/b", "B"), ("./lib/b", "C"), ("left-pad", "x")}
    assert ("go/m.go", "fmt", None) in got and ("go/m.go", "go/lib", None) in got and ("j/X.java", "java.util", "List") in got and ("web/lib/b.ts", "../a", None) in got
    out = {(r["file_path"], r["name"]) for r in S.exports(frame(spark)).collect()}
    assert {n for p, n in out if p == "web/a.ts"} == {"A", "f", "one", "three"} and ("app/util.py", "_own") not in out
    assert ("go/m.go", "Box") in out and ("go/m.go", "close") not in out and ("j/X.java", "X") in out and ("web/lib/b.ts", "helper") in out


def test_relations(spark):
    got = {(r["source"], r["target"], r["rel"]) for r in S.relations(frame(spark)).collect()}
    assert {("run", "helper", "calls"), ("helper", "Other", "instantiates"), ("Main", "Base", "extends"), ("wrap", "Main", "decorates"), ("go", "run", "calls")} <= got
    assert {("A", "B", "extends"), ("A", "I", "implements"), ("A", "J", "implements"), ("m", "helper", "calls"), ("m", "Thing", "instantiates")} <= got
    assert {("Open", "close", "calls"), ("close", "Println", "calls"), ("X", "Y", "extends"), ("X", "Z", "implements"), ("m", "of", "calls"), ("m", "Y", "instantiates"), ("Override", "m", "decorates")} <= got


def test_imports_resolve_to_files(spark):
    f = frame(spark)
    got = {(r["file_path"], r["module"]): (r["resolved"], r["how"]) for r in S.resolve_imports(S.imports(f), f).collect()}
    assert got["app/main.py", ".core.base"] == ("app/core/base.py", "relative")
    assert got["app/main.py", "app.core.base.deep"] == ("app/core/base.py", "prefix")
    assert got["app/main.py", "os.path"] == (None, "external") and got["web/a.ts", "left-pad"] == (None, "external")
    assert got["web/a.ts", "./lib/b"] == ("web/lib/b.ts", "relative") and got["web/lib/b.ts", "../a"] == ("web/a.ts", "relative")
    assert S.resolve_imports(S.imports(f.limit(0)), f).count() == 0


def test_graph_of_sources(spark):
    nodes, edges = S.source_graph(frame(spark))
    got = {tuple(r) for r in edges.select("src", "dst", "rel").collect()}
    assert ("app/main.py:Main", "app/core/base.py:Base", "extends") in got and ("app/main.py", "app/core/base.py", "imports") in got
    assert ("web/a.ts:A", "web/a.ts:m", "contains") in got and ("app/core/base.py:run", "app/core/base.py:helper", "calls") in got
    g = PropertyGraph(nodes, edges)
    assert g.tree(spark.createDataFrame([("app/core/base.py:run",)], "id string"), 2, ["calls"]).count() == 2
