
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.functions.code import language_of
from lodestrata.llm import grammars, lexing, parsing

VALID = {
    "python": ["", "# only\n", "x = 1\nif x:\n  y = 2\nelse:\n  y = 3\n", "def f(a, *, b=(1, 2)) -> int:\n    '''<<<<<<< {'''\n    return a\n", "@d\nclass A:\n    async def m(self): ...\r\n", "s = f'{x!r:>{w}}'\nmatch s:\n    case [1, *_]: pass\n"],
    "javascript": ["", "/* x */", "const f = async (a, {b = 1, ...c}) => a / 2 / b;\nlabel: for (const x of y) { continue label }\n", "class A extends B { static #p = 1; get x() { return this.#p } async *g() { yield* h } }\nexport default A\n", "let r = /[/({]+/g.test(`a ${b ? `c ${d}` : '}'} e`)\nif (a) b\nelse c\n", "import d, { x as y } from './m'\nvar a = b\n++c\n", "for (;;) {}\ndo x(); while (y)\nswitch (z) { case 1: default: break }\ntry { a() } catch { b() } finally { c() }\n"],
    "typescript": ["interface A<T = {}> extends B<Array<Array<T>>> { readonly x?: number; [k: string]: unknown; m<U>(u: U): u is T }\n", "export const f = <T,>(a: T, b?: (x: number) => void): Promise<T[]> => g<T>(a)!;\n", "type X = { [K in keyof T]?: T[K] extends infer U ? U : never } | 'a' | -1;\nabstract class C<T> implements D, E { private constructor(public readonly a: T) { super() } abstract m(): void; }\nenum Q { A = 1, B }\ndeclare module M { }\n", "let y = x as unknown as string[];\nif (a < b && c > d) e(f >> 2)\n"],
    "go": ["", "package a\n", "package a\n\nimport (\n  m \"math\"\n)\n\ntype T[K comparable] struct {\n  sync.Mutex\n  a, b map[string][]*K `json:\"x\"`\n}\n\nfunc (t *T[K]) F(x ...int) (n int, err error) {\n  for i, v := range x {\n    if v := g(i); v > 0 { n += v } else if ok { break }\n  }\n  switch y := z.(type) {\n  case int, []string:\n    go func() { ch <- 1 }()\n  default:\n  }\n  return T[K]{a: nil}.F(x...), <-ch\n}\n", "package a\nvar x = []struct{ a int }{{1}, {a: 2}}\nconst ( A = iota; B )\n"],
    "java": ["", "package a.b;\nimport static x.Y.*;\n@Z(a = {1, 2}) public final class A<T extends B & C> extends D<T[]> implements E {\n  static { f(); }\n  private int a = 1, b[] = {1, 2};\n  @Override public <U> List<Map<String, U>> m(final int... x) throws F { for (var y : z) { if (y instanceof G g && g.h() >> 2 > 1) return (List<Map<String, U>>) k; } return switch (q) { case 1, 2 -> 3; default -> { yield 4; } }; }\n  interface I { default void n() {} int o(); }\n  record R(int a) { R { assert a > 0 : \"x\"; } }\n  enum S { A(1) { void p() {} }, B; }\n}\n", "class A { Runnable r = () -> { try (var x = y()) { } catch (B | C e) { throw e; } }; Object o = new Object() { }; int[][] z = new int[3][]; String t = \"\"\"\n a \" { \"\"\"; F f = String::new; }\n"],
}
INVALID = {
    "python": ["def f(:\n", "if x\n  y = 1\n", "x = 'abc\n", "<<<<<<< HEAD\nx = 1\n=======\n", "  x = 1\n y = 2\n", "print 'a'\n", "def f():\nx = 1\n", "x = (1\n", "… rest\n"],
    "javascript": ["function f( {\n", "const x = ;\n", "let a = 'b\n", "interface A { x: number }\n", "function f(a: number) {}\n", "a b\n", "```\nx `y\n```\n", "<<<<<<< a\n", "x = `a ${b\n", "def f(x):\n    return x\n", "<!DOCTYPE html>\n<p>x</p>\n", "const x = 1 +\n", "@@ -1,2 +1,3 @@\n", "if (a) { b() \n", "foo(1, 2\n}"],
    "typescript": ["type = ;\n", "class A { x: }\n", "let x: = 1\n", "package a;\n", "func f() {}\n", "const v = (a + 1) * \n", "foo(a; b)\n"],
    "go": ["package a\nfunc f() {\n  x := \n}\n", "func f() {}\n", "package a\nimport \"x\n", "package a\nfunc f() int { return 1;; } }\n", "package a.b;\nclass A {}\n", "package a\nx = 1\n", "package a\nfunc f() { if { } }\n", "package a\ntype {{ .x }} struct {}\n", "package a\nfunc f() { a b }\n"],
    "java": ["class A { int x }\n", "class A { void m() { foo() } }\n", "int x = 1;\n", "class A { void m( { } }\n", "class A { void m() { a + b; } }\n", "package a\n\nfunc f() {}\n", "public class A {\n", "class A { String s = \"x; }\n", "class A { void m() { return 1 } }\n"],
}


def ok(text, language, size=10**6):
    pieces = lexing.chunks(text, size)
    return lexing.balanced([lexing.chunk_map(p, language, k == 0) for k, p in enumerate(pieces)], language, text) and grammars.valid(text, language)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert ok(text, language)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert not ok(text, language)


@pytest.mark.parametrize(("language", "text"), [(k, t) for d in (VALID, INVALID) for k, v in d.items() for t in v])
def test_any_cut_gives_the_same_verdict(language, text):
    whole = lexing.balanced([lexing.chunk_map(text, language, True)], language, text)
    for size in (1, 7, 40):
        maps = [lexing.chunk_map(p, language, k == 0) for k, p in enumerate(lexing.chunks(text, size))]
        assert lexing.balanced(maps, language, text) == whole


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(VALID)), st.lists(st.text(alphabet="ab ()[]{}'\"`/*#$\\\n", max_size=12), min_size=3, max_size=3))
def test_composition_is_associative(language, parts):
    a, b, c = (lexing.chunk_map(p + "\n", language) for p in parts)
    left, right = lexing.compose(lexing.compose(a, b), c), lexing.compose(a, lexing.compose(b, c))
    for s in left:
        x, y = left[s], right[s]
        if not (x.again or y.again or x.bad or y.bad):
            assert x == y


def test_operator(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    rows = [("r/a.py", "r", "x = 1\n", t), ("r/a.py", "r", "x = (\n", t + dt.timedelta(1)), ("r/b.js", "r", "", t), ("r/c.txt", "r", "(", t), ("r/d.go", "q", None, t), ("r/e.py", None, "y" * 100_000 + " = 1\n" + "(\n1)\n" * 20_000, t), (None, "r", "(", t), ("r/b.js", "r", "", t)]
    f = spark.createDataFrame([(*r, "clash", False) for r in rows], "file_path string, repo string, content string, parsed_at timestamp, language string, valid boolean")
    checked = parsing.checked_files(f)
    got = {(r["file_path"], r["parsed_at"].day): r["valid"] for r in checked.collect()}
    assert got == {("r/a.py", 1): True, ("r/a.py", 2): False, ("r/b.js", 1): True, ("r/c.txt", 1): None, ("r/d.go", 1): None, ("r/e.py", 1): True}
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"]) for r in parsing.invalid_rates(f, checked).collect()}
    assert rates == {("r", "python"): (1, 1), ("r", "javascript"): (1, 0), (None, "python"): (1, 0)}
    assert parsing.checked_files(f.limit(0)).count() == 0




def decided(path, text):
    language = language_of(path)
    m, grammar = parsing.examine(text, language, path)
    return grammar if lexing.balanced([m], language) else False


@pytest.mark.parametrize("depth", [4_000, 30_000])
def test_depth_is_no_excuse(depth):
    a, z = "(" * depth, ")" * depth
    for path, text in (("a.js", "x = {};"), ("a.go", "package a\nvar x = {}\n"), ("A.java", "class A {{ int x = {}; }}")):
        assert decided(path, text.format(f"{a}1{z}")) is True
        assert decided(path, text.format(f"{a}1 1{z}")) is False
    assert decided("a.py", f"x = {a}1{z}\n") is False  # the interpreter refuses it


def test_markup():
    ok = ['const A = ({a}) => <div className="x" {...p} onClick={() => f(`q ${b}`)}>it\'s {a ? <b>x</b> : null} {/* c */} <Foo.Bar/> <></></div>;\nexport default A\n', "x = a < b ? c : d\n"]
    bad = ["const a = <div>;", "const a = <a></b>;", "const a = <a b={}/>;", "const a = <a b={1 2}/>;", "const a = <a>{x y}</a>", "const a = <a"]
    assert all(decided("a.jsx", t) is True for t in ok) and not any(decided("a.jsx", t) for t in bad)
    assert decided("b.tsx", "const f = <T,>(x: T) => x;\nfunction B(p: {a: number}) { return (\n<ul>{xs.map((x) => <li key={x}>{x < 3 ? 'a' : `b`}</li>)}</ul>) }\nconst n: Array<number> = y as Foo<Bar>;") is True


@pytest.mark.parametrize(("path", "text", "valid"), [("A.java", "void main() { f(); }\nint f() { return 1; }", True), ("A.java", "int x = 1;\n", False), ("a.py", "return 1\n", False), ("a.py", "def f(a, a): pass\n", False), ("a.py", "break\n", False), ("a.py", "from __future__ import annotations\nx = 1\n", True), ("a.py", "async def f():\n    await x\n", True)])
def test_more_verdicts(path, text, valid):
    assert decided(path, text) is valid
