"""Source trees: scans, incremental selection, and symbols, imports, exports and relations of source files."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.code import SCRIPT, Headers, language_of, tokenize
from lodestrata.session import spread

SKIPPED = (".venv", "__pycache__", "node_modules", ".git")
SYMBOLS = "file_path string, name string, node_type string, start_line int, end_line int, docstring string, signature string, parent string"
IMPORTS = "file_path string, module string, name string, line int"


def scan_tree(spark: SparkSession, paths: str | Sequence[str], extensions: Sequence[str], glob: str | None = None) -> DataFrame:
    """(file_path, content, content_hash) of the files with one of the extensions, of a glob of names where given, folders of SKIPPED left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    d = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    keep = F.regexp_extract("path", r"\.([^./]+)$", 1).isin([e.lstrip(".") for e in extensions])
    for s in SKIPPED:
        keep = keep & ~F.col("path").contains(s)
    return d.where(keep).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.md5("content").alias("content_hash"))


def stale(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are not stored with the same hash."""
    return files.join(stored.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")


EXPORTS = "file_path string, name string, line int"
RELATIONS = "file_path string, source string, target string, rel string, line int"
_NO_CALL = frozenset("if for while switch catch return function func new typeof await yield super this print sizeof in case else do throw assert synchronized with def class lambda not and or is elif except import from go defer select range make len cap append panic".split())


class _Found:
    """What a file holds, as rows of the four tables."""

    def __init__(self, path: str):
        self.path = path
        self.symbols: list[tuple] = []
        self.imports: list[tuple] = []
        self.exports: list[tuple] = []
        self.relations: list[tuple] = []

    def relate(self, source: str | None, target: str, rel: str, line: int) -> None:
        self.relations.append((self.path, source, target, rel, line))


def _python(path: str, text: str) -> _Found:
    out = _Found(path)

    def called(f: ast.expr) -> str | None:
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None

    def visit(node: ast.AST, parent: str | None, scope: str | None, in_class: bool) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(c, ast.ClassDef)
                if cls:
                    bases = ", ".join(ast.unparse(b) for b in c.bases)
                    signature = f"class {c.name}({bases})" if bases else f"class {c.name}"
                    for b in c.bases:
                        out.relate(c.name, ast.unparse(b).split("[")[0].rsplit(".", 1)[-1], "extends", c.lineno)
                else:
                    returns = f" -> {ast.unparse(c.returns)}" if c.returns else ""
                    signature = f"{'async ' if isinstance(c, ast.AsyncFunctionDef) else ''}def {c.name}({ast.unparse(c.args)}){returns}"
                for dec in c.decorator_list:
                    if name := called(dec.func if isinstance(dec, ast.Call) else dec):
                        out.relate(name, c.name, "decorates", dec.lineno)
                out.symbols.append((path, c.name, "class" if cls else "method" if in_class else "function", c.lineno, c.end_lineno, ast.get_docstring(c), signature, parent))
                if parent is None and scope is None and not c.name.startswith("_"):
                    out.exports.append((path, c.name, c.lineno))
                visit(c, c.name, c.name, cls)
                continue
            if isinstance(c, ast.Import):
                out.imports.extend((path, a.name, None, c.lineno) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                out.imports.extend((path, "." * c.level + (c.module or ""), a.name, c.lineno) for a in c.names)
            elif isinstance(c, ast.Call) and (name := called(c.func)):
                out.relate(scope, name, "instantiates" if name[:1].isupper() else "calls", c.lineno)
            visit(c, parent, scope, False)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        visit(ast.parse(text), None, None, False)
    return out


def _braces(path: str, text: str, language: str) -> _Found:
    out, d = _Found(path), tokenize(text, language)
    if d.bad:
        raise ValueError("tokens")
    h, t, k = Headers(d, language), d.text, d.kind
    line, at, lines = 1, 0, []
    for a in d.start:
        line, at = line + text.count("\n", at, a), a
        lines.append(line)
    script, quoted = language in SCRIPT, {}
    for i, kind in enumerate(k):
        if kind == "s":
            quoted[i] = text[d.start[i] + 1 : d.end[i] - 1]

    def strings(i: int, j: int) -> list[str]:
        return [quoted[x] for x in range(i, j) if x in quoted]

    # types: (first token of the body, last one, name)
    bodies: list[tuple[int, int, str, str]] = []
    for i, s in enumerate(t):
        if k[i] != "w":
            continue
        name = None
        if s in ("class", "interface", "enum", "record") and language != "go" and h.is_word(i + 1) and h.at(i - 1) != ".":
            name = i + 1
        elif s == "type" and language == "go" and h.is_word(i + 1) and h.at(i + 2) in ("struct", "interface", "["):
            name = i + 1
        if name is None:
            continue
        b = name + 1
        while b < len(t) and t[b] not in ("{", ";"):
            b = h.pair.get(b, b) + 1 if t[b] in ("(", "[") else b + 1
        if b >= len(t) or t[b] != "{" or b not in h.pair:
            continue
        bodies.append((b, h.pair[b], t[name], "class"))
        rel = None
        for x in range(name + 1, b):
            if t[x] in ("extends", "implements"):
                rel = t[x]
            elif rel and k[x] == "w" and h.at(x - 1) in ("extends", "implements", ",", ".") and h.at(x + 1) != ".":
                out.relate(t[name], t[x], rel, lines[x])
        head = text[d.start[i] : d.start[b]].strip()
        out.symbols.append((path, t[name], "class", lines[i], lines[h.pair[b]], None, " ".join(head.split()), None))
    heads = {}
    for node_type, n, j, body, _ in h.find():
        end = h.pair.get(body, body) if body is not None else j
        heads[n] = (node_type, j, body, end)
    inner = sorted(bodies)
    for n, (node_type, j, body, end) in heads.items():
        around = [x for x in inner if x[0] < n < x[1]]
        parent = around[-1][2] if around else None
        if language == "go" and node_type == "method":
            receiver = [x for x in range(h.opener.get(n - 1, n), n) if k[x] == "w"]
            parent = t[receiver[-1]] if receiver else None
        out.symbols.append((path, t[n], node_type, lines[n], lines[end], None, " ".join(text[d.start[n] : d.end[j]].split()), parent))
        if body is not None:
            bodies.append((body, end, t[n], "function"))
    bodies.sort()
    # calls by the innermost function or type they stand in
    stack: list[tuple[int, str]] = []
    begin = {b: (e, name) for b, e, name, _ in bodies}
    for i, s in enumerate(t):
        while stack and stack[-1][0] < i:
            stack.pop()
        if i in begin:
            stack.append(begin[i])
        if k[i] == "w" and h.at(i + 1) == "(" and i not in heads and s not in _NO_CALL:
            made = h.at(i - 1) == "new" or (s[:1].isupper() and language != "go")
            out.relate(stack[-1][1] if stack else None, s, "instantiates" if made else "calls", lines[i])
        elif s == "@" and language == "java" and h.is_word(i + 1) and t[i + 1] != "interface":
            follow = next((n for n in sorted(heads) if n > i), None)
            if follow is not None:
                out.relate(t[i + 1], t[follow], "decorates", lines[i])
        # imports and exports
        if s == "import" and k[i] == "w" and h.at(i - 1) != ".":
            if script and h.at(i + 1) != "(":
                e = i + 1
                while e < len(t) and e not in quoted and t[e] != ";":
                    e += 1
                if e in quoted:
                    names = [t[x] for x in range(i + 1, e) if k[x] == "w" and t[x] not in ("from", "as", "type") and h.at(x - 1) != "as"]
                    out.imports += [(path, quoted[e], n, lines[i]) for n in names or [None]]
            elif language == "java":
                e = i + 1
                while e < len(t) and t[e] != ";":
                    e += 1
                dotted = "".join(x for x in t[i + 1 : e] if x != "static")
                module, _, name = dotted.rpartition(".")
                out.imports.append((path, module, name, lines[i]))
            elif language == "go":
                e = h.pair.get(i + 1, i + 2) if h.at(i + 1) == "(" else i + 3
                out.imports += [(path, m, None, lines[i]) for m in strings(i + 1, e + 1)]
        elif s == "require" and script and h.at(i + 1) == "(" and i + 2 in quoted:
            out.imports.append((path, quoted[i + 2], None, lines[i]))
        elif s == "export" and script:
            if h.at(i + 1) == "{":
                out.exports += [(path, t[x], lines[x]) for x in range(i + 2, h.pair.get(i + 1, i + 1)) if k[x] == "w" and h.at(x + 1) in (",", "}")]
                e = h.pair.get(i + 1, i + 1)
                if h.at(e + 1) == "from" and e + 2 in quoted:
                    out.imports.append((path, quoted[e + 2], None, lines[i]))
            else:
                x = i + 1
                while h.at(x) in ("default", "async", "function", "class", "const", "let", "var", "interface", "type", "enum", "abstract", "declare", "*"):
                    x += 1
                if h.is_word(x):
                    out.exports.append((path, t[x], lines[x]))
    if language == "go":
        out.exports += [(path, s[1], s[3]) for s in out.symbols if s[1][:1].isupper()]
    elif language == "java":
        out.exports += [(path, x[2], lines[x[0]]) for x in inner if "public" in t[max(0, x[0] - 12) : x[0]]]
    return out


def _extract(files: DataFrame, which: str, schema: str) -> DataFrame:
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for p, text in zip(b["file_path"], b["content"]):
                language = language_of(p)
                if not language:
                    continue
                try:
                    found = _python(p, text) if language == "python" else _braces(p, text, language)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += getattr(found, which)
            yield pd.DataFrame(rows, columns=columns)

    return spread(files.where("file_path is not null and content is not null").select("file_path", "content")).mapInPandas(run, schema).distinct()


def symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of files(file_path, content) in Python, JavaScript, TypeScript, Go and Java.

    Interfaces, enums, records and structs count as classes. Files of other extensions, null contents and files whose
    tokens or, in Python, syntax fail have none; repeated files count once.
    """
    return _extract(files, "symbols", SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    """(file_path, module, name, line): one row per imported name, relative modules with their dots; name is null where a whole module is imported."""
    return _extract(files, "imports", IMPORTS)


def exports(files: DataFrame) -> DataFrame:
    """(file_path, name, line): what a file offers others: exported names of scripts, capitalised ones of Go, public types of Java, top-level ones without underscore of Python."""
    return _extract(files, "exports", EXPORTS)


def relations(files: DataFrame) -> DataFrame:
    """(file_path, source, target, rel, line): calls, instantiates (new, or a capital first letter), extends, implements and decorates, by names; source is null at the top."""
    return _extract(files, "relations", RELATIONS)


def resolve_imports(imported: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module, resolved, how) of imports(file_path, module): 'exact' for a dotted name or path of a file, 'relative' from the folder of the
    importing file, 'prefix' for the longest dotted beginning that is a file, else null and 'external'. Of files of one name the greatest path counts."""
    known = files.where("file_path is not null").select("file_path").distinct()
    stem = F.regexp_replace("file_path", r"\.[^./]+$", "")
    whole = known.select(F.regexp_replace(stem, r"/(__init__|index)$", "").alias("stem"), "file_path").groupBy("stem").agg(F.max("file_path").alias("resolved"))
    i = imported.where("file_path is not null and module is not null").select("file_path", "module").distinct()
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    script = F.col("module").startswith("./") | F.col("module").startswith("../")
    up = F.when(script, F.size(F.split("module", r"\.\./")) - 1).otherwise(F.greatest(dots - 1, F.lit(0)))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "/")
    rest = F.when(script, F.regexp_replace(F.regexp_replace("module", r"^(\.\.?/)+", ""), r"\.(js|ts|mjs|jsx|tsx)$", "")).otherwise(F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/")))
    relative = F.when(script | (dots > 0), F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))
    plain = F.replace(F.regexp_replace("module", r"\.(js|ts|mjs|jsx|tsx)$", ""), F.lit("."), F.lit("/"))
    steps = F.split(plain, "/")
    n = F.size(steps)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.when(k == n, 0).otherwise(2).alias("rank"), (-k).alias("k"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("stem")))
    tries = F.when(relative.isNotNull(), F.array(F.struct(F.lit(1).alias("rank"), F.lit(0).alias("k"), relative.alias("stem")))).otherwise(prefixes)
    c = i.select("file_path", "module", F.explode(tries).alias("x")).select("file_path", "module", "x.*").join(whole, "stem")
    best = c.groupBy("file_path", "module").agg(F.min_by(F.struct("resolved", "rank"), F.struct("rank", "k")).alias("b"))
    how = F.when(F.col("b.rank") == 0, "exact").when(F.col("b.rank") == 1, "relative").when(F.col("b.rank") == 2, "prefix").otherwise("external")
    return i.join(best, ["file_path", "module"], "left").select("file_path", "module", F.col("b.resolved").alias("resolved"), how.alias("how"))


def source_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, label, name, file_path), edges(src, dst, rel)) of sources: files and their symbols; contains, resolved imports and relations whose
    target is a symbol of the same file, else of the last file that has the name."""
    s = symbols(files).groupBy("file_path", "name").agg(F.min("node_type").alias("label"), F.max("parent").alias("parent"))
    nodes = s.select(F.concat_ws(":", "file_path", "name").alias("id"), "label", "name", "file_path")
    nodes = nodes.unionByName(files.where("file_path is not null").select(F.col("file_path").alias("id"), F.lit("module").alias("label"), F.col("file_path").alias("name"), "file_path").distinct())
    holds = s.select(F.when(F.col("parent").isNull(), F.col("file_path")).otherwise(F.concat_ws(":", "file_path", "parent")).alias("src"), F.concat_ws(":", "file_path", "name").alias("dst"), F.lit("contains").alias("rel"))
    brought = resolve_imports(imports(files), files).where("resolved is not null").select(F.col("file_path").alias("src"), F.col("resolved").alias("dst"), F.lit("imports").alias("rel"))
    own = s.select("file_path", F.col("name").alias("target"), F.lit(True).alias("own"))
    last = s.groupBy(F.col("name").alias("target")).agg(F.max("file_path").alias("other"))
    r = relations(files).where("rel <> 'decorates'").join(own, ["file_path", "target"], "left").join(last, "target", "left").where("own or other is not null")
    tied = r.select(F.when(F.col("source").isNull(), F.col("file_path")).otherwise(F.concat_ws(":", "file_path", "source")).alias("src"), F.concat_ws(":", F.when(F.col("own"), F.col("file_path")).otherwise(F.col("other")), "target").alias("dst"), "rel")
    return nodes, holds.unionByName(brought).unionByName(tied).distinct()
