"""Functions paired with their documentation.

Lexed tokens that shape functions become rows: headers, brackets of bodies, indents, docstrings and comments. Windows in
SQL give each row its running depth and, by level of depth, what pairs with it, which delimits bodies. Comments on
successive lines are islands; a window over lines attaches an island to the declaration right below it.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.code import Headers, tokenize
from lodestrata.llm import grammars, lexing, parsing
from lodestrata.session import Workspace, spread

_COLUMNS = {"file_path": "string", "ver": "long", "parsed_at": "timestamp_ntz", "digest": "string", "valid": "boolean", "language": "string", "pos": "long", "kind": "string", "name": "string", "node_type": "string", "line": "int", "end_line": "int", "top": "int", "inner": "string", "text": "string"}
_ROW = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())

# How comments begin that direct a tool.
DIRECTIVE = r"^//[ ]*(@ts-|ts-|eslint|tslint|prettier|biome|deno-lint|istanbul|c8 |v8 |noinspection|nolint|NOSONAR|checkstyle|spotless|go:)"


# ---------------------------------------------------------------- tokens of Python

_PY_TOKEN = re.compile(r"(?P<n>\n)|(?P<s>'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'(?:[^'\\\n]|\\[\s\S])*+'|\"(?:[^\"\\\n]|\\[\s\S])*+\")|(?P<c>#[^\n]*)|(?P<b>[()\[\]{}])|\\\r?\n")
_PY_DEF = re.compile(r"(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?=[(\[])")
_PY_DOC = re.compile(r"[rRuU]?(?='|\")")
_PY_WORD = re.compile(r"[^\W\d]\w*")
_PY_BLANK = re.compile(r"[ \t\f]*")


def python_tokens(text: str) -> Iterator[tuple]:
    """(kind, pos, name, node_type, line, end_line, top, inner, text): headers 'h', indents 'in' and 'de', docstrings 's'."""
    if not text.endswith("\n"):
        text += "\n"
    begin, strings, close, stack = [0], {}, {}, []
    skip: list[tuple[int, int]] = []
    for m in _PY_TOKEN.finditer(text):
        k = m.lastgroup
        if k == "n":
            if not stack:
                begin.append(m.end())
        elif k == "s":
            strings[m.start()] = m.end()
            skip.append(m.span())
        elif k == "c":
            skip.append(m.span())
        elif k == "b":
            if m.group() in "([{":
                stack.append(m.start())
            elif stack:
                close[stack.pop()] = m.end() - 1
    line, counted, levels, body, no = 1, 0, [0], False, count()
    for at, end in zip(begin, begin[1:]):
        first = _PY_BLANK.match(text, at).end()
        if text[first] in "#\r\n" or first >= end:
            continue
        line, counted = line + text.count("\n", counted, first), first
        indent = len(text[at:first].expandtabs())
        if indent > levels[-1]:
            levels.append(indent)
            yield "in", next(no), None, None, line, line, None, None, None
        while indent < levels[-1]:
            levels.pop()
            yield "de", next(no), None, None, line, line, None, None, None

        def doc(start: int, line: int, end: int = end) -> Iterator[tuple]:
            """The docstring that begins at a place, if a statement of nothing but strings does."""
            if not (m := _PY_DOC.match(text, start)) and text[start] != "(":
                return
            q, z, tail = m.end() if m else -1, start, start
            if q < 0 and start in close and _is_string(text[start : close[start] + 1]):
                z = close[start] + 1
                tail = _PY_BLANK.match(text, z).end()
            while q in strings:
                z = tail = strings[q]
                tail = _PY_BLANK.match(text, tail).end()
                q = m.end() if (m := _PY_DOC.match(text, tail)) else -1
            if z > start and text[tail] in "\r\n#;":
                yield "s", next(no), None, None, line, line + text.count("\n", start, z), None, None, text[start:z]

        if body:
            yield from doc(first, line)
        body = False
        if not (m := _PY_DEF.match(text, first)):
            continue
        at = m.end()
        if text[at] == "[":
            at = _PY_BLANK.match(text, close.get(at, at) + 1).end()
        j = close.get(at)
        if text[at] != "(" or j is None:
            continue
        inner = " ".join(w for w in _words_of(text, at + 1, j, skip))
        yield "h", next(no), m.group(1), None, line, line, line, inner, None
        # the colon that ends the header: the first outside brackets and strings
        x = j + 1
        while x < end and text[x] != ":":
            x = close.get(x, strings.get(x, x + 1) - 1) + 1
        rest = _PY_BLANK.match(text, x + 1).end()
        if rest < end and text[rest] not in "\r\n#":
            yield from doc(rest, line + text.count("\n", first, rest))
        else:
            body = True
    line += text.count("\n", counted)
    for _ in levels[1:]:
        yield "de", next(no), None, None, line, line, None, None, None


def _is_string(code: str) -> bool:
    try:
        return isinstance(ast.literal_eval(code), str)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return False


def _words_of(text: str, a: int, b: int, skip: list[tuple[int, int]]) -> Iterator[str]:
    """The names between two places, without strings and comments."""
    k = bisect_left(skip, (a, 0))
    while a < b:
        stop = skip[k][0] if k < len(skip) and skip[k][0] < b else b
        yield from _PY_WORD.findall(text[a:stop])
        a, k = (skip[k][1] if stop < b else b), k + 1


# ---------------------------------------------------------------- tokens of languages with braces


def brace_tokens(text: str, language: str) -> Iterator[tuple]:
    """(kind, pos, name, node_type, line, end_line, top, inner, text): headers 'h', braces '{' and '}', comments 'c' on lines of their own."""
    d = tokenize(text, language)
    found = Headers(d, language, values=True)
    line, at = 1, 0
    lines = []
    for a in d.start:
        line, at = line + text.count("\n", at, a), a
        lines.append(line)
    headers, tops, owner = list(found.find()), [], {}
    for _, n, *_ in headers:
        first, places = found.begin(n)
        tops.append(lines[first])
        # the declaration to which a comment right above a line belongs: annotations and modifiers may stand on lines of their own
        owner |= {lines[i]: lines[first] for i in places if i == 0 or lines[i - 1] < lines[i]}
    line, at = 1, 0
    for a, z in d.comments:
        line, at = line + text.count("\n", at, a), a
        i = bisect_left(d.start, z)
        end = line + text.count("\n", a, z)
        if not text[text.rfind("\n", 0, a) + 1 : a].strip() and not (i < len(lines) and lines[i] == end):
            yield "c", 2 * a, None, None, line, end, owner.get(end + 1, end + 1), None, text[a:z]
    for i, (s, k) in enumerate(zip(d.text, d.kind)):
        if k == "o" and s in ("{", "}"):
            yield s, 2 * d.start[i], None, None, lines[i], lines[i], None, None, None
    for (node_type, n, j, body, inner), top in zip(headers, tops):
        pos = 2 * d.start[body] - 1 if body is not None else 2 * d.start[j] + 1
        e = j if body is not None else found.end(j)
        end = lines[e] + text.count("\n", d.start[e], d.end[e])
        yield "h" if body is not None else "d", pos, d.text[n], node_type, lines[n], end, top, inner, None


def token_rows(files: DataFrame) -> DataFrame:
    """The tokens of files(file_path, parsed_at, content) not known to be invalid as rows, beside a row 'v' for every version of a file with a content.

    Validity and tokens are found in one pass over the texts, which are not shuffled. Tokens of a version carry its number ver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, at, digest, text, language, ver in zip(b["file_path"], b["parsed_at"], b["digest"], b["content"], b["language"], b["ver"]):
                if text is None or not language:
                    continue
                m, grammar = parsing.examine(text, language, path)
                valid = grammar if lexing.balanced([m], language) else False
                rows.append((path, ver, at, digest, valid, language, -1, "v", *[None] * 7))
                if valid is not False:
                    if parsing.has_markup(path):
                        text = grammars.jsx_as_arrays(text)
                    found = python_tokens(text.removeprefix("\ufeff")) if language == "python" else brace_tokens(text, language)
                    rows += [(path, ver, None, None, None, language, pos, kind, *rest) for kind, pos, *rest in found]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=list(_COLUMNS))
                    rows = []
            yield pd.DataFrame(rows, columns=list(_COLUMNS))

    d = parsing.versions(files).withColumn("ver", F.xxhash64("parsed_at", "digest"))
    return spread(d).mapInPandas(run, _ROW)


# ---------------------------------------------------------------- windows


def comment_blocks(tokens: DataFrame) -> DataFrame:
    """(file_path, ver, top, doc): islands of comments of a kind on successive lines, at the declaration right below, else at the line; directives to tools join what is above."""
    over = "over (partition by file_path, ver order by pos)"
    c = tokens.where("kind = 'c'").selectExpr("file_path", "ver", "pos", "line", "end_line", "top", "text", "substr(text, 1, 2) as style").repartition("file_path")
    c = c.selectExpr("*", f"lag(struct(pos, end_line, style)) {over} as p").where("p is null or p.pos <> pos")
    c = c.selectExpr("*", f"sum(case when p.end_line + 1 = line and (p.style = style or text rlike '{DIRECTIVE}') then 0 else 1 end) {over} as island")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    c = c.groupBy("file_path", "ver", "island").agg(F.max_by("top", "pos").alias("top"), F.min("pos").alias("pos"), lines.alias("text"))
    return c.groupBy("file_path", "ver", "top").agg(lines.alias("doc"))


def documented_functions(tokens: DataFrame) -> DataFrame:
    """(file_path, language, name, node_type, start_line, end_line, inner, doc) of all named functions with any documentation, of the last version of each file.

    A file whose last version of known validity is invalid gives nothing, as p1 has it.
    """
    over = "over (partition by file_path, ver order by pos, kind, line, name)"
    version = "coalesce(parsed_at, timestamp_ntz'0001-01-01') as at, digest, ver"
    d = tokens.where("kind <> 'c'").repartition("file_path")
    d = d.selectExpr("*", f"max(case when kind = 'v' then struct({version}) end) over (partition by file_path) as latest", f"max(case when kind = 'v' and valid is not null then struct({version}, valid) end) over (partition by file_path) as known")
    d = d.where("coalesce(known.valid, true) and latest.ver = ver and kind <> 'v'").drop("latest", "known", "parsed_at", "digest", "valid")
    d = d.selectExpr("*", f"lag(struct(pos, kind, line, name)) {over} as p").where("p is null or not p <=> struct(pos, kind, line, name)")
    d = d.selectExpr("*", f"sum(case when kind in ('{{', 'in') then 1 when kind in ('}}', 'de') then -1 else 0 end) {over} as depth", f"lead(struct(kind, text, end_line), 1) {over} as x1", f"lead(struct(kind, text), 2) {over} as x2")
    level = "case when kind in ('{', 'in') then depth - 1 else depth end"
    by = f"over (partition by file_path, ver, {level} order by pos)"
    d = d.where("kind <> 's'").selectExpr("*", f"lead(struct(kind, line), 1) {by} as n1", f"lead(struct(kind, line), 2) {by} as n2")
    h = d.where("kind in ('h', 'd')")
    own = "case when x1.kind = 's' then x1.text when x1.kind = 'in' and x2.kind = 's' then x2.text end"
    end = "case when kind = 'd' then end_line when n1.kind = '{' then n2.line when n1.kind = 'in' then n2.line - 1 when x1.kind = 's' then x1.end_line else end_line end"
    h = h.selectExpr("file_path", "ver", "language", "name", "node_type", "line as start_line", f"cast(greatest(line, coalesce({end}, line)) as int) as end_line", "inner", "top", f"case when language = 'python' then {own} end as own")
    # a comment and the declaration below it are neighbours by the line they belong to
    heads = h.where("language <> 'python'").selectExpr("file_path", "ver", "top", "1 as part", "struct(language, name, node_type, start_line, end_line, inner) as h", "cast(null as string) as doc")
    docs = comment_blocks(tokens).selectExpr("file_path", "ver", "top", "0 as part", "cast(null as struct<language string, name string, node_type string, start_line int, end_line int, inner string>) as h", "doc")
    both = heads.unionByName(docs).repartition("file_path")
    both = both.selectExpr("*", "last(case when part = 0 then struct(top, doc) end, true) over (partition by file_path, ver order by top, part) as above")
    braces = both.where("part = 1 and above.top = top").selectExpr("file_path", "h.*", "above.doc as doc")
    python = h.where("own is not null").selectExpr("file_path", "language", "name", "node_type", "start_line", "end_line", "inner", "own as doc")
    return python.unionByName(braces)


# ---------------------------------------------------------------- what a documentation says

# Words that say nothing of what a function does, and sentences about the documentation itself.
EMPTY_WORDS = frozenset(
    "a an the this that these those it its is are was be been being will would can could may might shall should must do does did done has have had to of for in on at by with from into onto as and or but if then than so such not no yes all any each every some which who whom whose what when where why how here there function functions method methods routine procedure helper helpers class module file code implementation impl performs perform just simply basically returns return param params parameter parameters arg args argument arguments self cls none null nil void true false type types value values given name names note notes see also etc eg ie e g i n na".split()
)
ABOUT_ITSELF = re.compile(
    r"(?ix)^\W*(?:documentation|docs?|docstring|description|comment|doc\s+comment|placeholder|stub|undocumented|untitled|todo|fixme|tbd|tba|wip|xxx)\b"
    r"|\b(?:write|add|needs?|missing|without|no|insert|provide|complete|finish|improve|update)\s+(?:(?:a|an|the|some|any|more|proper|better|real|good|missing)\s+)*(?:documentation|docs|docstring|description|comments?)\b"
    r"|\bauto-?\s?generated\b|\bgenerated\s+by\b|\bdo\s+not\s+edit\b|\bto\s+be\s+(?:added|documented|written|done|defined|described)\b|^\W*document(?:ed)?(?:\s+(?:this|me|it))?\W*$"
    r"|\b(?:noqa|nolint|pylint|eslint|tslint|ts-ignore|type:\s*ignore|noinspection|checkstyle|prettier-ignore|istanbul|pragma|nosec|spotless)\b|^\W*(?:end)?region\b|\bcopyright\b|\ball\s+rights\s+reserved\b|\bspdx-"
)
MARK = re.compile(r"(?i)^\W*(?:TODO|FIXME|XXX|TBD|HACK)\b(?:[^:.\n]*:|\W*$)?\s*")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}\p{Nd}]*")
_FIELD = re.compile(r"(?i)^\s*(?:[@:\\](?:param|arg|argument|type|return|returns|throws|raises|exception)\b:?\s*(?:\{[^}]*\}\s*)?)?([\w$]+)\s*(?:\([^)]*\))?\s*:?\s*$")
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns|raises|yields|attributes|examples?|notes?|see also)\s*:?\s*$")


def plain(doc: str, language: str) -> str:
    """The text of a docstring or comment without its markers."""
    if language == "python":
        try:
            s = ast.literal_eval(doc)
            return s if isinstance(s, str) else ""
        except (ValueError, SyntaxError, MemoryError):
            return doc.strip("rRuUbB'\"")
    out = []
    for line in re.sub(r"\*/", "", doc).split("\n"):
        out.append(re.sub(r"^\s*(?:/\*+!?|//+[!/]?|\*+(?!\S*\*))\s?", "", line.rstrip("\r")))
    return "\n".join(out)


def _parts(name: str) -> list[str]:
    return [p.lower() for p in regex.findall(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+", name or "")]


def informative(doc: str | None, language: str, name: str, inner: str | None) -> bool:
    """Whether a documentation states something that the name and the parameter names do not."""
    if not doc:
        return False
    known = set(_parts(name)) | {name.lower()} | {p for w in (inner or "").split() for p in (*_parts(w), w.lower())}
    said = []
    for line in plain(doc, language).split("\n"):
        line = MARK.sub("", line) if MARK.match(line) else line
        if _SECTION.match(line) or ((f := _FIELD.match(line)) and (f.group(1).lower() in known or ":" in line)):
            continue
        said.append(line)
    for sentence in re.split(r"(?<=[.!?;])\s+|\n\s*\n|\n(?=\s*[-*@:])|\n", "\n".join(said)):
        if ABOUT_ITSELF.search(sentence):
            continue
        for w in _WORDS.findall(sentence):
            v = w.lower()
            if len(v) < 2 or v in EMPTY_WORDS or v in known or all(p in known or p in EMPTY_WORDS for p in _parts(w)):
                continue
            if any(len(k) > 3 and len(v) > 3 and (v.startswith(k) and len(v) - len(k) <= 3 or (v[:-1] == k[: len(v) - 1] and abs(len(k) - len(v)) <= 3) or (v.endswith("ing") and v[:-3] == k.rstrip("e"))) for k in known):
                continue
            return True
    return False


def function_docs(files: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(file_path, language, name, node_type, start_line, end_line, doc) of the functions and methods whose documentation informs.

    files has file_path, parsed_at and content; of each file the last version with a content counts, and nothing if the
    last of known validity is invalid. Nested, async and arrow functions bound to a name count, values of properties
    included, classes and constructors do not. Null and empty contents, unknown extensions and empty input give nothing;
    repeated rows count once; functions that share a name in a file have a row each.
    """

    @F.pandas_udf("boolean")
    def says(doc: pd.Series, language: pd.Series, name: pd.Series, inner: pd.Series) -> pd.Series:
        return pd.Series([informative(*x) for x in zip(doc, language, name, inner)])

    @F.pandas_udf("string")
    def clean(doc: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([plain(*x).strip() for x in zip(doc, language)])

    # the tokens are read more than once, so they are written
    tokens = (ws or Workspace(files.sparkSession)).save(token_rows(files), "tokens")
    d = documented_functions(tokens).where(says("doc", "language", "name", "inner"))
    return d.select("file_path", "language", "name", "node_type", "start_line", "end_line", clean("doc", "language").alias("doc"))
