"""Tokens of source files in languages with braces, and the headers of functions among them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

# Extensions of the languages.
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "tsx": "typescript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "java": "java"}
PAIRS = {")": "(", "]": "[", "}": "{"}
SCRIPT = ("javascript", "typescript")


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


_C_LINE, _STR, _CHR = r"//[^\n]*", r"\"(?:[^\"\\\n]|\\[\s\S])*+\"", r"'(?:[^'\\\n]|\\[\s\S])*+'"
REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_REGEX = re.compile(REGEX)
_TEMPLATE = re.compile(r"(?:[^\\`$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
#: Words after which a slash begins a regular expression.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof else do yield await".split())


@dataclass
class Tokens:
    """Tokens of a text: kind, text, start and end, and whether a line ends before each.

    Kinds: w word, n number, s string, t template without code, T template part before code, r regular expression,
    o operator or bracket, c comment, x unknown. Comments are in comments only.
    """

    kind: list[str]
    text: list[str]
    start: list[int]
    end: list[int]
    newline: list[bool]
    comments: list[tuple[int, int]]
    bad: bool = False


_OPS_C = r">=|<<=?|=>|==+|!==?|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\*\*=?|\+\+|--|->|::|:=|<-|<=|\.\.\.|&\^=?|[-+*/%&|^!~=<>?:;,.()\[\]{}@]=?(?<![>=?:;,.()\[\]{}@~]=)|[-+*/%&|^!~=<>?:;,.()\[\]{}@]"
_NUM = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[a-zA-Z]?"
_WORD = r"(?:[^\W\d]|\$)[\w$]*+"
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"


def _token_rule(blank: str, word: str, number: str, string: str, template: str = "") -> re.Pattern:
    """Blanks and the token after them; l is a line end with the blank lines that follow."""
    return re.compile(rf"[{blank}]*+(?:(?P<w>{word})|(?P<n>{number})|(?P<s>{string})|{template}(?P<c>{_COMMENT})|(?P<o>{_OPS_C})|(?P<l>\n[\n{blank}]*+)|\Z|(?P<x>.))")


_TOKEN = {
    "javascript": _token_rule(" \t\r\f\v\u00a0\ufeff", "#?(?:[^\\W\\d]|[$])[\\w$\u200c\u200d]*+", rf"(?<![\w$]){_NUM}n?", f"{_STR}|{_CHR}", "(?P<t>`)|"),
    "go": _token_rule(" \t\r\ufeff", r"[^\W\d]\w*+", f"{_NUM}i?", f"{_STR}|{_CHR}|`[^`]*+`"),
    "java": _token_rule(" \t\r\f\ufeff", _WORD, f"{_NUM}[lLfFdD]?", rf"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|{_STR}|{_CHR}"),
}
_TOKEN["typescript"] = _TOKEN["javascript"]


@lru_cache(maxsize=1)
def tokenize(text: str, language: str) -> Tokens:
    """Tokens of a text in one of the languages with braces; those of the last text are kept, as its grammar and its headers both need them."""
    rule, script = _TOKEN[language], language in SCRIPT
    out = Tokens([], [], [], [], [], [])
    k, t, a, z, nl = out.kind, out.text, out.start, out.end, out.newline
    at, n, line, braces = 0, len(text), False, []

    def put(kind: str, s: str, b: int, e: int) -> None:
        nonlocal line
        k.append(kind)
        t.append(s)
        a.append(b)
        z.append(e)
        nl.append(line)
        line = False

    def template(b: int, begin: int) -> int:
        m = _TEMPLATE.match(text, begin)
        if not m:
            out.bad = True
            return n
        put("T" if m.group(1) == "${" else "t", "`", b, m.end())
        if m.group(1) == "${":
            braces.append(1)
        return m.end()

    match = rule.match
    while at < n:
        m = match(text, at)
        kind = m.lastgroup
        if kind == "w":
            k.append("w")
            t.append(m.group("w"))
            b, at = m.span("w")
            a.append(b)
            z.append(at)
            nl.append(line)
            line = False
            continue
        if kind is None:
            break
        b, at = m.span(kind)
        if kind == "l":
            line = True
        elif kind == "c":
            out.comments.append((b, at))
            line = line or text.find("\n", b, at) >= 0
        elif kind == "t":
            at = template(b, at)
        elif kind == "x":
            out.bad = True
            put("x", m.group(kind), b, at)
        elif kind == "o":
            s = m.group(kind)
            if script and s in ("/", "/="):
                last = k[-1] if k else ""
                value = last in ("n", "s", "t", "r") or (last == "w" and t[-1] not in BEFORE_VALUE) or (last == "o" and t[-1] in (")", "]", "}"))
                if not value and (r := _REGEX.match(text, b)):
                    at = r.end()
                    put("r", "/r", b, at)
                    continue
            if braces:
                if s == "{":
                    braces[-1] += 1
                elif s == "}":
                    braces[-1] -= 1
                    if not braces[-1]:
                        braces.pop()
                        put("o", "}`", b, at)
                        at = template(b, at)
                        continue
            put("o", s, b, at)
        else:
            put(kind, '"' if kind == "s" else "0", b, at)
    if braces:
        out.bad = True
    return out


_CONTROL = frozenset("if for while switch catch with return function func new throw else do case await typeof synchronized super constructor assert yield".split())
#: Words and signs before a method of a script whose return type follows its parameters.
_MEMBER = frozenset("{ } ; ) * async static public private protected get set override readonly abstract declare".split())
_JAVA_NO_TYPE = _CONTROL | frozenset("extends implements instanceof public private protected static final abstract record class enum interface import package".split())
_TYPE_TOKENS = frozenset(", . ? & [ ] < > @ extends super".split())
#: Words that may begin a declaration in a script, and words of types that another word follows or that follow another.
_MODIFIERS = frozenset("export default declare async function const let var static public private protected get set readonly override abstract accessor".split())
_TYPE_WORDS = frozenset("keyof typeof readonly infer unique asserts is extends new abstract".split())
_VALUE_WORDS = frozenset("await async void delete yield typeof new in of instanceof as satisfies".split())


class Headers:
    """Finds the headers of functions among the tokens of a text.

    values: functions that are values of properties, literals of Go, arrows of Java and methods of interfaces of Go count too.
    """

    def __init__(self, d: Tokens, language: str, values: bool = False):
        self.t, self.k, self.nl, self.language, self.values = d.text, d.kind, d.newline, language, values
        self.pair, self.around, stack = {}, {}, []  # around: the bracket around a bracket
        for i, (s, k) in enumerate(zip(d.text, d.kind)):
            if k == "o":
                if s in ("(", "[", "{"):
                    self.around[i] = stack[-1] if stack else -1
                    stack.append(i)
                elif s in (")", "]", "}") and stack:
                    self.pair[stack.pop()] = i
        self.opener = {j: i for i, j in self.pair.items()}

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.k[i] == "w"

    def before_types(self, i: int) -> int:
        """The place before the type parameters that end at a place, or that place where none do."""
        if self.at(i) == "]":
            return self.opener.get(i, i + 1) - 1
        if self.at(i) != ">":
            return i
        depth, j = 0, i
        while j >= 0:
            s = self.t[j]
            depth += (s == ">") - (s == "<")
            if depth == 0:
                return j - 1
            if s in (")", "]", "}"):
                j = self.opener.get(j, j)
            elif s in (";", "(", "{"):
                break
            j -= 1
        return i

    def body(self, j: int) -> int | None:
        """The place of the brace that opens the body after the parameters that end at j."""
        x, script = j + 1, self.language in SCRIPT
        while x < len(self.t):
            s = self.t[x]
            if s == "{":
                before = self.at(x - 1)
                if before in ("interface", "struct") or (script and x > j + 1 and before in (":", "|", "&", ",", "<", "is")):
                    x = self.pair.get(x, x) + 1
                    continue
                return x
            if s == "=>" and script:
                y = self.at(x + 1)
                if y == "{":
                    return x + 1
                if y != "(" and not (self.is_word(x + 1) and self._type_goes_on(x + 1)):
                    return None
            elif s in (";", "=", "}") or (s == ")" and x > j) or (self.nl[x] and (self.language == "go" or (script and self._ends_before(x)))):
                return None
            x = self.pair.get(x, x) + 1 if s in ("(", "[") else x + 1
        return None

    def _ends_before(self, x: int, value: bool = False) -> bool:
        """Whether a line end before a place ends a type, or a value, in a script, where no semicolon does."""
        ended = self.k[x - 1] in "nst" or self.at(x - 1) in (")", "]", "}", ">") or (self.is_word(x - 1) and self.t[x - 1] not in (_VALUE_WORDS if value else _TYPE_WORDS))
        if self.is_word(x):
            return ended and self.t[x] not in (_VALUE_WORDS - {"async", "await", "void", "delete", "yield", "typeof", "new"} if value else ("is", "extends"))
        return ended and (self.k[x] in "ns" or (self.t[x] in ("[", "@", "*") and not value))

    def end(self, j: int) -> int:
        """The last place of a function without a braced body whose parameters, or the arrow after them, end at j."""
        x, value = j + 1, self.at(j) == "=>"
        stop = (";", ")", "]", "}", "}`") if self.language == "java" else (";", ",", ")", "]", "}", "}`")
        while x < len(self.t) and self.t[x] not in stop:
            value = value or self.t[x] == "=>"
            if self.nl[x] and (self.language == "go" or (self.language in SCRIPT and self._ends_before(x, value))):
                break
            x = self.pair.get(x, x) + 1
        return x - 1

    def begin(self, n: int) -> tuple[int, list[int]]:
        """The place where the declaration of a name begins, with its modifiers, types and annotations, and the places outside brackets from there to the name."""
        x, seen = n, [n]
        while x > 0:
            p, s = x - 1, self.at(x - 1)
            q = self.opener.get(p, p) - 1 if s == ")" else p
            while self.at(q - 1) == "." and self.is_word(q):
                q -= 2
            if self.is_word(q) and self.at(q - 1) == "@":
                x = q - 1
            elif self.language == "go":
                if s == ")" and self.at(self.opener.get(p, 0) - 1) == "func":
                    x = self.opener[p] - 1
                elif s in ("func", "var"):
                    x = p
                else:
                    break
            elif s == "." and self.is_word(p - 1):
                x = p - 1
            elif self.language in SCRIPT:
                if s != "*" and s not in _MODIFIERS:
                    break
                x = p
            elif s == "]" and self.at(p - 1) == "[":
                x = p - 1
            elif s == ">" and (b := self.before_types(p)) != p:
                x = b + 1
            elif self.is_word(p) and s not in _CONTROL:
                x = p
            else:
                break
            seen.append(x)
        return x, seen

    def in_object(self, b: int) -> bool:
        """Whether a bracket is the brace of an object's properties."""
        while self.at(b) == "{":
            s = self.at(b - 1)
            if s == "=":
                e = self.before_types(b - 2)
                return not (self.is_word(e) and self.at(e - 1) == "type")
            if s == ",":
                return self.at(self.around[b]) in ("(", "[")
            if s != ":":
                return s in ("(", "[", "return", "default", "?", "??", "||", "&&")
            if not self.is_word(b - 2):
                return False
            b = self.around[b]
        return False

    def key(self, colon: int) -> int | None:
        """The place of the property whose value follows a colon."""
        n = colon - 1
        if not self.values or self.at(colon) != ":" or not self.is_word(n) or self.at(n - 1) not in ("{", ","):
            return None
        b = n - 1
        while b >= 0 and self.t[b] not in ("(", "[", "{"):
            b = self.opener.get(b, b) - 1
        return n if self.in_object(b) else None

    def bound_go(self, eq: int) -> int | None:
        """The place of the name that a function of Go without one is bound to, past a type."""
        x = eq - 1
        while x > 0 and not self.nl[x] and self.at(x) not in ("var", "{", ";"):
            x = self.opener.get(x, x) - 1
        n = x + (self.at(x) in ("var", "{", ";"))
        if self.at(n + 1) == "." or self.at(eq) == ":=":
            n = eq - 1 if self.at(n + 1) == "." or n == eq - 1 else -1
        return n if self.is_word(n) and self.t[n] not in _CONTROL and self.at(n + 1) not in (",", "[") else None

    def _type_goes_on(self, x: int) -> bool:
        """Whether an arrow of a function type is followed by one of its own: (a): (b) => c => {."""
        while x < len(self.t) and self.t[x] not in (";", "=", "{", "}", ")", ","):
            if self.t[x] == "=>":
                return True
            x = self.pair.get(x, x) + 1 if self.t[x] in ("(", "[") else x + 1
        return False

    def has_arrow(self, x: int) -> bool:
        """Whether a return type that begins at a place is followed by an arrow."""
        while x < len(self.t):
            s = self.t[x]
            if s == "=>":
                return True
            if s in (";", ",", ")", "]", "}", "="):
                return False
            x = self.pair.get(x, x) + 1 if s in ("(", "[", "{") else x + 1
        return False

    def bound(self, eq: int) -> int | None:
        """The place of the name that the value after an equals sign is bound to, past a type annotation."""
        last = eq - 1
        start = last
        while self.is_word(start) and self.at(start - 1) == "." and self.is_word(start - 2):
            start -= 2
        if self.is_word(last) and self.at(start - 1) not in (":", "|", "&", "=>", "?", "keyof", "typeof", "<", "is", "extends"):
            return last
        x = last
        while x > 0:
            s = self.t[x]
            if s in (")", "]", "}"):
                x = self.opener.get(x, x)
            elif s == ":" and self.is_word(x - 1 - (self.at(x - 1) in ("?", "!"))):
                n = x - 1 - (self.at(x - 1) in ("?", "!"))
                if self.at(n - 1) in ("const", "let", "var", ",", ";", "{", "}", "static", "readonly", "private", "public", "protected", "override", "declare") or self.nl[n] or n == 0:
                    return n
            elif s in (";", "=", "{", "(", "const", "let", "var"):
                return None
            x -= 1
        return None

    def script(self, i: int, j: int) -> tuple[str, int] | None:
        q, after = self.before_types(i - 1), self.at(j + 1)
        s, p = self.at(q), self.at(q - 1)
        if s in ("=", ":") and (after == "=>" or (after == ":" and self.has_arrow(j + 2))):
            n = self.bound(q) if s == "=" else self.key(q)
            return ("function", n) if n is not None else None
        star = s == "*" and p == "function"
        if s == "function" or star:  # a function without a name of its own
            q -= star
            q -= self.at(q - 1) == "async"
            n = self.bound(q - 1) if self.at(q - 1) == "=" else self.key(q - 1)
            return ("function", n) if n is not None else None
        if s == "async" and p in ("=", ":") and (after == "=>" or (after == ":" and self.has_arrow(j + 2))):
            n = self.bound(q - 1) if p == "=" else self.key(q - 1)
            return ("function", n) if n is not None else None
        if not self.is_word(q) or s in _CONTROL:
            return None
        if p == "function" or (p == "*" and self.at(q - 2) == "function"):
            return ("function", q) if after in ("{", ":", ";") else None
        if p in ("function", "new", ".", "?.", "extends", "implements", "=", "=>", "return", "await", "case", "throw"):
            return None
        if after == "{":
            return "method", q
        if after == ":" and self.language == "typescript" and (p in _MEMBER or (self.nl[q] and self._ends_before(q))):
            return "method", q
        return None

    def go(self, i: int, j: int) -> tuple[str, int] | None:
        q = self.before_types(i - 1)
        if self.values and q == i - 1 and self.at(q) == "func" and self.at(q - 1) in ("=", ":="):
            n = self.bound_go(q - 1)
            return ("function", n) if n is not None else None
        if not self.is_word(q) or self.at(q) in _CONTROL:
            return None
        if self.at(q - 1) == "func":
            return "function", q
        b = self.around[i]
        if self.values and self.at(b) == "{" and self.at(b - 1) == "interface" and (self.nl[q] or self.at(q - 1) in ("{", ";")):
            return "method", q
        if self.at(q - 1) == ")" and self.at(self.opener.get(q - 1, 0) - 1) == "func":
            return "method", q
        return None

    def java(self, i: int, j: int) -> tuple[str, int] | None:
        q, after = i - 1, self.at(j + 1)
        if after == "->":
            return ("function", q - 1) if self.values and self.at(q) == "=" and self.declared(q - 1) else None
        if not self.is_word(q) or self.at(q) in _CONTROL or after not in ("{", "throws", ";", "default"):
            return None
        p = self.at(q - 1)
        if self.is_word(q - 1):
            return ("method", q) if p not in _JAVA_NO_TYPE else None
        if p == "]":
            return ("method", q) if self.at(q - 2) == "[" else None
        if p == ">":
            b = self.before_types(q - 1)
            if b != q - 1 and self.at(b) != "." and all(self.k[x] == "w" or self.t[x] in _TYPE_TOKENS for x in range(b + 2, q - 1)):
                return "method", q
        return None

    def declared(self, n: int) -> bool:
        """Whether a word of Java is a variable after its type."""
        return self.is_word(n) and ((self.is_word(n - 1) and self.t[n - 1] not in _JAVA_NO_TYPE) or self.at(n - 1) in (">", "]"))

    def find(self) -> Iterator[tuple[str, int, int, int | None, str]]:
        """(node_type, place of the name, last place of the header, place of the body's brace, words of the parameters)."""
        rule = {"go": self.go, "java": self.java}.get(self.language, self.script)
        for i, (s, k) in enumerate(zip(self.t, self.k)):
            if k != "o":
                continue
            if s == "(" and i in self.pair:
                j = self.pair[i]
                if hit := rule(i, j):
                    yield *hit, j, self.body(j), " ".join(self.t[x] for x in range(i + 1, j) if self.k[x] == "w")
            elif s == ("->" if self.language == "java" else "=>") and self.is_word(i - 1):
                eq = i - 2 - (self.at(i - 2) == "async")
                if self.language == "java":
                    n = eq - 1 if self.values and self.at(eq) == "=" and self.declared(eq - 1) else None
                else:
                    n = self.bound(eq) if self.at(eq) == "=" else self.key(eq)
                if n is not None:
                    yield "function", n, i, i + 1 if self.at(i + 1) == "{" else None, self.t[i - 1]
