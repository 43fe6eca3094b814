"""Lexing of Python, JavaScript, TypeScript, Go and Java, whole or in chunks.

A chunk of lines is summarised as a map: for every state in which its lexing can begin, the state in which
it ends and the brackets it leaves open or closes beyond itself. Maps of neighbouring chunks compose, and
the composition is associative, so a file may be cut anywhere and put together in any grouping.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from lodestrata.functions.code import _C_LINE, _CHR, _REGEX, _STR, _TEMPLATE, BEFORE_VALUE, PAIRS, SCRIPT

CHUNK_CHARS = 4096

# ---------------------------------------------------------------- chunks

_PY = re.compile(rf"#[^\n]*|(?P<q>'''|\"\"\")|{_STR}|{_CHR}|(?P<open>['\"])|(?P<b>[()\[\]{{}}])")
_GO = re.compile(rf"{_C_LINE}|(?P<q>/\*|`)|{_STR}|{_CHR}|(?P<open>['\"])|(?P<b>[()\[\]{{}}])")
_JAVA = re.compile(rf"{_C_LINE}|(?P<q>/\*|\"\"\")|{_STR}|{_CHR}|(?P<open>['\"])|(?P<b>[()\[\]{{}}])")
_JS = re.compile(rf"(?P<line>{_C_LINE})|(?P<q>/\*|`)|{_STR}|{_CHR}|(?P<open>['\"])|(?P<b>[()\[\]{{}}])|(?P<slash>/)")
_LAST_WORD = re.compile(r"[\w$]+$")
_RULES = {"python": _PY, "go": _GO, "java": _JAVA, "javascript": _JS, "typescript": _JS}
_ENDS = {"'''": re.compile(r"(?:[^\\']|\\[\s\S]|'(?!''))*+'''"), '"""': re.compile(r'(?:[^\\"]|\\[\s\S]|"(?!""))*+"""'), "/*": re.compile(r"[\s\S]*?\*/")}
_GO_RAW = re.compile(r"[^`]*`")
STATES = {"python": ("code", "'''", '"""'), "go": ("code", "/*", "`"), "java": ("code", "/*", '"""'), "javascript": ("code", "value", "/*", "`"), "typescript": ("code", "value", "/*", "`")}


@dataclass(frozen=True)
class Part:
    """From one entry state: exit state, brackets closed beyond the chunk, brackets left open ('$' for a template's), errors."""

    state: str
    closed: str = ""
    left: str = ""
    bad: bool = False
    again: bool = False


def _is_value(between: str, value: bool) -> bool:
    """Whether a value ends before a slash, by the words and operators since the last bracket or string."""
    between = between.rstrip()
    if not between:
        return value
    w = _LAST_WORD.search(between)
    return bool(w) and w.group() not in BEFORE_VALUE


def scan(text: str, language: str, state: str = "code") -> Part:
    """Lexes a text from a state; only strings, comments, brackets and, in scripts, slashes are looked at."""
    rule, script = _RULES[language], language in SCRIPT
    at, n, value, last = 0, len(text), state == "value", 0
    state = "code" if value else state
    closed, left, bad = [], [], False
    while at < n:
        if state != "code":
            end = (_GO_RAW if language == "go" else _TEMPLATE) if state == "`" else _ENDS[state]
            m = end.match(text, at)
            if not m:
                return Part(state, "".join(closed), "".join(left), bad)
            at = last = m.end()
            if state == "`":
                value = True
                if script and m.group(1) == "${":
                    left.append("$")
                    value = False
            state = "code"
            continue
        m = rule.search(text, at)
        if not m:
            break
        at, kind = m.end(), m.lastgroup
        if kind == "b":
            b = m.group()
            if b in "([{":
                left.append(b)
                value = False
            else:
                value = b != "}"
                if not left:
                    closed.append(b)
                elif left[-1] == "$" and b == "}":
                    left.pop()
                    state = "`"
                else:
                    bad = bad or left[-1] != PAIRS[b]
                    left.pop()
        elif kind is None:  # a string, or a comment outside scripts
            value = True
        elif kind == "q":
            state = m.group()
            if script and state == "/*":
                value = _is_value(text[last : m.start()], value)
        elif kind == "open":
            bad = True
        elif kind == "line":
            value = _is_value(text[last : m.start()], value)
        else:
            value = _is_value(text[last : m.start()], value)
            r = None if value else _REGEX.match(text, m.start())
            at, value = (r.end(), True) if r else (m.start() + 1, False)
        last = at
    if script and state == "code":
        value = _is_value(text[last:], value)
    return Part("value" if script and value and state == "code" else state, "".join(closed), "".join(left), bad)


def chunk_map(text: str, language: str, first: bool = False) -> dict[str, Part]:
    return {s: scan(text, language, s) for s in (("code",) if first else STATES[language])}


def compose(a: dict[str, Part], b: dict[str, Part]) -> dict[str, Part]:
    """The map of two neighbouring chunks as one."""
    out = {}
    for entry, x in a.items():
        y = b[x.state]
        left, closed, bad, again = list(x.left), list(y.closed), x.bad or y.bad, x.again or y.again
        while left and closed:
            if left[-1] == "$":  # text of a template follows, which the second chunk read as code
                again = True
            elif left[-1] != PAIRS[closed[0]]:
                bad = True
            left.pop()
            closed.pop(0)
        out[entry] = Part(y.state, x.closed + "".join(closed), "".join(left) + y.left, bad, again)
    return out


def balanced(maps: list[dict[str, Part]], language: str, text: str | None = None) -> bool:
    """Whether a file of these chunks ends in code, with all brackets paired."""
    p = reduce(compose, maps)["code"] if maps else Part("code")
    if p.again and text is not None:
        p = scan(text, language)
    return p.state in ("code", "value") and not (p.closed or p.left or p.bad)


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """The text cut at line ends into pieces of about size characters."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.find("\n", end)
            end = len(text) if cut < 0 else cut + 1
        out.append(text[at:end])
        at = end
    return out or [""]
