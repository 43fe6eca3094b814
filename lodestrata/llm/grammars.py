"""Local grammars: whether the statements of a file whose brackets pair are valid in its language.

Recursive descent over the tokens of lexing.tokenize(), without building trees. Names and types are not
looked up; a construct the grammars do not know makes a file invalid.
"""

from __future__ import annotations

import re
import sys
import warnings

from lodestrata.functions.code import _REGEX, _TEMPLATE, SCRIPT, tokenize
from lodestrata.llm.lexing import _JS, _is_value

END = "\0"
_JSX = re.compile(_JS.pattern + "|(?P<less><)")
#: Frames of a descent that a token may need.
FRAMES = 24


class Bad(Exception):
    """The tokens do not follow the grammar."""


class Parser:
    reserved: frozenset[str] = frozenset()

    def __init__(self, text: str, language: str):
        d = tokenize(text, language)
        if d.bad:
            raise Bad("token")
        self.t, self.k, self.nl, self.a, self.z = [*d.text, END, END, END], [*d.kind, "", "", ""], [*d.newline, True, True, True], [*d.start, 0, 0, 0], [*d.end, 0, 0, 0]
        self.i = 0
        self.pair = self._pairs()

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, s in enumerate(self.t):
            if self.k[i] == "o":
                if s in ("(", "[", "{"):
                    stack.append(i)
                elif s in (")", "]", "}"):
                    if not stack:
                        raise Bad("bracket")
                    out[stack.pop()] = i
        return out

    def need(self, s: str) -> None:
        if self.t[self.i] != s:
            raise Bad(s)
        self.i += 1

    def got(self, s: str) -> bool:
        if self.t[self.i] == s:
            self.i += 1
            return True
        return False

    def is_name(self, i: int | None = None) -> bool:
        i = self.i if i is None else i
        return self.k[i] == "w" and self.t[i] not in self.reserved

    def name(self) -> None:
        if not self.is_name():
            raise Bad("name")
        self.i += 1

    def word(self) -> None:
        if self.k[self.i] != "w":
            raise Bad("word")
        self.i += 1

    def attempt(self, f) -> bool:
        """Whether f succeeds here; where it does not, nothing is consumed."""
        at = self.i
        try:
            f()
            return True
        except Bad:
            self.i = at
            return False

    def listed(self, close: str, item) -> None:
        """Items with commas up to close, which is consumed; a last comma is allowed."""
        while self.t[self.i] != close:
            item()
            if not self.got(","):
                break
        self.need(close)


class Script(Parser):
    """JavaScript, and TypeScript where typed is set."""

    reserved = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
    BINARY = frozenset("+ - * / % ** == != === !== < <= >= << & | ^ && || ?? in instanceof".split())
    ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
    MODIFIERS = frozenset("static async get set public private protected readonly abstract override declare accessor".split())

    def __init__(self, text: str, language: str):
        super().__init__(text, language)
        self.typed = language == "typescript"

    def file(self) -> None:
        while self.t[self.i] != END:
            self.statement()

    def semicolon(self) -> None:
        s = self.t[self.i]
        if s == ";":
            self.i += 1
        elif not (s in ("}", END) or self.nl[self.i]):
            raise Bad("semicolon")

    def block(self) -> None:
        self.need("{")
        while self.t[self.i] not in ("}", END):
            self.statement()
        self.need("}")

    def statement(self) -> None:
        s, nxt = self.t[self.i], self.t[self.i + 1]
        if self.k[self.i] == "w":
            f = getattr(self, f"s_{s}", None)
            if f and not (s == "import" and nxt in ("(", ".")):
                return f()
            if s == "let" and (self.k[self.i + 1] == "w" or nxt in ("[", "{")) and nxt not in ("in", "instanceof", "of"):
                return self.s_var()
            if s == "async" and nxt == "function" and not self.nl[self.i + 1]:
                self.i += 1
                return self.s_function()
            if nxt == ":" and s not in self.reserved:
                self.i += 2
                return self.statement()
            if self.typed and self.k[self.i + 1] in ("w", "s") and not self.nl[self.i + 1]:
                if s == "type":
                    self.i += 1
                    self.name()
                    self.type_params()
                    self.need("=")
                    self.type()
                    return self.semicolon()
                if s == "interface":
                    self.i += 1
                    self.name()
                    self.type_params()
                    if self.got("extends"):
                        self.type()
                        while self.got(","):
                            self.type()
                    return self.type_body()
                if s in ("declare", "abstract"):
                    self.i += 1
                    return self.ambient() if s == "declare" else self.statement()
                if s in ("namespace", "module"):
                    self.i += 2
                    while self.got("."):
                        self.word()
                    return self.block()
        if s == "{":
            return self.block()
        if s == ";":
            self.i += 1
            return None
        if s == "@":
            self.decorators()
            return self.statement()
        self.expression()
        return self.semicolon()

    def ambient(self) -> None:
        if self.t[self.i] in ("var", "let", "const"):
            self.i += 1
            self.pattern()
            if self.got(":"):
                self.type()
            return self.semicolon()
        return self.statement()

    def s_var(self) -> None:
        constant = self.t[self.i] == "const"
        self.i += 1
        if constant and self.t[self.i] == "enum" and self.typed:
            return self.s_enum()
        self.bindings(constant)
        return self.semicolon()

    s_const = s_var

    def bindings(self, initial: bool = False) -> None:
        while True:
            self.pattern()
            if self.typed:
                self.got("!")
                if self.got(":"):
                    self.type()
            if self.got("="):
                self.assign()
            elif initial:
                raise Bad("const")
            if not self.got(","):
                return

    def s_enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")

        def member() -> None:
            self.key()
            if self.got("="):
                self.assign()

        self.listed("}", member)

    def s_function(self) -> None:
        self.need("function")
        self.got("*")
        self.name()
        self.signature()
        if self.t[self.i] == "{":
            self.block()
        elif self.typed:
            self.semicolon()
        else:
            raise Bad("body")

    def signature(self) -> None:
        self.type_params()
        self.need("(")
        self.listed(")", self.param)
        if self.typed and self.got(":"):
            self.type()

    def param(self) -> None:
        self.decorators()
        if self.typed:
            while self.t[self.i] in ("public", "private", "protected", "readonly", "override") and (self.k[self.i + 1] == "w" or self.t[self.i + 1] in ("{", "[")):
                self.i += 1
        self.got("...")
        if self.typed and self.t[self.i] == "this":
            self.i += 1
        else:
            self.pattern()
        if self.typed:
            self.got("?")
            if self.got(":"):
                self.type()
        if self.got("="):
            self.assign()

    def pattern(self) -> None:
        if self.got("["):
            while self.t[self.i] != "]":
                if self.got(","):
                    continue
                self.got("...")
                self.pattern()
                if self.got("="):
                    self.assign()
                if self.t[self.i] != "]":
                    self.need(",")
            self.need("]")
        elif self.got("{"):

            def prop() -> None:
                if self.got("..."):
                    return self.pattern()
                plain = self.is_name()
                self.key()
                if self.got(":"):
                    self.pattern()
                elif not plain:
                    raise Bad("pattern")
                if self.got("="):
                    self.assign()
                return None

            self.listed("}", prop)
        else:
            self.name()

    def decorators(self) -> None:
        while self.got("@"):
            if self.got("("):
                self.expression()
                self.need(")")
                continue
            self.name()
            while self.got("."):
                self.word()
            if self.t[self.i] == "(":
                self.arguments()

    def s_class(self) -> None:
        self.need("class")
        if self.is_name() and not (self.t[self.i] == "implements" and self.typed and self.t[self.i + 1] != "{"):
            self.i += 1
            self.type_params()
        if self.got("extends"):
            self.left_side()
            if self.typed and self.t[self.i] == "<":
                self.type_args()
        if self.typed and self.got("implements"):
            self.type()
            while self.got(","):
                self.type()
        self.need("{")
        while not self.got("}"):
            self.member()

    def member(self) -> None:
        if self.got(";"):
            return
        self.decorators()
        if self.t[self.i] == "static" and self.t[self.i + 1] == "{":
            self.i += 1
            return self.block()
        while self.t[self.i] in self.MODIFIERS and (self.k[self.i + 1] in ("w", "s", "n") or self.t[self.i + 1] in ("[", "*", "#")) and (self.typed or self.t[self.i] in ("static", "async", "get", "set", "accessor")):
            self.i += 1
        self.got("*")
        if self.typed and self.t[self.i] == "[" and self.k[self.i + 1] == "w" and self.t[self.i + 2] == ":":
            self.index_signature()
            return self.semicolon()
        self.key()
        if self.typed:
            self.got("?") or self.got("!")
        if self.t[self.i] in ("(", "<"):
            self.signature()
            if self.t[self.i] == "{":
                return self.block()
            if self.typed:
                return self.semicolon()
            raise Bad("body")
        if self.typed and self.got(":"):
            self.type()
        if self.got("="):
            self.assign()
        return self.semicolon()

    def index_signature(self) -> None:
        self.i += 3
        self.type()
        self.need("]")
        self.need(":")
        self.type()

    def key(self) -> None:
        if self.got("["):
            self.assign()
            self.need("]")
        elif self.k[self.i] in ("w", "s", "n"):
            self.i += 1
        else:
            raise Bad("key")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.got("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    s_with = s_while

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.got(";")

    def s_for(self) -> None:
        self.i += 1
        self.got("await")
        self.need("(")
        end = self.pair[self.i - 1]
        if self.t[self.i] in ("var", "let", "const") and (self.k[self.i + 1] == "w" or self.t[self.i + 1] in ("[", "{")):
            self.i += 1

            def each() -> None:
                self.pattern()
                if self.typed and self.got(":"):
                    self.type()
                if self.t[self.i] not in ("of", "in"):
                    raise Bad("for")
                self.i += 1
                self.expression()
                if self.i != end:
                    raise Bad("for")

            if self.attempt(each):
                self.i += 1
                return self.statement()
            self.bindings()
        elif self.t[self.i] != ";":

            def over() -> None:
                self.left_side()
                if self.t[self.i] not in ("of", "in"):
                    raise Bad("for")
                self.i += 1
                self.expression()
                if self.i != end:
                    raise Bad("for")

            if self.attempt(over):
                self.i += 1
                return self.statement()
            self.expression()
        self.need(";")
        if self.t[self.i] != ";":
            self.expression()
        self.need(";")
        if self.i != end:
            self.expression()
        self.need(")")
        return self.statement()

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.got("}"):
            if self.got("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.t[self.i] not in ("case", "default", "}"):
                self.statement()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        caught = False
        if self.got("catch"):
            caught = True
            if self.got("("):
                self.pattern()
                if self.typed and self.got(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.got("finally"):
            self.block()
        elif not caught:
            raise Bad("try")

    def s_return(self) -> None:
        self.i += 1
        if self.t[self.i] not in (";", "}", END) and not self.nl[self.i]:
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            raise Bad("throw")
        self.expression()
        self.semicolon()

    def s_break(self) -> None:
        self.i += 1
        if self.is_name() and not self.nl[self.i]:
            self.i += 1
        self.semicolon()

    s_continue = s_debugger = s_break

    def names_in_braces(self) -> None:
        def one() -> None:
            if self.typed and self.t[self.i] == "type" and self.k[self.i + 1] == "w" and self.t[self.i + 1] != "as":
                self.i += 1
            if self.k[self.i] not in ("w", "s"):
                raise Bad("name")
            self.i += 1
            if self.got("as"):
                if self.k[self.i] not in ("w", "s"):
                    raise Bad("name")
                self.i += 1

        self.need("{")
        self.listed("}", one)

    def source(self) -> None:
        self.need("from")
        if self.k[self.i] != "s":
            raise Bad("source")
        self.i += 1
        if self.t[self.i] in ("with", "assert") and self.t[self.i + 1] == "{":
            self.i += 1
            self.object()

    def s_import(self) -> None:
        self.i += 1
        if self.k[self.i] == "s":
            self.i += 1
            return self.semicolon()
        if self.typed and self.t[self.i] == "type" and (self.t[self.i + 1] in ("{", "*") or (self.k[self.i + 1] == "w" and self.t[self.i + 1] != "from")):
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.typed and self.got("="):
                self.expression()
                return self.semicolon()
            if not self.got(","):
                self.source()
                return self.semicolon()
        if self.got("*"):
            self.need("as")
            self.name()
        else:
            self.names_in_braces()
        self.source()
        return self.semicolon()

    def s_export(self) -> None:
        self.i += 1
        if self.got("default"):
            if self.t[self.i] in ("function", "class", "@", "abstract") or (self.t[self.i] == "async" and self.t[self.i + 1] == "function"):
                self.got("async")
                if self.t[self.i] == "function":
                    return self.function()
                self.got("abstract")
                self.decorators()
                return self.s_class()
            if self.typed and self.t[self.i] == "interface":
                return self.statement()
            self.assign()
            return self.semicolon()
        if self.got("*"):
            if self.got("as"):
                self.word()
            self.source()
            return self.semicolon()
        if self.typed and self.got("="):
            self.expression()
            return self.semicolon()
        if self.typed and self.t[self.i] == "type" and self.t[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.t[self.i] == "{":
            self.names_in_braces()
            if self.t[self.i] == "from":
                self.source()
            return self.semicolon()
        if self.t[self.i] in ("var", "let", "const", "function", "class", "async", "@", "enum", "interface", "type", "namespace", "module", "abstract", "declare"):
            return self.statement()
        raise Bad("export")

    # expressions

    def expression(self) -> None:
        self.assign()
        while self.got(","):
            self.assign()

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        at = self.i
        if self.t[at] == "async" and not self.nl[at + 1] and (self.t[at + 1] in ("(", "<") or (self.is_name(at + 1) and self.t[at + 2] == "=>")):
            at += 1
        if self.is_name(at) and self.t[at + 1] == "=>":
            self.i = at + 2
        elif self.t[at] == "(" and (self.t[self.pair[at] + 1] == "=>" or (self.typed and self.t[self.pair[at] + 1] == ":")) or (self.t[at] == "<" and self.typed):

            def head() -> None:
                self.i = at
                self.signature()
                self.need("=>")

            if not self.attempt(head):
                return False
        else:
            return False
        if self.t[self.i] == "{":
            self.block()
        else:
            self.assign()
        return True

    def assign(self) -> None:
        if self.arrow():
            return
        if self.t[self.i] == "yield" and (self.t[self.i + 1] in (";", ")", "]", "}", ",", ":", END) or self.nl[self.i + 1]):
            self.i += 1
            return
        self.binary()
        if self.t[self.i] == "?":
            self.i += 1
            self.assign()
            self.need(":")
            self.assign()
        elif self.t[self.i] in self.ASSIGN:
            if self.k[self.i - 1] not in ("w",) and self.t[self.i - 1] not in ("]", "}", ")"):
                raise Bad("target")
            self.i += 1
            self.assign()

    def binary(self) -> None:
        self.unary()
        while True:
            s = self.t[self.i]
            if s == ">":
                self.i += 1
                while self.t[self.i] == ">" and self.a[self.i] == self.z[self.i - 1]:
                    self.i += 1
                self.got("=") if self.a[self.i] == self.z[self.i - 1] else None
            elif s == ">=" or s in self.BINARY:
                self.i += 1
            elif self.typed and s in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.got("const"):
                    self.type()
                continue
            else:
                return
            self.unary()

    def unary(self) -> None:
        while self.t[self.i] in ("+", "-", "!", "~", "++", "--", "typeof", "void", "delete") or (self.t[self.i] in ("await", "yield") and not (self.t[self.i + 1] in (")", ";", ",", "=", ".", "]", "=>", "}"))):
            self.i += 1
            if self.t[self.i - 1] == "yield":
                self.got("*")
        self.left_side()
        if self.t[self.i] in ("++", "--") and not self.nl[self.i]:
            self.i += 1

    def arguments(self) -> None:
        self.need("(")

        def one() -> None:
            self.got("...")
            self.assign()

        self.listed(")", one)

    def left_side(self) -> None:
        self.primary()
        while True:
            s = self.t[self.i]
            if s == ".":
                self.i += 1
                self.word()
            elif s == "?.":
                self.i += 1
                if self.t[self.i] not in ("(", "["):
                    self.word()
            elif s == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif s == "(":
                self.arguments()
            elif self.k[self.i] in ("t", "T"):
                self.template()
            elif self.typed and s == "!" and not self.nl[self.i]:
                self.i += 1
            elif self.typed and s == "<":

                def call() -> None:
                    self.type_args()
                    if self.t[self.i] != "(" and self.k[self.i] not in ("t", "T"):
                        raise Bad("call")

                if not self.attempt(call):
                    return
            else:
                return

    def template(self) -> None:
        while self.k[self.i] == "T":
            self.i += 1
            self.expression()
            self.need("}`")
        if self.k[self.i] != "t":
            raise Bad("template")
        self.i += 1

    def function(self) -> None:
        self.need("function")
        self.got("*")
        if self.is_name():
            self.i += 1
        self.signature()
        self.block()

    def primary(self) -> None:
        s, k = self.t[self.i], self.k[self.i]
        if k in ("n", "s", "r"):
            self.i += 1
        elif k in ("t", "T"):
            self.template()
        elif s == "(":
            self.i += 1
            self.expression()
            self.need(")")
        elif s == "[":
            self.i += 1
            while self.t[self.i] != "]":
                if self.got(","):
                    continue
                self.got("...")
                self.assign()
                if self.t[self.i] != "]":
                    self.need(",")
            self.i += 1
        elif s == "{":
            self.object()
        elif s == "function":
            self.function()
        elif s == "async" and self.t[self.i + 1] == "function":
            self.i += 1
            self.function()
        elif s in ("class", "@"):
            self.decorators()
            self.s_class()
        elif s == "new":
            self.i += 1
            if self.got("."):
                return self.word()
            if self.t[self.i] == "new":
                return self.primary()
            self.primary()
            while True:
                if self.got("."):
                    self.word()
                elif self.got("["):
                    self.expression()
                    self.need("]")
                else:
                    break
            if self.typed and self.t[self.i] == "<":
                self.attempt(self.type_args)
            if self.t[self.i] == "(":
                self.arguments()
        elif s == "import":
            self.i += 1
            if self.got("."):
                return self.word()
            if self.t[self.i] != "(":
                raise Bad("import")
        elif s in ("this", "super", "null", "true", "false") or self.is_name():
            self.i += 1
        else:
            raise Bad(s)
        return None

    def object(self) -> None:
        self.need("{")

        def prop() -> None:
            if self.got("..."):
                return self.assign()
            while self.t[self.i] in ("async", "get", "set") and (self.k[self.i + 1] in ("w", "s", "n") or self.t[self.i + 1] in ("[", "*")):
                self.i += 1
            self.got("*")
            plain = self.is_name()
            self.key()
            if self.t[self.i] in ("(", "<"):
                self.signature()
                return self.block()
            if self.got(":"):
                return self.assign()
            if not plain:
                raise Bad("property")
            if self.got("="):
                return self.assign()
            return None

        self.listed("}", prop)

    # types

    def type_params(self) -> None:
        if not self.typed or not self.got("<"):
            return

        def one() -> None:
            while self.t[self.i] in ("const", "in", "out") and self.k[self.i + 1] == "w":
                self.i += 1
            self.name()
            if self.got("extends"):
                self.type()
            if self.got("="):
                self.type()

        self.listed(">", one)

    def type_args(self) -> None:
        self.need("<")
        self.listed(">", self.type)

    def type(self) -> None:
        if self.t[self.i] == "<" or (self.t[self.i] == "(" and self.t[self.pair[self.i] + 1] == "=>") or self.t[self.i] == "new" or (self.t[self.i] == "abstract" and self.t[self.i + 1] == "new"):
            self.got("abstract")
            self.got("new")
            self.type_params()
            self.need("(")
            self.listed(")", self.param)
            self.need("=>")
            return self.type()
        self.got("|") or self.got("&")
        self.type_part()
        while self.t[self.i] in ("|", "&"):
            self.i += 1
            self.type_part()
        if self.t[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            self.type()
            if self.got("?"):
                self.type()
                self.need(":")
                self.type()
        return None

    def type_part(self) -> None:
        while self.t[self.i] in ("keyof", "readonly", "unique", "infer", "asserts") and (self.k[self.i + 1] in ("w", "s") or self.t[self.i + 1] in ("(", "{", "[")) and self.t[self.i + 1] not in ("is", "extends"):
            self.i += 1
        s, k = self.t[self.i], self.k[self.i]
        if k in ("s", "n"):
            self.i += 1
        elif k in ("t", "T"):
            while self.k[self.i] == "T":
                self.i += 1
                self.type()
                self.need("}`")
            self.i += 1
        elif s == "-" and self.k[self.i + 1] == "n":
            self.i += 2
        elif s == "(":
            if self.t[self.pair[self.i] + 1] == "=>":
                return self.type()
            self.i += 1
            self.type()
            self.need(")")
        elif s == "[":
            self.i += 1

            def one() -> None:
                self.got("...")
                if self.k[self.i] == "w" and (self.t[self.i + 1] == ":" or (self.t[self.i + 1] == "?" and self.t[self.i + 2] == ":")):
                    self.i += 1
                    self.got("?")
                    self.i += 1
                self.type()
                self.got("?")

            self.listed("]", one)
        elif s == "{":
            self.type_body()
        elif s == "typeof":
            self.i += 1
            self.word()
            while self.got("."):
                self.word()
            if self.t[self.i] == "<":
                self.type_args()
        elif k == "w" and (s not in self.reserved or s in ("void", "null", "true", "false", "this", "import")):
            self.i += 1
            if s == "import":
                self.arguments()
            while self.got("."):
                self.word()
            if self.t[self.i] == "<" and not self.nl[self.i]:
                self.type_args()
            if self.t[self.i] == "is" and not self.nl[self.i]:
                self.i += 1
                self.type()
        else:
            raise Bad("type")
        while self.t[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if self.t[self.i] != "]":
                self.type()
            self.need("]")
        return None

    def type_body(self) -> None:
        self.need("{")
        while not self.got("}"):
            if self.t[self.i] in ("+", "-"):
                self.i += 1
            while self.t[self.i] in ("readonly", "get", "set") and (self.k[self.i + 1] in ("w", "s") or self.t[self.i + 1] == "["):
                self.i += 1
            if self.t[self.i] == "[" and self.k[self.i + 1] == "w" and self.t[self.i + 2] in (":", "in"):
                self.i += 3
                self.type()
                if self.got("as"):
                    self.type()
                self.need("]")
            elif self.t[self.i] not in ("(", "<") and not (self.t[self.i] == "new" and self.t[self.i + 1] in ("(", "<")):
                self.key()
            else:
                self.got("new")
            self.got("+") or self.got("-")
            self.got("?")
            if self.t[self.i] in ("(", "<"):
                self.signature()
            elif self.got(":"):
                self.type()
            if not (self.got(",") or self.got(";")) and self.t[self.i] != "}" and not self.nl[self.i]:
                raise Bad("member")


class Go(Parser):
    reserved = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    BINARY = frozenset("+ - * / % == != < <= > >= << & | ^ && || &^".split())
    ASSIGN = frozenset("= := += -= *= /= %= <<= >>= &= |= ^= &^=".split())

    def __init__(self, text: str, language: str):
        super().__init__(text, language)
        self.no_type: set[int] = set()
        # a line end after these ends a statement
        t, k = [], []
        for i, s in enumerate(self.t[:-3]):
            if t and self.nl[i] and self._ends(t[-1], k[-1]):
                t.append(";")
                k.append("o")
            if s == ">" and t and t[-1] == ">" and self.a[i] == self.z[i - 1]:
                t[-1] = ">>"
                continue
            if s in ("=", ">=") and t and t[-1] == ">>" and self.a[i] == self.z[i - 1]:
                t[-1] = ">>="
                continue
            t.append(s)
            k.append(self.k[i])
        if t and self._ends(t[-1], k[-1]):
            t.append(";")
            k.append("o")
        self.t, self.k = [*t, END, END, END], [*k, "", "", ""]
        self.pair = self._pairs()

    def _ends(self, s: str, k: str) -> bool:
        return k in ("n", "s") or s in ("++", "--", ")", "]", "}") or (k == "w" and (s not in self.reserved or s in ("break", "continue", "fallthrough", "return")))

    def semicolon(self) -> None:
        if self.t[self.i] not in (")", "}"):
            self.need(";")

    def file(self) -> None:
        self.need("package")
        self.name()
        self.need(";")
        while self.got("import"):
            self.group(self.import_spec)
            self.need(";")
        while self.t[self.i] != END:
            s = self.t[self.i]
            if s == "func":
                self.i += 1
                if self.t[self.i] == "(":
                    self.params()
                self.name()
                if self.t[self.i] == "[":
                    self.type_params()
                self.signature()
                if self.t[self.i] == "{":
                    self.block()
            elif s in ("type", "var", "const"):
                self.declaration()
            else:
                raise Bad(s)
            self.need(";")

    def group(self, item) -> None:
        if self.got("("):
            while not self.got(")"):
                item()
                self.semicolon()
        else:
            item()

    def import_spec(self) -> None:
        if self.is_name() or self.t[self.i] == ".":
            self.i += 1
        if self.k[self.i] != "s":
            raise Bad("import")
        self.i += 1

    def declaration(self) -> None:
        s = self.t[self.i]
        self.i += 1
        self.group(self.type_spec if s == "type" else self.value_spec)

    def type_spec(self) -> None:
        self.name()
        if self.t[self.i] == "[" and self.is_name(self.i + 1) and self.t[self.i + 2] != "]":
            self.type_params()
        self.got("=")
        self.type()

    def type_params(self) -> None:
        self.need("[")

        def one() -> None:
            self.name()
            if self.t[self.i] not in (",", "]"):
                self.union()

        self.listed("]", one)

    def union(self) -> None:
        while True:
            self.got("~")
            self.type()
            if not self.got("|"):
                return

    def value_spec(self) -> None:
        self.name()
        while self.got(","):
            self.name()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
        if self.got("="):
            self.expressions()

    def params(self) -> None:
        self.need("(")

        def one() -> None:
            self.got("...")
            self.type()
            if self.t[self.i] not in (",", ")"):
                self.got("...")
                self.type()

        self.listed(")", one)

    def signature(self) -> None:
        self.params()
        if self.t[self.i] == "(":
            self.params()
        elif self.t[self.i] in ("*", "[", "func", "map", "chan", "struct", "interface", "<-") or self.is_name():
            self.type()

    def type(self) -> None:
        """A type; where one has failed before, on another path, it is not tried again."""
        at = self.i
        if at in self.no_type:
            raise Bad("type")
        try:
            self.any_type()
        except Bad:
            self.no_type.add(at)
            raise

    def any_type(self) -> None:
        s = self.t[self.i]
        if s == "*":
            self.i += 1
            self.type()
        elif s == "[":
            self.i += 1
            if not self.got("]"):
                if not self.got("..."):
                    self.expr()
                self.need("]")
            self.type()
        elif s == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif s in ("chan", "<-"):
            self.i += 1
            if s == "<-":
                self.need("chan")
            self.got("<-")
            self.type()
        elif s == "func":
            self.i += 1
            self.signature()
        elif s == "struct":
            self.i += 1
            self.need("{")
            while not self.got("}"):
                self.got("*")
                self.name()
                if self.got("."):
                    self.name()
                elif self.t[self.i] not in (";", "}") and self.k[self.i] != "s":
                    while self.got(","):
                        self.name()
                    self.type()
                if self.k[self.i] == "s":
                    self.i += 1
                self.semicolon()
        elif s == "interface":
            self.i += 1
            self.need("{")
            while not self.got("}"):
                if self.is_name() and self.t[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.union()
                self.semicolon()
        elif s == "(":
            self.i += 1
            self.type()
            self.need(")")
        else:
            self.name()
            if self.got("."):
                self.name()
            if self.t[self.i] == "[" and self.t[self.i + 1] != "]":

                def args() -> None:
                    self.need("[")
                    self.listed("]", self.type)

                self.attempt(args)

    def block(self) -> None:
        self.need("{")
        while not self.got("}"):
            self.statement()
            self.semicolon()

    def statement(self) -> None:
        s = self.t[self.i]
        if s in (";", "}"):
            return None
        if s in ("var", "const", "type"):
            return self.declaration()
        if s == "{":
            return self.block()
        if s == "return":
            self.i += 1
            if self.t[self.i] not in (";", "}"):
                self.expressions()
            return None
        if s in ("break", "continue", "goto"):
            self.i += 1
            if self.is_name():
                self.i += 1
            elif s == "goto":
                raise Bad("goto")
            return None
        if s == "fallthrough":
            self.i += 1
            return None
        if s in ("go", "defer"):
            self.i += 1
            self.expr()
            if self.t[self.i - 1] != ")":
                raise Bad("call")
            return None
        if s == "if":
            self.i += 1
            self.header(True)
            self.block()
            if self.got("else"):
                if self.t[self.i] not in ("if", "{"):
                    raise Bad("else")
                return self.statement()
            return None
        if s == "for":
            self.i += 1
            self.for_header()
            return self.block()
        if s in ("switch", "select"):
            self.i += 1
            if self.t[self.i] != "{":
                if s == "select":
                    raise Bad("select")
                self.header(False)
            self.need("{")
            while not self.got("}"):
                if self.got("case"):
                    if s == "select":
                        self.simple(True)
                    else:
                        self.case_item()
                        while self.got(","):
                            self.case_item()
                else:
                    self.need("default")
                self.need(":")
                while self.t[self.i] not in ("case", "default", "}"):
                    self.statement()
                    self.semicolon()
            return None
        if self.is_name() and self.t[self.i + 1] == ":":
            self.i += 2
            return None if self.t[self.i] in (";", "}") else self.statement()
        return self.simple(True)

    def case_item(self) -> None:
        if not self.attempt(lambda: (self.expr(), self.follows(",", ":"))):
            self.type()

    def follows(self, *texts: str) -> None:
        if self.t[self.i] not in texts:
            raise Bad("after")

    def simple(self, composite: bool) -> None:
        at = self.i
        self.expressions(composite)
        s = self.t[self.i]
        if s in self.ASSIGN:
            self.i += 1
            if self.got("range"):
                return self.expr(composite)
            return self.expressions(composite)
        if s in ("++", "--"):
            self.i += 1
            return None
        if s == "<-":
            self.i += 1
            return self.expr(composite)
        if self.t[self.i - 1] != ")" and composite and self.t[at] != "<-":
            raise Bad("statement")
        return None

    def header(self, condition: bool) -> None:
        if self.t[self.i] != ";":
            self.simple(False)
        elif condition and self.t[self.i + 1] == "{":
            raise Bad("condition")
        if self.got(";") and self.t[self.i] != "{":
            self.simple(False)

    def for_header(self) -> None:
        if self.t[self.i] == "{":
            return
        if self.got("range"):
            return self.expr(False)
        if self.t[self.i] != ";":
            self.simple(False)
        if self.got(";"):
            if self.t[self.i] != ";":
                self.expr(False)
            self.need(";")
            if self.t[self.i] != "{":
                self.simple(False)
        return None

    def expressions(self, composite: bool = True) -> None:
        self.expr(composite)
        while self.got(","):
            self.expr(composite)

    def expr(self, composite: bool = True) -> None:
        self.unary(composite)
        while self.t[self.i] in self.BINARY or self.t[self.i] == ">>":
            self.i += 1
            self.unary(composite)

    def unary(self, composite: bool) -> None:
        while self.t[self.i] in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.i += 1
        self.primary(composite)

    def primary(self, composite: bool) -> None:
        s, k = self.t[self.i], self.k[self.i]
        literal = False
        if k in ("n", "s"):
            self.i += 1
        elif s == "(":
            self.i += 1
            if not self.attempt(lambda: (self.expr(), self.need(")"))):
                self.type()
                self.need(")")
        elif s == "func":
            self.i += 1
            self.signature()
            if self.t[self.i] == "{":
                self.block()
        elif s in ("[", "map", "struct", "chan", "interface"):
            self.type()
            literal = True
        else:
            self.name()
            literal = composite
        while True:
            s = self.t[self.i]
            if s == ".":
                self.i += 1
                if self.got("("):
                    if not self.got("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif s == "(":
                self.i += 1

                def arg() -> None:
                    if not self.attempt(lambda: (self.expr(), self.got("..."), self.follows(",", ")"))):
                        self.type()

                self.listed(")", arg)
                literal = False
            elif s == "[":
                self.i += 1

                def index() -> None:
                    if self.t[self.i] != ":":
                        self.expr()
                    while self.got(":"):
                        if self.t[self.i] not in (":", "]"):
                            self.expr()
                    self.need("]")

                if not self.attempt(index):
                    self.listed("]", self.type)
                literal = literal and composite
            elif s == "{" and literal:
                self.literal()
                literal = False
            else:
                return

    def literal(self) -> None:
        self.need("{")

        def item() -> None:
            self.literal() if self.t[self.i] == "{" else self.expr()
            if self.got(":"):
                self.literal() if self.t[self.i] == "{" else self.expr()

        self.listed("}", item)


class Java(Parser):
    reserved = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
    PRIMITIVE = frozenset("boolean byte char short int long float double".split())
    MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
    BINARY = frozenset("+ - * / % == != < <= >= << & | ^ && ||".split())
    ASSIGN = frozenset("= += -= *= /= %= <<= &= |= ^=".split())

    def file(self) -> None:
        at = self.i
        self.modifiers()
        if self.got("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = at
        while self.t[self.i] in ("import", ";"):
            if self.got(";"):
                continue
            self.i += 1
            self.got("static")
            self.qualified(star=True)
            self.need(";")
        main = loose = False
        while self.t[self.i] != END:
            if self.got(";"):
                continue
            self.modifiers()
            if self.is_type_declaration():
                self.type_declaration()
                continue
            # members without a class, which a file with a main method may have
            loose = True
            self.type_params()
            if not self.got("void"):
                self.type()
            main = main or (self.t[self.i] == "main" and self.t[self.i + 1] == "(")
            self.name()
            if self.t[self.i] == "(":
                self.method_rest()
            else:
                self.declarators()
                self.need(";")
        if loose and not main:
            raise Bad("declaration")

    def qualified(self, star: bool = False) -> None:
        self.name()
        while self.got("."):
            if star and self.got("*"):
                return
            self.name()

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.got("("):

            def one() -> None:
                if self.is_name() and self.t[self.i + 1] == "=":
                    self.i += 2
                self.annotation_value()

            self.listed(")", one)

    def annotation_value(self) -> None:
        if self.t[self.i] == "@":
            self.annotation()
        elif self.got("{"):
            self.listed("}", self.annotation_value)
        else:
            self.conditional()

    def modifiers(self) -> None:
        while True:
            if self.t[self.i] == "@" and self.t[self.i + 1] != "interface":
                self.annotation()
            elif self.t[self.i] in self.MODIFIERS and not (self.t[self.i] == "default" and self.t[self.i + 1] in (":", "->")):
                self.i += 1
            elif self.t[self.i] == "non" and self.t[self.i + 1] == "-" and self.t[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def is_type_declaration(self) -> bool:
        s = self.t[self.i]
        return s in ("class", "interface", "enum") or (s == "@" and self.t[self.i + 1] == "interface") or (s == "record" and self.is_name(self.i + 1) and self.t[self.i + 2] in ("(", "<"))

    def type_declaration(self) -> None:
        if not self.is_type_declaration():
            raise Bad("declaration")
        s = self.t[self.i]
        self.i += 2 if s == "@" else 1
        self.name()
        self.type_params()
        if s == "record":
            self.need("(")
            self.listed(")", self.param)
        for word in ("extends", "implements", "permits"):
            if self.got(word):
                self.type()
                while self.got(","):
                    self.type()
        self.need("{")
        if s == "enum":
            while self.t[self.i] not in (";", "}"):
                self.modifiers()
                self.name()
                if self.t[self.i] == "(":
                    self.arguments()
                if self.t[self.i] == "{":
                    self.i += 1
                    self.members()
                if not self.got(","):
                    break
            if not self.got(";"):
                return self.need("}")
        return self.members()

    def type_params(self) -> None:
        if self.got("<"):

            def one() -> None:
                self.modifiers()
                self.name()
                if self.got("extends"):
                    self.type()
                    while self.got("&"):
                        self.type()

            self.listed(">", one)

    def members(self) -> None:
        while not self.got("}"):
            if self.got(";"):
                continue
            if self.t[self.i] == "{" or (self.t[self.i] == "static" and self.t[self.i + 1] == "{"):
                self.got("static")
                self.block()
                continue
            self.modifiers()
            if self.is_type_declaration():
                self.type_declaration()
                continue
            self.type_params()
            self.modifiers()
            if self.is_name() and self.t[self.i + 1] in ("(", "{"):
                self.i += 1
                if self.t[self.i] == "(":
                    self.method_rest()
                else:
                    self.block()
                continue
            if not self.got("void"):
                self.type()
            self.name()
            if self.t[self.i] == "(":
                self.method_rest()
            else:
                self.declarators()
                self.need(";")

    def method_rest(self) -> None:
        self.need("(")
        self.listed(")", self.param)
        self.dims()
        if self.got("throws"):
            self.type()
            while self.got(","):
                self.type()
        if self.got("default"):
            self.annotation_value()
        if self.t[self.i] == "{":
            self.block()
        else:
            self.need(";")

    def param(self) -> None:
        self.modifiers()
        self.type()
        self.modifiers()
        self.got("...")
        if self.got("this"):
            return
        self.name()
        self.dims()

    def dims(self) -> None:
        while self.t[self.i] == "[" and self.t[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.got("="):
                self.initializer()
            if not self.got(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.got("{"):
            self.listed("}", self.initializer)
        else:
            self.expression()

    def type(self) -> None:
        self.modifiers() if self.t[self.i] == "@" else None
        if self.t[self.i] in self.PRIMITIVE:
            self.i += 1
        elif self.got("?"):
            if self.t[self.i] in ("extends", "super"):
                self.i += 1
                self.type()
            return
        else:
            self.name()
            self.type_args()
            while self.t[self.i] == "." and self.k[self.i + 1] == "w" and self.is_name(self.i + 1):
                self.i += 2
                self.type_args()
        self.dims()

    def type_args(self) -> None:
        if self.got("<"):
            self.listed(">", self.type)

    def block(self) -> None:
        self.need("{")
        while not self.got("}"):
            self.statement()

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if self.t[self.i] not in ("=", ";", ",", ":", "["):
            raise Bad("local")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        s = self.t[self.i]
        if s == "{":
            return self.block()
        if self.got(";"):
            return None
        if s in ("if", "while"):
            self.i += 1
            self.condition()
            self.statement()
            if s == "if" and self.got("else"):
                self.statement()
            return None
        if s == "for":
            return self.for_()
        if s == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            return self.need(";")
        if s == "switch":
            self.switch()
            if self.t[self.i] == ".":
                raise Bad("switch")
            return None
        if s == "try":
            return self.try_()
        if s in ("return", "throw", "assert"):
            self.i += 1
            if s != "return" or self.t[self.i] != ";":
                self.expression()
                if s == "assert" and self.got(":"):
                    self.expression()
            return self.need(";")
        if s in ("break", "continue"):
            self.i += 1
            if self.is_name():
                self.i += 1
            return self.need(";")
        if s == "yield" and (self.k[self.i + 1] in ("w", "n", "s") or self.t[self.i + 1] in ("(", "-", "!", "+")) and self.t[self.i + 1] not in ("=",):
            self.i += 1
            self.expression()
            return self.need(";")
        if s == "synchronized" and self.t[self.i + 1] == "(":
            self.i += 1
            self.condition()
            return self.block()
        if self.is_name() and self.t[self.i + 1] == ":":
            self.i += 2
            return self.statement()
        at = self.i
        self.modifiers()
        if self.is_type_declaration():
            return self.type_declaration()
        self.i = at
        if self.attempt(self.local):
            self.declarators()
            return self.need(";")
        self.effect()
        return self.need(";")

    def effect(self) -> None:
        """An expression that may stand as a statement."""
        at = self.i
        self.expression()
        depth, assigns = 0, False
        for j in range(at, self.i):
            s = self.t[j]
            if self.k[j] == "o":
                depth += (s in ("(", "[", "{")) - (s in (")", "]", "}"))
                assigns = assigns or (depth == 0 and (s in self.ASSIGN or s in ("++", "--")))
        if not assigns and self.t[self.i - 1] not in (")", "}"):
            raise Bad("statement")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        if self.attempt(self.local):
            if self.got(":"):
                self.expression()
                self.need(")")
                return self.statement()
            self.declarators()
        elif self.t[self.i] != ";":
            self.effect()
            while self.got(","):
                self.effect()
        self.need(";")
        if self.t[self.i] != ";":
            self.expression()
        self.need(";")
        while self.t[self.i] != ")":
            self.effect()
            if not self.got(","):
                break
        self.need(")")
        return self.statement()

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        while not self.got("}"):
            if self.got("case"):
                while True:
                    if not self.got("default") and not self.attempt(lambda: (self.type(), self.name(), self.follows(",", ":", "->", "when"))) and not self.attempt(lambda: (self.record_pattern(), self.follows(",", ":", "->", "when"))):
                        self.conditional()
                    if not self.got(","):
                        break
                if self.got("when"):
                    self.conditional()
            else:
                self.need("default")
            if self.got("->"):
                if self.t[self.i] in ("{", "throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while self.t[self.i] not in ("case", "default", "}"):
                self.statement()

    def record_pattern(self) -> None:
        self.type()
        self.need("(")

        def one() -> None:
            if not self.attempt(self.record_pattern):
                self.type()
                self.name()

        self.listed(")", one)
        if self.is_name() and self.t[self.i] != "when":
            self.i += 1

    def follows(self, *texts: str) -> None:
        if self.t[self.i] not in texts:
            raise Bad("after")

    def try_(self) -> None:
        self.i += 1
        handled = False
        if self.got("("):
            handled = True
            while self.t[self.i] != ")":
                if self.attempt(self.local):
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if not self.got(";"):
                    break
            self.need(")")
        self.block()
        while self.got("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.got("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.got("finally"):
            handled = True
            self.block()
        if not handled:
            raise Bad("try")

    def expression(self) -> None:
        self.conditional()
        if self.t[self.i] in self.ASSIGN:
            if self.k[self.i - 1] != "w" and self.t[self.i - 1] not in ("]", ")"):
                raise Bad("target")
            self.i += 1
            self.expression()
        elif self.t[self.i] == ">" and self.t[self.i + 1] in (">", ">="):
            raise Bad("shift")

    def conditional(self) -> None:
        if self.lambda_():
            return
        self.binary()
        if self.got("?"):
            self.conditional()
            self.need(":")
            self.conditional()

    def lambda_(self) -> bool:
        if self.is_name() and self.t[self.i + 1] == "->":
            self.i += 2
        elif self.t[self.i] == "(" and self.t[self.pair[self.i] + 1] == "->":
            self.i += 1

            def one() -> None:
                if not (self.is_name() and self.t[self.i + 1] in (",", ")")):
                    return self.param()
                self.i += 1
                return None

            self.listed(")", one)
            self.need("->")
        else:
            return False
        if self.t[self.i] == "{":
            self.block()
        else:
            self.expression()
        return True

    def binary(self) -> None:
        self.unary()
        while True:
            s = self.t[self.i]
            if s == ">":
                self.i += 1
                while self.t[self.i] == ">" and self.a[self.i] == self.z[self.i - 1]:
                    self.i += 1
                if self.t[self.i] in ("=", ">=") and self.a[self.i] == self.z[self.i - 1]:
                    self.i += 1
            elif s in self.BINARY:
                self.i += 1
            elif s == "instanceof":
                self.i += 1
                self.got("final")
                if not self.attempt(self.record_pattern):
                    self.type()
                    if self.is_name():
                        self.i += 1
                continue
            else:
                return
            if not self.lambda_():
                self.unary()

    def unary(self) -> None:
        while self.t[self.i] in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
        if self.t[self.i] == "(":

            def cast() -> None:
                self.need("(")
                primitive = self.t[self.i] in self.PRIMITIVE and self.t[self.i + 1] == ")"
                self.type()
                while self.got("&"):
                    self.type()
                self.need(")")
                s, k = self.t[self.i], self.k[self.i]
                if not (primitive or k in ("n", "s") or s in ("(", "!", "~", "new", "this", "super", "true", "false", "null", "switch") or self.is_name()):
                    raise Bad("cast")
                if not self.lambda_():
                    self.unary()

            if self.attempt(cast):
                return
        self.primary()
        while self.t[self.i] in ("++", "--"):
            self.i += 1

    def arguments(self) -> None:
        self.need("(")
        if self.got(")"):
            return
        while True:
            self.expression()
            if not self.got(","):
                break
        self.need(")")

    def primary(self) -> None:
        s, k = self.t[self.i], self.k[self.i]
        if k in ("n", "s") or s in ("this", "super", "true", "false", "null"):
            self.i += 1
        elif s == "(":
            self.i += 1
            self.expression()
            self.need(")")
        elif s == "new":
            self.creation()
        elif s == "switch":
            self.switch()
        elif s in self.PRIMITIVE or s == "void":
            self.i += 1
            self.dims()
            if self.t[self.i] not in ("::", "."):
                raise Bad("primitive")
        else:
            self.name()
            if self.t[self.i] == "<":

                def generic() -> None:
                    self.type_args()
                    self.dims()
                    self.follows("::")

                self.attempt(generic)
        while True:
            s = self.t[self.i]
            if s == ".":
                self.i += 1
                if self.t[self.i] == "new":
                    self.creation()
                elif self.t[self.i] in ("this", "super", "class"):
                    self.i += 1
                else:
                    self.type_args()
                    self.name()
            elif s == "(":
                self.arguments()
            elif s == "[":
                if self.t[self.i + 1] == "]":
                    self.dims()
                    self.follows("::", ".")
                else:
                    self.i += 1
                    self.expression()
                    self.need("]")
            elif s == "::":
                self.i += 1
                self.type_args()
                if not self.got("new"):
                    self.name()
            else:
                return

    def creation(self) -> None:
        self.need("new")
        self.type_args()
        self.modifiers()
        if self.t[self.i] in self.PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_args()
            while self.got("."):
                self.name()
                self.type_args()
        if self.t[self.i] == "(":
            self.arguments()
            if self.got("{"):
                self.members()
        elif self.t[self.i] == "[":
            while self.got("["):
                if self.t[self.i] != "]":
                    self.expression()
                self.need("]")
            if self.got("{"):
                self.listed("}", self.initializer)
        else:
            raise Bad("new")


_JOINS = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}]")


def _python_statements(text: str) -> list[str]:
    """The text cut before lines that begin a statement at the left margin."""
    from lodestrata.llm.lexing import _PY, _ENDS

    starts, at, depth, line = [], 0, 0, 0
    n = len(text)
    # places of line starts outside brackets and strings
    begin = [0]
    while at < n:
        m = _PY.search(text, at)
        j = text.find("\n", at)
        if j >= 0 and (not m or j < m.start()):
            if depth == 0 and (j == 0 or text[j - 1] != "\\"):
                begin.append(j + 1)
            at = j + 1
            continue
        if not m:
            break
        at = m.end()
        if m.group("q"):
            e = _ENDS[m.group("q")].match(text, at)
            at = e.end() if e else n
        elif b := m.group("b"):
            depth = max(0, depth + (1 if b in "([{" else -1))
    del line
    decorated = False
    for b in begin:
        c = text[b : b + 1]
        if c in ("", "\n", "\r", " ", "\t", "\f", "#"):
            continue
        joined = _JOINS.match(text, b) is not None or decorated
        decorated = c == "@"
        if not joined:
            starts.append(b)
    if not starts:
        return [text]
    starts[0] = 0
    return [text[a:b] for a, b in zip(starts, [*starts[1:], n])]


def python_valid(text: str) -> bool | None:
    """Each statement at the left margin by the interpreter's own compiler; None where it is nested too deep for that."""
    text = text.removeprefix("﻿")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for s in _python_statements(text):
            try:
                compile(s, "file", "exec", dont_inherit=True)
            except (SyntaxError, ValueError):
                return False
            except (RecursionError, MemoryError):
                return None
    return True


def valid(text: str, language: str, jsx: bool = False) -> bool | None:
    """Whether a text with paired brackets is valid in a language; one without statements is.

    jsx: elements of markup are allowed where a value is. Descents are as deep as the text needs, whatever its nesting;
    None is for Python files that the interpreter itself cannot decide on.
    """
    if language == "python":
        return python_valid(text)
    if jsx and (text := jsx_as_arrays(text)) is None:
        return False
    limit = sys.getrecursionlimit()
    try:
        p = {"go": Go, "java": Java}.get(language, Script)(text, language)
        sys.setrecursionlimit(max(limit, 10_000 + FRAMES * len(p.t)))
        if p.t[0] != END:
            p.file()
        return True
    except Bad:
        return False
    except KeyError:  # a bracket without its pair
        return False
    finally:
        sys.setrecursionlimit(limit)


# ---------------------------------------------------------------- markup in scripts

_TAG_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[-:.][\w$]+)*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s+[\w$])")
_OPENS = re.compile(r"<\s*[A-Za-z_$>]")
_SPACE = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*")


def _code(text: str, at: int) -> tuple[int, str]:
    """From a place to the brace that closes what it lies in, or to the end: that place, and the code with arrays for elements."""
    out, copied, last, value, depth, n = [], at, at, False, 0, len(text)
    while at < n:
        m = _JSX.search(text, at)
        if not m:
            break
        at, kind = m.end(), m.lastgroup
        if kind == "b":
            b = m.group()
            depth += 1 if b in "([{" else -1
            if depth < 0:
                return m.start(), "".join([*out, text[copied : m.start()]])
            value = b in ")]"
        elif kind == "q" and m.group() == "/*":
            value = _is_value(text[last : m.start()], value)
            at = text.find("*/", at) + 2
            if at < 2:
                raise Bad("comment")
        elif kind == "q":
            while (e := _TEMPLATE.match(text, at)) and e.group(1) == "${":
                end, inner = _code(text, e.end())
                out += [text[copied : e.end()], inner]
                copied, at = end, end + 1
            if not e:
                raise Bad("template")
            at, value = e.end(), True
        elif kind == "line":
            value = _is_value(text[last : m.start()], value)
        elif kind == "slash":
            value = _is_value(text[last : m.start()], value)
            r = None if value else _REGEX.match(text, m.start())
            at, value = (r.end(), True) if r else (at, False)
        elif kind == "less":
            if not _is_value(text[last : m.start()], value) and _OPENS.match(text, m.start()) and not _GENERIC.match(text, m.start()):
                end, new = _element(text, m.start())
                out += [text[copied : m.start()], new]
                copied, at, value = end, end, True
            else:
                value = False
        else:
            value = True
        last = at
    return n, "".join([*out, text[copied:]])


def _element(text: str, at: int) -> tuple[int, str]:
    """The end of the element that begins at a place, and an array of the expressions it holds."""
    out, begin = ["["], at

    def code(at: int, child: bool) -> int:
        end, inner = _code(text, at + 1)
        if not text.startswith("}", end):
            raise Bad("brace")
        s, close = _SPACE.match(inner).end(), "\n" if "//" in inner else ""
        if s == len(inner):
            if not child:
                raise Bad("attribute")
            out.append("\n" * inner.count("\n"))
        elif inner.startswith("...", s):
            out.append(f"{inner}{close},")
        else:
            out.append(f"({inner}{close}),")
        return end + 1

    def space(at: int) -> int:
        end = _SPACE.match(text, at).end()
        out.append("\n" * text.count("\n", at, end))
        return end

    def tag(at: int) -> tuple[int, str]:
        m = _TAG_NAME.match(text, at)
        return (m.end(), m.group()) if m else (at, "")

    at, name = tag(space(at + 1) if text[at + 1 : at + 2].isspace() else at + 1)
    while name:
        at = space(at)
        c = text[at : at + 1]
        if c == "/" or c == ">":
            break
        if c == "{":
            if not text[_SPACE.match(text, at + 1).end() :].startswith("..."):
                raise Bad("attribute")
            at = code(at, False)
            continue
        end, attribute = tag(at)
        if not attribute:
            raise Bad("attribute")
        at = space(end)
        if text[at : at + 1] == "=":
            at = space(at + 1)
            c = text[at : at + 1]
            if c == "{":
                at = code(at, False)
            elif c in ("'", '"'):
                end = text.find(c, at + 1)
                if end < 0:
                    raise Bad("attribute")
                out.append("\n" * text.count("\n", at, end))
                at = end + 1
            elif c == "<":
                at, inner = _element(text, at)
                out.append(inner + ",")
            else:
                raise Bad("attribute")
    if name and text.startswith("/", at):
        if not text.startswith(">", at := space(at + 1)):
            raise Bad("tag")
        return at + 1, "".join([*out, "]"])
    if not text.startswith(">", at):
        raise Bad("tag")
    at += 1
    while True:
        m = _CHILD.search(text, at)
        if not m or m.group() in (">", "}"):
            raise Bad("child")
        out.append("\n" * text.count("\n", at, m.start()))
        at = m.start()
        if m.group() == "{":
            at = code(at, True)
        elif m.group() == "<":
            at, inner = _element(text, at)
            out.append(inner + ",")
        else:
            end, close = tag(space(at + 2))
            end = space(end)
            if close != name or not text.startswith(">", end):
                raise Bad(f"end of {text[begin : begin + 10]}")
            return end + 1, "".join([*out, "]"])


_CHILD = re.compile(r"</|[<{}>]")


def jsx_as_arrays(text: str) -> str | None:
    """A script with each element of markup replaced by an array of the expressions it holds; None where one is not well-formed."""
    try:
        end, out = _code(text, 0)
    except Bad:
        return None
    return out + text[end:]


assert set(SCRIPT) == {"javascript", "typescript"}
