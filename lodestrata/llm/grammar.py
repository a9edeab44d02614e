"""Local grammars over token strings (see lexing): is a balanced text a sequence of statements of its language?

Bracketed groups are interned: a group's content is a string in which inner groups are single characters, and what was
found about a content is remembered, so that each shape of statement list, argument list or body is parsed once. The
grammars decide syntax only; where a language leaves something to later phases they accept it.
"""

from __future__ import annotations

import sys

from .lexing import CODE

_GROUP = 0xF0000
_LIMIT = 60_000
#: Groups within groups that are parsed in one go; deeper ones are put off and parsed first. So nesting has no limit.
_DEEP = 200
#: Frames of Python functions take no C stack; chains without brackets (else if) take a few for each of their tokens.
_FRAMES = 50_000

PACKAGE, IMPORT, DECLARATION = 1, 2, 4


def _k(words: str) -> str:
    return "".join(CODE[w] for w in words.split())


class Unbalanced(Exception):
    pass


class _PutOff(Exception):
    """A group that lies too deep to be parsed within its surroundings; its key is the argument."""


class Grammar:
    """Common part: groups, expressions. Parse functions take (s, i) and return the next position, or -1."""

    lang = ""
    soft = ""  # words that are also names
    prefix = ""  # words that stand before an operand
    newlines = False

    def __init__(self) -> None:
        self.groups: list[tuple[str, str]] = []
        self.numbers: dict[tuple[str, str], int] = {}
        self.known: dict[tuple[str, str, bool], bool] = {}
        self.depth = 0
        self.ambient = False  # within a declaration that gives types only
        self.names = "i" + self.soft
        self.anyname = set(self.names) | {c for c in CODE.values()}

    # groups

    def fold(self, tokens: str) -> str:
        """Replace every bracketed group, innermost first, by its character."""
        stack: list[tuple[str, list[str]]] = [("", [])]
        at = 0
        for n, c in enumerate(tokens):
            if c in "([{":
                stack[-1][1].append(tokens[at:n])
                stack.append((c, []))
                at = n + 1
            elif c in ")]}":
                kind, parts = stack.pop()
                if not stack or "([{".find(kind) != ")]}".find(c):
                    raise Unbalanced
                parts.append(tokens[at:n])
                stack[-1][1].append(self.intern(kind, "".join(parts)))
                at = n + 1
        if len(stack) != 1:
            raise Unbalanced
        stack[0][1].append(tokens[at:])
        return "".join(stack[0][1])

    def intern(self, kind: str, content: str) -> str:
        key = kind, content
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.groups)
            self.groups.append(key)
        return chr(_GROUP + n)

    def fresh(self) -> None:
        if len(self.groups) > _LIMIT:
            self.groups.clear(), self.numbers.clear(), self.known.clear()

    def kind(self, s: str, i: int) -> str:
        """Bracket of the group at i, or ''."""
        return self.groups[ord(s[i]) - _GROUP][0] if i < len(s) and ord(s[i]) >= _GROUP else ""

    def content(self, s: str, i: int) -> str:
        return self.groups[ord(s[i]) - _GROUP][1]

    def whole(self, role: str, content: str) -> bool:
        """Does the content as a whole match the method of that name?"""
        key = role, content, self.ambient
        got = self.known.get(key)
        if got is None:
            if self.depth >= _DEEP:
                raise _PutOff(key)
            self.depth += 1
            got = self.known[key] = bool(getattr(self, role)(content))
            self.depth -= 1
        return got

    def group(self, s: str, i: int, bracket: str, role: str) -> int:
        return i + 1 if self.kind(s, i) == bracket and self.whole(role, self.content(s, i)) else -1

    def skip(self, s: str, i: int) -> int:
        while i < len(s) and s[i] == "\n":
            i += 1
        return i

    def at(self, s: str, i: int) -> str:
        return s[i] if 0 <= i < len(s) else ""

    # expressions

    binary = frozenset("b+-*/%&|^<>")
    unary = frozenset("+-!~x")

    def expr(self, s: str, i: int, block: bool = False) -> int:
        """A non-empty expression; block: a brace group after a name opens a body, it is no literal."""
        alone = True  # no operator since the start or the last assignment: an assignment may follow
        while True:
            start = i
            i = self.operand(s, i, block)
            if i < 0:
                return -1
            j = self.skip(s, i) if self.newlines else i
            c = self.at(s, j)
            if c in self.binary and c:
                i, alone = j + 1, False
                while c == ">" and self.at(s, i) == ">":
                    i += 1
                i = self.skip(s, i)
            elif c in ("=", "a") and c and self.assigns:
                if not alone or not self.target(s, start, i):
                    return -1
                i = self.skip(s, j + 1)
            elif c == "?" and self.ternary:
                i = self.expr(s, self.skip(s, j + 1), block)
                if i < 0:
                    return -1
                i = self.skip(s, i)
                if self.at(s, i) != ":":
                    return -1
                i, alone = self.skip(s, i + 1), True
            elif c and c in self.word_ops:
                i, alone = self.skip(s, j + 1), False
            else:
                return i

    assigns = True
    ternary = True
    word_ops = ""

    def target(self, s: str, start: int, end: int) -> bool:
        """May the operand from start to end be assigned to: a name, a member, an element, a pattern or one of them in parentheses?"""
        last, k = s[end - 1], self.kind(s, end - 1)
        if s[start] in self.unary or s[start] in self.prefix and end > start + 1:
            return False
        return last in self.anyname or k == "[" or k == "(" and end == start + 1 or k == "{" and end == start + 1 or last == "!"

    def operand(self, s: str, i: int, block: bool) -> int:
        while i < len(s) and (s[i] in self.unary or s[i] in self.prefix):
            i = self.skip(s, i + 1)
        i = self.primary(s, i, block)
        while 0 <= i < len(s):
            j = self.postfix(s, i, block)
            if j < 0:
                return -1
            if j == i:
                break
            i = j
        return i

    def primary(self, s: str, i: int, block: bool) -> int:
        raise NotImplementedError

    def postfix(self, s: str, i: int, block: bool) -> int:
        raise NotImplementedError

    def exprs(self, s: str, i: int, block: bool = False) -> int:
        while True:
            i = self.expr(s, i, block)
            if i < 0 or self.at(s, self.skip(s, i)) != ",":
                return i
            i = self.skip(s, self.skip(s, i) + 1)

    def list_of(self, c: str, item, empty_items: bool = False, sep: str = ",") -> bool:
        """Whole content: items between separators, one trailing separator allowed."""
        i = self.skip(c, 0)
        while i < len(c):
            if c[i] == sep and empty_items:
                i = self.skip(c, i + 1)
                continue
            i = item(c, i)
            if i < 0:
                return False
            i = self.skip(c, i)
            if i < len(c):
                if c[i] != sep:
                    return False
                i = self.skip(c, i + 1)
        return True

    def only_expr(self, c: str) -> bool:
        i = self.expr(c, self.skip(c, 0))
        return i >= 0 and self.skip(c, i) == len(c)

    def args(self, c: str) -> bool:
        return self.list_of(c, self.arg)

    def arg(self, s: str, i: int) -> int:
        if self.at(s, i) == "e":
            i += 1
        return self.expr(s, i)

    def statements(self, c: str) -> bool:
        i = self.skip(c, 0)
        while i < len(c):
            i = self.statement(c, i)
            if i < 0:
                return False
            i = self.skip(c, i)
        return True

    def statement(self, s: str, i: int) -> int:
        raise NotImplementedError

    def block(self, s: str, i: int) -> int:
        return self.group(s, i, "{", "statements")

    def valid(self, tokens: str) -> int | None:
        """Flags of what a text of whole declarations and statements holds, in order; None if it isn't one."""
        if "E" in tokens:
            return None
        self.fresh()
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _FRAMES, 12 * len(tokens)))
        try:
            text = self.fold(tokens)
        except Unbalanced:
            return None
        first: list[tuple[str, str, bool]] = []  # groups that were put off, innermost last
        while True:
            self.depth, self.ambient = 0, first[-1][2] if first else False
            try:
                if not first:
                    return self.top(text)
                self.known[first[-1]] = bool(getattr(self, first[-1][0])(first[-1][1]))
                first.pop()
            except _PutOff as e:
                first.append(e.args[0])

    def top(self, s: str) -> int | None:
        raise NotImplementedError


class Go(Grammar):
    lang = "go"
    unary = frozenset("+-!^*&w")
    binary = frozenset("b+-*/%&|^<>")
    assigns = False
    ternary = False

    RETURN, BREAK, CONTINUE, GOTO, FALL, DEFER, GOW, IF, ELSE, FOR, SWITCH, SELECT, CASE, DEFAULT = (_k(w) for w in "return break continue goto fallthrough defer go if else for switch select case default".split())
    VAR, CONST, TYPE, FUNC, STRUCT, INTERFACE, MAP, CHAN, RANGE, PACK, IMP = (_k(w) for w in "var const type func struct interface map chan range package import".split())

    def top(self, s: str) -> int | None:
        i, flags = 0, 0
        while i < len(s):
            c = s[i]
            if c == ";":
                i += 1
                continue
            if c == self.PACK:
                if flags or self.at(s, i + 1) != "i":
                    return None
                flags, i = PACKAGE, i + 2
            elif c == self.IMP:
                if flags & DECLARATION:
                    return None
                flags |= IMPORT
                i = self.group(s, i + 1, "(", "imports") if self.kind(s, i + 1) == "(" else self.import_spec(s, i + 1)
            elif c in (self.VAR, self.CONST, self.TYPE):
                flags |= DECLARATION
                i = self.declaration(s, i)
            elif c == self.FUNC:
                flags |= DECLARATION
                i += 1
                if self.kind(s, i) == "(":
                    i = self.group(s, i, "(", "params")
                if i < 0 or self.at(s, i) != "i":
                    return None
                i += 1
                if self.kind(s, i) == "[":
                    i = self.group(s, i, "[", "params")
                i = self.signature(s, i) if i > 0 else -1
                if i > 0 and self.kind(s, i) == "{":
                    i = self.block(s, i)
            else:
                return None
            if i < 0 or i < len(s) and s[i] != ";":
                return None
        return flags

    def import_spec(self, s: str, i: int) -> int:
        if self.at(s, i) in ("i", ".") and self.at(s, i):
            i += 1
        return i + 1 if self.at(s, i) == "s" else -1

    def imports(self, c: str) -> bool:
        return self.list_of(c, self.import_spec, True, ";")

    def names_(self, s: str, i: int) -> int:
        while self.at(s, i) == "i":
            i += 1
            if self.at(s, i) != ",":
                return i
            i += 1
        return -1

    def var_spec(self, s: str, i: int) -> int:
        i = self.names_(s, i)
        if i < 0:
            return -1
        if self.at(s, i) not in ("=", ";", ""):
            i = self.type(s, i)
        if i >= 0 and self.at(s, i) == "=":
            i = self.exprs(s, i + 1)
        return i

    def type_spec(self, s: str, i: int) -> int:
        if self.at(s, i) != "i":
            return -1
        i += 1
        if self.kind(s, i) == "[" and self.content(s, i) and self.whole("params", self.content(s, i)):
            j = self.type(s, i + 1)
            if j >= 0:
                return j
        if self.at(s, i) == "=":
            i += 1
        return self.type(s, i)

    def var_specs(self, c: str) -> bool:
        return self.list_of(c, self.var_spec, True, ";")

    def type_specs(self, c: str) -> bool:
        return self.list_of(c, self.type_spec, True, ";")

    def declaration(self, s: str, i: int) -> int:
        one, many = (self.type_spec, "type_specs") if s[i] == self.TYPE else (self.var_spec, "var_specs")
        return self.group(s, i + 1, "(", many) if self.kind(s, i + 1) == "(" else one(s, i + 1)

    def type(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c == "i":
            i += 1
            if self.at(s, i) == "." and self.at(s, i + 1) == "i":
                i += 2
            if self.kind(s, i) == "[" and self.content(s, i) and self.whole("types", self.content(s, i)):
                i += 1
            return i
        if c == "*":
            return self.type(s, i + 1)
        if c == "w":
            return self.type(s, i + 2) if self.at(s, i + 1) == self.CHAN else -1
        if c == self.CHAN:
            return self.type(s, i + 2 if self.at(s, i + 1) == "w" else i + 1)
        if c == self.MAP:
            i = self.group(s, i + 1, "[", "types")
            return self.type(s, i) if i > 0 else -1
        if c == self.FUNC:
            return self.signature(s, i + 1)
        if c == self.STRUCT:
            return self.group(s, i + 1, "{", "fields")
        if c == self.INTERFACE:
            return self.group(s, i + 1, "{", "methods")
        k = self.kind(s, i)
        if k == "[":
            inner = self.content(s, i)
            return self.type(s, i + 1) if inner in ("", "e") or self.whole("only_expr", inner) else -1
        return self.group(s, i, "(", "types") if k == "(" else -1

    def types(self, c: str) -> bool:
        return bool(c) and self.list_of(c, self.type)

    def param(self, s: str, i: int) -> int:
        """name type, name ...type, type or ...type; constraint unions for type parameters."""
        for start in (i + 1, i) if self.at(s, i) == "i" else (i,):
            j = start + 1 if self.at(s, start) == "e" else start
            while self.at(s, j) == "~":
                j += 1
            j = self.type(s, j)
            while j >= 0 and self.at(s, j) == "|":
                j = self.type(s, j + 2 if self.at(s, j + 1) == "~" else j + 1)
            if j >= 0 and self.at(s, j) in (",", ""):
                return j
        return -1

    def params(self, c: str) -> bool:
        return self.list_of(c.rstrip(";"), self.param)

    def signature(self, s: str, i: int) -> int:
        i = self.group(s, i, "(", "params")
        if i < 0:
            return -1
        if self.kind(s, i) == "(":
            return self.group(s, i, "(", "params")
        if i < len(s) and (s[i] in ("i", "*", "w", self.CHAN, self.MAP, self.FUNC, self.STRUCT, self.INTERFACE) or self.kind(s, i) == "["):
            return self.type(s, i)
        return i

    def field(self, s: str, i: int) -> int:
        if self.at(s, i) == "*" or self.at(s, i) == "i" and self.at(s, i + 1) in (";", "", ".", "s"):
            i = self.type(s, i)
        else:
            i = self.names_(s, i)
            i = self.type(s, i) if i > 0 else -1
        return i + 1 if i > 0 and self.at(s, i) == "s" else i

    def fields(self, c: str) -> bool:
        return self.list_of(c, self.field, True, ";")

    def method(self, s: str, i: int) -> int:
        if self.at(s, i) == "i" and self.kind(s, i + 1) == "(":
            return self.signature(s, i + 1)
        while True:
            i = self.type(s, i + 1 if self.at(s, i) == "~" else i)
            if i < 0 or self.at(s, i) != "|":
                return i
            i += 1

    def methods(self, c: str) -> bool:
        return self.list_of(c, self.method, True, ";")

    def primary(self, s: str, i: int, block: bool) -> int:
        c = self.at(s, i)
        if c and c in "ins":
            return i + 1
        if c == self.FUNC:
            j = self.signature(s, i + 1)
            return self.block(s, j) if j > 0 and self.kind(s, j) == "{" else j
        k = self.kind(s, i)
        if k == "(":
            inner = self.content(s, i)
            return i + 1 if self.whole("only_expr", inner) or self.whole("types", inner) else -1
        if k == "[" or c and c in (self.MAP, self.STRUCT, self.CHAN, self.INTERFACE):
            j = self.type(s, i)
            return self.group(s, j, "{", "elements") if j > 0 and self.kind(s, j) == "{" else j
        return -1

    def postfix(self, s: str, i: int, block: bool) -> int:
        c = s[i]
        if c == ".":
            if self.kind(s, i + 1) == "(":
                inner = self.content(s, i + 1)
                return i + 2 if inner == self.TYPE or self.whole("types", inner) else -1
            return i + 2 if self.at(s, i + 1) == "i" else -1
        k = self.kind(s, i)
        if k == "(":
            return self.group(s, i, "(", "args")
        if k == "[":
            return self.group(s, i, "[", "index")
        if k == "{" and not block and self.at(s, i - 1) and (s[i - 1] == "i" or self.kind(s, i - 1) == "["):
            return self.group(s, i, "{", "elements")
        return i

    def arg(self, s: str, i: int) -> int:
        j = self.expr(s, i)
        if j < 0 or self.at(s, j) not in (",", "", "e"):
            j = self.type(s, i)
        return j + 1 if j > 0 and self.at(s, j) == "e" else j

    def index(self, c: str) -> bool:
        if ":" in c:
            parts = c.split(":")
            return len(parts) <= 3 and all(not p or self.whole("only_expr", p) for p in parts)
        return self.whole("only_expr", c) or self.whole("types", c)

    def element(self, s: str, i: int) -> int:
        for _ in range(2):
            i = self.group(s, i, "{", "elements") if self.kind(s, i) == "{" else self.expr(s, i)
            if i < 0 or self.at(s, i) != ":":
                return i
            i += 1
        return -1

    def elements(self, c: str) -> bool:
        return self.list_of(c, self.element)

    def simple(self, s: str, i: int, block: bool) -> int:
        if self.at(s, i) == self.RANGE:
            return self.expr(s, i + 1, block)
        i = self.exprs(s, i, block)
        c = self.at(s, i)
        if i > 0 and c in ("=", "a", "d") and c:
            return self.expr(s, i + 2, block) if self.at(s, i + 1) == self.RANGE else self.exprs(s, i + 1, block)
        if i > 0 and c == "x":
            return i + 1
        if i > 0 and c == "w":
            return self.expr(s, i + 1, block)
        return i

    def head(self, s: str, i: int, parts: int) -> int:
        """Up to ``parts`` simple statements between semicolons, up to a body; position of the body."""
        n = 0
        while self.kind(s, i) != "{" or n == 0 and self.at(s, i + 1) and self.kind(s, i + 1) == "{":
            if self.at(s, i) == ";":
                n += 1
                i += 1
                if n >= parts:
                    return -1
                continue
            j = self.simple(s, i, True)
            if j <= i or self.at(s, j) != ";" and self.kind(s, j) != "{":
                return -1
            i = j
        return i

    def statement(self, s: str, i: int) -> int:
        c = s[i]
        if c == ";":
            return i + 1
        if c in (self.VAR, self.CONST, self.TYPE):
            i = self.declaration(s, i)
        elif c == self.RETURN:
            i = i + 1 if self.at(s, i + 1) in (";", "") else self.exprs(s, i + 1)
        elif c in (self.BREAK, self.CONTINUE, self.GOTO):
            i = i + 2 if self.at(s, i + 1) == "i" else i + 1
        elif c == self.FALL:
            i += 1
        elif c in (self.DEFER, self.GOW):
            i = self.expr(s, i + 1)
            i = i if i > 0 and self.kind(s, i - 1) == "(" else -1
        elif c == self.IF:
            while True:
                i = self.head(s, i + 1, 2)
                if i < 0 or s[i - 1] in (self.IF, ";"):
                    return -1
                i = self.block(s, i)
                if i < 0 or self.at(s, i) != self.ELSE:
                    break
                i += 1
                if self.at(s, i) != self.IF:
                    i = self.block(s, i)
                    break
        elif c == self.FOR:
            i = self.head(s, i + 1, 3)
            i = self.block(s, i) if i > 0 else -1
        elif c in (self.SWITCH, self.SELECT):
            i = self.head(s, i + 1, 2)
            i = self.group(s, i, "{", "cases") if i > 0 else -1
        elif c == "i" and self.at(s, i + 1) == ":":
            return i + 2
        elif self.kind(s, i) == "{":
            i = self.block(s, i)
        else:
            i = self.simple(s, i, False)
        if i < 0 or i < len(s) and s[i] != ";":
            return -1
        return i + 1

    def cases(self, c: str) -> bool:
        i, seen = 0, False
        while i < len(c):
            if c[i] == self.DEFAULT:
                i += 1
            elif c[i] == self.CASE:
                j = self.simple(c, i + 1, False)
                while j < 0 or self.at(c, j) != ":":
                    # lists of types
                    j = self.type(c, i + 1)
                    while j > 0 and self.at(c, j) == ",":
                        j = self.type(c, j + 1)
                    if j < 0 or self.at(c, j) != ":":
                        return False
                i = j
            elif seen:
                i = self.statement(c, i)
                if i < 0:
                    return False
                continue
            elif c[i] == ";":
                i += 1
                continue
            else:
                return False
            if self.at(c, i) != ":":
                return False
            i, seen = i + 1, True
        return True


class Script(Grammar):
    """JavaScript modules; TypeScript adds types."""

    lang = "js"
    newlines = True
    soft = _k("let static async of from as get set")
    prefix = _k("typeof void delete await")
    word_ops = _k("in instanceof")
    typed = False

    CONST, LET, VAR, FUNCTION, CLASS, IF, ELSE, FOR, WHILE, DO, SWITCH, CASE, DEFAULT, TRY, CATCH, FINALLY = (_k(w) for w in "const let var function class if else for while do switch case default try catch finally".split())
    THROW, RETURN, BREAK, CONTINUE, IMPORT, EXPORT, EXTENDS, NEW, ASYNC, AWAIT, YIELD, OF, IN, FROM, AS, GET, SET, STATIC, DEBUGGER = (_k(w) for w in "throw return break continue import export extends new async await yield of in from as get set static debugger".split())

    def top(self, s: str) -> int | None:
        return DECLARATION if self.statements(s) else None

    def primary(self, s: str, i: int, block: bool) -> int:
        c = self.at(s, i)
        if not c:
            return -1
        if c == self.ASYNC:
            if self.at(s, i + 1) == self.FUNCTION:
                return self.function(s, i + 1)
            if self.typed and self.at(s, i + 1) == "<":
                j = self.type_params(s, i + 1)
                if j > 0 and self.kind(s, j) == "(" and self.arrow_after(s, j + 1):
                    return self.arrow_body(s, self.arrow_after(s, j + 1)) if self.whole("params", self.content(s, j)) else -1
            if self.kind(s, i + 1) == "(" and self.arrow_after(s, i + 2) or self.at(s, i + 1) and s[i + 1] in self.names and self.at(s, i + 2) == "r":
                i, c = i + 1, s[i + 1]
        if c in self.names:
            return self.arrow_body(s, i + 2) if self.at(s, i + 1) == "r" else i + 1
        if c in "nst":
            return i + 1
        if c == self.FUNCTION:
            return self.function(s, i)
        if c == self.CLASS:
            return self.class_(s, i)
        if c == self.NEW:
            if self.at(s, i + 1) == ".":
                return i + 3
            return self.operand(s, i + 1, block)
        if c == "<" and self.typed:
            return self.generic_or_assertion(s, i, block)
        if c == self.IMPORT:
            return i + 1 if self.at(s, i + 1) == "." or self.kind(s, i + 1) == "(" else -1
        if c == self.YIELD:
            j = i + 2 if self.at(s, i + 1) == "*" else i + 1
            k = self.expr(s, j, block) if j < len(s) and s[j] not in ";,\n)" else j
            return k if k > 0 else j
        k = self.kind(s, i)
        if k == "(":
            j = self.arrow_after(s, i + 1)
            if j:
                return self.arrow_body(s, j) if self.whole("params", self.content(s, i)) else -1
            inner = self.content(s, i)
            return i + 1 if inner.strip("\n") and self.whole("sequence", inner) else -1
        if k == "[":
            return self.group(s, i, "[", "array")
        if k == "{":
            return self.group(s, i, "{", "object")
        return -1

    def generic_or_assertion(self, s: str, i: int, block: bool) -> int:
        return -1

    def arrow_after(self, s: str, i: int) -> int:
        """Position after => if an arrow follows a parameter list that ends before i, else 0."""
        if self.at(s, i) == "r":
            return i + 1
        if self.typed and self.at(s, i) == ":":
            j = self.type(s, i + 1)
            if j > 0 and self.at(s, j) == "r":
                return j + 1
        return 0

    def arrow_body(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        return self.block(s, i) if self.kind(s, i) == "{" else self.expr(s, i)

    def sequence(self, c: str) -> bool:
        i = self.exprs(c, self.skip(c, 0))
        return i >= 0 and self.skip(c, i) == len(c)

    def postfix(self, s: str, i: int, block: bool) -> int:
        j = self.skip(s, i)
        c = self.at(s, j)
        if c == "." or c == "o":
            n = self.skip(s, j + 1)
            if n < len(s) and s[n] in self.anyname:
                return n + 1
            return n if c == "o" and self.kind(s, n) in ("(", "[") and self.kind(s, n) else -1
        k = self.kind(s, j)
        if k == "(":
            return self.group(s, j, "(", "args")
        if k == "[":
            return self.group(s, j, "[", "sequence")
        if c == "t":
            return j + 1
        if c == "x" and j == i:
            return i + 1
        if self.typed:
            if c == "<" and j == i:
                n = self.type_args(s, i)
                if n > 0 and self.kind(s, n) == "(":
                    return self.group(s, n, "(", "args")
                return n if n > 0 and (n >= len(s) or s[n] in "t;,.)\n") else i
            if c == "!" and j == i and self.at(s, i + 1) not in ("=", "i", "s", "n"):
                return i + 1
            if c and c in self.casts and j == i:
                return i + 2 if self.at(s, i + 1) == self.CONST else self.type(s, i + 1)
        return i

    casts = ""

    def element(self, s: str, i: int) -> int:
        return self.expr(s, i + 1 if self.at(s, i) == "e" else i)

    def array(self, c: str) -> bool:
        return self.list_of(c, self.element, True)

    def member_name(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c and (c in self.anyname or c in "sn"):
            return i + 1
        return self.group(s, i, "[", "only_expr")

    def property(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c == "e":
            return self.expr(s, i + 1)
        j = self.method_(s, i)
        if j > 0:
            return j
        j = self.member_name(s, i)
        if j < 0:
            return -1
        if self.at(s, j) == ":":
            return self.expr(s, self.skip(s, j + 1))
        if c in self.names:
            return self.expr(s, j + 1) if self.at(s, j) == "=" else j
        return -1

    def object(self, c: str) -> bool:
        return self.list_of(c, self.property)

    def method_(self, s: str, i: int) -> int:
        """[async] [*] [get|set] name(params) body, or -1."""
        for _ in range(3):
            c = self.at(s, i)
            n = self.at(s, i + 1)
            if c and (c == "*" or c in (self.ASYNC, self.GET, self.SET)) and n and self.kind(s, i + 1) != "(" and n not in ",:=;\n<":
                i += 1
        i = self.member_name(s, i)
        if i > 0 and self.typed and self.at(s, i) == "?":
            i += 1
        return self.callable(s, i, self.typed) if i > 0 else -1

    def callable(self, s: str, i: int, bodiless: bool = False) -> int:
        """(params) body, with type parameters and a result type where typed."""
        if self.typed and self.at(s, i) == "<":
            i = self.type_params(s, i)
        i = self.group(s, i, "(", "params") if i >= 0 else -1
        if i > 0 and self.typed and self.at(s, i) == ":":
            i = self.type(s, i + 1)
        if i < 0:
            return -1
        j = self.skip(s, i)
        if self.kind(s, j) == "{":
            return self.block(s, j)
        return i if bodiless else -1

    def function(self, s: str, i: int) -> int:
        i += 1
        if self.at(s, i) == "*":
            i += 1
        if self.at(s, i) and s[i] in self.names:
            i += 1
        return self.callable(s, i)

    def binding(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c and c in self.names:
            return i + 1
        k = self.kind(s, i)
        return self.group(s, i, "[", "pattern") if k == "[" else self.group(s, i, "{", "pattern_object") if k == "{" else -1

    def param(self, s: str, i: int) -> int:
        if self.at(s, i) == "@" and self.typed:
            i = self.decorator(s, i)
        while self.typed and self.at(s, i) and s[i] in self.modifiers and self.at(s, i + 1) and (s[i + 1] in self.names or s[i + 1] in self.modifiers):
            i += 1
        if self.at(s, i) == "e":
            i += 1
        i = self.binding(s, i)
        if i > 0 and self.typed:
            if self.at(s, i) == "?":
                i += 1
            if self.at(s, i) == ":":
                i = self.type(s, i + 1)
        if i > 0 and self.at(s, i) == "=":
            i = self.expr(s, i + 1)
        return i

    modifiers = ""

    def params(self, c: str) -> bool:
        return self.list_of(c, self.param)

    def pattern(self, c: str) -> bool:
        return self.list_of(c, self.param, True)

    def pattern_property(self, s: str, i: int) -> int:
        if self.at(s, i) == "e":
            return self.binding(s, i + 1)
        j = self.member_name(s, i)
        if j > 0 and self.at(s, j) == ":":
            j = self.binding(s, self.skip(s, j + 1))
        if j > 0 and self.at(s, j) == "=":
            j = self.expr(s, j + 1)
        return j

    def pattern_object(self, c: str) -> bool:
        return self.list_of(c, self.pattern_property)

    def class_(self, s: str, i: int) -> int:
        i += 1
        if self.at(s, i) and s[i] in self.names:
            i += 1
        if self.typed and self.at(s, i) == "<":
            i = self.type_params(s, i)
        if i > 0 and self.at(s, i) == self.EXTENDS:
            i = self.operand(s, i + 1, True)
            if i > 0 and self.typed and self.at(s, i) == "<":
                i = self.type_args(s, i)
        if i > 0 and self.typed and self.at(s, i) == self.IMPLEMENTS:
            i = self.type(s, i + 1)
            while i > 0 and self.at(s, i) == ",":
                i = self.type(s, i + 1)
        return self.group(s, i, "{", "class_body") if i > 0 else -1

    IMPLEMENTS = _k("implements")

    def class_body(self, c: str) -> bool:
        i = 0
        while True:
            while i < len(c) and c[i] in ";\n":
                i += 1
            if i >= len(c):
                return True
            i = self.member(c, i)
            if i < 0:
                return False
            if i < len(c) and c[i] not in ";\n" and self.kind(c, i - 1) != "{":
                return False

    def member(self, s: str, i: int) -> int:
        while self.typed and self.at(s, i) == "@":
            i = self.skip(s, self.decorator(s, i))
            if i <= 0:
                return -1
        while self.at(s, i) and (s[i] == self.STATIC or self.typed and s[i] in self.modifiers) and self.at(s, i + 1) and self.kind(s, i + 1) != "(" and s[i + 1] not in "=;\n:?<":
            i += 1
        if self.kind(s, i) == "{":
            return self.block(s, i) if s[i - 1] == self.STATIC else -1
        j = self.method_(s, i)
        if j > 0:
            return j
        if self.typed and self.kind(s, i) == "[":
            j = self.type_member(s, i)
            if j > 0:
                return j
        j = self.member_name(s, i)
        if j > 0 and self.typed:
            if self.at(s, j) in ("?", "!") and self.at(s, j):
                j += 1
            if self.at(s, j) == ":":
                j = self.type(s, j + 1)
        if j > 0 and self.at(s, j) == "=":
            j = self.expr(s, self.skip(s, j + 1))
        return j

    def finish(self, s: str, i: int) -> int:
        """The end of a statement: ;, a line end, or the end of the block."""
        if i < 0:
            return -1
        if i >= len(s) or s[i] == "\n":
            return i
        return i + 1 if s[i] == ";" else -1

    def declarators(self, s: str, i: int, need_value: bool) -> int:
        while True:
            i = self.skip(s, i)
            plain = self.kind(s, i) == ""
            i = self.binding(s, i)
            if i < 0:
                return -1
            if self.typed and self.at(s, i) == "!":
                i += 1
            if self.typed and self.at(s, i) == ":":
                i = self.type(s, i + 1)
                if i < 0:
                    return -1
            j = self.skip(s, i)
            if self.at(s, j) == "=":
                i = self.expr(s, self.skip(s, j + 1))
                if i < 0:
                    return -1
            elif need_value or not plain:
                return -1
            j = self.skip(s, i)
            if self.at(s, j) != ",":
                return i
            i = j + 1

    def for_head(self, c: str) -> bool:
        i = self.skip(c, 0)
        start = self.at(c, i)
        if start and start in (self.CONST, self.LET, self.VAR):
            j = self.binding(c, i + 1)
            if j > 0 and self.typed and self.at(c, j) == ":":
                j = self.type(c, j + 1)
            if j > 0 and self.at(c, j) in (self.OF, self.IN) and self.at(c, j):
                k = self.exprs(c, j + 1)
                return k > 0 and self.skip(c, k) == len(c)
            i = self.declarators(c, i + 1, start == self.CONST)
        elif self.at(c, i) != ";":
            j = self.operand(c, i, False)
            if j > 0 and self.at(c, j) == self.OF:
                k = self.expr(c, j + 1)
                return k > 0 and self.skip(c, k) == len(c)
            i = self.exprs(c, i)
            if i > 0 and self.skip(c, i) == len(c):
                return self.IN in c
        for last in (False, True):
            if i < 0:
                return False
            i = self.skip(c, i)
            if self.at(c, i) != ";":
                return False
            i = self.skip(c, i + 1)
            if i < len(c) and c[i] != ";":
                i = self.exprs(c, i)
            if last:
                return i >= 0 and self.skip(c, i) == len(c)
        return False

    def body(self, s: str, i: int) -> int:
        """The statement under if, else, for, while: no declaration."""
        i = self.skip(s, i)
        if i >= len(s) or s[i] in (self.CONST, self.CLASS, self.IMPORT, self.EXPORT):
            return -1
        return self.statement(s, i)

    def condition(self, s: str, i: int) -> int:
        return self.group(s, self.skip(s, i), "(", "sequence") if self.content(s, i).strip("\n") else -1 if self.kind(s, i) == "(" else -1

    def paren(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        return self.group(s, i, "(", "sequence") if self.kind(s, i) == "(" and self.content(s, i).strip("\n") else -1

    def statement(self, s: str, i: int) -> int:
        c = s[i]
        if c == ";":
            return i + 1
        if self.kind(s, i) == "{":
            return self.block(s, i)
        if c in (self.CONST, self.VAR) or c == self.LET and self.at(s, i + 1) and (s[i + 1] in self.names or self.kind(s, i + 1) in ("[", "{") and self.kind(s, i + 1)):
            if c == self.CONST and self.typed and self.at(s, i + 1) == self.ENUM:
                return self.statement(s, i + 1)
            return self.finish(s, self.declarators(s, i + 1, c == self.CONST and not self.ambient))
        if c == self.FUNCTION or c == self.ASYNC and self.at(s, i + 1) == self.FUNCTION:
            j = i + 1 if c == self.ASYNC else i
            k = j + 2 if self.at(s, j + 1) == "*" else j + 1
            if not self.at(s, k) or s[k] not in self.names:
                return -1
            return self.callable(s, k + 1, self.typed)
        if c == self.CLASS:
            return self.class_(s, i) if self.at(s, i + 1) and s[i + 1] in self.names else -1
        if c == self.IF:
            i = self.paren(s, i + 1)
            i = self.body(s, i) if i > 0 else -1
            j = self.skip(s, i) if i > 0 else -1
            if j > 0 and self.at(s, j) == self.ELSE:
                return self.body(s, j + 1)
            return i
        if c == self.FOR:
            j = i + 2 if self.at(s, i + 1) == self.AWAIT else i + 1
            j = self.group(s, j, "(", "for_head")
            return self.body(s, j) if j > 0 else -1
        if c == self.WHILE:
            i = self.paren(s, i + 1)
            return self.body(s, i) if i > 0 else -1
        if c == self.DO:
            i = self.body(s, i + 1)
            i = self.skip(s, i) if i > 0 else -1
            if i < 0 or self.at(s, i) != self.WHILE:
                return -1
            i = self.paren(s, i + 1)
            return i + 1 if i > 0 and self.at(s, i) == ";" else i
        if c == self.SWITCH:
            i = self.paren(s, i + 1)
            return self.group(s, self.skip(s, i), "{", "cases") if i > 0 else -1
        if c == self.TRY:
            i = self.block(s, self.skip(s, i + 1))
            seen = False
            j = self.skip(s, i) if i > 0 else -1
            if j > 0 and self.at(s, j) == self.CATCH:
                j = self.skip(s, j + 1)
                if self.kind(s, j) == "(":
                    j = self.group(s, j, "(", "params")
                i, seen = self.block(s, self.skip(s, j)) if j > 0 else -1, True
                j = self.skip(s, i) if i > 0 else -1
            if j > 0 and self.at(s, j) == self.FINALLY:
                i, seen = self.block(s, self.skip(s, j + 1)), True
            return i if seen else -1
        if c in (self.RETURN, self.THROW):
            j = i + 1
            if j >= len(s) or s[j] in ";\n":
                return self.finish(s, j) if c == self.RETURN else -1
            return self.finish(s, self.exprs(s, j))
        if c in (self.BREAK, self.CONTINUE):
            j = i + 2 if self.at(s, i + 1) and s[i + 1] in self.names else i + 1
            return self.finish(s, j)
        if c == self.DEBUGGER:
            return self.finish(s, i + 1)
        if c == self.IMPORT and self.at(s, i + 1) != "." and self.kind(s, i + 1) != "(":
            return self.finish(s, self.import_(s, i + 1))
        if c == self.EXPORT:
            return self.export(s, i + 1)
        if self.typed:
            j = self.typed_statement(s, i)
            if j:
                return j
        if c in self.names and self.at(s, i + 1) == ":":
            return self.body(s, i + 2)
        return self.finish(s, self.exprs(s, i))

    ENUM = _k("enum")

    def typed_statement(self, s: str, i: int) -> int:
        return 0

    def specifier(self, s: str, i: int) -> int:
        if self.at(s, i) and (s[i] in self.anyname or s[i] == "s"):
            i += 1
            if self.typed and self.at(s, i) and s[i] in self.anyname and s[i] != self.AS:
                i += 1
            if self.at(s, i) == self.AS:
                return i + 2 if self.at(s, i + 1) and (s[i + 1] in self.anyname or s[i + 1] == "s") else -1
            return i
        return -1

    def specifiers(self, c: str) -> bool:
        return self.list_of(c, self.specifier)

    def source(self, s: str, i: int) -> int:
        """The name of a module at i, with import attributes."""
        if self.at(s, i) != "s":
            return -1
        return self.group(s, i + 2, "{", "object") if self.at(s, i + 1) == self.WITH else i + 1

    WITH = _k("with")

    def import_(self, s: str, i: int) -> int:
        if self.at(s, i) == "s":
            return self.source(s, i)
        if self.typed and self.at(s, i) == self.TYPE and self.at(s, i + 1) != self.FROM and self.at(s, i + 1) != ",":
            i += 1
        got = False
        if self.at(s, i) and s[i] in self.names:
            i, got = i + 1, True
            if self.typed and self.at(s, i) == "=":
                return self.expr(s, i + 1)
            if self.at(s, i) == ",":
                i, got = i + 1, False
        if not got or self.kind(s, i) == "{" or self.at(s, i) == "*":
            if self.kind(s, i) == "{":
                i = self.group(s, i, "{", "specifiers")
            elif self.at(s, i) == "*" and self.at(s, i + 1) == self.AS and self.at(s, i + 2) and s[i + 2] in self.names:
                i += 3
            else:
                return -1
        return self.source(s, i + 1) if i > 0 and self.at(s, i) == self.FROM else -1

    TYPE = _k("type")

    def export(self, s: str, i: int) -> int:
        c = self.at(s, i)
        if c == self.DEFAULT:
            n = self.at(s, i + 1)
            if n == self.FUNCTION or n == self.ASYNC and self.at(s, i + 2) == self.FUNCTION:
                return self.function(s, i + 1 if n == self.FUNCTION else i + 2)
            if n == self.CLASS:
                return self.class_(s, i + 1)
            if self.typed and n:
                j = self.typed_statement(s, i + 1)
                if j:
                    return j
            return self.finish(s, self.expr(s, i + 1))
        if self.typed and c == self.TYPE and self.kind(s, i + 1) == "{":
            i += 1
        if self.kind(s, i) == "{":
            i = self.group(s, i, "{", "specifiers")
            if i > 0 and self.at(s, i) == self.FROM:
                i = self.source(s, i + 1)
            return self.finish(s, i)
        if c == "*":
            i += 1
            if self.at(s, i) == self.AS:
                i += 2
            return self.finish(s, self.source(s, i + 1)) if self.at(s, i) == self.FROM else -1
        if self.typed and c == self.AS and self.at(s, i + 1) == self.NAMESPACE:
            return self.finish(s, i + 3 if self.at(s, i + 2) and s[i + 2] in self.names else -1)
        if self.typed and c == "=":
            return self.finish(s, self.expr(s, i + 1))
        if c and c in (self.CONST, self.LET, self.VAR, self.FUNCTION, self.CLASS) or c == self.ASYNC:
            return self.statement(s, i)
        if self.typed and c:
            return self.typed_statement(s, i) or -1
        return -1

    def cases(self, c: str) -> bool:
        i, seen = self.skip(c, 0), False
        while i < len(c):
            if c[i] == self.DEFAULT and self.at(c, i + 1) == ":":
                i += 1
            elif c[i] == self.CASE:
                i = self.exprs(c, i + 1)
                if i < 0 or self.at(c, i) != ":":
                    return False
            elif seen:
                i = self.statement(c, i)
                if i < 0:
                    return False
                i = self.skip(c, i)
                continue
            else:
                return False
            i, seen = self.skip(c, i + 1), True
        return True


class Typed(Script):
    lang = "ts"
    typed = True
    soft = Script.soft + _k("type declare namespace module abstract readonly is keyof infer unique override accessor asserts satisfies")
    modifiers = _k("public private protected readonly abstract override static declare accessor async")
    casts = _k("as satisfies")

    INTERFACE, DECLARE, NAMESPACE, MODULE, ABSTRACT, KEYOF, TYPEOF, INFER, UNIQUE, READONLY, IS, ASSERTS = (_k(w) for w in "interface declare namespace module abstract keyof typeof infer unique readonly is asserts".split())

    def type(self, s: str, i: int) -> int:
        i = self.skip(s, i)
        if self.at(s, i) in ("|", "&") and self.at(s, i):
            i = self.skip(s, i + 1)
        while True:
            i = self.type_operand(s, i)
            if i < 0:
                return -1
            j = self.skip(s, i)
            c = self.at(s, j)
            if c in ("|", "&") and c:
                i = self.skip(s, j + 1)
            elif c == self.EXTENDS and self.ternary_ahead(s, j + 1):
                for mark in ("?", ":", ""):
                    i = self.type_operand(s, self.skip(s, j + 1)) if mark == "?" else self.type(s, j + 1)
                    j = self.skip(s, i) if i > 0 else -1
                    if i < 0 or mark and self.at(s, j) != mark:
                        return -1
                return i
            elif c == self.IS and c:
                i = self.skip(s, j + 1)
            else:
                return i

    def ternary_ahead(self, s: str, i: int) -> bool:
        j = self.type_operand(s, self.skip(s, i))
        return j > 0 and self.at(s, self.skip(s, j)) == "?"

    def type_operand(self, s: str, i: int) -> int:
        infers = False
        while self.at(s, i) and s[i] in (self.KEYOF, self.TYPEOF, self.INFER, self.UNIQUE, self.READONLY, self.ASSERTS, self.NEW, self.ABSTRACT) and self.at(s, i + 1) and s[i + 1] not in ",;=|&>)\n:":
            infers, i = s[i] == self.INFER, i + 1
        c = self.at(s, i)
        if infers and c and c in self.names:
            # a constraint, unless the word belongs to a conditional type around it
            j = self.type_operand(s, self.skip(s, i + 2)) if self.at(s, i + 1) == self.EXTENDS else -1
            return j if j > 0 and self.at(s, self.skip(s, j)) != "?" else i + 1
        if c == "-" and self.at(s, i + 1) == "n":
            i += 2
        elif c and (c in self.names or c in "nst" or c == CODE["void"] or c == self.IMPORT and self.kind(s, i + 1) == "("):
            i += 2 if c == self.IMPORT else 1
            while self.at(s, i) == "." and self.at(s, i + 1) and s[i + 1] in self.anyname:
                i += 2
            if self.at(s, i) == "<":
                i = self.type_args(s, i)
        elif c == "<":
            i = self.type_params(s, i)
            return self.function_type(s, i) if i > 0 else -1
        else:
            k = self.kind(s, i)
            if k == "(":
                j = self.function_type(s, i)
                i = j if j > 0 else self.group(s, i, "(", "types")
            elif k == "[":
                i = self.group(s, i, "[", "tuple_types")
            elif k == "{":
                i = self.group(s, i, "{", "type_body")
            else:
                return -1
        while i > 0 and self.kind(s, i) == "[":
            inner = self.content(s, i)
            if inner.strip("\n") and not self.whole("types", inner):
                return -1
            i += 1
        return i

    def function_type(self, s: str, i: int) -> int:
        i = self.group(s, i, "(", "params")
        return self.type(s, i + 1) if i > 0 and self.at(s, i) == "r" else -1

    def types(self, c: str) -> bool:
        return bool(c.strip("\n")) and self.list_of(c, self.type)

    def tuple_type(self, s: str, i: int) -> int:
        if self.at(s, i) == "e":
            i += 1
        if self.at(s, i) and s[i] in self.names and self.at(s, i + 1) in (":", "?") and self.at(s, i + 1):
            i += 2 if s[i + 1] == ":" else 3
        i = self.type(s, i)
        return i + 1 if i > 0 and self.at(s, i) == "?" else i

    def tuple_types(self, c: str) -> bool:
        return self.list_of(c, self.tuple_type)

    def type_args(self, s: str, i: int) -> int:
        while True:
            i = self.type(s, i + 1)
            i = self.skip(s, i) if i > 0 else -1
            if i < 0:
                return -1
            if s[i : i + 1] == ">":
                return i + 1
            if self.at(s, i) != ",":
                return -1

    def generic_or_assertion(self, s: str, i: int, block: bool) -> int:
        """<T>(params) => body, or <type>operand."""
        j = self.type_params(s, i)
        if j > 0 and self.kind(s, j) == "(":
            k = self.arrow_after(s, j + 1)
            if k and self.whole("params", self.content(s, j)):
                return self.arrow_body(s, k)
        j = self.type_args(s, i)
        return self.operand(s, j, block) if j > 0 else -1

    def type_params(self, s: str, i: int) -> int:
        first = i
        while True:
            i = self.skip(s, i + 1)
            if self.at(s, i) == ">" and i > first + 1:
                return i + 1
            while self.at(s, i) in (self.CONST, self.IN) or self.at(s, i) == "i" and self.at(s, i + 1) and s[i + 1] in self.names:
                i += 1  # const, in, out
            if not self.at(s, i) or s[i] not in self.names:
                return -1
            i += 1
            if self.at(s, i) == self.EXTENDS:
                i = self.type(s, i + 1)
            if i > 0 and self.at(s, i) == "=":
                i = self.type(s, i + 1)
            i = self.skip(s, i) if i > 0 else -1
            if i > 0 and self.at(s, i) == ">":
                return i + 1
            if i < 0 or self.at(s, i) != ",":
                return -1

    def type_member(self, s: str, i: int) -> int:
        if self.at(s, i) in ("+", "-") and self.at(s, i + 1) == self.READONLY:
            i += 1
        while self.at(s, i) and s[i] in self.modifiers + self.GET + self.SET and self.at(s, i + 1) and s[i + 1] not in ":?(;,\n<" and self.kind(s, i + 1) != "(":
            i += 1
        if self.at(s, i) in ("+", "-") and self.at(s, i):
            i += 1
        if self.kind(s, i) == "(" or self.at(s, i) == "<" or self.at(s, i) == self.NEW and self.kind(s, i + 1) == "(":
            return self.callable(s, i + 1 if s[i] == self.NEW else i, True)
        if self.kind(s, i) == "[":
            i += 1  # index signature or computed name
            if self.at(s, i) in ("+", "-") and self.at(s, i):
                i += 1
        else:
            i = self.member_name(s, i)
        if i > 0 and self.at(s, i) == "?":
            i += 1
        if i > 0 and (self.kind(s, i) == "(" or self.at(s, i) == "<"):
            return self.callable(s, i, True)
        return self.type(s, i + 1) if i > 0 and self.at(s, i) == ":" else i

    def type_body(self, c: str) -> bool:
        i = 0
        while True:
            while i < len(c) and c[i] in ",;\n":
                i += 1
            if i >= len(c):
                return True
            i = self.type_member(c, i)
            if i < 0 or i < len(c) and c[i] not in ",;\n":
                return False

    def decorator(self, s: str, i: int) -> int:
        return self.operand(s, i + 1, True)

    def enum_member(self, s: str, i: int) -> int:
        i = self.member_name(s, i)
        return self.expr(s, i + 1) if i > 0 and self.at(s, i) == "=" else i

    def enum_body(self, c: str) -> bool:
        return self.list_of(c, self.enum_member)

    def typed_statement(self, s: str, i: int) -> int:
        """Position after a statement only TypeScript has, -1 if it is broken, 0 if it is none."""
        c, n = s[i], self.at(s, i + 1)
        if c == "@":
            j = self.skip(s, self.decorator(s, i))
            return self.statement(s, j) if 0 < j < len(s) and s[j] in (self.CLASS, self.EXPORT, self.ABSTRACT, "@") else -1
        if c == self.INTERFACE:
            if not n or n not in self.names:
                return -1
            i += 2
            if self.at(s, i) == "<":
                i = self.type_params(s, i)
            if i > 0 and self.at(s, i) == self.EXTENDS:
                i = self.type(s, i + 1)
                while i > 0 and self.at(s, i) == ",":
                    i = self.type(s, i + 1)
            return self.group(s, self.skip(s, i), "{", "type_body") if i > 0 else -1
        if c == self.TYPE and n and n in self.names and self.at(s, i + 2) in ("=", "<") and self.at(s, i + 2):
            i += 2
            if s[i] == "<":
                i = self.type_params(s, i)
            return self.finish(s, self.type(s, i + 1)) if i > 0 and self.at(s, i) == "=" else -1
        if c == self.ENUM:
            return self.group(s, i + 2, "{", "enum_body") if n and n in self.names else -1
        if c == self.ABSTRACT and n == self.CLASS:
            return self.statement(s, i + 1)
        if c == self.DECLARE and n and n not in "=.;\n,:" and self.kind(s, i + 1) == "":
            if n in (self.CONST, self.LET, self.VAR):
                return self.finish(s, self.declarators(s, i + 2, False))
            outer, self.ambient = self.ambient, True
            j = self.block(s, i + 2) if n == "i" and self.kind(s, i + 2) == "{" else self.statement(s, i + 1)  # declare global
            self.ambient = outer
            return j
        if c in (self.NAMESPACE, self.MODULE) and n and (n in self.names or n == "s"):
            i += 2
            while self.at(s, i) == "." and self.at(s, i + 1):
                i += 2
            return self.block(s, i)
        return 0


class Java(Grammar):
    lang = "java"
    soft = _k("record yield sealed permits var module open requires exports opens uses provides transitive to with")
    word_ops = ""

    (PACK, IMP, CLASS, INTERFACE, ENUM, RECORD, EXTENDS, IMPLEMENTS, PERMITS, THROWS, STATIC, DEFAULT, NEW, INSTANCEOF, IF, ELSE, FOR, WHILE, DO, SWITCH, CASE, TRY, CATCH, FINALLY, RETURN, THROW, BREAK, CONTINUE, ASSERT, SYNC, YIELD, FINAL) = (
        _k(w) for w in "package import class interface enum record extends implements permits throws static default new instanceof if else for while do switch case try catch finally return throw break continue assert synchronized yield final".split()
    )
    modifiers = _k("public private protected static final abstract native synchronized transient volatile strictfp default sealed non-sealed")

    def top(self, s: str) -> int | None:
        i, flags = 0, 0
        while i < len(s):
            c = s[i]
            if c == ";":
                i += 1
                continue
            if c == self.PACK:
                if flags:
                    return None
                flags = PACKAGE
                i = self.dotted(s, i + 1)
                i = i + 1 if i > 0 and self.at(s, i) == ";" else -1
            elif c == self.IMP:
                if flags & DECLARATION:
                    return None
                flags |= IMPORT
                i += 2 if self.at(s, i + 1) == self.STATIC else 1
                i = self.dotted(s, i)
                if i > 0 and self.at(s, i) == "." and self.at(s, i + 1) == "*":
                    i += 2
                i = i + 1 if i > 0 and self.at(s, i) == ";" else -1
            else:
                flags |= DECLARATION
                j = self.mods(s, i)
                i = self.module(s, j) if j >= 0 and self.at(s, j) in (self.OPEN, self.MODULE) else self.type_declaration(s, j)
            if i < 0:
                return None
        return flags

    MODULE, OPEN, REQUIRES, EXPORTS, OPENS, USES, PROVIDES, TRANSITIVE, TO, WITH = (_k(w) for w in "module open requires exports opens uses provides transitive to with".split())

    def module(self, s: str, i: int) -> int:
        if s[i] == self.OPEN:
            i += 1
        return self.group(s, self.dotted(s, i + 1), "{", "directives") if self.at(s, i) == self.MODULE and self.dotted(s, i + 1) > 0 else -1

    def directives(self, c: str) -> bool:
        i = 0
        while i < len(c):
            k = c[i]
            if k not in (self.REQUIRES, self.EXPORTS, self.OPENS, self.USES, self.PROVIDES):
                return False
            i += 1
            while k == self.REQUIRES and self.at(c, i) in (self.TRANSITIVE, self.STATIC) and self.at(c, i + 1) not in (";", "."):
                i += 1
            i = self.dotted(c, i)
            if i > 0 and self.at(c, i) == {self.EXPORTS: self.TO, self.OPENS: self.TO, self.PROVIDES: self.WITH}.get(k):
                i = self.dotted(c, i + 1)
                while i > 0 and self.at(c, i) == ",":
                    i = self.dotted(c, i + 1)
            if i < 0 or self.at(c, i) != ";":
                return False
            i += 1
        return True

    def dotted(self, s: str, i: int) -> int:
        if not self.at(s, i) or s[i] not in self.names:
            return -1
        i += 1
        while self.at(s, i) == "." and self.at(s, i + 1) and s[i + 1] in self.names:
            i += 2
        return i

    def mods(self, s: str, i: int) -> int:
        while i >= 0 and self.at(s, i):
            if s[i] == "@" and self.at(s, i + 1) != self.INTERFACE:
                i = self.dotted(s, i + 1)
                if i > 0 and self.kind(s, i) == "(":
                    i = self.group(s, i, "(", "annotation_args")
            elif s[i] in self.modifiers and not (s[i] == self.DEFAULT and self.at(s, i + 1) in (":", "r")):
                i += 1
            else:
                break
        return i

    def annotation_value(self, s: str, i: int) -> int:
        if self.at(s, i) and s[i] in self.names and self.at(s, i + 1) == "=":
            i += 2
        if self.at(s, i) == "@":
            return self.mods(s, i)
        return self.group(s, i, "{", "annotation_args") if self.kind(s, i) == "{" else self.expr(s, i)

    def annotation_args(self, c: str) -> bool:
        return self.list_of(c, self.annotation_value)

    def type_declaration(self, s: str, i: int) -> int:
        if i < 0:
            return -1
        c = self.at(s, i)
        if c == "@" and self.at(s, i + 1) == self.INTERFACE:
            i, c = i + 1, self.INTERFACE
        if c not in (self.CLASS, self.INTERFACE, self.ENUM, self.RECORD) or not c or not self.at(s, i + 1) or s[i + 1] not in self.names:
            return -1
        i += 2
        if self.at(s, i) == "<":
            i = self.type_args(s, i)
        if c == self.RECORD:
            i = self.group(s, i, "(", "params") if i > 0 else -1
        while i > 0 and self.at(s, i) and s[i] in (self.EXTENDS, self.IMPLEMENTS, self.PERMITS):
            i = self.type(s, i + 1)
            while i > 0 and self.at(s, i) == ",":
                i = self.type(s, i + 1)
        return self.group(s, i, "{", "enum_body" if c == self.ENUM else "class_body") if i > 0 else -1

    def type(self, s: str, i: int) -> int:
        i = self.mods(s, i) if self.at(s, i) == "@" else i
        if self.at(s, i) == "?":
            i += 1
            if self.at(s, i) and (s[i] == self.EXTENDS or s[i] == "i" and self.at(s, i + 1) == "i"):
                return self.type(s, i + 1)
            return i
        if not self.at(s, i) or s[i] not in self.names:
            return -1
        while True:
            i += 1
            if self.at(s, i) == "<":
                i = self.type_args(s, i)
                if i < 0:
                    return -1
            if self.at(s, i) == "." and self.at(s, i + 1) and s[i + 1] in self.names:
                i += 1
            else:
                break
        while True:
            j = self.mods(s, i) if self.at(s, i) == "@" and self.at(s, i + 1) != self.INTERFACE else i
            if j < 0 or self.kind(s, j) != "[" or self.content(s, j):
                return i
            i = j + 1

    def type_args(self, s: str, i: int) -> int:
        if self.at(s, i + 1) == ">":
            return i + 2
        while True:
            i = self.type(s, i + 1)
            while i > 0 and (self.at(s, i) == "&" or self.at(s, i) == self.EXTENDS and self.at(s, i)):
                i = self.type(s, i + 1)
            if i < 0:
                return -1
            if self.at(s, i) == ">":
                return i + 1
            if self.at(s, i) != ",":
                return -1

    def param(self, s: str, i: int) -> int:
        i = self.type(s, self.mods(s, i))
        if i > 0 and self.at(s, i) == "e":
            i += 1
        if i < 0 or not self.at(s, i) or s[i] not in self.names:
            return -1
        i += 1
        while self.kind(s, i) == "[" and not self.content(s, i):
            i += 1
        return i

    def params(self, c: str) -> bool:
        return c[-1:] != "," and self.list_of(c, self.param)

    def args(self, c: str) -> bool:
        return c[-1:] != "," and self.list_of(c, self.expr)

    def lambda_params(self, c: str) -> bool:
        return self.params(c) or all(p in self.names for p in c.split(",") if p) and ",," not in c and c[-1:] != ","

    def declarators(self, s: str, i: int) -> int:
        """name [= value], ... from the first name on."""
        while True:
            if not self.at(s, i) or s[i] not in self.names:
                return -1
            i += 1
            while self.kind(s, i) == "[" and not self.content(s, i):
                i += 1
            if self.at(s, i) == "=":
                i = self.initializer(s, i + 1)
            if i < 0 or self.at(s, i) != ",":
                return i
            i += 1

    def initializer(self, s: str, i: int) -> int:
        return self.group(s, i, "{", "array") if self.kind(s, i) == "{" else self.expr(s, i)

    def array(self, c: str) -> bool:
        return self.list_of(c, self.initializer)

    def class_body(self, c: str) -> bool:
        i = 0
        while i < len(c):
            i = self.member(c, i)
            if i < 0:
                return False
        return True

    def member(self, s: str, i: int) -> int:
        if s[i] == ";":
            return i + 1
        start = i
        i = self.mods(s, i)
        if i < 0 or i >= len(s):
            return -1
        if self.kind(s, i) == "{":
            return self.block(s, i) if s[start:i] in ("", self.STATIC) else -1
        if s[i] in (self.CLASS, self.INTERFACE, self.ENUM, "@") or s[i] == self.RECORD and self.at(s, i + 1) and s[i + 1] in self.names and (self.kind(s, i + 2) == "(" or self.at(s, i + 2) == "<"):
            return self.type_declaration(s, i)
        if s[i] == "<":
            i = self.type_args(s, i)
            if i < 0:
                return -1
        if s[i] in self.names and self.kind(s, i + 1) == "(":
            return self.method(s, i + 1, False)  # constructor
        if s[i] in self.names and self.kind(s, i + 1) == "{":
            return self.block(s, i + 1)  # compact constructor of a record
        i = self.type(s, i)
        if i < 0 or not self.at(s, i) or s[i] not in self.names:
            return -1
        if self.kind(s, i + 1) == "(":
            return self.method(s, i + 1, True)
        i = self.declarators(s, i)
        return i + 1 if i > 0 and self.at(s, i) == ";" else -1

    def method(self, s: str, i: int, bodiless: bool) -> int:
        i = self.group(s, i, "(", "params")
        while i > 0 and self.kind(s, i) == "[":
            i += 1
        if i > 0 and self.at(s, i) == self.THROWS:
            i = self.type(s, i + 1)
            while i > 0 and self.at(s, i) == ",":
                i = self.type(s, i + 1)
        if i > 0 and self.at(s, i) == self.DEFAULT:
            i = self.annotation_value(s, i + 1)
        if i < 0:
            return -1
        if self.kind(s, i) == "{":
            return self.block(s, i)
        return i + 1 if bodiless and self.at(s, i) == ";" else -1

    def enum_constant(self, s: str, i: int) -> int:
        i = self.mods(s, i)
        if i < 0 or not self.at(s, i) or s[i] not in self.names:
            return -1
        i += 1
        if self.kind(s, i) == "(":
            i = self.group(s, i, "(", "args")
        if i > 0 and self.kind(s, i) == "{":
            i = self.group(s, i, "{", "class_body")
        return i

    def enum_body(self, c: str) -> bool:
        head, semi, rest = c.partition(";")
        return self.list_of(head, self.enum_constant) and (not semi or self.class_body(rest))

    def expr(self, s: str, i: int, block: bool = False) -> int:
        i = super().expr(s, i, block)
        while i > 0 and self.at(s, i) == self.INSTANCEOF:
            i = self.type(s, self.mods(s, i + 1))
            if i > 0 and self.at(s, i) and s[i] in self.names:
                i += 1
            if i > 0 and self.at(s, i) and (s[i] in self.binary or s[i] == "?"):
                # the rest of the expression, with the test as its first operand
                i = super().expr("i" + s[i:], 0, block) + i - 1 if super().expr("i" + s[i:], 0, block) > 0 else -1
        return i

    def primary(self, s: str, i: int, block: bool) -> int:
        c = self.at(s, i)
        if not c:
            return -1
        if c in self.names:
            if self.at(s, i + 1) == "r":
                return self.lambda_body(s, i + 2)
            # a generic type before :: or an array type before .class or ::
            if self.at(s, i + 1) == "<" or self.kind(s, i + 1) == "[" and not self.content(s, i + 1):
                j = self.type(s, i)
                if j > 0 and (self.at(s, j) == "c" or self.at(s, j) == "." and self.at(s, j + 1) == self.CLASS):
                    return j
            return i + 1
        if c in "ns":
            return i + 1
        if c == self.NEW:
            j = i + 1
            if self.at(s, j) and s[j] in self.names:
                while True:
                    j += 1
                    if self.at(s, j) == "<":
                        j = self.type_args(s, j)
                    if j > 0 and self.at(s, j) == "." and self.at(s, j + 1) and s[j + 1] in self.names:
                        j += 1
                    else:
                        break
                if j < 0:
                    return -1
                if self.kind(s, j) == "(":
                    j = self.group(s, j, "(", "args")
                    return self.group(s, j, "{", "class_body") if j > 0 and self.kind(s, j) == "{" else j
                n = 0
                while self.kind(s, j) == "[":
                    inner = self.content(s, j)
                    if inner and not self.whole("only_expr", inner):
                        return -1
                    n, j = n + 1, j + 1
                if not n:
                    return -1
                return self.group(s, j, "{", "array") if self.kind(s, j) == "{" else j
            return -1
        if c == self.SWITCH:
            j = self.group(s, i + 1, "(", "only_expr")
            return self.group(s, j, "{", "cases") if j > 0 else -1
        if self.kind(s, i) == "(":
            inner = self.content(s, i)
            if self.at(s, i + 1) == "r":
                return self.lambda_body(s, i + 2) if self.whole("lambda_params", inner) else -1
            n = self.at(s, i + 1)
            if self.whole("cast_type", inner) and n and (n in self.names or n in "ns!~" or n == self.NEW or self.kind(s, i + 1) == "("):
                return self.operand(s, i + 1, block)
            return i + 1 if self.whole("only_expr", inner) else self.operand(s, i + 1, block) if self.whole("cast_type", inner) else -1
        return -1

    def cast_type(self, c: str) -> bool:
        i = self.type(c, 0)
        while i > 0 and self.at(c, i) == "&":
            i = self.type(c, i + 1)
        return i == len(c) and i > 0

    def lambda_body(self, s: str, i: int) -> int:
        return self.block(s, i) if self.kind(s, i) == "{" else self.expr(s, i)

    def postfix(self, s: str, i: int, block: bool) -> int:
        c = s[i]
        if c == ".":
            j = i + 1
            if self.at(s, j) == "<":
                j = self.type_args(s, j)
            n = self.at(s, j) if j > 0 else ""
            if n == self.NEW:
                return self.primary(s, j, block)
            return j + 1 if n and (n in self.names or n == self.CLASS) else -1
        if c == "c":
            n = self.at(s, i + 1)
            return i + 2 if n and (n in self.names or n == self.NEW) else -1
        k = self.kind(s, i)
        if k == "(":
            return self.group(s, i, "(", "args")
        if k == "[":
            return self.group(s, i, "[", "only_expr")
        return i + 1 if c == "x" else i

    def effect(self, s: str, i: int) -> int:
        """An expression that may be a statement: assignment, step, call or creation."""
        j = self.expr(s, i)
        if j < 0:
            return -1
        first = self.operand(s, i, False)
        if self.at(s, first) in ("=", "a") and self.at(s, first):
            return j
        if first != j:
            return -1
        return j if s[i] in ("x", self.NEW) or s[j - 1] == "x" or self.kind(s, j - 1) == "(" and j - 1 > i or self.kind(s, j - 1) == "{" else -1

    def local(self, s: str, i: int) -> int:
        """A local variable declaration without its semicolon, or -1."""
        j = self.type(s, self.mods(s, i))
        if j < 0 or not self.at(s, j) or s[j] not in self.names or self.at(s, j + 1) not in ("=", ";", ",", ":", "") and self.kind(s, j + 1) != "[":
            return -1
        return self.declarators(s, j)

    def for_head(self, c: str) -> bool:
        i = self.type(c, self.mods(c, 0))
        if i > 0 and self.at(c, i) and c[i] in self.names and self.at(c, i + 1) == ":":
            return self.expr(c, i + 2) == len(c)
        parts = c.split(";")
        if len(parts) != 3:
            return False
        first, test, step = parts
        if first and self.local(first, 0) != len(first) and not self.list_of(first, self.effect):
            return False
        return (not test or self.expr(test, 0) == len(test)) and self.list_of(step, self.effect)

    def resource(self, s: str, i: int) -> int:
        j = self.local(s, i)
        return j if j > 0 else self.expr(s, i)

    def resources(self, c: str) -> bool:
        return bool(c) and self.list_of(c, self.resource, False, ";")

    def catch_param(self, c: str) -> bool:
        i = self.type(c, self.mods(c, 0))
        while i > 0 and self.at(c, i) == "|":
            i = self.type(c, i + 1)
        return i > 0 and i == len(c) - 1 and c[i] in self.names

    def semi(self, s: str, i: int) -> int:
        return i + 1 if i > 0 and self.at(s, i) == ";" else -1

    def body(self, s: str, i: int) -> int:
        return self.statement(s, i) if 0 < i < len(s) else -1

    def statement(self, s: str, i: int) -> int:
        c = s[i]
        if c == ";":
            return i + 1
        if self.kind(s, i) == "{":
            return self.block(s, i)
        if c == self.IF:
            i = self.body(s, self.group(s, i + 1, "(", "only_expr"))
            return self.body(s, i + 1) if i > 0 and self.at(s, i) == self.ELSE else i
        if c == self.FOR:
            return self.body(s, self.group(s, i + 1, "(", "for_head"))
        if c == self.WHILE:
            return self.body(s, self.group(s, i + 1, "(", "only_expr"))
        if c == self.DO:
            i = self.body(s, i + 1)
            if i < 0 or self.at(s, i) != self.WHILE:
                return -1
            return self.semi(s, self.group(s, i + 1, "(", "only_expr"))
        if c == self.SWITCH:
            i = self.group(s, i + 1, "(", "only_expr")
            return self.group(s, i, "{", "cases") if i > 0 else -1
        if c == self.TRY:
            i, seen = i + 1, False
            if self.kind(s, i) == "(":
                i, seen = self.group(s, i, "(", "resources"), True
            i = self.block(s, i) if i > 0 else -1
            while i > 0 and self.at(s, i) == self.CATCH:
                i, seen = self.group(s, i + 1, "(", "catch_param"), True
                i = self.block(s, i) if i > 0 else -1
            if i > 0 and self.at(s, i) == self.FINALLY:
                i, seen = self.block(s, i + 1), True
            return i if seen else -1
        if c == self.RETURN:
            return i + 2 if self.at(s, i + 1) == ";" else self.semi(s, self.expr(s, i + 1))
        if c == self.THROW:
            return self.semi(s, self.expr(s, i + 1))
        if c in (self.BREAK, self.CONTINUE):
            return self.semi(s, i + 2 if self.at(s, i + 1) and s[i + 1] in self.names else i + 1)
        if c == self.ASSERT:
            i = self.expr(s, i + 1)
            return self.semi(s, self.expr(s, i + 1) if i > 0 and self.at(s, i) == ":" else i)
        if c == self.SYNC and self.kind(s, i + 1) == "(":
            i = self.group(s, i + 1, "(", "only_expr")
            return self.block(s, i) if i > 0 else -1
        if c == self.YIELD and self.at(s, i + 1) not in ("=", ".", "a", "x"):
            return self.semi(s, self.expr(s, i + 1))
        j = self.mods(s, i)
        if j >= 0 and self.at(s, j) and (s[j] in (self.CLASS, self.INTERFACE, self.ENUM) or s[j] == self.RECORD and self.at(s, j + 1) and s[j + 1] in self.names and self.kind(s, j + 2) in ("(", "") and self.at(s, j + 2) not in ("=", ";", ",", ":")):
            return self.type_declaration(s, j)
        if c in self.names and self.at(s, i + 1) == ":":
            return self.body(s, i + 2)
        j = self.local(s, i)
        return self.semi(s, j if j > 0 else self.effect(s, i))

    def case_label(self, s: str, i: int) -> int:
        if self.at(s, i) == self.DEFAULT:
            return i + 1
        return self.operand_label(s, i)

    def operand_label(self, s: str, i: int) -> int:
        """Constants of a case; an arrow after the last one is no lambda."""
        if self.at(s, i) and s[i] in self.names and self.at(s, i + 1) in ("r", ":", ",") and self.at(s, i + 1):
            return i + 1
        for stop in ("r", ":"):
            j = s.find(stop, i)
            if j > 0 and self.list_of(s[i:j], self.expr):
                return j
        return -1

    def cases(self, c: str) -> bool:
        i, seen = 0, False
        while i < len(c):
            if c[i] == self.DEFAULT and self.at(c, i + 1) in (":", "r"):
                i += 1
            elif c[i] == self.CASE:
                i = self.case_label(c, i + 1)
                while i > 0 and self.at(c, i) == ",":
                    i = self.case_label(c, i + 1)
                if i < 0:
                    return False
            elif seen:
                i = self.statement(c, i)
                if i < 0:
                    return False
                continue
            else:
                return False
            if self.at(c, i) == "r":
                i += 1
                if self.kind(c, i) == "{":
                    i = self.block(c, i)
                elif self.at(c, i) == self.THROW:
                    i = self.statement(c, i)
                else:
                    i = self.semi(c, self.expr(c, i))
                if i < 0:
                    return False
                seen = False
            elif self.at(c, i) == ":":
                i, seen = i + 1, True
            else:
                return False
        return True


GRAMMARS = {"go": Go, "java": Java, "js": Script, "ts": Typed}
