"""Local grammars of Python and JSON.

Python: a text becomes logical lines in which names, numbers and strings are erased, so that few shapes are left; each shape is parsed once, by Python's own
parser, as a statement on its own. What holds lines together is decided here: indentation, what may follow what (else, except, case), decorators.
JSON: strings and numbers are erased and every bracketed group is matched as it closes, so that nesting has no limit.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings

#: What a state of the lexer leaves open: nothing, or a string of three quotes.
CLOSE = {"D": '"""', "S": "'''"}
_OPAQUE = re.compile(
    r"(?P<l>#[^\n]*)|(?P<j>\\\r?\n)|(?P<s>\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*''')"
    r"|(?P<D>\"\"\"[\s\S]*)|(?P<S>'''[\s\S]*)|(?P<e>[\"'][^\n]*)"
)
_PREFIX = re.compile(r"(?i)(?<!\w)(?:br?|rb?|fr?|rf|u)\Z")
_PREFIXED = re.compile(r"(?i)(?<!\w)(?:br?|rb?|fr?|rf|u)(?=[\x02-\x04])")
_NAME = re.compile(r"(?<!\w)[^\W\d]\w*")
_NUMBER = re.compile(r"(?<!\w)(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(\w*)")
_KEPT = {w: w for w in [*keyword.kwlist, "match", "case", "type", "_"]}
_BLANKS = re.compile(r"[ \t\f\r]+")
_SAME = re.compile(r"((?:x|1|\x02|\x02 ?: ?(?:x|1|\x02)) ?, ?)\1+")
_ESCAPE = re.compile(r"\\[xuUN]")
_OCTAL = re.compile(r"0[0-9_]*[1-9_][0-9_]*\Z")
_BRACKET = re.compile(r"[()\[\]{}]")
_HEAD = re.compile(r"(?:async )?(if|elif|else|for|while|with|try|except|finally|def|class|match|case)\b")

#: What may follow a compound statement at the same indentation.
_AFTER = {"if": {"elif", "else"}, "elif": {"elif", "else"}, "for": {"else"}, "while": {"else"}, "try": {"except", "finally"}, "except": {"except", "else", "finally"}}
_LATER = {"elif", "else", "except", "finally"}
_BEFORE = {"elif": "if x: pass\n", "else": "if x: pass\n", "except": "try: pass\n", "finally": "try: pass\n", "case": "match x:\n "}


def parses(text: str) -> bool:
    """Python's own parser on a whole text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def python_tokens(text: str, state: str = "N") -> tuple[str, str, bool]:
    """(text with names, numbers and strings erased, exit state, is all of it known?) of a text entered in a state. Strings that
    hold code or escapes are parsed each; where one isn't understood, the text isn't known."""
    lead = ""
    if state != "N":
        at = text.find(CLOSE[state])
        if at < 0:
            return "", state, True
        text, lead = text[at + 3 :], "\x02"
    end, known = "N", True

    def opaque(m: re.Match) -> str:
        nonlocal end, known
        kind, w = m.lastgroup, m.group()
        if kind == "s":
            prefix = ""
            if m.string[m.start() - 1 : m.start()].isalpha():
                before = _PREFIX.search(m.string[max(0, m.start() - 3) : m.start()])
                prefix = before.group().lower() if before else ""
                w = prefix + w
            if ("f" in prefix or "r" not in prefix and _ESCAPE.search(w) or "b" in prefix and not w.isascii()) and not parses(w):
                known = False
            return "\x03" if "b" in prefix else "\x04" if "f" in prefix else "\x02"
        if kind == "l":
            return ""
        if kind == "j":
            return " "
        if kind == "e":
            known = False
            return "?"
        end = kind
        return ""

    def number(m: re.Match) -> str:
        w = m.group()
        return "?" if m.group(1) or len(w) > 1 and w[0] == "0" and _OCTAL.match(w) else "1"

    named = _NAME.sub(_erased, _PREFIXED.sub("", lead + _OPAQUE.sub(opaque, text)))
    return _NUMBER.sub(number, named), end, known


def _erased(m: re.Match) -> str:
    return _KEPT.get(m[0], "x")


class _Level:
    def __init__(self, width: tuple[int, int], cases: bool = False):
        self.width, self.cases, self.after, self.last, self.decorated = width, cases, frozenset(), "", False

    def open(self) -> bool:
        """Does what came last need more at this level?"""
        return self.decorated or self.last == "try"


class Python:
    """Statements by shape; what was found about a shape is remembered."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, bool], tuple[str, bool, bool]] = {}

    def statement(self, line: str, cases: bool) -> tuple[str, bool, bool]:
        """(kind, opens a block, is it valid?) of a logical line; cases: it stands in the block of a match."""
        got = self.known.get((line, cases))
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[line, cases] = self._statement(line, cases)
        return got

    @staticmethod
    def _statement(line: str, cases: bool) -> tuple[str, bool, bool]:
        text = line.replace("\x02", '""').replace("\x03", 'b""').replace("\x04", 'f""')
        m = _HEAD.match(line)
        kind = "@" if line[0] == "@" else m.group(1) if m else ""
        opens = line[-1] == ":"
        if kind == "match" and opens and parses(text + "\n case x: pass"):
            return kind, True, True
        if kind == "match" or kind == "case" and not cases:
            kind = ""
        if cases and kind != "case":
            return kind, opens, False
        if not kind:
            return "", False, parses(text)
        if kind == "@":
            return kind, False, parses(text + "\ndef x(): pass")
        return kind, opens, parses(_BEFORE.get(kind, "") + text + (" pass" if opens else "") + ("\nfinally: pass" if kind == "try" else ""))

    def valid(self, tokens: str) -> bool:
        """Are these whole statements, the first of them not indented?"""
        levels = [_Level((0, 0))]
        block = False  # the line before opened one
        cases = False
        for width, line in logical_lines(tokens):
            top = levels[-1]
            if block:
                if not (width[0] > top.width[0] and width[1] > top.width[1]):
                    return False
                top = _Level(width, cases)
                levels.append(top)
            else:
                while width[0] < top.width[0]:
                    if top.open():
                        return False
                    levels.pop()
                    top = levels[-1]
                if width != top.width:
                    return False
            kind, opens, good = self.statement(line, top.cases)
            if not good:
                return False
            if kind in _LATER:
                if kind not in top.after or top.decorated:
                    return False
                tried = top.last in ("try", "except")
                top.after = (frozenset({"finally"}) if tried else frozenset()) if kind == "else" else frozenset(_AFTER.get(kind, ()))
            else:
                if top.last == "try" or top.decorated and kind not in ("def", "class", "@"):
                    return False
                top.decorated, top.after = kind == "@", frozenset(_AFTER.get(kind, ()))
            top.last = kind
            block, cases = opens, kind == "match"
        return not block and not any(x.open() for x in levels)


def logical_lines(tokens: str) -> list[tuple[tuple[int, int], str]]:
    """((width with tabs to eights, number of blanks), line without them) of the lines that hold anything; brackets join lines."""
    out: list[tuple[tuple[int, int], str]] = []
    held: list[str] = []
    depth, width = 0, (0, 0)
    for raw in tokens.split("\n"):
        line = raw.strip(" \t\f\r")
        if not line:
            continue
        if not held:
            lead = raw[: len(raw) - len(raw.lstrip(" \t\f"))].rpartition("\f")[2]
            width = (len(lead.expandtabs(8)), len(lead)) if lead else (0, 0)
        held.append(line)
        for b in _BRACKET.findall(line):
            depth += 1 if b in "([{" else -1
        if depth <= 0:
            line = _BLANKS.sub(" ", " ".join(held) if len(held) > 1 else line)
            out.append((width, _SAME.sub(r"\1", line) if line.count(",") > 2 else line))
            held, depth = [], 0
    if held:
        out.append((width, " ".join(held)))
    return out


_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_VALUE = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|\b(?:true|false|null)\b")
_WHITE = re.compile(r"[ \t\n\r]+")
_ARRAY, _OBJECT = re.compile(r"(?:[sv](?:,[sv])*)?"), re.compile(r"(?:s:[sv](?:,s:[sv])*)?")


def json_tokens(text: str) -> str:
    """s for a string, v for another value, brackets, commas, colons; anything else stays."""
    plain = _WHITE.sub("", _VALUE.sub("\x01", _STRING.sub("\x02", text)))
    return "?" if "s" in plain or "v" in plain else plain.replace("\x02", "s").replace("\x01", "v")


def json_value(tokens: str) -> bool:
    """One value and nothing else."""
    stack: list[list[str]] = [[]]
    at = 0
    for m in _BRACKET.finditer(tokens):
        stack[-1].append(tokens[at : m.start()])
        at = m.end()
        b = m.group()
        if b in "[{":
            stack.append([b])
        elif b in "]}" and len(stack) > 1:
            kind, *parts = stack.pop()
            if (kind == "[") != (b == "]") or not (_ARRAY if kind == "[" else _OBJECT).fullmatch("".join(parts)):
                return False
            stack[-1].append("v")
        else:
            return False
    return len(stack) == 1 and "".join([*stack[0], tokens[at:]]) in ("s", "v")
