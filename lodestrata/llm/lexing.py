"""Lexers of Go, Java, JavaScript and TypeScript, and a lighter one of Python.

A text becomes a string with one character per token, so that later stages can work with string operations and dictionary look-ups
at C speed. A chunk is lexed from the normal state; for the states in which an earlier chunk can leave it (an open
block comment, raw string or template) only the first closing delimiter matters, so the map from entry state to exit state is cheap.
"""

from __future__ import annotations

import re

#: Reserved and contextual words by language.
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
JAVA_WORDS = (
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof"
    " interface native new package private protected public return static strictfp switch synchronized throw throws transient try volatile while record yield sealed permits non-sealed var module open requires exports opens uses provides transitive to with"
).split()
JS_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new"
    " return switch throw try typeof var void while with yield await let static async of from as get set"
).split()
TS_WORDS = [*JS_WORDS, *"type interface declare namespace module abstract readonly implements public private protected keyof is satisfies infer unique override accessor asserts".split()]
WORDS = {"go": GO_WORDS, "java": JAVA_WORDS, "js": JS_WORDS, "ts": TS_WORDS}

#: One private character per word, the same in all languages.
CODE = {w: chr(0xE000 + n) for n, w in enumerate(sorted({w for ws in WORDS.values() for w in ws}))}
#: Operators of several characters that become one token: b binary, a assignment, x step, d declare, r arrow, e ellipsis, o optional member, c colons, w channel arrow.
LONG = [
    (">>>=", "a"), ("&&=", "a"), ("||=", "a"), ("??=", "a"), ("**=", "a"), ("<<=", "a"), (">>=", "a"), ("&^=", "a"), ("...", "e"), ("===", "b"), ("!==", "b"),
    ("=>", "r"), ("->", "r"), ("==", "b"), ("!=", "b"), ("<=", "b"), (">=", "b"), ("&&", "b"), ("||", "b"), ("??", "b"), ("?.", "o"), ("::", "c"), (":=", "d"), ("<-", "w"),
    ("++", "x"), ("--", "x"), ("+=", "a"), ("-=", "a"), ("*=", "a"), ("/=", "a"), ("%=", "a"), ("&=", "a"), ("|=", "a"), ("^=", "a"), ("<<", "b"), ("**", "b"), ("&^", "b"),
]
_ONLY = {"go": {"=>", "->", "===", "!==", "??", "?.", "::", "**", "**=", "&&=", "||=", "??=", ">>>="}, "java": {"=>", "===", "!==", "??", "?.", ":=", "<-", "**", "&^", "&^=", "**=", "&&=", "||=", "??="}, "js": {"->", "::", ":=", "<-", "&^", "&^="}}
_ONLY["ts"] = _ONLY["js"]
_LONG = {}
for _lang, _not in _ONLY.items():
    _ops = {o: c for o, c in LONG if o not in _not}
    _LONG[_lang] = _ops, re.compile("|".join(re.escape(o) for o in sorted(_ops, key=len, reverse=True)))

_NUMBER = {
    "go": r"0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?i?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?i?",
    "java": r"0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+[fFdD]?|0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*\.?(?:[eE][+-]?\d+)?[fFdDlL]?",
    "js": r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?n?",
}
_NUMBER["ts"] = _NUMBER["js"]
_PLAIN_OCTAL = re.compile(r"0[0-9_]+$")

_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:.|\n))*"', r"'(?:[^'\\\n]|\\(?:.|\n))*'"
_REGEX_BODY = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
#: A regular expression follows an operator or opening bracket, which the match takes in (p), or one of a few words.
_REGEX = r"(?P<p>[(,=:\[!&|?{};+*%<>~^\n][ \t]*)" + _REGEX_BODY
_WORD_REGEX = "/(?:" + "|".join(rf"(?<=\b{w}{blank}/)" for w in "return typeof case else do in of void delete await yield throw".split() for blank in ("", " ")) + ")" + _REGEX_BODY[1:]
#: It also follows the head of a statement, which ends with a bracket as an operand does.
_HEAD_REGEX = rf"(?P<h>[iwf](?:(?<=\bi)f|(?<=\bw)hile|(?<=\bw)ith|(?<=\bf)or)[ \t]*\((?:[^()'\"`/\n]|\((?:[^()'\"`/\n]|\([^()'\"`/\n]*\))*\))*\)[ \t]*){_REGEX_BODY}"
_AFTER_BRACKET = re.compile(r"\)[ \t]*/(?![/*])")
_TEMPLATE = r"`(?:[^`\\$]|\\(?:.|\n)|\$(?!\{)|\$\{(?:[^{}`]|\{(?:[^{}`]|\{[^{}`]*\})*\}|`[^`]*`)*\})*`"
#: Comments and literals; what opens one without closing it comes last.
_OPAQUE = {
    "go": re.compile(rf"(?P<l>//[^\n]*)|(?P<c>/\*.*?\*/)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<q>'(?:[^'\\\n]|\\[^\n0-7xuU]|\\[0-7]{{3}}|\\x[0-9a-fA-F]{{2}}|\\u[0-9a-fA-F]{{4}}|\\U[0-9a-fA-F]{{8}})')|(?P<C>/\*.*)|(?P<R>`[^`]*$)|(?P<E>[\"'][^\n]*)", re.S),
    "java": re.compile(rf"(?P<l>//[^\n]*)|(?P<c>/\*.*?\*/)|(?P<s>\"\"\"[ \t]*\n(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\[^\n])*\")|(?P<q>'(?:[^'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\[btnfrs\"'\\])')|(?P<C>/\*.*)|(?P<R>\"\"\"[ \t]*\n.*)|(?P<E>[\"'][^\n]*)", re.S),
}
_SCRIPT = rf"(?P<l>//[^\n]*)|(?P<c>/\*.*?\*/)|(?P<s>{_DQ}|{_SQ})|(?P<t>{_TEMPLATE})|(?P<x>{_REGEX})|(?P<w>{_WORD_REGEX})|(?P<C>/\*.*)|(?P<R>`.*)|(?P<E>[\"'][^\n]*)"
_OPAQUE["js"] = _OPAQUE["ts"] = re.compile(_SCRIPT, re.S)
_WITH_HEADS = re.compile(rf"(?P<H>{_HEAD_REGEX})|{_SCRIPT}", re.S)
_CLOSE = {"C": "*/", "R": {"go": "`", "java": '"""', "js": "`", "ts": "`"}}
_NAME = {lang: re.compile(rf"(?P<n>{num})(?P<bad>[\w$]*)|{'non-sealed|' if lang == 'java' else ''}[^\W\d][\w$]*|\$[\w$]*|#[^\W\d][\w$]*") for lang, num in _NUMBER.items()}
_SPACE = re.compile(r"[ \t\r\f\v\u00a0\ufeff]+")
_SEMI_AFTER = re.compile(r"([ins)\]}x" + CODE["return"] + CODE["break"] + CODE["continue"] + CODE["fallthrough"] + r"])\n")
_LINES = re.compile(r"\n+")
_AS_NAME = {"go": "nil true false iota", "java": "this super null true false int long short byte char float double boolean void", "js": "this super null true false undefined", "ts": "this super null true false undefined"}
_ODD = re.compile(r"[^ins()\[\]{};,.:?@=<>+\-*/%&|^!~bateoxdrcwE\n\ue000-\uf8ff]")


#: Length from which a string literal without white space counts as data.
DATA_STRING = 40
_BLANK = re.compile(r"\s")


def language_of(extension: str) -> str | None:
    return {"go": "go", "java": "java", "js": "js", "ts": "ts", "py": "py", "json": "json"}.get(extension.lower())


def is_data(literal: str) -> bool:
    """Is a string literal encoded data and no text: long, without white space?"""
    return len(literal) >= DATA_STRING and _BLANK.search(literal) is None


_IN_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_IN_CODE = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|{_DQ}|{_SQ}|[`{{}}]")


def template_end(text: str, at: int) -> int:
    """Position after the template that begins there, whatever it nests; -1 if it doesn't end."""
    open_ = ["`"]
    at += 1
    while open_:
        m = (_IN_TEMPLATE if open_[-1] == "`" else _IN_CODE).search(text, at)
        if not m:
            return -1
        at, w = m.end(), m.group()
        if w == "`" and open_[-1] == "`" or w == "}":
            open_.pop()
        elif w in ("`", "{", "${"):
            open_.append("`" if w == "`" else "{")
    return at


def lex(text: str, lang: str, state: str = "N") -> tuple[str, str, int, int]:
    """(tokens, exit state, characters of data, characters of code) of a text entered in a state: N normal, C block
    comment, R raw string or template. Data are numbers and encoded strings. Tokens: i name, n number, s string, t template, the codes of words and operators, E an error; for Go semicolons
    are inserted at line ends, for JavaScript and TypeScript line ends stay."""
    literal = named = 0
    lead = ""
    if state != "N":
        close = _CLOSE[state] if state == "C" else _CLOSE[state][lang]
        at = text.find(close)
        if at < 0:
            return "", state, len(text) if state == "R" else 0, 0
        if state == "R":
            literal, lead = at, "s"
        text = text[at + len(close) :]
    elif lang in ("js", "ts") and text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    end, resume = "N", -1

    def add(w: str) -> None:
        nonlocal literal, named
        if is_data(w):
            literal += len(w)
        else:
            named += len(w)

    def opaque(m: re.Match) -> str:
        nonlocal literal, end, resume
        kind = m.lastgroup
        if kind == "l":
            return ""
        if kind == "c":
            return "\n" if "\n" in m.group() else " "
        if kind == "C":
            end = "C"
            return " "
        if kind in ("x", "H"):
            before = m.group("p" if kind == "x" else "h")
            add(m.group()[len(before) :])
            return before + "\x02"
        if kind == "R":
            at = template_end(m.string, m.start()) if lang in ("js", "ts") else -1
            if at > 0:
                resume = at
                add(m.group()[: at - m.start()])
                return "\x03"
            end = "R"
            literal += len(m.group())
            return ""
        if kind == "E":
            return "\x01"
        add(m.group())
        return "\x03" if kind == "t" else "\x02"

    pattern = _OPAQUE[lang]
    if lang in ("js", "ts"):
        if text[:1] in ("/", " ", "\t"):
            text = "\n" + text  # what a regular expression may follow
        if _AFTER_BRACKET.search(text):
            pattern = _WITH_HEADS
    t = pattern.sub(opaque, text)
    while resume > 0:
        # the pattern gave up at a template of many levels and took all that follows; a name stands for the template
        text, resume = "i" + text[resume:], -1
        t += pattern.sub(opaque, text)[1:]
    words = _TABLE[lang]

    def name(m: re.Match) -> str:
        nonlocal literal, named
        w = m.group()
        if m.lastgroup is None:
            named += len(w)
            return words.get(w) or ("i" if w[0] != "#" or lang in ("js", "ts") else "E")
        literal += len(w)
        if m.group("bad"):
            return "E"
        if len(w) > 1 and w[0] == "0" and _PLAIN_OCTAL.match(w) and (lang in ("js", "ts") or not set(w) <= set("01234567_")):
            return "E"
        return "n"

    # names and numbers first: their codes hold no letters of operators
    t = _NAME[lang].sub(lambda m: " " + name(m) + " ", t)
    ops, pattern = _LONG[lang]
    t = pattern.sub(lambda m: ops[m.group()], t)
    t = _SPACE.sub("", t)
    t = t.replace("\x02", "s").replace("\x03", "t" if lang in ("js", "ts") else "s").replace("\x01", "E")
    t = lead + t
    if lang == "go":
        t = _LINES.sub("\n", t + "\n")
        t = _SEMI_AFTER.sub(r"\1;", t).replace("\n", "")
    elif lang == "java":
        t = t.replace("\n", "")
    else:
        t = _LINES.sub("\n", t)
    return _ODD.sub("E", t), end, literal, named


_TABLE = {lang: {w: CODE[w] for w in ws} | dict.fromkeys(_AS_NAME[lang].split(), "i") for lang, ws in WORDS.items()}

_BRACKETS = re.compile(r"[^()\[\]{}]+")
_PAIRS = ("()", "[]", "{}")


def bracket_summary(tokens: str) -> str:
    """The brackets that no partner in the text cancels: closing ones, then opening ones. A mismatch leaves both, as in
    '(]'. Summaries combine associatively: summary(a + b) = summary(summary(a) + summary(b))."""
    s = _BRACKETS.sub("", tokens)
    while True:
        n = len(s)
        for p in _PAIRS:
            s = s.replace(p, "")
        if len(s) == n:
            return s


def state_map(text: str, lang: str) -> dict[str, tuple[str, str]]:
    """Entry state -> (exit state, bracket summary)."""
    out = {}
    for state in ("N", "C", "R"):
        tokens, end, _, _ = lex(text, lang, state)
        out[state] = end, bracket_summary(tokens)
    return out


def combine(a: dict[str, tuple[str, str]], b: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """The state map of two texts one after the other; associative."""
    return {s: (b[mid][0], bracket_summary(br + b[mid][1])) for s, (mid, br) in a.items()}


_PY_OPAQUE = re.compile(r"(?P<l>#[^\n]*)|(?P<s>(?:\b[rRbBuUfF]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))", re.S)
_PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_NAME = re.compile(r"(?P<n>(?:\d[\w.]*|\.\d[\w.]*))|[^\W\d]\w*")


def lex_python(text: str) -> tuple[str, int, int]:
    """(tokens with line ends and words kept, characters of data, of code): for layout only."""
    literal = named = 0

    def opaque(m: re.Match) -> str:
        nonlocal literal, named
        w = m.group()
        if m.lastgroup == "l":
            return ""
        if is_data(w):
            literal += len(w)
        else:
            named += len(w)
        return "\x02"

    def name(m: re.Match) -> str:
        nonlocal literal, named
        if m.lastgroup == "n":
            literal += len(m.group())
            return "n"
        named += len(m.group())
        return m.group() if m.group() in _PY_WORDS else "i"

    t = _PY_NAME.sub(name, _PY_OPAQUE.sub(opaque, text)).replace("\x02", "s")
    return t, literal, named
