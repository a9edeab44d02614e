"""Constructs of source files: functions, methods, classes, imports and variables, with lines, names and visibility."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .chunking import cut_lines

FIELDS = ["kind", "name", "qualified_name", "parent", "signature", "visibility", "start_line", "end_line"]
_SCHEMA = "kind string, name string, qualified_name string, parent string, signature string, visibility string, start_line int, end_line int"

_GO = [
    ("package", re.compile(r"^package\s+(?P<n>\w+)", re.M)),
    ("method", re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?(?P<p>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<n>\w+)\s*(?P<s>\([^{\n]*)", re.M)),
    ("function", re.compile(r"^func\s+(?P<n>\w+)\s*(?:\[[^\]\n]*\])?\s*(?P<s>\([^{\n]*)", re.M)),
    ("struct", re.compile(r"^type\s+(?P<n>\w+)(?:\[[^\]\n]*\])?\s+struct\b", re.M)),
    ("interface", re.compile(r"^type\s+(?P<n>\w+)(?:\[[^\]\n]*\])?\s+interface\b", re.M)),
    ("type", re.compile(r"^type\s+(?P<n>\w+)\s+(?!struct\b|interface\b)[\w*\[\].]+", re.M)),
    ("constant", re.compile(r"^const\s+(?P<n>\w+)", re.M)),
    ("variable", re.compile(r"^var\s+(?P<n>\w+)", re.M)),
    ("constant", re.compile(r"^const\s*\((?P<g>[^()]*(?:\([^()]*\)[^()]*)*)^\)", re.M)),
    ("variable", re.compile(r"^var\s*\((?P<g>[^()]*(?:\([^()]*\)[^()]*)*)^\)", re.M)),
    ("import", re.compile(r"^(?:import\s+|\t)(?:(?P<s>[\w.]+)\s+)?\"(?P<n>[^\"\n]+)\"\s*$", re.M)),
]
_JS = [
    ("class", re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)(?:\s+extends\s+(?P<s>[\w$.]+))?", re.M)),
    ("class", re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*=\s*class\b(?:\s+extends\s+(?P<s>[\w$.]+))?", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)\s*(?P<s>\([^{\n]*)", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*=\s*(?:async\s+)?(?P<s>\([^)\n]*\)|[\w$]+)\s*=>", re.M)),
    ("method", re.compile(r"^[ \t]+(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?(?P<n>#?[\w$]+)\s*(?P<s>\([^)\n]*\)(?:\s*:\s*[^{\n]+)?)\s*\{", re.M)),
    ("interface", re.compile(r"^[ \t]*(?:export\s+)?interface\s+(?P<n>[\w$]+)", re.M)),
    ("enum", re.compile(r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)", re.M)),
    ("type", re.compile(r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>[\w$]+)(?:<[^=\n]*>)?\s*=", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*=\s*(?:async\s+)?function\b\s*\*?\s*(?:[\w$]+\s*)?(?P<s>\([^{\n]*)", re.M)),
    ("function", re.compile(r"^[ \t]*(?:module\.)?exports\.(?P<n>[\w$]+)\s*=\s*(?:async\s+)?(?:function\b\s*\*?\s*(?:[\w$]+\s*)?)?(?P<s>\([^{\n=]*)", re.M)),
    ("constant", re.compile(r"^(?:export\s+)?const\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=(?!\s*(?:async\s+)?(?:function\b|class\b|\([^)\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>))", re.M)),
    ("variable", re.compile(r"^(?:export\s+)?(?:let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n;]+)?(?:=(?!\s*(?:async\s+)?(?:function\b|class\b|\([^)\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>))|;|$)", re.M)),
    ("export", re.compile(r"^[ \t]*export\s+(?:\*|\{(?P<s>[^}]*)\})(?:\s+as\s+[\w$]+)?\s+from\s+['\"](?P<n>[^'\"\n]+)['\"]", re.M)),
    ("import", re.compile(r"\bdefine\(\s*(?:['\"][^'\"\n]*['\"]\s*,\s*)?\[\s*['\"](?P<n>[^'\"\n]+)['\"]", re.M)),
    ("import", re.compile(r"^[ \t]*import\s+(?P<s>[^;'\"\n]+?\s+from\s+)?['\"](?P<n>[^'\"\n]+)['\"]", re.M)),
    ("import", re.compile(r"\brequire\(\s*['\"](?P<n>[^'\"\n]+)['\"]\s*\)", re.M)),
]
_JAVA = [
    ("package", re.compile(r"^package\s+(?P<n>[\w.]+)", re.M)),
    ("import", re.compile(r"^import\s+(?:static\s+)?(?P<n>[\w.]+(?:\.\*)?)\s*;", re.M)),
    ("class", re.compile(r"^[ \t]*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|enum|record)\s+(?P<n>\w+)", re.M)),
    ("interface", re.compile(r"^[ \t]*(?:(?:public|protected|private|static)\s+)*interface\s+(?P<n>\w+)", re.M)),
    ("method", re.compile(r"^[ \t]+(?P<m>(?:(?:public|protected|private|static|final|synchronized|abstract)\s+)*)(?!return\b|new\b|else\b|throw\b)[\w<>\[\], ?.]+\s+(?P<n>\w+)\s*(?P<s>\([^)\n]*\))\s*(?:throws\s+[\w., ]+)?\{", re.M)),
]
_CONTROL = {"if", "for", "while", "switch", "catch", "function", "return", "constructor", "do", "else", "try", "with", "super"}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _end_line(plain: str, at: int, line: int) -> int:
    """Line of the brace that closes the first one opened after ``at``, on the same statement."""
    start = plain.find("{", at)
    semi = plain.find("\n\n", at)
    if start < 0 or 0 <= semi < start:
        return line
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, start):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return plain.count("\n", 0, m.start()) + 1
    return plain.count("\n") + 1


def _private(name: str, lang: str, mods: str = "") -> bool:
    if lang == "go":
        return not name[:1].isupper() or not name[:1].isascii()
    if lang == "java":
        return "private" in mods
    return name[:1] in ("_", "#")


def by_patterns(text: str, lang: str) -> list[tuple]:
    patterns = {"go": _GO, "java": _JAVA}.get(lang, _JS)
    plain = _NOISE.sub(_blank, text)
    out = []
    owners: list[tuple[int, int, str]] = []
    package = ""
    for kind, rx in patterns:
        for m in rx.finditer(text if kind in ("import", "export") else plain):
            g = m.groupdict()
            if g.get("g") is not None:  # a group of declarations, one or several names to a line
                first = text.count("\n", 0, m.start("g")) + 1
                for n, one in enumerate(m.group("g").split("\n")):
                    names = re.match(r"[ \t]+([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)", one)
                    for name in re.findall(r"\w+", names.group(1)) if names else []:
                        qualified = f"{package}.{name}" if package and package != "main" else name
                        out.append((kind, name, qualified, None, None, "private" if _private(name, lang) else "public", first + n, first + n))
                continue
            name = m.group("n")
            line = text.count("\n", 0, m.start("n")) + 1
            if kind == "method" and (name in _CONTROL or lang not in ("go", "java") and not any(a < line <= b for a, b, _ in owners)):
                continue
            if kind in ("package", "import", "export"):
                if kind == "package":
                    package = name
                out.append((kind, name, name, None, (g.get("s") or "").strip() or None, "public", line, line))
                continue
            end = _end_line(plain, m.end("n"), line) if kind not in ("constant", "variable", "type") else line
            parent = g.get("p") or (min((o for o in owners if o[0] < line <= o[1]), key=lambda o: o[1] - o[0], default=(0, 0, None))[2] if kind == "method" else None)
            if kind in ("class", "interface", "struct"):
                owners.append((line, end, name))
            qualified = f"{parent}.{name}" if parent else f"{package}.{name}" if lang == "go" and package and package != "main" else name
            out.append((kind, name, qualified, parent, (g.get("s") or "").strip() or None, "private" if _private(name, lang, g.get("m") or "") else "public", line, end))
    return sorted(out, key=lambda r: (r[6], r[7], r[0], r[1]))


def by_syntax_tree(text: str) -> list[tuple] | None:
    """Python constructs from the syntax tree, None if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []

    def visit(node: ast.AST, owner: str | None, top: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if owner else "function"
                qualified = f"{owner}.{n.name}" if owner else n.name
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                out.append((kind, n.name, qualified, owner, f"({ast.unparse(n.args)})", "private" if n.name.startswith("_") else "public", start, n.end_lineno))
                visit(n, None, False)
            elif isinstance(n, ast.ClassDef):
                bases = [ast.unparse(b) for b in n.bases]
                abstract = any(isinstance(f, ast.FunctionDef) and any("abstractmethod" in ast.unparse(d) for d in f.decorator_list) for f in n.body)
                kind = "interface" if abstract or any(b.split(".")[-1].split("[")[0] in ("Protocol", "ABC") for b in bases) else "class"
                out.append((kind, n.name, f"{owner}.{n.name}" if owner else n.name, owner, f"({', '.join(bases)})" if bases else None, "private" if n.name.startswith("_") else "public", n.lineno, n.end_lineno))
                visit(n, n.name, False)
            elif isinstance(n, ast.Import):
                out.extend(("import", a.name, a.name, None, a.asname, "public", n.lineno, n.end_lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                out.append(("import", module, module, None, ", ".join(a.name for a in n.names if a.name != "*") or None, "public", n.lineno, n.end_lineno))
            elif top and isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for v in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                        if isinstance(v, ast.Name):
                            hidden = v.id.startswith("_") and not (v.id.startswith("__") and v.id.endswith("__"))
                            out.append(("constant" if v.id.upper() == v.id else "variable", v.id, v.id, None, None, "private" if hidden else "public", n.lineno, n.end_lineno))
            else:
                visit(n, owner, top)

    visit(tree, None, True)
    return sorted(out, key=lambda r: (r[6], r[7], r[0], r[1]))


def constructs_of(text: str, extension: str) -> list[tuple]:
    """Rows of FIELDS; a text of another language or one that doesn't parse gives none."""
    if extension == "py":
        return by_syntax_tree(text) or []
    return by_patterns(text, extension) if extension in ("go", "js", "ts", "java") else []


CHUNKED = ("function", "method", "class", "interface", "struct", "enum", "type", "constant", "variable")


def chunk_pieces(text: str, extension: str, size: int) -> list[tuple]:
    """(kind, name, qualified name, parent, signature, visibility, start line, end line, content) of the constructs of a text in order, each with its whole lines. A text
    without any, or one that its extractor can't read, is cut by lines instead, as fragments."""
    lines = text.split("\n")
    out = []
    for row in constructs_of(text, extension):
        start, end = row[6], max(row[6], min(row[7], len(lines)))
        content = "\n".join(lines[start - 1 : end])
        if row[0] in CHUNKED and content.strip():
            out.append((*row[:6], start, end, content))
    return out or [("fragment", None, None, None, None, None, a, b, c) for a, b, c in cut_lines(text, size)]


def chunk_rows(df: DataFrame, id_col: str = "id", text_col: str = "content", path_col: str = "file_path", size: int = 1000) -> DataFrame:
    """One row per chunk of each file: id, ord, chunk_type, entity_name, qualified_name, parent_entity, signature, visibility, start_line, end_line, content and the
    SHA-256 of it. Null and blank texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), *[pa.string()] * 6, pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            at, rows = [], []
            for k, (t, e) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                got = chunk_pieces(t or "", e, size)
                at += [k] * len(got)
                rows += [(n, *r) for n, r in enumerate(got, 1)]
            cols = list(zip(*rows)) if rows else [()] * 10
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["id", *_CHUNK])

    kind = dict(df.dtypes)[id_col]
    src = df.select(F.col(id_col).alias("id"), text_col, F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]+)$", 1)).alias("e"))
    got = spread(src).mapInArrow(run, f"id {kind}, ord int, chunk_type string, entity_name string, qualified_name string, parent_entity string, signature string, visibility string, start_line int, end_line int, content string")
    return got.withColumn("content_hash", F.sha2("content", 256))


_CHUNK = ["ord", "chunk_type", "entity_name", "qualified_name", "parent_entity", "signature", "visibility", "start_line", "end_line", "content"]


def constructs(df: DataFrame, id_col: str = "id", text_col: str = "content", path_col: str = "file_path") -> DataFrame:
    """One row per construct of each text, lines counted from 1; null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int32()] * 2
        for b in batches:
            at, rows = [], []
            for k, (t, e) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                got = constructs_of(t or "", e)
                at += [k] * len(got)
                rows += got
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["id", *FIELDS])

    kind = dict(df.dtypes)[id_col]
    src = df.select(F.col(id_col).alias("id"), text_col, F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]+)$", 1)).alias("e"))
    return spread(src).mapInArrow(run, f"id {kind}, {_SCHEMA}")
