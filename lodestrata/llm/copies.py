"""Duplicates hidden by formatting: records equal but for white space, letter case, punctuation and mapping order.

The canonical key of a text is a 128-bit hash of its letters, marks and digits in lower case, made by JVM expressions. JSON and
YAML texts are first rewritten with the entries of every mapping sorted; only those texts cross into Python.

Hot keys, those with a 64th or more of the rows that an even shuffle partition would get, are found exactly by counts that are combined
before the shuffle; there can be at most 64 times as many as there are partitions. Their rows are aggregated at two levels with
a salt and joined by broadcasting the hot keys. All other keys go through one shuffle. The representative of a class is its smallest id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parallelism, spread, stage

#: A key is hot from this part of an even shuffle partition's rows on.
HOT_PART = 1 / 64
#: Hot keys that are broadcast at most (24 bytes each); beyond that the hot rows are joined by a salted shuffle.
MAX_BROADCAST_KEYS = 1_000_000
SALTS = 256

#: What counts in a text, in the JVM and in Python alike: letters, marks, numbers.
_KEPT = r"\p{L}\p{M}\p{N}"
_DROP = regex.compile(rf"[^{_KEPT}]+")
_ENTRY = re.compile(r"""^(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s|$)""")


def _plain(text: str) -> str:
    return _DROP.sub("", text.lower())


def _of_json(v: object) -> str:
    """Plain form of a decoded value; objects arrive as tuples of pairs, numbers as their source text."""
    if isinstance(v, tuple):
        return "".join(sorted(_plain(k) + _of_json(x) for k, x in v))
    if isinstance(v, list):
        return "".join(map(_of_json, v))
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else _plain(v)


def sorted_json(text: str) -> str | None:
    """Plain form of a JSON text with the entries of its objects sorted; None if it isn't JSON."""
    try:
        v = json.loads(text.lstrip("\ufeff"), object_pairs_hook=tuple, parse_int=str, parse_float=str, parse_constant=str)
    except (ValueError, RecursionError):
        return None
    return _of_json(v)


_MARKER = re.compile(r"(---|\.\.\.)(?=\s|\Z)|%")
_PROPERTIES = re.compile(r"(?:[&!]\S*\s+)*")
_BLOCK_SCALAR = re.compile(r"[|>][-+0-9]{0,2}\s*(?:\s#.*)?\Z")
_BLANK = re.compile(r"(?:\s+(?:#[^\n]*)?|(?<=[\[{,:\n])#[^\n]*)*")
_QUOTED = re.compile(r"""\"(?:[^"\\]|\\.)*\"|'(?:[^']|'')*'""", re.S)
_FLOW_PLAIN = re.compile(r"(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|\Z)|(?<!\s)#|[ \t\n]+(?![\s#]))+")
_REST = re.compile(r"[ \t]*(?:[ \t]#[^\n]*)?(?=\n|\Z)")


def _blank(text: str, at: int) -> tuple[str, int]:
    m = _BLANK.match(text, at)
    return _plain(m.group()), m.end()


def _flow(text: str, at: int) -> tuple[str, int]:
    """(plain form, end) of the flow node at a position, the entries of its mappings sorted; ValueError if it isn't one."""
    at = _PROPERTIES.match(text, at).end()
    kind = text[at : at + 1]
    if kind not in ("{", "["):
        m = _QUOTED.match(text, at) if kind in ("'", '"') else _FLOW_PLAIN.match(text, at)
        return (_plain(m.group()), m.end()) if m else ("", at)
    close, parts = "}" if kind == "{" else "]", []
    at += 1
    while True:
        # a comment belongs to the entry after it, or to that in which it stands
        note, at = _blank(text, at)
        if text[at : at + 1] == close:
            return "".join(sorted(parts) if kind == "{" else parts) + note, at + 1
        part, end = _flow(text, at)
        more, end = _blank(text, end)
        part = note + part + more
        if text[end : end + 1] == ":":
            note, end = _blank(text, end + 1)
            value, end = _flow(text, end)
            more, end = _blank(text, end)
            part += note + value + more
        if end == at or text[end : end + 1] not in (",", close):
            raise ValueError("not a flow node")
        parts.append(part)
        at = end + (text[end] == ",")


def _flow_value(text: str, at: int) -> tuple[str, int] | None:
    """(plain form, end) of a flow mapping or sequence that nothing but a comment follows on its last line."""
    start = _PROPERTIES.match(text, at).end()
    if text[start : start + 1] not in ("{", "["):
        return None
    try:
        form, end = _flow(text, start)
    except (ValueError, RecursionError):
        return None
    rest = _REST.match(text, end)
    return (form + _plain(rest.group()), rest.end()) if rest else None


def sorted_yaml(text: str) -> str:
    """Plain form of a YAML text with the entries of its block and flow mappings sorted.

    Document markers and directives are boundaries: each document is sorted on its own. Blocks follow from indentation. Among neighbours
    of one indentation that are all ``key:`` entries order is dropped, everything else (sequence items, lines of block scalars,
    plain text) keeps it. A comment line belongs to the entry after it. Never fails: what isn't YAML keeps its order.
    """
    done: list[str] = []
    part: list[str] = []
    for raw in text.lstrip("\ufeff").splitlines():
        m = _MARKER.match(raw)
        if m and (m.group(1) or not any(x.strip() and not x.startswith("#") for x in part)):
            done.append(_sorted_document(part))
            # what follows a marker opens the next document
            done.append("" if m.group(1) else _plain(raw))
            part = [" " * m.end() + raw[m.end() :]] if m.group(1) and raw[m.end() :].strip() else []
            if part and _BLOCK_SCALAR.search(raw[m.end() :].lstrip()) and _BLOCK_SCALAR.match(raw, _PROPERTIES.match(raw, len(raw) - len(raw[m.end() :].lstrip())).end()):
                part = ["--- " + raw[m.end() :].strip()]
        else:
            part.append(raw)
    return "".join(done) + _sorted_document(part)


def _sorted_document(lines: list[str]) -> str:
    rows: list[tuple] = []
    n = 0
    whole, starts = "\n".join(lines), [0]
    for raw in lines:
        starts.append(starts[-1] + len(raw) + 1)
    if lines and lines[0].startswith("--- "):  # the document is one block scalar
        return "".join(map(_plain, lines))
    while n < len(lines):
        raw = lines[n]
        n += 1
        line = raw.strip()
        if line:
            width = len(raw.expandtabs(8)) - len(raw.expandtabs(8).lstrip())
            # "- key: x" opens a sequence item that holds a mapping, indented below the dash
            while line.startswith("- ") and _ENTRY.match(line[2:].lstrip()):
                rows.append((width, "-"))
                rest = line[2:].lstrip()
                width += len(line) - len(rest)
                line = rest
            if line.startswith("#"):
                rows.append((width, line))
                continue
            key = _ENTRY.match(line)
            start = key.end() if key else len(line) - len(re.sub(r"\A(?:-\s+)+", "", line))
            value = line[start:].lstrip()
            if _BLOCK_SCALAR.match(value, _PROPERTIES.match(value).end()) and (key or start):
                first = n
                # an item's own dashes may be nested; the innermost one is the parent
                parent = width if key else width + max(0, line[:start].rstrip().rfind("-"))
                while n < len(lines) and (not lines[n].strip() or _indent(lines[n]) > parent):
                    n += 1
                rows.append((width, line, _plain(line) + "".join(map(_plain, lines[first:n]))))
                continue
            if _PROPERTIES.sub("", value, count=1)[:1] in ("{", "["):
                at = starts[n - 1] + len(raw.rstrip()) - len(value)
                got = _flow_value(whole, at)
                if got:
                    rows.append((width, line, _plain(line[:start]) + got[0]))
                    n += whole.count("\n", at, got[1])
                    continue
            rows.append((width, line))
    # stack of open blocks: (indentation, finished pieces as (is an entry, text))
    stack: list[tuple[int, list[list]]] = [(-1, [])]

    def close() -> None:
        _, pieces = stack.pop()
        body = _join(pieces)
        if stack and stack[-1][1]:
            stack[-1][1][-1][1] += body
        elif stack:
            stack[-1][1].append([False, body])

    for width, line, *form in rows:
        # items of a sequence may stand at the indentation of their key
        level = width + (0.5 if line == "-" or line.startswith("- ") else 0)
        while stack[-1][0] > level:
            close()
        if stack[-1][0] < level:
            stack.append((level, []))
        stack[-1][1].append([None if line.startswith("#") else bool(_ENTRY.match(line)), form[0] if form else _plain(line)])
    while len(stack) > 1:
        close()
    return _join(stack[0][1])


def _indent(raw: str) -> int:
    return len(raw.expandtabs(8)) - len(raw.expandtabs(8).lstrip())


def _join(pieces: list[list]) -> str:
    merged: list[list] = []
    held = ""
    for kind, text in pieces:
        if kind is None:
            held += text
        else:
            merged.append([kind, held + text])
            held = ""
    texts = [t for _, t in merged]
    if merged and all(k for k, _ in merged):
        texts.sort()
    return "".join(texts) + held


def _structured(text: str, kind: str) -> str | None:
    got = sorted_json(text) if kind == "json" or text.lstrip()[:1] in ("{", "[") else None
    return sorted_yaml(text) if got is None and kind == "yaml" else got


@F.pandas_udf(T.StringType())
def _sorted_form(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, kind in texts:
        yield pd.Series([None if t is None or k is None else _structured(t, k) for t, k in zip(content, kind)], dtype=object)


def structured_kind(path: Column, language: Column) -> Column:
    """'json' or 'yaml' by file name, else by language, else null."""
    ext, lang = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1)), F.lower(F.trim(language))
    by_ext = F.when(ext == "json", "json").when(ext.isin("yaml", "yml"), "yaml")
    return F.coalesce(by_ext, F.when((ext == "") & lang.isin("json", "yaml"), lang))


def canonical_keys(df: DataFrame, text: str = "content", path: str = "file_path", language: str = "language") -> DataFrame:
    """Adds copy_key (16 bytes); null for a null text. Columns of the input keep their names."""
    kind = structured_kind(F.col(path), F.col(language))
    df = df.withColumn("__kind", kind)
    # rows of other kinds send nulls to Python
    df = df.withColumn("__sorted", _sorted_form(F.when(F.col("__kind").isNotNull(), F.col(text)), F.col("__kind")))
    plain = F.coalesce(F.col("__sorted"), F.regexp_replace(F.lower(F.col(text)), f"[^{_KEPT}]+", ""))
    return df.withColumn("copy_key", F.unhex(F.md5(plain))).drop("__kind", "__sorted")


def _hot(rows: DataFrame, hot_rows: int | None) -> tuple[DataFrame | None, DataFrame]:
    """(the rows of hot keys with a salt, None if there are none; the other rows)."""
    if hot_rows is None:
        hot_rows = max(2, int(rows.count() * HOT_PART / parallelism(rows.sparkSession)))
    hot = rows.groupBy("copy_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_rows)
    hot = stage(hot.select(F.col("copy_key").alias("hot_key")), "hotkeys")
    n_hot = hot.count()
    if not n_hot:
        return None, rows
    side = F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot
    salted = rows.join(side, rows.copy_key == hot.hot_key, "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return salted, rows.join(side, rows.copy_key == hot.hot_key, "left_anti")


def copy_classes(keyed: DataFrame, id_col: str = "id", hot_rows: int | None = None) -> DataFrame:
    """Rows (keep_id, id) of all records in classes of two or more, the representative among them.

    ``keyed`` has id and copy_key and should be stored (it is read several times). Rows with a null id or key are in no class;
    a repeated id counts once. ``hot_rows`` sets the number of rows from which a key is hot.
    """
    rows = keyed.select(F.col(id_col).alias("id"), "copy_key").filter(F.col("id").isNotNull() & F.col("copy_key").isNotNull())
    salted, cold = _hot(rows, hot_rows)
    w = Window.partitionBy("copy_key")
    cold = cold.select("id", F.min("id").over(w).alias("keep_id"), F.max("id").over(w).alias("last")).filter(F.col("last") != F.col("keep_id")).select("keep_id", "id")
    if salted is None:
        return cold
    reps = salted.groupBy("copy_key", "salt").agg(F.min("id").alias("least"), F.max("id").alias("most")).groupBy("copy_key").agg(F.min("least").alias("keep_id"), F.max("most").alias("last"))
    reps = stage(reps.filter(F.col("last") != F.col("keep_id")).select(F.col("copy_key").alias("rep_key"), "keep_id"), "reps")
    if reps.count() <= MAX_BROADCAST_KEYS:
        both = salted.join(F.broadcast(reps), F.col("copy_key") == F.col("rep_key"))
    else:
        salts = reps.withColumn("rep_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = salted.join(salts, (F.col("copy_key") == F.col("rep_key")) & (F.col("salt") == F.col("rep_salt")))
    return cold.unionByName(both.select("keep_id", "id"))


def _keyed(df: DataFrame, id_col: str) -> DataFrame:
    src = df.select(F.col(id_col).alias("id"), "content", "file_path", "language").filter(F.col("content").isNotNull() & F.col("id").isNotNull())
    return stage(canonical_keys(spread(src)).select("id", "copy_key"), "copykeys")


def copies(df: DataFrame, hot_rows: int | None = None, id_col: str = "id") -> DataFrame:
    """keep_id, chunk_id for each record that repeats another one in another format.

    Null ids and texts are left out; texts without a letter or digit (empty ones too) are copies of each other; an empty table
    gives an empty result; extra columns are ignored.
    """
    return copy_classes(_keyed(df, id_col), "id", hot_rows).filter(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("chunk_id")).distinct()


def copy_counts(df: DataFrame, hot_rows: int | None = None, id_col: str = "id") -> DataFrame:
    """One row per distinct content: keep_id and the number of records that have it (1 for content without copies). Nulls and empty
    tables as for copies."""
    salted, cold = _hot(_keyed(df, id_col), hot_rows)
    counted = [F.min("id").alias("keep_id"), F.countDistinct("id").alias("copies")]
    out = cold.groupBy("copy_key").agg(*counted).select("keep_id", "copies")
    if salted is None:
        return out
    # an id has one salt: the counts of the salts add up
    hot = salted.groupBy("copy_key", "salt").agg(*counted).groupBy("copy_key").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    return out.unionByName(hot.select("keep_id", "copies"))
