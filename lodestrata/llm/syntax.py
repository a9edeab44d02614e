"""Source files that do not parse, per file and as rates.

1. Every chunk is lexed once, to a map from the lexer's state at its start (code, comment, raw string) to that at its end with the brackets left open or
   unmatched, and to tokens. What leaves nothing open is parsed as statements by the local grammar of its language (grammar, layout), which tells
   what the chunk holds (package clause, imports, declarations).
2. These summaries are reduced associatively, in order: within each range partition as they stream by, then over the partitions that a file spans. Chunks that parse alone
   make a valid file if the parts come in order; for the others the composed map shows whether the file ends inside a comment or literal or leaves brackets
   unbalanced, which settles it.
3. Only files that balance but whose chunks don't parse alone are put together and parsed as a whole. That text has to fit into a task.

What the grammar of Python rejects is confirmed by Python's own parser.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism, spread, stage
from . import layout, lexing
from .grammar import GRAMMARS, IMPORT, PACKAGE
from .origin import extension

LANGUAGES = {"go": "go", "py": "py", "js": "js", "ts": "ts", "java": "java", "json": "json"}
_VALID, _INVALID, _WHOLE = 0, 1, 2
_PARSERS: dict[str, object] = {}
#: Files to be parsed as a whole that are broadcast at most, about 100 bytes each.
MAX_BROADCAST_FILES = 200_000


def lexed(text: str, lang: str, state: str = "N") -> tuple[str, str, bool]:
    """(tokens, exit state, may they be valid?)"""
    if lang == "py":
        return layout.python_tokens(text.removeprefix("\ufeff"), state)
    if lang == "json":
        return layout.json_tokens(text), "N", True
    tokens, end, _, _ = lexing.lex(text, lang, state)
    return tokens, end, True


def statements(tokens: str, text: str, lang: str) -> int | None:
    """Flags of what tokens that leave nothing open hold; None if they aren't whole statements."""
    if lang == "json":
        return 0 if layout.json_value(tokens) else None
    g = _PARSERS.get(lang)
    if g is None:
        g = _PARSERS[lang] = layout.Python() if lang == "py" else GRAMMARS[lang]()
    return (0 if g.valid(tokens) else None) if lang == "py" else g.valid(tokens)


def parts(text: str, lang: str) -> int | None:
    """Flags of what a text of whole declarations holds; None if it doesn't parse on its own."""
    tokens, end, may = lexed(text, lang)
    flags = statements(tokens, text, lang) if may and end == "N" else None
    if flags is None and lang == "py" and layout.parses(text.removeprefix("\ufeff")):
        return 0
    return flags


def file_valid(text: str, lang: str) -> bool:
    """Is the whole text of a file valid syntax? A Go file needs its package clause, a JSON file a value."""
    flags = parts(text, lang)
    return flags is not None and (lang != "go" or bool(flags & PACKAGE))


#: What is known of consecutive chunks: their number, whether any doesn't parse alone, the parts seen, whether these are in order,
#: the encoded state map.
Summary = tuple[int, bool, int, bool, str]


def join(a: Summary, b: Summary) -> Summary:
    """The summary of two stretches of a file one after the other; associative. In order means: a package clause only at the start,
    imports before declarations."""
    clash = b[2] & PACKAGE and a[2] or b[2] & IMPORT and a[2] & ~(PACKAGE | IMPORT)
    return a[0] + b[0], a[1] or b[1], a[2] | b[2], a[3] and b[3] and not clash, _encode(lexing.combine(_decode(a[4]), _decode(b[4])))


def _encode(m: dict[str, tuple[str, str]]) -> str:
    return "|".join(f"{s}{mid}{br}" for s, (mid, br) in m.items())


def _decode(s: str) -> dict[str, tuple[str, str]]:
    return {x[0]: (x[1], x[2:]) for x in s.split("|")}


#: States that a language's lexer can be in besides N, with what ends them.
_STATES = {"py": layout.CLOSE, "json": {}, "go": {"C": "*/", "R": "`"}, "java": {"C": "*/", "R": '"""'}, "js": {"C": "*/", "R": "`"}, "ts": {"C": "*/", "R": "`"}}


def chunk_summary(text: str, lang: str) -> Summary:
    tokens, end, may = lexed(text, lang)
    states = {"N": (end, lexing.bracket_summary(tokens))}
    for state, close in _STATES[lang].items():
        if close in text:
            t, e, _ = lexed(text, lang, state)
            states[state] = e, lexing.bracket_summary(t)
        else:
            states[state] = state, ""  # all of it is comment or literal
    flags = statements(tokens, text, lang) if may and states["N"] == ("N", "") else None
    if flags is None and lang == "py" and layout.parses(text.removeprefix("\ufeff")):
        flags, states["N"] = 0, ("N", "")
    return 1, flags is None, flags or 0, True, _encode(states)


_FIELDS = ["n", "bad", "seen", "ordered", "summary"]
_TYPES = [pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
_SUMMARY = "n int, bad boolean, seen int, ordered boolean, summary string"


def _columns(summaries: list[Summary]) -> list[pa.Array]:
    cols = list(zip(*summaries)) if summaries else [()] * len(_TYPES)
    return [pa.array(c, t) for c, t in zip(cols, _TYPES)]


def _chunk_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [chunk_summary(t or "", LANGUAGES[e]) for t, e in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 3, 5)] + _columns(got), names=["repository_id", "file_path", "start_line", "id", "ext", *_FIELDS])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces the chunks of each file as they come in order: one row per file that the partition holds a part of, with its first chunk's place."""
    key, place, got = None, None, None
    for b in batches:
        done = []
        for repo, path, line, i, ext, *summary in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
            if (repo, path, ext) == key:
                got = join(got, tuple(summary))
            else:
                if key:
                    done.append((key, place, got))
                key, place, got = (repo, path, ext), (line, i), tuple(summary)
        if done:
            yield _part_rows(done)
    if key:
        yield _part_rows([(key, place, got)])


def _part_rows(done: list) -> pa.RecordBatch:
    keys = [pa.array([k[n] for k, _, _ in done], pa.string()) for n in range(3)]
    places = [pa.array([p[0] for _, p, _ in done], pa.int32()), pa.array([p[1] for _, p, _ in done], pa.string())]
    return pa.RecordBatch.from_arrays([*keys, *places, *_columns([s for _, _, s in done])], names=["repository_id", "file_path", "ext", "start_line", "id", *_FIELDS])


def verdict(ext: str, s: Summary) -> int:
    """0 valid, 1 invalid, 2 to be parsed as a whole, from the summary of a file."""
    lang, (n, bad, seen, in_order, states) = LANGUAGES[ext], s
    if lang == "json" and n > 1:
        return _WHOLE
    if not bad:
        return _VALID if in_order and (lang != "go" or seen & PACKAGE) else _INVALID
    if n == 1:
        return _INVALID
    return _WHOLE if _decode(states)["N"] == ("N", "") else _INVALID


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole = [reduce(join, (tuple(x[f] for f in _FIELDS) for x in c)) for c in b.column(3).to_pylist()]
        v = [verdict(e, s) for e, s in zip(b.column(2).to_pylist(), whole)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(v, pa.int32())], names=["repository_id", "file_path", "ext", "verdict"])


def _parse_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = [_VALID if file_valid("\n\n".join(t or "" for t in texts), LANGUAGES[e]) else _INVALID for e, texts in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(v, pa.int32())], names=["repository_id", "file_path", "ext", "verdict"])


_RESULT = "repository_id string, file_path string, ext string, verdict int"


def file_verdicts(chunks: DataFrame) -> DataFrame:
    """(repository_id, file_path, language, valid) of every file with extension go, py, js, ts, java or json.

    ``chunks``: live rows with repository_id, file_path, start_line, id, content. A file is its chunks in order of start_line (nulls
    first, then by id) with a blank line between; null contents are empty; an empty file is valid except for Go and
    JSON. Rows with a null path or repository belong to no file; an empty table gives an empty result; extra columns are ignored.
    """
    src = chunks.select("repository_id", "file_path", F.col("start_line").cast("int").alias("start_line"), F.col("id").cast("string").alias("id"), "content", extension(F.col("file_path")).alias("ext"))
    src = src.filter(F.col("repository_id").isNotNull() & F.col("ext").isin(list(LANGUAGES)))
    s = stage(spread(src).mapInArrow(_chunk_summaries, f"repository_id string, file_path string, start_line int, id string, ext string, {_SUMMARY}"), "summaries")
    order = ["repository_id", "file_path", "ext", "start_line", "id"]
    s = s.repartitionByRange(parallelism(s.sparkSession), *order).sortWithinPartitions(*order)
    parted = s.mapInArrow(_streamed, f"repository_id string, file_path string, ext string, start_line int, id string, {_SUMMARY}")
    # a file has at most as many parts as there are partitions
    by_file = parted.groupBy("repository_id", "file_path", "ext").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", *_FIELDS))).alias("c"))
    first = stage(by_file.mapInArrow(_verdicts, _RESULT), "verdicts")
    open_ = first.filter(F.col("verdict") == _WHOLE).select("repository_id", "file_path")
    texts = src.join(F.broadcast(open_) if open_.count() <= MAX_BROADCAST_FILES else open_, ["repository_id", "file_path"], "left_semi")
    texts = texts.groupBy("repository_id", "file_path", "ext").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", "content"))).alias("c"))
    second = texts.select("repository_id", "file_path", "ext", F.col("c.content").alias("texts")).mapInArrow(_parse_whole, _RESULT)
    both = first.filter(F.col("verdict") != _WHOLE).unionByName(second)
    return both.select("repository_id", "file_path", F.col("ext").alias("language"), (F.col("verdict") == _VALID).alias("valid"))


def unparsable(chunks: DataFrame) -> DataFrame:
    """(repository_id, file_path) of the files that are not valid syntax of the language of their extension."""
    return file_verdicts(chunks).filter(~F.col("valid")).select("repository_id", "file_path")


def rates(verdicts: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    g = verdicts.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid"))
    return g.withColumn("rate", F.col("invalid") / F.col("files"))
