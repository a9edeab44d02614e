"""Generated, minified, vendored files and data blobs among source files.

Every chunk is lexed and re-emitted in canonical form, one statement or opening or closing brace to a line, and compared with the original layout.
What the chunks give are counts and hashes, which add up to those of the file by plain aggregations:

- canonical lines over original lines: extreme expansion marks minified code;
- the share of canonical lines whose shape (names, numbers and strings erased) equals that of the line one period before, the period being the
  chunk's own and of any length, or that stand in a chunk shaped like another one of the file: uniformity over many lines marks output of a tool;
- characters of data (numbers, long strings without white space) over those of data, other literals, names and words: dominance marks a block of data.

Third-party copies don't differ in layout. They are known by content, as the same canonical file in several repositories at different paths, or by a
folder that package managers or custom reserve for them. Comments prove nothing and aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, stage
from .lexing import CODE, lex, lex_python

EXTENSIONS = ["go", "py", "js", "ts", "java"]
#: Folders that hold third-party code.
VENDOR_FOLDERS = ["vendor", "vendored", "third_party", "thirdparty", "third-party", "3rdparty", "node_modules", "bower_components", "external", "externals", "extern", "deps", "Godeps", "site-packages"]
#: A folder named by a library and its version, as in name-1.2.3.
VERSIONED = r"(?:^|/)[A-Za-z][\w.]*[-@]v?\d+(?:\.\d+)+(?:[-+.]\w+)*/"
_HEAD = re.compile(r"\A(?:\s*(?://[^\n]*|#[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?''')\s*?(?:\n|\Z))+", re.S)
_PIECE = re.compile(r"[^;{}\n]*[;{}]|[^;{}\n]+")
_DROP = re.compile(r"[^\w\n]+|_+")
_SKIP = (CODE["import"], CODE["package"], "import", "from", "s;")
_CODE = re.compile(r"[;(\ue000-\uf8ff]|\b(?:def|return|if|for|while|with|raise|del|assert)\b")
#: Distances between equal runs of three lines that are tried as a period: the most frequent ones.
CANDIDATES = 6


def canonical_lines(text: str, ext: str) -> tuple[list[str], int, int]:
    """(shapes of the canonical lines, characters in literals, in names and words)."""
    if ext == "py":
        tokens, literal, named = lex_python(text)
        lines = [re.sub(r"[ \t]+", " ", line).strip() for line in tokens.split("\n")]
        return [p for line in lines if line for p in (line.split(";") if ";" in line else (line,)) if p], literal, named
    tokens, _, literal, named = lex(text, ext)
    return [p for p in _PIECE.findall(tokens) if p.strip()], literal, named


def repetition(lines: list[str]) -> tuple[int, int]:
    """(lines equal to the line one period before, lines compared) at the best period. A period has to fit three times and to hold
    a statement or call: rows of a table written as code repeat by nature."""
    ids: dict[str, int] = {}
    shapes = np.array([ids.setdefault(x, len(ids)) for x in lines], np.int64)
    code = np.array([bool(_CODE.search(x)) for x in ids])
    n = len(shapes)
    if n < 6:
        return 0, n
    runs = shapes[:-2] * np.int64(1_000_003) + shapes[1:-1] * np.int64(10_007) + shapes[2:]
    order = np.argsort(runs, kind="stable")
    gap = (order[1:] - order[:-1])[runs[order[1:]] == runs[order[:-1]]]
    periods, times = np.unique(gap[gap <= n // 3], return_counts=True)
    best = (0, n)
    for p in periods[np.argsort(-times, kind="stable")[:CANDIDATES]]:
        equal = shapes[p:] == shapes[:-p]
        same = int(equal.sum()) if code[shapes[p:][equal]].any() else 0
        if same * best[1] > best[0] * (n - int(p)):
            best = same, n - int(p)
    return best


def chunk_features(text: str, ext: str) -> tuple[int, int, int, int, int, int, int, int, int]:
    """(original lines, canonical lines, characters in literals, in names, repeated lines and compared ones, hash of the shapes,
    two sums of hashes of the lines behind the opening comment, each of its letters and digits: they don't depend on where a file is cut)."""
    import xxhash

    lines, literal, named = canonical_lines(text, ext)
    body = [x for x in lines if not x.startswith(_SKIP)]
    same, compared = repetition(body)
    head = _HEAD.match(text)
    shape = xxhash.xxh3_64_intdigest("\n".join(body)) >> 1
    keys = [xxhash.xxh3_64_intdigest(x) for x in _DROP.sub("", text[head.end() if head else 0 :].lower()).split("\n") if x]
    return sum(1 for x in text.split("\n") if x.strip()), len(body), literal, named, same, compared, shape, sum(k >> 32 for k in keys), sum(k & 0xFFFFFFFF for k in keys)


_COUNTS = ["lines", "canonical", "literal", "named", "same", "compared", "shape", "key_a", "key_b"]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [chunk_features(t or "", e) for t, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        cols = list(zip(*got)) if got else [()] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols]], names=["repository_id", "file_path", *_COUNTS])


_SCHEMA = "repository_id string, file_path string, " + ", ".join(f"{c} long" for c in _COUNTS)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def vendor_path(path: Column) -> Column:
    """Is a folder of the path one that holds third-party code?"""
    folders = "|".join(re.escape(f) for f in VENDOR_FOLDERS)
    return path.rlike(rf"(?:^|/)(?:{folders})/") | path.rlike(VERSIONED)


def file_features(chunks: DataFrame) -> DataFrame:
    """One row per file of the known extensions: the sums over its chunks, ``uniform``, the share of repeated lines, and
    key_a, key_b, sums of the hashes of its lines, which are equal for equal files.

    ``chunks``: live rows with repository_id, file_path, content. Rows with a null path or repository belong to no file; null
    contents count as empty. A file of very many chunks is summed up by the shape of its chunks first, then as a whole.
    """
    src = chunks.select("repository_id", "file_path", "content", extension(F.col("file_path")).alias("ext"))
    src = src.filter(F.col("repository_id").isNotNull() & F.col("ext").isin(EXTENSIONS))
    sums = [F.sum(c).alias(c) for c in _COUNTS if c != "shape"]
    by_shape = spread(src).mapInArrow(_features, _SCHEMA).groupBy("repository_id", "file_path", "shape").agg(*sums, F.count(F.lit(1)).alias("chunks"))
    # of equally shaped chunks all but one repeat another one as a whole
    again = F.when((F.col("chunks") > 1) & (F.col("canonical") >= 3 * F.col("chunks")), (F.col("canonical") * (F.col("chunks") - 1) + F.col("same")) / F.col("chunks")).otherwise(F.col("same"))
    g = by_shape.withColumn("again", again).groupBy("repository_id", "file_path").agg(*[F.sum(c).alias(c) for c in _COUNTS if c != "shape"], F.sum("again").alias("again"), F.sum("chunks").alias("chunks"))
    uniform = F.coalesce(F.try_divide("again", "compared"), F.lit(0.0))
    return g.select("repository_id", "file_path", "lines", "canonical", "literal", "named", "chunks", uniform.alias("uniform"), "key_a", "key_b")


def shared_files(files: DataFrame, least_lines: int = 10, salts: int = 16) -> DataFrame:
    """(repository_id, file_path) of the files of least_lines or more canonical lines that another repository holds too, at another
    path: a fork, which has the same paths, isn't a third-party copy. Which of the repositories is the origin can't be told, so its file is
    listed as well. A file that a third of all repositories hold is salted."""
    key = ["key_a", "key_b", "canonical"]
    f = files.filter(F.col("canonical") >= least_lines).withColumn("salt", F.pmod(F.xxhash64("repository_id", "file_path"), F.lit(salts)))
    ends = [g(c).alias(f"{n}_{c}") for c in ("repository_id", "file_path") for n, g in (("low", F.min), ("high", F.max))]
    several = f.groupBy(*key).agg(*ends).filter("low_repository_id < high_repository_id and low_file_path < high_file_path")
    several = several.select(*key, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return f.join(several, [*key, "salt"], "left_semi").select("repository_id", "file_path")


def not_hand_written(chunks: DataFrame, expansion: float = 8.0, uniform: float = 0.7, least_lines: int = 31, literal: float = 0.4) -> DataFrame:
    """(repository_id, file_path, reason) of files that people of the project did not write: vendored, data, minified or
    generated, the first that holds. Files of other extensions never count; an empty table gives an empty result."""
    f = stage(file_features(chunks), "files")
    shared = shared_files(f).withColumn("shared", F.lit(True))
    e = F.coalesce(F.try_divide("canonical", "lines"), F.lit(0.0))
    reason = (
        F.when(vendor_path(F.col("file_path")) | F.col("shared"), "vendored")
        .when(F.coalesce(F.try_divide(F.col("literal"), F.col("literal") + F.col("named")), F.lit(0.0)) >= literal, "data")
        .when(e >= expansion, "minified")
        .when((F.col("uniform") >= uniform) & (F.col("canonical") >= least_lines), "generated")
    )
    r = f.join(shared, ["repository_id", "file_path"], "left").withColumn("reason", reason)
    return r.filter(F.col("reason").isNotNull()).select("repository_id", "file_path", "reason")
