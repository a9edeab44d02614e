"""Source trees, batch request files and a SQL table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, strings
from ..operators.chunking import cut_lines


def source_files(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = 1_000_000, tests: bool = True, ignore: list[str] | None = None) -> DataFrame:
    """(path, size, language, content) of the text files below a folder, paths relative to it. Left out: skipped folders, files over
    max_bytes, binary files, ignored paths, files that match none of the globs and, without ``tests``, test files."""
    base = root.rstrip("/").removeprefix("file:").rstrip("/") or "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _quoted(base) + "/*", "")
    f = raw.filter(F.col("length") <= max_bytes).select(rel.alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    f = f.filter(~strings.in_skipped_folder(F.col("path")) & ~code.is_binary(F.col("path"), F.col("bytes")))
    if ignore:
        f = f.filter(~strings.is_ignored(F.col("path"), ignore))
    if patterns:
        f = f.filter(" or ".join(f"path rlike '^{strings.glob_regex(p)}$'".replace("\\", "\\\\") for p in patterns))
    if not tests:
        f = f.filter(~strings.is_test_file(F.col("path")))
    return f.select("path", "size", strings.extension_language(F.col("path")).alias("language"), F.decode("bytes", "UTF-8").alias("content"))


def skipped_files(spark: SparkSession, root: str, max_bytes: int = 1_000_000) -> DataFrame:
    """(path, size, reason) of the files that source_files leaves out for their size, as binary or by folder, so that none vanishes unseen."""
    base = root.rstrip("/").removeprefix("file:").rstrip("/") or "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _quoted(base) + "/*", "")
    # the bytes of a large file aren't looked at
    reason = F.when(strings.in_skipped_folder(F.col("path")), "folder").when(F.col("size") > max_bytes, "size").when(code.is_binary(F.col("path"), F.col("bytes")), "binary")
    f = raw.select(rel.alias("path"), F.col("length").alias("size"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("bytes"))
    return f.select("path", "size", reason.alias("reason")).filter("reason is not null")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in ".+^${}[]()|\\*?" else c for c in text)


def write_requests(chunks: DataFrame, path: str) -> None:
    """One JSON line per chunk: key and content."""
    chunks.select(code.request_key(F.col("id")).alias("key"), F.struct("content").alias("request")).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding, error) of result lines; lines with another key or broken JSON have a null chunk_id."""
    r = spark.read.schema("key string, embedding array<double>, error string").json(path)
    return r.select(code.chunk_of_key(F.col("key")).alias("chunk_id"), "embedding", "error")


def register_functions(spark: SparkSession) -> None:
    """line_chunks(text, size) for SQL: rows (ord, start_line, end_line, content)."""
    from pyspark.sql.functions import udtf

    class LineChunks:
        def eval(self, text: str, size: int):
            for n, (a, b, c) in enumerate(cut_lines(text or "", size), 1):
                yield n, a, b, c

    spark.udtf.register("line_chunks", udtf(LineChunks, returnType="ord int, start_line int, end_line int, content string"))
