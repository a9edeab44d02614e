"""From source files to stored chunks and vectors: what an indexing run computes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract, upserts


def new_chunks(files: DataFrame, repository_id: str, now: Column, size: int = 1000) -> DataFrame:
    """Chunk rows of (path, language, content) files: their constructs, or line pieces of files without any, with their hash; the id is derived from repository, path,
    hash and first line, so that a repeated run gives the same rows."""
    f = files.withColumn("f", F.struct("path", "language"))
    p = extract.chunk_rows(f.select("f", "content", "path"), "f", "content", "path", size)
    key = F.sha2(F.concat_ws("|", F.lit(repository_id), "id.path", "content_hash", F.col("start_line").cast("string")), 256)
    uid = F.regexp_replace(F.substring(key, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    rows = p.select(
        uid.alias("id"), F.lit(repository_id).alias("repository_id"), F.col("id.path").alias("file_path"), "chunk_type", F.translate("content", "\u0000", "").alias("content"), F.col("id.language").alias("language"), "entity_name", "parent_entity", "qualified_name", "signature", "visibility",
        "content_hash", "start_line", "end_line", F.lit(None).cast("int").alias("token_count"), F.lit(None).cast("timestamp").alias("token_counted_at"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return upserts.first_by(rows, upserts.CHUNK_KEY, ["start_line", "id"])


def missing_vectors(chunks: DataFrame, embeddings: DataFrame, model: str, now: Column, embed: Callable[[str], Column]) -> DataFrame:
    """Vectors for the live chunks that have none of the model yet; ``embed`` makes a column of vectors from one of texts, null where there is none."""
    have = embeddings.filter((F.col("model_version") == model) & F.col("deleted_at").isNull()).select("chunk_id")
    todo = chunks.filter("deleted_at is null").join(have, chunks.id == have.chunk_id, "left_anti")
    vec = embed("content")
    return todo.select(F.concat_ws(":", "id", F.lit(model)).alias("id"), F.col("id").alias("chunk_id"), "repository_id", vec.alias("embedding"), F.lit(model).alias("model_version"), "language", "chunk_type", "file_path", now.alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at")).filter("embedding is not null")


def index(files: DataFrame, repository_id: str, chunks: DataFrame, embeddings: DataFrame, model: str, now: Column, embed: Callable[[str], Column], size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The next versions of the chunk and vector tables after a run over a repository's files. Running it again changes nothing."""
    merged = upserts.upsert_chunks(chunks, new_chunks(files, repository_id, now, size))
    fresh = missing_vectors(merged, embeddings, model, now, embed)
    return merged, embeddings.unionByName(fresh)
