"""Search: exact vector top-k with filters, the text query language, rank fusion and paging."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.strings import glob_regex
from ..functions.vectors import cosine_to
from ..session import stage


def in_list(c: Column, values: list | None) -> Column:
    """Membership; an empty list is no restriction."""
    return c.isin(list(values)) if values else F.lit(True)


def has_extension(path: Column, extensions: list[str] | None) -> Column:
    """One of the suffixes; a missing dot is added, blanks are ignored; _ and % in an extension are wildcards."""
    ext = [e.strip() for e in extensions or [] if e.strip()]
    return reduce(lambda a, b: a | b, [path.like("%" + (e if e.startswith(".") else "." + e)) for e in ext]) if ext else F.lit(True)


@dataclass
class VectorFilter:
    """Restrictions on the stored vectors, all of which must hold."""

    repository_ids: list[str] = field(default_factory=list)
    model_versions: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    chunk_types: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)

    def predicate(self) -> Column:
        return (
            in_list(F.col("repository_id"), self.repository_ids) & in_list(F.col("model_version"), self.model_versions) & in_list(F.col("language"), self.languages)
            & in_list(F.col("chunk_type"), self.chunk_types) & has_extension(F.col("file_path"), self.extensions)
        )


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", embedding: str = "embedding", where: Column | None = None, at_least: float = 0.0, above: float | None = None) -> DataFrame:
    """The k rows most similar to a query vector, with similarity, distance and rank (1 is best); ties go to the smaller id.

    ``at_least`` is inclusive and applies only above 0, ``above`` is exclusive. Vectors of another length, null and zero ones are
    left out. Thresholds apply after the limit: the same rows, and the similarity is computed once. Filters reach the
    scan; the limit keeps k rows per task before anything is moved.
    """
    v = vectors if where is None else vectors.filter(where)
    v = v.filter(F.size(embedding) == len(query)).withColumn("similarity", cosine_to(F.col(embedding), query))
    best = v.filter(F.col("similarity").isNotNull()).orderBy(F.col("similarity").desc(), id_col).limit(k)
    if at_least > 0:
        best = best.filter(F.col("similarity") >= at_least)
    if above is not None:
        best = best.filter(F.col("similarity") > above)
    rank = F.row_number().over(Window.orderBy(F.col("similarity").desc(), id_col))  # k rows
    return best.withColumn("distance", 1 - F.col("similarity")).withColumn("rank", rank)


#: Query vectors that are broadcast at a time (8 bytes a number).
QUERIES_PER_PASS = 20_000
#: Similarities that a worker holds at a time (8 bytes each).
BLOCK_SCORES = 2_000_000


class Best:
    """The k best ids of each of n queries so far: by similarity, ties by the smaller id. An id may come once only."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.s, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.least = np.full(n, -np.inf)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Similarities of queries first.. (rows) to the ids (columns)."""
        n, m = scores.shape
        least = self.least[first : first + n]
        if m > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, m - self.k, axis=1)[:, m - self.k])
        q, c = np.nonzero(scores >= least[:, None])
        if not len(q):
            return
        q, s, x = np.concatenate([self.q, q + first]), np.concatenate([self.s, scores[q, c]]), np.concatenate([self.ids, ids[c]])
        _, by_id = np.unique(x, return_inverse=True)
        order = np.lexsort((by_id, -s, q))
        q, s, x = q[order], s[order], x[order]
        starts = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - starts[q] < self.k
        self.q, self.s, self.ids = q[keep], s[keep], x[keep]
        counts = np.bincount(self.q, minlength=self.n)
        full = counts == self.k
        self.least[full] = self.s[np.cumsum(counts)[full] - 1]


def _score(shared, k: int, schema: pa.Schema):
    """Arrow batches (id, its vectors) to the k best ids of each query among the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, by_length = shared.value
        best = {n: Best(len(at), k) for n, (at, _) in by_length.items()}
        for b in batches:
            vectors = b.column(1)
            owner = np.repeat(np.arange(len(b)), np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)))
            flat, ids = vectors.flatten(), np.array(b.column(0).to_pylist(), object)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(flat), -1))
            for n, (at, unit) in by_length.items():
                rows = np.nonzero(lengths == n)[0]
                m = np.asarray(pc.fill_null(pc.cast(flat.take(pa.array(rows)).flatten(), pa.float64()), np.nan)).reshape(len(rows), n)
                with np.errstate(all="ignore"):
                    m = m / np.sqrt((m * m).sum(1))[:, None]
                usable = np.isfinite(m).all(1)
                m, own = m[usable], owner[rows][usable]
                if not len(own):
                    continue
                starts = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
                step = max(1, BLOCK_SCORES // len(m))
                for first in range(0, len(at), step):
                    # 12 digits: equal vectors tie, wherever they stand in a block
                    s = np.maximum.reduceat((unit[first : first + step] @ m.T).round(12), starts, axis=1)
                    best[n].add(first, s, ids[own[starts]])
        for n, (at, _) in by_length.items():
            r = best[n]
            yield pa.RecordBatch.from_arrays([pa.array([query_ids[at[q]] for q in r.q], schema.field(0).type), pa.array(r.ids.tolist(), schema.field(1).type), pa.array(r.s)], schema=schema)

    return run


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", embedding: str = "embedding", query_id: str = "query_id", where: Column | None = None, at_least: float = 0.0, above: float | None = None, per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """top_k of every query: rows (query_id, id, similarity, distance, rank).

    ``queries`` has query_id (unique) and the same vector column. An id with several vectors counts once, with its most similar one.
    Queries are broadcast in passes and scored in blocks against all vectors; every task keeps the k best of each. Similarities
    are rounded to 12 digits; null and zero vectors, null ids and ids of queries of another length are left out, as are null, zero and
    empty queries. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    v = vectors if where is None else vectors.filter(where)
    v = v.filter(F.col(id_col).isNotNull() & F.col(embedding).isNotNull()).groupBy(id_col).agg(F.collect_list(embedding).alias(embedding))
    asked = queries.filter(F.col(query_id).isNotNull() & (F.size(embedding) > 0)).select(F.col(query_id).alias("query_id"), embedding)
    out_type = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(id_col, v.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())])
    passes = max(1, -(-asked.count() // per_pass))
    found = None
    for p in range(passes):
        ids, units = [], {}
        for r in asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toLocalIterator():
            q = np.array(r[1], np.float64)
            with np.errstate(all="ignore"):
                q = q / np.sqrt(q @ q)
            if np.isfinite(q).all():
                units.setdefault(len(q), []).append((len(ids), q))
                ids.append(r[0])
        shared = spark.sparkContext.broadcast((ids, {n: (np.array([i for i, _ in x]), np.stack([q for _, q in x])) for n, x in units.items()}))
        got = v.mapInArrow(_score(shared, k, to_arrow_schema(out_type)), out_type)
        if passes > 1:
            got = stage(got, "nearest")
            shared.destroy()
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), id_col)
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if at_least > 0:
        best = best.filter(F.col("similarity") >= at_least)
    if above is not None:
        best = best.filter(F.col("similarity") > above)
    return best.withColumn("distance", 1 - F.col("similarity"))


# text queries


def compile_query(query: str, content: Column, path: Column | None = None, repository: Column | None = None, language: Column | None = None, branch: Column | None = None) -> Column:
    """A predicate from the query language: plain words are a substring in any case; re: a regular expression on the content;
    file: a glob on the path; repo:, lang:, branch: fields; a leading 'NOT ', else the first ' AND ', else the first ' OR ' combine two terms.
    An empty query, a broken expression and a field that isn't there match everything."""
    fields = {"file": path, "repo": repository, "lang": language, "branch": branch}

    def term(t: str) -> Column:
        t = t.strip()
        if t.startswith("re:"):
            return content.rlike(t[3:]) if _compiles(t[3:]) else F.lit(True)
        for name, c in fields.items():
            if t.startswith(name + ":"):
                rest = t[len(name) + 1 :]
                if c is None:
                    return F.lit(True)
                if name == "lang":
                    return F.lower(c) == rest.lower()
                rx = glob_regex(rest) if name == "file" else rest
                return c.contains(rest) if name == "branch" else c.rlike(rx) if _compiles(rx) else F.lit(True)
        return F.contains(F.lower(content), F.lit(t.lower()))

    q = query.strip()
    if not q:
        return F.lit(True)
    if q.startswith("NOT "):
        return ~term(q[4:])
    for word in (" AND ", " OR "):
        if word in q:
            a, b = (term(x) for x in q.split(word, 1))
            return a & b if word == " AND " else a | b
    return term(q)


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


# fusion

RRF_CONSTANT = 60


def fuse(semantic: DataFrame, text: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists into one total order; with ``by`` (a query's id, say) of the two lists of each of its values.

    Both have rank, chunk_id (may be null), repository, file_path, start_line, end_line, content. Rows are the same result if they have the same
    chunk id, without one the same repository and path. A list counts once for a result, with its best rank; the
    semantic row gives the columns where there is one. Adds score, source (both, embedding, text) and position.
    """
    both = semantic.withColumn("engine", F.lit(0)).unionByName(text.withColumn("engine", F.lit(1)))
    repo = F.coalesce(F.col("repository"), F.lit(""))
    key = F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("chunk:"), "chunk_id")).when(repo != "", F.concat(F.lit("file:"), repo, F.lit("|"), "file_path")).otherwise(F.concat(F.lit("file:"), "file_path"))
    cols = ["chunk_id", "repository", "file_path", "start_line", "end_line", "content"]
    g = both.withColumn("key", key).groupBy(*by, "key").agg(
        F.min(F.when(F.col("engine") == 0, F.col("rank"))).alias("s"),
        F.min(F.when(F.col("engine") == 1, F.col("rank"))).alias("t"),
        F.min_by(F.struct(*cols), F.struct("engine", "rank")).alias("r"),
    )
    score = sum((F.coalesce(1.0 / (RRF_CONSTANT + F.col(c)), F.lit(0.0)) for c in ("s", "t")), F.lit(0.0))
    source = F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), "both").when(F.col("s").isNotNull(), "embedding").otherwise("text")
    out = g.select(*by, "r.*", score.alias("score"), source.alias("source"))
    order = [F.col("score").desc(), F.col("repository").asc_nulls_first(), "file_path", "start_line", "end_line", F.col("chunk_id").asc_nulls_first(), "source", "content"]
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit in order; the order must be total. ValueError for a limit below 1 or a negative offset."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)
