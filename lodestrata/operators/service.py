"""Search end to end: a checked request becomes one plan over chunks, repositories and stored vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import name_candidates
from ..functions.vectors import cosine_to
from . import intervals, search

MODES = ("semantic", "text", "hybrid")
SORTS = ("similarity:desc", "similarity:asc", "file_path:asc", "file_path:desc")
MAX_LIMIT, MAX_NAMES = 100, 50


@dataclass
class SearchRequest:
    """What is asked: checked on creation, ValueError if it can't be answered.

    Filters on languages, types and extensions act on the stored vectors before the limit; entity_name and visibility act after it, so that
    fewer rows than the limit may come back, unless ``prefilter`` asks for them before.
    """

    query: str
    mode: str = "semantic"
    limit: int = 10
    offset: int = 0
    threshold: float = 0.7
    sort: str = "similarity:desc"
    repository_ids: list[str] = field(default_factory=list)
    repository_names: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    chunk_types: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    model_versions: list[str] = field(default_factory=list)
    entity_name: str = ""
    visibility: list[str] = field(default_factory=list)
    prefilter: bool = False

    def __post_init__(self) -> None:
        names = self.repository_names
        wrong = (
            not self.query.strip() and "the query is empty" or self.mode not in MODES and f"mode must be one of {MODES}" or not 1 <= self.limit <= MAX_LIMIT and f"limit must be 1 to {MAX_LIMIT}" or self.offset < 0 and "offset must not be negative"
            or not 0 <= self.threshold <= 1 and "threshold must be 0 to 1" or self.sort not in SORTS and f"sort must be one of {SORTS}" or len(names) > MAX_NAMES and f"more than {MAX_NAMES} repository names"
            or len(set(names)) < len(names) and "a repository name is given twice" or any(not re.fullmatch(r"[^/\s]+(?:/[^/\s]+)+", n) for n in names) and "repository names are owner/name"
        )
        if wrong:
            raise ValueError(wrong)

    @property
    def fetched(self) -> int:
        return self.limit + self.offset


def chunk_filter(r: SearchRequest) -> Column:
    """Entity name: contained in any case; visibility: one of the list in any case."""
    c = F.lit(True)
    if r.entity_name:
        c = c & F.coalesce(F.contains(F.lower("entity_name"), F.lit(r.entity_name.lower())), F.lit(False))
    if r.visibility:
        c = c & F.coalesce(F.lower("visibility").isin([v.lower() for v in r.visibility]), F.lit(False))
    return c


def _chunks(r: SearchRequest, chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Live chunks of live repositories, restricted to the repositories asked for."""
    repos = repositories.filter("deleted_at is null").select(F.col("id").alias("repository_id"), F.col("name").alias("repository"))
    if r.repository_names:
        repos = repos.filter(F.col("repository").isin(r.repository_names))
    c = chunks.filter("deleted_at is null").filter(search.in_list(F.col("repository_id"), r.repository_ids)).withColumnRenamed("id", "chunk_id")
    return c.join(repos, "repository_id")


_COLUMNS = ["rank", "chunk_id", "repository", "file_path", "start_line", "end_line", "content", "entity_name", "visibility", "similarity"]


def semantic(r: SearchRequest, vector: list[float], chunks: DataFrame, repositories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ranked chunks by similarity to the query's vector. A chunk with several vectors counts with its best."""
    known = _chunks(r, chunks, repositories)
    e = embeddings.filter("deleted_at is null").filter(search.VectorFilter(r.repository_ids, r.model_versions, r.languages, r.chunk_types, r.extensions).predicate()).select("chunk_id", "embedding")
    allowed = known.filter(chunk_filter(r)) if r.prefilter else known
    e = e.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    sim = e.filter(F.size("embedding") == len(vector)).select("chunk_id", cosine_to(F.col("embedding"), vector).alias("similarity"))
    best = sim.filter(F.col("similarity").isNotNull() & ~F.isnan("similarity")).groupBy("chunk_id").agg(F.max("similarity").alias("similarity"))
    best = best.orderBy(F.col("similarity").desc(), "chunk_id").limit(r.fetched)
    if r.threshold > 0:
        best = best.filter(F.col("similarity") >= r.threshold)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "chunk_id")))  # limit + offset rows
    got = best.join(known, "chunk_id")
    return got.select(*_COLUMNS) if r.prefilter else got.filter(chunk_filter(r)).select(*_COLUMNS)


def text(r: SearchRequest, chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Ranked chunks that match the query language; more occurrences of a plain word first, then repository, path and line."""
    known = _chunks(r, chunks, repositories).filter(search.in_list(F.lower("language"), [x.lower() for x in r.languages]) & search.in_list(F.col("chunk_type"), r.chunk_types) & search.has_extension(F.col("file_path"), r.extensions))
    hit = known.filter(search.compile_query(r.query, F.col("content"), F.col("file_path"), F.col("repository"), F.col("language")) & chunk_filter(r))
    word = F.lit(r.query.strip().lower())
    times = F.when(F.length(word) > 0, (F.length("content") - F.length(F.replace(F.lower("content"), word, F.lit("")))) / F.length(word)).otherwise(0)
    order = [F.col("times").desc(), F.col("repository"), F.col("file_path"), F.col("start_line"), F.col("chunk_id")]
    top = hit.withColumn("times", times).orderBy(*order).limit(r.fetched)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("similarity", F.lit(None).cast("double")).select(*_COLUMNS)


def line_hits(r: SearchRequest, chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """What a text engine that knows files answers: one hit per file with a line that holds the query's plain word: hit_id, repository (name),
    file_path, hit_start and hit_end (its first such line), score (the number of such lines), term."""
    known = _chunks(r, chunks, repositories)
    word = r.query.strip().lower()
    lines = known.select("repository", "file_path", "start_line", F.posexplode(F.split("content", "\n")).alias("n", "line")).filter(F.contains(F.lower("line"), F.lit(word)))
    at = F.col("start_line") + F.col("n")
    g = lines.groupBy("repository", "file_path").agg(F.min(at).alias("hit_start"), F.countDistinct(at).cast("double").alias("score"))
    return g.select(F.concat_ws("|", "repository", "file_path").alias("hit_id"), "repository", "file_path", "hit_start", F.col("hit_start").alias("hit_end"), "score", F.lit(word).alias("term"))


def resolved(hits: DataFrame, chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Hits of files as hits of chunks: of a hit with lines the chunk that overlaps them best, of one without the chunk whose name fits its term best. The repository's name is
    tried as it is, then without its host. Columns: hit_id, score, chunk_id and the chunk's own; a hit with lines that no chunk holds keeps its own place and a null
    chunk_id, one without lines is left out."""
    repos = repositories.filter("deleted_at is null").select(F.col("id").alias("repository_id"), F.col("name").alias("known"))
    c = chunks.filter("deleted_at is null").select("id", "repository_id", "file_path", "start_line", "end_line", "content", "entity_name", "qualified_name", "signature")
    named = hits.select("*", F.posexplode(name_candidates(F.col("repository"))).alias("try", "known")).join(repos, "known").withColumnRenamed("hit_id", "asked")
    named = named.withColumn("hit_id", F.struct("asked", "try"))
    keys = ["repository_id", "file_path"]
    lined = intervals.best_overlap(named.filter("hit_start is not null").select(*keys, "hit_id", "hit_start", "hit_end"), c.select(*keys, "id", "start_line", "end_line"), keys).select("hit_id", "id")
    by_name = intervals.best_by_name(named.filter("hit_start is null").select(*keys, "hit_id", "term"), c, keys).select("hit_id", "id")
    best = lined.unionByName(by_name).groupBy(F.col("hit_id.asked").alias("hit_id")).agg(F.min_by("id", "hit_id.try").alias("chunk_id"))
    place = c.join(repos, "repository_id").select(F.col("id").alias("chunk_id"), F.col("known").alias("c_repository"), F.col("file_path").alias("c_path"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), F.col("content").alias("c_content"))
    got = hits.join(best, "hit_id", "left").join(place, "chunk_id", "left").filter("chunk_id is not null or hit_start is not null")
    pick = lambda a, b: F.coalesce(a, b)
    return got.select(
        "hit_id", "score", "chunk_id", pick("c_repository", "repository").alias("repository"), pick("c_path", "file_path").alias("file_path"),
        pick("c_start", "hit_start").cast("int").alias("start_line"), pick("c_end", "hit_end").cast("int").alias("end_line"), pick("c_content", F.lit("")).alias("content"),
    )


def text_of_hits(r: SearchRequest, hits: DataFrame, found: DataFrame | None, chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """The ranked list of a text engine's hits: resolved to chunks, without those that no chunk holds but a result in ``found`` covers; by score, repository, path and line."""
    t = resolved(hits, chunks, repositories)
    if found is not None:
        bare = t.filter("chunk_id is null").withColumnsRenamed({"start_line": "hit_start", "end_line": "hit_end"})
        bare = intervals.unless_overlapping(bare, found.select("repository", "file_path", "start_line", "end_line"), ["repository", "file_path"])
        t = t.filter("chunk_id is not null").unionByName(bare.withColumnsRenamed({"hit_start": "start_line", "hit_end": "end_line"}))
    order = [F.col("score").desc(), F.col("repository"), F.col("file_path"), F.col("start_line"), F.col("chunk_id").asc_nulls_last()]
    top = t.orderBy(*order).limit(r.fetched)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # limit + offset rows


def run(r: SearchRequest, vector: list[float] | None, chunks: DataFrame, repositories: DataFrame, embeddings: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """The page asked for: chunk columns, score, source and position. ``vector`` is the query's; only text mode does without. With ``hits`` (see line_hits) of a text
    engine these are the text results, else the chunks are searched themselves."""
    if r.mode != "text" and vector is None:
        raise ValueError("the mode needs the query's vector")
    base = ["rank", "chunk_id", "repository", "file_path", "start_line", "end_line", "content"]
    if r.mode == "hybrid":
        near = semantic(r, vector, chunks, repositories, embeddings).select(*base)
        words = text(r, chunks, repositories) if hits is None else text_of_hits(r, hits, near, chunks, repositories)
        return search.page(search.fuse(near, words.select(*base)), [F.col("position")], r.limit, r.offset)
    if r.mode == "text":
        words = text(r, chunks, repositories) if hits is None else text_of_hits(r, hits, None, chunks, repositories)
        got = words.select(*base).withColumns({"score": 1.0 / F.col("rank"), "source": F.lit("text")})
    else:
        got = semantic(r, vector, chunks, repositories, embeddings).withColumns({"score": F.col("similarity"), "source": F.lit("embedding")})
    key, _, way = r.sort.partition(":")
    c = F.col("score" if key == "similarity" else key)
    return search.page(got, [c.desc() if way == "desc" else c.asc(), F.col("chunk_id")], r.limit, r.offset).select(*base[1:], "score", "source")
