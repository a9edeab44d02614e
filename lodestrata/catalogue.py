"""Queries of the core operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import code, strings
from .functions.vectors import cosine_to, dimension_policy, doubles, normalized, truncated
from .operators import catalog, chunking, deliveries, errors, extract, intervals, search, stats, upserts
from .session import scratch_path, spread
from .sources.tables import live, load
from .streaming import events as stream_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@register(
    "p7_found",
    r"""
WITH t AS (
  SELECT delivery_id, received_at,
         regexp_replace(request_id, '^\s+|\s+$', '', 'g') AS r, regexp_replace(correlation_id, '^\s+|\s+$', '', 'g') AS c FROM embedding_requests),
u AS (
  SELECT delivery_id, received_at,
         CASE WHEN regexp_matches(lower(r), '^(urn:)?(uuid:)?[{(]?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}[)}]?$')
              THEN regexp_replace(regexp_replace(lower(r), '^(urn:)?(uuid:)?', ''), '[^0-9a-f]', '', 'g') ELSE nullif(r, '') END AS rk,
         CASE WHEN regexp_matches(lower(c), '^(urn:)?(uuid:)?[{(]?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}[)}]?$')
              THEN regexp_replace(regexp_replace(lower(c), '^(urn:)?(uuid:)?', ''), '[^0-9a-f]', '', 'g') ELSE nullif(c, '') END AS ck FROM t)
SELECT delivery_id FROM u
QUALIFY row_number() OVER (
  PARTITION BY CASE WHEN rk IS NOT NULL THEN 'r' WHEN ck IS NOT NULL THEN 'c' ELSE 'd' END, coalesce(rk, ck, cast(delivery_id AS varchar))
  ORDER BY received_at NULLS LAST, delivery_id) > 1
""",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.surplus_deliveries(load(spark, d, "embedding_requests"))


# vectors


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return load(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding


_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_NEAR = f"SELECT e.vec_id, e.label, {_SIM} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q"


@register("vec_topk", f"WITH t AS ({_NEAR}) SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM t ORDER BY s DESC, vec_id LIMIT 20")
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    r = search.top_k(load(spark, d, "embeddings"), _vector(spark, d, 1), 20, "vec_id")
    return r.select("vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@register("vec_topk_filtered", f"WITH t AS ({_NEAR} WHERE e.label IN (1, 3, 5)) SELECT vec_id, label, round(s, 6) AS similarity FROM t ORDER BY s DESC, vec_id LIMIT 10")
def vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    r = search.top_k(load(spark, d, "embeddings"), _vector(spark, d, 1), 10, "vec_id", where=search.in_list(F.col("label"), [1, 3, 5]))
    return r.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@register("vec_threshold_ge", f"WITH t AS ({_NEAR}), k AS (SELECT * FROM t ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, round(s, 6) AS similarity FROM k WHERE s >= 0.2")
def vec_threshold_ge(spark: SparkSession, d: str) -> DataFrame:
    r = search.top_k(load(spark, d, "embeddings"), _vector(spark, d, 1), 50, "vec_id", at_least=0.2)
    return r.select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("vec_threshold_gt", f"WITH t AS ({_NEAR}), k AS (SELECT * FROM t ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, round(s, 6) AS similarity FROM k WHERE s > 0.25")
def vec_threshold_gt(spark: SparkSession, d: str) -> DataFrame:
    r = search.top_k(load(spark, d, "embeddings"), _vector(spark, d, 1), 50, "vec_id", above=0.25)
    return r.select("vec_id", F.round("similarity", 6).alias("similarity"))


@register(
    "vec_topk_join",
    """WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1),
    t AS (SELECT e.chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings_partitioned e, q
          WHERE e.deleted_at IS NULL AND len(e.embedding) = 64 AND e.model_version = 'code-embed-1' AND lower(e.file_path) LIKE '%.go'),
    u AS (SELECT chunk_id, s FROM t WHERE s IS NOT NULL AND NOT isnan(s)),
    k AS (SELECT chunk_id, max(s) AS s FROM u GROUP BY chunk_id ORDER BY max(s) DESC, chunk_id LIMIT 25)
    SELECT k.chunk_id, c.file_path, c.entity_name, round(k.s, 5) AS similarity FROM k JOIN code_chunks c ON c.id = k.chunk_id WHERE c.deleted_at IS NULL""",
)
def vec_topk_join(spark: SparkSession, d: str) -> DataFrame:
    v = live(load(spark, d, "embeddings_partitioned")).filter("model_version = 'code-embed-1' and lower(file_path) like '%.go'")
    s = v.filter(F.size("embedding") == 64).select("chunk_id", cosine_to(F.col("embedding"), _vector(spark, d, 1)).alias("s"))
    best = s.filter(~F.isnan("s") & F.col("s").isNotNull()).groupBy("chunk_id").agg(F.max("s").alias("s")).orderBy(F.col("s").desc(), "chunk_id").limit(25)
    return best.join(live(load(spark, d, "code_chunks")), F.col("chunk_id") == F.col("id")).select("chunk_id", "file_path", "entity_name", F.round("s", 5).alias("similarity"))


# the same for every vector whose id is divisible by 50; similarities that are equal to 12 digits tie

_NEAR_EACH = "SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0"
_BEST_EACH = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register("vec_topk_all", f"WITH t AS ({_NEAR_EACH}) SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM t {_BEST_EACH} <= 20")
def vec_topk_all(spark: SparkSession, d: str) -> DataFrame:
    r = search.top_k_each(load(spark, d, "embeddings"), _asked(spark, d), 20, "vec_id")
    return r.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@register("vec_topk_filtered_all", f"WITH t AS ({_NEAR_EACH} AND e.label IN (1, 3, 5)) SELECT query_id, vec_id, label, round(s, 6) AS similarity FROM t {_BEST_EACH} <= 10")
def vec_topk_filtered_all(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    r = search.top_k_each(e, _asked(spark, d), 10, "vec_id", where=search.in_list(F.col("label"), [1, 3, 5]))
    return r.join(e.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@register("vec_threshold_ge_all", f"WITH t AS ({_NEAR_EACH}), k AS (SELECT * FROM t {_BEST_EACH} <= 50) SELECT query_id, vec_id, round(s, 6) AS similarity FROM k WHERE s >= 0.2")
def vec_threshold_ge_all(spark: SparkSession, d: str) -> DataFrame:
    r = search.top_k_each(load(spark, d, "embeddings"), _asked(spark, d), 50, "vec_id", at_least=0.2)
    return r.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@register("vec_threshold_gt_all", f"WITH t AS ({_NEAR_EACH}), k AS (SELECT * FROM t {_BEST_EACH} <= 50) SELECT query_id, vec_id, round(s, 6) AS similarity FROM k WHERE s > 0.25")
def vec_threshold_gt_all(spark: SparkSession, d: str) -> DataFrame:
    r = search.top_k_each(load(spark, d, "embeddings"), _asked(spark, d), 50, "vec_id", above=0.25)
    return r.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@register(
    "vec_topk_join_all",
    """WITH t AS (SELECT q.vec_id AS query_id, e.chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS s FROM embeddings_partitioned e, embeddings q
          WHERE q.vec_id % 50 = 0 AND e.deleted_at IS NULL AND len(e.embedding) = 64 AND e.model_version = 'code-embed-1' AND lower(e.file_path) LIKE '%.go'),
    u AS (SELECT query_id, chunk_id, max(s) AS s FROM t WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1, 2),
    k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 25)
    SELECT k.query_id, k.chunk_id, c.file_path, c.entity_name, round(k.s, 5) AS similarity FROM k JOIN code_chunks c ON c.id = k.chunk_id WHERE c.deleted_at IS NULL""",
)
def vec_topk_join_all(spark: SparkSession, d: str) -> DataFrame:
    v = live(load(spark, d, "embeddings_partitioned")).filter("model_version = 'code-embed-1' and lower(file_path) like '%.go' and size(embedding) = 64")
    best = search.top_k_each(v, _asked(spark, d), 25).select("query_id", "chunk_id", "similarity")
    return best.join(live(load(spark, d, "code_chunks")), F.col("chunk_id") == F.col("id")).select("query_id", "chunk_id", "file_path", "entity_name", F.round("similarity", 5).alias("similarity"))


@register("vec_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 3)) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x))), 6) AS total FROM embeddings")
def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = normalized(F.transform(doubles(F.col("embedding")), lambda x: x * 3))
    return load(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("vec_truncate_renorm", "SELECT vec_id, round(list_sum(embedding[1:16]::DOUBLE[]) / sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))), 6) AS total, 16 AS dims FROM embeddings")
def vec_truncate_renorm(spark: SparkSession, d: str) -> DataFrame:
    v = truncated(F.col("embedding"), 16)
    return load(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size(v).alias("dims"))


@register("vec_dim_policy", "SELECT CASE WHEN len(embedding) = 64 THEN 'pass' WHEN len(embedding) > 64 THEN 'truncate' ELSE 'error' END AS policy, count(*) AS n FROM embeddings_partitioned WHERE embedding IS NOT NULL GROUP BY 1")
def vec_dim_policy(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings_partitioned").filter("embedding is not null")
    return e.groupBy(dimension_policy(F.col("embedding"), 64).alias("policy")).agg(F.count(F.lit(1)).alias("n"))


# text queries


def _text_query(query: str, where: str) -> None:
    name = {"plain": "text_substring", "re": "text_regex", "and": "text_and", "or": "text_or", "not": "text_not", "lang": "text_lang", "file": "text_file"}[where.split("|")[0]]

    def run(spark: SparkSession, d: str) -> DataFrame:
        x = load(spark, d, "documents")
        return x.filter(search.compile_query(query, F.col("text"), F.col("file_path"), F.col("repository_id"), F.col("lang"))).select("doc_id")

    register(name, f"SELECT doc_id FROM documents WHERE {where.split('|')[1]}")(run)


_text_query("Compiler", "plain|contains(lower(text), 'compiler')")
_text_query(r"re:version \d+", r"re|regexp_matches(text, 'version \d+')")
_text_query("release AND spectrum", "and|contains(lower(text), 'release') AND contains(lower(text), 'spectrum')")
_text_query("oboe OR marathon", "or|contains(lower(text), 'oboe') OR contains(lower(text), 'marathon')")
_text_query("NOT nobody", "not|NOT contains(lower(text), 'nobody')")
_text_query("lang:DE", "lang|lower(lang) = 'de'")
_text_query("file:*.md", r"file|regexp_matches(file_path, '.*\.md')")

# fusion

_LIST = "SELECT chunk_id, any_value(repository_id) AS repository, max(similarity) AS s FROM search_results WHERE query_id = 1 AND lower(source_engine) = '{}' AND similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY chunk_id"


@register(
    "hybrid_rrf",
    f"""WITH a AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM ({_LIST.format("embedding")})),
    b AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM ({_LIST.format("zoekt")})),
    f AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score,
          CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN 'both' WHEN a.r IS NOT NULL THEN 'embedding' ELSE 'text' END AS source
          FROM a FULL JOIN b ON a.chunk_id = b.chunk_id)
    SELECT chunk_id, round(score, 9) AS score, source FROM f""",
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "search_results").filter((F.col("query_id") == 1) & F.col("similarity").isNotNull() & ~F.isnan("similarity"))

    def ranked(engine: str) -> DataFrame:
        best = s.filter(F.lower("source_engine") == engine).groupBy("chunk_id").agg(F.max("similarity").alias("s"), F.min("repository_id").alias("repository"))
        w = Window.orderBy(F.col("s").desc(), "chunk_id")  # one query's answers
        nothing = {c: F.lit(None).cast(t) for c, t in (("file_path", "string"), ("start_line", "int"), ("end_line", "int"), ("content", "string"))}
        return best.withColumn("rank", F.row_number().over(w)).withColumns(nothing).drop("s")

    return search.fuse(ranked("embedding"), ranked("zoekt")).select("chunk_id", F.round("score", 9).alias("score"), "source")


@register(
    "hybrid_rrf_all",
    """WITH l AS (SELECT query_id, chunk_id, lower(source_engine) AS e, max(similarity) AS s FROM search_results
          WHERE lower(source_engine) IN ('embedding', 'zoekt') AND similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY s DESC, chunk_id) AS r FROM l)
    SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, CASE WHEN count(*) = 2 THEN 'both' WHEN min(e) = 'embedding' THEN 'embedding' ELSE 'text' END AS source
    FROM r GROUP BY 1, 2""",
)
def hybrid_rrf_all(spark: SparkSession, d: str) -> DataFrame:
    """hybrid_rrf of every query of the table."""
    s = load(spark, d, "search_results").filter(F.col("similarity").isNotNull() & ~F.isnan("similarity"))

    def ranked(engine: str) -> DataFrame:
        best = s.filter(F.lower("source_engine") == engine).groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("s"), F.min("repository_id").alias("repository"))
        w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "chunk_id")
        nothing = {c: F.lit(None).cast(t) for c, t in (("file_path", "string"), ("start_line", "int"), ("end_line", "int"), ("content", "string"))}
        return best.withColumn("rank", F.row_number().over(w)).withColumns(nothing).drop("s")

    return search.fuse(ranked("embedding"), ranked("zoekt"), ["query_id"]).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "source")


# line ranges: every third line range of a chunk asks for the best chunk of its file

_HITS = "SELECT id AS hit_id, repository_id, file_path, end_line AS hit_start, start_line + 2 AS hit_end FROM code_chunks WHERE deleted_at IS NULL"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).select(F.col("id").alias("hit_id"), "repository_id", "file_path", F.col("end_line").alias("hit_start"), (F.col("start_line") + 2).alias("hit_end"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).select("id", "repository_id", "file_path", "start_line", "end_line")


_OVERLAP = f"""WITH h AS ({_HITS}), c AS (SELECT * FROM code_chunks WHERE deleted_at IS NULL), j AS (
    SELECT h.hit_id, c.id, c.start_line, c.end_line, least(greatest(h.hit_start, h.hit_end), c.end_line) - greatest(least(h.hit_start, h.hit_end), c.start_line) + 1 AS overlap
    FROM h JOIN c USING (repository_id, file_path) WHERE least(h.hit_start, h.hit_end) <= c.end_line AND greatest(h.hit_start, h.hit_end) >= c.start_line)"""


@register("interval_overlaps", f"{_OVERLAP} SELECT hit_id, id, overlap FROM j")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlaps(_hits(spark, d), _ranges(spark, d), ["repository_id", "file_path"]).select("hit_id", "id", F.col("overlap").cast("long").alias("overlap"))


@register("interval_best", f"{_OVERLAP} SELECT hit_id, id FROM j QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY overlap DESC, end_line - start_line, start_line, id) = 1")
def interval_best(spark: SparkSession, d: str) -> DataFrame:
    return intervals.best_overlap(_hits(spark, d), _ranges(spark, d), ["repository_id", "file_path"]).select("hit_id", "id")


@register(
    "rank_dedup_overlap",
    f"""WITH h AS ({_HITS}), s AS (SELECT * FROM code_chunks WHERE deleted_at IS NULL AND chunk_type = 'class')
    SELECT hit_id FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repository_id = h.repository_id AND s.file_path = h.file_path
      AND least(h.hit_start, h.hit_end) <= s.end_line AND greatest(h.hit_start, h.hit_end) >= s.start_line)""",
)
def rank_dedup_overlap(spark: SparkSession, d: str) -> DataFrame:
    classes = live(load(spark, d, "code_chunks")).filter("chunk_type = 'class'").select("repository_id", "file_path", "start_line", "end_line")
    return intervals.unless_overlapping(_hits(spark, d), classes, ["repository_id", "file_path"]).select("hit_id")


@register(
    "path_only_best",
    """WITH c AS (SELECT * FROM code_chunks WHERE deleted_at IS NULL),
    h AS (SELECT DISTINCT repository_id, file_path, repository_id || '|' || file_path AS hit_id, split_part(split_part(file_path, '/', -1), '_', 1) AS term FROM c),
    j AS (SELECT h.hit_id, c.id, c.start_line, greatest(c.end_line - c.start_line + 1, 1) AS span,
      CASE WHEN lower(c.entity_name) = lower(term) THEN 5 WHEN contains(lower(c.entity_name), lower(term)) THEN 4 WHEN contains(lower(c.qualified_name), lower(term)) THEN 3
           WHEN contains(lower(c.signature), lower(term)) THEN 2 WHEN contains(lower(c.content), lower(term)) THEN 1 ELSE 0 END AS score
      FROM h JOIN c USING (repository_id, file_path))
    SELECT hit_id, id, score FROM j QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY score DESC, span, start_line, id) = 1""",
)
def path_only_best(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks"))
    term = F.substring_index(F.substring_index("file_path", "/", -1), "_", 1)
    hits = c.select("repository_id", "file_path", F.concat("repository_id", F.lit("|"), "file_path").alias("hit_id"), term.alias("term")).distinct()
    return intervals.best_by_name(hits, c.drop("metadata"), ["repository_id", "file_path"]).select("hit_id", "id", "score")


# catalogue listing


@register("catalog_filter_sort_page", "SELECT id, name, status FROM repositories WHERE deleted_at IS NULL AND status = 'completed' AND lower(name) LIKE '%a%' ORDER BY created_at DESC, id LIMIT 10 OFFSET 2")
def catalog_filter_sort_page(spark: SparkSession, d: str) -> DataFrame:
    r = catalog.matching(live(load(spark, d, "repositories")), equal={"status": "completed"}, like={"name": "a"})
    return search.page(r, catalog.order(catalog.REPOSITORY_ORDER, "created_at:desc"), 10, 2).select("id", "name", "status")


@register("catalog_count_page", "SELECT count(*) AS total FROM repositories WHERE deleted_at IS NULL AND lower(url) LIKE '%hub%'")
def catalog_count_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.matching(live(load(spark, d, "repositories")), like={"url": "hub"}).agg(F.count(F.lit(1)).alias("total"))


@register("in_list", "SELECT p_brand, count(*) AS n FROM part WHERE p_size IN (1, 5, 9) GROUP BY 1")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").filter(search.in_list(F.col("p_size"), [1, 5, 9]))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@register("like_suffix", "SELECT id FROM code_chunks WHERE deleted_at IS NULL AND (file_path LIKE '%.go' OR file_path LIKE '%.ts')")
def like_suffix(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).filter(search.has_extension(F.col("file_path"), ["go", " ", ".ts"])).select("id")


@register("ci_contains", "SELECT id FROM code_chunks WHERE deleted_at IS NULL AND contains(lower(entity_name), 'worker')")
def ci_contains(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).filter(F.contains(F.lower("entity_name"), F.lit("worker"))).select("id")


@register("ci_member", "SELECT visibility, count(*) AS n FROM code_chunks WHERE deleted_at IS NULL AND lower(visibility) IN ('public', 'private') GROUP BY 1")
def ci_member(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).filter(F.lower("visibility").isin("public", "private")).groupBy("visibility").agg(F.count(F.lit(1)).alias("n"))


@register("point_lookup", "SELECT r.id, r.name FROM repositories r WHERE r.deleted_at IS NULL AND r.normalized_url = (SELECT min(normalized_url) FROM repositories WHERE deleted_at IS NULL)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = live(load(spark, d, "repositories"))
    least = r.agg(F.min("normalized_url").alias("u"))
    return r.join(F.broadcast(least), F.col("normalized_url") == F.col("u"), "left_semi").select("id", "name")


@register(
    "chunk_repository_join",
    "SELECT c.id, coalesce(r.name, '') AS repository, coalesce(c.entity_name, '') AS entity_name, c.file_path, c.start_line FROM code_chunks c JOIN repositories r ON r.id = c.repository_id WHERE c.deleted_at IS NULL AND r.deleted_at IS NULL",
)
def chunk_repository_join(spark: SparkSession, d: str) -> DataFrame:
    r = live(load(spark, d, "repositories")).select(F.col("id").alias("rid"), "name")
    c = live(load(spark, d, "code_chunks"))
    return c.join(r, c.repository_id == r.rid).select("id", F.coalesce("name", F.lit("")).alias("repository"), F.coalesce("entity_name", F.lit("")).alias("entity_name"), "file_path", "start_line")


@register("name_resolution", "SELECT q.v AS asked, arg_max(r.id, (r.created_at, r.id)) AS id FROM (VALUES ('hq'), ('lab'), ('team')) q(v) JOIN repositories r ON r.deleted_at IS NULL AND lower(r.name) LIKE '%' || q.v || '%' GROUP BY 1")
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("hq",), ("lab",), ("team",)], "asked string")
    return catalog.resolve_names(asked, live(load(spark, d, "repositories"))).select("asked", "id")


# semi and anti joins, set operations


@register("semi_existing", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_existing(spark: SparkSession, d: str) -> DataFrame:
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@register("anti_missing", "SELECT id FROM code_chunks c WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM embeddings_partitioned e WHERE e.chunk_id = c.id AND e.deleted_at IS NULL)")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    c, e = live(load(spark, d, "code_chunks")), live(load(spark, d, "embeddings_partitioned")).select("chunk_id")
    return c.join(e, c.id == e.chunk_id, "left_anti").select("id")


@register(
    "orphan_cleanup",
    """SELECT id, count(*) AS n FROM embeddings_partitioned e WHERE NOT EXISTS (SELECT 1 FROM code_chunks c WHERE c.id = e.chunk_id AND c.deleted_at IS NULL)
    OR NOT EXISTS (SELECT 1 FROM repositories r WHERE r.id = e.repository_id AND r.deleted_at IS NULL) GROUP BY 1""",
)
def orphan_cleanup(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings_partitioned").select("id", "chunk_id", "repository_id")
    o = upserts.orphans(e, [(live(load(spark, d, "code_chunks")), "chunk_id", "id"), (live(load(spark, d, "repositories")), "repository_id", "id")])
    return o.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("left_null_count", "SELECT count(*) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
def left_null_count(spark: SparkSession, d: str) -> DataFrame:
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").agg(F.count(F.lit(1)).alias("n"))


@register("union_all_ids", "SELECT s_nationkey AS k, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY 1")
def union_all_ids(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(load(spark, d, "customer").select(F.col("c_nationkey").alias("k")))
    return u.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, d, "supplier").select("s_nationkey"))


@register("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    used = load(spark, d, "lineitem").filter("l_quantity > 30").select("l_partkey")
    return load(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(used)


# changes to stored tables: chunks of the older half are stored, the newer half arrives

_SPLIT = "2024-04-01"
_OLD = f"(SELECT repository_id, file_path, content_hash, min(id) AS id, arg_min(start_line, id) AS start_line, arg_min(coalesce(token_count, -1), id) AS token_count FROM code_chunks WHERE created_at < TIMESTAMP '{_SPLIT}' GROUP BY 1, 2, 3)"
_NEW = _OLD.replace("created_at <", "created_at >=")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, d, "code_chunks").select("repository_id", "file_path", "content_hash", "id", "start_line", "token_count", "created_at")
    first = [upserts.first_by(c.filter(cond), upserts.CHUNK_KEY, ["id"]).drop("created_at") for cond in (f"created_at < timestamp_ntz'{_SPLIT}'", f"created_at >= timestamp_ntz'{_SPLIT}'")]
    return first[0], first[1]


@register(
    "upsert_chunk",
    f"""SELECT coalesce(o.id, n.id) AS id, coalesce(n.start_line, o.start_line) AS start_line, coalesce(nullif(n.token_count, -1), nullif(o.token_count, -1)) AS token_count
    FROM {_OLD} o FULL JOIN {_NEW} n ON o.repository_id = n.repository_id AND o.file_path = n.file_path AND o.content_hash = n.content_hash""",
)
def upsert_chunk(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upserts.upsert(old, new, upserts.CHUNK_KEY, ["start_line"], ["token_count"], ["id"]).select("id", "start_line", "token_count")


@register(
    "conflict_counts",
    f"SELECT CASE WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END AS outcome, count(*) AS n FROM {_NEW} n LEFT JOIN {_OLD} o ON o.repository_id = n.repository_id AND o.file_path = n.file_path AND o.content_hash = n.content_hash GROUP BY 1",
)
def conflict_counts(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upserts.conflict_outcomes(old, new, upserts.CHUNK_KEY, "update")


@register("upsert_embed", "SELECT chunk_id, model_version, repository_id, max(created_at) AS created_at FROM embeddings_partitioned WHERE deleted_at IS NULL GROUP BY 1, 2, 3")
def upsert_embed(spark: SparkSession, d: str) -> DataFrame:
    e = live(load(spark, d, "embeddings_partitioned")).select("chunk_id", "model_version", "repository_id", "created_at", "id")
    return upserts.first_by(e, ["chunk_id", "model_version", "repository_id"], [F.col("created_at").desc(), "id"]).drop("id")


@register("soft_delete", "SELECT chunk_type, count(*) AS n FROM code_chunks WHERE deleted_at IS NULL AND (language IS NULL OR language <> 'Unknown') GROUP BY 1")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    c = upserts.soft_delete(load(spark, d, "code_chunks"), F.col("language") == "Unknown", F.lit("2024-07-01").cast("timestamp_ntz"))
    return live(c).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "backfill",
    "SELECT e.id, e.created_at, coalesce(e.language, c.language) AS language, coalesce(e.file_path, c.file_path) AS file_path FROM embeddings_partitioned e LEFT JOIN (SELECT * FROM code_chunks WHERE deleted_at IS NULL) c ON c.id = e.chunk_id",
)
def backfill(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings_partitioned").select("id", "created_at", "chunk_id", "language", "file_path")
    c = live(load(spark, d, "code_chunks")).select(F.col("id").alias("chunk_id"), "language", "file_path")
    return upserts.backfill(e, c, ["chunk_id"], ["language", "file_path"]).drop("chunk_id")


@register("dedup_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY 2")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return upserts.first_by(x, ["h"], ["doc_id"])


@register("reconcile", "SELECT n.n_nationkey AS k, CASE WHEN s.k IS NULL THEN 'create' WHEN s.m <> n.n_regionkey THEN 'update' ELSE 'keep' END AS action FROM nation n LEFT JOIN (SELECT c_nationkey AS k, min(c_custkey) % 5 AS m FROM customer GROUP BY 1) s ON s.k = n.n_nationkey")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    stored = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.min("c_custkey") % 5).cast("int").alias("m"))
    declared = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("int").alias("m"))
    return upserts.reconcile(stored, declared, "k", ["m"])


# functions on texts, paths and URLs


@register("url_norm_sql", r"SELECT id, regexp_replace(regexp_replace(lower(url), '\.git/?$', ''), '/+$', '') AS u FROM repositories")
def url_norm_sql(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "repositories").select("id", strings.stored_url(F.col("url")).alias("u"))


@register("url_norm_full", r"SELECT id, 'https://git.invalid' || replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://[^/]+(.*)$', 1)), '/+$', ''), '\.git$', ''), '/-', '-') AS u FROM repositories")
def url_norm_full(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "repositories").select("id", strings.normal_url(F.col("url"), ["git.invalid"]).alias("u"))


@register("hash_content", "SELECT id, sha256(content) = lower(content_hash) AS same, substring(sha256(content), 1, 8) AS short FROM code_chunks WHERE deleted_at IS NULL")
def hash_content(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("content", 256)
    return live(load(spark, d, "code_chunks")).select("id", (h == F.lower("content_hash")).alias("same"), F.substring(h, 1, 8).alias("short"))


_SIGNS = " + ".join(f"contains(lower(text), '{s}')::INT" for s in strings.CODE_SIGNS)
_CODE_LIKE = rf"(({_SIGNS}) >= 2 OR (length(text) > 50 AND length(regexp_replace(text, '[\p{{L}}\p{{Nd}}\s]', '', 'g')) > 0.15 * length(text)))"


@register("code_like", f"SELECT doc_id, {_CODE_LIKE} AS code FROM documents WHERE text IS NOT NULL")
def code_like(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", strings.is_code_like(F.col("text")).alias("code"))


@register(
    "token_estimate",
    rf"""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS w, CASE WHEN {_CODE_LIKE} THEN 16 ELSE 13 END AS m FROM documents)
    SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR w = 0 THEN 0 ELSE greatest(greatest(1, w // 2), least((w * m) // 10, w * 3)) END AS tokens FROM t""",
)
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", strings.token_estimate(F.col("text")).alias("tokens"))


_TEST_NAME = " OR ".join(f"contains(lower(split_part(file_path, '/', -1)), '{p}')" for p in strings.TEST_NAME_PARTS)


@register("test_files", f"SELECT DISTINCT file_path FROM code_chunks WHERE {_TEST_NAME} OR lower(split_part(file_path, '/', -2)) IN ('test', 'tests', 'spec', 'specs', '__tests__')")
def test_files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_chunks").filter(strings.is_test_file(F.col("file_path"))).select("file_path").distinct()


_FOLDERS = ", ".join(f"'{x}'" for x in strings.SKIPPED_FOLDERS)


@register("skip_dirs", f"SELECT DISTINCT file_path FROM code_chunks WHERE NOT list_has_any(string_split(file_path, '/')[:-2], [{_FOLDERS}])")
def skip_dirs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_chunks").filter(~strings.in_skipped_folder(F.col("file_path"))).select("file_path").distinct()


_BY_EXT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in strings.EXTENSION_LANGUAGES.items())


@register("ext_language", rf"SELECT CASE lower(regexp_extract(file_path, '\.([^./]+)$', 1)) {_BY_EXT} END AS lang, count(*) AS n FROM code_chunks GROUP BY 1")
def ext_language(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_chunks").groupBy(strings.extension_language(F.col("file_path")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "visibility_rules",
    """SELECT id, CASE WHEN CASE WHEN lower(language) = 'go' THEN NOT regexp_matches(entity_name, '^[A-Z]') WHEN lower(language) = 'python' THEN entity_name LIKE '\\_%' ESCAPE '\\'
       ELSE substring(entity_name, 1, 1) IN ('#', '_') END THEN 'private' ELSE 'public' END AS v FROM code_chunks WHERE entity_name IS NOT NULL AND language IS NOT NULL""",
)
def visibility_rules(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "code_chunks").filter("entity_name is not null and language is not null")
    return c.select("id", strings.visibility(F.col("entity_name"), F.col("language"), F.lit("function")).alias("v"))


@register("unicode_norm", "SELECT doc_id, length(replace(text, chr(160), ' ')) AS n FROM documents WHERE text IS NOT NULL")
def unicode_norm(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", F.length(strings.plain_unicode(F.col("text"))).alias("n"))


@register("injection_flags")
def injection_flags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(strings.risk_level(F.col("text")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


_IGNORE = ["*.min.js", "vendor/", "!vendor/keep.go", "/lib/**/*.py", "# comment"]


@register(
    "gitignore",
    r"SELECT DISTINCT file_path FROM code_chunks WHERE regexp_matches(file_path, '(^|/)[^/]*\.min\.js(/.*)?$') OR regexp_matches(file_path, '(^|/)vendor/.*$') OR regexp_matches(file_path, '^lib/(.*/)?[^/]*\.py(/.*)?$')",
)
def gitignore(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_chunks").filter(strings.is_ignored(F.col("file_path"), _IGNORE)).select("file_path").distinct()


@register(
    "failure_kinds",
    """SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'SYSTEM_ERROR' WHEN regexp_matches(lower(text), 'connection|dial tcp|network') THEN 'NETWORK_ERROR'
    WHEN regexp_matches(lower(text), 'timeout|deadline exceeded|timed out') THEN 'TIMEOUT_ERROR' WHEN regexp_matches(lower(text), 'invalid|required field') THEN 'VALIDATION_ERROR'
    WHEN regexp_matches(lower(text), 'permission denied|access denied') THEN 'PERMISSION_DENIED' WHEN regexp_matches(lower(text), 'repository not found|404 not found') THEN 'REPOSITORY_NOT_FOUND'
    WHEN regexp_matches(lower(text), 'out of memory|disk full') THEN 'RESOURCE_EXHAUSTED' ELSE 'SYSTEM_ERROR' END AS kind FROM documents""",
)
def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", strings.failure_kind(F.col("text")).alias("kind"))


@register("json_decode", "SELECT event_id, json_extract_string(props, '$.page') AS page, length(props) AS n FROM events")
def json_decode(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").alias("n"))


# aggregates


@register("length_cv", "WITH m AS (SELECT (sum(strlen(text)) // count(text))::BIGINT AS m FROM documents) SELECT m AS mean_length, round(sqrt(avg((strlen(text) - m) * (strlen(text) - m))) / m, 6) AS variation FROM documents, m WHERE text IS NOT NULL GROUP BY m")
def length_cv(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_variation(load(spark, d, "documents"), "text").select("mean_length", F.round("variation", 6).alias("variation"))


@register("token_total", "SELECT lang, sum(greatest(1, strlen(text) // 4))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1")
def token_total(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").groupBy("lang").agg(stats.token_total(F.col("text")).cast("long").alias("tokens"))


@register("avg_div", "SELECT chunk_type, (sum(strlen(content)) // count(*))::BIGINT AS size, count(*) AS n FROM code_chunks WHERE deleted_at IS NULL GROUP BY 1")
def avg_div(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).groupBy("chunk_type").agg(stats.whole_average(F.octet_length("content")).alias("size"), F.count(F.lit(1)).alias("n"))


@register("batch_numbers", "SELECT id, (row_number() OVER (PARTITION BY repository_id ORDER BY file_path, start_line, id) - 1) // 50 + 1 AS batch_number FROM code_chunks WHERE deleted_at IS NULL")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    return stats.batch_numbers(live(load(spark, d, "code_chunks")), ["repository_id"], ["file_path", "start_line", "id"], 50).select("id", "batch_number")


@register("resume_point", "SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 0) AS last_done FROM orders GROUP BY 1")
def resume_point(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey").agg(stats.resume_point(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("last_done"))


@register("load_level", "SELECT CASE WHEN u < 0.3 THEN 'low' WHEN u < 0.7 THEN 'medium' WHEN u < 0.9 THEN 'high' ELSE 'critical' END AS level, count(*) AS n FROM (SELECT l_quantity / 50.0 AS u FROM lineitem) GROUP BY 1")
def load_level(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(stats.load_level(F.col("l_quantity") / 50.0).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@register("backoff_schedule", "SELECT a::BIGINT AS attempt, least(0.5 * pow(2, a - 1), 30.0) AS delay FROM range(1, 11) t(a)")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 11).select(F.col("id").alias("attempt"), stats.backoff(F.col("id"), 0.5, 2, 30).alias("delay"))


@register("priority_sort_topk", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100")
def priority_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.page(load(spark, d, "orders"), [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 100).select("o_orderkey", "o_orderpriority")


@register("storage_stats", "SELECT repository_id, count(*) AS n_rows, count(*) FILTER (deleted_at IS NULL) AS n_live, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings_partitioned GROUP BY 1")
def storage_stats(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings_partitioned")
    return e.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("deleted_at").isNull(), 1)).alias("n_live"), F.sum(F.when(F.col("embedding").isNotNull(), F.size("embedding") * 4)).cast("long").alias("bytes"))


# chunks and their context


@register("line_chunks")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(load(spark, d, "documents"), "doc_id", "text", 400)


@register("function_groups")
def function_groups(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks"))
    at = F.sum(F.octet_length("content") + 2).over(Window.partitionBy("repository_id", "file_path").orderBy("start_line", "id"))
    p = c.withColumn("end_byte", at.cast("int")).withColumn("start_byte", (F.col("end_byte") - F.octet_length("content") - 2).cast("int"))
    p = p.select("repository_id", "file_path", F.col("chunk_type").alias("kind"), F.coalesce("entity_name", "id").alias("name"), "start_byte", "end_byte", F.coalesce(F.lower("language"), F.lit("")).alias("language"))
    return chunking.grouped(p, ["repository_id", "file_path"])


@register(
    "neighbour_context",
    """SELECT id, right(lag(content) OVER w, 200) AS before, left(lead(content) OVER w, 200) AS after, row_number() OVER w - 1 AS ordinal
    FROM code_chunks WHERE deleted_at IS NULL WINDOW w AS (PARTITION BY repository_id, file_path ORDER BY start_line, id)""",
)
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    return chunking.neighbours(live(load(spark, d, "code_chunks")), ["repository_id", "file_path"], ["start_line", "id"]).select("id", "before", "after", "ordinal")


@register(
    "gap_groups",
    "WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS new FROM events)"
    " SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM g",
)
def gap_groups(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return chunking.gap_groups(e, ["user_id"], "t", 3_600_000_000).select("event_id", F.col("group_no").cast("long").alias("group_no"))


@register(
    "gap_share",
    """WITH g AS (SELECT repository_id, file_path, start_line - lag(end_line) OVER (PARTITION BY repository_id, file_path ORDER BY start_line, end_line) AS g FROM code_chunks WHERE deleted_at IS NULL)
    SELECT repository_id, file_path, round(coalesce(avg(CASE WHEN g IS NULL THEN NULL WHEN g >= 0 AND g < 100 THEN 1.0 ELSE 0.0 END) * 0.7, 1.0), 6) AS cohesion FROM g GROUP BY 1, 2""",
)
def gap_share(spark: SparkSession, d: str) -> DataFrame:
    return chunking.gap_share(live(load(spark, d, "code_chunks")), ["repository_id", "file_path"], "start_line", "end_line").withColumn("cohesion", F.round("cohesion", 6))


@register(
    "optimal_size",
    "SELECT id, least(greatest(trunc(strlen(content) * CASE lower(language) WHEN 'go' THEN 0.30::DOUBLE WHEN 'python' THEN 0.35::DOUBLE WHEN 'javascript' THEN 0.25::DOUBLE WHEN 'typescript' THEN 0.25::DOUBLE ELSE 0.40::DOUBLE END)::INT, 100), 2000) AS size FROM code_chunks WHERE deleted_at IS NULL",
)
def optimal_size(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).select("id", chunking.chunk_size(F.octet_length("content"), F.col("language"), 100, 2000).alias("size"))


@register("constructs")
def constructs(spark: SparkSession, d: str) -> DataFrame:
    return extract.constructs(live(load(spark, d, "code_chunks")))


# error events

_CODES = "SELECT event_type AS code, ts, event_id, CASE WHEN value > 90 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR' WHEN value > 50 THEN 'WARNING' ELSE 'INFO' END AS severity FROM events"
_WINDOWS = f"""WITH e AS ({_CODES}), r AS (SELECT *, list_position(['CRITICAL', 'ERROR', 'WARNING', 'INFO'], severity) AS r FROM e),
w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, code, count(*) AS n, ['CRITICAL', 'ERROR', 'WARNING', 'INFO'][min(r)] AS severity, min(ts) AS first_at, max(ts) AS last_at, count(*) / 300.0 AS rate FROM r GROUP BY 1, 2)"""


def _coded(spark: SparkSession, d: str) -> DataFrame:
    sev = F.when(F.col("value") > 90, "CRITICAL").when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 50, "WARNING").otherwise("INFO")
    return load(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("code"), sev.alias("severity"))


@register("err_window", f"{_WINDOWS} SELECT epoch_us(window_start) AS at, code, n, severity FROM w")
def err_window(spark: SparkSession, d: str) -> DataFrame:
    return errors.windows(_coded(spark, d)).select(F.unix_micros("window_start").alias("at"), "code", "n", "severity")


@register(
    "err_alerts",
    f"{_WINDOWS} SELECT epoch_us(window_start) AS at, code, CASE WHEN severity = 'CRITICAL' OR n >= 10 OR rate > 1 THEN 'REAL_TIME' ELSE 'BATCH' END AS alert_type FROM w WHERE CASE severity WHEN 'CRITICAL' THEN n >= 1 WHEN 'ERROR' THEN n >= 3 ELSE n >= 10 OR rate > 1 END",
)
def err_alerts(spark: SparkSession, d: str) -> DataFrame:
    return errors.alerts(errors.windows(_coded(spark, d))).select(F.unix_micros("window_start").alias("at"), "code", "alert_type")


@register("err_cascade", f"{_WINDOWS} SELECT epoch_us(window_start) AS at, count(*) AS codes, string_agg(code, ',' ORDER BY code) AS key FROM w GROUP BY window_start HAVING count(*) >= 2 AND epoch_us(max(last_at)) - epoch_us(min(first_at)) <= 60000000")
def err_cascade(spark: SparkSession, d: str) -> DataFrame:
    return errors.cascades(errors.windows(_coded(spark, d)), 60).select(F.unix_micros("window_start").alias("at"), "codes", "key")


@register("err_rate", f"{_WINDOWS} SELECT code, count(*) AS windows, round(max(rate), 6) AS most FROM w GROUP BY 1")
def err_rate(spark: SparkSession, d: str) -> DataFrame:
    return errors.windows(_coded(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("windows"), F.round(F.max("rate"), 6).alias("most"))


@register(
    "err_similar",
    """WITH c AS (SELECT DISTINCT lower(split_part(file_path, '/', 1)) || '_' || chunk_type AS c FROM code_chunks),
    w AS (SELECT c, string_split(c, '_') AS w FROM c), p AS (SELECT x.c AS a, y.c AS b, len(list_filter(x.w, lambda v: list_contains(y.w, v))) AS k, len(x.w) AS n, len(y.w) AS m FROM w x JOIN w y ON x.c < y.c)
    SELECT a, b, round(k * 1.0 / (n + m - k), 6) AS similarity FROM p WHERE k * 1.0 / (n + m - k) >= 0.3""",
)
def err_similar(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "code_chunks").select(F.concat(F.lower(F.substring_index("file_path", "/", 1)), F.lit("_"), "chunk_type").alias("code"))
    return errors.similar_pairs(c, 0.3).withColumn("similarity", F.round("similarity", 6))


@register("correlation_groups", "SELECT correlation_id, count(*) AS n, min(received_at) AS first_at FROM embedding_requests WHERE coalesce(trim(correlation_id), '') <> '' GROUP BY 1")
def correlation_groups(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "embedding_requests").filter("coalesce(trim(correlation_id), '') <> ''")
    return r.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first_at"))


@register("stream_window", f"{_WINDOWS} SELECT epoch_us(window_start) AS at, code, n, severity FROM w")
def stream_window(spark: SparkSession, d: str) -> DataFrame:
    """err_window as a stream over the table's files, every window complete when the stream ends."""
    table = load(spark, d, "events")
    out = scratch_path(spark, "windows")
    src = spark.readStream.schema(table.schema).parquet(f"{d.rstrip('/')}/events*.parquet")
    sev = F.when(F.col("value") > 90, "CRITICAL").when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 50, "WARNING").otherwise("INFO")
    agg = stream_events.error_windows(src.select("ts", F.col("event_type").alias("code"), sev.alias("severity")))
    q = agg.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.unix_micros("window_start").alias("at"), "code", "n", "severity")


# further functions on code


_BY_EXT_CASE = rf"CASE lower(regexp_extract(file_path, '\.([^./]+)$', 1)) {_BY_EXT} END"
_BY_HEAD = "CASE " + " ".join(f"WHEN regexp_matches(split_part(content, chr(10), 1), '{rx}') THEN '{lang}'" for lang, rx in code.SHEBANGS) + " END"
_BY_CONTENT = "CASE " + " ".join("WHEN regexp_matches(content, '{}') THEN '{}'".format(rx.replace("'", "''"), lang) for lang, rx in code.CONTENTS) + " END"


@register("language_detection", f"SELECT id, coalesce({_BY_EXT_CASE}, {_BY_HEAD}, {_BY_CONTENT}) AS lang FROM code_chunks WHERE deleted_at IS NULL AND chunk_type IN ('config', 'query', 'function')")
def language_detection(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks")).filter("chunk_type in ('config', 'query', 'function')")
    lang, _ = code.detected_language(F.col("file_path"), F.col("content"), strings.extension_language(F.col("file_path")))
    return c.select("id", lang.alias("lang"))


@register("language_detection_all", f"SELECT id, coalesce({_BY_EXT_CASE}, {_BY_HEAD}, {_BY_CONTENT}) AS lang FROM code_chunks WHERE deleted_at IS NULL")
def language_detection_all(spark: SparkSession, d: str) -> DataFrame:
    """language_detection over chunks of every type."""
    c = live(load(spark, d, "code_chunks"))
    lang, _ = code.detected_language(F.col("file_path"), F.col("content"), strings.extension_language(F.col("file_path")))
    return c.select("id", lang.alias("lang"))


@register("binary_extension", "SELECT DISTINCT file_path FROM code_chunks WHERE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) IN (" + ", ".join(f"'{x}'" for x in code.BINARY_EXTENSIONS) + ")")
def binary_extension(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_chunks").filter(code.has_binary_extension(F.col("file_path"))).select("file_path").distinct()


@register("doc_summary", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '@'))[1], '') AS summary FROM documents WHERE kind = 'docstring' AND text IS NOT NULL")
def doc_summary(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("kind = 'docstring' and text is not null").select("doc_id", code.doc_summary(F.col("text")).alias("summary"))


@register("struct_tags", r"""SELECT id, len(regexp_extract_all(content, '(\w+):"([^"]*)"')) AS n, regexp_extract_all(content, '(\w+):"([^"]*)"', 1)[1] AS first FROM code_chunks WHERE deleted_at IS NULL AND file_path LIKE '%.go'""")
def struct_tags(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks")).filter("file_path like '%.go'").withColumn("t", code.struct_tags(F.col("content")))
    return c.select("id", F.size("t").cast("long").alias("n"), F.try_element_at("t", F.lit(1))["name"].alias("first"))


_CALLED = ", ".join(f"'{x}'" for x in code.NOT_CALLED)
_NAMES = r"list_transform(list_filter(regexp_split_to_array(content, '\s+'), lambda w: contains(w, '(')), lambda w: CASE WHEN contains(split_part(w, '(', 1), '.') THEN split_part(split_part(w, '(', 1), '.', 2) ELSE split_part(w, '(', 1) END)"


@register(
    "called_names",
    f"SELECT id, len(list_filter({_NAMES}, lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') AND x NOT IN ({_CALLED}))) AS calls FROM code_chunks WHERE deleted_at IS NULL AND chunk_type = 'function'",
)
def called_names(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).filter("chunk_type = 'function'").select("id", F.size(code.called_names(F.col("content"))).cast("long").alias("calls"))


@register(
    "similar_names",
    """WITH c AS (SELECT DISTINCT repository_id, file_path, entity_name AS n FROM code_chunks WHERE deleted_at IS NULL AND entity_name IS NOT NULL),
    p AS (SELECT a.file_path, a.n AS a, b.n AS b, least(length(a.n), length(b.n)) AS m FROM c a JOIN c b ON a.repository_id = b.repository_id AND a.file_path = b.file_path AND a.n < b.n)
    SELECT file_path, a, b FROM p WHERE m >= 3 AND (left(lower(a), m // 2) = left(lower(b), m // 2) OR right(lower(a), m // 2) = right(lower(b), m // 2))""",
)
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks")).filter("entity_name is not null").select("repository_id", "file_path", F.col("entity_name").alias("n")).distinct()
    p = c.withColumnRenamed("n", "a").join(c.withColumnRenamed("n", "b"), ["repository_id", "file_path"]).filter("a < b")
    return p.filter(code.similar_names(F.col("a"), F.col("b"))).select("file_path", "a", "b")


@register("fnv_hash")
def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", code.fnv32a("text").alias("h"))


@register("request_keys", "SELECT id, 'chunk_' || replace(id, '-', '') AS key, id AS back FROM code_chunks")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "code_chunks").select("id", code.request_key(F.col("id")).alias("key"))
    return c.withColumn("back", code.chunk_of_key(F.col("key")))


@register("embeddings_page", "SELECT id, created_at FROM embeddings_partitioned WHERE deleted_at IS NULL AND model_version IN ('code-embed-1') AND repository_id = (SELECT min(repository_id) FROM embeddings_partitioned) ORDER BY created_at DESC, id LIMIT 100")
def embeddings_page(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings_partitioned")
    first = e.agg(F.min("repository_id").alias("r"))
    e = live(e).filter(search.in_list(F.col("model_version"), ["code-embed-1"])).join(F.broadcast(first), F.col("repository_id") == F.col("r"), "left_semi")
    return search.page(e, [F.col("created_at").desc(), F.col("id")], 100).select("id", "created_at")


@register("repository_regex", "SELECT id, name FROM repositories WHERE deleted_at IS NULL AND regexp_matches(name, '^[a-m].*-') ORDER BY name, id LIMIT 20")
def repository_regex(spark: SparkSession, d: str) -> DataFrame:
    return search.page(live(load(spark, d, "repositories")).filter(F.col("name").rlike("^[a-m].*-")), [F.col("name"), F.col("id")], 20).select("id", "name")


@register("queue_head", "SELECT delivery_id FROM embedding_requests WHERE deadline IS NULL OR deadline <= TIMESTAMP '2024-04-01' ORDER BY submitted_at, delivery_id LIMIT 1")
def queue_head(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "embedding_requests").filter("deadline is null or deadline <= timestamp_ntz'2024-04-01'")
    return search.page(r, [F.col("submitted_at"), F.col("delivery_id")], 1).select("delivery_id")


@register("duplicate_hours", "SELECT hour(received_at)::INT AS h, count(*) - count(DISTINCT correlation_id) AS repeats, count(*) AS n FROM embedding_requests WHERE correlation_id IS NOT NULL GROUP BY 1")
def duplicate_hours(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "embedding_requests").filter("correlation_id is not null")
    return r.groupBy(F.hour("received_at").alias("h")).agg((F.count(F.lit(1)) - F.countDistinct("correlation_id")).alias("repeats"), F.count(F.lit(1)).alias("n"))


@register("script_counts", r"SELECT doc_id, strlen(text) AS bytes, length(text) AS characters, length(text) - length(regexp_replace(text, '\p{Latin}', '', 'g')) AS latin FROM documents WHERE text IS NOT NULL")
def script_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", stats.script_counts(F.col("text")).alias("s")).select("doc_id", F.col("s.bytes").cast("long").alias("bytes"), F.col("s.characters").cast("long").alias("characters"), F.col("s.latin").cast("long").alias("latin"))


@register("nearest_class", """WITH c AS (SELECT * FROM code_chunks WHERE deleted_at IS NULL), m AS (SELECT id, repository_id, file_path, start_line, end_line FROM c WHERE chunk_type <> 'class'),
    o AS (SELECT id, repository_id, file_path, start_line - 50 AS s, end_line + 50 AS e FROM c WHERE chunk_type = 'class')
    SELECT m.id, arg_min(o.id, (o.e - o.s, o.id)) AS owner_id FROM m JOIN o ON m.repository_id = o.repository_id AND m.file_path = o.file_path AND m.start_line >= o.s AND m.end_line <= o.e GROUP BY 1""")
def nearest_class(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks"))
    m = c.filter("chunk_type <> 'class'").select("id", "repository_id", "file_path", "start_line", "end_line")
    o = c.filter("chunk_type = 'class'").select(F.col("id").alias("owner_id"), "repository_id", "file_path", (F.col("start_line") - 50).alias("owner_start"), (F.col("end_line") + 50).alias("owner_end"))
    return intervals.enclosing(m, o, ["repository_id", "file_path"]).select("id", "owner_id")
