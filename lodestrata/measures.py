"""Further core queries, on constructs, texts, statistics and search end to end, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import _CODES, _coded, _vector, register
from .functions import code, strings
from .functions.vectors import euclidean, from_text, to_text
from .operators import chunking, errors, extract, intervals, search, service, stats, upserts
from .session import scratch_path
from .sources.tables import live, load
from .streaming import events as stream_events

# statistics


@register(
    "strategy_choice",
    """WITH g AS (SELECT repository_id, file_path, count(*) FILTER (lower(chunk_type) IN ('function', 'method')) AS functions, count(*) FILTER (lower(chunk_type) IN ('class', 'struct')) AS classes,
      (sum(strlen(coalesce(content, ''))) // count(*))::BIGINT AS average FROM code_chunks WHERE deleted_at IS NULL GROUP BY 1, 2)
    SELECT *, CASE WHEN classes > functions THEN 'class' WHEN functions > 0 AND average < 1000 THEN 'function' WHEN average > 2000 THEN 'size' ELSE 'hybrid' END AS strategy FROM g""",
)
def strategy_choice(spark: SparkSession, d: str) -> DataFrame:
    return stats.strategy_choice(live(load(spark, d, "code_chunks")), ["repository_id", "file_path"])


@register(
    "unicode_stats",
    r"""SELECT doc_id, strlen(text) AS bytes, length(text) AS characters, len(regexp_extract_all(text, '\p{Latin}')) AS latin, len(regexp_extract_all(text, '\p{L}')) AS letter, len(regexp_extract_all(text, '\p{Nd}')) AS digit,
      len(regexp_extract_all(text, '\p{P}')) AS punctuation, len(regexp_extract_all(text, '[\t\n\x0B\f\r\x{85}\p{Z}]')) AS space, length(text) - len(regexp_extract_all(text, '[\p{L}\p{Nd}\p{P}\p{M}\p{Z}\p{Cc}]')) AS other
      FROM documents WHERE text IS NOT NULL""",
)
def unicode_stats(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "documents").filter("text is not null").select("doc_id", stats.unicode_stats(F.col("text")).alias("s"))
    return s.select("doc_id", "s.bytes", "s.characters", "s.latin", "s.letter", "s.digit", "s.punctuation", "s.space", F.col("s.other_category").alias("other"))


@register("token_sample", "WITH p AS (SELECT text FROM documents ORDER BY doc_id LIMIT (SELECT greatest(1, count(*) * 10 // 100) FROM documents)), t AS (SELECT greatest(1, strlen(text) // 4) AS t FROM p) SELECT count(*) AS texts, sum(t)::BIGINT AS tokens, round(avg(t), 6) AS average, count(*) FILTER (t > 300) AS oversized FROM t")
def token_sample(spark: SparkSession, d: str) -> DataFrame:
    t = stats.token_counts(load(spark, d, "documents").select("doc_id", "text"), ["doc_id"], 10, F.greatest(F.lit(1), F.floor(F.octet_length("text") / 4)), 300)
    return t.withColumn("average", F.round("average", 6))


@register("pending_count", "SELECT count(*) AS pending FROM embedding_requests WHERE batch_id IS NULL AND (deadline IS NULL OR deadline >= TIMESTAMP '2024-03-01')")
def pending_count(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "embedding_requests").filter("batch_id is null and (deadline is null or deadline >= timestamp_ntz'2024-03-01')")
    return r.agg(F.count(F.lit(1)).alias("pending"))


@register("failure_rates", "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS retryable, count(*) FILTER (event_type <> 'error') AS permanent, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS retryable_share FROM events")
def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    return stats.failure_rates(load(spark, d, "events"), F.col("event_type") == "error").withColumn("retryable_share", F.round("retryable_share", 9))


@register("delivery_delay", "SELECT delivery_id, round((epoch_us(received_at) - epoch_us(submitted_at)) / 1000000.0, 3) AS seconds FROM embedding_requests")
def delivery_delay(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embedding_requests").select("delivery_id", F.round(stats.seconds_between(F.col("submitted_at"), F.col("received_at")), 3).alias("seconds"))


@register(
    "priority_rank_topk",
    """WITH p AS (SELECT o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '2' THEN 'HIGH' WHEN '3' THEN 'normal' WHEN '5' THEN ' Low' ELSE o_orderpriority END AS p, o_orderdate FROM orders),
    r AS (SELECT o_orderkey, CASE upper(trim(p)) WHEN 'HIGH' THEN 0 WHEN 'NORMAL' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS priority, o_orderdate FROM p)
    SELECT o_orderkey, priority, row_number() OVER (ORDER BY priority, o_orderdate DESC, o_orderkey) AS position FROM r ORDER BY priority, o_orderdate DESC, o_orderkey LIMIT 200""",
)
def priority_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    o = load(spark, d, "orders").withColumn("p", F.when(first == "2", "HIGH").when(first == "3", "normal").when(first == "5", " Low").otherwise(F.col("o_orderpriority")))
    order = [F.col("priority"), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    top = search.page(o.withColumn("priority", stats.priority_rank(F.col("p"))), order, 200)
    return top.select("o_orderkey", "priority", F.row_number().over(Window.orderBy(*order)).alias("position"))  # 200 rows


@register("correlation_groups_all", "SELECT coalesce(trim(correlation_id), '') AS correlation_id, count(*) AS n, min(received_at) AS first_at FROM embedding_requests GROUP BY 1")
def correlation_groups_all(spark: SparkSession, d: str) -> DataFrame:
    """Messages by correlation id; those without one are a group of their own."""
    r = load(spark, d, "embedding_requests").withColumn("correlation_id", F.coalesce(F.trim("correlation_id"), F.lit("")))
    return r.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first_at"))


# texts and names


@register(
    "binary_stream",
    r"""WITH h AS (SELECT id, hex(encode(content))[1:2048] AS h, strlen(content) AS n FROM code_chunks WHERE content IS NOT NULL), p AS (SELECT id, h, n, regexp_extract_all(h, '..') AS p FROM h)
    SELECT id, list_contains(p[1:512], '00') OR (n >= 4 AND regexp_matches(h, '^(7F454C46|FFD8FF|89504E47|504B0304|25504446|52617221)')) OR len(list_filter(p, lambda x: x < '20' OR x > '7E')) > 0.3 * least(n, 1024) AS is_binary FROM p""",
)
def binary_stream(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_chunks").filter("content is not null").select("id", code.is_binary_stream(F.encode("content", "UTF-8")).alias("is_binary"))


@register("html_languages", r"SELECT doc_id, regexp_matches(text, '(?i)<html\b|<!doctype\s+html|<div\b|<body\b') AS html, regexp_matches(text, '(?i)<script\b') AS script, regexp_matches(text, '(?i)<style\b') AS style FROM documents WHERE text IS NOT NULL")
def html_languages(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "documents").filter("text is not null").select("doc_id", code.html_languages(F.col("text")).alias("l"))
    return x.select("doc_id", *[F.array_contains("l", lang).alias(c) for lang, c in (("HTML", "html"), ("JavaScript", "script"), ("CSS", "style"))])


@register(
    "language_confidence",
    r"""SELECT id, CASE WHEN lower(regexp_extract(file_path, '\.([^./]+)$', 1)) IN ('go', 'py', 'js', 'ts', 'cpp', 'cc', 'cxx', 'c++', 'rs', 'java', 'c', 'rb', 'php', 'html', 'css', 'json', 'yaml', 'yml', 'xml', 'md', 'sql', 'sh') THEN 0.95::DOUBLE
      WHEN regexp_matches(content, '^#!/(usr/bin/(env (python|node|ruby|php|bash)|python|ruby|php)|bin/(ba)?sh)') THEN 0.90::DOUBLE WHEN NOT regexp_matches(content, '[{}(<:=*#]|package|import|require|SELECT|TABLE|def|use|type|@media') AND trim(coalesce(language, '')) = '' THEN 0.0::DOUBLE END AS confidence
      FROM code_chunks WHERE deleted_at IS NULL AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) IN ('go', 'py', 'js', 'ts', 'cpp', 'cc', 'cxx', 'c++', 'rs', 'java', 'c', 'rb', 'php', 'html', 'css', 'json', 'yaml', 'yml', 'xml', 'md', 'sql', 'sh')""",
)
def language_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The confidence where a file's extension tells the language; what contents tell is compared by language_detection_all."""
    c = live(load(spark, d, "code_chunks")).filter(strings.extension_language(F.col("file_path")).isNotNull())
    return c.select("id", code.detected_language(F.col("file_path"), F.col("content"), strings.extension_language(F.col("file_path")), F.col("language"))[1].alias("confidence"))


_GO_WORDS = "'break', 'case', 'chan', 'const', 'continue', 'default', 'defer', 'else', 'fallthrough', 'for', 'func', 'go', 'goto', 'if', 'import', 'interface', 'map', 'package', 'range', 'return', 'select', 'struct', 'switch', 'type', 'var'"


@register(
    "identifier_validity",
    f"SELECT id, w, w <> '' AND NOT regexp_matches(w, '^[0-9]') AND NOT (lower(coalesce(language, '')) = 'go' AND w IN ({_GO_WORDS})) AS valid FROM (SELECT id, language, regexp_extract(content, '\\w+') AS w FROM code_chunks WHERE deleted_at IS NULL AND lower(coalesce(language, '')) <> 'python')",
)
def identifier_validity(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks")).filter("lower(coalesce(language, '')) <> 'python'").select("id", "language", F.regexp_extract("content", r"\w+", 0).alias("w"))
    return c.select("id", "w", code.valid_identifier(F.col("w"), F.col("language")).alias("valid"))


@register(
    "doc_details",
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN list_position(l, '') > 0 THEN array_to_string(list_filter(l[list_position(l, '') + 1:], lambda x: x <> '' AND NOT starts_with(x, '@')), chr(10)) ELSE '' END AS details FROM l""",
)
def doc_details(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", code.doc_details(F.col("text")).alias("details"))


_CALL_NAMES = r"list_transform(list_filter(regexp_split_to_array(content, '\s+'), lambda w: contains(w, '(')), lambda w: CASE WHEN contains(split_part(w, '(', 1), '.') THEN split_part(split_part(w, '(', 1), '.', 2) ELSE split_part(w, '(', 1) END)"


@register(
    "called_names_all",
    f"SELECT id, len(list_filter({_CALL_NAMES}, lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') AND x NOT IN ('if', 'for', 'while', 'switch', 'return', 'func', 'function', 'def', 'class', 'catch', 'elif', 'else', 'and', 'or', 'not', 'in'))) AS calls FROM code_chunks WHERE deleted_at IS NULL",
)
def called_names_all(spark: SparkSession, d: str) -> DataFrame:
    """called_names of chunks of every type."""
    return live(load(spark, d, "code_chunks")).select("id", F.size(code.called_names(F.col("content"))).cast("long").alias("calls"))


@register("doc_summary_all", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '@'))[1], '') AS summary FROM documents WHERE text IS NOT NULL")
def doc_summary_all(spark: SparkSession, d: str) -> DataFrame:
    """doc_summary of documents of every kind."""
    return load(spark, d, "documents").filter("text is not null").select("doc_id", code.doc_summary(F.col("text")).alias("summary"))


@register("struct_tags_all", r"""SELECT id, len(regexp_extract_all(content, '(\w+):"([^"]*)"')) AS n, regexp_extract_all(content, '(\w+):"([^"]*)"', 1)[1] AS first FROM code_chunks WHERE deleted_at IS NULL""")
def struct_tags_all(spark: SparkSession, d: str) -> DataFrame:
    """struct_tags of files of every language."""
    c = live(load(spark, d, "code_chunks")).withColumn("t", code.struct_tags(F.col("content")))
    return c.select("id", F.size("t").cast("long").alias("n"), F.try_element_at("t", F.lit(1))["name"].alias("first"))


@register("shared_words", "WITH p AS (SELECT id, string_split(signature, ' ') AS b, string_split(lag(signature) OVER (PARTITION BY repository_id, file_path ORDER BY start_line, id), ' ') AS a FROM code_chunks WHERE deleted_at IS NULL AND signature IS NOT NULL) SELECT id, len(list_filter(b, lambda x: list_contains(a, x)))::INT AS shared FROM p WHERE a IS NOT NULL")
def shared_words(spark: SparkSession, d: str) -> DataFrame:
    """How many words of a signature the one before in the file has too, repetitions counted."""
    c = live(load(spark, d, "code_chunks")).filter("signature is not null")
    before = F.lag("signature").over(Window.partitionBy("repository_id", "file_path").orderBy("start_line", "id"))
    c = c.withColumn("a", F.split(before, " ")).filter("a is not null")
    return c.select("id", code.shared_count(F.col("a"), F.split("signature", " ")).alias("shared"))


@register(
    "repository_candidates",
    """WITH n AS (SELECT id, replace(normalized_url, 'https://', '') AS n, string_split(replace(normalized_url, 'https://', ''), '/') AS p FROM repositories WHERE deleted_at IS NULL),
    c AS (SELECT id, n AS candidate, 0 AS ord FROM n UNION ALL SELECT id, array_to_string(p[2:], '/'), 1 FROM n WHERE len(p) >= 3)
    SELECT c.id, c.candidate, c.ord, r.id AS found FROM c LEFT JOIN (SELECT id, name FROM repositories WHERE deleted_at IS NULL) r ON r.name = c.candidate""",
)
def repository_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = live(load(spark, d, "repositories"))
    c = r.select("id", F.posexplode(code.name_candidates(F.replace("normalized_url", F.lit("https://"), F.lit("")))).alias("ord", "candidate"))
    return c.join(r.select(F.col("id").alias("found"), "name"), F.col("candidate") == F.col("name"), "left").select("id", "candidate", "ord", "found")


@register(
    "error_codes",
    """SELECT doc_id, 'git' || CASE WHEN regexp_matches(text, 'connection refused|connection failed|no connection') THEN '_connection_failure' WHEN regexp_matches(text, 'timeout|timed out|deadline exceeded') THEN '_timeout_failure'
      WHEN regexp_matches(text, 'authentication|auth|login|credential') THEN '_auth_failure' WHEN regexp_matches(text, 'permission|forbidden|unauthorized|access denied') THEN '_permission_failure' WHEN regexp_matches(text, 'not found|404|does not exist|missing') THEN '_not_found'
      WHEN regexp_matches(text, 'validation|invalid|malformed|bad request') THEN '_validation_failure' WHEN regexp_matches(text, 'disk|storage|filesystem|no space') THEN '_storage_failure' WHEN regexp_matches(text, 'memory|out of memory|oom') THEN '_memory_failure'
      WHEN regexp_matches(text, 'network|connection|socket') THEN '_network_failure' WHEN regexp_matches(text, 'rate limit|too many requests|throttle') THEN '_rate_limit_failure' ELSE '_processing_failure' END AS code FROM documents WHERE text IS NOT NULL""",
)
def error_codes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", strings.error_code(F.col("text"), F.lit("git")).alias("code"))


@register(
    "retry_kinds",
    """SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown' WHEN regexp_matches(lower(text), 'nats|jetstream|messaging') THEN 'messaging' WHEN regexp_matches(lower(text), 'connection|timeout|network|dns|refused') THEN 'network'
      WHEN regexp_matches(lower(text), 'authentication|auth|credentials|unauthorized|permission') THEN 'authentication' WHEN regexp_matches(lower(text), 'disk space|no space|space left') THEN 'disk_space' WHEN regexp_matches(lower(text), 'repository|not found|access denied') THEN 'repository_access'
      WHEN regexp_matches(lower(text), 'circuit breaker|circuit') THEN 'circuit_breaker' WHEN regexp_matches(lower(text), 'rate limit|too many requests') THEN 'rate_limit' ELSE 'unknown' END AS kind,
      coalesce(regexp_matches(lower(text), 'quota|rate limit|429|resource exhausted'), false) AS limited, coalesce(regexp_matches(lower(text), 'quota exceeded|quota_exceeded|resource exhausted|billing required|you exceeded your current quota|insufficient quota|429|resource_exhausted'), false) AS quota FROM documents""",
)
def retry_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", strings.retry_kind(t).alias("kind"), strings.is_rate_limited(t).alias("limited"), strings.is_quota_failure(t).alias("quota"))


@register("vec_text_codec", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vec_text_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as texts and read again."""
    v = from_text(to_text(F.col("embedding")))
    return load(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@register("vec_euclid", "SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q")
def vec_euclid(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, d, 1)])
    return load(spark, d, "embeddings").select("vec_id", F.round(euclidean(F.col("embedding"), q), 6).alias("distance"))


# constructs and their quality


@register(
    "complexity_weights",
    """SELECT repository_id, file_path, round(least(1.0, sum(CASE lower(chunk_type) WHEN 'function' THEN 1.0 WHEN 'method' THEN 1.0 WHEN 'class' THEN 2.0 WHEN 'struct' THEN 2.0 WHEN 'interface' THEN 1.5 ELSE 0.5 END + 0.1 * coalesce(len(string_split(signature, ',')), 0)) / (count(*) * 3.0)), 9)::DOUBLE AS complexity
    FROM code_chunks WHERE deleted_at IS NULL GROUP BY 1, 2""",
)
def complexity_weights(spark: SparkSession, d: str) -> DataFrame:
    g = live(load(spark, d, "code_chunks")).groupBy("repository_id", "file_path")
    return g.agg(F.round(chunking.group_complexity(chunking.construct_weight(F.col("chunk_type")), F.size(F.split("signature", ","))), 9).alias("complexity"))


@register(
    "construct_metadata",
    "SELECT id, strlen(content)::VARCHAR AS length, (coalesce(signature, '') <> '')::VARCHAR AS documented, round(1.0 + CASE WHEN strlen(content) > 1000 THEN 0.5 ELSE 0 END + 0.1 * coalesce(len(string_split(signature, ',')), 0), 6)::DOUBLE AS complexity FROM code_chunks WHERE deleted_at IS NULL AND content IS NOT NULL",
)
def construct_metadata(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks")).filter("content is not null")
    score = chunking.content_complexity(F.col("content"), F.lit(0), F.coalesce(F.size(F.split("signature", ",")), F.lit(0)))
    m = chunking.metadata_map(F.col("content"), F.col("signature"), score, F.lit(0))
    return c.select("id", m["content_length"].alias("length"), m["has_documentation"].alias("documented"), F.round(m["complexity_score"].cast("double"), 6).alias("complexity"))


@register(
    "quality_scores",
    """WITH s AS (SELECT doc_id, strlen(text) AS size, trim(text, ' ') <> '' AS filled, kind = 'manifest' AS mixed FROM documents WHERE text IS NOT NULL),
    q AS (SELECT doc_id, greatest(0, 1 - least(1, (1.0 + log10(size / 1000.0 + 1)) / 5.0)) AS complexity, (filled::INT + 1 + 0 + 1 + (NOT mixed OR 1 <= 1)::INT + (size BETWEEN 50 AND 5000)::INT) / 6.0 AS completeness FROM s)
    SELECT doc_id, round(complexity, 6) AS complexity, round(completeness, 6) AS completeness, round(least(1, 0.5 + (2 - complexity) * 0.25 + completeness * 0.15 + 0.1), 6) AS maintainability FROM q""",
)
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Documents as single constructs without context or dependencies."""
    x = load(spark, d, "documents").filter("text is not null")
    one = F.lit(1)
    complexity = chunking.complexity_score(F.lit(1.0), F.lit(0), F.octet_length("text"), one)
    completeness = chunking.completeness_score(F.col("text"), one, F.lit(False), F.lit(0), F.col("kind") == "manifest")
    whole = chunking.maintainability_score(F.lit(1.0), chunking.coupling_score(F.lit(0), one), complexity, completeness, F.lit(1.0))
    return x.select("doc_id", F.round(complexity, 6).alias("complexity"), F.round(completeness, 6).alias("completeness"), F.round(whole, 6).alias("maintainability"))


@register("large_named", "SELECT id FROM code_chunks WHERE deleted_at IS NULL AND strlen(content) >= 200 AND coalesce(entity_name, '') <> ''")
def large_named(spark: SparkSession, d: str) -> DataFrame:
    return live(load(spark, d, "code_chunks")).filter(chunking.large_and_named(F.col("content"), F.col("entity_name"), 200)).select("id")


@register(
    "overlap_context",
    """WITH c AS (SELECT id, lag(entity_name) OVER w AS a, lag(signature) OVER w AS b, lag(qualified_name) OVER w AS c FROM code_chunks WHERE deleted_at IS NULL WINDOW w AS (PARTITION BY repository_id, file_path ORDER BY start_line, id)),
    s AS (SELECT id, b, c, CASE WHEN strlen(coalesce(a, '')) BETWEEN 1 AND 60 THEN a ELSE '' END AS x FROM c),
    t AS (SELECT id, c, CASE WHEN coalesce(b, '') = '' THEN x WHEN x = '' AND strlen(b) <= 60 THEN b WHEN x <> '' AND strlen(x) + 1 + strlen(b) <= 60 THEN x || chr(10) || b ELSE x END AS x FROM s)
    SELECT id, CASE WHEN coalesce(c, '') = '' THEN x WHEN x = '' AND strlen(c) <= 60 THEN c WHEN x <> '' AND strlen(x) + 1 + strlen(c) <= 60 THEN x || chr(10) || c ELSE x END AS context FROM t""",
)
def overlap_context(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("repository_id", "file_path").orderBy("start_line", "id")
    c = live(load(spark, d, "code_chunks"))
    return c.select("id", chunking.overlap_context([F.lag(x).over(w) for x in ("entity_name", "signature", "qualified_name")], 60).alias("context"))


@register(
    "preceding_class",
    """WITH c AS (SELECT * FROM code_chunks WHERE deleted_at IS NULL)
    SELECT m.id, arg_min(o.id, (m.start_line - o.end_line, o.id)) AS owner_id FROM c m JOIN c o ON o.repository_id = m.repository_id AND o.file_path = m.file_path AND o.chunk_type = 'class' AND o.end_line < m.start_line
    WHERE m.chunk_type <> 'class' AND m.start_line - o.end_line <= 40 GROUP BY 1""",
)
def preceding_class(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks"))
    m = c.filter("chunk_type <> 'class'").select("id", "repository_id", "file_path", "start_line")
    o = c.filter("chunk_type = 'class'").select("repository_id", "file_path", F.col("id").alias("owner_id"), F.col("end_line").alias("owner_end"))
    return intervals.preceding(m, o, ["repository_id", "file_path"], 40).select("id", "owner_id")


@register("construct_chunks")
def construct_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunk_rows(live(load(spark, d, "code_chunks")))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    c = live(load(spark, d, "code_chunks"))
    at = F.sum(F.octet_length("content") + 2).over(Window.partitionBy("repository_id", "file_path").orderBy("start_line", "id"))
    p = c.withColumn("end_byte", at.cast("int")).withColumn("start_byte", (F.col("end_byte") - F.octet_length("content") - 2).cast("int"))
    return p.select("repository_id", "file_path", F.col("chunk_type").alias("kind"), F.coalesce("entity_name", "id").alias("name"), "start_byte", "end_byte", F.coalesce(F.lower("language"), F.lit("")).alias("language"))


@register("class_groups")
def class_groups(spark: SparkSession, d: str) -> DataFrame:
    return chunking.grouped(_pieces(spark, d), ["repository_id", "file_path"], "class")


@register("adaptive_groups")
def adaptive_groups(spark: SparkSession, d: str) -> DataFrame:
    return chunking.grouped(_pieces(spark, d), ["repository_id", "file_path"], "adaptive")


# stored tables


@register("hard_delete", "SELECT model_version, count(*) AS n FROM embeddings_partitioned WHERE deleted_at IS NULL GROUP BY 1")
def hard_delete(spark: SparkSession, d: str) -> DataFrame:
    e = upserts.hard_delete(load(spark, d, "embeddings_partitioned"), F.col("deleted_at").isNotNull())
    return e.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"))


@register("status_remap", "SELECT id, CASE status WHEN 'processing' THEN 'indexing' WHEN 'completed' THEN 'indexed' ELSE status END AS status FROM repositories")
def status_remap(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "repositories").select("id", upserts.remapped(F.col("status"), {"processing": "indexing", "completed": "indexed"}).alias("status"))


@register("missing_chunks", "SELECT DISTINCT chunk_id AS id FROM embeddings_partitioned WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM code_chunks WHERE deleted_at IS NULL AND chunk_type = 'function')")
def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids that vectors name and that aren't stored as live functions."""
    asked = load(spark, d, "embeddings_partitioned").select(F.col("chunk_id").alias("id"))
    return upserts.fetched(asked, live(load(spark, d, "code_chunks")).filter("chunk_type = 'function'"), "id")[1]


@register("orphan_vectors", "SELECT count(*) AS n, count(DISTINCT e.id) AS ids FROM embeddings_partitioned e WHERE NOT EXISTS (SELECT 1 FROM code_chunks c WHERE c.id = e.chunk_id AND c.deleted_at IS NULL) OR NOT EXISTS (SELECT 1 FROM repositories r WHERE r.id = e.repository_id AND r.deleted_at IS NULL)")
def orphan_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings_partitioned").select("id", "chunk_id", "repository_id")
    gone = upserts.orphans(e, [(live(load(spark, d, "code_chunks")), "chunk_id", "id"), (live(load(spark, d, "repositories")), "repository_id", "id")])
    return gone.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@register("set_except_rows", "SELECT DISTINCT repository_id FROM code_chunks WHERE chunk_type = 'function' EXCEPT SELECT DISTINCT repository_id FROM code_chunks WHERE chunk_type = 'query'")
def set_except_rows(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "code_chunks")
    return c.filter("chunk_type = 'function'").select("repository_id").subtract(c.filter("chunk_type = 'query'").select("repository_id"))


@register(
    "embedding_merge",
    """WITH o AS (SELECT chunk_id, min(id) AS id, max(model_version) AS model FROM embeddings_partitioned WHERE chunk_id IS NOT NULL AND deleted_at IS NOT NULL GROUP BY 1),
    n AS (SELECT chunk_id, min(id) AS id, max(model_version) AS model FROM embeddings_partitioned WHERE chunk_id IS NOT NULL AND deleted_at IS NULL GROUP BY 1)
    SELECT chunk_id, coalesce(o.id, n.id) AS id, CASE WHEN n.chunk_id IS NOT NULL THEN n.model ELSE o.model END AS model FROM o FULL JOIN n USING (chunk_id)""",
)
def embedding_merge(spark: SparkSession, d: str) -> DataFrame:
    """Live vectors merged into the stored ones by chunk: a stored id stays, the model is replaced."""
    e = load(spark, d, "embeddings_partitioned").filter("chunk_id is not null")
    per = lambda x: x.groupBy("chunk_id").agg(F.min("id").alias("id"), F.max("model_version").alias("model"))
    return upserts.upsert(per(e.filter("deleted_at is not null")), per(live(e)), ["chunk_id"], ["model"], keep=["id"]).select("chunk_id", "id", "model")


# windows that begin with their first event

_FIRST = """WITH RECURSIVE e AS ({events}), s AS (SELECT DISTINCT {key}, epoch_us(ts) // 1000000 AS t FROM e),
    w AS (SELECT {key}, min(t) AS t FROM s GROUP BY {key} UNION ALL SELECT * FROM (SELECT {qualified}, (SELECT min(s.t) FROM s WHERE {same} AND s.t > w.t + {seconds}) AS t FROM w) WHERE t IS NOT NULL)"""


@register(
    "alert_dedup",
    _FIRST.format(events=_CODES, key="code, severity", qualified="w.code, w.severity", same="s.code = w.code AND s.severity = w.severity", seconds=300)
    + " SELECT arg_min(e.event_id, e.ts) AS event_id FROM w JOIN e ON e.code = w.code AND e.severity = w.severity AND epoch_us(e.ts) // 1000000 = w.t GROUP BY w.code, w.severity, w.t",
)
def alert_dedup(spark: SparkSession, d: str) -> DataFrame:
    return errors.first_in_window(_coded(spark, d), ["code", "severity"], "ts", 300).select("event_id")


@register(
    "alert_windows",
    _FIRST.format(events=_CODES, key="code, severity", qualified="w.code, w.severity", same="s.code = w.code AND s.severity = w.severity", seconds=300)
    + " SELECT w.code, w.severity, epoch_us(min(e.ts)) AS first_at, count(*) AS n, count(*) >= 2 AS suppressed FROM w JOIN e ON e.code = w.code AND e.severity = w.severity AND epoch_us(e.ts) // 1000000 BETWEEN w.t AND w.t + 300 GROUP BY w.code, w.severity, w.t",
)
def alert_windows(spark: SparkSession, d: str) -> DataFrame:
    w = errors.duplicates_in_window(_coded(spark, d), ["code", "severity"], "ts", 300, 2)
    return w.select("code", "severity", F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_at"), "n", "suppressed")


@register(
    "err_first_window",
    _FIRST.format(events=_CODES, key="code", qualified="w.code", same="s.code = w.code", seconds=301)
    + " SELECT w.code, epoch_us(min(e.ts)) AS first_at, count(*) AS n, ['CRITICAL', 'ERROR', 'WARNING', 'INFO'][min(list_position(['CRITICAL', 'ERROR', 'WARNING', 'INFO'], e.severity))] AS severity FROM w JOIN e ON e.code = w.code AND epoch_us(e.ts) // 1000000 BETWEEN w.t AND w.t + 301 GROUP BY w.code, w.t",
)
def err_first_window(spark: SparkSession, d: str) -> DataFrame:
    return errors.windows_from_first(_coded(spark, d)).select("code", F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_at"), "n", "severity")


@register(
    "err_cascade_severity",
    """WITH e AS (SELECT event_type AS code, ts, CASE WHEN value > 90 THEN 0 WHEN event_type = 'error' THEN 1 WHEN value > 50 THEN 2 ELSE 3 END AS r FROM events),
    w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ws, code, min(r) AS r, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1, 2)
    SELECT epoch_us(ws) AS at, CASE min(r) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS severity FROM w GROUP BY ws HAVING count(*) >= 2 AND epoch_us(max(b)) - epoch_us(min(a)) <= 200000000""",
)
def err_cascade_severity(spark: SparkSession, d: str) -> DataFrame:
    return errors.cascades(errors.windows(_coded(spark, d)), 200).select(F.unix_micros("window_start").alias("at"), "severity")


@register("err_groups")
def err_groups(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "code_chunks").select(F.concat(F.lower(F.substring_index("file_path", "/", 1)), F.lit("_"), "chunk_type").alias("code"))
    return errors.similarity_groups(c, 0.3)


@register("size_groups")
def size_groups(spark: SparkSession, d: str) -> DataFrame:
    return chunking.grouped(_pieces(spark, d), ["repository_id", "file_path"], "size", 800, 100)


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, each user and type once: repetitions within a watermark of 60 days."""
    table, out = load(spark, d, "events"), scratch_path(spark, "distinct")
    src = spark.readStream.schema(table.schema).parquet(f"{d.rstrip('/')}/events*.parquet")
    got = stream_events.distinct_messages(src.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    q = got.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")


# search end to end

_TERM = "harbor"


@register(
    "search_resolved",
    f"""WITH c AS (SELECT c.*, r.name AS repository FROM code_chunks c JOIN repositories r ON r.id = c.repository_id WHERE c.deleted_at IS NULL AND r.deleted_at IS NULL),
    l AS (SELECT repository, repository_id, file_path, start_line, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM c),
    h AS (SELECT repository, repository_id, file_path, min(start_line + n) AS hit_line, count(DISTINCT start_line + n) AS score FROM l WHERE contains(lower(line), '{_TERM}') GROUP BY 1, 2, 3),
    j AS (SELECT h.repository, h.file_path, h.hit_line, h.score, c.id, c.start_line, c.end_line FROM h LEFT JOIN c ON c.repository_id = h.repository_id AND c.file_path = h.file_path AND h.hit_line BETWEEN c.start_line AND c.end_line
      QUALIFY row_number() OVER (PARTITION BY h.repository_id, h.file_path ORDER BY c.end_line - c.start_line, c.start_line, c.id) = 1),
    t AS (SELECT id AS chunk_id, repository, file_path, coalesce(start_line, hit_line) AS start_line, coalesce(end_line, hit_line) AS end_line, row_number() OVER (ORDER BY score DESC, repository, file_path, coalesce(start_line, hit_line), id NULLS LAST) AS r FROM j QUALIFY r <= 60),
    q AS (SELECT embedding FROM embeddings WHERE vec_id = 1),
    v AS (SELECT e.chunk_id, max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS s FROM embeddings_partitioned e, q WHERE e.deleted_at IS NULL AND len(e.embedding) = 64 AND e.chunk_id IN (SELECT id FROM c) AND NOT isnan(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) GROUP BY 1),
    s AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM v QUALIFY r <= 60),
    f AS (SELECT coalesce(s.chunk_id, t.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + s.r), 0) + coalesce(1.0::DOUBLE / (60 + t.r), 0) AS score, CASE WHEN s.r IS NOT NULL AND t.r IS NOT NULL THEN 'both' WHEN s.r IS NOT NULL THEN 'embedding' ELSE 'text' END AS source,
      coalesce(c.repository, t.repository) AS repository, coalesce(c.file_path, t.file_path) AS file_path, coalesce(c.start_line, t.start_line) AS start_line, coalesce(c.end_line, t.end_line) AS end_line FROM s FULL JOIN t ON s.chunk_id = t.chunk_id LEFT JOIN c ON c.id = s.chunk_id)
    SELECT chunk_id, round(score, 9) AS score, source, row_number() OVER (ORDER BY score DESC, repository, file_path, start_line, end_line, chunk_id) AS position FROM f ORDER BY position LIMIT 50 OFFSET 10""",
)
def search_resolved(spark: SparkSession, d: str) -> DataFrame:
    """A hybrid page: files of a text engine resolved to chunks, fused with the nearest vectors."""
    c, r, e = (load(spark, d, t) for t in ("code_chunks", "repositories", "embeddings_partitioned"))
    ask = service.SearchRequest(_TERM, mode="hybrid", limit=50, offset=10, threshold=0.0)
    got = service.run(ask, list(_vector(spark, d, 1)), c, r, e, service.line_hits(ask, c, r))
    return got.select("chunk_id", F.round("score", 9).alias("score"), "source", "position")


@register(
    "search_text_order",
    f"""WITH c AS (SELECT c.*, r.name AS repository FROM code_chunks c JOIN repositories r ON r.id = c.repository_id WHERE c.deleted_at IS NULL AND r.deleted_at IS NULL),
    h AS (SELECT id AS chunk_id, (length(content) - length(replace(lower(content), '{_TERM}', ''))) / length('{_TERM}') AS times, repository, file_path, start_line FROM c WHERE contains(lower(content), '{_TERM}'))
    SELECT chunk_id, row_number() OVER (ORDER BY times DESC, repository, file_path, start_line, chunk_id) AS rank FROM h ORDER BY rank LIMIT 80""",
)
def search_text_order(spark: SparkSession, d: str) -> DataFrame:
    ask = service.SearchRequest(_TERM, mode="text", limit=80)
    return service.text(ask, load(spark, d, "code_chunks"), load(spark, d, "repositories")).select("chunk_id", "rank")
