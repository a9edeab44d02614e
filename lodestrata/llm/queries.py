"""Queries pN_... over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import live, load
from . import copies, leakage, mixing, near_copies, neighbours, origin, ranking, subjects, syntax

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.leaders(ranking.net_flow(load(spark, d, "search_results"))).select("query_id", "chunk_id")


def p1_flows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.net_flow(load(spark, d, "search_results")).select("query_id", "chunk_id", F.round("net_flow", 6).alias("net_flow"))


def p1_linear(spark: SparkSession, d: str) -> DataFrame:
    flows = ranking.net_flow(load(spark, d, "search_results"), preference=(0.05, 0.4))
    return flows.select("query_id", "chunk_id", F.round("net_flow", 6).alias("net_flow"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(live(load(spark, d, "code_chunks")))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_counts(live(load(spark, d, "code_chunks")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.not_hand_written(live(load(spark, d, "code_chunks"))).select("repository_id", "file_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    links = near_copies.NearCopies(threshold=0.6, shingle=3, least_words=20)
    return links.pairs(live(load(spark, d, "code_chunks"))).select("chunk_id_a", "chunk_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.NearCopies(threshold=0.6, shingle=3, least_words=20).groups(live(load(spark, d, "code_chunks")))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.NearCopies(threshold=0.6, shingle=3, least_words=20).links(live(load(spark, d, "code_chunks")))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.Neighbours().neighbours(load(spark, d, "embeddings_partitioned")).select("id", "neighbour_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(live(load(spark, d, "code_chunks")))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.file_verdicts(live(load(spark, d, "code_chunks"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_shares(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).filter("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    model = subjects.train(docs, load(spark, d, "subject_labels"), load(spark, d, "subject_areas"))
    return subjects.assign(docs, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_assigned(spark, d), load(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_flows, p1_linear, p2_found, p2_counts, p3_found, p4_found, p4_groups, p4_links, p5_found, p6_found, p6_rates, p8_found, p8_items, p9_found, p9_shares, p9_mix, p10_found, p10_composition)}

_FLOWS = """
WITH best AS (
  SELECT query_id, chunk_id, lower(trim(source_engine)) AS e,
         max(CASE WHEN similarity IS NOT NULL AND NOT isnan(similarity) THEN similarity END) AS s
  FROM search_results GROUP BY 1, 2, 3),
n AS (SELECT query_id, count(DISTINCT chunk_id) AS n FROM best GROUP BY 1),
ranked AS (
  SELECT query_id, chunk_id, e,
         2 * (rank() OVER (PARTITION BY query_id, e ORDER BY s) - 1) + count(*) OVER (PARTITION BY query_id, e, s)
           - count(*) OVER (PARTITION BY query_id, e) AS gain,
         count(*) OVER (PARTITION BY query_id, e) AS m
  FROM best WHERE s IS NOT NULL),
lost AS (SELECT query_id, sum(m) AS lost, count(*) AS w FROM (SELECT DISTINCT query_id, e, m FROM ranked) GROUP BY 1),
got AS (SELECT query_id, chunk_id, sum(gain) AS gain, count(*) AS k FROM ranked GROUP BY 1, 2),
flows AS (
  SELECT c.query_id, c.chunk_id,
         (coalesce(g.gain, 0) + n.n * coalesce(g.k, 0) - coalesce(l.lost, 0)) AS num, (n.n - 1) * coalesce(l.w, 0) AS scale
  FROM (SELECT DISTINCT query_id, chunk_id FROM best) c JOIN n USING (query_id)
  LEFT JOIN got g USING (query_id, chunk_id) LEFT JOIN lost l USING (query_id))
"""

ORACLE: dict[str, str] = {
    "p1_found": _FLOWS + "SELECT query_id, chunk_id FROM flows QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY num DESC, chunk_id) <= 5",
    "p1_flows": _FLOWS + "SELECT query_id, chunk_id, CASE WHEN scale > 0 THEN round(num / scale, 6) ELSE 0.0 END AS net_flow FROM flows",
    # every pair by the definition of the preference function
    "p1_linear": """
WITH best AS (
  SELECT query_id, chunk_id, lower(trim(source_engine)) AS e, max(CASE WHEN similarity IS NOT NULL AND NOT isnan(similarity) THEN similarity END) AS s FROM search_results GROUP BY 1, 2, 3),
n AS (SELECT query_id, count(DISTINCT chunk_id) AS n FROM best GROUP BY 1),
r AS (SELECT query_id, chunk_id, e, (2 * (rank() OVER w - 1) + count(*) OVER (PARTITION BY query_id, e, s) - 1) / nullif(2.0::DOUBLE * (count(*) OVER (PARTITION BY query_id, e) - 1), 0) AS p, count(*) OVER (PARTITION BY query_id, e) AS m
      FROM best WHERE s IS NOT NULL WINDOW w AS (PARTITION BY query_id, e ORDER BY s)),
g AS (SELECT a.query_id, a.chunk_id, a.e, any_value(a.m) AS m, sum(CASE WHEN a.p - b.p > 0 THEN least(1, greatest(0, (a.p - b.p - 0.05) / 0.35)) WHEN a.p - b.p < 0 THEN -least(1, greatest(0, (b.p - a.p - 0.05) / 0.35)) ELSE 0 END) AS net
      FROM r a JOIN r b USING (query_id, e) GROUP BY 1, 2, 3),
w AS (SELECT query_id, count(*) AS w, sum(m) AS lost FROM (SELECT DISTINCT query_id, e, m FROM r) GROUP BY 1),
f AS (SELECT query_id, chunk_id, sum(net - m + n + m) AS got, sum(m) AS had FROM g JOIN n USING (query_id) GROUP BY 1, 2)
SELECT c.query_id, c.chunk_id, CASE WHEN (n.n - 1) * coalesce(w.w, 0) > 0 THEN round((coalesce(f.got, 0) - coalesce(w.lost, 0)) / ((n.n - 1) * w.w), 6) ELSE 0.0 END AS net_flow
FROM (SELECT DISTINCT query_id, chunk_id FROM best) c JOIN n USING (query_id) LEFT JOIN w USING (query_id) LEFT JOIN f USING (query_id, chunk_id)""",
}
