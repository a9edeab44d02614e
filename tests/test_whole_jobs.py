"""Queries and operators over whole tables, where an earlier form covered a part."""

import numpy as np

from lodestrata.catalogue import QUERIES
from lodestrata.operators import search
from lodestrata.sources.tables import load


def test_fusion_of_every_query(spark, small):
    cols = "query_id int, rank int, chunk_id string, repository string, file_path string, start_line int, end_line int, content string"
    s = spark.createDataFrame([(q, 1, "a", "r", "f", 1, 2, "s") for q in (1, 2)], cols)
    t = spark.createDataFrame([(2, 1, "a", "r", "f", 1, 2, "t"), (3, 1, "b", "r", "f", 1, 2, "t")], cols)
    got = {(r.query_id, r.chunk_id, r.source, r.position) for r in search.fuse(s, t, ["query_id"]).collect()}
    assert got == {(1, "a", "embedding", 1), (2, "a", "both", 1), (3, "b", "text", 1)}
    answered = load(spark, small, "search_results").filter("lower(source_engine) in ('embedding', 'zoekt') and similarity is not null and not isnan(similarity)").select("query_id").distinct()
    assert {r.query_id for r in QUERIES["hybrid_rrf_all"](spark, small).collect()} == {r.query_id for r in answered.collect()}


def test_top_k_of_every_query_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    data = [(f"{k // 2:03}", v.tolist()) for k, v in enumerate(x)] + [("n", None), ("z", [0.0] * 4), ("s", [1.0]), (None, [1.0] * 4)]
    asked = [(q, x[q].tolist()) for q in range(0, 300, 7)] + [(1000, None), (1001, [0.0] * 4), (1002, [2.0])]
    df = spark.createDataFrame(data, "chunk_id string, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    want = {1002: [("s", 1.0)]}
    for q, v in asked[:-3]:
        best = {}
        for i, e in data[:300]:
            if any(e) and any(v):
                best[i] = max(best.get(i, -2), round(float(np.dot(e, v) / np.linalg.norm(e) / np.linalg.norm(v)), 9))
        if best:
            want[q] = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:5]
    for per_pass in (20_000, 10):
        got = {}
        for r in search.top_k_each(df, qdf, 5, per_pass=per_pass).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, round(r.similarity, 9)))
        assert got == want
    assert search.top_k_each(df, qdf, 5, at_least=2.0).count() == 0 and search.top_k_each(df, qdf.limit(0), 5).count() == 0 and search.top_k_each(df.limit(0), qdf, 5).count() == 0


def test_language_of_every_live_chunk(spark, small):
    live_ids = {r.id for r in load(spark, small, "code_chunks").filter("deleted_at is null").select("id").collect()}
    assert {r.id for r in QUERIES["language_detection_all"](spark, small).collect()} == live_ids
