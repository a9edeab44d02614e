"""Search and indexing end to end on small tables."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import service
from lodestrata.plans import indexing
from lodestrata.sources.files import source_files

CHUNKS = "id string, repository_id string, file_path string, chunk_type string, content string, language string, content_hash string, start_line int, end_line int, token_count int, token_counted_at timestamp, created_at timestamp, deleted_at timestamp"


@pytest.fixture
def tables(spark):
    c = spark.createDataFrame(
        [
            ("1", "r", "a.go", "function", "alpha beta alpha", "Go", "h1", 1, 9, None, None, None, None), ("2", "r", "b.py", "function", "beta", "Python", "h2", 1, 5, None, None, None, None), ("3", "r", "c.go", "class", "alpha", "Go", "h3", 1, 5, None, None, None, None),
            ("4", "s", "d.go", "function", "alpha", "Go", "h4", 1, 5, None, None, None, None), ("5", "gone", "e.go", "function", "alpha", "Go", "h5", 1, 5, None, None, None, None),
        ],
        CHUNKS,
    ).withColumns({"entity_name": F.concat(F.lit("Name"), "id"), "visibility": F.when(F.col("id") == "3", "private").otherwise("Public")})
    r = spark.createDataFrame([("r", "o/r", None), ("s", "o/s", None), ("gone", "o/g", "x")], "id string, name string, deleted_at string")
    e = spark.createDataFrame([(f"e{k}", str(k), rid, v, "m", lang, kind, path, None) for k, rid, v, lang, kind, path in [(1, "r", [1.0, 0.0], "Go", "function", "a.go"), (2, "r", [0.9, 0.1], "Python", "function", "b.py"), (3, "r", [0.8, 0.6], "Go", "class", "c.go"), (4, "s", [0.0, 1.0], "Go", "function", "d.go"), (5, "gone", [1.0, 0.0], "Go", "function", "e.go"), (1, "r", [0.5, 0.5], "Go", "function", "a.go")]], "id string, chunk_id string, repository_id string, embedding array<double>, model_version string, language string, chunk_type string, file_path string, deleted_at string")
    return c, r, e


def ids(df, order=None):
    return [x.chunk_id for x in (df.orderBy(order) if order else df).collect()]


def test_semantic(tables):
    ask = lambda **k: service.run(service.SearchRequest("x", **k), [1.0, 0.0], *tables)
    assert ids(ask()) == ["1", "2", "3"] and ids(ask(threshold=0.0)) == ["1", "2", "3", "4"]
    assert ids(ask(limit=1, offset=1)) == ["2"] and ids(ask(languages=["Go"])) == ["1", "3"] and ids(ask(repository_names=["o/s"], threshold=0)) == ["4"]
    assert ids(ask(visibility=["PRIVATE"], limit=2)) == [] and ids(ask(visibility=["PRIVATE"], limit=2, prefilter=True)) == ["3"]
    assert ids(ask(entity_name="name2")) == ["2"] and ids(ask(sort="file_path:desc")) == ["3", "2", "1"] and ids(ask(extensions=["py"])) == ["2"]


def test_text_and_hybrid(tables):
    run = lambda q, m, **k: service.run(service.SearchRequest(q, mode=m, **k), [1.0, 0.0], *tables)
    assert ids(run("alpha", "text")) == ["1", "3", "4"] and ids(run("alpha AND beta", "text")) == ["1"] and ids(run("repo:o/s", "text")) == ["4"]
    got = run("alpha", "hybrid").orderBy("position").collect()
    assert [(x.chunk_id, x.source) for x in got] == [("1", "both"), ("3", "both"), ("2", "embedding"), ("4", "text")]


def test_hits_of_files(spark, tables):
    """Resolution by lines, by name, with the host in front, and hits that no chunk holds: these leave where a found chunk covers them."""
    c, r, e = tables
    c = c.withColumns({"qualified_name": F.lit("q"), "signature": F.lit("s")})
    hits = spark.createDataFrame([("h1", "o/r", "a.go", 2, 2, 5.0, "x"), ("h2", "host/o/r", "b.py", 1, 1, 4.0, "x"), ("h3", "o/r", "c.go", None, None, 3.0, "name3"), ("h4", "o/r", "a.go", 20, 21, 2.0, "x"), ("h5", "none", "z.go", None, None, 9.0, "x"), ("h6", "o/s", "new.go", 1, 3, 1.0, "x"), ("h7", "o/g", "e.go", 1, 1, 8.0, "x")], "hit_id string, repository string, file_path string, hit_start int, hit_end int, score double, term string")
    got = {x.hit_id: (x.chunk_id, x.start_line, x.end_line) for x in service.resolved(hits, c, r).collect()}
    assert got == {"h1": ("1", 1, 9), "h2": ("2", 1, 5), "h3": ("3", 1, 5), "h4": (None, 20, 21), "h6": (None, 1, 3), "h7": (None, 1, 1)}
    ask = service.SearchRequest("alpha", mode="hybrid", limit=20)
    found = spark.createDataFrame([("o/r", "a.go", 21, 30)], "repository string, file_path string, start_line int, end_line int")
    listed = service.text_of_hits(ask, hits, found, c, r).orderBy("rank").collect()
    assert [x.hit_id for x in listed] == ["h7", "h1", "h2", "h3", "h6"]
    page = service.run(ask, [1.0, 0.0], c, r, e, hits).orderBy("position").collect()
    assert [(x.chunk_id, x.source) for x in page][:2] == [("1", "both"), ("2", "both")] and {x.source for x in page if x.chunk_id is None} == {"text"}
    lines = {(x.repository, x.file_path, x.hit_start, x.score) for x in service.line_hits(ask, c, r).collect()}
    assert lines == {("o/r", "a.go", 1, 1.0), ("o/r", "c.go", 1, 1.0), ("o/s", "d.go", 1, 1.0)}


@pytest.mark.parametrize("bad", [{"query": " "}, {"mode": "x"}, {"limit": 0}, {"limit": 101}, {"offset": -1}, {"threshold": 2}, {"sort": "x"}, {"repository_names": ["a"]}, {"repository_names": ["a/b", "a/b"]}])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        service.SearchRequest(**({"query": "x"} | bad))


def test_indexing_twice(spark, tmp_path):
    (tmp_path / "a.go").write_text("package a\n\nfunc F() {\n\tg()\n}\n\ntype T struct {\n\ta int\n}\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    (tmp_path / "c.md").write_text("words\n" * 600)
    files = source_files(spark, str(tmp_path))
    now = F.lit("2024-01-01").cast("timestamp")
    c = spark.createDataFrame([], CHUNKS)
    e = spark.createDataFrame([], "id string, chunk_id string, repository_id string, embedding array<float>, model_version string, language string, chunk_type string, file_path string, created_at timestamp, deleted_at timestamp")
    embed = lambda text: F.when(F.length(text) > 0, F.array(F.length(text).cast("float"), F.lit(1.0).cast("float")))
    c1, e1 = indexing.index(files, "r", c, e, "m", now, embed)
    c1, e1 = (spark.createDataFrame(t.collect(), t.schema) for t in (c1, e1))
    assert c1.count() == e1.count() > 1
    kinds = {(r.file_path, r.chunk_type) for r in c1.collect()}
    assert kinds == {("a.go", "function"), ("a.go", "struct"), ("b.py", "variable"), ("c.md", "fragment")}
    c2, e2 = indexing.index(files, "r", c1, e1, "m", now, embed)
    assert sorted(r.id for r in c2.collect()) == sorted(r.id for r in c1.collect()) and e2.count() == e1.count()
