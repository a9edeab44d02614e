"""Functions on program texts, source trees and relations, on literal inputs."""

from pyspark.sql import functions as F

from lodestrata.functions import code
from lodestrata.operators import extract, graphs
from lodestrata.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_language_and_markup(spark):
    def lang(path, content):
        from lodestrata.functions.strings import extension_language

        x, c = code.detected_language(F.lit(path), F.lit(content), extension_language(F.lit(path)))
        return one(spark, F.concat_ws("|", x, c))

    assert lang("a.go", "x") == "Go|0.95" and lang("run", "#!/usr/bin/env python3\nx") == "Python|0.9" and lang("x", "fn main() {") == "Rust|0.8" and lang("x", "plain words") == "0.0"
    assert one(spark, code.html_languages(F.lit("<html><script>x</script></html>"))) == ["HTML", "JavaScript"]


def test_binary(spark):
    def is_bin(path, data):
        return one(spark, code.is_binary(F.lit(path), F.lit(bytearray(data))))

    assert is_bin("a.png", b"x") and is_bin("a", b"\x89PNG\r\n") and is_bin("a", b"text\x00more") and is_bin("a", bytes(range(128, 200)))
    assert not is_bin("a.go", b"package p\n\tx := 1\r\n") and not is_bin("a", b"") and not is_bin("a", b"abc\x50\x00"[:4])


def test_hash_documents_and_tags(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string")
    assert [r.h for r in df.select(code.fnv32a("t").alias("h")).collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]
    doc = F.lit("\n  First line.\nmore\n@param a the a\n @return b\n@bare\n")
    assert one(spark, code.doc_summary(doc)) == "First line." and [tuple(x) for x in one(spark, code.doc_tags(doc))] == [("param", "a the a"), ("return", "b")]
    assert [(t.name, t.args) for t in one(spark, code.struct_tags(F.lit('A int `json:"a, omitempty" db:"x"`')))] == [("json", ["a", "omitempty"]), ("db", ["x"])]
    assert one(spark, code.called_names(F.lit("if (x) { a.run(1); go(\n b.c.d() }"))) == ["run", "go", "c"]
    assert one(spark, code.similar_names(F.lit("readFile"), F.lit("READline"))) and not one(spark, code.similar_names(F.lit("ab"), F.lit("ab")))
    assert one(spark, code.compatible(F.lit("2.1"), "2")) and not one(spark, code.compatible(F.lit("21"), "2"))
    u = "2b9b21a4-c55c-488c-85b4-f83adc31ac33"
    assert one(spark, code.chunk_of_key(code.request_key(F.lit(u)))) == u and one(spark, code.chunk_of_key(F.lit("x"))) is None


def test_submodules_and_parts():
    assert code.submodules('[submodule "a"]\n\tpath = lib/a\n\turl = https://x/a.git\n[submodule "b"]\n\turl = y\n') == [("a", "lib/a", "https://x/a.git")]
    assert code.python_parts("import a\n\n@d\ndef f():\n    pass\n\n@e\nclass B:\n    x = 1") == [(1, 6), (7, 9)]
    assert code.python_parts("x = 1") == [(1, 1)]


def test_source_tree(spark, tmp_path):
    for name, data in {"a/x.go": b"package a\n", "a/x_test.go": b"package a\n", "vendor/y.go": b"package y\n", "b.bin": b"\x7fELF", "c.py": b"x = 1\n" * 50_000, "d.py": b"y = 2\n", "e.log": b"z"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = lambda **k: sorted(r.path for r in files.source_files(spark, str(tmp_path), max_bytes=100_000, **k).collect())
    assert got() == ["a/x.go", "a/x_test.go", "d.py", "e.log"]
    assert got(tests=False, ignore=["*.log"]) == ["a/x.go", "d.py"] and got(patterns=["*.py"]) == ["d.py"]


def test_request_files(spark, tmp_path):
    u = "2b9b21a4-c55c-488c-85b4-f83adc31ac33"
    files.write_requests(spark.createDataFrame([(u, "text")], "id string, content string"), str(tmp_path / "req"))
    assert spark.read.json(str(tmp_path / "req")).first().key == "chunk_" + u.replace("-", "")
    (tmp_path / "res.json").write_text('{"key": "chunk_%s", "embedding": [1, 2]}\n{"key": "other", "error": "x"}\n' % u.replace("-", ""))
    assert sorted((r.chunk_id or "", r.error or "") for r in files.read_results(spark, str(tmp_path / "res.json")).collect()) == [("", "x"), (u, "")]


def test_sql_function(spark):
    files.register_functions(spark)
    assert [tuple(r) for r in spark.sql("select * from line_chunks('aa\nbb\ncc', 6)").collect()] == [(1, 1, 2, "aa\nbb\n"), (2, 3, 3, "cc\n")]


def test_relations(spark):
    rows = [("r", "a", "b(1); c()"), ("r", "b", "x.c(2)"), ("r", "c", "a()"), ("r", "d", "a()"), ("r", None, "a()"), ("s", "a", "b()")]
    e = graphs.call_edges(spark.createDataFrame(rows, "repo string, entity_name string, content string"), ["repo"])
    assert {(r.caller, r.callee) for r in e.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "a")}
    assert sorted(r.name for r in graphs.on_cycles(e, ["repo"]).collect()) == ["a", "b", "c"]
    src = spark.createDataFrame([("1", "class A: pass\nclass P(Protocol): pass\nclass B(A, P, Other): pass\n", "m.py")], "id string, content string, file_path string")
    got = graphs.inheritance(extract.constructs(src), ["id"])
    assert sorted((r.child, r.parent, r.kind, r.weight) for r in got.collect()) == [("B", "A", "inheritance", 0.95), ("B", "P", "implements", 0.90)]
