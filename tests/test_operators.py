"""Rules that SQL doesn't express, on small literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import strings
from lodestrata.functions.vectors import cosine, dimension_policy, from_text, normalized, to_text, truncated
from lodestrata.operators import catalog, chunking, deliveries, errors, extract, intervals, search, stats, upserts
from lodestrata.plans.prefix import running_sums
from lodestrata.streaming import events as stream

T = dt.datetime(2024, 5, 1)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_running_sums_with_one_group_of_most_rows(spark):
    data = [("big" if k % 3 else "small", k, k % 7) for k in range(3000)]
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(7)
    got = {(r.g, r.o): (r.before, r.all) for r in running_sums(df, ["g"], ["o"], "v", "before", "all").collect()}
    sums = {"big": 0, "small": 0}
    for g, o, v in data:
        assert got[g, o][0] == sums[g]
        sums[g] += v
    assert all(t == sums[g] for (g, _), (_, t) in got.items())
    assert running_sums(df.limit(0), ["g"], ["o"], "v", "before").count() == 0


def test_scratch_is_released(spark):
    from lodestrata import session

    df = session.stage(spark.range(5).toDF("k"), "test")
    path = session._SCRATCH[-1].removeprefix("file:").replace("//", "/")
    import os

    assert df.count() == 5 and os.path.isdir(path)
    kept = session._SCRATCH[:-1]
    session._SCRATCH[:] = session._SCRATCH[-1:]
    session.release(spark)
    session._SCRATCH[:] = kept
    assert not os.path.exists(path)


DELIVERIES = "delivery_id long, request_id string, correlation_id string, received_at timestamp_ntz, extra string"


def test_deliveries_edge_cases(spark):
    u = "2b9b21a4-c55c-488c-85b4-f83adc31ac33"
    rows = [
        (1, u, None, T, "a"), (2, u.upper(), "c", T, "b"), (3, "{" + u + "}", "x", T - dt.timedelta(1), None), (4, f" urn:uuid:{u}\n", None, None, None), (5, u.replace("-", ""), None, T, None),
        (6, None, "k", T, None), (7, " ", "k ", T, None), (8, "k", None, T, None), (9, None, None, T, None), (10, "", "", T, None), (11, "k", None, T, None), (None, "z", None, T, None),
    ]
    df = spark.createDataFrame(rows, DELIVERIES)
    assert sorted(r[0] for r in deliveries.surplus_deliveries(df).collect()) == [1, 2, 4, 5, 7, 11]
    assert deliveries.surplus_deliveries(df.limit(0)).count() == 0
    assert deliveries.kept_deliveries(df).count() == 5


def test_delivery_log_is_idempotent_and_merges_runs(spark):
    rows = [(k, f"m{k % 50 if k % 3 else 0}", None, T + dt.timedelta(seconds=k), "") for k in range(600)]
    df = deliveries.with_identity(spark.createDataFrame(rows, DELIVERIES)).select(*deliveries.IDENTITY, "received_at", "delivery_id")
    log = deliveries.DeliveryLog(spark, buckets=4)
    for _ in range(2):
        log.upsert(df.filter("delivery_id < 400")).upsert(df.filter("delivery_id >= 300"))
    first = {}
    for k, key, *_ in rows:
        first.setdefault(key, k)
    assert log.runs == 4 and log.compact().runs == 1
    assert sorted(r.delivery_id for r in log.current().collect()) == sorted(first.values())
    plan = log.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    log.drop()


SECOND = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lodestrata.operators import deliveries
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
rows = deliveries.with_identity(s.read.parquet(sys.argv[3])).select(*deliveries.IDENTITY, "received_at", "delivery_id")
log = deliveries.DeliveryLog.open(s, sys.argv[1])
log.upsert(rows.filter("delivery_id >= 200"), "second")
log._write(rows.repartition(log.buckets, *deliveries.IDENTITY).selectExpr("id_kind", "id_key", "false unknown", "received_at", "delivery_id - 1000 as delivery_id"))
import os
os._exit(9)  # killed before the version that would list the last run
"""


def test_delivery_log_survives_its_process(spark, tmp_path):
    """A second process opens the log, adds a batch and dies while it writes another one; the first opens what is stored and goes on."""
    import os
    import subprocess
    import sys

    rows = [(k, f"m{k % 50}" if k % 3 else f"n{k}", None, T + dt.timedelta(seconds=1000 - k), "") for k in range(300)]
    src = spark.createDataFrame(rows, DELIVERIES)
    src.write.parquet(str(tmp_path / "rows"))
    df = deliveries.with_identity(src).select(*deliveries.IDENTITY, "received_at", "delivery_id")
    path = f"file://{tmp_path}/log"
    log = deliveries.DeliveryLog(spark, path, buckets=3).upsert(df.filter("delivery_id < 250"), "first")
    log.close()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SECOND, path, str(tmp_path / "wh"), str(tmp_path / "rows")], env=os.environ | {"PYTHONPATH": root}, cwd=tmp_path, timeout=300, capture_output=True)
    assert done.returncode == 9, done.stderr[-500:]
    log = deliveries.DeliveryLog.open(spark, path)
    last = {}
    for k, key, *_ in rows:
        last[key] = k
    assert log.buckets == 3 and log.runs == 2 and sorted(r.delivery_id for r in log.current().collect()) == sorted(last.values())
    for part in ("first", "second"):  # replayed
        assert log.upsert(df, part).runs == 2
    plan = log.current()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert log.compact().runs == 1 and sorted(r.delivery_id for r in log.current().collect()) == sorted(last.values())
    kept = spark.catalog.listTables()
    log.drop()
    assert not os.path.exists(tmp_path / "log") and len(spark.catalog.listTables()) == len(kept) - 1
    with pytest.raises(ValueError):
        deliveries.DeliveryLog.open(spark, path)


def test_staged_tables_are_discarded(spark):
    import os

    from lodestrata import session

    for write in (lambda x: session.stage(x, "gone"), lambda x: session.stage_bucketed(x, ["k"], "gone")):
        df = write(spark.range(5).toDF("k"))
        path, tables = session._SCRATCH[-1], len(spark.catalog.listTables())
        session.discard(df)
        assert path not in session._SCRATCH and not os.path.exists(path.removeprefix("file:").replace("//", "/")) and path not in session._TABLES
        assert len(spark.catalog.listTables()) <= tables
    session.discard(spark.range(3).toDF("k"))


def test_delivery_stream(spark, tmp_path):
    rows = [(k, f"m{k % 7}", None, T + dt.timedelta(seconds=k), "") for k in range(40)]
    df = spark.createDataFrame(rows, DELIVERIES)
    for n in range(3):
        df.filter(F.col("delivery_id") % 3 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = deliveries.DeliveryLog(spark, buckets=2)
    stream.collect_deliveries(stream.read_files(spark, str(tmp_path / "in"), df.schema), log, str(tmp_path / "cp"), compact_after=2)
    assert sorted(r.delivery_id for r in log.current().collect()) == list(range(7))
    log.drop()


def test_stream_dedup(spark, tmp_path):
    df = spark.createDataFrame([(k % 5, T + dt.timedelta(seconds=k)) for k in range(20)], "k int, at timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream.run_available(stream.distinct_messages(stream.read_files(spark, str(tmp_path / "in"), df.schema), ["k"], "at", "1 hour"), lambda b, _: got.extend(b.collect()), str(tmp_path / "cp"))
    assert sorted(r.k for r in got) == [0, 1, 2, 3, 4]


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, normalized(a)) == [0.6, 0.8]
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, normalized(zero)) == [0.0, 0.0] and one(spark, cosine(a, zero)) is None
    assert one(spark, truncated(a, 1)) == [1.0] and one(spark, truncated(a, 3)) is None
    assert [one(spark, dimension_policy(a, k, t)) for k, t in ((2, True), (1, True), (1, False), (3, True), (0, True))] == ["pass", "truncate", "error", "error", "pass"]
    assert one(spark, from_text(to_text(a))) == [3.0, 4.0]


def test_top_k_leaves_out_unusable_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    assert [(r.chunk_id, r.rank) for r in search.top_k(df, [1.0, 0.0], 5).collect()] == [("a", 1), ("b", 2), ("f", 3)]
    assert search.top_k(df, [1.0, 0.0], 5, at_least=0.7).count() == 2 and search.top_k(df, [1.0, 0.0], 5, above=1.0).count() == 0
    assert search.top_k(df.limit(0), [1.0, 0.0], 5).count() == 0


@pytest.mark.parametrize("query,want", [("", [1, 2, 3]), ("Alpha", [1, 2]), ("re:b[a-z]+", [2]), ("re:(", [1, 2, 3]), ("file:*.go", [1]), ("lang:GO", [1]), ("repo:y$", [3]), ("NOT alpha", [3]), ("alpha AND beta", [2]), ("beta OR gamma", [2, 3]), ("branch:main", [1, 2, 3])])
def test_text_queries(spark, query, want):
    df = spark.createDataFrame([(1, "alpha", "a.go", "x", "Go"), (2, "ALPHA beta", "b.py", "x", "Python"), (3, "gamma", "c.py", "y", None)], "id int, content string, path string, repo string, lang string")
    got = df.filter(search.compile_query(query, F.col("content"), F.col("path"), F.col("repo"), F.col("lang"))).collect()
    assert sorted(r.id for r in got) == want


def test_fusion_order_and_keys(spark):
    cols = "rank int, chunk_id string, repository string, file_path string, start_line int, end_line int, content string"
    s = spark.createDataFrame([(1, "a", "r", "f", 1, 2, "s"), (2, None, "r", "g", 1, 2, "s"), (3, "a", "r", "f", 1, 2, "s")], cols)
    t = spark.createDataFrame([(1, None, "r", "g", 3, 4, "t"), (2, "b", "r", "h", 1, 2, "t")], cols)
    got = [(r.chunk_id, r.file_path, r.source, round(r.score, 6), r.content) for r in search.fuse(s, t).orderBy("position").collect()]
    assert got == [(None, "g", "both", round(1 / 62 + 1 / 61, 6), "s"), ("a", "f", "embedding", round(1 / 61, 6), "s"), ("b", "h", "text", round(1 / 62, 6), "t")]


def test_overlaps_across_bands_equal_brute_force(spark):
    import random

    random.seed(3)
    h = [("f", k, a, a + random.randint(-30, 200)) for k in range(60) for a in [random.randint(0, 500)]]
    c = [("f", k, a, a + random.randint(0, 300)) for k in range(60) for a in [random.randint(0, 500)]]
    got = {(r.hit_id, r.id, r.overlap) for r in intervals.overlaps(spark.createDataFrame(h, "f string, hit_id int, hit_start int, hit_end int"), spark.createDataFrame(c, "f string, id int, start_line int, end_line int"), ["f"]).collect()}
    want = {(i, j, min(max(a, b), y) - max(min(a, b), x) + 1) for _, i, a, b in h for _, j, x, y in c if min(a, b) <= y and max(a, b) >= x}
    assert got == want


def test_enclosing(spark):
    m = spark.createDataFrame([("f", "m", 5, 6), ("f", "n", 50, 60)], "f string, id string, start_line int, end_line int")
    o = spark.createDataFrame([("f", "big", 1, 20), ("f", "small", 4, 8), ("f", "m", 5, 6)], "f string, owner_id string, owner_start int, owner_end int")
    assert [(r.id, r.owner_id) for r in intervals.enclosing(m, o, ["f"]).collect()] == [("m", "small")]


def test_upsert_twice_is_once(spark):
    cols = "repository_id string, file_path string, content_hash string, id string, start_line int, end_line int, token_count int, token_counted_at timestamp_ntz, language string"
    old = spark.createDataFrame([("r", "f", "h", "1", 1, 2, 7, T, "Go"), ("r", "f", "i", "2", 3, 4, None, None, None)], cols)
    new = spark.createDataFrame([("r", "f", "h", "9", 5, 6, None, None, "X"), ("r", "g", "h", "3", 1, 1, 1, T, "Go")], cols)
    a = upserts.upsert_chunks(old, new)
    want = [("1", 5, 6, 7, "Go"), ("2", 3, 4, None, None), ("3", 1, 1, 1, "Go")]
    for t in (a, upserts.upsert_chunks(a, new)):
        assert sorted(((r.id, r.start_line, r.end_line, r.token_count, r.language) for r in t.collect()), key=lambda r: r[0]) == want
    inc = new.withColumn("ord", F.monotonically_increasing_id())
    assert sorted(r.id for r in upserts.find_or_create(old, inc, "ord").collect()) == ["1", "3"]
    assert {r.outcome: r.n for r in upserts.conflict_outcomes(old, new, upserts.CHUNK_KEY, "do_nothing").collect()} == {"skipped": 1, "inserted": 1}


def test_cut_lines():
    assert chunking.cut_lines("ab\ncd", 100) == [(1, 2, "ab\ncd")]
    assert chunking.cut_lines("aa\nbb\ncc", 6) == [(1, 2, "aa\nbb\n"), (3, 3, "cc\n")]
    assert chunking.cut_lines("a" * 50 + "\nb", 10) == [(1, 1, "a" * 50 + "\n"), (2, 2, "b\n")]
    assert chunking.cut_lines("", 10) == [] and chunking.cut_lines(" \n ", 1) == []
    text = "\n".join("x" * (k % 9) for k in range(100))
    assert "".join(p[2] for p in chunking.cut_lines(text, 20)).replace("\n", "") == text.replace("\n", "")


def test_grouping():
    p = [chunking.Piece("function", str(k), k * 600, k * 600 + 500, "go") for k in range(5)] + [chunking.Piece("class", "c", 4000, 4100, "go")]
    assert [[x.name for x in g] for g in chunking.group_functions(p)] == [["0", "1", "2"], ["3", "4"], ["c"]]
    assert [[x.name for x in g] for g in chunking.pack_sizes(p[:5], 1000, overlap=500)] == [["0", "1"], ["1", "2"], ["2", "3"], ["3", "4"]]
    assert chunking.split_points(100, 60) == [(0, 100)] and chunking.split_points(200, 60)[-1][1] == 200


def test_constructs():
    py = "import os\nfrom .a import b, c\nLIMIT = 3\n_x = 1\nclass P(Protocol):\n    @deco\n    def _m(self, a=1):\n        pass\nasync def f(): pass\n"
    got = [(r[0], r[2], r[5], r[6], r[7]) for r in extract.constructs_of(py, "py")]
    assert got == [("import", "os", "public", 1, 1), ("import", ".a", "public", 2, 2), ("constant", "LIMIT", "public", 3, 3), ("variable", "_x", "private", 4, 4), ("interface", "P", "public", 5, 8), ("method", "P._m", "private", 6, 8), ("function", "f", "public", 9, 9)]
    go = 'package p\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) Get() int {\n\treturn t.A // }\n}\n\nfunc help(a int) {\n}\n'
    assert [(r[0], r[2], r[5], r[6], r[7]) for r in extract.constructs_of(go, "go")] == [("package", "p", "public", 1, 1), ("import", "fmt", "public", 4, 4), ("struct", "p.T", "public", 7, 9), ("method", "T.Get", "public", 11, 13), ("function", "p.help", "private", 15, 16)]
    js = 'import { a } from "./x";\nexport class B extends C {\n  go(x) {\n    if (x) { y(); }\n  }\n}\nconst f = async (a) => a;\n'
    assert [(r[0], r[2], r[6], r[7]) for r in extract.constructs_of(js, "js")] == [("import", "./x", 1, 1), ("class", "B", 2, 6), ("method", "B.go", 3, 5), ("function", "f", 7, 7)]
    assert extract.constructs_of("def (", "py") == [] and extract.constructs_of("x", "sql") == []


def test_errors(spark):
    e = spark.createDataFrame([(T + dt.timedelta(seconds=k), "db_down", "ERROR") for k in range(4)] + [(T, "net_down", "CRITICAL"), (T, "Bad Code", "ERROR"), (T, "x", "LOUD")], "ts timestamp_ntz, code string, severity string")
    w = errors.windows(e)
    assert {(r.code, r.n, r.severity) for r in w.collect()} == {("db_down", 4, "ERROR"), ("net_down", 1, "CRITICAL")}
    assert {(r.code, r.alert_type, r.urgency) for r in errors.alerts(w).collect()} == {("db_down", "BATCH", "NORMAL"), ("net_down", "REAL_TIME", "CRITICAL")}
    assert [(r.codes, r.key, r.severity) for r in errors.cascades(w, 60).collect()] == [(2, "db_down,net_down", "CRITICAL")]
    assert errors.cascades(w, 1).count() == 0
    d = spark.createDataFrame([("k", T + dt.timedelta(seconds=s)) for s in (0, 100, 299, 301, 400, 700)], "k string, at timestamp_ntz")
    assert sorted((r.at - T).seconds for r in errors.first_in_window(d, ["k"], "at", 300).collect()) == [0, 301, 700]


def test_ignore_lines_and_names(spark):
    paths = ["a.log", "x/a.log", "build/o.c", "src/build/o.c", "keep.log", "docs/a/b.txt", "docs/b.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p for r in df.filter(strings.is_ignored(F.col("p"), ["*.log", "!keep.log", "/build/", "docs/**/b.txt", "", "# x"])).collect()}
    assert got == {"a.log", "x/a.log", "build/o.c", "docs/a/b.txt", "docs/b.txt"}
    assert one(spark, strings.visibility(F.lit("__init__"), F.lit("Python"), F.lit("function"))) == "private"
    assert one(spark, strings.visibility(F.lit("__all__"), F.lit("python"), F.lit("variable"))) == "public"
    assert one(spark, strings.visibility(F.lit("Run"), F.lit("Go"), F.lit("function"))) == "public"
    assert [one(spark, strings.normal_url(F.lit(u))) for u in ("HTTP://GitHub.com/A/B.git/", "https://github.com/a/../b", "ftp://github.com/a/b", "https://github.com/a", "https://x.org/a/b")] == ["https://github.com/a/b", None, None, None, None]
    with pytest.raises(ValueError):
        catalog.order(catalog.CONNECTOR_ORDER, "updated_at")


def test_stats(spark):
    assert [one(spark, stats.backoff(F.lit(a), 1, 2, 5)) for a in (1, 2, 3, 4)] == [1.0, 2.0, 4.0, 5.0]
    df = spark.createDataFrame([(k,) for k in range(10)], "k int")
    assert [r.k for r in stats.sample_prefix(df, ["k"], 5).collect()] == [0] and stats.sample_prefix(df, ["k"], 30).count() == 3
    assert stats.sample_prefix(df.limit(0), ["k"], 30).count() == 0
    assert stats.failure_rates(df.limit(0), F.lit(True)).first().retryable_share == 0.0


def test_grouping_strategies(spark):
    from lodestrata.operators.chunking import Piece, group_classes, group_hybrid, groups_of, suited_strategy

    def p(kind, name, start, end):
        return Piece(kind, name, start, end, "go")

    cls = [p("class", "A", 0, 1000), p("method", "m1", 10, 300), p("method", "m2", 310, 900), p("function", "f", 1100, 1300), p("function", "g", 1310, 1400), p("struct", "B", 1500, 1600)]
    names = lambda groups: [[x.name for x in g] for g in groups]
    assert names(group_classes(cls)) == [["A", "m1", "m2"], ["f", "g"], ["B"]]
    assert names(group_classes(cls, limit=600)) == [["A", "m1"], ["m2"], ["f", "g"], ["B"]]
    assert names(group_hybrid([p("function", "a", 0, 900), p("function", "b", 900, 1800), p("function", "c", 1800, 1850)], 1000)) == [["a"], ["b", "c"]]
    assert suited_strategy([p("class", "A", 0, 10)]) == "class" and suited_strategy([p("function", "a", 0, 10)]) == "function" and suited_strategy([p("other", "a", 0, 5000)]) == "size" and suited_strategy([]) == "hybrid"
    assert names(groups_of(cls, "adaptive")) == names(groups_of(cls, "function"))
    df = spark.createDataFrame([("r", x.kind, x.name, x.start, x.end, x.language) for x in cls] + [("s", "function", "z", 0, 5, "go")], "repo string, kind string, name string, start_byte int, end_byte int, language string")
    got = {(r.repo, r.name): r.group_no for r in chunking.grouped(df, ["repo"], "class").collect()}
    assert got == {("r", "A"): 1, ("r", "m1"): 1, ("r", "m2"): 1, ("r", "f"): 2, ("r", "g"): 2, ("r", "B"): 3, ("s", "z"): 1}
    assert chunking.grouped(df.limit(0), ["repo"], "hybrid").count() == 0


def test_windows_begin_with_their_first_event(spark):
    at = [0, 10, 299, 300, 301, 302, 700, 1003]
    df = spark.createDataFrame([(k, "a" if k % 3 else None, T + dt.timedelta(seconds=s)) for s in at for k in (1, 3)], "k int, code string, ts timestamp_ntz")
    kept = errors.first_in_window(df, ["code"], "ts", 300).orderBy("code", "ts").collect()
    assert [(r.code, (r.ts - T).seconds) for r in kept] == [(c, s) for c in (None, "a") for s in (0, 301, 700, 1003)]
    w = errors.duplicates_in_window(df.filter("code = 'a'"), ["code"], "ts", 300, 3).orderBy("first_at").collect()
    assert [(r.n, r.suppressed) for r in w] == [(4, True), (2, False), (1, False), (1, False)]
    assert errors.first_in_window(df.limit(0), ["code"], "ts", 300).count() == 0


def test_cycles_of_any_length(spark):
    from lodestrata.operators import graphs

    n = 40
    edges = [("r", f"n{k}", f"n{(k + 1) % n}") for k in range(n)] + [("r", "n0", "leaf"), ("r", "root", "n0"), ("r", "self", "self"), ("s", "a", "b"), ("s", "b", "c")]
    got = graphs.on_cycles(spark.createDataFrame(edges, "repo string, caller string, callee string"), ["repo"])
    assert {(r.repo, r.name) for r in got.collect()} == {("r", f"n{k}") for k in range(n)} | {("r", "self")}
    assert graphs.cycle_members([]) == [] and len(graphs.cycle_members([(str(k), str((k + 1) % 50_000)) for k in range(50_000)])) == 50_000


def test_values_of_small_functions(spark):
    from lodestrata.functions import code
    from lodestrata.functions.vectors import euclidean

    r = spark.range(1).select(
        code.is_binary_stream(F.encode(F.lit("a\tb\n" * 3), "UTF-8")).alias("tabs"), code.is_binary_stream(F.encode(F.lit("plain text"), "UTF-8")).alias("plain"), code.is_binary_stream(F.encode(F.lit(""), "UTF-8")).alias("none"), code.is_binary_stream(F.unhex(F.lit("FFD8FF"))).alias("three"),
        euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("five"), euclidean(F.array(F.lit(0.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("unequal"), chunking.validation_score(F.array(F.lit("high")), F.lit(False)).alias("invalid"), chunking.validation_score(F.array(F.lit("high"), F.lit("low"))).alias("issues"),
        chunking.complexity_score(F.lit(1.0), F.lit(0), F.lit(9000), F.lit(0)).alias("nothing"), chunking.overlap_context([F.lit("aaa"), F.lit(None), F.lit("bbbbbb"), F.lit("cc")], 6).alias("fits"), stats.priority_rank(F.lit(" low ")).alias("low"), code.name_candidates(F.lit("h/o/r/x")).alias("names"), code.doc_details(F.lit("Sum.\n\n more\n@x y\nend")).alias("details"),
    ).first()
    assert (r.tabs, r.plain, r.none, r.three, r.five, r.unequal, r.invalid, round(r.issues, 6), r.nothing, r.fits, r.low, r.names, r.details) == (True, False, False, True, 5.0, None, 0.0, 0.6, 0.0, "aaa\ncc", 2, ["h/o/r/x", "o/r/x"], "more\nend")
    with pytest.raises(ValueError):
        search.page(spark.range(3), [F.col("id")], 0)


GO_SOURCE = """package shop

import (
\t"fmt"
)

const (
\tLimit = 10
\tlow, High = 1, 2
)

var (
\tshared int
)

type Item struct {
\tName string
}

func (i *Item) Show() string {
\treturn fmt.Sprint(i.Name)
}
"""
TS_SOURCE = """export enum Kind { A, B }
type Pair<T> = [T, T];
export const LIMIT = 5;
const double = (x: number) => x * 2;
const Base = class extends Root {
  run(): void {
  }
};
exports.handler = async function (event) {
};
export { a, b } from "./c";
"""


def test_constructs_become_chunks(spark):
    from lodestrata.operators import extract

    df = spark.createDataFrame([("1", GO_SOURCE, "a.go"), ("2", TS_SOURCE, "b.ts"), ("3", "def f(:\n", "c.py"), ("4", None, "d.py"), ("5", " \n", "e.go"), ("6", "class A:\n    def m(self):\n        pass\n", "f.py")], "id string, content string, file_path string")
    got = {}
    for r in extract.chunk_rows(df).orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append((r.chunk_type, r.entity_name, r.start_line, r.end_line, r.visibility))
    assert got["1"] == [("constant", "Limit", 8, 8, "public"), ("constant", "High", 9, 9, "public"), ("constant", "low", 9, 9, "private"), ("variable", "shared", 13, 13, "private"), ("struct", "Item", 16, 18, "public"), ("method", "Show", 20, 22, "public")]
    assert {(k, n) for k, n, *_ in got["2"]} >= {("enum", "Kind"), ("type", "Pair"), ("constant", "LIMIT"), ("function", "double"), ("class", "Base"), ("method", "run"), ("function", "handler")}
    assert got["3"] == [("fragment", None, 1, 2, None)] and set(got) == {"1", "2", "3", "6"} and [x[:2] for x in got["6"]] == [("class", "A"), ("method", "m")]
    exported = [r.name for r in extract.constructs(df.filter("id = '2'")).filter("kind = 'export'").collect()]
    assert exported == ["./c"]


def test_no_file_vanishes_unseen(spark, tmp_path):
    from lodestrata.sources.files import skipped_files, source_files

    (tmp_path / "vendor").mkdir()
    for name, data in (("a.go", b"package a\n"), ("big.py", b"x = 1\n" * 300), ("b.bin", b"\x00\x01"), ("vendor/c.go", b"package c\n")):
        (tmp_path / name).write_bytes(data)
    assert [r.path for r in source_files(spark, str(tmp_path), max_bytes=1000).collect()] == ["a.go"]
    assert {(r.path, r.reason) for r in skipped_files(spark, str(tmp_path), max_bytes=1000).collect()} == {("big.py", "size"), ("b.bin", "binary"), ("vendor/c.go", "folder")}


def test_unknown_names_can_be_errors(spark):
    r = spark.createDataFrame([("1", "o/alpha", T)], "id string, name string, created_at timestamp_ntz")
    asked = spark.createDataFrame([("Alpha",), ("beta",)], "asked string")
    assert [x.id for x in catalog.resolve_names(asked, r).collect()] == ["1"]
    with pytest.raises(ValueError, match="beta"):
        catalog.resolve_names(asked, r, strict=True)


def test_similarity_groups_equal_the_greedy_ones(spark):
    import itertools
    import random

    rng = random.Random(5)
    codes = sorted({"_".join(rng.sample(["git", "disk", "net", "auth", "parse", "token", "queue", "vector"], rng.randint(1, 3))) for _ in range(60)})
    df = spark.createDataFrame([(c,) for c in codes + codes[:5] + [None]], "code string")
    pairs = {(r.a, r.b): r.similarity for r in errors.similar_pairs(df, 0.0).collect()}
    want = errors.greedy_groups(codes, lambda a, b: pairs.get((min(a, b), max(a, b)), 0.0), 0.5)
    got = {}
    for r in errors.similarity_groups(df, 0.5).collect():
        got.setdefault(r.group, set()).add(r.code)
    assert got == {g[0]: set(g) for g in want} and len(got) < len(codes) and len(list(itertools.chain(*got.values()))) == len(codes)
    assert errors.similarity_groups(df.limit(0), 0.5).count() == 0


def test_large_pieces_are_split():
    from lodestrata.operators.chunking import Piece, groups_of, large_function_parts

    ps = [Piece("function", "f", 0, 1000, "go"), Piece("interface", "i", 1000, 3000, "go"), Piece("function", "g", 3000, 3010, "go")]
    assert [[(p.name, p.start, p.end) for p in g] for g in groups_of(ps, "size", 400)] == [[("f", 0, 300)], [("f", 300, 600)], [("f", 600, 900), ("f", 900, 1000)], [("i", 1000, 3000), ("g", 3000, 3010)]]
    text = "func f() {\n" + "\tx()\n" * 3000 + "}"
    parts = large_function_parts(text)
    assert len(parts) > 2 and parts[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:])) and large_function_parts("f()\n") == [(1, 2, "f()\n")]
