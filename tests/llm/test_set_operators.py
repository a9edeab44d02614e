"""Ranking, copies, near copies, neighbours and mixing against brute force."""

import datetime as dt
import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import copies, mixing, near_copies, neighbours, ranking


def test_net_flow_equals_pairwise_comparison(spark):
    rng = random.Random(2)
    data = []
    for q in range(5):
        for c in range(12 if q else 300):
            for e in ("a", "B ", "c"):
                if rng.random() < 0.8:
                    data.append((q, f"{c:03}", e if rng.random() < 0.5 else e.lower().strip(), rng.choice([None, math.nan, 0.0, -0.0, *(round(rng.gauss(0, 10 ** (ord(e[0]) % 5)), 1) for _ in range(3))]), "x"))
    data += data[:20] + [(None, "1", "a", 1.0, ""), (9, None, "a", 1.0, ""), (8, "1", None, 1.0, ""), (7, "1", "a", 1.0, "")]
    df = spark.createDataFrame(data, "query_id int, chunk_id string, source_engine string, similarity double, q string")
    best = {}
    for q, c, e, s, _ in data:
        if q is not None and c is not None:
            best.setdefault(q, {}).setdefault(c, {})
            if e is not None and s is not None and not math.isnan(s):
                e = e.strip().lower()
                best[q][c][e] = max(s, best[q][c].get(e, -math.inf))
    want = {}
    for q, cs in best.items():
        engines = {e for v in cs.values() for e in v}
        for c in cs:
            f = sum(np.sign(cs[c].get(e, -math.inf) - cs[o].get(e, -math.inf)) if cs[c].get(e, -math.inf) != cs[o].get(e, -math.inf) else 0 for e in engines for o in cs)
            want[q, c] = f / ((len(cs) - 1) * len(engines)) if len(cs) > 1 and engines else 0.0
    flows = ranking.net_flow(df)
    got = {(r.query_id, r.chunk_id): r.net_flow for r in flows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for q in best:
        top = [r.chunk_id for r in ranking.leaders(flows).filter(F.col("query_id") == q).orderBy("rank").collect()]
        assert top == sorted(best[q], key=lambda c: (-round(want[q, c], 12), c))[:5]
    assert ranking.net_flow(df.limit(0)).count() == 0
    heavy = {(r.query_id, r.chunk_id): r.net_flow for r in ranking.net_flow(df, {"A": 0, "b": 0}).collect()}
    assert heavy != got
    for q0, p0 in ((0.0, 0.3), (0.1, 0.5), (0.0, 2.0)):
        got = {(r.query_id, r.chunk_id): r.net_flow for r in ranking.net_flow(df, preference=(q0, p0)).collect()}
        assert got.keys() == want.keys()
        for (q, c), flow in got.items():
            cs, f = best[q], 0.0
            engines = {e for v in cs.values() for e in v}
            for e in engines:
                have = [v[e] for v in cs.values() if e in v]
                pct = lambda x: (2 * sum(y < x for y in have) + sum(y == x for y in have) - 1) / max(1, 2 * (len(have) - 1))
                for o in cs:
                    if o != c and (e in cs[c]) != (e in cs[o]):
                        f += 1 if e in cs[c] else -1
                    elif o != c and e in cs[c]:
                        d = pct(cs[c][e]) - pct(cs[o][e])
                        f += math.copysign(min(1.0, max(0.0, (abs(d) - q0) / (p0 - q0))), d)
            assert abs(flow - (f / ((len(cs) - 1) * len(engines)) if len(cs) > 1 and engines else 0.0)) < 1e-9
    with pytest.raises(ValueError):
        ranking.net_flow(df, preference=(0.2, 0.2))


CHUNKS = "id string, content string, file_path string, language string, copy_key string, n int"


def test_copies(spark):
    data = [
        ("1", "if (a) { b(); }", "x.js", "JavaScript"), ("2", "IF (a)\n{\n\tb()\n}", "y.js", None), ("3", "b(); if (a) {}", "x.js", "js"), ("4", '{"a": 1, "b": {"c": [1, 2], "d": "x y"}}', "c.json", "JSON"), ("5", '{"b": {"d": "X-Y", "c": [1,2]}, "a": 1}', "d.json", "JSON"),
        ("6", '{"a": 1, "b": {"c": [2, 1], "d": "x y"}}', "c.json", "JSON"), ("7", "a: 1\nb:\n  c: [1, 2]\n  d: z\n", "e.yaml", "YAML"), ("8", "b:\n    d: z\n    c: [1,2]\na: 1\n", "f.yml", None), ("9", "b:\n  - x: 1\n    y: 2\n  - z\n", "g.yml", None), ("a", "b:\n- y: 2\n  x: 1\n- z\n", "g.yml", None),
        ("b", "b:\n- z\n- y: 2\n  x: 1\n", "g.yml", None), ("c", None, "x.js", None), ("d", "", "x.js", None), ("e", "--", "z.js", None), ("f", '{"a": 1', "h.json", "JSON"), (None, "if (a) { b(); }", "x.js", None), ("1", "if (a) { b(); }", "x.js", "JavaScript"), ("g", "w " * 100_000, "l.md", None), ("h", "W" * 100_000, "l.md", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], CHUNKS)
    want = {("1", "2"), ("4", "5"), ("7", "8"), ("9", "a"), ("d", "e"), ("g", "h")}
    for hot in (10_000, 2, None):
        got = copies.copies(df, hot_rows=hot)
        assert got.columns == ["keep_id", "chunk_id"]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    for hot in (10_000, 2, None):
        counts = {r.keep_id: r.copies for r in copies.copy_counts(df, hot_rows=hot).collect()}
        assert counts["1"] == 2 and counts["3"] == 1 and sum(counts.values()) == 16
    assert copies.copies(df.limit(0)).count() == 0


def test_marks_count_in_every_format(spark):
    pairs = [("a.json", '{"k": "\u0915\u093f"}', '{"k": "\u0915\u0940"}'), ("a.yaml", "y: \u0915\u093f", "y: \u0915\u0940"), ("a.go", "\u0915\u093f", "\u0915\u0940")]
    df = spark.createDataFrame([(f"{p}{n}", t, p, None, "c", 1) for p, a, b in pairs for n, t in enumerate((a, b, a + " "))], CHUNKS)
    assert sorted(map(tuple, copies.copies(df).collect())) == [(f"{p}0", f"{p}2") for p in ("a.go", "a.json", "a.yaml")]


def test_hot_copies_are_whole(spark):
    df = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.when(F.col("id") % 3 == 0, "same TEXT").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("content"), F.lit("a.md").alias("file_path"), F.lit("").alias("language"))
    assert {tuple(r) for r in copies.copy_counts(df).filter("copies > 1").collect()} == {("00000", 1000)}
    got = copies.copies(df)
    assert got.count() == 999 and got.select("keep_id").distinct().collect()[0][0] == "00000"


def jaccard_pairs(data, n, least, t):
    import re

    sets, keys = {}, {}
    for i, text, path, *_ in data:
        if text is None or i is None:
            continue
        w = re.findall(r"\w+", text.lower())
        if len(w) >= max(least, n):
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            keys[i] = re.sub(r"[\W_]+", "", text.lower())
    return {(a, b) for a in sets for b in sets if a < b and keys[a] != keys[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("wide", [400, 3])
def test_near_copies_equal_brute_force(spark, wide):
    rng = random.Random(7)
    data = []
    for f in range(25):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(15, 60))]
        for m in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(1000)}"
            data.append((f"{f:02}{m}", " ".join(v), "a.go", "Go"))
    data += [("x1", data[0][1].upper(), "a.go", "Go"), ("x2", data[0][1].replace(" ", ",\n"), "b.go", "Go"), ("n1", None, "a.go", ""), ("n2", "", "a.go", ""), (None, data[0][1], "a.go", ""), ("l1", " ".join(f"q{k}" for k in range(30_000)), "a.go", ""), ("l2", " ".join(f"q{k}" for k in range(29_900)), "a.go", ""), data[3]]
    df = spark.createDataFrame([(*r, "c", 1) for r in data], CHUNKS)
    op = near_copies.NearCopies(0.6, 3, 20, wide=wide)
    got = {(r.chunk_id_a, r.chunk_id_b) for r in op.pairs(df).collect()}
    want = jaccard_pairs(data, 3, 20, 0.6)
    assert len(want) > 20 and ("l1", "l2") in want and got <= want and len(want - got) <= 0.02 * len(want)
    assert op.pairs(df.limit(0)).count() == 0
    nodes, _ = op.nodes(df)
    assert [n for n, _, _ in op.steps] == list(range(6, 6 - len(op.steps), -1)) and op.steps[-1][2] >= 0.98
    links = {frozenset((r.a, r.b)) for r in op.exact_candidates(nodes).collect()}
    ids = {r.node_key: r.nid for r in nodes.select("nid", "node_key").collect()}
    assert {frozenset((ids[r.na], ids[r.nb])) for r in op.node_links(nodes).select("na", "nb").collect()} <= links


def test_runs_across_batches():
    import itertools

    import pyarrow as pa

    rng = random.Random(6)
    for wide in (1, 3, 50):
        data = sorted((rng.randrange(12), rng.randrange(5), n) for n in range(90))
        cuts = sorted([0, 90, *(rng.randrange(90) for _ in range(12))])
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in data[a:b]], pa.int64()) for c in range(3)], names=["head", "rest", "nid"]) for a, b in itertools.pairwise(cuts)]
        got = {False: [], True: []}
        for b in near_copies._runs(wide)(iter(batches)):
            for crowd, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[crowd].append([(x["rest"], x["nid"]) for x in run])
        runs = [[r[1:] for r in g] for _, g in itertools.groupby(data, key=lambda r: r[0])]
        assert sorted(got[False]) == sorted(r for r in runs if 2 <= len(r) <= wide)
        assert sorted(x for r in got[True] for x in r) == sorted(x for r in runs if len(r) > wide for x in r)


def test_near_copies_stop_shortening(spark):
    """Pairs that are all but equal are found at whole labels; none at all only after the shortest prefix."""
    w = [[f"w{f}_{k}" for k in range(400)] for f in range(30)]
    data = [(f"{f:02}{m}", " ".join([*x[: 399 - m], "e"]), "a.go", "Go", "c", 1) for f, x in enumerate(w) for m in range(2)]
    op = near_copies.NearCopies(0.6, 3, 20)
    assert op.pairs(spark.createDataFrame(data, CHUNKS)).count() == 30 and op.steps == [(6, 30, pytest.approx(1))]
    assert op.pairs(spark.createDataFrame(data[::2], CHUNKS)).count() == 0 and [s[0] for s in op.steps] == [6, 5, 4, 3]


def test_near_copy_groups(spark):
    base = [f"w{k}" for k in range(60)]
    chain = [" ".join([*(f"x{k}" for k in range(n)), *base[n:]]) for n in (0, 8, 16, 24)]  # each near the next only
    data = [(f"c{n}", t, "a.go", "Go", "c", 1) for n, t in enumerate(chain)] + [("b9", chain[2].upper(), "a.go", "Go", "c", 1), ("z", " ".join(f"q{k}" for k in range(50)), "a.go", "Go", "c", 1), ("s", "short", "a.go", "Go", "c", 1)]
    df = spark.createDataFrame(data, CHUNKS)
    op = near_copies.NearCopies(0.6, 3, 20)
    got = {r.id: (r.keep_id, r.group_id, r.links) for r in op.groups(df).collect()}
    assert got == {"c0": ("c0", "b9", 1), "c1": ("c1", "b9", 2), "c2": ("b9", "b9", 2), "b9": ("b9", "b9", 2), "c3": ("c3", "b9", 1), "z": ("z", "z", 0)}
    links, members = op.links(df)
    assert {(r.keep_id_a, r.keep_id_b) for r in links.collect()} == {("c0", "c1"), ("b9", "c1"), ("b9", "c3")} and members.count() == 6
    assert op.groups(df.limit(0)).count() == 0
    edges = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(100)] + [("a", "b"), ("b", "a"), ("c", "c")], "a string, b string")
    roots = {r.node: r.root for r in near_copies.components(edges).collect()}
    assert len(roots) == 103 and set(roots.values()) == {"000", "a"} and roots["b"] == "a"


def test_forest_depth():
    assert near_copies.forest_depth(0.6, 24, 6, 0.995) == 3 and near_copies.forest_depth(0.9, 24, 6, 0.99) == 6 and near_copies.forest_depth(0.1, 4, 6, 0.99) == 1


@pytest.mark.parametrize("top", [20_000, 6])
def test_neighbours(spark, monkeypatch, top):
    """Also with few leaves, which are divided into cells."""
    monkeypatch.setattr(neighbours, "TOP_LEAVES", top)
    monkeypatch.setattr(neighbours, "SPLIT", 4 if top > 6 else 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    T = dt.datetime(2024, 1, 1)
    data = []
    for k in range(900):
        data.append((f"{k:04}", (centres[k % 12] + 0.3 * rng.normal(size=64)).tolist(), "m1" if k % 5 else "m2", T, None, 1))
    same = centres[0].tolist()
    data += [(f"s{k:03}", [3 * x for x in same], "m1", T, None, 1) for k in range(40)]
    bad = [("b1", None, "m1", T, None, 1), ("b2", [0.0] * 64, "m1", T, None, 1), ("b3", [math.nan] * 64, "m1", T, None, 1), ("b4", [1.0] * 63, "m1", T, None, 1), ("b5", same, "m1", T, T, 1), (None, same, "m1", T, None, 1), ("b6", [math.inf] + [1.0] * 63, "m1", T, None, 1), ("b7", [None] + [1.0] * 63, "m1", T, None, 1)]
    twice = [(data[5][0], data[6][1], "m1", T - dt.timedelta(1), None, 1), data[7]]
    one = [("z1", same, "m3", T, None, 1), ("z2", same, "m3", None, None, 1)]
    df = spark.createDataFrame(data + bad + twice + one, "id string, embedding array<double>, model_version string, created_at timestamp_ntz, deleted_at timestamp_ntz, vec int")
    op = neighbours.Neighbours(leaf=60 if top > 6 else 25, block=50)
    got = {}
    for r in op.neighbours(df).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour_id))
    assert {k for k in got if k[0] == "b"} == set() and [n for _, n in got["z1"]] == ["z2"]
    hit = tot = 0
    for m in ("m1", "m2"):
        part = sorted((d[0], d[1]) for d in data if d[2] == m)
        x = np.array([v for _, v in part])
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        s = (x.astype(np.float64) @ x.T.astype(np.float64)).round(6)
        np.fill_diagonal(s, -9)
        for k, (i, _) in enumerate(part):
            want = [part[j][0] for j in np.argsort(-s[k], kind="stable")[:5]]
            assert len(got[i]) == 5
            hit += len({n for _, n in got[i]} & set(want))
            tot += 5
            if i == "s039":
                assert [n for _, n in sorted(got[i])] == ["s000", "s001", "s002", "s003", "s004"]
    assert hit / tot >= 0.95 and all(v >= 0.9 for v in op.measured.values()) and (top > 6 or max(op.cells[m] for m in ("m1", "m2")) >= 1)
    assert neighbours.Neighbours().neighbours(df.limit(0)).count() == 0


def test_neighbours_disk(spark, monkeypatch):
    """Copies of the vectors that are on disk at one time don't follow the number of blocks a vector asks."""
    monkeypatch.setattr(neighbours, "LEAST_ROUND", 1, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(f"{k:04}", v.tolist(), "m", None, None) for k, v in enumerate(x)], "id string, embedding array<float>, model_version string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tables = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    shuffled = lambda: sum(p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data"))
    at, moved, most, write = tables(), shuffled(), [], neighbours.stage

    def stage(df, label):
        out = write(df, label)
        most.append(tables() - at)
        return out

    monkeypatch.setattr(neighbours, "stage", stage)
    op = neighbours.Neighbours(leaf=100)
    result = op.neighbours(df)
    assert max(most) < 3 * x.nbytes
    for _ in range(50):  # they are removed in the background
        if shuffled() - moved < x.nbytes:
            break
        time.sleep(0.2)
    assert shuffled() - moved < x.nbytes
    got = {}
    for r in result.collect():
        got.setdefault(r.id, set()).add(int(r.neighbour_id))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, 1)[:, :5]
    assert len(got) == 4000 and all(len(v) == 5 for v in got.values())
    assert sum(len(got[f"{k:04}"] & set(w.tolist())) for k, w in enumerate(want)) >= 0.97 * want.size
    assert op.rounds > 3 and op.blocks["m"] > 10


@pytest.mark.parametrize("broadcast", [1 << 24, -1])
def test_neighbours_few_in_own_block(spark, monkeypatch, broadcast):
    """A vector whose own block holds fewer than k others still gets k, of other leaves; cells held by every task or joined."""
    monkeypatch.setattr(neighbours, "BROADCAST", broadcast, raising=False)
    monkeypatch.setattr(neighbours, "SPLIT", 1)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1, 64)) * 0.1 + c for c in rng.normal(size=(40, 64))])
    df = spark.createDataFrame([(f"{k:02}", v.tolist(), "m", None, None) for k, v in enumerate(x)], "id string, embedding array<double>, model_version string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    got = {}
    for r in neighbours.Neighbours(leaf=4).neighbours(df).collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    assert len(got) == 40 and all(len(v) == 5 and k not in v for k, v in got.items())


def test_pfair_deviation():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {str(k): 1 / (k + 1) for k in range(15)}, {"x": 1.0}, {"x": 1.0, "y": 0.0}):
        order = mixing.pfair_schedule(weights, 3000)
        total = sum(weights.values())
        seen = dict.fromkeys(weights, 0)
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[k] - w / total * t) < 1 for k, w in weights.items())
    assert mixing.pfair_schedule({}, 10) == []


def test_mixing(spark):
    docs = [(k, "word " * (20 + k % 7), " Big " if k % 3 else "BIG", 1) for k in range(200)] + [(1000 + k, "word " * 30, "small", 1) for k in range(10)] + [(2000, None, "small", 1), (2001, "", "small", 1), (2002, "x", None, 1), (2003, "x", " ", 1), (2004, "y " * 200_000, "tiny", 1)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    tdf = spark.createDataFrame([("big", 0.5, 2), ("small", 0.2, 3), ("gone", 0.1, 9), ("tiny", 0.2, None)], "source string, target_share double, max_repeats int")
    r = {x.source: x for x in mixing.shares(mixing.sized(ddf), tdf).collect()}
    assert {s for s, x in r.items() if x.short} == {"big", "small", "gone", "tiny"} and r["gone"].tokens == 0 and r["tiny"].repeats == 0
    d2 = ddf.filter("doc_id < 2000")
    r = {x.source: x for x in mixing.shares(mixing.sized(d2), tdf).collect()}
    assert not r["big"].short and abs(r["big"].used_tokens - r["big"].target_tokens) < 1 and r["small"].short and r["small"].repeats == 3
    assert mixing.mix(d2.limit(0), tdf).count() == 0 and mixing.shares(mixing.sized(d2.limit(0)), tdf).filter("reached > 0").count() == 0


@pytest.mark.parametrize("round_slots", [10**6, 10])
def test_mix_is_whole_and_within_a_block(spark, monkeypatch, round_slots):
    """Whatever the number of rounds (a source of fewer tokens than rounds leaves slots empty): every token of every use once, in order, and after any slot each source within one block of its share."""
    monkeypatch.setattr(mixing, "ROUND_SLOTS", round_slots)
    rng = random.Random(4)
    docs = [(k, "word " * rng.choice([1, 7, 30, 400]), rng.choice("aaab"), 1) for k in range(120)] + [(1000, "word " * 5000, "long", 1), (1001, "word", "speck", 1)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string, source string, slot int")
    tdf = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 9), ("long", 0.2, 1), ("speck", 0.0001 * (round_slots > 10), 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    block = 64
    r = {x.source: x for x in mixing.mixed_shares(ddf, tdf, block_tokens=block).collect()}
    m = sorted(mixing.mix(ddf, tdf, block_tokens=block).collect(), key=lambda x: (x.slot, x["pass"], x.doc_id, x.first_token))
    held, at, sizes = dict.fromkeys(r, 0), {}, {x.doc_id: x for x in mixing.sized(ddf).collect()}
    for x in m:
        held[x.source] += x.tokens
        key = x["pass"], x.doc_id
        assert x.tokens > 0 and x.first_token == at.get((x.source, key), 0) and sizes[x.doc_id].source == x.source
        at[x.source, key] = x.first_token + x.tokens
    assert {s: x.mixed_tokens for s, x in r.items()} == held and all(held[s] == x.used_tokens for s, x in r.items())
    assert abs(sum(x.mixed_share for x in r.values()) - 1) < 1e-12
    for s in held:  # all uses but the last one are whole
        uses = sorted(k for src, k in at if src == s)
        assert all(at[s, k] == sizes[k[1]].tokens for k in uses[:-1])
    by_slot = {}
    for x in m:
        by_slot.setdefault(x.slot, []).append(x)
    assert sorted(by_slot) == list(range(max(by_slot) + 1)) and all(len({x.source for x in v}) == 1 for v in by_slot.values())
    assert max(sum(x.tokens for x in v) for v in by_slot.values()) <= block
    blocks = {s: sum(v[0].source == s for v in by_slot.values()) for s in held if held[s]}
    done = dict.fromkeys(blocks, 0)
    for t in range(len(by_slot)):
        done[by_slot[t][0].source] += 1
        assert all(abs(done[s] - n / len(by_slot) * (t + 1)) < 1 for s, n in blocks.items())
    assert {s for s, x in r.items() if x.short} == {s for s, x in r.items() if x.tokens * x.max_repeats < x.target_tokens}
