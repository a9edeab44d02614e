"""Near-duplicate records with small edits: MinHash LSH forest, then exact verification.

Every distinct text is a node: its set of shingles (consecutive words) as 64-bit hashes, and in each of ``trees`` prefix tries a label of ``depth``
MinHash values. A trie is stored sorted, as runs: nodes that share their first ``k`` values stand together in order of the others. The search starts at
whole labels and shortens them value by value. At each step the pairs whose longest common prefix in some trie has just that length, and that no
longer one gave, are verified on the whole shingle sets. From the similarities of the pairs found, each of which a step finds with a known probability, follows
how many there are in all and so the recall; shortening ends when it reaches the target, at the latest at ``k`` values, where even pairs that all just meet the
threshold are found at the rate ``least``.

A run of more than ``wide`` nodes would emit too many unrelated pairs. Its nodes are joined by an exact way
instead: two sets of similarity t share one of the |x| - ceil(t |x|) + 1 rarest shingles of each (rarity counted over
all of these nodes). Candidates are verified on the whole shingle sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..session import discard, parallelism, spread, stage, stage_bucketed
from .copies import canonical_keys

_WORD = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all runs of n words, index of their text, number of words of each text)."""
    import xxhash

    ids: dict[str, int] = {}
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    put = ids.setdefault
    for k, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        counts[k] = len(words)
        flat.extend([put(w, len(ids)) for w in words])
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
    h = table[np.asarray(flat, np.int64)] if flat else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    run = np.zeros(m, np.uint64)
    for k in range(n):
        run = _mix(run * _M2 + h[k : k + m] + _M1)
    inside = owner[:m] == owner[n - 1 :]
    return run[inside], owner[:m][inside], counts


def shingle_sets(texts: list[str], n: int, least_words: int) -> list[np.ndarray | None]:
    """Sorted distinct shingle hashes of each text; None for one with fewer than least_words words."""
    run, owner, counts = word_shingles(texts, n)
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    run, owner = run[first], owner[first]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [run[ends[k] : ends[k + 1]] if counts[k] >= max(least_words, n) else None for k in range(len(texts))]


def signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    """MinHash values, one row per set: the minimum of ``width`` independent hash functions over the set."""
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, width, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), width), np.uint32)
    for k in range(width):
        v = flat * a[k] + b[k]
        out[:, k] = np.minimum.reduceat((v ^ (v >> np.uint64(29))) * _M2 >> np.uint64(32), starts)
    return out


def forest_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix at which pairs of the threshold's similarity are found with the target probability."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= target:
            return k
    return 1


def _nodes(n: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, texts, keys = (b.column(k).to_pylist() for k in range(3))
            sets = shingle_sets([t or "" for t in texts], n, least_words)
            kept = [k for k, s in enumerate(sets) if s is not None]
            raw = [sets[k].tobytes() for k in kept]
            digest = [xxhash.xxh3_128_digest(r + (keys[k] or b"")) for r, k in zip(raw, kept)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in kept], pa.string()), pa.array([keys[k] for k in kept], pa.binary()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["id", "copy_key", "node_key", "shingles"])

    return run


def _labels(trees: int, k: int, depth: int):
    """Rows (head, rest, nid): a hash of the trie and the first k values, and the other values in the bits of a number, first one highest."""
    bits = 63 // max(1, depth - k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mix(np.arange(1, trees + 1, dtype=np.uint64) * _M3)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                nid = part.column(0).to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                if not sets:
                    continue
                sig = signatures(sets, trees * depth).reshape(len(sets), trees, depth).astype(np.uint64)
                head = np.broadcast_to(salt, (len(sets), trees))
                for j in range(k):
                    head = _mix(head * _M2 + sig[:, :, j] + _M1)
                rest = np.zeros((len(sets), trees), np.uint64)
                for j in range(k, depth):
                    rest = rest << np.uint64(bits) | (_mix(sig[:, :, j]) >> np.uint64(64 - bits))
                yield pa.RecordBatch.from_arrays([pa.array(head.reshape(-1).view(np.int64)), pa.array(rest.reshape(-1).view(np.int64)), pa.array(np.repeat(nid, trees))], names=["head", "rest", "nid"])

    return run


def _runs(wide: int):
    """From (head, rest, nid) in order: rows (crowd, run) of the nodes under one head, two to ``wide`` of them, or pieces of a wider one as
    crowd. A run that batches share is held back; a wide one leaves at once."""

    def rows(crowd: bool, rest: np.ndarray, nid: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        pairs = pa.StructArray.from_arrays([pa.array(rest), pa.array(nid)], ["rest", "nid"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array([crowd] * len(lengths), pa.bool_()), lists], names=["crowd", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held, held_rest, held_nid, crowded = None, none, none, False
        for b in _and_end(batches):
            if b is None:
                head, rest, nid = none, held_rest, held_nid
                lengths = np.array([len(rest)]) if len(rest) else none
                wider = np.zeros(len(lengths), bool)
            else:
                head, rest, nid = (b.column(c).to_numpy() for c in range(3))
                if not len(head):
                    continue
                first_is_held = held is not None and head[0] == held
                if held is not None:
                    head, rest, nid = np.concatenate((np.full(len(held_rest), held), head)), np.concatenate((held_rest, rest)), np.concatenate((held_nid, nid))
                starts = np.concatenate(([0], np.flatnonzero(np.diff(head)) + 1))
                lengths = np.diff(np.concatenate((starts, [len(head)])))
                wider = lengths > wide
                wider[0] |= crowded and first_is_held
                held, last = head[-1], lengths[-1]
                if wider[-1]:
                    held_rest, held_nid, crowded, last = none, none, True, 0
                else:
                    held_rest, held_nid, crowded = rest[len(rest) - last :], nid[len(nid) - last :], False
                    lengths, wider = lengths[:-1], wider[:-1]
                rest, nid = rest[: len(rest) - last], nid[: len(nid) - last]
            for crowd, keep in ((False, (lengths > 1) & ~wider), (True, wider)):
                if keep.any():
                    each = np.repeat(keep, lengths)
                    yield rows(crowd, rest[each], nid[each], lengths[keep])

    return run


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def run_pairs(lengths: np.ndarray, rest: np.ndarray, shift: int, deeper: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within runs whose rests agree above ``shift`` bits and not above ``deeper`` (None: any)."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    after = ends - np.arange(len(rest)) - 1
    i = np.repeat(np.arange(len(rest)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    x = rest[i] ^ rest[j]
    keep = x >> np.uint64(shift) == 0 if shift < 64 else np.ones(len(x), bool)
    if deeper is not None:
        keep &= x >> np.uint64(deeper) != 0
    return i[keep], j[keep]


def _level(shift: int, deeper: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # at most 64 x wide^2 / 2 pairs at a time
                lists = b.column(0).slice(at, 64)
                flat = lists.flatten()
                rest, nid = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
                lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                i, j = run_pairs(lengths, rest, shift, deeper)
                x, y = nid[i], nid[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            sim = np.zeros(b.num_rows)
            for k in range(b.num_rows):
                p, q = np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64)
                if min(len(p), len(q)) >= threshold * max(len(p), len(q)):
                    both = np.concatenate((p, q))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    sim[k] = common / (len(p) + len(q) - common) if common else 0.0
            keep = sim >= threshold - 1e-12
            t = pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(sim)], names=["a", "b", "na", "nb", "similarity"])
            yield t.filter(pa.array(keep))

    return run


def _rarest(threshold: float):
    """Rows (shingle, nid, number of shingles) of the shingles of which two similar sets share at least one; input nid, shingles and the
    frequency of each shingle in the same order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out_s, out_n, out_z = [], [], []
            for nid, sh, fr in zip(pdf.nid, pdf.hashes, pdf.freqs):
                sh, fr = np.asarray(sh, np.int64), np.asarray(fr, np.int64)
                m = len(sh) - math.ceil(threshold * len(sh) - 1e-9) + 1
                pick = np.lexsort((sh, fr))[:m]
                out_s.append(sh[pick])
                out_n.append(np.full(len(pick), nid))
                out_z.append(np.full(len(pick), len(sh), np.int32))
            if out_s:
                yield pd.DataFrame({"prefix": np.concatenate(out_s), "nid": np.concatenate(out_n), "size": np.concatenate(out_z)})

    return run


def _explode_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b.column(1).to_pylist()
        lens = [len(r) // 8 for r in raw]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), lens))], names=["prefix", "nid"])


def _pairs(groups: DataFrame, threshold: float, block: int = 1_000) -> DataFrame:
    """Distinct pairs of nodes that share a prefix and whose sizes allow the threshold; groups of one node leave before the join,
    larger ones are joined in blocks, so that none is one task's."""
    several = groups.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    g = groups.join(several, "prefix")
    x = g.select("prefix", F.col("nid").alias("a"), F.col("size").alias("sa"), F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int").alias("part"))
    y = g.select("prefix", F.col("nid").alias("b"), F.col("size").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = (F.col("sa") >= F.lit(threshold - 1e-9) * F.col("sb")) & (F.col("sb") >= F.lit(threshold - 1e-9) * F.col("sa"))
    return x.join(y, ["prefix", "part"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


class NearCopies:
    """Links between near-duplicate records.

    :param threshold: least similarity (intersection over union of shingle sets).
    :param shingle: words in a shingle. :param least_words: records with fewer words take no part.
    :param trees, depth: size of the forest. :param target: estimated recall at which shortening ends.
    :param least: recall at the threshold that the shortest prefix must have.
    :param wide: nodes under one prefix above which the exact way replaces the forest's.
    """

    def __init__(self, threshold: float = 0.8, shingle: int = 5, least_words: int = 0, trees: int = 24, depth: int = 6, target: float = 0.999, least: float = 0.995, wide: int = 400):
        self.threshold, self.shingle, self.least_words, self.trees, self.depth, self.target, self.wide = threshold, shingle, least_words, trees, depth, target, wide
        self.k = forest_depth(threshold, trees, depth, least)
        #: Of the last search: (prefix length, pairs, estimated recall) of each step.
        self.steps: list[tuple[int, int, float]] = []

    def nodes(self, df: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
        """(nodes: nid, node_key, copy_key, shingles; members: id, node_key). A node is a distinct shingle set with
        its copy key; texts that are formatted copies of each other have equal copy keys."""
        src = df.select(F.col(id_col).alias("id"), "content", "file_path", "language").filter(F.col("content").isNotNull() & F.col("id").isNotNull())
        src = canonical_keys(spread(src))
        rows = src.select("id", "content", "copy_key").mapInArrow(_nodes(self.shingle, self.least_words), "id string, copy_key binary, node_key binary, shingles binary")
        rows = stage(rows, "shingles")
        members = stage(rows.select("id", "node_key"), "members")
        # one node per distinct content; a hot content shrinks to one row per map task before the only shuffle of shingles
        nodes = rows.groupBy("node_key").agg(F.first("copy_key").alias("copy_key"), F.first("shingles").alias("shingles"))
        nodes = nodes.withColumn("nid", F.monotonically_increasing_id())
        nodes = stage_bucketed(nodes.select("nid", "node_key", "copy_key", "shingles"), ["node_key"], "nodes")
        discard(rows)
        return nodes, members

    def runs(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(run: nodes under one prefix of k values in order, two to ``wide`` of them; crowd: nid of the nodes under wider ones)."""
        labels = nodes.select("nid", "shingles").mapInArrow(_labels(self.trees, self.k, self.depth), "head long, rest long, nid long")
        # each partition holds whole runs of the tries, sorted
        labels = labels.repartition(parallelism(nodes.sparkSession), "head").sortWithinPartitions("head", "rest", "nid")
        both = stage(labels.mapInArrow(_runs(self.wide), "crowd boolean, run array<struct<rest: long, nid: long>>"), "runs")
        crowd = both.filter("crowd").select(F.explode("run.nid").alias("nid")).distinct()
        return both.filter("not crowd").select("run"), crowd

    def exact_candidates(self, nodes: DataFrame) -> DataFrame:
        """Pairs that share one of their rarest shingles: no pair of the threshold is missing."""
        each = stage(nodes.select("nid", "shingles").mapInArrow(_explode_shingles, "prefix long, nid long"), "crowd")
        freq = each.groupBy("prefix").agg(F.count(F.lit(1)).alias("f")).withColumnRenamed("prefix", "p")
        with_f = each.join(freq, F.col("prefix") == F.col("p")).groupBy("nid").agg(F.collect_list(F.struct("prefix", "f")).alias("s"))
        with_f = with_f.select("nid", F.col("s.prefix").alias("hashes"), F.col("s.f").alias("freqs"))
        return _pairs(with_f.mapInPandas(_rarest(self.threshold), "prefix long, nid long, size int"), self.threshold)

    def _verified(self, cand: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
        """(a, b, na, nb, similarity) of candidates that reach the threshold and are no copies of each other. Shingles are read from the
        buckets of node_key, in place; only those of candidates are shuffled."""
        ka = names.select(F.col("nid").alias("ia"), F.col("node_key").alias("na"), F.col("copy_key").alias("ca"))
        kb = names.select(F.col("nid").alias("ib"), F.col("node_key").alias("nb"), F.col("copy_key").alias("cb"))
        named = cand.join(ka, F.col("a") == F.col("ia")).join(kb, F.col("b") == F.col("ib")).filter("ca <> cb").select("a", "b", "na", "nb")
        x = nodes.select(F.col("node_key").alias("xa"), F.col("shingles").alias("sa"))
        y = nodes.select(F.col("node_key").alias("yb"), F.col("shingles").alias("sb"))
        both = named.join(x, F.col("na") == F.col("xa")).drop("xa").join(y, F.col("nb") == F.col("yb")).select("a", "b", "na", "nb", "sa", "sb")
        return both.mapInArrow(_verify(self.threshold), "a long, b long, na binary, nb binary, similarity double")

    def node_links(self, nodes: DataFrame) -> DataFrame:
        """(na, nb, similarity): node keys of linked nodes, each pair once."""
        runs, crowd = self.runs(nodes)
        names = stage_bucketed(nodes.select("nid", "node_key", "copy_key"), ["nid"], "names")
        bits = 63 // max(1, self.depth - self.k)
        self.steps, found, tested = [], [], None
        for length in range(self.depth, self.k - 1, -1):
            shift, deeper = bits * (self.depth - length), bits * (self.depth - length - 1) if length < self.depth else None
            fresh = runs.mapInArrow(_level(shift, deeper), "a long, b long").distinct()
            if tested is not None:
                fresh = fresh.join(tested, ["a", "b"], "left_anti")
            fresh = stage(fresh, "pairs")
            tested = fresh if tested is None else tested.unionByName(fresh)
            found.append(stage(self._verified(fresh, nodes, names), "links"))
            got = found[0] if len(found) == 1 else self._union(found)
            # a pair of similarity s has a prefix of this length in some trie with probability p(s): it stands for 1 / p(s) pairs
            p = 1 - F.pow(1 - F.pow("similarity", F.lit(float(length))), F.lit(float(self.trees)))
            pairs, all_ = got.agg(F.count(F.lit(1)), F.sum(1 / p)).first()
            self.steps.append((length, pairs, pairs / all_ if pairs else 1.0))
            if pairs >= all_ * self.target if pairs else length == self.k:
                break
        links = self._union(found).select("na", "nb", "similarity")
        if not crowd.isEmpty():
            more = self._verified(self.exact_candidates(nodes.join(crowd, "nid", "left_semi")), nodes, names)
            links = links.unionByName(more.select("na", "nb", "similarity")).distinct()
        return links

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def pairs(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """chunk_id_a < chunk_id_b and similarity of all linked records that are no formatted copies of each other: every member of a text
        with every member of a linked one, as p4_found asks for. Where a text has very many copies, links and groups say the same in fewer rows.

        Null ids and texts and texts below least_words (or one shingle) take no part; an empty table gives an empty result; extra
        columns are ignored; a repeated id counts once.
        """
        nodes, members = self.nodes(df, id_col)
        ma, mb = members.select(F.col("id").alias("ia"), F.col("node_key").alias("na")), members.select(F.col("id").alias("ib"), F.col("node_key").alias("nb"))
        p = self.node_links(nodes).join(ma, "na").join(mb, "nb")
        return p.select(F.least("ia", "ib").alias("chunk_id_a"), F.greatest("ia", "ib").alias("chunk_id_b"), "similarity").distinct()

    def links(self, df: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
        """(links: keep_id_a < keep_id_b and similarity between the representatives of distinct texts; members: id, keep_id, the smallest id of the
        records with the same text). Nulls and empty tables as for pairs."""
        nodes, members = self.nodes(df, id_col)
        kept = stage(members.groupBy("node_key").agg(F.min("id").alias("keep_id")), "kept")
        of = members.join(kept, "node_key").select("id", "keep_id").distinct()
        ka, kb = kept.select(F.col("node_key").alias("na"), F.col("keep_id").alias("ka")), kept.select(F.col("node_key").alias("nb"), F.col("keep_id").alias("kb"))
        p = self.node_links(nodes).join(ka, "na").join(kb, "nb")
        return p.select(F.least("ka", "kb").alias("keep_id_a"), F.greatest("ka", "kb").alias("keep_id_b"), "similarity"), of

    def groups(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """One row per record that takes part: id, keep_id (its text's representative), group_id (the smallest id that can be reached over
        links) and links (the number of texts that its text is linked with)."""
        links, members = self.links(df, id_col)
        links = stage(links, "textlinks")
        ends = links.select(F.col("keep_id_a").alias("node")).unionByName(links.select(F.col("keep_id_b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        roots = components(links.select(F.col("keep_id_a").alias("a"), F.col("keep_id_b").alias("b")))
        of = roots.join(ends, "node").withColumnRenamed("node", "keep_id")
        r = members.join(of, "keep_id", "left")
        return r.select("id", "keep_id", F.coalesce("root", "keep_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
