"""Most similar vectors for every vector: hierarchical k-means tree with best-bin-first traversal.

Equal vectors are one node, so that copies don't crowd a leaf. A tree of centroids is fitted on a bounded sample; every
node is placed in a leaf. Leaves of the tree that hold more than SPLIT times the aimed number of vectors are divided into cells by a second k-means over a bounded
sample of their own vectors, so that cells keep their size when the collection grows. A cell is stored as blocks of bounded size. Each node first searches its own block, which gives the
similarity it has to beat. Then it visits the leaves and cells it lies close to: at every level of the tree it has a margin, its distance to the plane between the nearest centroid and
another one, and the squared margins on the way to a cell, in relation to the distance the node has to beat, may add up to a width. The width is calibrated per model: it is
widened until the exact neighbours of a sample of queries, found by a scan of all vectors, are covered to the target recall. So a node within its leaf asks few others and one at many
borders asks many. Only candidates better than those of the own block are shuffled.

A question is a copy of its vector for every block that is asked. So that these copies don't pile up on disk, the blocks ask in rounds, each of about ROUND copies of all vectors, and
what a step has read is deleted when the step has been stored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stage

#: Leaves of all trees together, about (256 bytes each): what is broadcast. Every model has one at least.
TOP_LEAVES = 20_000
#: A leaf of more than so many times the aimed vectors is divided into cells; the cells of a leaf, and the vectors sampled for each of them, at most.
SPLIT, MAX_CELLS, CELL_SAMPLE = 4, 4_096, 64
#: Questions of one round in relation to the vectors, about, and the bytes from which on there is more than one round.
ROUND, LEAST_ROUND = 1.75, 1 << 27
#: Questions in a batch that leaves a task, and bytes of all cells' centroids that every task holds, at most; more are joined to the questions.
ASKS, BROADCAST = 16_384, 1 << 24


def _stored(df: DataFrame, label: str, *read: DataFrame) -> DataFrame:
    """stage, after which the shuffle files of that query and the tables ``read`` are removed: the stored rows replace them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        out = stage(df, label)
    finally:
        conf.set(key, before)
    for r in read:
        discard(r)
    return out


def usable(df: DataFrame, dim: int = 64) -> DataFrame:
    """(id, model, vec) of the live rows with ``dim`` finite numbers that aren't all zero; vec is the unit vector as
    float32 bytes. Of several rows of one id the latest (created_at, then by content) counts. A null model is a
    model of its own; rows with a null id are left out."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(2)
            flat = np.asarray(e.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            good = np.isfinite(flat).all(1)
            top = np.abs(np.where(np.isfinite(flat), flat, 0)).max(1) if len(flat) else np.zeros(0)
            good &= top > 0
            x = flat[good] / top[good][:, None]  # no overflow or underflow in the norm
            x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
            rows = pa.array(np.nonzero(good)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "model", "vec"])

    d = df.filter(F.col("deleted_at").isNull() & F.col("id").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))
    d = d.groupBy("id").agg(F.max(F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.coalesce("model_version", F.lit("")).alias("model"), "embedding")).alias("r"))
    return d.select("id", "r.model", "r.embedding").mapInArrow(unit, "id string, model string, vec binary")


class Tree:
    """Centroids of a hierarchical k-means; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = 8, iterations: int = 8, seed: int = 5):
        self.centroids: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)

        def grow(x: np.ndarray, centre: np.ndarray, want: int) -> int:
            me = len(self.centroids)
            self.centroids.append(centre), self.children.append([]), self.leaf_of.append(-1)
            k = min(branch, want, len(x))
            parts = self._split(x, k, iterations, rng) if k > 1 else []
            if len(parts) < 2:
                self.leaf_of[me] = self.leaves
                self.leaves += 1
                return me
            for c, p in parts:
                self.children[me].append(grow(p, c, max(1, round(want * len(p) / len(x)))))
            return me

        grow(sample, sample.mean(0) if len(sample) else np.zeros(1, np.float32), max(1, leaves))
        self.matrix = np.stack(self.centroids).astype(np.float32)
        self.half = (self.matrix**2).sum(1) / 2

    @staticmethod
    def _split(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(iterations):
            own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            for j in range(k):
                if (own == j).any():
                    c[j] = x[own == j].mean(0)
        own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        return [(c[j], x[own == j]) for j in range(k) if (own == j).any()]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row by greedy descent."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            pick = (x[rows] @ self.matrix[kids].T - self.half[kids]).argmax(1)
            todo += [(kid, rows[pick == j]) for j, kid in enumerate(kids) if (pick == j).any()]
        return out

    def reach(self, x: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows, squared margins on the way) of the leaves where these are within each row's ``most``."""
        todo = [(0, np.arange(len(x)), np.zeros(len(x), np.float32))]
        while todo:
            node, rows, gone = todo.pop()
            kids = self.children[node]
            if not kids:
                yield self.leaf_of[node], rows, gone
                continue
            far = gone[:, None] + _margins(x[rows], self.matrix[kids], self.half[kids])
            near = far <= most[rows][:, None]
            for j, kid in enumerate(kids):
                at = np.nonzero(near[:, j])[0]
                if len(at):
                    todo.append((kid, rows[at], far[at, j]))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _margins(x: np.ndarray, c: np.ndarray, half: np.ndarray) -> np.ndarray:
    """For each row and centroid the squared distance to the plane between it and the row's nearest centroid; 0 for the nearest."""
    a = x @ c.T - half
    own = a.argmax(1)
    apart = 2 * (half[own][:, None] + half - c[own] @ c.T)
    return (a[np.arange(len(x)), own][:, None] - a) ** 2 / np.maximum(apart, 1e-12)


def _cell_margins(x: np.ndarray, centroids: bytes | None) -> np.ndarray:
    """_margins over the cells of a leaf; none are one cell."""
    if not centroids:
        return np.zeros((len(x), 1), np.float32)
    c = np.frombuffer(centroids, np.float32).reshape(-1, x.shape[1])
    return _margins(x, c, (c * c).sum(1) / 2)


def _distance(bar: np.ndarray) -> np.ndarray:
    """Of unit vectors with that cosine; not quite 0, as cosines are rounded."""
    return np.sqrt(np.maximum(2 - 2 * np.maximum(bar, -1), 1e-4)).astype(np.float32)


def _parts(ids: list[int], parts: list[int], cells: int) -> np.ndarray:
    """Blocks of each cell of a leaf."""
    out = np.zeros(cells, np.int64)
    out[ids] = parts
    return out


class Neighbours:
    """:param k: neighbours per vector. :param target: recall to calibrate for. :param leaf: aimed vectors per leaf.
    :param sample: vectors per model the tree is fitted on, about. :param queries: calibration queries per model.
    :param block: vectors in one stored block, at most, about."""

    def __init__(self, k: int = 5, dim: int = 64, target: float = 0.985, leaf: int = 600, sample: int = 30_000, queries: int = 300, block: int = 2_000):
        self.k, self.dim, self.target, self.leaf, self.sample, self.queries, self.block = k, dim, target, leaf, sample, queries, block
        #: Of the last search, by model: the width, leaves visited on average, cells visited in each of them, blocks asked, and the recall measured with that.
        self.width: dict[str, float] = {}
        self.visits: dict[str, float] = {}
        self.cells: dict[str, float] = {}
        self.blocks: dict[str, float] = {}
        self.measured: dict[str, float] = {}
        #: Of the last search: rounds of questions.
        self.rounds = 0

    def _nodes(self, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes: nid, model, vec; members: nid, id), where nid is a number of a distinct (model, vec)."""
        nodes = _stored(vectors.select("model", "vec").distinct().withColumn("nid", F.monotonically_increasing_id()), "vecs")
        members = vectors.join(nodes.select(F.col("model").alias("m"), F.col("vec").alias("v"), "nid"), (F.col("model") == F.col("m")) & (F.col("vec") == F.col("v"))).select("nid", "id")
        return nodes, _stored(members, "vecids", vectors)

    def _fit(self, nodes: DataFrame) -> dict[str, Tree]:
        """One tree per model, each fitted in a task of its own."""
        spark, dim = nodes.sparkSession, self.dim
        counts = {r.model: r.n for r in nodes.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return {}
        total = sum(counts.values())
        plan = [(m, min(1.0, self.sample / n), max(1, min(math.ceil(n / self.leaf), self.sample // 8, math.ceil(TOP_LEAVES * n / total)))) for m, n in counts.items()]
        plan = spark.createDataFrame(plan, "m string, rate double, leaves int")
        some = nodes.join(F.broadcast(plan), nodes.model == plan.m).filter(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < F.ceil(F.col("rate") * 1_000_000))

        def fit(t: pa.Table) -> pa.Table:
            x = _matrix(t.column("vec").combine_chunks(), dim)
            leaves = min(t.column("leaves")[0].as_py(), max(1, len(x) // 8))
            return pa.table({"model": [t.column("model")[0].as_py()], "tree": pa.array([pickle.dumps(Tree(x, leaves))], pa.binary())})

        got = some.select("model", "leaves", "vec").groupBy("model").applyInArrow(fit, "model string, tree binary")
        trees = {r.model: pickle.loads(r.tree) for r in got.collect()}
        return {m: trees[m] if m in trees else Tree(np.zeros((1, dim), np.float32), 1) for m in counts}

    def _placed(self, nodes: DataFrame, trees) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                models = np.asarray(b.column(1).to_pylist(), object)
                x = _matrix(b.column(2), self.dim)
                leaf = np.zeros(b.num_rows, np.int64)
                for m in set(models.tolist()):
                    leaf[models == m] = trees.value[m].place(x[models == m])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32()), b.column(2)], names=["nid", "model", "leaf", "vec"])

        return nodes.select("nid", "model", "vec").mapInArrow(place, "nid long, model string, leaf int, vec binary")

    def _packed(self, rows: DataFrame) -> DataFrame:
        """Rows (model, leaf, cell, part, nids, vecs) from (nid, model, leaf, cell, vec): a cell in parts of at most about ``block`` vectors."""
        cell = ["model", "leaf", "cell"]
        size = rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(self.block))).cast("int").alias("parts"))
        p = rows.join(size, cell).withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
        both = p.groupBy(*cell, "part").agg(F.sort_array(F.collect_list(F.struct("nid", "vec"))).alias("r"))
        return both.select(*cell, "part", F.col("r.nid").alias("nids"), F.col("r.vec").alias("vecs"))

    def _cells(self, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(blocks, as _packed; cells: model, leaf, centroids of its cells as bytes, none for a leaf of one cell)."""
        dim = self.dim
        size = placed.groupBy("model", "leaf").agg(F.least(F.ceil(F.count(F.lit(1)) / F.lit(float(SPLIT * self.leaf))), F.lit(MAX_CELLS)).cast("int").alias("cells"), F.count(F.lit(1)).alias("n"))
        size = _stored(size, "leaves")
        large = stage(size.filter("cells > 1"), "largeleaves")
        packed = self._packed(placed.withColumn("cell", F.lit(0)))
        if large.isEmpty():
            return _stored(packed, "blocks", placed), size.select("model", "leaf", F.lit(None).cast("binary").alias("centroids"))
        rate = F.ceil(F.lit(1_000_000.0) * CELL_SAMPLE * F.col("cells") / F.col("n"))
        some = placed.join(large, ["model", "leaf"]).filter(F.pmod(F.xxhash64("vec", F.lit(3)), F.lit(1_000_000)) < rate)

        def fit(t: pa.Table) -> pa.Table:
            x = _matrix(t.column("vec").combine_chunks(), dim)
            tree = Tree(x, min(t.column("cells")[0].as_py(), max(1, len(x) // 8)))
            c = tree.matrix[[n for n, leaf in enumerate(tree.leaf_of) if leaf >= 0]]
            return pa.table({"model": [t.column("model")[0].as_py()], "leaf": pa.array([t.column("leaf")[0].as_py()], pa.int32()), "centroids": pa.array([c.tobytes()], pa.binary())})

        fitted = _stored(some.select("model", "leaf", "cells", "vec").groupBy("model", "leaf").applyInArrow(fit, "model string, leaf int, centroids binary"), "centroids")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n in range(b.num_rows):
                    x, c = _matrix(b.column(3)[n].values, dim), np.frombuffer(b.column(4)[n].as_py(), np.float32).reshape(-1, dim)
                    cell = (x @ c.T - (c * c).sum(1) / 2).argmax(1).astype(np.int32)
                    m = len(x)
                    yield pa.RecordBatch.from_arrays([b.column(2)[n].values, pa.array([b.column(0)[n].as_py()] * m, pa.string()), pa.array([b.column(1)[n].as_py()] * m, pa.int32()), pa.array(cell), b.column(3)[n].values], names=["nid", "model", "leaf", "cell", "vec"])

        packed = _stored(packed, "packed", placed)
        moved = packed.join(fitted, ["model", "leaf"]).select("model", "leaf", "nids", "vecs", "centroids").mapInArrow(assign, "nid long, model string, leaf int, cell int, vec binary")
        kept = packed.join(fitted, ["model", "leaf"], "left_anti")
        moved = _stored(moved, "moved")
        return _stored(kept.unionByName(self._packed(moved)), "blocks", packed, moved), size.join(fitted, ["model", "leaf"], "left").select("model", "leaf", "centroids")

    def _located(self, blocks: DataFrame, cells: DataFrame) -> DataFrame:
        """(model, leaf, vectors in it, centroids, ids and numbers of blocks of its cells)."""
        last = blocks.groupBy("model", "leaf", "cell").agg((F.max("part") + 1).alias("n"), F.sum(F.size("nids")).alias("held"))
        of = last.groupBy("model", "leaf").agg(F.sum("held").alias("held"), F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("c"))  # MAX_CELLS entries
        return _stored(cells.join(of, ["model", "leaf"]).select("model", "leaf", "held", "centroids", F.col("c.cell").alias("ids"), F.col("c.n").alias("parts")), "cells")

    def _calibrate(self, blocks: DataFrame, cells: DataFrame, trees: dict[str, Tree]) -> None:
        """Sets the width per model, the recall measured with it and what it makes a node visit."""
        spark, k, dim = blocks.sparkSession, self.k, self.dim
        flat = blocks.select("model", F.explode(F.arrays_zip("nids", "vecs")).alias("r")).select("model", "r.nids", "r.vecs")
        w = Window.partitionBy("model").orderBy(F.xxhash64("vecs", F.lit(7)), "nids")
        asked: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        picked: dict[str, list] = {}
        for r in flat.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= self.queries).collect():  # queries rows per model
            picked.setdefault(r.model, []).append((r.nids, r.vecs))
        for model, q in picked.items():
            asked[model] = np.array([n for n, _ in q], np.int64), np.stack([np.frombuffer(v, np.float32) for _, v in q])
        shared = spark.sparkContext.broadcast(asked)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # leaf -1 has what a query has to beat after its own block
            best: dict[str, tuple[np.ndarray, ...]] = {}
            names = ["model", "q", "s", "leaf", "cell"]
            for b in batches:
                for n in range(b.num_rows):
                    m = b.column(0)[n].as_py()
                    ids, q = shared.value[m]
                    s = q @ _matrix(b.column(4)[n].values, dim).T
                    for i, at in zip(*np.nonzero(ids[:, None] == b.column(3)[n].values.to_numpy()[None, :])):
                        s[i, at] = -9
                        bar = float(np.partition(s[i], s.shape[1] - k)[s.shape[1] - k]) if s.shape[1] > k else -4.0
                        yield pa.RecordBatch.from_arrays([pa.array([m], pa.string()), pa.array([i], pa.int32()), pa.array([bar]), pa.array([-1], pa.int32()), pa.array([-1], pa.int32())], names=names)
                    if m in best:
                        s = s[:, (s > best[m][0].min(1)[:, None]).any(0)]
                    leaf, cell = np.full(s.shape, b.column(1)[n].as_py(), np.int32), np.full(s.shape, b.column(2)[n].as_py(), np.int32)
                    if m in best:
                        s, leaf, cell = (np.concatenate(x, 1) for x in zip(best[m], (s, leaf, cell)))
                    top = np.argpartition(-s, k, 1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
                    best[m] = tuple(np.take_along_axis(x, top, 1) for x in (s, leaf, cell))
                    if s.shape[1] < k:  # anything is better than nothing
                        best[m] = tuple(np.pad(x, ((0, 0), (0, k - s.shape[1])), constant_values=v) for x, v in zip(best[m], (-9, 0, 0)))
            for m, (s, leaf, cell) in best.items():
                q = np.repeat(np.arange(len(s)), s.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(q), pa.string()), pa.array(q, pa.int32()), pa.array(s.reshape(-1).astype(np.float64)), pa.array(leaf.reshape(-1)), pa.array(cell.reshape(-1))], names=names)

        found = blocks.select("model", "leaf", "cell", "nids", "vecs").mapInArrow(scan, "model string, q int, s double, leaf int, cell int")
        w = Window.partitionBy("model", "q", F.col("leaf") < 0).orderBy(F.col("s").desc(), "leaf", "cell")
        truth = found.filter("s > -5").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gone = [float(_cell_margins(shared.value[m][1][q : q + 1], raw)[0][max(cell, 0)]) for m, q, cell, raw in zip(*(b.column(c).to_pylist() for c in (0, 1, 4, 5)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(gone, pa.float64())], names=["model", "q", "s", "leaf", "gone"])

        # queries x (k + 1) rows per model
        rows = truth.join(cells.select("model", "leaf", "centroids"), ["model", "leaf"], "left").select("model", "q", "s", "leaf", "cell", "centroids")
        by_model: dict[str, list] = {}
        for r in rows.mapInArrow(measured, "model string, q int, s double, leaf int, gone double").collect():
            by_model.setdefault(r.model, []).append(r)
        plans: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for model, (_, x) in asked.items():
            t, mine = trees[model], by_model.get(model, [])
            bar, gone = np.full(len(x), -4.0), np.zeros((len(x), t.leaves), np.float32)
            for r in mine:
                if r.leaf < 0:
                    bar[r.q] = r.s
            for leaf, at, far in t.reach(x, np.full(len(x), np.inf, np.float32)):
                gone[at, leaf] = far
            d = _distance(bar)
            need = np.sort([(gone[r.q, r.leaf] + r.gone) / d[r.q] for r in mine if r.leaf >= 0])
            if len(need):
                # the sample's own error is added to the target
                share = min(1.0, self.target + math.sqrt(self.target * (1 - self.target) / len(need)))
                at = max(0, math.ceil(share * len(need)) - 1)
                self.width[model], self.measured[model] = float(need[at]) * 1.0001 + 1e-9, (at + 1) / len(need)
            else:
                self.width[model], self.measured[model] = 1e9, 1.0
            plans[model] = x, gone, (self.width[model] * d).astype(np.float32)
        spread = spark.sparkContext.broadcast(plans)

        def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sums = []
                for m, leaf, raw, ids, parts in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5))):
                    x, gone, most = spread.value[m]
                    at = np.nonzero(gone[:, leaf] <= most)[0]
                    hit = gone[at, leaf][:, None] + _cell_margins(x[at], raw) <= most[at][:, None]
                    sums.append((len(at), int(hit.sum()), int((hit @ _parts(ids, parts, hit.shape[1])).sum())))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*sums))] if sums else [b.column(0), *[pa.array([], pa.int64())] * 3], names=["model", "leaves", "cells", "blocks"])

        for r in cells.mapInArrow(visited, "model string, leaves long, cells long, blocks long").groupBy("model").agg(*(F.sum(c).alias(c) for c in ("leaves", "cells", "blocks"))).collect():
            n = len(asked[r.model][0])
            self.visits[r.model], self.cells[r.model], self.blocks[r.model] = r.leaves / n, r.cells / max(1, r.leaves), r.blocks / n

    def links(self, nodes: DataFrame) -> DataFrame:
        """(nid, other, cosine): of each node the 2 k best candidates. ``nodes`` is a staged table; it is discarded."""
        spark = nodes.sparkSession
        trees = self._fit(nodes)
        k, dim = self.k, self.dim
        if not trees:
            return spark.createDataFrame([], "nid long, other long, cosine float")
        shared = spark.sparkContext.broadcast(trees)
        blocks, cells = self._cells(_stored(self._placed(nodes, shared), "placed", nodes))
        cells = self._located(blocks, cells)
        self._calibrate(blocks, cells, trees)
        width = spark.sparkContext.broadcast(dict(self.width))
        held: dict[str, np.ndarray] = {m: np.zeros(t.leaves, np.int64) for m, t in trees.items()}
        for r in cells.select("model", "leaf", "held").collect():  # a row per leaf
            held[r.model][r.leaf] = r.held
        sizes, enough = spark.sparkContext.broadcast(held), max(self.leaf, 4 * k)

        def within(model: str, bar: np.ndarray) -> np.ndarray:
            """The squared margins up to which rows ask; all of a leaf's cells where the own block has fewer than k others."""
            return np.where(bar < -1, np.float32(np.inf), width.value[model] * _distance(bar))

        def visits(model: str, x: np.ndarray, bar: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """Tree.reach within the width; rows without k others in the own block ask as many leaves as hold enough vectors."""
            t: Tree = shared.value[model]
            if len(x) > k:
                yield from t.reach(x, within(model, bar))
                return
            every = sorted(t.reach(x, np.full(len(x), np.inf, np.float32)), key=lambda e: e[0])
            order = np.argsort(far := np.stack([e[2][np.argsort(e[1])] for e in every], 1), 1, kind="stable")
            full = np.take_along_axis(far, order, 1)
            last = np.minimum((np.cumsum(sizes.value[model][order], 1) < enough).sum(1), far.shape[1] - 1)
            most = np.maximum(full[np.arange(len(x)), last], width.value[model] * _distance(bar))
            for leaf in range(far.shape[1]):
                at = np.nonzero(far[:, leaf] <= most)[0]
                if len(at):
                    yield leaf, at, far[at, leaf]

        def best(ids: np.ndarray, s: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row, other, cosine) of up to k entries per row that reach the row's bar, and those equal to the last."""
            at = np.flatnonzero(s >= np.maximum(bar, -5)[:, None])
            many = np.nonzero(np.bincount(at // s.shape[1], minlength=len(s)) > k)[0]
            if len(many):
                bar = np.maximum(bar, -5)
                bar[many] = np.maximum(bar[many], np.partition(s[many], s.shape[1] - k, 1)[:, s.shape[1] - k])
                at = at[s.ravel()[at] >= bar[at // s.shape[1]]]
            return at // s.shape[1], ids[at % s.shape[1]], s.ravel()[at]

        size, each = cells.agg(F.sum(F.length("centroids"))).first()[0] or 0, 4 * dim + 16
        known: dict[tuple[str, int], tuple] = {}
        if size <= BROADCAST:
            known = {(r.model, r.leaf): (r.centroids, r.ids, r.parts) for r in cells.select("model", "leaf", "centroids", "ids", "parts").collect()}  # a row per leaf
        known_cells = spark.sparkContext.broadcast(known)

        def to_blocks(place: tuple, target: int, q: np.ndarray, x: np.ndarray, bar: np.ndarray, gone: np.ndarray, raw: bytes | None, ids: list[int], parts: list[int]) -> Iterator[tuple]:
            """The questions to a leaf go to the cells within the width, and to every block of these but the own one."""
            near = gone[:, None] + _cell_margins(x, raw) <= within(place[0], bar)[:, None]
            blocks_of = _parts(ids, parts, near.shape[1])
            for to in np.nonzero(near.any(0))[0].tolist():
                at = np.nonzero(near[:, to])[0]
                cols = q[at].tobytes(), x[at].tobytes(), bar[at].tobytes()
                for p in range(blocks_of[to]):
                    if (target, to, p) != place[1:]:
                        yield place[0], target, to, p, 1, *cols

        def batches_of(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
            """Record batches of about ASKS questions; the first column is the model, the last ones are bytes from ``rows`` on."""
            types = [pa.string(), *[pa.int32()] * (names.index("rows") - 1), *[pa.binary()] * (len(names) - names.index("rows"))]
            out, held = [], 0
            for r in rows:
                out.append(r)
                held += len(r[names.index("rows")]) // 8
                if held >= ASKS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        leaf_names = ["model", "target", "leaf", "cell", "part", "rows", "data", "bars", "gone"]
        block_names = ["model", "leaf", "cell", "part", "kind", "rows", "data", "bars"]
        block_form = "model string, leaf int, cell int, part int, kind int, rows binary, data binary, bars binary"

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            # a block against itself sets the bar; target -1 holds what it gave, the others the questions to leaves
            for b in batches:
                for n in range(b.num_rows):
                    nid = b.column(4)[n].values.to_numpy()
                    x = _matrix(b.column(5)[n].values, dim)
                    s = x @ x.T
                    np.fill_diagonal(s, -9)
                    bar = np.full(len(nid), -4.0, np.float32)
                    if s.shape[1] > k:
                        bar = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
                    r, o, v = best(nid, s, bar)
                    del s
                    place = tuple(b.column(c)[n].as_py() for c in range(4))
                    yield place, -1, nid[r], o, v, v
                    for target, at, gone in visits(place[0], x, bar):
                        yield place, target, nid[at], x[at], bar[at], gone

        def own_to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batches_of(((p[0], target, *p[1:], *(c.tobytes() for c in cols)) for p, target, *cols in own(batches)), leaf_names)

        def own_to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for p, target, q, x, bar, gone in own(batches):
                    if target < 0:
                        yield p[0], -1, p[1], p[2] * 31 + p[3], 2, q.tobytes(), x.tobytes(), bar.tobytes()
                    else:
                        yield from to_blocks(p, target, q, x, bar, gone, *known_cells.value[p[0], target])

            yield from batches_of(rows(), block_names)

        def leaves_to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for b in batches:
                    for n in range(b.num_rows):
                        model, target, leaf, cell, part, q, x, bar, gone, raw, ids, parts = (c[n].as_py() for c in b.columns)
                        if target < 0:
                            yield model, -1, leaf, cell * 31 + part, 2, q, x, bar
                        else:
                            floats = np.frombuffer(x, np.float32).reshape(-1, dim), np.frombuffer(bar, np.float32), np.frombuffer(gone, np.float32)
                            yield from to_blocks((model, leaf, cell, part), target, np.frombuffer(q, np.int64), *floats, raw, ids, parts)

            yield from batches_of(rows(), block_names)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # rows come by block: the block (kind 0), then the questions to it (1); kind 2 are answers already
            at, nid, x = None, None, None
            for b in batches:
                kinds, got = b.column(4).to_pylist(), []
                for n, kind in enumerate(kinds):
                    if kind == 0:
                        at, nid, x = tuple(b.column(c)[n].as_py() for c in range(4)), b.column(8)[n].values.to_numpy().copy(), _matrix(b.column(9)[n].values, dim)
                        continue
                    q, data, bar = np.frombuffer(b.column(5)[n].as_py(), np.int64), b.column(6)[n].as_py(), np.frombuffer(b.column(7)[n].as_py(), np.float32)
                    if kind == 2:
                        got.append((q, np.frombuffer(data, np.int64), bar))
                        continue
                    if at != tuple(b.column(c)[n].as_py() for c in range(4)):
                        raise ValueError("questions without their block")
                    r, o, v = best(nid, np.frombuffer(data, np.float32).reshape(-1, dim) @ x.T, bar)
                    got.append((q[r], o, v))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["nid", "other", "cosine"])

        counts = {r.model: r.n for r in blocks.groupBy("model").agg(F.sum(F.size("nids")).alias("n")).collect()}
        asks = sum(self.blocks[m] * n for m, n in counts.items())
        self.rounds = max(1, math.ceil(asks * each / max(ROUND * sum(counts.values()) * each, LEAST_ROUND)))
        to = cells.select(F.col("model").alias("cm"), F.col("leaf").alias("cl"), "centroids", "ids", "parts")
        key, turn = ["model", "leaf", "cell", "part"], F.pmod(F.xxhash64("model", "leaf", "cell", "part"), F.lit(self.rounds))
        stored = blocks.select(*key, F.lit(0).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in ("rows", "data", "bars")), "nids", "vecs")
        w = Window.partitionBy("nid").orderBy(F.col("cosine").desc(), "other")
        links = None
        for now in range(self.rounds):
            asked = blocks.filter(turn == now).select(*key, "nids", "vecs")
            if known:
                asked = asked.mapInArrow(own_to_blocks, block_form)
            else:
                sent = asked.mapInArrow(own_to_leaves, "model string, target int, leaf int, cell int, part int, rows binary, data binary, bars binary, gone binary")
                sent = sent.join(to, (sent.model == F.col("cm")) & (sent.target == F.col("cl")), "left").select(*leaf_names, "centroids", "ids", "parts")
                asked = sent.mapInArrow(leaves_to_blocks, block_form)
            asked = asked.withColumns({"nids": F.lit(None).cast("array<bigint>"), "vecs": F.lit(None).cast("array<binary>")})
            met = stored.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind")
            got = met.mapInArrow(answer, "nid long, other long, cosine float").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * k).drop("r")
            got = _stored(got, "links")
            links = got if links is None else links.unionByName(got)
        discard(blocks)
        return links

    def neighbours(self, df: DataFrame) -> DataFrame:
        """(id, neighbour_id, cosine, rank): the k most similar other vectors of the same model for every usable one.

        Equal cosines go to the smaller neighbour_id. Fewer than k others give fewer rows. Null, zero, non-finite and wrong-length
        vectors and deleted rows are neither asked nor found; an empty table gives an empty result; extra columns are ignored.
        """
        nodes, members = self._nodes(_stored(usable(df, self.dim), "unit"))
        links = self.links(nodes)
        # of a node's ids only the k + 1 smallest can be anyone's neighbours
        wm = Window.partitionBy("nid").orderBy("id")
        few = _stored(members.withColumn("r", F.row_number().over(wm)).filter(F.col("r") <= self.k + 1).select(F.col("nid").alias("o"), F.col("id").alias("neighbour_id")), "vecfew")
        other = links.join(few, links.other == few.o).select("nid", "neighbour_id", F.col("cosine").cast("double").alias("cosine"))
        same = few.select(F.col("o").alias("nid"), "neighbour_id", F.lit(1.0).alias("cosine"))
        wn = Window.partitionBy("nid").orderBy(F.col("cosine").desc(), "neighbour_id")
        pool = other.unionByName(same).withColumn("r", F.row_number().over(wn)).filter(F.col("r") <= self.k + 1).drop("r")
        pool = pool.groupBy("nid").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour_id"))).alias("p"))  # k + 1 entries
        got = members.join(pool, "nid").select("id", F.posexplode(F.slice(F.filter("p", lambda x: x.neighbour_id != F.col("id")), 1, self.k)).alias("at", "n"))
        return got.select("id", F.col("n.neighbour_id").alias("neighbour_id"), (-F.col("n.c")).alias("cosine"), (F.col("at") + 1).alias("rank"))
