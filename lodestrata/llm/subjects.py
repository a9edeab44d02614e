"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A word's vector is the mean of the embeddings of the word and of its character n-grams (hashed into ``buckets`` rows), a
document's vector is the mean over its words, and each subject has a logistic output of its own, so that a document gets none,
one or several. Training is data-parallel and synchronous: at every step each partition gives the gradient of its labelled documents at the
shared model, the gradients are summed, weighted by documents, and one step is taken. The labelled rows used are bounded by ``max_labelled``, and so are
partitions and what a step sends. A text that isn't prose, whose white-space separated parts are longer than ``longest_parts`` characters on average (lists of files and hashes), has no subject.
As the outputs are linear in the vectors, scoring needs one row of outputs per distinct word.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stage

_CAMEL = re.compile(r"([a-zß-öø-ÿ])([A-Z])")
_WORD = re.compile(r"[^\W\d_]{2,}")


def words_of(text: str) -> list[str]:
    """Letter runs of two or more in lower case, camel case split."""
    return _WORD.findall(_CAMEL.sub(r"\1 \2", text).lower())


def word_rows(word: str, buckets: int, low: int, high: int) -> list[int]:
    """Embedding rows of a word: the word itself and its n-grams with word-end marks."""
    w = f"<{word}>"
    grams = [w] + [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


@dataclass
class Settings:
    dim: int = 16
    buckets: int = 1 << 16
    low: int = 4
    high: int = 5
    steps: int = 40
    rate: float = 0.2
    decay: float = 1e-5
    max_labelled: int = 8_000
    per_partition: int = 1_000
    least_words: int = 8
    longest_parts: float = 20.0
    threshold: float = 0.4
    seed: int = 11


def is_prose(text: str, s: Settings) -> bool:
    return len(text) <= s.longest_parts * len(text.split())


@dataclass
class Model:
    subjects: list[str]
    settings: Settings
    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def scorer(self):
        """A function from texts to a matrix of probabilities, zeros for texts of too few words and for what isn't prose; it keeps the outputs
        of the words it has seen."""
        s, index, rows = self.settings, {}, []
        known = np.zeros((0, len(self.subjects)), np.float32)

        def score(texts: list[str]) -> np.ndarray:
            nonlocal known
            if len(index) > 500_000:
                index.clear()
                known = known[:0]
            flat: list[int] = []
            counts = np.zeros(len(texts), np.int64)
            for k, t in enumerate(texts):
                words = words_of(t)
                if len(words) < s.least_words or not is_prose(t, s):
                    continue
                counts[k] = len(words)
                flat.extend([index[w] if w in index else index.setdefault(w, len(index)) for w in words])
            if len(index) > len(known):
                rows.extend(self.table[word_rows(w, s.buckets, s.low, s.high)].mean(0) @ self.out for w in list(index)[len(known) :])
                known = np.concatenate([known, np.asarray(rows, np.float32)])
                rows.clear()
            out = np.zeros((len(texts), len(self.subjects)))
            full = np.nonzero(counts)[0]
            if len(full):
                starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                out[full] = np.add.reduceat(known[np.asarray(flat, np.int64)], starts) / counts[full][:, None]
            out = 1 / (1 + np.exp(-(out + self.bias)))
            out[counts == 0] = 0
            return out

        return score


def _initial(subjects: list[str], s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    return Model(subjects, s, rng.normal(0, 0.5 / s.dim, (s.buckets, s.dim)).astype(np.float32), rng.normal(0, 0.5, (s.dim, len(subjects))).astype(np.float32), np.full(len(subjects), -2.0, np.float32))


class _Batch:
    """Labelled documents as index arrays, with the permutations that turn scatters into segment sums."""

    def __init__(self, texts: list[str], labels: np.ndarray, s: Settings):
        vocab: dict[str, int] = {}
        doc, word, times, size = [], [], [], []
        for d, t in enumerate(texts):
            c = Counter(words_of(t))
            size.append(max(1, c.total()))
            doc += [d] * len(c)
            word += [vocab.setdefault(w, len(vocab)) for w in c]
            times += c.values()
        self.y, self.docs, self.words = labels, len(texts), len(vocab)
        self.doc, self.word = np.asarray(doc, np.int32), np.asarray(word, np.int32)
        self.share = (np.asarray(times, np.float32) / np.asarray(size, np.float32)[self.doc])[:, None]
        rows = [word_rows(w, s.buckets, s.low, s.high) for w in vocab]
        lens = np.array([len(r) for r in rows], np.int64)
        self.rows = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
        self.lens = lens.astype(np.float32)[:, None]
        self.by_word, self.by_row = np.argsort(self.word, kind="stable").astype(np.int32), np.argsort(self.rows, kind="stable").astype(np.int32)
        self.used, self.row_starts = np.unique(self.rows[self.by_row], return_index=True)
        self.word_starts = np.unique(self.word[self.by_word], return_index=True)[1]
        self.doc_ids, self.doc_starts = np.unique(self.doc, return_index=True)
        self.owner_starts = np.unique(self.owner, return_index=True)[1]

    def gradients(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        # the mean over words commutes with the output layer: subjects are fewer columns than dimensions
        vec = np.add.reduceat(m.table[self.rows], self.owner_starts) / self.lens
        z = np.zeros((self.docs, self.y.shape[1]), np.float32)
        z[self.doc_ids] = np.add.reduceat((vec @ m.out)[self.word] * self.share, self.doc_starts)
        p = 1 / (1 + np.exp(-(z + m.bias)))
        loss = float(-np.mean(self.y * np.log(p + 1e-7) + (1 - self.y) * np.log(1 - p + 1e-7)))
        err = ((p - self.y) / self.docs).astype(np.float32)
        g_word = np.add.reduceat((err[self.doc] * self.share)[self.by_word], self.word_starts)
        g_vec = (g_word @ m.out.T) / self.lens
        g_table = np.add.reduceat(g_vec[self.owner][self.by_row], self.row_starts)
        return g_table, vec.T @ g_word, err.sum(0), loss


class _Adam:
    """One step after the other on the sums of gradients; the rate falls in the second half."""

    def __init__(self, m: Model):
        self.m, self.t = m, 0
        self.params = [m.table, m.out, m.bias]
        self.first, self.second = [np.zeros_like(x) for x in self.params], [np.zeros_like(x) for x in self.params]

    def step(self, grads: list[np.ndarray]) -> None:
        s = self.m.settings
        self.t += 1
        rate = s.rate * min(1.0, 2 * (1 - self.t / (s.steps + 1)))
        for k, g in enumerate(grads):
            g = g + s.decay * self.params[k] * (k < 2)
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            self.params[k] -= (rate * (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


_SEGMENT = re.compile(r"\n+|(?<=[.!?]) ")


def blends(texts: list[str], labels: list[list[int]], rng: np.random.Generator) -> tuple[list[str], list[list[int]]]:
    """Made-up documents of two subjects: halves of two labelled ones of one subject each."""
    single = [k for k, ks in enumerate(labels) if len(ks) == 1]
    parts = {k: [p for p in _SEGMENT.split(texts[k]) if p.strip()] for k in single}
    single = [k for k in single if len(parts[k]) > 3]
    more_t: list[str] = []
    more_l: list[list[int]] = []
    for k, other in zip(single, rng.permutation(single)):
        a, b = parts[k], parts[other]
        if labels[k] != labels[other]:
            more_t.append("\n".join(a[: len(a) // 2] + b[len(b) // 2 :]))
            more_l.append(labels[k] + labels[other])
    return more_t, more_l


def _indexed(s: Settings, k_subjects: int):
    """A partition's documents as one row: their index arrays, made once for all steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        texts, labels = [t for b in got for t in b.column(0).to_pylist()], [ks for b in got for ks in b.column(1).to_pylist()]
        more = blends(texts, labels, np.random.default_rng(s.seed + got[0].column(2)[0].as_py()))
        texts, labels = texts + more[0], labels + more[1]
        y = np.zeros((len(texts), k_subjects), np.float32)
        for d, ks in enumerate(labels):
            y[d, ks] = 1
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_Batch(texts, y, s), protocol=5)], pa.binary())], names=["documents"])

    return run


def _gradients(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for n in range(b.num_rows):
                batch = pickle.loads(b.column(0)[n].as_buffer())
                table, out, bias, _ = batch.gradients(m)
                parts = [batch.used.astype(np.int32).tobytes(), table.astype(np.float32).tobytes(), out.astype(np.float32).tobytes(), bias.astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.docs], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], names=["n", "used", "table", "out", "bias"])

    return run


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, settings: Settings | None = None) -> Model:
    """Fit the model on labelled documents.

    Null texts and subjects that aren't listed are ignored; a repeated label counts once; the list of subjects is held by the driver. At most max_labelled documents
    are used, the ones with the smallest hash of doc_id. Without labels the model gives no subject.
    """
    s = settings or Settings()
    spark = documents.sparkSession
    names = sorted({r[0] for r in subjects.select("subject").filter("subject is not null").distinct().collect()})
    m = _initial(names, s)
    num = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "subject string, k int")
    lab = labels.join(F.broadcast(num), "subject").groupBy("doc_id").agg(F.collect_set("k").alias("ks"))
    lab = stage(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled), "labels")
    src = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    parts = max(1, -(-min(s.max_labelled, lab.count()) // s.per_partition))
    # at most max_labelled rows of a number and a few subjects
    rows = src.join(F.broadcast(lab), "doc_id").repartition(parts, F.xxhash64("doc_id")).select("text", "ks", F.spark_partition_id().alias("part"))
    rows = stage(rows.mapInArrow(_indexed(s, len(names)), "documents binary"), "labelled")
    adam = _Adam(m)
    for _ in range(s.steps):
        shared = spark.sparkContext.broadcast(m)
        got = rows.mapInArrow(_gradients(shared), "n long, used binary, table binary, out binary, bias binary").toArrow()
        shared.destroy()
        counts = got.column("n").to_pylist()
        if not counts:
            break
        sums = [np.zeros_like(x) for x in adam.params]
        for n, *parts in zip(counts, *(got.column(c) for c in ("used", "table", "out", "bias"))):
            w = np.float32(n / sum(counts))
            used, table, out, bias = (np.frombuffer(x.as_buffer(), t) for x, t in zip(parts, (np.int32, np.float32, np.float32, np.float32)))
            sums[0][used] += table.reshape(-1, s.dim) * w
            sums[1] += out.reshape(m.out.shape) * w
            sums[2] += bias * w
        adam.step(sums)
    return m


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score, names = m.scorer(), np.asarray(m.subjects, object)
        for b in batches:
            if not b.num_rows:
                continue
            p = score(b.column(1).to_pylist())
            d, k = np.nonzero(p >= m.settings.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)).cast(pa.int64()), pa.array(names[k], pa.string()), pa.array(p[d, k], pa.float64())], names=["doc_id", "subject", "probability"])

    return run


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, probability) for every document and subject of at least the threshold's probability. Whole
    texts are read; null, empty and very short texts have no row; a repeated doc_id is scored each time."""
    src = documents.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return spread(src).mapInArrow(_score(documents.sparkSession.sparkContext.broadcast(model)), "doc_id long, subject string, probability double")


def composition(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and share of the corpus per subject."""
    c = assigned.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))
    return c.withColumn("share", F.try_divide("documents", F.lit(documents.count())))
