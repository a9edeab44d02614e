"""Evaluation texts that leak into training texts: winnowed fingerprints, joined and extended to edited passages.

Words are hashed in runs of ``k``; of every ``window`` neighbouring runs the one with the least hash is a fingerprint,
so any shared run of k + window - 1 words shares a fingerprint. A passage of ``passage`` words with at most one edit in
``per_edit`` has an unbroken run of at least that length with the defaults (30 words, 3 edits: 27 kept words in 4 runs, one of 7 or more).

1. Items of any number become rows of word hashes and fingerprints. A Bloom filter of all their runs, of bounded size, is broadcast.
2. Documents are read once. One that has fewer runs in the filter than any passage keeps has no case and ends there; the filter errs to one
   side only, so a fuller one costs time and never a case.
3. The fingerprints of what is left are joined with those of the items by a shuffle, and so are its runs, to count what a document and an item
   share; hashes of very many documents are salted. A line that many items open with gives many pairs of too few runs, which end here.
4. Each pair that is left is extended at its fingerprints in both texts as far as the edits allow, which settles it exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stage
from .near_copies import _M1, _M2, _mix

#: Bits of the filter for each run of the items, up to the whole filter's bound; probes of a look-up.
FILTER_BITS, MOST_FILTER_BITS, PROBES = 32, 1 << 27, 4
#: Documents with one fingerprint from which it is salted, and the salts. Hot fingerprints that are broadcast at most (8 bytes each).
HOT_DOCUMENTS, SALTS, MAX_BROADCAST_KEYS = 20_000, 32, 1_000_000

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))*\s*/?>|&(?:[a-z]{2,8}|#\d{1,6});|\{\{|\}\}")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without tags and entities of markup."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(m, np.uint64)
    for j in range(k):
        run = _mix(run * _M2 + h[j : j + m] + _M1)
    return run


def winnow(run: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: the (last) least hash of each window."""
    m = len(run)
    if m == 0:
        return np.zeros(0, np.int64)
    if m <= window:
        return np.array([m - 1 - int(np.argmin(run[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(run, window)[:, ::-1]
    return np.unique(np.arange(m - window + 1) + window - 1 - views.argmin(1))


def passage_length(item: list[int], doc: list[int], i: int, j: int, passage: int, per_edit: int) -> int:
    """Length in item words of the longest passage that holds the match of item[i] and doc[j] and is long enough with
    at most one edit in per_edit words; 0 if there is none. Furthest-reaching paths by edits, to either side."""

    def reach(a: list[int], b: list[int]) -> list[int]:
        # reach[e]: most words of a consumed with e edits, b free to end anywhere
        best: list[int] = []
        row = {0: 0}
        n, m = len(a), len(b)
        for e in range(n // per_edit + passage // per_edit + 2):
            nxt: dict[int, int] = {}
            far = 0
            for d, x in row.items():  # x words of a, x + d of b
                while x < n and x + d < m and a[x] == b[x + d]:
                    x += 1
                row[d] = x
                far = max(far, x)
            best.append(far)
            if far >= n or per_edit * e > far + passage:
                break
            for d, x in row.items():
                y = x + d
                if x < n and y < m:
                    nxt[d] = max(nxt.get(d, 0), x + 1)
                if x < n:
                    nxt[d - 1] = max(nxt.get(d - 1, 0), x + 1)
                if y < m:
                    nxt[d + 1] = max(nxt.get(d + 1, 0), x)
            row = {d: x for d, x in nxt.items() if 0 <= x + d <= m}
            if not row:
                break
        return best

    right, left = reach(item[i:], doc[j:]), reach(item[:i][::-1], doc[:j][::-1])
    most = 0
    for e1, r in enumerate(right):
        for e2, l in enumerate(left):
            n = r + l
            if n >= passage and (e1 + e2) * per_edit <= n:
                most = max(most, n)
    return most


def least_runs(passage: int, per_edit: int, k: int) -> int:
    """Runs of k words that a passage keeps at least: one edit breaks k of them."""
    return max(1, min(n - k + 1 - k * (n // per_edit) for n in range(passage, 10 * passage)))


def hashes_of(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` keeps those seen."""
    import xxhash

    if len(known) > 500_000:
        known.clear()
    return np.fromiter([known[x] if x in known else known.setdefault(x, xxhash.xxh3_64_intdigest(x)) for x in words], np.uint64, len(words))


def probes(run: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each run in a filter of a power of two bits, one row per probe."""
    step = _mix(run + _M1) | np.uint64(1)
    return np.stack([(run + np.uint64(j) * step) >> np.uint64(7) & np.uint64(bits - 1) for j in range(PROBES)])


def in_filter(table: np.ndarray, bits: int, run: np.ndarray) -> np.ndarray:
    """Which runs may be in the filter."""
    at = run
    left = np.arange(len(run))
    for j in range(PROBES):
        step = _mix(at + _M1) | np.uint64(1)
        p = (at + np.uint64(j) * step) >> np.uint64(7) & np.uint64(bits - 1)
        hit = (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, left = at[hit], left[hit]
    return left


def _items(k: int, window: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            ids, words, prints, every = [], [], [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text)
                if len(w) >= passage:
                    h = hashes_of(w, known)
                    runs = run_hashes(h, k)
                    ids.append(item), words.append(h.tobytes()), prints.append(np.unique(runs[winnow(runs, window)]).view(np.int64)), every.append(np.unique(runs).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(prints, pa.list_(pa.int64())), pa.array(every, pa.list_(pa.int64()))], names=["item_id", "item_words", "prints", "item_runs"])

    return run


def _filter_parts(k: int, bits: int):
    """The filter of a partition's items: one row of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, np.bool_)
        for b in batches:
            for w in b.column(0).to_pylist():
                table[probes(run_hashes(np.frombuffer(w, np.uint64), k), bits).reshape(-1).astype(np.int64)] = True
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], names=["part"])

    return run


def flat_runs(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all texts one after the other, where each text begins and the last ends, run hashes, where those begin and end)."""
    import xxhash

    ids: dict[str, int] = {}
    flat: list[int] = []
    starts = [0]
    for t in texts:
        flat.extend([ids[w] if w in ids else ids.setdefault(w, len(ids)) for w in words_of(t)])
        starts.append(len(flat))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
    h = table[np.asarray(flat, np.int64)] if flat else np.zeros(0, np.uint64)
    first = np.asarray(starts, np.int64)
    count = np.maximum(0, np.diff(first) - k + 1)
    every = run_hashes(h, k)
    at = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return h, first, every[at] if len(every) else every, np.concatenate(([0], np.cumsum(count)))


def _documents(shared, k: int, window: int, passage: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        need = least_runs(passage, per_edit, k)
        for b in batches:
            h, first, runs, begins = flat_runs(b.column(1).to_pylist(), k)
            may = np.zeros(len(runs) + 1, np.int64)
            may[in_filter(table, bits, runs)] = 1
            before = np.concatenate(([0], np.cumsum(may)))
            there = np.nonzero(before[begins[1:]] - before[begins[:-1]] >= need)[0]
            words, prints, every, times, ends = [], [], [], [], [0]
            for d in there:
                mine = slice(begins[d], begins[d + 1])
                own, ok = runs[mine], may[mine] == 1
                p = winnow(own, window)
                words.append(h[first[d] : first[d + 1]].tobytes()), prints.append(np.unique(own[p[ok[p]]]).view(np.int64))
                u, c = np.unique(own[ok], return_counts=True)
                every.append(u), times.append(c), ends.append(ends[-1] + len(u))
            known = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in ((every, pa.uint64()), (times, pa.int64()))], ["hash", "times"])
            known = pa.StructArray.from_arrays([known.field(0).view(pa.int64()), known.field(1).cast(pa.int32())], ["hash", "times"])
            known = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(there)), pa.array(words, pa.binary()), pa.array(prints, pa.list_(pa.int64())), known], names=["doc_id", "doc_words", "prints", "doc_runs"])

    return run


def found_passage(item: np.ndarray, doc: np.ndarray, k: int, window: int, passage: int, per_edit: int) -> int:
    """Words of a passage of the item that the document holds, 0 if there is none; both as word hashes. The first hit that extends to
    a passage counts."""
    ri, rd = run_hashes(item, k), run_hashes(doc, k)
    pi, pd = winnow(ri, window), winnow(rd, window)
    order = np.argsort(ri[pi], kind="stable")
    pi = pi[order]
    lo, hi = np.searchsorted(ri[pi], rd[pd], "left"), np.searchsorted(ri[pi], rd[pd], "right")
    a, b = item.tolist(), doc.tolist()
    tried: set[tuple[int, int]] = set()
    for x in np.nonzero(hi > lo)[0]:
        for i in pi[lo[x] : hi[x]].tolist():
            j = int(pd[x])
            while i and j and a[i - 1] == b[j - 1]:  # the start of the unbroken run names the hit
                i, j = i - 1, j - 1
            if (i, j) in tried:
                continue
            tried.add((i, j))
            got = passage_length(a, b, i, j, passage, per_edit)
            if got:
                return got
    return 0


def _extend(k: int, window: int, passage: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [found_passage(np.frombuffer(i, np.uint64), np.frombuffer(d, np.uint64), k, window, passage, per_edit) for d, i in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            t = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32())], names=["doc_id", "item_id", "words"])
            yield t.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return run


def _meet(docs: DataFrame, items: DataFrame, hot_documents: int) -> DataFrame:
    """Rows (row, item_id, times): hashes that both have. docs has row, hash and times, items item_id and of_item; hashes of very many documents are salted."""
    hot = stage(docs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_documents).select(F.col("hash").alias("hot")), "hotprints")
    n_hot = hot.count()
    if not n_hot:
        return docs.join(items, F.col("hash") == F.col("of_item")).select("row", "item_id", "times")
    side = F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot
    left = docs.join(side, docs.hash == side.hot, "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0))
    right = items.join(side, items.of_item == side.hot, "left").withColumn("isalt", F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, (F.col("hash") == F.col("of_item")) & (F.col("salt") == F.col("isalt"))).select("row", "item_id", "times")


def _pairs(docs: DataFrame, items: DataFrame, need: int, hot_documents: int) -> DataFrame:
    """(row, item_id) that share a fingerprint and, counted over all runs, as many as any passage keeps."""
    by_print = _meet(docs.select("row", F.explode("prints").alias("hash"), F.lit(1).alias("times")), items.select("item_id", F.explode("prints").alias("of_item")), hot_documents)
    by_run = _meet(docs.select("row", F.explode("doc_runs").alias("r")).select("row", "r.hash", "r.times"), items.select("item_id", F.explode("item_runs").alias("of_item")), hot_documents)
    many = by_run.groupBy("row", "item_id").agg(F.sum("times").alias("n")).filter(F.col("n") >= need).select("row", "item_id")
    return by_print.select("row", "item_id").distinct().join(many, ["row", "item_id"])


def leaks(documents: DataFrame, items: DataFrame, passage: int = 30, per_edit: int = 10, k: int = 5, window: int = 3, hot_documents: int = HOT_DOCUMENTS, most_filter_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """Rows (doc_id, item_id, words): the document holds a passage of ``passage`` or more words of the item, with at
    most one word in ``per_edit`` changed, dropped or added; words is the length of a passage found.

    Null and empty texts and items shorter than a passage match nothing. A repeated doc_id or item_id gives its pair once
    for each passage length. Empty tables give an empty result; extra columns are ignored.
    """
    if (passage - passage // per_edit) // (passage // per_edit + 1) + bool((passage - passage // per_edit) % (passage // per_edit + 1)) < k + window - 1:
        raise ValueError("k + window - 1 is longer than the unbroken run that a passage must have")
    spark = documents.sparkSession
    src = documents.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    its = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    its = stage(its.mapInArrow(_items(k, window, passage), "item_id long, item_words binary, prints array<long>, item_runs array<long>"), "items")
    runs = its.agg(F.sum(F.length("item_words") / 8)).first()[0] or 0
    bits = 1 << max(10, min(most_filter_bits.bit_length() - 1, int(FILTER_BITS * runs).bit_length()))
    table = np.zeros(bits // 8, np.uint8)
    # a few rows of at most 16 MB, one at a time
    for r in its.select("item_words").coalesce(8).mapInArrow(_filter_parts(k, bits), "part binary").toLocalIterator():
        table |= np.frombuffer(r.part, np.uint8)
    shared = spark.sparkContext.broadcast((table, bits))
    docs = spread(src).mapInArrow(_documents(shared, k, window, passage, per_edit), "doc_id long, doc_words binary, prints array<long>, doc_runs array<struct<hash: long, times: int>>")
    docs = stage(docs.withColumn("row", F.xxhash64("doc_id", "doc_words")), "suspects")
    pairs = stage(_pairs(docs, its, least_runs(passage, per_edit, k), hot_documents), "leakpairs")
    d = docs.select(F.col("row").alias("drow"), "doc_id", "doc_words")
    # an item may be in a third of all documents: its rows are dealt out by document
    salted = its.select(F.col("item_id").alias("iid"), "item_words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("isalt"))
    both = pairs.join(d, F.col("row") == F.col("drow")).withColumn("salt", F.pmod("row", F.lit(SALTS)))
    both = both.join(salted, (F.col("item_id") == F.col("iid")) & (F.col("salt") == F.col("isalt")))
    return both.select("doc_id", "item_id", "doc_words", "item_words").mapInArrow(_extend(k, window, passage, per_edit), "doc_id long, item_id long, words int").distinct()


def leaked_items(found: DataFrame) -> DataFrame:
    """Which items leaked, into how many documents, and the longest passage."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))
