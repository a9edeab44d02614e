"""Error events: windows of errors by code, alerts, similar groups, cascades, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import code_similarity
from ..plans.components import components
from ..session import stage

#: Severities from the gravest on; thresholds of the alert rule.
SEVERITIES = ["CRITICAL", "ERROR", "WARNING", "INFO"]
CRITICAL_COUNT, ERROR_COUNT, VOLUME, RATE = 1, 3, 10, 1.0


def severity_rank(c: Column) -> Column:
    """0 for the gravest, null for an unknown one."""
    out = F.when(c == SEVERITIES[0], 0)
    for n, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(c == s, n)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def valid_event(code: Column, severity: Column) -> Column:
    return code.rlike("^[a-z0-9_]+$") & (F.length(code) <= 100) & severity.isin(SEVERITIES)


def windows(events: DataFrame, time: str = "ts", code: str = "code", severity: str = "severity", minutes: int = 5) -> DataFrame:
    """Tumbling windows per code: window_start, n, the gravest severity, first and last time, errors per second. Works on streams with a
    watermark as on tables. Invalid events are left out."""
    e = events.filter(valid_event(F.col(code), F.col(severity))).withColumn("__r", severity_rank(F.col(severity)))
    g = e.groupBy(F.window(F.col(time).cast("timestamp"), f"{minutes} minutes").alias("w"), F.col(code).alias("code"))
    g = g.agg(F.count(F.lit(1)).alias("n"), F.min("__r").alias("r"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
    return g.select(F.col("w.start").alias("window_start"), "code", "n", severity_name(F.col("r")).alias("severity"), "first_at", "last_at", (F.col("n") / (minutes * 60.0)).alias("rate"))


def alerts(agg: DataFrame) -> DataFrame:
    """Windows that raise an alert, with its type: critical ones by count, errors by count alone, others by volume or rate."""
    s, n, rate = F.col("severity"), F.col("n"), F.col("rate")
    fire = F.when(s == "CRITICAL", n >= CRITICAL_COUNT).when(s == "ERROR", n >= ERROR_COUNT).otherwise((n >= VOLUME) | (rate > RATE))
    kind = F.when((s == "CRITICAL") | (n >= VOLUME) | (rate > RATE), "REAL_TIME").otherwise("BATCH")
    urgency = F.when(s == "CRITICAL", "CRITICAL").when(n >= VOLUME, "HIGH").otherwise("NORMAL")
    return agg.filter(fire).withColumns({"alert_type": kind, "urgency": urgency})


def similar_pairs(codes: DataFrame, threshold: float, code: str = "code") -> DataFrame:
    """(a, b, similarity) of distinct codes that share words, a < b. The join is on the words, not on all pairs."""
    c = codes.select(F.col(code).alias("c")).distinct()
    w = c.select("c", F.explode(F.array_distinct(F.split(F.substring_index(F.lower("c"), ":", 1), "_"))).alias("word"))
    p = w.select("word", F.col("c").alias("a")).join(w.select("word", F.col("c").alias("b")), "word").filter("a < b").select("a", "b").distinct()
    return p.withColumn("similarity", code_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= threshold)


def greedy_groups(codes: list[str], similarity, threshold: float) -> list[list[str]]:
    """Groups in order: each code that is in no group yet takes all later ones at least as similar as the threshold."""
    out: list[list[str]] = []
    left = sorted(set(codes))
    while left:
        seed, rest = left[0], left[1:]
        group = [seed, *[c for c in rest if similarity(seed, c) >= threshold]]
        out.append(group)
        left = [c for c in rest if c not in set(group)]
    return out


def similarity_groups(codes: DataFrame, threshold: float, code: str = "code") -> DataFrame:
    """(group, code): greedy_groups over all distinct codes; a group is named by its first code. Codes of different components of the similar pairs can't meet, so each component is
    grouped on its own, from its pairs."""
    c = codes.select(F.col(code).alias("c")).dropna().distinct()
    pairs = stage(similar_pairs(c, threshold, "c"), "similar")
    roots = components(pairs.select("a", "b"))
    edges = pairs.join(roots.select(F.col("node").alias("a"), "root"), "a").select("root", "a", "b")

    def run(key, pdf):
        near = {(a, b) for a, b in zip(pdf["a"], pdf["b"])}
        groups = greedy_groups([*pdf["a"], *pdf["b"]], lambda x, y: 1.0 if (x, y) in near else 0.0, 1.0)
        return type(pdf)([(g[0], m) for g in groups for m in g], columns=["group", "code"])

    grouped = edges.groupBy("root").applyInPandas(run, "group string, code string")
    alone = c.join(roots.select(F.col("node").alias("c")), "c", "left_anti")
    return grouped.unionByName(alone.select(F.col("c").alias("group"), F.col("c").alias("code")))


def cascades(agg: DataFrame, seconds: int) -> DataFrame:
    """Windows in which two or more codes failed within ``seconds``: window_start, codes, their key, the gravest severity."""
    span = F.max(F.unix_micros(F.col("last_at").cast("timestamp"))) - F.min(F.unix_micros(F.col("first_at").cast("timestamp")))
    g = agg.groupBy("window_start").agg(F.count(F.lit(1)).alias("codes"), span.alias("span"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("key"), F.min(severity_rank(F.col("severity"))).alias("r"))
    return g.filter((F.col("codes") >= 2) & (F.col("span") <= seconds * 1_000_000)).select("window_start", "codes", "key", severity_name(F.col("r")).alias("severity"))


def _starts(keys: int, seconds: int):
    """From (keys, second) in order to (keys, second, start): the window of ``seconds`` that holds the second, begun by the first one that no earlier window holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, 0
        for b in batches:
            out = []
            for *key, t in zip(*(b.column(c).to_pylist() for c in range(keys + 1))):
                if key != last or t - start > seconds:
                    last, start = key, t
                out.append(start)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(keys + 1)), pa.array(out, pa.int64())], names=[*b.schema.names, "__start"])

    return run


def window_starts(events: DataFrame, key: list[str], time: str, seconds: int) -> DataFrame:
    """Adds __start, the second in which the event's window began: windows begin at the first event of a key that is more than ``seconds`` after the start of
    the window before, not at the clock's. One thing follows from the other, so a key's distinct seconds pass through one task in order; nothing is held but the last start."""
    e = events.withColumn("__s", F.unix_seconds(F.col(time).cast("timestamp")))
    per = e.select(*key, "__s").dropna(subset=["__s"]).distinct().repartition(*key).sortWithinPartitions(*key, "__s")
    kinds = dict(e.dtypes)
    found = per.mapInArrow(_starts(len(key), seconds), ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", __s long, __start long")
    found = found.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(key)], F.col("__s").alias("__t"), "__start")
    on = e["__s"] == found["__t"]
    for n, k in enumerate(key):
        on = on & e[k].eqNullSafe(found[f"__k{n}"])
    return e.join(found, on).drop("__t", *[f"__k{n}" for n in range(len(key))])


def first_in_window(events: DataFrame, key: list[str], time: str, seconds: int) -> DataFrame:
    """Events without the duplicates of a key that fall within ``seconds`` of the first kept one; the next one after that is kept again. Of events in the kept second
    the earliest stays."""
    j = window_starts(events, key, time, seconds).filter("__s = __start")
    w = Window.partitionBy(*key, "__s").orderBy(time)
    return j.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__s", "__start")


def duplicates_in_window(events: DataFrame, key: list[str], time: str, seconds: int, threshold: int) -> DataFrame:
    """One row per window of a key: first_at, last_at, n events and whether further alerts are suppressed, as they are from ``threshold`` on."""
    g = window_starts(events, key, time, seconds).groupBy(*key, "__start").agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count(F.lit(1)).alias("n"))
    return g.drop("__start").withColumn("suppressed", F.col("n") >= threshold)


def windows_from_first(events: DataFrame, time: str = "ts", code: str = "code", severity: str = "severity", minutes: int = 5, most: int = 10_000, tolerance: int = 1) -> DataFrame:
    """windows that begin with a code's first event instead of at the clock's: first_at, code, n (at most ``most``), the gravest severity, last_at. An event up to
    ``tolerance`` seconds after the window's end still belongs to it. Invalid events are left out."""
    e = events.filter(valid_event(F.col(code), F.col(severity))).withColumn("__r", severity_rank(F.col(severity)))
    g = window_starts(e, [code], time, minutes * 60 + tolerance).groupBy(F.col(code).alias("code"), "__start")
    g = g.agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"), F.min("__r").alias("r"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
    return g.select("first_at", "code", "n", severity_name(F.col("r")).alias("severity"), "last_at")


def latest(events: DataFrame, time: str, n: int) -> DataFrame:
    """What a ring buffer of n entries holds at the end: the n latest events."""
    return events.orderBy(F.col(time).desc()).limit(n)
