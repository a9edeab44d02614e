"""Aggregates over contents, tokens, failures and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import running_sums


def token_total(text: Column) -> Column:
    """Sum of the rough token counts: a quarter of the bytes, at least 1 each."""
    return F.sum(F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)))


def whole_average(x: Column) -> Column:
    """Truncated mean, 0 for no rows."""
    return F.coalesce(F.floor(F.try_divide(F.sum(x), F.count(x))), F.lit(0))


def length_variation(df: DataFrame, text: str) -> DataFrame:
    """(mean_length, variation): the truncated mean length in bytes, and the deviation around that truncated mean over it."""
    x = F.octet_length(text).cast("double")
    a = df.agg(whole_average(F.octet_length(text)).alias("mean_length"), F.avg(x).alias("a"), F.avg(x * x).alias("b"))
    # the mean of (x - m)^2 from one pass
    square = F.col("b") - 2 * F.col("mean_length") * F.col("a") + F.col("mean_length") * F.col("mean_length")
    return a.select("mean_length", F.try_divide(F.sqrt(F.greatest(square, F.lit(0.0))), "mean_length").alias("variation"))


def failure_rates(df: DataFrame, retryable: Column) -> DataFrame:
    """Counts and shares of retryable and permanent failures; shares are 0 without rows."""
    n, r = F.count(F.lit(1)), F.coalesce(F.sum(retryable.cast("long")), F.lit(0))
    return df.agg(n.alias("total"), r.alias("retryable"), (n - r).alias("permanent"), F.coalesce(F.try_divide(r, n), F.lit(0.0)).alias("retryable_share"))


def load_level(utilization: Column) -> Column:
    return F.when(utilization < 0.3, "low").when(utilization < 0.7, "medium").when(utilization < 0.9, "high").otherwise("critical")


def batch_numbers(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds batch_number, from 1, of batches of ``size`` rows within the keys in a total order. A key with a third of all rows is spread."""
    r = running_sums(df.withColumn("__one", F.lit(1)), keys, order, "__one", "__before")
    return r.withColumn("batch_number", F.floor(F.col("__before") / size).cast("long") + 1).drop("__one", "__before")


def resume_point(done: Column, number: Column) -> Column:
    """Highest finished number, 0 if none is."""
    return F.coalesce(F.max(F.when(done, number)), F.lit(0))


def backoff(attempt: Column, base: float, factor: float, cap: float, kind: str = "exponential") -> Column:
    """Delay before an attempt (from 1): base * factor^(attempt - 1), base * attempt or base, at most cap."""
    raw = {"exponential": base * F.pow(F.lit(float(factor)), attempt - 1), "linear": base * attempt, "fixed": F.lit(float(base))}[kind]
    return F.least(raw.cast("double"), F.lit(float(cap)))


def sample_prefix(df: DataFrame, order: list[Column | str], percent: int) -> DataFrame:
    """The first percent of the rows in order, at least one. Only the cut-off rank is computed globally."""
    n = df.count()
    return df.orderBy(*order).limit(max(1, n * percent // 100)) if n else df


def script_counts(text: Column) -> Column:
    """(bytes, characters, latin, cyrillic, greek, digits) of a text."""
    left = lambda rx: F.length(text) - F.length(F.regexp_replace(text, rx, ""))
    return F.struct(F.octet_length(text).alias("bytes"), F.length(text).alias("characters"), left(r"\p{IsLatin}").alias("latin"), left(r"\p{IsCyrillic}").alias("cyrillic"), left(r"\p{IsGreek}").alias("greek"), left(r"\p{Nd}").alias("digits"))


def strategy_choice(df: DataFrame, keys: list[str], kind: str = "chunk_type", content: str = "content") -> DataFrame:
    """(keys, functions, classes, average, strategy) of groups of constructs: class if classes outnumber functions, function if there are functions and the truncated
    average size is under 1000 bytes, size if it is over 2000, else hybrid."""
    count = lambda *kinds: F.count(F.when(F.lower(kind).isin(*kinds), 1))
    g = df.groupBy(*keys).agg(count("function", "method").alias("functions"), count("class", "struct").alias("classes"), F.floor(F.sum(F.coalesce(F.octet_length(content), F.lit(0))) / F.count(F.lit(1))).alias("average"))
    choice = F.when(F.col("classes") > F.col("functions"), "class").when((F.col("functions") > 0) & (F.col("average") < 1000), "function").when(F.col("average") > 2000, "size").otherwise("hybrid")
    return g.withColumn("strategy", choice)


#: Scripts that are counted, and classes of characters in the order in which they are tried.
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana"]
CATEGORIES = [("letter", r"\p{L}"), ("digit", r"\p{Nd}"), ("punctuation", r"\p{P}"), ("space", r"[\t\n\x0B\f\r\u0085\p{Z}]"), ("control", r"[\p{Cc}&&[^\t\n\x0B\f\r\u0085]]"), ("mark", r"\p{M}")]


def unicode_stats(text: Column) -> Column:
    """Struct of bytes, characters, counts by script and by category; what is in none of them is other_script and other_category."""
    n = F.length(text)
    count = lambda rx: F.regexp_count(text, F.lit(rx)).cast("long")
    by_script = {x.lower(): count(rf"\p{{Is{x}}}") for x in SCRIPTS}
    by_category = {name: count(rx) for name, rx in CATEGORIES}
    rest = lambda d: n.cast("long") - sum(d.values(), F.lit(0))
    cols = {"bytes": F.octet_length(text).cast("long"), "characters": n.cast("long"), **by_script, "other_script": rest(by_script), **by_category, "other_category": rest(by_category)}
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def token_counts(df: DataFrame, order: list[str], percent: int, tokens: Column, limit: int) -> DataFrame:
    """(texts, tokens, average, oversized) of the first percent of the rows in a total order, at least one; oversized are over ``limit`` tokens."""
    n = F.count(F.lit(1)).alias("texts")
    t = sample_prefix(df, order, percent).withColumn("__t", tokens)
    return t.agg(n, F.coalesce(F.sum("__t"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.try_divide(F.sum("__t"), F.count("__t")), F.lit(0.0)).alias("average"), F.count(F.when(F.col("__t") > limit, 1)).alias("oversized"))


def priority_rank(priority: Column) -> Column:
    """0 for HIGH, 1 for NORMAL, 2 for LOW, 3 for anything else."""
    p = F.upper(F.trim(priority))
    return F.when(p == "HIGH", 0).when(p == "NORMAL", 1).when(p == "LOW", 2).otherwise(3)


def seconds_between(start: Column, end: Column) -> Column:
    """Duration in seconds, null where either end is."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000
