"""Mixing sources to target weights: proportionate fair (Pfair) scheduling of blocks.

Sizes are token counts. The mix is as large as all documents together. Each source gets its target share of it, repeating
every document up to the source's cap; the shares that the mix then holds are counted from its rows. The order of the mix is a schedule of
blocks of at most ``block_tokens`` tokens: the i-th block of a source of weight w is released at slot floor((i - 1) / w) and due at slot
ceil(i / w), and the earliest deadline among the released ones runs next. So after any slot each source is within one
block of its share. Documents are cut where blocks end.

A mix of more than ROUND_SLOTS blocks is made of equal rounds: each source gives the same number of blocks in every round, so one schedule holds for all
of them, the driver's work is bounded at any size, and at the end of a round no source is ahead or behind. (A source of fewer tokens than there are rounds
leaves some of its slots empty.) Documents find their blocks by
a running sum of tokens within the source (plans.prefix), so that a source with a third of all rows stays spread.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.prefix import running_sums
from ..session import spread, stage
from .tokens import VOCABULARY, token_count

#: Blocks in one round of the schedule, about; sources with a small share get one each on top.
ROUND_SLOTS = 1_000_000


def source_name(c: str = "source"):
    return F.lower(F.trim(F.regexp_replace(F.col(c), r"^[\s\u00a0]+|[\s\u00a0]+$", "")))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a source and a text, the source trimmed and in lower case.
    Null and empty sources and texts are left out."""
    d = documents.select("doc_id", source_name().alias("source"), "text").filter((F.col("source") != "") & (F.col("text") != ""))
    return stage(spread(d).select("doc_id", "source", token_count(vocabulary)("text").alias("tokens")), "tokens")


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source with a target: available tokens, target tokens, repeats needed, tokens used and the shares.

    This is the plan, from which the schedule is made; mixed_shares has what the mix holds. ``repeats`` is the (fractional) number of times each document is used, at most max_repeats; ``reached`` is the share of
    the mix's full size, ``short`` whether it stays below target_share. Sources without documents reach 0. A source
    listed twice in targets counts with the sum of its shares and its largest cap; null shares or caps count as 0.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    total = F.lit(sizes.agg(F.sum("tokens")).first()[0] or 0).cast("long")
    t = targets.select(source_name().alias("source"), "target_share", "max_repeats").filter(F.col("source") != "")
    t = t.groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    r = t.join(have, "source", "left").na.fill(0, ["tokens", "documents"]).withColumn("mix_tokens", total)
    want = F.col("target_share") * F.col("mix_tokens")
    r = r.withColumn("target_tokens", want).withColumn("most_tokens", (F.col("tokens") * F.col("max_repeats")).cast("double"))
    r = r.withColumn("used_tokens", F.least(F.ceil("target_tokens"), F.col("most_tokens").cast("long")))
    r = r.withColumn("repeats", F.coalesce(F.try_divide("used_tokens", "tokens"), F.lit(0.0)))
    r = r.withColumn("reached", F.coalesce(F.try_divide("used_tokens", "mix_tokens"), F.lit(0.0)))
    return r.withColumn("short", F.col("most_tokens") < F.col("target_tokens"))


def pfair_slots(weights: dict[str, float]) -> Iterator[str]:
    """Source of each slot, without end, by earliest deadline among the released blocks. Weights are taken relative to their sum;
    non-positive ones get no block. After t slots every source of weight w has between wt - 1 and wt + 1 blocks, both exclusive."""
    exact = {s: Fraction(w).limit_denominator(10**9) for s, w in weights.items() if w and w > 0}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    w = {s: int(x * scale) for s, x in exact.items()}
    total = sum(w.values())
    if not total:
        return
    waiting = [(0, s, 1) for s in w]  # (release, source, number of the block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    for t in count():
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            due, rest = divmod(i * total, w[s])
            # among equal deadlines the block whose window overlaps the next one goes first
            heapq.heappush(ready, (due + (rest > 0), 0 if rest else 1, s, i))
        _, _, s, i = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, (i * total // w[s], s, i + 1))


def pfair_schedule(weights: dict[str, float], slots: int) -> list[str]:
    """The first slots of pfair_slots."""
    return list(islice(pfair_slots(weights), slots))


def round_blocks(used: dict[str, int], block_tokens: int) -> tuple[int, dict[str, int]]:
    """(rounds, blocks of each source in a round) such that no block is larger than block_tokens."""
    rounds = max(1, math.ceil(sum(used.values()) / block_tokens / ROUND_SLOTS))
    return rounds, {s: math.ceil(n / rounds / block_tokens) for s, n in used.items() if n > 0}


def _schedule(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """Rows (of, place, slot) of one round: the slot of each of a source's blocks."""
    order = pfair_schedule({s: float(n) for s, n in blocks.items()}, sum(blocks.values()))
    seen: dict[str, int] = {}
    places = []
    for s in order:
        places.append(seen.get(s, 0))
        seen[s] = places[-1] + 1
    rows = pa.table({"of": pa.array(order, pa.string()), "place": pa.array(places, pa.int64()), "slot": pa.array(range(len(order)), pa.int64())})
    return spark.createDataFrame(rows, "of string, place long, slot long")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _pieces(sizes: DataFrame, plan: DataFrame, block_tokens: int) -> DataFrame:
    """mix, from the sizes and a stored plan."""
    spark = sizes.sparkSession
    used = {r.source: r.used_tokens for r in plan.select("source", "used_tokens").filter("used_tokens > 0").collect()}  # one row per target
    rounds, blocks = round_blocks(used, block_tokens)
    per_round = sum(blocks.values())
    counts = spark.createDataFrame([(s, used[s], n, n * rounds) for s, n in blocks.items()], "source string, used_tokens long, in_round long, blocks long")
    runs = running_sums(sizes, ["source"], ["doc_id"], "tokens", "before", "all_tokens")
    uses = runs.join(F.broadcast(counts), "source")  # as many rows as there are targets
    passes = F.ceil(_exact("used_tokens") / _exact("all_tokens")).cast("int")
    uses = uses.withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    uses = uses.withColumn("start", F.col("before") + (F.col("pass") - 1) * F.col("all_tokens")).filter("start < used_tokens")
    uses = uses.withColumn("end", F.least(F.col("start") + F.col("tokens"), F.col("used_tokens")))
    # block g holds the source's tokens from floor(g x used / blocks) on; the decimals keep that exact
    uses = uses.withColumns({"u": _exact("used_tokens"), "n": _exact("blocks")})
    first, last = F.expr("((cast(start + 1 as decimal(19,0)) * n) - 1) div u"), F.expr("((cast(end as decimal(19,0)) * n) - 1) div u")
    cut = uses.withColumn("block", F.explode(F.sequence(first, last)))
    begins, ends = F.expr("(cast(block as decimal(19,0)) * u) div n"), F.expr("(cast(block + 1 as decimal(19,0)) * u) div n")
    cut = cut.withColumns({"from": F.greatest("start", begins), "to": F.least("end", ends)}).filter("from < to")
    cut = cut.withColumns({"round": F.expr("block div in_round"), "place": F.col("block") % F.col("in_round")})
    slots = _schedule(spark, blocks)
    placed = cut.join(slots, (F.col("source") == F.col("of")) & (cut["place"] == slots["place"]))
    slot = F.col("round") * F.lit(per_round) + F.col("slot")
    return placed.select(slot.alias("slot"), "source", "pass", "doc_id", (F.col("from") - F.col("start")).alias("first_token"), (F.col("to") - F.col("from")).alias("tokens"))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = 4096) -> DataFrame:
    """The mix itself: rows (slot, source, pass, doc_id, first_token, tokens), one per piece of a document in a block, to be read in order of
    slot, pass, doc_id and first_token.

    Every pass over a source uses its documents in order of doc_id; the last pass ends where the target is reached, be it within a
    document. Rows of sources without a target are not used; ``targets`` is held by the driver. Empty tables give an
    empty result.
    """
    sizes = sized(documents, vocabulary)
    return _pieces(sizes, stage(shares(sizes, targets), "shares"), block_tokens)


def mixed_shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = 4096) -> DataFrame:
    """shares, with what the scheduled mix holds in place of the plan.

    ``mixed_tokens`` sums the pieces in the source's slots, ``reached`` is their share of the mix's full size, ``mixed_share`` of all that the
    mix holds (these sum to 1), ``short`` whether they are fewer than target_tokens.
    """
    sizes = sized(documents, vocabulary)
    plan = stage(shares(sizes, targets), "shares")
    held = stage(_pieces(sizes, plan, block_tokens).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens")), "held")
    total = F.lit(held.agg(F.sum("mixed_tokens")).first()[0] or 0)
    r = plan.join(held, "source", "left").na.fill(0, ["mixed_tokens"])
    share = lambda c: F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), c), F.lit(0.0))
    r = r.withColumn("reached", share(F.col("mix_tokens"))).withColumn("mixed_share", share(total))
    return r.withColumn("short", F.col("mixed_tokens") < F.col("target_tokens"))
