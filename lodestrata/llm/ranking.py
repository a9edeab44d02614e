"""One ranking from several scores on different scales: outranking net flow.

Within a query every engine compares all pairs of candidates by a preference function of the difference of their percentiles among
its own scores: the usual one (1 for a higher percentile, else 0), or a linear one, 0 up to a threshold of indifference, 1 from a threshold of preference on and
rising between. The net flow of a candidate in an engine is the sum of its preferences over the others minus the sum of theirs over it,
divided by the number of others; flows are weighted (equally by default) and
summed. Nothing but order within the engine enters, so neither range nor distribution can dominate.

Pairs are never formed: the candidates below one are a prefix sum over the engine's sorted distinct scores, above it the
group's total minus that; the linear part needs the prefix sums of counts and percentiles at four places around each. The sums are made over range partitions
(plans.prefix), so a query with a third of all rows
is spread. A candidate without a score in an engine (no row, null, NaN) lies below all that have one and ties with the
other missing ones: with n candidates and m scored ones a scored one beats the n - m missing, a missing one loses to m.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import running_sums


def net_flow(scores: DataFrame, weights: dict[str, float] | None = None, preference: tuple[float, float] | None = None, query: str = "query_id", item: str = "chunk_id", engine: str = "source_engine", score: str = "similarity") -> DataFrame:
    """Rows (query, item, net_flow) of all candidates, flow within -1 to 1.

    Engine names are trimmed and compared in lower case; rows with a null engine make their item a candidate but score
    nothing. Of several rows of one (query, item, engine) the highest score counts, once. Rows with a null query or item
    are ignored. Ties share the flow. A single candidate has flow 0. ``weights`` maps engine names to weights, others
    weigh 1. ``preference`` gives the thresholds of indifference and preference, 0 <= q < p, in percentiles from 0 to 1 (midranks; a sole answer
    differs from none); without it the usual function holds. Extra columns are ignored; an empty table gives an empty result.
    """
    if preference is not None and not 0 <= preference[0] < preference[1]:
        raise ValueError("the thresholds are 0 <= indifference < preference")
    s = scores.select(F.col(query).alias("q"), F.col(item).alias("i"), F.lower(F.trim(F.col(engine))).alias("e"), F.col(score).cast("double").alias("s"))
    s = s.filter(F.col("q").isNotNull() & F.col("i").isNotNull())
    s = s.withColumn("s", F.when(~F.isnan("s"), F.when(F.col("s") == 0, F.lit(0.0)).otherwise(F.col("s"))))
    # one row per answer; null where the engine gave the item no usable score
    best = s.groupBy("q", "i", "e").agg(F.max("s").alias("s"))
    answers = best.filter(F.col("s").isNotNull() & F.col("e").isNotNull())
    levels = answers.groupBy("q", "e", "s").agg(F.count(F.lit(1)).alias("c"))
    levels = running_sums(levels, ["q", "e"], ["s"], "c", "below", "m")
    weight = F.lit(1.0)
    for name, w in sorted((weights or {}).items()):
        weight = F.when(F.col("e") == name.strip().lower(), F.lit(float(w))).otherwise(weight)
    # flow x (n - 1) of a scored item: below + (n - m) - above = 2 below + c + n - 2m; of a missing one: -m
    # below + (n - m) - above, or with a linear function what takes the place of below - above
    levels = levels.withColumn("net", 2 * F.col("below") + F.col("c") - F.col("m")) if preference is None else _linear(levels, *preference)
    gain = levels.select(F.col("q").alias("lq"), F.col("e").alias("le"), F.col("s").alias("ls"), (weight * F.col("net")).alias("gain"), weight.alias("w"))
    lost = levels.groupBy("q", "e").agg(F.max("m").alias("m")).groupBy("q").agg(F.sum(weight * F.col("m")).alias("lost"), F.sum(weight).alias("all_w"))
    ranked = best.join(gain, (best.q == gain.lq) & (best.e == gain.le) & (best.s == gain.ls), "left")
    ranked = ranked.groupBy("q", "i").agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("in_w"))
    size = best.groupBy("q", "i").agg(F.lit(1).alias("one")).groupBy("q").agg(F.count("one").alias("n"))
    per_query = size.join(lost, "q", "left").select(F.col("q"), "n", F.coalesce("lost", F.lit(0.0)).alias("lost"), F.coalesce("all_w", F.lit(0.0)).alias("all_w"))
    scale = (F.col("n") - 1) * F.col("all_w")
    flow = F.when(scale > 0, (F.col("gain") + F.col("n") * F.col("in_w") - F.col("lost")) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))
    return ranked.join(per_query, "q").select(F.col("q").alias(query), F.col("i").alias(item), F.round(flow, 12).alias("net_flow"))


def _linear(levels: DataFrame, indifference: float, preference: float) -> DataFrame:
    """Adds net, the preferences of a level over all scored candidates minus theirs over it, to (q, e, s, c, below, m).

    Ranks run from 0 to 2 (m - 1), so that midranks are whole numbers. With N and S the count and the sum of ranks up to a place, the preferences over lower ones are
    N(x - p) + ((x - q) (N(x - q) - N(x - p)) - (S(x - q) - S(x - p))) / (p - q), and likewise upwards.
    """
    lv = levels.withColumns({"x": (2 * F.col("below") + F.col("c") - 1).cast("double"), "span": 2.0 * (F.col("m") - 1)})
    places = [-preference, -indifference, indifference, preference]
    points = lv.select("q", "e", "s", F.col("x").alias("v"), F.lit(0).alias("kind"), "c", (F.col("c") * F.col("x")).alias("cx"))
    for n, shift in enumerate(places, 1):
        points = points.unionByName(lv.select("q", "e", "s", (F.col("x") + shift * F.col("span")).alias("v"), F.lit(n).alias("kind"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("cx")))
    sums = running_sums(points, ["q", "e"], ["v", "kind", "s"], ["c", "cx"], ["n", "t"]).filter("kind > 0")
    at = sums.groupBy("q", "e", "s").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, 5) for c in ("n", "t")])
    at = at.select(*[F.col(c).alias(f"a{c}") for c in ("q", "e", "s")], *[f"{c}{k}" for k in range(1, 5) for c in ("n", "t")])
    j = lv.join(at, (lv.q == at.aq) & (lv.e == at.ae) & (lv.s == at["as"]))
    q, width = F.lit(indifference) * F.col("span"), F.lit(preference - indifference) * F.col("span")
    over = F.col("n1") + ((F.col("x") - q) * (F.col("n2") - F.col("n1")) - (F.col("t2") - F.col("t1"))) / F.nullif(width, F.lit(0.0))
    under = F.col("m") - F.col("n4") + ((F.col("t4") - F.col("t3")) - (F.col("x") + q) * (F.col("n4") - F.col("n3"))) / F.nullif(width, F.lit(0.0))
    return j.withColumn("net", F.coalesce(over - under, F.lit(0.0))).select("q", "e", "s", "c", "below", "m", "net")


def leaders(flows: DataFrame, k: int = 5, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The k items of each query with the highest net flow; ties go to the smaller item id. Fewer than k candidates give
    fewer rows. Spark limits each sort partition to k rows before the shuffle, so a large query isn't gathered."""
    w = Window.partitionBy(query).orderBy(F.col("net_flow").desc(), F.col(item))
    return flows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
