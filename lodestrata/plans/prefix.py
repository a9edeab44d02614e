"""Exact running sums within groups, of which one may hold a third of all rows.

A window over the group would put that group into one task. Here rows are range-partitioned on (group, order), so a
large group spans many partitions; each partition sums on its own, and the offsets of the partitions, one row for each
group and partition it spans, are added afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism, stage

_PID = "__pid"


def running_sums(df: DataFrame, group: list[str], order: list[str], value: str | list[str], out: str | list[str], total: str | None = None) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows of the group before this one in ``order`` (which must be total
    within a group), and ``total``, the sum of the whole group; with lists one sum for each value, and the total of the first. Nulls in ``value`` count as 0. An
    empty input gives an empty result."""
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    zero = [F.coalesce(F.col(v), F.lit(0)) for v in values]
    spark = df.sparkSession
    cut = df.repartitionByRange(parallelism(spark), *[F.col(c) for c in group + order]).withColumn(_PID, F.spark_partition_id())
    cut = stage(cut, "prefix")  # the partition id must not change between the two reads
    part = cut.groupBy(*group, _PID).agg(*[F.sum(z).alias(f"__part{n}") for n, z in enumerate(zero)])
    by_group = Window.partitionBy(*group)
    earlier = by_group.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"__part{n}").over(earlier), F.lit(0)).alias(f"__offset{n}") for n in range(len(values))]
    part = part.select(*group, _PID, *offsets, F.sum("__part0").over(by_group).alias("__total"))
    w = Window.partitionBy(*group, _PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumns({f"__inner{n}": F.coalesce(F.sum(z).over(w), F.lit(0)) for n, z in enumerate(zero)})
    cond = None
    p = part.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(_PID).alias("__p"), *[f"__offset{n}" for n in range(len(values))], "__total")
    for i, c in enumerate(group):
        e = inner[c].eqNullSafe(p[f"__g{i}"])
        cond = e if cond is None else cond & e
    res = inner.join(p, cond & (inner[_PID] == p["__p"]), "left").withColumns({o: F.col(f"__inner{n}") + F.col(f"__offset{n}") for n, o in enumerate(outs)})
    if total:
        res = res.withColumn(total, F.col("__total"))
    return res.drop(_PID, "__total", "__p", *[f"__{x}{n}" for n in range(len(values)) for x in ("inner", "offset")], *[f"__g{i}" for i in range(len(group))])
