"""Line ranges: overlap joins, the best chunk of a hit, suppression of overlapping hits, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines per band: ranges that overlap share a band, so that the join has an equality on it.
BAND = 64


def _banded(df: DataFrame, start: str, end: str, band: int) -> DataFrame:
    return df.withColumn("__band", F.explode(F.sequence(F.floor(F.col(start) / band), F.floor(F.col(end) / band))))


def overlaps(hits: DataFrame, chunks: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """Inner join of hits (keys, hit_id, hit_start, hit_end) and chunks (keys, id, start_line, end_line) whose ranges overlap, with the
    length of the overlap. Reversed ranges are swapped; rows with null keys or bounds match nothing. Both sides are cut into bands of
    lines, so that a file with very many chunks is no quadratic join; a pair is emitted in its first common band only."""
    h = hits.withColumns({"hit_start": F.least("hit_start", "hit_end"), "hit_end": F.greatest("hit_start", "hit_end")}).dropna(subset=[*keys, "hit_start", "hit_end"])
    c = chunks.withColumns({"start_line": F.least("start_line", "end_line"), "end_line": F.greatest("start_line", "end_line")}).dropna(subset=[*keys, "start_line", "end_line"])
    j = _banded(h, "hit_start", "hit_end", band).join(_banded(c, "start_line", "end_line", band), [*keys, "__band"])
    low, high = F.greatest("hit_start", "start_line"), F.least("hit_end", "end_line")
    j = j.filter((low <= high) & (F.col("__band") == F.floor(low / band)))
    return j.withColumn("overlap", high - low + 1).drop("__band")


def best_overlap(hits: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One chunk per hit: the longest overlap, then the smallest span, the first start, the smallest id."""
    w = Window.partitionBy("hit_id").orderBy(F.col("overlap").desc(), F.col("end_line") - F.col("start_line"), "start_line", "id")
    return overlaps(hits, chunks, keys).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def best_by_name(hits: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One chunk per hit without lines: entity name, then qualified name, signature and content that hold the hit's term; then the
    smallest span (at least 1), the first start, the smallest id. hits: keys, hit_id, term."""
    j = hits.join(chunks, keys)
    t = F.lower("term")
    score = (
        F.when(F.lower("entity_name") == t, 5).when(F.contains(F.lower("entity_name"), t), 4).when(F.contains(F.lower("qualified_name"), t), 3)
        .when(F.contains(F.lower("signature"), t), 2).when(F.contains(F.lower("content"), t), 1).otherwise(0)
    )
    # what was searched stays behind before the rows are ranked
    j = j.withColumn("score", score).drop("content", "signature", "qualified_name", "entity_name")
    w = Window.partitionBy("hit_id").orderBy(F.col("score").desc(), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)), "start_line", "id")
    return j.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def unless_overlapping(text_hits: DataFrame, semantic_hits: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """Text hits without those that overlap a semantic hit in the same file."""
    s = semantic_hits.select(*keys, F.col("start_line"), F.col("end_line"), F.lit(1).alias("id"))
    covered = overlaps(text_hits.select(*keys, "hit_id", "hit_start", "hit_end"), s, keys, band).select("hit_id").distinct()
    return text_hits.join(covered, "hit_id", "left_anti")


def enclosing(members: DataFrame, owners: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """The smallest owner range that holds each member's; members without one are left out. members: keys, id, start_line, end_line;
    owners: keys, owner_id, owner_start, owner_end. An owner never encloses itself. The join is on the band of the member's first line, in which an owner
    that holds it has to be, so that a file of very many constructs is no quadratic join."""
    m = members.withColumn("__band", F.floor(F.col("start_line") / band))
    j = m.join(_banded(owners.dropna(subset=["owner_start", "owner_end"]).filter("owner_start <= owner_end"), "owner_start", "owner_end", band), [*keys, "__band"]).drop("__band")
    j = j.filter("start_line >= owner_start and end_line <= owner_end and owner_id <> id")
    w = Window.partitionBy("id").orderBy(F.col("owner_end") - F.col("owner_start"), "owner_id")
    return j.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def preceding(members: DataFrame, owners: DataFrame, keys: list[str], within: int) -> DataFrame:
    """The nearest owner that ends before each member starts, at most ``within`` lines before (an as-of join): members with owner_id; without one they are left
    out. Of owners that end on one line the smallest id counts. Both are put in one order, so that a file is passed once."""
    o = owners.groupBy(*keys, F.col("owner_end").alias("__at")).agg(F.min("owner_id").alias("owner_id"))
    both = members.select(*keys, F.col("start_line").alias("__at"), F.lit(0).alias("__kind"), F.struct(*members.columns).alias("m"), F.lit(None).cast(o.schema["owner_id"].dataType).alias("owner_id"), F.lit(None).cast("int").alias("__end"))
    both = both.unionByName(o.select(*keys, "__at", F.lit(1).alias("__kind"), F.lit(None).cast(both.schema["m"].dataType).alias("m"), "owner_id", F.col("__at").cast("int").alias("__end")))
    # members of a line come before the owners that end on it
    w = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = both.withColumns({"owner_id": F.last("owner_id", True).over(w), "__end": F.last("__end", True).over(w)})
    return r.filter((F.col("__kind") == 0) & (F.col("__at") - F.col("__end") <= within)).select("m.*", "owner_id")
