"""Changes to stored tables as survivor rows: nothing is updated in place, a new version of the table is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_KEY = ["repository_id", "file_path", "content_hash"]


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order. Spark cuts each sorted partition to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: list[str], fill: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """old merged with new on unique keys: ``replace`` columns come from the new row, ``fill`` ones too unless null there, ``keep`` ones stay; rows
    only in new are added as they are. Applying the same new rows twice changes nothing."""
    cols = [*keys, *replace, *fill, *keep]
    j = old.select(*keys, F.struct(*cols).alias("o")).join(new.select(*keys, F.struct(*cols).alias("n")), keys, "full_outer")
    has = F.col("n").isNotNull()

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        v = F.when(has, n).otherwise(o) if c in replace else F.coalesce(n, o) if c in fill else F.when(F.col("o").isNotNull(), o).otherwise(n)
        return v.alias(c)

    return j.select(*keys, *[pick(c) for c in cols if c not in keys])


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks keyed by repository, path and content hash: the existing id stays, lines are replaced, token counts are filled."""
    rest = [c for c in old.columns if c not in {*CHUNK_KEY, "start_line", "end_line", "token_count", "token_counted_at"}]
    return upsert(old, new, CHUNK_KEY, ["start_line", "end_line"], ["token_count", "token_counted_at"], rest)


def find_or_create(old: DataFrame, new: DataFrame, ordinal: str) -> DataFrame:
    """(ordinal, id): the stored id of each incoming chunk, its own where the key is new; of equal keys the first incoming row counts."""
    mine = first_by(new, CHUNK_KEY, [ordinal]).select(*CHUNK_KEY, F.col("id").alias("own"))
    ids = mine.join(old.select(*CHUNK_KEY, F.col("id").alias("stored")), CHUNK_KEY, "left").select(*CHUNK_KEY, F.coalesce("stored", "own").alias("id"))
    return new.select(*CHUNK_KEY, ordinal).join(ids, CHUNK_KEY).select(ordinal, "id")


def conflict_outcomes(old: DataFrame, new: DataFrame, keys: list[str], action: str) -> DataFrame:
    """Counts by outcome under an action on conflict: do_nothing (skipped), update (updated) or error (failed)."""
    hit = {"do_nothing": "skipped", "update": "updated", "error": "failed"}[action]
    j = new.select(*keys).join(old.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
    return j.groupBy(F.when(F.col("__hit"), hit).otherwise("inserted").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def soft_delete(df: DataFrame, match: Column, now: Column) -> DataFrame:
    """deleted_at is set where the live row matches."""
    return df.withColumn("deleted_at", F.when(F.coalesce(match, F.lit(False)) & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))


def hard_delete(df: DataFrame, match: Column) -> DataFrame:
    """Rows that don't match; a null condition keeps the row."""
    return df.filter(~F.coalesce(match, F.lit(False)))


def remapped(values: Column, table: dict[str, str]) -> Column:
    """Values of an enumeration under their new names; others stay."""
    out = None
    for old, new in table.items():
        out = F.when(values == old, new) if out is None else out.when(values == old, new)
    return values if out is None else out.otherwise(values)


def fetched(asked: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(stored rows of the asked keys, asked keys that aren't stored)."""
    k = asked.select(key).dropna().distinct()
    return stored.join(k, key, "left_semi"), k.join(stored.select(key), key, "left_anti")


def orphans(child: DataFrame, parents: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Child rows of which one of the parents is missing: (parent, child column, parent column) each."""
    out = None
    seen: DataFrame = child
    for parent, c, p in parents:
        key = parent.select(F.col(p).alias("__p")).distinct()
        gone = seen.join(key, seen[c] == key["__p"], "left_anti")
        out = gone if out is None else out.unionByName(gone)
        seen = seen.join(key, seen[c] == key["__p"], "left_semi")
    return out


def backfill(target: DataFrame, source: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """target with the columns filled from source (unique on the keys) where they are null."""
    s = source.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    j = target.join(s, on, "left")
    return j.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in target.columns])


def reconcile(stored: DataFrame, declared: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action) of what a declared list asks for: create, update where a column differs, keep; extra stored rows are left alone."""
    s = stored.select(key, F.struct(*columns).alias("s"))
    j = declared.select(key, F.struct(*columns).alias("d")).join(s, key, "left")
    action = F.when(F.col("s").isNull(), "create").when(~F.col("s").eqNullSafe(F.col("d")), "update").otherwise("keep")
    return j.select(key, action.alias("action"))
