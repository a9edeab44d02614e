"""Listing of stored entities: filters, sort keys, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names one request may ask for.
MAX_NAMES = 50
#: Sort keys that a listing accepts.
REPOSITORY_ORDER = ("name", "created_at", "updated_at")
CONNECTOR_ORDER = ("name", "created_at")


def matching(df: DataFrame, equal: dict[str, str] | None = None, like: dict[str, str] | None = None) -> DataFrame:
    """Rows with equal columns and with columns that contain a pattern in any case; % and _ are wildcards; None is no restriction."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    for c, v in (like or {}).items():
        if v is not None:
            df = df.filter(F.lower(c).like(f"%{v.lower()}%"))
    return df


def order(allowed: tuple[str, ...], spec: str, tie: str = "id") -> list[Column]:
    """Sort columns of 'name' or 'name:desc', nulls last when rising and first when falling, ties by id; ValueError for another key."""
    key, _, way = spec.partition(":")
    if key not in allowed or way not in ("", "asc", "desc"):
        raise ValueError(f"cannot sort by {spec!r}")
    c = F.col(key)
    return [c.desc_nulls_first() if way == "desc" else c.asc_nulls_last(), F.col(tie)]


def resolve_names(asked: DataFrame, repositories: DataFrame, strict: bool = False) -> DataFrame:
    """asked names with the latest repository whose name contains them. ``asked`` is a request's list of names: at most 50. A name that none contains is left
    out, or with ``strict`` an error."""
    names = asked.select("asked").distinct()
    if len(names.take(MAX_NAMES + 1)) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    j = repositories.join(F.broadcast(names), F.lower("name").contains(F.lower("asked")))
    w = Window.partitionBy("asked").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    found = j.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    if strict:
        unknown = [r.asked for r in names.join(found.select("asked"), "asked", "left_anti").collect()]
        if unknown:
            raise ValueError(f"no repository for {', '.join(sorted(unknown))}")
    return found
