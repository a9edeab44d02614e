"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine similarity to a literal vector: one matrix product per Arrow batch. Null for null and zero vectors, other lengths and a
    zero query. (The same as a higher-order function costs about ten times the CPU, as Spark interprets those per element.)"""
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q))
    unit = q / length if length else q

    @F.arrow_udf(T.DoubleType())
    def similarity(x: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(x), len(unit)), False))
        rows = np.nonzero(fits)[0]
        if len(rows) and length:
            flat = np.asarray(pc.fill_null(pc.cast(x.take(pa.array(rows)).flatten(), pa.float64()), np.nan))
            m = flat.reshape(len(rows), len(unit))
            with np.errstate(all="ignore"):
                out[rows] = (m @ unit) / np.sqrt((m * m).sum(1))
        known = fits & np.isfinite(out)
        return pa.array(out, mask=~known)

    return similarity(v)


def normalized(v: Column, least: float = 1e-10) -> Column:
    """Unit vector; one shorter than ``least`` stays as it is; null and empty stay."""
    n = norm(v)
    return F.when(n < least, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def truncated(v: Column, k: int) -> Column:
    """The first k numbers, normalized again (an exact zero stays); null if there are fewer."""
    s = F.slice(doubles(v), 1, k)
    n = norm(s)
    return F.when(F.size(v) >= k, F.when(n == 0, s).otherwise(F.transform(s, lambda x: x / n)))


def dimension_policy(v: Column, k: int, truncate: bool = True) -> Column:
    """pass, truncate or error: what becomes of a vector where k numbers are wanted (0: no check)."""
    if not k:
        return F.lit("pass")
    return F.when(F.size(v) == k, "pass").when((F.size(v) > k) & F.lit(truncate), "truncate").otherwise("error")


def to_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def from_text(s: Column) -> Column:
    return F.from_json(s, "array<double>")


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two vectors of one length; null for other ones."""
    d = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x)))
