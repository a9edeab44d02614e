"""Relations between constructs: calls, cycles of calls, class relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import called_names

#: Weight of each kind of relationship between classes.
RELATION_WEIGHTS = {"inheritance": 0.95, "implements": 0.90, "nested": 0.95, "composition": 0.85, "aggregation": 0.75, "dependency": 0.60}
OTHER_WEIGHT = 0.50


def call_edges(chunks: DataFrame, keys: list[str], name: str = "entity_name", content: str = "content") -> DataFrame:
    """Distinct (keys, caller, callee) of named chunks that call another named chunk with the same keys."""
    c = chunks.filter(F.col(name).isNotNull()).select(*keys, F.col(name).alias("caller"), F.explode(F.array_distinct(called_names(F.col(content)))).alias("callee"))
    known = chunks.select(*keys, F.col(name).alias("callee")).dropna().distinct()
    return c.filter("caller <> callee").join(known, [*keys, "callee"]).select(*keys, "caller", "callee").distinct()


def cycle_members(edges: list[tuple[str, str]]) -> list[str]:
    """Nodes of a graph that reach themselves over its edges, whatever the number of steps, in order of name: those of strongly connected components of
    two or more, and those with an edge to themselves."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    waiting: set[str] = set()
    found = {a for a, b in edges if a == b}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root), waiting.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt), waiting.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in waiting:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        waiting.discard(part[-1])
                        if part[-1] == node:
                            break
                    if len(part) > 1:
                        found.update(part)
    return sorted(found)


def on_cycles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name) of callers that reach themselves, by any number of calls. Nodes without a way in or out are dropped before; the calls left of
    one key (a file) are one task's."""
    live = edges
    for _ in range(2):
        live = live.join(live.select(*keys, F.col("callee").alias("caller")).distinct(), [*keys, "caller"], "left_semi")
        live = live.join(live.select(*keys, F.col("caller").alias("callee")).distinct(), [*keys, "callee"], "left_semi")
    kinds = dict(edges.dtypes)

    def run(key, pdf):
        return type(pdf)([(*key, name) for name in cycle_members(list(zip(pdf["caller"], pdf["callee"])))], columns=[*keys, "name"])

    return live.select(*keys, "caller", "callee").groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", name string")


def relation_weights(relations: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds the weight of each relationship."""
    w = None
    for name, x in RELATION_WEIGHTS.items():
        w = F.when(F.lower(kind) == name, x) if w is None else w.when(F.lower(kind) == name, x)
    return relations.withColumn("weight", w.otherwise(OTHER_WEIGHT))


def inheritance(constructs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, child, parent, kind, weight) from the bases in the signatures of classes, where the parent is known in the same keys."""
    c = constructs.filter(F.col("kind").isin("class", "interface"))
    bases = c.select(*keys, F.col("name").alias("child"), F.explode(F.split(F.regexp_replace(F.coalesce("signature", F.lit("")), r"[()\s]", ""), ",")).alias("parent")).filter("parent <> '' and parent <> child")
    known = c.select(*keys, F.col("name").alias("parent"), F.when(F.col("kind") == "interface", "implements").otherwise("inheritance").alias("kind")).distinct()
    return relation_weights(bases.join(known, [*keys, "parent"]).select(*keys, "child", "parent", "kind"))
