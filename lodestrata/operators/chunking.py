"""Cutting texts and source files into chunks, and the context and quality of chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread


def cut_lines(text: str, size: int) -> list[tuple[int, int, str]]:
    """(start line, end line, content) of greedy pieces of at most ``size`` bytes, whole lines each; the text as it is if it fits. A longer
    line stays whole. Every line of a cut text ends with a line end, the last one too."""
    if len(text.encode()) <= size:
        return [(1, 1 + text.count("\n"), text)] if text.strip() else []
    out: list[tuple[int, int, str]] = []
    buf: list[str] = []
    used, start = 0, 1
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        length = len(line.encode()) + 1
        if buf and used + length > size:
            out.append((start, n - 1, "\n".join(buf) + "\n"))
            buf, used, start = [], 0, n
        buf.append(line)
        used += length
    if buf:
        out.append((start, len(lines), "\n".join(buf) + "\n"))
    return [p for p in out if p[2].strip()]


def line_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1000) -> DataFrame:
    """(id, ord, start_line, end_line, content) of every text; null and blank texts and pieces give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rest = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for n, p in enumerate(cut_lines(t or "", size), 1):
                    ids.append(k)
                    rest.append((n, *p))
            cols = list(zip(*rest)) if rest else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["id", "ord", "start_line", "end_line", "content"])

    kind = dict(df.dtypes)[id_col]
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).mapInArrow(run, f"id {kind}, ord int, start_line int, end_line int, content string")


@dataclass(frozen=True)
class Piece:
    """A construct of a file: type, name, bytes and language."""

    kind: str
    name: str
    start: int
    end: int
    language: str

    @property
    def size(self) -> int:
        return self.end - self.start


MAJOR = ("class", "interface", "struct", "enum", "module")
WHOLE = ("interface", "enum", "constant")


def group_functions(pieces: list[Piece], limit: int = 1500, gap: int = 500) -> list[list[Piece]]:
    """Neighbouring pieces by position: a new group at a major construct, another language, a gap over ``gap`` bytes or beyond
    ``limit`` bytes in all."""
    groups: list[list[Piece]] = []
    used = 0
    for p in sorted(pieces, key=lambda x: (x.start, x.end, x.name)):
        last = groups[-1][-1] if groups else None
        if last is None or p.kind in MAJOR or last.kind in MAJOR or p.language != last.language or p.start - last.end > gap or used + p.size > limit:
            groups.append([])
            used = 0
        groups[-1].append(p)
        used += p.size
    return groups


def pack_sizes(pieces: list[Piece], limit: int, least: int = 0, overlap: int = 0) -> list[list[Piece]]:
    """Greedy packing up to ``limit`` bytes; a group starts with the trailing pieces of the one before that fit into ``overlap``. Last, a
    group under ``least`` bytes joins the one before."""
    groups: list[list[Piece]] = []
    current: list[Piece] = []
    used = 0
    for p in sorted(pieces, key=lambda x: (x.start, x.end, x.name)):
        if current and used + p.size > limit:
            groups.append(current)
            tail: list[Piece] = []
            room = overlap
            for q in reversed(current):
                if q.size > room:
                    break
                tail.insert(0, q)
                room -= q.size
            current, used = tail, sum(q.size for q in tail)
        current.append(p)
        used += p.size
    if current:
        groups.append(current)
    if len(groups) > 1 and sum(p.size for p in groups[-1]) < least:
        groups[-2:] = [groups[-2] + [p for p in groups[-1] if p not in groups[-2]]]
    return groups


def split_points(size: int, limit: int) -> list[tuple[int, int]]:
    """Byte ranges of a piece of at least twice the limit, at three quarters of it each; one range otherwise."""
    if size < 2 * limit:
        return [(0, size)]
    step = max(1, limit * 3 // 4)
    return [(a, min(size, a + step)) for a in range(0, size, step)]


def split_large(pieces: list[Piece], limit: int) -> list[Piece]:
    """Pieces of at least twice the limit in parts of three quarters of it; interfaces, enumerations and constants stay whole."""
    return [Piece(p.kind, p.name, p.start + a, p.start + b, p.language) for p in pieces for a, b in ([(0, p.size)] if p.kind in WHOLE else split_points(p.size, limit))]


def large_function_parts(text: str, threshold: int = 10_240, size: int = 5_120) -> list[tuple[int, int, str]]:
    """(start line, end line, content) of a function over ``threshold`` bytes in parts of about ``size`` bytes, cut between lines; of a smaller one as it is."""
    return cut_lines(text, size if len(text.encode()) > threshold else threshold)


def group_classes(pieces: list[Piece], limit: int = 1500, gap: int = 500) -> list[list[Piece]]:
    """Every outermost class-like piece with the pieces inside it; what stands in no class is grouped as by functions. A class group beyond
    ``limit`` bytes of members is packed by size, the class itself in front of the first part."""
    ordered = sorted(pieces, key=lambda x: (x.start, -x.end, x.name))
    groups: list[list[Piece]] = []
    orphans: list[Piece] = []
    owner: Piece | None = None
    for p in ordered:
        if owner and p.end <= owner.end:
            groups[-1].append(p)
        elif p.kind in MAJOR:
            owner = p
            groups.append([p])
        else:
            orphans.append(p)
    out: list[list[Piece]] = []
    for head, *members in groups:
        parts = pack_sizes(members, limit) if sum(m.size for m in members) > limit else [members]
        out += [[head, *parts[0]], *parts[1:]]
    return sorted(out + group_functions(orphans, limit, gap), key=lambda g: (g[0].start, g[0].end, g[0].name))


def group_hybrid(pieces: list[Piece], limit: int = 1500, gap: int = 500, least: int = 100) -> list[list[Piece]]:
    """Groups as by functions, refined by size: one beyond the limit is packed anew, one under ``least`` bytes joins the one before if both fit."""
    out: list[list[Piece]] = []
    for g in group_functions(pieces, limit, gap):
        for part in pack_sizes(g, limit) if sum(p.size for p in g) > limit else [g]:
            size = sum(p.size for p in part)
            if out and size < least and sum(p.size for p in out[-1]) + size <= limit and out[-1][-1].language == part[0].language:
                out[-1] = out[-1] + part
            else:
                out.append(part)
    return out


def suited_strategy(pieces: list[Piece]) -> str:
    """The strategy that suits a file: see stats.strategy_choice."""
    functions, classes = sum(p.kind in ("function", "method") for p in pieces), sum(p.kind in ("class", "struct") for p in pieces)
    average = sum(p.size for p in pieces) // max(1, len(pieces))
    return "class" if classes > functions else "function" if functions and average < 1000 else "size" if average > 2000 else "hybrid"


STRATEGIES = ("function", "class", "size", "hybrid", "adaptive")


def groups_of(pieces: list[Piece], strategy: str, limit: int = 1500, overlap: int = 0) -> list[list[Piece]]:
    if strategy == "adaptive":
        strategy = suited_strategy(pieces)
    if strategy == "size":
        return pack_sizes(split_large(pieces, limit), limit, limit // 10, overlap)
    return {"function": group_functions, "class": group_classes, "hybrid": group_hybrid}[strategy](pieces, limit)


def grouped(df: DataFrame, keys: list[str], strategy: str = "function", limit: int = 1500, overlap: int = 0) -> DataFrame:
    """Adds group_no to constructs (keys, kind, name, start_byte, end_byte, language) per file, by one of STRATEGIES. Constructs of a file, not of a
    repository, are held at a time: they stream by, sorted within partitions of whole files. With an overlap a construct has a row in each of its groups."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported strategy {strategy!r}")
    cols = ["kind", "name", "start_byte", "end_byte", "language"]
    src = df.select(*keys, *cols)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], []

        def flush() -> None:
            if key is not None:
                for number, g in enumerate(groups_of(held, strategy, limit, overlap), 1):
                    rows.extend((*key, p.kind, p.name, p.start, p.end, p.language, number) for p in g)

        def out() -> pa.RecordBatch:
            made = list(zip(*rows)) if rows else [()] * (n + 6)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, [*schema.types, pa.int32()])], names=[*keys, *cols, "group_no"])

        schema = None
        for b in batches:
            schema = b.schema
            for *k, kind, name, start, end, language in zip(*(b.column(c).to_pylist() for c in range(n + 5))):
                if k != key:
                    flush()
                    key, held = k, []
                held.append(Piece(kind, name, start, end, language))
            if rows:
                yield out()
                rows = []
        if schema is not None:
            flush()
            yield out()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.repartition(*keys).sortWithinPartitions(*keys, "start_byte", "end_byte", "name").mapInArrow(run, fields + ", group_no int")


def overlap_context(parts: list[Column], budget: int) -> Column:
    """What a chunk takes over from the one before: of the parts in order of importance (types, documentation, signature, dependencies) each that still fits into
    ``budget`` bytes with the line ends between; empty and null ones are passed over."""
    def add(acc: Column, x: Column) -> Column:
        joined = F.when(acc == "", x).otherwise(F.concat(acc, F.lit("\n"), x))
        return F.when(F.octet_length(joined) <= budget, joined).otherwise(acc)

    kept = F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.aggregate(kept, F.lit(""), add) if budget > 0 else F.lit("")


def neighbours(df: DataFrame, keys: list[str], order: list[str], content: str = "content", size: int = 200) -> DataFrame:
    """Adds before (the last ``size`` characters of the previous chunk), after (the first of the next) and ordinal (chunks before it)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = F.lag(content).over(w)
    return df.withColumns({"before": F.right(prev, F.lit(size)), "after": F.left(F.lead(content).over(w), F.lit(size)), "ordinal": F.row_number().over(w) - 1})


def gap_share(df: DataFrame, keys: list[str], start: str, end: str, small: int = 100, weight: float = 0.7) -> DataFrame:
    """Cohesion of a file's constructs: the share of gaps from 0 to below ``small``, times the weight; one construct has 1."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    gap = F.col(start) - F.lag(end).over(w)
    g = df.withColumn("__gap", gap)
    close = F.avg(((F.col("__gap") >= 0) & (F.col("__gap") < small)).cast("double"))
    return g.groupBy(*keys).agg(F.coalesce(close * weight, F.lit(1.0)).alias("cohesion"))


def gap_groups(df: DataFrame, keys: list[str], order: str, gap: float) -> DataFrame:
    """Adds group_no: a new group where the value is more than ``gap`` above the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("group_no", F.sum("__new").over(w)).drop("__new")


#: Share of the content that makes a good chunk, by language; weights of the quality scores.
SIZE_SHARES = {"go": 0.30, "python": 0.35, "javascript": 0.25, "typescript": 0.25}
OTHER_SHARE = 0.40
QUALITY_WEIGHTS = {"cohesion": 0.20, "coupling": 0.20, "complexity": 0.15, "completeness": 0.15, "readability": 0.15, "maintainability": 0.15}


def chunk_size(length: Column, language: Column, least: int, most: int) -> Column:
    """Chunk size that suits a content of a length: a share by language, truncated, within bounds."""
    share = F.lit(OTHER_SHARE)
    for lang, x in SIZE_SHARES.items():
        share = F.when(F.lower(language) == lang, x).otherwise(share)
    return F.least(F.greatest((length * share).cast("int"), F.lit(least)), F.lit(most))


def readability(content: Column) -> Column:
    """A quarter each: under 10 % lines over 120 characters, a comment, mostly even indentation, no tab after a blank."""
    lines = F.split(content, "\n")
    long = F.size(F.filter(lines, lambda x: F.length(x) > 120))
    indented = F.filter(lines, lambda x: x.startswith(" "))
    odd = F.size(F.filter(indented, lambda x: F.length(F.regexp_extract(x, "^( *)", 1)) % 2 == 1))
    return 0.25 * ((long * 10 < F.size(lines)).cast("double") + F.regexp_like(content, F.lit("//|#|/\\*")).cast("double") + (odd * 5 <= F.size(indented)).cast("double") + (~F.regexp_like(content, F.lit(" \t"))).cast("double"))


def overall_quality(**scores: Column) -> Column:
    """Weighted mean of the six scores."""
    if set(scores) != set(QUALITY_WEIGHTS):
        raise ValueError(f"scores needed: {', '.join(QUALITY_WEIGHTS)}")
    out = F.lit(0.0)
    for name, w in QUALITY_WEIGHTS.items():
        out = out + scores[name] * w
    return out


def validation_score(issues: Column, valid: Column | None = None) -> Column:
    """1 minus .5, .3, .2 or .1 for each critical, high, medium or low issue of an array of severities, at least 0; 0 for what isn't valid."""
    cost = lambda x: F.when(x == "critical", 0.5).when(x == "high", 0.3).when(x == "medium", 0.2).when(x == "low", 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 1 - F.aggregate(issues, F.lit(0.0), lambda s, x: s + cost(x)))
    return score if valid is None else F.when(F.coalesce(valid, F.lit(False)), score).otherwise(0.0)


#: Weight of a construct by its kind.
CONSTRUCT_WEIGHTS = {"function": 1.0, "method": 1.0, "class": 2.0, "struct": 2.0, "interface": 1.5}
OTHER_CONSTRUCT = 0.5


def construct_weight(kind: Column) -> Column:
    out = None
    for name, x in CONSTRUCT_WEIGHTS.items():
        out = F.when(F.lower(kind) == name, x) if out is None else out.when(F.lower(kind) == name, x)
    return out.otherwise(OTHER_CONSTRUCT)


def group_complexity(weights: Column, used: Column) -> Column:
    """Aggregate over a group of constructs: their weights and a tenth for each call or type used, over three times their number, at most 1."""
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(F.sum(weights + F.coalesce(used, F.lit(0)) * 0.1), F.count(F.lit(1)) * 3.0), F.lit(0.0)))


def content_complexity(content: Column, children: Column, parameters: Column) -> Column:
    """1, .5 more over 1000 bytes, .2 for each child and .1 for each parameter."""
    return 1.0 + F.when(F.octet_length(content) > 1000, 0.5).otherwise(0.0) + children * 0.2 + parameters * 0.1


def metadata_map(content: Column, documentation: Column, complexity: Column, depth: Column) -> Column:
    """What is recorded about a construct, as texts: content_length, has_documentation, complexity_score, semantic_depth."""
    text = lambda c: c.cast("string")
    return F.create_map(
        F.lit("content_length"), text(F.octet_length(content)), F.lit("has_documentation"), text(F.coalesce(documentation, F.lit("")) != ""),
        F.lit("complexity_score"), text(complexity), F.lit("semantic_depth"), text(depth),
    )


def coupling_score(external: Column, constructs: Column) -> Column:
    """1 minus unresolved dependencies per construct, at least 0."""
    return F.greatest(F.lit(0.0), 1.0 - external / F.greatest(constructs, F.lit(1)))


def complexity_score(constructs_complexity: Column, dependencies: Column, size: Column, constructs: Column) -> Column:
    """1 minus the complexity (that of the constructs, a tenth per dependency, the logarithm of the size) over five times the constructs, between 0 and 1; 0 without constructs."""
    total = constructs_complexity + dependencies * 0.1 + F.log10(size / 1000.0 + 1)
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.coalesce(F.try_divide(total, constructs * 5.0), F.lit(1.0)), F.lit(1.0)))


def completeness_score(content: Column, constructs: Column, context: Column, dependencies: Column, mixed: Column) -> Column:
    """A sixth each: content, constructs, context kept, dependencies (none is as good), one kind of construct, 50 to 5000 bytes. Null dependencies are unknown ones."""
    size = F.octet_length(content)
    signs = [F.trim(content) != "", constructs > 0, context, dependencies.isNotNull(), ~mixed | (constructs <= 1), (size >= 50) & (size <= 5000)]
    out = F.lit(0)
    for x in signs:
        out = out + F.coalesce(x, F.lit(False)).cast("int")
    return out / 6.0


def maintainability_score(cohesion: Column, coupling: Column, complexity: Column, completeness: Column, readable: Column) -> Column:
    """.25 each of cohesion, coupling and 2 minus complexity, .15 of completeness, .1 of readability, at most 1."""
    return F.least(F.lit(1.0), cohesion * 0.25 + coupling * 0.25 + (2.0 - complexity) * 0.25 + completeness * 0.15 + readable * 0.1)


def large_and_named(content: Column, name: Column, least: int = 0) -> Column:
    """Is a construct kept: of at least ``least`` bytes, not empty, with a name?"""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return (size >= max(1, least)) & (F.coalesce(name, F.lit("")) != "")
