"""Schemas and profiles: coarse types, column resolution, distinct values and quantile cuts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.errors import AmbiguousField, NonNumeric, RequestShape, UnknownField
from tessera.sources.tabular import small_table

NUMERIC, BOOLEAN, STRING, TEMPORAL = "numeric", "boolean", "string", "temporal"
DISTINCT_CAP, MAX_BINS = 50, 32


def coarse(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return NUMERIC
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    return TEMPORAL if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else STRING


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def has_probe(kind: T.DataType) -> bool:
    """Text, boolean and integer columns are probed for distinct values."""
    return is_integer(kind) or coarse(kind) in (BOOLEAN, STRING)


def orderable(kind: T.DataType) -> bool:
    return coarse(kind) in (NUMERIC, TEMPORAL)


@dataclass(frozen=True)
class Resolved:
    name: str
    kind: T.DataType

    @property
    def coarse(self) -> str:
        return coarse(self.kind)

    @property
    def column(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")


def resolve(schema: T.StructType, name: str) -> Resolved:
    """The one column of that name, whatever its case."""
    found = [f for f in schema.fields if f.name.lower() == name.lower()]
    if not found:
        raise UnknownField(name)
    if len(found) > 1:
        raise AmbiguousField(name)
    return Resolved(found[0].name, found[0].dataType)


def numeric(schema: T.StructType, name: str) -> Resolved:
    c = resolve(schema, name)
    if c.coarse != NUMERIC:
        raise NonNumeric(name)
    return c


def check_bins(bins: int) -> None:
    if bins != 0 and not 2 <= bins <= MAX_BINS:
        raise RequestShape(f"bins {bins} is neither 0 nor from 2 to {MAX_BINS}")


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, coarse(f.dataType)) for f in df.schema.fields]


def bind_targets(schema: T.StructType, fields: list[str]) -> list[tuple[str, str | None, bool]]:
    """(target, column, matched)."""
    out = []
    for name in fields:
        try:
            out.append((name, resolve(schema, name).name, True))
        except (UnknownField, AmbiguousField):
            out.append((name, None, False))
    return out


#: Rows that are looked at first: a column with more than the cap of values among them is settled.
HEAD_ROWS = 2000


def distinct_values(df: DataFrame, columns: list[str] | None = None, cap: int = DISTINCT_CAP) -> DataFrame:
    """Rows (column, value): the distinct non-null values as text of probed columns with at most cap of them.

    A column with more than cap values has no rows at all. Most such columns, ids above all, show more than cap values in the first
    HEAD_ROWS rows that come to hand, which settles them without a scan; the others are counted in full, all in one scan.
    """
    chosen = [f for f in df.schema.fields if has_probe(f.dataType) and (columns is None or f.name in columns)]
    empty = df.sparkSession.createDataFrame([], "column string, value string")
    if not chosen:
        return empty
    # Beginnings are enough to tell values apart, and bound what is gathered.
    text = [F.substring(F.col(f"`{f.name}`").cast("string"), 1, 64).alias(f"c{i}") for i, f in enumerate(chosen)]
    head = df.select(*text).limit(max(HEAD_ROWS, 4 * (cap + 1))).collect()
    left = [f for i, f in enumerate(chosen) if len({r[i] for r in head} - {None}) <= cap]
    if not left:
        return empty
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in left])
    pairs = df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null").distinct()
    # Each task keeps one value beyond the cap, if there are so many, so the pairs are made once and a column's values need not meet.
    own = Window.partitionBy("column")
    first = pairs.withColumn("place", F.row_number().over(own.orderBy("value"))).where(F.col("place") <= cap + 1)
    return first.withColumn("most", F.max("place").over(own)).where(F.col("most") <= cap).select("column", "value")


def cut_shares(bins: int) -> list[float]:
    return [round(i / bins, 6) for i in range(1, bins)]


#: Rows up to which one aggregate holds all values of the columns; beyond it no task does. That aggregate is one task's work.
HELD_VALUES = 100_000
#: Estimated quantiles are off by at most one row in so many.
NEAR = 10_000
#: Brackets of quantiles that one scan counts.
BRACKETS = 32


def quantile_cuts(df: DataFrame, columns: list[str], bins: int, held: int = HELD_VALUES, beside: dict[str, Column] | None = None) -> dict[str, list[float]]:
    """bins - 1 interpolated quantiles of each numeric column, nulls left out, non-finite cuts dropped; exact.

    A quantile lies between the values of two ranks. Up to `held` rows take one aggregate. Of more, estimates bracket each quantile, and
    only the values within a bracket are ranked; should a rank be in none, all values of its column are. One scan counts the rows and
    makes the estimates. beside: other aggregates of that scan by name, in whose place their values are put.
    """
    check_bins(bins)
    if not bins or not columns:
        return {c: [] for c in columns}
    own = {c: numeric(df.schema, c).column.cast("double") for c in dict.fromkeys(columns)}
    more = dict(beside or {})
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *estimates(own, cut_shares(bins)), *[x.alias(f"b{i}") for i, x in enumerate(more.values())]).first()
    for i, name in enumerate(more):
        beside[name] = seen[f"b{i}"]
    if seen["rows"] > held:
        found = bracketed_cuts(df, own, cut_shares(bins), seen)
        if missed := {c: x for c, x in own.items() if c not in found}:
            found |= ranked_cuts(df, missed, cut_shares(bins))
    else:
        row = df.agg(*[F.percentile(x, F.array(*map(F.lit, cut_shares(bins)))).alias(f"q{i}") for i, x in enumerate(own.values())]).first()
        found = {c: row[i] or [] for i, c in enumerate(own)}
    return {c: [x for x in found[c] if x is not None and abs(x) != float("inf") and x == x] for c in columns}


def ranks(share: float, n: int) -> tuple[int, int]:
    """The ranks, from 0, between whose values a quantile of n values lies."""
    return math.floor(share * (n - 1)), math.ceil(share * (n - 1))


def between(share: float, n: int, low: float, high: float) -> float:
    x = share * (n - 1)
    return low if low == high or x == math.floor(x) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high


def estimates(own: dict[str, Column], shares: list[float]) -> list[Column]:
    """Of the i-th column its values (n_i) and what is close to each quantile on both sides (q_i)."""
    asked = F.array(*[F.lit(min(max(p + d / NEAR, 0.0), 1.0)) for p in shares for d in (-2, 2)])
    return [x for i, v in enumerate(own.values()) for x in (F.count(v).alias(f"n{i}"), F.percentile_approx(v, asked, NEAR).alias(f"q{i}"))]


def placed(v: Column, c: int, brackets: list[list[float]]) -> Column:
    """A value of the c-th column (v), how many brackets of that column lie below it, and itself if it is inside one."""
    inside = reduce(Column.__or__, [v.between(low, high) for low, high in brackets])
    passed = reduce(Column.__add__, [F.when(v > high, 1).otherwise(0) for _, high in brackets])
    return F.struct(F.lit(c).alias("c"), v.alias("v"), passed.alias("passed"), F.when(inside, v).alias("value"))


def bracketed_cuts(df: DataFrame, own: dict[str, Column], shares: list[float], seen: Row) -> dict[str, list[float]]:
    """Exact interpolated quantiles of the columns whose ranks the brackets hold, which is all but for a fault of the estimates.

    seen: the estimates. A scan for BRACKETS of them counts each value inside a bracket, some 4 in NEAR rows, and the rows between two
    brackets as one; ordered, the counts are ranks.
    """
    names = list(own)
    total = {c: seen[f"n{c}"] for c in range(len(names))}
    at = {}
    step = max(1, BRACKETS // len(shares))
    for first in range(0, len(names), step):
        part = [c for c in range(len(names))[first : first + step] if total[c]]
        if not part:
            continue
        brackets = {c: [seen[f"q{c}"][2 * i : 2 * i + 2] for i in range(len(shares))] for c in part}
        values = df.select(F.explode(F.array(*[placed(own[names[c]], c, brackets[c]) for c in part])).alias("x")).select("x.*").where("v is not null")
        counts = values.groupBy("c", "passed", "value").agg(F.count("*").alias("n"), F.max("v").alias("most"))
        last = counts.withColumn("last", F.sum("n").over(Window.partitionBy("c").orderBy("most")) - 1)
        wanted = {c: sorted({k for p in shares for k in ranks(p, total[c])}) for c in part}
        hit = reduce(Column.__or__, [(F.col("c") == c) & (F.col("last") >= k) & (F.col("last") - F.col("n") < k) for c in part for k in wanted[c]])
        for r in last.where(hit & F.col("value").isNotNull()).collect():  # at most two for each quantile
            at |= {(r.c, k): r.value for k in wanted[r.c] if r.last - r.n < k <= r.last}
    out = {}
    for c, name in enumerate(names):
        ends = [(p, *[at.get((c, k)) for k in ranks(p, total[c])]) for p in shares if total[c]]
        if all(x is not None for e in ends for x in e):
            out[name] = [between(p, total[c], low, high) for p, low, high in ends]
    return out


def ranked_cuts(df: DataFrame, own: dict[str, Column], shares: list[float]) -> dict[str, list[float]]:
    """Exact interpolated quantiles without any task that holds a column's values."""
    names = list(own)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), x.alias("v")) for i, x in enumerate(own.values())])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = ordered.groupBy("part", "c").agg(F.sum("n").alias("n")).collect()  # a row for each partition and column
        before, total = {}, dict.fromkeys(range(len(names)), 0)
        for part, c, n in sorted((r.part, r.c, r.n) for r in totals):
            before[part, c] = total[c]
            total[c] += n
        # Ranks that are asked for, by column and partition.
        asked = {(c, k) for c, n in total.items() for p in shares for k in ranks(p, n) if n}
        starts = small_table(df.sparkSession, [(part, c, b) for (part, c), b in before.items()], "part int, c int, before long")
        here = Window.partitionBy("part", "c").orderBy("v")
        ranked = ordered.join(F.broadcast(starts), ["part", "c"]).withColumn("last", F.col("before") + F.sum("n").over(here) - 1)
        wanted = F.broadcast(small_table(df.sparkSession, sorted(asked), "c int, k long"))
        hit = ranked.alias("r").join(wanted.alias("w"), (F.col("r.c") == F.col("w.c")) & (F.col("k") <= F.col("last")) & (F.col("k") > F.col("last") - F.col("n")))
        at = {(r.c, r.k): r.v for r in hit.select("w.c", "k", "v").collect()}  # two for each quantile
    finally:
        ordered.unpersist()
    out = {}
    for c, name in enumerate(names):
        out[name] = [between(p, total[c], *[at[c, k] for k in ranks(p, total[c])]) for p in shares] if total[c] else []
    return out


def profile(df: DataFrame, cap: int = DISTINCT_CAP, bins: int = 0) -> list[dict]:
    """Name, type, distinct values (if few) and quantile cuts (if asked for) of each column."""
    values: dict[str, list[str]] = {}
    for r in distinct_values(df, cap=cap).collect():  # at most cap rows for each column
        values.setdefault(r.column, []).append(r.value)
    cuts = quantile_cuts(df, [f.name for f in df.schema.fields if coarse(f.dataType) == NUMERIC], bins) if bins else {}
    return [{"name": f.name, "type": coarse(f.dataType), "integer": is_integer(f.dataType), "values": sorted(values[f.name]) if f.name in values else None, "cuts": cuts.get(f.name, [])} for f in df.schema.fields]


def unknown_columns(names: list[str], schema_names: list[str]) -> list[str]:
    known, out = {n.lower() for n in schema_names}, {}
    for n in names:
        if n.lower() not in known:
            out.setdefault(n.lower(), n)
    return list(out.values())


def unknown_values(constraints, columns: list[dict]) -> list[str]:
    """Members of equality and set predicates that a column's known value set lacks, case-insensitively."""
    from tessera.plans.model import EQUALITY_OPS, MEMBER_OPS, scalar_text

    sets = {c["name"].lower(): {v.lower() for v in c["values"]} for c in columns if c.get("values") is not None}
    out = {}
    for c in constraints:
        if c.op in EQUALITY_OPS | MEMBER_OPS and (own := sets.get(c.field.lower())) is not None:
            for v in c.members:
                if scalar_text(v).lower() not in own:
                    out.setdefault((c.field.lower(), scalar_text(v).lower()), f"{c.field} = {scalar_text(v)}")
    return list(out.values())
