"""Grouped analytics: contingency tables, moments, stratified effects and their sampled form."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.expressions import aggregated, free_name, segment, with_value
from tessera.plans.errors import NonFiniteValue, RequestShape
from tessera.plans.model import Constraint, Objective
from tessera.sources.profile import check_bins, numeric, quantile_cuts, resolve

MAX_COLUMNS = 4


def check_shape(columns, what: str, most: int = MAX_COLUMNS, least: int = 0) -> None:
    if not least <= len(columns) <= most:
        raise RequestShape(f"{len(columns)} {what}; from {least} to {most} are allowed")


def bin_label(value: Column, cuts: list[float]) -> Column:
    """The text number of the first cut that is not below the value; k cuts make k + 1 bins."""
    if not cuts:
        return F.lit("0")
    out = None
    for i, cut in enumerate(cuts):
        out = F.when(value <= cut, str(i)) if out is None else out.when(value <= cut, str(i))
    return out.otherwise(str(len(cuts)))


def group_keys(df: DataFrame, columns: list[tuple[str, int]], cuts: dict[str, list[float]] | None = None) -> list[Column]:
    """A text key for each (name, bins): a quantile bin, or the value itself for 0 bins."""
    binned = []
    for name, bins in columns:
        check_bins(bins)
        if bins:
            numeric(df.schema, name)
            binned.append((name, bins))
    if cuts is None:
        cuts = {}
        for bins in sorted({b for _, b in binned}):
            cuts |= {f"{c}\0{bins}": v for c, v in quantile_cuts(df, [n for n, b in binned if b == bins], bins).items()}
    out = []
    for name, bins in columns:
        own = resolve(df.schema, name)
        key = bin_label(own.column.cast("double"), cuts[f"{name}\0{bins}"]) if bins else own.column.cast("string")
        out.append(key.alias(own.name))
    return out


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        df = df.where(resolve(df.schema, n).column.isNotNull())
    return df


def all_cuts(df: DataFrame, names: list[str], bins: int, beside: dict[str, Column] | None = None) -> dict[str, list[float]]:
    """Cuts of several columns from one job, as group_keys takes them; beside as quantile_cuts takes it."""
    return {f"{n}\0{bins}": c for n, c in quantile_cuts(df, names, bins, beside=beside).items()}


def contingency(df: DataFrame, columns: list[tuple[str, int]], constraints: list[Constraint] = (), cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """(value of each column, count) over rows without nulls in them; cuts come from all rows, or are given."""
    check_shape(columns, "columns", least=1)
    keys = group_keys(df, columns, cuts)
    rows = complete(df.where(segment(constraints, df.schema)), [n for n, _ in columns])
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def moments(df: DataFrame, variables: list[str], group_by: list[tuple[str, int]] = (), constraints: list[Constraint] = ()) -> DataFrame:
    """(group..., n, sum_i, sumsq_i, cross_i_j) in double over rows without nulls in variables and groups; no rows sum to 0."""
    check_shape(variables, "variables", least=1)
    check_shape(group_by, "groups")
    own = [numeric(df.schema, v).column.cast("double") for v in variables]
    keys = group_keys(df, list(group_by))
    rows = complete(df.where(segment(constraints, df.schema)), [*variables, *(g for g, _ in group_by)])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggregates = [F.count("*").alias("n")]
    for i, x in enumerate(own):
        aggregates += [zero(F.sum(x)).alias(f"sum_{i}"), zero(F.sum(x * x)).alias(f"sumsq_{i}")]
    for i, j in itertools.combinations(range(len(own)), 2):
        aggregates.append(zero(F.sum(own[i] * own[j])).alias(f"cross_{i}_{j}"))
    return rows.groupBy(*keys).agg(*aggregates) if keys else rows.agg(*aggregates)


def check_finite(rows: list[dict], k: int) -> list[dict]:
    """Rows of moments of k variables; a sum, a sum of squares or a cross sum that is not finite is an error."""
    for r in rows:
        for name in [f"{s}_{i}" for i in range(k) for s in ("sum", "sumsq")] + [f"cross_{i}_{j}" for i, j in itertools.combinations(range(k), 2)]:
            if not math.isfinite(r[name]):
                raise NonFiniteValue(f"moment {name}")
    return rows


def collected_moments(df: DataFrame, k: int) -> list[dict]:
    return check_finite([r.asDict() for r in df.collect()], k)


def stratified_effect(df: DataFrame, objective: Objective, treated: list[Constraint], adjust: list[tuple[str, int]] = (), random_bins: int = 0, seed: int = 0, sample: DataFrame | None = None) -> DataFrame:
    """(stratum..., n, seg_n, seg_agg, base_n, base_agg): the objective inside and outside a segment in each stratum.

    A row on which the segment is null counts in n and in neither arm. Without strata there is one row even over no rows.
    sample: the rows to aggregate, if not all; cuts always come from df.
    """
    if objective.expression.has_window():
        raise RequestShape("a windowed objective is not adjustable")
    check_shape(adjust, "adjusted columns")
    keys = group_keys(df, list(adjust))
    rows = complete(df if sample is None else sample, [n for n, _ in adjust])
    inside = free_name(df, "in_segment")
    rows = rows.withColumn(inside, segment(treated, df.schema))
    rows, name, kind = with_value(rows, objective)
    arm = lambda test: aggregated(objective.aggregation.lower(), F.when(test, F.col(name)), kind)
    seg, base = F.col(inside), ~F.col(inside)
    aggregates = [F.count("*").alias("n"), F.count(F.when(seg, 1)).alias("seg_n"), arm(seg).alias("seg_agg"), F.count(F.when(base, 1)).alias("base_n"), arm(base).alias("base_agg")]
    if random_bins:
        check_bins(random_bins)
        keys = [*keys, F.floor(F.rand(seed) * random_bins).cast("string").alias(free_name(df, "random_stratum"))]
    return rows.groupBy(*keys).agg(*aggregates) if keys else rows.agg(*aggregates)


#: Rows of one range of draws that may be sorted to find the last ones of a sample.
SORTED_ROWS = 20_000


def exact_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """round(fraction * n) rows drawn without replacement; all rows for fraction 1.

    Rows are ordered by a seeded hash of their content, so a sample depends on the rows alone, not on how they are split or
    read. Counts of the draws' leading bits, 12 bits more in each pass, say which ranges are in, until the range on the edge is
    small. Rows that share a draw to its last bit are equal, so it does not matter which of them are taken; they are told apart by place.
    """
    if not 0 < fraction <= 1:
        raise RequestShape(f"fraction {fraction}")
    if fraction == 1:
        return df
    draw, place = free_name(df, "draw"), free_name(df, "place")
    content = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    rows = df.withColumn(draw, F.xxhash64(F.lit(seed), *content)).withColumn(place, F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    wanted, parts, edge = None, [], rows
    for column, shift in [(c, 64 - 12 * k) for c in (draw, place) for k in range(1, 6)]:
        leading = F.shiftrightunsigned(F.col(column), shift)
        counts = {r[0]: r[1] for r in edge.groupBy(leading).count().collect()}  # at most 4096
        if wanted is None:
            wanted = round(fraction * sum(counts.values()))
        inside = []
        for bits in sorted(counts):
            if counts[bits] > wanted:
                break
            inside.append(bits)
            wanted -= counts[bits]
        else:
            parts.append(edge)
            break
        parts.append(edge.where(leading < bits) if inside else edge.where("false"))
        edge = edge.where(leading == bits)
        if not wanted or counts[bits] <= SORTED_ROWS:
            parts.append(edge.orderBy(draw, place).limit(wanted))
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop(draw, place)


def sampled_effect(df: DataFrame, objective: Objective, treated: list[Constraint], adjust: list[tuple[str, int]] = (), fraction: float = 0.7, seed: int = 0, exact: bool = True) -> DataFrame:
    """A stratified effect over a sample of a fixed size; with exact=False a Bernoulli sample, which needs no pass of its own."""
    if not 0 < fraction <= 1:
        raise RequestShape(f"fraction {fraction}")
    rows = exact_sample(df, fraction, seed) if exact or fraction == 1 else df.sample(False, fraction, seed)
    return stratified_effect(df, objective, treated, adjust, sample=rows)
