"""Adjusted effects of segments, claims, and the refutation battery that tests them."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.statistics import attenuation
from tessera.operators.analyze import group_keys, stratified_effect
from tessera.operators.discovery import Orientation
from tessera.operators.expressions import aggregated, free_name, segment, with_value
from tessera.operators.measure import execute
from tessera.plans.canonical import finding_seed
from tessera.plans.model import Constraint, Objective

# Defaults of verification.
SUPPORT_FLOOR, COLLAPSE, TAU, DRAWS, SHARE, BAND, RANDOM_BINS, ADJUST_BINS = 20, 0.5, 0.8, 20, 0.7, 0.5, 4, 4
VERIFIED, CONFOUNDED, NOT_IDENTIFIABLE, UNSUPPORTED, POSITIVITY = "causally_verified", "confounded", "not_identifiable", "unsupported_objective", "positivity_violation"


@dataclass(frozen=True)
class Plan:
    status: str = ""
    adjust: tuple[str, ...] = ()
    blocking: tuple[str, ...] = ()


def adjustment(graph: Orientation, objective: Objective, treated: list[Constraint]) -> Plan:
    """The treatment columns' parents, without treatment and outcome. An open edge at a treatment or adjusted column blocks.

    Names are compared whatever their case. A treatment column that was tested and has no edge left has no parents; one that was
    not tested is not identifiable.
    """
    if objective.expression.has_window():
        return Plan(UNSUPPORTED)
    lower = lambda names: {n.lower() for n in names}
    treatment, outcome = lower(c.field for c in treated), lower(objective.expression.columns())
    known = lower([*graph.found.columns, *graph.nodes()])
    if unknown := [c.field for c in treated if c.field.lower() not in known]:
        return Plan(NOT_IDENTIFIABLE, blocking=tuple(sorted(set(unknown))))
    parents = {a for a, b in graph.directed if b.lower() in treatment and a.lower() not in treatment | outcome}
    open_ = sorted(f"{a} - {b}" for a, b in graph.open if {a.lower(), b.lower()} & (treatment | lower(parents)))
    return Plan(NOT_IDENTIFIABLE, tuple(sorted(parents)), tuple(open_)) if open_ else Plan("", tuple(sorted(parents)))


def reweighted(rows: list[dict], floor: int = SUPPORT_FLOOR) -> float | None:
    """The effect weighted by stratum size; None if an arm of any stratum is empty or below the floor."""
    if not rows or any(r["seg_agg"] is None or r["base_agg"] is None or min(r["seg_n"], r["base_n"]) < floor for r in rows):
        return None
    return sum((r["seg_agg"] - r["base_agg"]) * r["n"] for r in rows) / sum(r["n"] for r in rows)


def reweighted_leniently(rows: list[dict]) -> float | None:
    """Over the strata that have both arms."""
    own = [r for r in rows if r["seg_agg"] is not None and r["base_agg"] is not None]
    return sum((r["seg_agg"] - r["base_agg"]) * r["n"] for r in own) / sum(r["n"] for r in own) if own else None


def collapses(naive: float, adjusted: float, share: float = COLLAPSE) -> bool:
    return naive != 0 and (naive * adjusted < 0 or abs(adjusted) < share * abs(naive))


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]  # strata are bounded by bins and categories


def difference(rows: list[dict]) -> float | None:
    r = rows[0]
    return None if r["seg_agg"] is None or r["base_agg"] is None else r["seg_agg"] - r["base_agg"]


@dataclass
class Verification:
    status: str
    naive: float | None = None
    adjusted: float | None = None
    adjust: tuple[str, ...] = ()
    scores: dict[str, float] = field(default_factory=dict)
    score: float = 0.0
    blocking: tuple[str, ...] = ()


def binned(df: DataFrame, names: tuple[str, ...], bins: int = ADJUST_BINS) -> list[tuple[str, int]]:
    from tessera.sources.profile import NUMERIC, resolve

    return [(n, bins if resolve(df.schema, n).coarse == NUMERIC else 0) for n in names]


def stability_rows(df: DataFrame, objective: Objective, treated: list[Constraint], adjust: list[tuple[str, int]], seed: int, draws: int = DRAWS, share: float = SHARE) -> DataFrame:
    """All subsamples in one scan: each draw is a seeded flag, cuts are those of the full data.

    Rows (s_i: stratum..., arm, none: the aggregate of no rows, then n_k and agg_k of each draw) for each arm of a stratum; the arm is null where
    the segment is. An arm is a key, so a row costs a draw two aggregates, not five.
    """
    keys = group_keys(df, adjust)
    inside, agg = free_name(df, "in_segment"), objective.aggregation.lower()
    rows, name, kind = with_value(df.withColumn(inside, segment(treated, df.schema)), objective)
    for n, _ in adjust:
        rows = rows.where(F.col(f"`{n}`").isNotNull())
    rows = rows.select(*[k.alias(f"s_{i}") for i, k in enumerate(keys)], F.col(inside).alias("arm"), F.col(name).alias("value"), *[(F.rand(seed + k) < share).alias(f"draw_{k}") for k in range(draws)])
    out = [F.lit(0.0 if agg == "count" else None).cast("double").alias("none")]
    for k in range(draws):
        drawn = F.col(f"draw_{k}")
        out += [F.count(F.when(drawn, 1)).alias(f"n_{k}"), aggregated(agg, F.when(drawn, F.col("value")), kind).alias(f"agg_{k}")]
    return rows.groupBy(*[f"s_{i}" for i in range(len(keys))], "arm").agg(*out)


def stability(rows: list[dict], reference: float, draws: int = DRAWS, band: float = BAND) -> float:
    """Share of draws of the same sign and within the band around the reference."""
    strata: dict[tuple, dict] = {}
    for r in rows:
        strata.setdefault(tuple(v for f, v in r.items() if f.startswith("s_")), {})[r["arm"]] = r
    good = 0
    for k in range(draws):
        of_arm = lambda arms, a: arms[a][f"agg_{k}"] if a in arms else next(iter(arms.values()))["none"]  # noqa: B023, E731
        own = [{"n": sum(r[f"n_{k}"] for r in arms.values()), "seg_agg": of_arm(arms, True), "base_agg": of_arm(arms, False)} for arms in strata.values()]
        e = reweighted_leniently([r for r in own if r["n"]])
        good += e is not None and e * reference > 0 and abs(e - reference) <= band * abs(reference)
    return good / draws


def placebo_columns(profile: list[dict], graph: Orientation, treatment: set[str], outcome: set[str], adjust: tuple[str, ...]) -> list[dict]:
    """Text columns with known values that neither take part nor touch the outcome."""
    out = {o.lower() for o in outcome}
    near = {v for e in graph.found.edges for v in e if {x.lower() for x in e} & out}
    taken = {n.lower() for n in treatment | near | set(adjust)} | out
    return [c for c in profile if c["type"] == "string" and c["values"] and len(c["values"]) > 1 and c["name"].lower() not in taken]


def verify(df: DataFrame, objective: Objective, treated: list[Constraint], graph: Orientation, profile: list[dict], finding: str = "", tau: float = TAU, floor: int = SUPPORT_FLOOR, draws: int = DRAWS) -> Verification:
    """Adjusts a segment's effect and stress-tests it: a placebo treatment, subsamples, and a random confounder."""
    plan = adjustment(graph, objective, treated)
    if plan.status:
        return Verification(plan.status, adjust=plan.adjust, blocking=plan.blocking)
    whole = rows_of(stratified_effect(df, objective, treated))
    naive = difference(whole)
    adjust = binned(df, plan.adjust)
    strata = rows_of(stratified_effect(df, objective, treated, adjust)) if adjust else whole
    effect = reweighted(strata, floor)
    if naive is None or effect is None:
        return Verification(POSITIVITY, naive, effect, plan.adjust)
    if collapses(naive, effect):
        return Verification(CONFOUNDED, naive, effect, plan.adjust)
    seed = finding_seed(finding) % 2**31
    options = placebo_columns(profile, graph, {c.field for c in treated}, set(objective.expression.columns()), plan.adjust)
    placebo = 0.0
    if options:
        pick = random.Random(seed)
        column = pick.choice(options)
        fake = [Constraint(column["name"], "eq", pick.choice(column["values"]))]
        null = reweighted_leniently(rows_of(stratified_effect(df, objective, fake, adjust)))
        placebo = 0.0 if null is None else attenuation(null, effect)
    steady = stability(rows_of(stability_rows(df, objective, treated, adjust, seed, draws)), effect, draws)
    confounded = reweighted_leniently(rows_of(stratified_effect(df, objective, treated, adjust, random_bins=RANDOM_BINS, seed=seed)))
    shift = 0.0 if confounded is None else attenuation(effect - confounded, effect)
    scores = {"placebo": placebo, "stability": steady, "random_confounder": shift}
    score = sum(scores.values()) / 3
    return Verification(VERIFIED if score >= tau else CONFOUNDED, naive, effect, plan.adjust, scores, score)


@dataclass(frozen=True)
class Claim:
    value: float
    baseline: float
    support: int
    agrees: bool


def measure_claim(df: DataFrame, objective: Objective, claimed: list[Constraint]) -> Claim | None:
    """The segment's value against the unfiltered one; None if the segment has no rows."""
    inside = rows_of(stratified_effect(df, objective, claimed))[0]
    if not inside["seg_n"] or inside["seg_agg"] is None:
        return None
    baseline = execute(df, objective)[objective.label]
    return Claim(inside["seg_agg"], baseline, inside["seg_n"], objective.delta(inside["seg_agg"], baseline) > 0)


def grounding_message(claimed: list[Constraint], profile: list[dict]) -> str:
    from tessera.sources.profile import unknown_columns, unknown_values

    parts = []
    if names := unknown_columns([c.field for c in claimed], [c["name"] for c in profile]):
        parts.append(f"unknown columns: {', '.join(names)}")
    if values := unknown_values(claimed, profile):
        parts.append(f"unknown values: {', '.join(values)}")
    return "; ".join(parts)
