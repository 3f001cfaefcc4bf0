"""What a run publishes: candidates, shrunk scores, deduplication, containment and caps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.statistics import shrunk_score
from tessera.operators.search import Finding
from tessera.plans.canonical import components, derived_id, key
from tessera.plans.model import Constraint, Objective

# Fixed values
SHRINK, MARGIN, CAP, PROMOTED = 30.0, 1.10, 20, 5


@dataclass(frozen=True)
class Candidate:
    canonical: str
    filters: tuple[Constraint, ...]
    value: float
    support: int
    score: float
    sources: tuple[str, ...] = ()


def candidates(findings: list[Finding], objective: Objective, baseline: float, k: float = SHRINK) -> list[Candidate]:
    """Effective segments with rows whose value improves on the global baseline."""
    out = []
    for f in findings:
        if f.effective_filters and f.support > 0 and f.value is not None and objective.improves(f.value, baseline):
            score = shrunk_score(objective.delta(f.value, baseline), f.support, k)
            out.append(Candidate(key(f.effective_filters), tuple(f.effective_filters), f.value, f.support, score, (f.id,)))
    return out


def ranked(found: list[Candidate]) -> list[Candidate]:
    return sorted(found, key=lambda c: (-c.score, c.canonical))


def deduplicated(found: list[Candidate]) -> list[Candidate]:
    """One candidate for each segment: its best score, everyone's sources."""
    out: dict[str, Candidate] = {}
    for c in ranked(found):
        first = out.setdefault(c.canonical, c)
        if first is not c:
            out[c.canonical] = Candidate(*[getattr(first, f) for f in ("canonical", "filters", "value", "support", "score")], tuple(dict.fromkeys(first.sources + c.sources)))
    return ranked(list(out.values()))


def contained(found: list[Candidate], margin: float = MARGIN) -> list[Candidate]:
    """Drops a candidate if a kept one is a strict sub- or superset of it and scores more than margin times as much."""
    kept: list[Candidate] = []
    for c in ranked(found):
        own = set(components(c.canonical))
        if not any((own < other or other < own) and k.score > margin * c.score for k in kept for other in [set(components(k.canonical))]):
            kept.append(c)
    return kept


def published(findings: list[Finding], objective: Objective, baseline: float, cap: int = CAP) -> list[Candidate]:
    return contained(deduplicated(candidates(findings, objective, baseline)))[:cap]


def promoted(findings: list[Finding], objective: Objective, baseline: float, n: int = PROMOTED, k: float = SHRINK) -> list[Finding]:
    """The n best findings by shrunk score, ties by id."""
    usable = [f for f in findings if f.value is not None and f.support > 0]
    return sorted(usable, key=lambda f: (-shrunk_score(objective.delta(f.value, baseline), f.support, k), f.id))[:n]


def overlap(segment: list[Constraint], claimed: list[Constraint]) -> float:
    """Share of the claimed predicates that the segment has."""
    own, asked = set(components(key(segment))), set(components(key(claimed)))
    return len(own & asked) / len(asked) if asked else 0.0


def claim_matches(findings: list[Finding], claimed: list[Constraint]) -> list[Finding]:
    """Findings that share a predicate with the claim, the largest overlap first, otherwise in order."""
    scored = [(overlap(list(f.effective_filters), claimed), f) for f in findings]
    return [f for s, f in sorted((x for x in scored if x[0] > 0), key=lambda x: -x[0])]


def write_back(goal: str, winners: list[tuple[list[Constraint], float, int]], objective: Objective, baseline: float) -> list[dict]:
    """Triplet rows of winners with deterministic ids; their effect is relative to the global baseline and their state is shared."""
    state = derived_id(goal, "baseline_state")
    return [
        {"state_id": state, "intervention_id": derived_id(goal, "intervention", k), "outcome_id": derived_id(goal, "outcome", k), "filters": k, "value": v, "support": n, "effect_size": objective.delta(v, baseline), "sleep_derived": True}
        for s, v, n in winners
        for k in [key(s)]
    ]


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_by_key(df: DataFrame, by: str, score: str, sources: str) -> DataFrame:
    """One row for each key: the best score and the union of sources."""
    return df.groupBy(by).agg(F.max(score).alias(score), F.array_sort(F.array_distinct(F.flatten(F.collect_list(sources)))).alias(sources))


def top(df: DataFrame, k: int, score: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(tie)).limit(k)


def overlap_fraction(a, b):
    """Of array columns: shared elements by the size of b."""
    return F.size(F.array_intersect(a, b)) / F.size(b)
