"""Segment search over the conjunction lattice: atoms, greedy expansion, beam, and tree search with upper confidence bounds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from tessera.functions.statistics import shrunk_score
from tessera.operators.measure import Measurement
from tessera.plans.canonical import component, key
from tessera.plans.errors import RequestError
from tessera.plans.interfaces import Critic, Proposer
from tessera.plans.model import Constraint, Objective

# Defaults of the search.
MAX_MEASUREMENTS, MAX_ORDER, MIN_SUPPORT, BEAM_WIDTH = 200, 3, 30, 10
EXPLORATION, CAUSAL_SCALE, PROPOSAL_SHARE = math.sqrt(2), 1.0, 0.3
LIFT, EPSILON = 0.05, 1e-9
GREEDY_BREADTH, GREEDY_DEPTH = 3, 4

Measure = Callable[[list[list[Constraint]]], list[Measurement | None]]


@dataclass(frozen=True)
class Finding:
    """A verified observation: which predicates an intervention added, on top of which, and what was measured."""

    id: str
    new_filters: tuple[Constraint, ...]
    effective_filters: tuple[Constraint, ...]
    value: float | None
    support: int
    effect: float = 0.0


@dataclass
class Atom:
    constraint: Constraint
    #: Ids of the findings that it comes from, in order of first sight.
    sources: dict[str, None] = field(default_factory=dict)
    #: What a critic's ranking gave its column; 0 if nothing ranked it.
    prior: float = 0.0

    @property
    def key(self) -> str:
        return component(self.constraint)


def finding_atoms(findings: Iterable[Finding]) -> list[Atom]:
    """Distinct predicates that findings added, each with the findings it comes from, by key."""
    out: dict[str, Atom] = {}
    for f in findings:
        for c in f.new_filters:
            out.setdefault(component(c), Atom(c)).sources.setdefault(f.id)
    return [out[k] for k in sorted(out)]


def typed_value(text: str, kind: str) -> float | bool | str:
    return float(text) if kind == "numeric" else text.lower() == "true" if kind == "boolean" else text


def schema_atoms(profile: list[dict], exclude: Iterable[str] = ()) -> list[Atom]:
    """From a profile: equality with each known value, at most and above each quantile cut."""
    left_out, out = {e.lower() for e in exclude}, []
    for c in profile:
        if c["name"].lower() in left_out:
            continue
        if c["values"] is not None:
            out += [Atom(Constraint(c["name"], "eq", typed_value(v, c["type"]))) for v in c["values"]]
        else:
            for cut in dict.fromkeys(c["cuts"]):
                out += [Atom(Constraint(c["name"], "lte", cut)), Atom(Constraint(c["name"], "gt", cut))]
    return out


def merged_atoms(found: list[Atom], schema: list[Atom], excluded: Iterable[str] = ()) -> list[Atom]:
    """Findings' atoms win; excluded columns drop schema atoms only."""
    left_out = {e.lower() for e in excluded}
    have = {a.key for a in found}
    return found + [a for a in schema if a.key not in have and a.constraint.field.lower() not in left_out]


def ranked_priors(atoms: list[Atom], columns: list[str]) -> None:
    place = {c.lower(): i for i, c in enumerate(columns)}
    for a in atoms:
        i = place.get(a.constraint.field.lower())
        a.prior = (len(columns) - i) / len(columns) if i is not None and columns else a.prior


def contradictory(segment: Iterable[Constraint]) -> bool:
    """Two predicates on one field and operator."""
    seen = [(c.field.lower(), c.op) for c in segment]
    return len(set(seen)) < len(seen)


def kept_columns(named: list[str], schema: list[str]) -> list[str]:
    """Schema columns among the named ones, in the schema's spelling, first occurrence."""
    spelling = {s.lower(): s for s in schema}
    return list(dict.fromkeys(spelling[n.lower()] for n in named if n.lower() in spelling))


def vocabulary(found: list[Atom], profile: list[dict], critic: Critic, objective: Objective) -> list[Atom]:
    """The atoms of a search: the findings', and those of the schema's columns that a critic does not leave out, with its priors.

    Of the critic's lists only columns of the schema count, and a column that is left out is not ranked. If the critic fails there
    are the findings' atoms only.
    """
    names = [c["name"] for c in profile]
    try:
        ranked, excluded = (kept_columns(x, names) for x in critic(names, objective.label))
    except RequestError:
        return found
    atoms = merged_atoms(found, schema_atoms(profile, exclude=objective.expression.columns()), excluded)
    ranked_priors(atoms, [r for r in ranked if r not in excluded])
    return atoms


class Search:
    """Measurements memoised by canonical key, within a budget, with support pruning."""

    def __init__(self, objective: Objective, measure: Measure, baseline: float, budget: int = MAX_MEASUREMENTS, min_support: int = MIN_SUPPORT, max_order: int = MAX_ORDER):
        self.objective, self.measure, self.baseline = objective, measure, baseline
        self.budget, self.min_support, self.max_order = budget, min_support, max_order
        self.seen: dict[str, Measurement | None] = {}
        self.segments: dict[str, list[Constraint]] = {}
        self.stopped = ""

    def below_floor(self, k: str) -> bool:
        m = self.seen.get(k)
        return k in self.seen and (m is None or m.value is None or m.support < self.min_support)

    def starved(self, segment: list[Constraint]) -> bool:
        """A measured part (one predicate, or all but one) is below the floor; parts not measured never prune."""
        parts = [[c] for c in segment] + [list(s) for s in itertools.combinations(segment, len(segment) - 1)]
        return len(segment) > 1 and any(self.below_floor(key(p)) for p in parts)

    def run(self, segments: list[list[Constraint]]) -> list[str]:
        """Measures what is new, as far as the budget goes; the keys that have a measurement."""
        new = {}
        for s in segments:
            k = key(s)
            if k not in self.seen and k not in new:
                if len(self.seen) + len(new) >= self.budget:
                    self.stopped = "budget"
                    break
                new[k] = s
        if new:
            try:
                found = self.measure(list(new.values()))
            except RequestError:
                found = [None] * len(new)
            for (k, s), m in zip(new.items(), found, strict=True):
                self.seen[k], self.segments[k] = (m if m and m.support > 0 and m.value is not None else None), s
        return [k for s in segments if (k := key(s)) in self.seen]

    def delta(self, k: str) -> float:
        m = self.seen[k]
        return -math.inf if m is None else self.objective.delta(m.value, self.baseline)

    def winners(self) -> list[tuple[list[Constraint], Measurement]]:
        """Conjunctions of two or more predicates at or above the floor, best first."""
        keys = [k for k, m in self.seen.items() if m and len(self.segments[k]) >= 2 and not self.below_floor(k)]
        return [(self.segments[k], self.seen[k]) for k in sorted(keys, key=lambda k: (-self.delta(k), k))]


def beam(search: Search, atoms: list[Atom], width: int = BEAM_WIDTH) -> Search:
    """Level by level: the best `width` segments are extended by atoms ranked after their last, so no subset comes twice.

    A level is one measuring call. Segments that do not improve are extended like others; those below the floor are not.
    """
    order = [a.constraint for a in sorted(atoms, key=lambda a: a.key)]
    place = {component(c): i for i, c in enumerate(order)}
    level = [[c] for c in order]
    for size in range(1, search.max_order + 1):
        keys = search.run(level)
        if size == search.max_order or search.stopped:
            break
        best = sorted((k for k in dict.fromkeys(keys) if not search.below_floor(k)), key=lambda k: (-search.delta(k), k))[:width]
        level = []
        for k in best:
            s = search.segments[k]
            for c in order[max(place[component(x)] for x in s) + 1 :]:
                longer = [*s, c]
                if not contradictory(longer) and not search.starved(longer):
                    level.append(longer)
        if not level:
            search.stopped = search.stopped or "exhausted"
            break
    return search


@dataclass(frozen=True)
class Proposal:
    """A whole conjunction taken from a heuristic, with the similarity it was retrieved by."""

    segment: tuple[Constraint, ...]
    prior: float = 0.0
    heuristic: str = ""


class _Place:
    """A measured segment in the tree: its moves still to try, its visits and the sum of what was found at and below it."""

    def __init__(self, segment: list[Constraint], prior: float, moves: Iterable[Atom], parent: _Place | None = None):
        self.segment, self.prior, self.parent, self.moves = segment, prior, parent, list(moves)
        self.children: list[_Place] = []
        self.visits, self.total, self.spent = 0, 0.0, False

    @property
    def estimate(self) -> float:
        return self.total / self.visits if self.visits else 0.0


def column_rounds(atoms: list[Atom], floor: float = 0.0) -> list[Atom]:
    """One atom of each column in every round, columns by their prior, the strongest first, otherwise in order."""
    columns: dict[str, list[Atom]] = {}
    for a in atoms:
        columns.setdefault(a.constraint.field.lower(), []).append(a)
    ranked = sorted(columns.values(), key=lambda c: -(c[0].prior if c[0].prior > 0 else floor))
    return [a for row in itertools.zip_longest(*ranked) for a in row if a]


def causal_multiplier(sources: Iterable[str], confidence: dict[str, float], scale: float = CAUSAL_SCALE) -> float:
    return 1 + scale * max((confidence.get(s, 0.0) for s in sources), default=0.0)


def tree_search(search: Search, atoms: list[Atom], proposals: Iterable[Proposal] = (), confidence: dict[str, float] | None = None, exploration: float = EXPLORATION, proposal_share: float = PROPOSAL_SHARE, causal_scale: float = CAUSAL_SCALE) -> Search:
    """Expands before it descends, then follows prior-weighted upper confidence bounds.

    A measured segment is worth its shrunk gain times the causal weight of what it was built from (its atoms' findings, or the
    heuristic that proposed it), and nothing if it failed. A place's estimate is the mean worth at and below it; children are
    ranked by their estimate now, scaled to the range of all estimates so far. Proposals are tried at the root, the strongest
    first, as long as they have had less than their share of the root's expansions; they are pruned by support like any segment.
    """
    known, offered = confidence or {}, sorted(proposals, key=lambda p: (-p.prior, p.heuristic))
    floor = 1 / max(1, len(atoms) + len(offered))
    ordered = column_rounds(atoms, floor)
    sources = {a.key: a.sources for a in atoms}
    offered = [p for p in offered if 2 <= len(p.segment) <= search.max_order and not contradictory(p.segment)]
    root = _Place([], 1.0, ordered)
    claimed, expanded, taken = {key([])}, 0, 0
    low, high = math.inf, -math.inf

    def admissible(segment: list[Constraint]) -> bool:
        return len(segment) <= search.max_order and key(segment) not in claimed and not contradictory(segment) and not search.starved(segment)

    def peek(at: _Place) -> Proposal | Atom | None:
        """The next move; one that is not admissible now never will be again."""
        while at is root and offered and not admissible(list(offered[0].segment)):
            offered.pop(0)
        while at.moves and not admissible([*at.segment, at.moves[0].constraint]):
            at.moves.pop(0)
        if at is root and offered and (not at.moves or (taken < proposal_share * expanded if expanded else proposal_share > 0)):
            return offered[0]
        return at.moves[0] if at.moves else None

    def settle(at: _Place) -> bool:
        """Whether nothing is left to try at or below a place."""
        if not at.spent:
            at.spent = all([settle(c) for c in at.children]) and peek(at) is None
        return at.spent

    def rank(parent: _Place, child: _Place) -> tuple[float, str]:
        scaled = (child.estimate - low) / (high - low) if high > low else 0.0
        return -(scaled + exploration * child.prior * math.sqrt(parent.visits) / (1 + child.visits)), key(child.segment)

    while not search.stopped:
        if settle(root):
            search.stopped = "exhausted"
            break
        at = root
        while (move := peek(at)) is None:
            at = min((c for c in at.children if not c.spent), key=lambda c, parent=at: rank(parent, c))
        if isinstance(move, Proposal):
            segment, built_from = list(offered.pop(0).segment), {move.heuristic}
            taken += 1
        else:
            segment, built_from = [*at.segment, at.moves.pop(0).constraint], set()
        expanded += at is root
        k = key(segment)
        if not search.run([segment]):
            break
        claimed.add(k)
        for c in segment:
            built_from |= set(sources.get(component(c), ()))
        m = search.seen[k]
        worth = 0.0 if m is None else shrunk_score(search.delta(k), m.support, search.min_support) * causal_multiplier(built_from, known, causal_scale)
        child = _Place(segment, move.prior if move.prior > 0 else floor, () if search.below_floor(k) else ordered, at)
        at.children.append(child)
        while child is not None:
            child.visits += 1
            child.total += worth
            low, high = min(low, child.estimate), max(high, child.estimate)
            child = child.parent
    return search


def skip_reason(order: int, s_star: float | None, atoms: list[Atom], proposals: list, policy: str = "uct") -> str:
    """Why a search would not start; empty if it would."""
    if order < 2:
        return "order below 2"
    if policy == "uct" and s_star is None:
        return "no baseline finding"
    return "too few atoms" if len(atoms) < 2 and not proposals else ""


def s_star(findings: Iterable[Finding], objective: Objective, min_support: int = MIN_SUPPORT) -> float | None:
    """The best value among findings with enough support."""
    values = [f.value for f in findings if f.value is not None and f.support > 0 and f.support >= min_support]
    return None if not values else max(values) if objective.direction == "maximize" else min(values)


def materially_better(objective: Objective, value: float, than: float, lift: float = LIFT) -> bool:
    return objective.improves(value, than) and abs(value - than) / max(abs(than), EPSILON) >= lift


@dataclass(frozen=True)
class Recorded:
    segment: tuple[Constraint, ...]
    value: float
    support: int
    effect: float
    depth: int


def greedy(objective: Objective, measure: Measure, propose: Proposer, root_value: float, constraints: list[Constraint] = (), breadth: int = GREEDY_BREADTH, depth: int = GREEDY_DEPTH) -> list[Recorded]:
    """Depth-first growth: siblings are measured in one call, every one with rows is recorded, and those that improve on their parent grow on.

    An expansion whose segments all lack rows is proposed once more. Effects are relative to the parent.
    """
    out: list[Recorded] = []

    def grow(at: tuple[Constraint, ...], parent: float, level: int) -> None:
        if level > depth:
            return
        for attempt in range(2):
            new = [c for c in propose(at, attempt)[:breadth] if not contradictory([*at, c])]
            found = measure([[*at, c] for c in new]) if new else []
            usable = [(c, m) for c, m in zip(new, found, strict=True) if m and m.support > 0 and m.value is not None]
            if usable:
                break
        for c, m in usable:
            segment = (*at, c)
            out.append(Recorded(segment, m.value, m.support, m.value - parent, level))
            if objective.improves(m.value, parent) and objective.satisfied(m.value, constraints):
                grow(segment, m.value, level + 1)

    grow((), root_value, 1)
    return out


def schema_proposer(atoms: list[Atom], measure: Measure, objective: Objective, baseline: float) -> Proposer:
    """The deterministic proposer: atoms by their single gain, the best first; a second attempt goes further down the list."""
    found = measure([[a.constraint] for a in atoms])
    gains = {a.key: objective.delta(m.value, baseline) for a, m in zip(atoms, found, strict=True) if m and m.value is not None}
    order = sorted((a for a in atoms if a.key in gains), key=lambda a: (-gains[a.key], a.key))

    def propose(at: tuple[Constraint, ...], attempt: int) -> list[Constraint]:
        used = {c.field.lower() for c in at}
        return [a.constraint for a in order if a.constraint.field.lower() not in used][attempt * GREEDY_BREADTH :]

    return propose


def grounded(retrieved: list[tuple[str, list[list[Constraint]], float]], columns: list[dict], max_order: int = MAX_ORDER, kept_each: int = 3, tried_each: int = 9) -> list[Proposal]:
    """Proposals from retrieved heuristics (id, conjunctions, distance): of known columns and values, prior 1 - distance / 2."""
    from tessera.sources.profile import unknown_columns, unknown_values

    names, out = [c["name"] for c in columns], []
    for heuristic, conjunctions, distance in retrieved:
        kept = 0
        for s in conjunctions[:tried_each]:
            if kept == kept_each:
                break
            if 2 <= len(s) <= max_order and not contradictory(s) and not unknown_columns([c.field for c in s], names) and not unknown_values(s, columns):
                out.append(Proposal(tuple(s), 1 - distance / 2, heuristic))
                kept += 1
    return out


def same_source(origin: str, ref: str, terms: list[str], names: dict[str, str]) -> bool:
    """Whether a heuristic's bracketed terms can be read back on this source: same reference, and every term resolves."""
    return origin == ref and all(t in names for t in terms)


@dataclass(frozen=True)
class Extracted:
    field: str
    method: str
    value: str
    confidence: float
    effect: float
    depth: int


def extraction(fields: list[str], methods: list[str], extract: Callable[[str, str, Extracted | None], tuple[str, float] | None], depth: int = GREEDY_DEPTH) -> list[Extracted]:
    """Greedy growth for documents: an extractor tries each method on each field, and goes on where confidence rises.

    extract: (field, method, parent) -> value and confidence, or None. The effect is the gain in confidence on the parent.
    """
    out: list[Extracted] = []

    def grow(name: str, parent: Extracted | None, level: int) -> None:
        for m in methods:
            if (found := extract(name, m, parent)) is not None:
                before = parent.confidence if parent else 0.0
                one = Extracted(name, m, found[0], found[1], found[1] - before, level)
                out.append(one)
                if level < depth and found[1] > before:
                    grow(name, one, level + 1)

    for f in fields:
        grow(f, None, 1)
    return out
