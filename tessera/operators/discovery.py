"""Causal discovery over columns: conditional-independence tests, a level-wise skeleton sweep, and edge orientation.

All data access is through contingency tables and moments. A sweep folds the rows once into cells, one for each combination of bins
and categories with its sums, and every test is a sum over cells, on the driver if all cells together are at most HELD_NUMBERS keys
and sums. Where the cells would be too many to fold, rows are read again: the tests of
one level are independent of each other, so a level takes their tables and moments together. Each row becomes one narrow row for every
distinct set of columns asked about, which partial aggregation folds at once, and a level costs a scan for every AT_ONCE sets, not
one for every test.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import statistics as S
from tessera.operators.analyze import all_cuts, check_finite, group_keys
from tessera.plans.errors import RequestError
from tessera.plans.interfaces import OrientationPrior, abstaining_prior
from tessera.plans.model import Constraint, Objective
from tessera.sources.profile import resolve

# Defaults of the sweep.
ALPHA, MAX_CONDITIONS, BINS, COLUMN_CAP, MAX_TESTS = 0.05, 2, 4, 50, 20_000
#: Column sets whose tables or moments come from one scan.
AT_ONCE = 128
#: Cells and sums of a cell up to which a sweep folds its rows.
MAX_CELLS, MAX_SUMS = 100_000, 200
#: Keys and sums of all cells up to which the driver holds them.
HELD_NUMBERS = 1_000_000
TESTED, UNKNOWN, CAPPED = "tested", "unknown", "budget_capped"


@dataclass(frozen=True)
class Variable:
    name: str
    numeric: bool


Edge = tuple[str, str]


def edge(a: str, b: str) -> Edge:
    return (a, b) if a < b else (b, a)


Asked = tuple[str, str, tuple[str, ...]]


def present(df: DataFrame) -> DataFrame:
    """Rows without nulls; a NaN is a value, which the sums will show."""
    for c in df.columns:
        df = df.where(F.col(c).isNotNull())
    return df


class Held:
    """Cells gathered on the driver, a column an array."""

    def __init__(self, cells: DataFrame):
        table = cells.toArrow()  # at most HELD_NUMBERS of keys and sums
        self.valid, self.value, self.labels = {}, {}, {}
        for name in table.column_names:
            column = table[name].combine_chunks()
            self.valid[name] = column.is_valid().to_numpy(zero_copy_only=False)
            if name.startswith("k_"):
                column = column.dictionary_encode()
                self.labels[name], column = column.dictionary.to_pylist(), column.indices
            self.value[name] = column.fill_null(0).to_numpy(zero_copy_only=False)

    def summed(self, keys: list[str], sums: dict[str, str]) -> list[dict]:
        """Rows (g_i: key, n, sums...) over the cells without nulls in keys and sums."""
        whole = np.ones(len(self.value["n"]), dtype=bool)
        for c in (*keys, *sums.values()):
            whole &= self.valid[c]
        group = np.zeros(whole.sum(), dtype=np.int64)
        for c in keys:
            group = np.unique(group * len(self.labels[c]) + self.value[c][whole], return_inverse=True)[1]
        first = np.unique(group, return_index=True)[1]
        own = {f"g{j}": [self.labels[c][i] for i in self.value[c][whole][first]] for j, c in enumerate(keys)}
        own["n"] = [round(x) for x in np.bincount(group, self.value["n"][whole])]
        own |= {f: np.bincount(group, self.value[c][whole]).tolist() for f, c in sums.items()}
        return [dict(zip(own, r, strict=True)) for r in zip(*own.values(), strict=True)]


@dataclass(frozen=True)
class Folded:
    """Cells (k_i: key of the i-th column; n: rows; s_i, q_i, x_i_j: sums of numbers, squares and products) and the columns' places.

    A key is null where its column is, so a cell's rows have the same nulls, and a sum is null where there is nothing to sum.
    """

    cells: DataFrame
    place: dict[str, int]
    held: Held | None = None

    def keys(self, names: Iterable[str]) -> list[str]:
        return [f"k_{self.place[n]}" for n in names]

    def sums(self, names: tuple[str, ...]) -> dict[str, str]:
        """The columns of moments, each with its column of the cells."""
        own = [self.place[n] for n in names]
        out = {f"{f}_{i}": f"{c}_{p}" for i, p in enumerate(own) for f, c in (("sum", "s"), ("sumsq", "q"))}
        return out | {f"cross_{i}_{j}": f"x_{min(own[i], own[j])}_{max(own[i], own[j])}" for i, j in itertools.combinations(range(len(own)), 2)}


def binned_keys(df: DataFrame, columns: list[Variable], bins: int, cuts: dict[str, list[float]]) -> list[Column]:
    """The key of each column, null where the column is."""
    return [F.when(resolve(df.schema, v.name).column.isNotNull(), group_keys(df, [(v.name, bins if v.numeric else 0)], cuts)[0]) for v in columns]


def folded(df: DataFrame, columns: list[Variable], bins: int, cuts: dict[str, list[float]], levels: dict[str, int] | None = None) -> Folded | None:
    """The cells of all columns, kept until they are unpersisted; None if there may be too many of them or of their sums.

    levels: the values of each column that is no number, if they are known. Should all combinations be few, cells are not counted beforehand.
    """
    numbers = [i for i, v in enumerate(columns) if v.numeric]
    if len(numbers) * (len(numbers) + 3) // 2 > MAX_SUMS:
        return None
    keys = [k.alias(f"k_{i}") for i, k in enumerate(binned_keys(df, columns, bins, cuts))]
    wide = len(columns) + 1 + len(numbers) * (len(numbers) + 3) // 2
    many = math.prod(1 + (len(cuts[f"{v.name}\0{bins}"]) + 1 if v.numeric else levels[v.name]) for v in columns) if levels is not None else None
    if many is None or many > MAX_CELLS or many * wide > HELD_NUMBERS:
        many = df.select(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    if many > MAX_CELLS:
        return None
    value = {i: resolve(df.schema, columns[i].name).column.cast("double").alias(f"v_{i}") for i in numbers}
    rows, v = df.select(*keys, *value.values()), {i: F.col(f"v_{i}") for i in numbers}
    sums = [x for i in numbers for x in (F.sum(v[i]).alias(f"s_{i}"), F.sum(v[i] * v[i]).alias(f"q_{i}"))]
    sums += [F.sum(v[i] * v[j]).alias(f"x_{i}_{j}") for i, j in itertools.combinations(numbers, 2)]
    cells = rows.groupBy(*[f"k_{i}" for i in range(len(columns))]).agg(F.count("*").alias("n"), *sums)
    place = {c.name: i for i, c in enumerate(columns)}
    if many * wide <= HELD_NUMBERS:
        return Folded(cells, place, Held(cells))
    return Folded(cells.persist(StorageLevel.MEMORY_AND_DISK), place)


def of_cells(cells: Folded, part: list[tuple], keys: Callable, sums: Callable) -> list:
    """For each entry of part its cells, summed by its keys: rows (set, keys..., n, sums...)."""
    k, s = [keys(x) for x in part], [sums(x) for x in part]
    if cells.held:
        return [Row(set=i, **r) for i in range(len(part)) for r in cells.held.summed(k[i], s[i])]
    width, names = max(map(len, k)), list(max(s, key=len))
    fill = lambda own: [F.col(own[j]) if j < len(own) else F.lit("") for j in range(width)]
    wide = F.array(*[F.struct(F.lit(i).alias("set"), *[c.alias(f"g{j}") for j, c in enumerate(fill(k[i]))], F.col("n"), *[(F.col(s[i][f]) if f in s[i] else F.lit(0.0)).alias(f) for f in names]) for i in range(len(part))])
    rows = present(cells.cells.select(F.explode(wide).alias("x")).select("x.*"))
    return rows.groupBy("set", *[f"g{j}" for j in range(width)]).agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in names]).collect()  # bounded by sets and categories


def moments_of_sets(df: DataFrame, sets: list[tuple[tuple[str, ...], tuple[str, ...]]], cells: Folded | None = None) -> dict[tuple, list[dict]]:
    """For (variables, groups) the rows that collected_moments has, of complete cases; several sets from one scan."""
    out: dict[tuple, list[dict]] = {s: [] for s in sets}
    for at in range(0, len(sets), AT_ONCE):
        part = sets[at : at + AT_ONCE]
        if cells:
            for r in of_cells(cells, part, lambda s: cells.keys(s[1]), lambda s: cells.sums(s[0])):
                out[part[r["set"]]].append(r.asDict())
            continue
        k, g = max(len(v) for v, _ in part), max(len(x) for _, x in part)
        values = lambda v: [resolve(df.schema, n).column.cast("double") for n in v] + [F.lit(0.0)] * (k - len(v))
        keys = lambda x: [resolve(df.schema, n).column.cast("string") for n in x] + [F.lit("")] * (g - len(x))
        wide = F.array(*[F.struct(F.lit(i).alias("set"), *[c.alias(f"g{j}") for j, c in enumerate(keys(x))], *[c.alias(f"v{j}") for j, c in enumerate(values(v))]) for i, (v, x) in enumerate(part)])
        names = [f"g{j}" for j in range(g)]
        rows = present(df.select(F.explode(wide).alias("x")).select("x.*"))
        own = [F.col(f"v{j}") for j in range(k)]
        aggregates = [F.count("*").alias("n")]
        for i, c in enumerate(own):
            aggregates += [F.sum(c).alias(f"sum_{i}"), F.sum(c * c).alias(f"sumsq_{i}")]
        aggregates += [F.sum(own[i] * own[j]).alias(f"cross_{i}_{j}") for i, j in itertools.combinations(range(k), 2)]
        for r in rows.groupBy("set", *names).agg(*aggregates).collect():  # bounded by sets and categories
            out[part[r["set"]]].append(r.asDict())
    for (variables, _), rows in out.items():
        rows.sort(key=lambda r: tuple(v for f, v in r.items() if f.startswith("g")))
        if not rows:  # as over no rows at all
            rows.append({"n": 0} | {f"{f}_{i}": 0.0 for f in ("sum", "sumsq") for i in range(len(variables))} | {f"cross_{i}_{j}": 0.0 for i, j in itertools.combinations(range(len(variables)), 2)})
    return out


def tables_of_sets(df: DataFrame, sets: list[tuple[str, ...]], by: dict[str, Variable], bins: int, cuts: dict[str, list[float]], cells: Folded | None = None) -> dict[tuple, dict[tuple, int]]:
    """For each set of columns its contingency table over complete cases, numbers in bins; several sets from one scan."""
    out: dict[tuple, dict[tuple, int]] = {s: {} for s in sets}
    for at in range(0, len(sets), AT_ONCE):
        part = sets[at : at + AT_ONCE]
        if cells:
            for r in of_cells(cells, part, cells.keys, lambda s: {}):
                own = part[r["set"]]
                out[own][tuple(r)[1 : 1 + len(own)]] = r["n"]
            continue
        width = max(map(len, part))
        used = sorted({n for s in part for n in s})
        keyed = df.select(*[k.alias(f"k{i}") for i, k in enumerate(binned_keys(df, [by[n] for n in used], bins, cuts))])
        place = {n: F.col(f"k{i}") for i, n in enumerate(used)}
        wide = F.array(*[F.struct(F.lit(i).alias("set"), *[(place[s[j]] if j < len(s) else F.lit("")).alias(f"c{j}") for j in range(width)]) for i, s in enumerate(part)])
        rows = present(keyed.select(F.explode(wide).alias("x")).select("x.*"))
        for r in rows.groupBy("set", *[f"c{j}" for j in range(width)]).agg(F.count("*").alias("n")).collect():  # bounded by bins and categories
            own = part[r["set"]]
            out[own][tuple(r)[1 : 1 + len(own)]] = r["n"]
    return out


def independence_ps(df: DataFrame, by: dict[str, Variable], asked: list[Asked], bins: int = BINS, cuts: dict[str, list[float]] | None = None, cells: Folded | None = None) -> list[float | None | RequestError]:
    """p-values of independence of the first two of each test given the others; None if untestable, an error if the data are at fault.

    Two numbers: Fisher z of the (partial) correlation, pooled over the strata of categorical conditions. Otherwise a conditional
    G-test, numbers in quantile bins.
    """
    plans, wanted, tables = [], {}, {}
    for a, b, given in asked:
        groups, numbers = tuple(g for g in given if not by[g].numeric), tuple(g for g in given if by[g].numeric)
        if by[a].numeric and by[b].numeric:
            plans.append((True, ((a, b, *numbers), groups)))
            wanted[plans[-1][1]] = None
        else:
            plans.append((False, (a, b, *given)))
            tables[plans[-1][1]] = None
    if cuts is None:
        cuts = all_cuts(df, sorted({n for t in tables for n in t if by[n].numeric}), bins)
    found, counts = moments_of_sets(df, list(wanted), cells), tables_of_sets(df, list(tables), by, bins, cuts, cells)
    out: list[float | None | RequestError] = []
    for by_moments, key in plans:
        if by_moments:
            try:
                out.append(correlation_p(check_finite(found[key], len(key[0])), len(key[0]), bool(key[1])))
            except RequestError as error:
                out.append(error)
        else:
            g = S.conditional_g(counts[key])
            out.append(None if g is None else g[2])
    return out


def correlation_p(rows: list[dict], k: int, pooled: bool) -> float | None:
    """Of the moments of k variables in each stratum: the first two given the others."""
    tests = []
    for r in rows:
        m = S.correlation_matrix(r["n"], [r[f"sum_{i}"] for i in range(k)], [r[f"sumsq_{i}"] for i in range(k)], {(i, j): r[f"cross_{i}_{j}"] for i, j in itertools.combinations(range(k), 2)})
        if m is not None and (rho := S.partial_correlation(m)) is not None:
            tests.append((rho, r["n"]))
    if not tests:
        return None
    return S.pooled_fisher_p([t[0] for t in tests], [t[1] for t in tests], k - 2) if pooled else S.fisher_p(*tests[0], k - 2)


def independence_p(df: DataFrame, x: Variable, y: Variable, given: list[Variable] = (), bins: int = BINS, cuts: dict[str, list[float]] | None = None) -> float | None:
    """One test of independence_ps."""
    (p,) = independence_ps(df, {v.name: v for v in (x, y, *given)}, [(x.name, y.name, tuple(g.name for g in given))], bins, cuts)
    if isinstance(p, RequestError):
        raise p
    return p


@dataclass
class Skeleton:
    edges: set[Edge]
    separators: dict[Edge, tuple[str, ...]] = field(default_factory=dict)
    status: dict[Edge, str] = field(default_factory=dict)
    p: dict[Edge, float] = field(default_factory=dict)
    tests: int = 0
    truncated: bool = False
    excluded: list[str] = field(default_factory=list)
    #: Every column that was tested, whether or not an edge of it is left.
    columns: list[str] = field(default_factory=list)

    def neighbours(self, v: str) -> set[str]:
        return {b if a == v else a for a, b in self.edges if v in (a, b)}


Test = Callable[[str, str, tuple[str, ...]], float | None]
Tests = Callable[[list[Asked]], list[float | None | RequestError]]


def one_by_one(test: Test) -> Tests:
    """A test of one pair as a test of many; only an error of the request or its data is a result, any other is raised."""

    def tried(a: str, b: str, given: tuple[str, ...]) -> float | None | RequestError:
        try:
            return test(a, b, given)
        except RequestError as error:
            return error

    return lambda asked: [tried(*x) for x in asked]


def independent(ps: list[float], alpha: float, correction: str = "bh") -> list[bool]:
    """Under bh what is not rejected is independent; without a correction p above alpha is."""
    return [not r for r in S.benjamini_hochberg(ps, alpha)] if correction == "bh" else [p > alpha for p in ps]


def capped_columns(names: list[str], priority: list[str], tests: Tests, cap: int = COLUMN_CAP) -> tuple[list[str], list[str]]:
    """Priority columns first, then those most associated with one of them, ties by name; the others are left out."""
    if len(names) <= cap:
        return list(names), []
    first = list(dict.fromkeys(p for p in priority if p in names))[:cap]
    asked = [(n, q, ()) for n in names if n not in first for q in first]
    strength = {n: 1.0 for n in names if n not in first}
    for (n, _, _), p in zip(asked, tests(asked), strict=True):
        if isinstance(p, float):
            strength[n] = min(strength[n], p)
    chosen = first + sorted(strength, key=lambda n: (strength[n], n))[: cap - len(first)]
    return chosen, sorted(set(names) - set(chosen))


def skeleton(names: list[str], tests: Tests, alpha: float = ALPHA, max_conditions: int = MAX_CONDITIONS, max_tests: int = MAX_TESTS, correction: str = "bh") -> Skeleton:
    """Starts complete and removes independent pairs level by level.

    Conditioning sets come from both ends' neighbours at the start of a level and removals are made at its end, so the result
    does not depend on the order of pairs. A pair with a failed test is kept as unknown; tests are asked for a whole level.
    """
    out = Skeleton({edge(a, b) for a, b in itertools.combinations(sorted(names), 2)}, columns=list(names))
    out.status = dict.fromkeys(out.edges, TESTED)
    for level in range(max_conditions + 1):
        pool = {e: sorted((out.neighbours(e[0]) | out.neighbours(e[1])) - set(e)) for e in sorted(out.edges)}
        count = {e: math.comb(len(c), level) for e, c in pool.items()}
        if out.tests + sum(count.values()) > max_tests:
            out.truncated = True
            for e, n in count.items():
                if n and out.status[e] != UNKNOWN:
                    out.status[e] = CAPPED
            break
        asked = [(e, s) for e, c in pool.items() for s in itertools.combinations(c, level)]
        if not asked:
            break
        results = tests([(*e, given) for e, given in asked])
        out.tests += len(asked)
        done = [(e, given, p) for (e, given), p in zip(asked, results, strict=True) if isinstance(p, float)]
        for (e, _), p in zip(asked, results, strict=True):
            if isinstance(p, RequestError):
                out.status[e] = UNKNOWN
        drop: dict[Edge, tuple] = {}
        for (e, s, p), free in zip(done, independent([p for *_, p in done], alpha, correction), strict=True):
            out.p[e] = min(p, out.p.get(e, 1.0)) if not free else out.p.get(e, p)
            if free and out.status[e] != UNKNOWN:
                rank = (-p, len(s), s)
                if e not in drop or rank < drop[e]:
                    drop[e] = rank
        for e, (p, _, s) in drop.items():
            out.edges.discard(e)
            out.separators[e], out.p[e] = s, -p
    return out


class Orientation:
    """Directed and undirected edges of a skeleton."""

    def __init__(self, found: Skeleton):
        self.found, self.directed = found, set()
        self.open = {e for e in found.edges}

    def adjacent(self, a: str, b: str) -> bool:
        return edge(a, b) in self.found.edges

    def undirected(self, a: str, b: str) -> bool:
        return edge(a, b) in self.open

    def orient(self, a: str, b: str) -> bool:
        if not self.undirected(a, b) or self.found.status[edge(a, b)] != TESTED:
            return False
        self.open.discard(edge(a, b))
        self.directed.add((a, b))
        return True

    def nodes(self) -> list[str]:
        return sorted({v for e in self.found.edges for v in e})

    def colliders(self) -> None:
        """x -> z <- y for unshielded x - z - y whose separator lacks z."""
        todo = []
        for z in self.nodes():
            for x, y in itertools.combinations(sorted(self.found.neighbours(z)), 2):
                if not self.adjacent(x, y) and (s := self.found.separators.get(edge(x, y))) is not None and z not in s:
                    if all(self.found.status[edge(v, z)] == TESTED for v in (x, y)):
                        todo.append((x, y, z))
        for x, y, z in todo:
            for v in (x, y):
                if (z, v) not in self.directed:
                    self.orient(v, z)

    def implied(self, a: str, b: str) -> bool:
        """Whether one of the four propagation rules forces a -> b."""
        into = lambda v: {x for x, y in self.directed if y == v}
        if any(not self.adjacent(x, b) for x in into(a) if x != b):
            return True  # else a new collider at a
        if any((a, x) in self.directed for x in into(b)):
            return True  # else a cycle
        sides = [x for x in into(b) if self.undirected(a, x)]
        if any(not self.adjacent(x, y) for x, y in itertools.combinations(sorted(sides), 2)):
            return True
        return any((c, d) in self.directed and not self.adjacent(c, b) and self.adjacent(a, d) and self.undirected(a, c) for d in into(b) for c in into(d))

    def propagate(self) -> None:
        changed = True
        while changed:
            changed = False
            for a, b in sorted(self.open):
                if self.implied(a, b):
                    changed |= self.orient(a, b)
                elif self.implied(b, a):
                    changed |= self.orient(b, a)

    def apply_prior(self, prior: OrientationPrior) -> None:
        """Outside knowledge, asked once for all edges that are left: it may orient them, never add or remove one."""
        for e, d in prior(sorted(self.open)).items():
            if d and edge(*d) == e and e in self.open:
                self.orient(*d)


def oriented(found: Skeleton, prior: OrientationPrior = abstaining_prior) -> Orientation:
    out = Orientation(found)
    out.colliders()
    out.propagate()
    out.apply_prior(prior)
    return out


def variables(profile: list[dict]) -> list[Variable]:
    return [Variable(c["name"], c["type"] == "numeric") for c in profile if c["type"] != "temporal"]


def priority_columns(objective: Objective, constraints: Iterable[Constraint], findings: Iterable[Iterable[Constraint]], names: list[str]) -> list[str]:
    """Columns that discovery must keep: the objective's, then the hard constraints', then those that findings filter on."""
    asked = [*objective.expression.columns(), *(c.field for c in constraints), *(c.field for f in findings for c in f)]
    spelling = {n.lower(): n for n in names}
    return list(dict.fromkeys(spelling[a.lower()] for a in asked if a.lower() in spelling))


def discover(df: DataFrame, columns: list[Variable], priority: Iterable[str] = (), alpha: float = ALPHA, max_conditions: int = MAX_CONDITIONS, bins: int = BINS, max_tests: int = MAX_TESTS, correction: str = "bh", column_cap: int = COLUMN_CAP, prior: OrientationPrior = abstaining_prior) -> tuple[Skeleton, Orientation]:
    by = {v.name: v for v in columns}
    levels = {v.name: F.approx_count_distinct(resolve(df.schema, v.name).column.cast("string")) for v in columns if not v.numeric}
    numbers = [v.name for v in columns if v.numeric]
    cuts = all_cuts(df, numbers, bins, levels)
    cells = folded(df, columns, bins, cuts, levels if numbers else None)
    tests = lambda asked: independence_ps(df, by, asked, bins, cuts, cells)
    try:
        names, excluded = capped_columns([v.name for v in columns], list(priority), tests, column_cap)
        found = skeleton(names, tests, alpha, max_conditions, max_tests, correction)
    finally:
        if cells:
            cells.cells.unpersist()
    found.excluded = excluded
    return found, oriented(found, prior)


def layers(directed: set[tuple[str, str]]) -> dict[str, int]:
    """The longest directed path to each node; nodes on cycles come last."""
    nodes = {v for e in directed for v in e}
    out: dict[str, int] = {}
    left = set(nodes)
    while ready := {v for v in left if all(a not in left for a, b in directed if b == v)}:
        for v in ready:
            out[v] = max((out[a] + 1 for a, b in directed if b == v), default=0)
        left -= ready
    return out | dict.fromkeys(left, max(out.values(), default=-1) + 1)
