"""Statistics over collected summaries, standard library only."""

from __future__ import annotations

import math
from collections import defaultdict

NEARLY_ONE = 1 - 1e-12


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): a series for small x, else a continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b or tiny)
        c = b + top / c or tiny
        h *= (step := d * c)
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def chi_square_tail(statistic: float, dof: float) -> float:
    return 1.0 if statistic <= 0 or dof <= 0 else gamma_upper(dof / 2, statistic / 2)


def g_statistic(table: list[list[float]]) -> tuple[float, int]:
    """G and its degrees of freedom; rows and columns without counts do not count."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    total = sum(rows)
    dof = (sum(r > 0 for r in rows) - 1) * (sum(c > 0 for c in cols) - 1)
    if dof <= 0:
        return 0.0, 0
    return 2 * sum(o * math.log(o * total / (rows[i] * cols[j])) for i, r in enumerate(table) for j, o in enumerate(r) if o > 0), dof


def conditional_g(cells: dict[tuple, float]) -> tuple[float, int, float] | None:
    """(x, y, stratum...) -> count. Sums G and dof over strata; None if nothing is testable. Returns (G, dof, p)."""
    strata: dict[tuple, dict[tuple, float]] = defaultdict(dict)
    for (x, y, *s), n in cells.items():
        strata[tuple(s)][x, y] = strata[tuple(s)].get((x, y), 0) + n
    g, dof = 0.0, 0
    for _, counts in sorted(strata.items(), key=lambda kv: str(kv[0])):
        xs, ys = sorted({k[0] for k in counts}, key=str), sorted({k[1] for k in counts}, key=str)
        one, d = g_statistic([[counts.get((x, y), 0) for y in ys] for x in xs])
        g, dof = g + one, dof + d
    return (g, dof, chi_square_tail(g, dof)) if dof else None


def clamp(r: float) -> float:
    return max(-NEARLY_ONE, min(NEARLY_ONE, r))


def pearson(n: float, sx: float, sy: float, sxx: float, syy: float, sxy: float) -> float | None:
    if n <= 1:
        return None
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    if vx <= 0 or vy <= 0:
        return None
    return clamp((sxy - sx * sy / n) / math.sqrt(vx * vy))


def correlation_matrix(n: float, sums: list[float], squares: list[float], crosses: dict[tuple[int, int], float]) -> list[list[float]] | None:
    if n <= 1:
        return None
    k = len(sums)
    scatter = [[(squares[i] if i == j else crosses[min(i, j), max(i, j)]) - sums[i] * sums[j] / n for j in range(k)] for i in range(k)]
    if any(scatter[i][i] <= 0 for i in range(k)):
        return None
    return [[1.0 if i == j else clamp(scatter[i][j] / math.sqrt(scatter[i][i] * scatter[j][j])) for j in range(k)] for i in range(k)]


def inverse(matrix: list[list[float]]) -> list[list[float]] | None:
    """None if the determinant is within 1e-12 of 0."""
    n = len(matrix)
    both = [[*map(float, row), *(float(i == j) for j in range(n))] for i, row in enumerate(matrix)]
    determinant = 1.0
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(both[r][i]))
        if both[p][i] == 0:
            return None
        if p != i:
            both[i], both[p], determinant = both[p], both[i], -determinant
        pivot = both[i][i]
        determinant *= pivot
        both[i] = [x / pivot for x in both[i]]
        for r in range(n):
            if r != i and both[r][i]:
                f = both[r][i]
                both[r] = [x - f * y for x, y in zip(both[r], both[i], strict=True)]
    return None if abs(determinant) < 1e-12 else [row[n:] for row in both]


def partial_correlation(correlations: list[list[float]]) -> float | None:
    """Of the first two variables given the others."""
    p = inverse(correlations)
    if p is None or p[0][0] * p[1][1] <= 0:
        return None
    return clamp(-p[0][1] / math.sqrt(p[0][0] * p[1][1]))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def fisher_p(r: float, n: float, conditions: int) -> float | None:
    w = n - conditions - 3
    return two_sided(math.sqrt(w) * math.atanh(clamp(r))) if w > 0 else None


def pooled_fisher_p(rs: list[float], ns: list[float], conditions: int) -> float | None:
    """Over strata of at least conditions + 8 rows, weighted by n - conditions - 3."""
    used = [(n - conditions - 3, math.atanh(clamp(r))) for r, n in zip(rs, ns, strict=True) if n >= conditions + 8]
    total = sum(w for w, _ in used)
    return two_sided(sum(w * z for w, z in used) / math.sqrt(total)) if total > 0 else None


def benjamini_hochberg(ps: list[float], alpha: float) -> list[bool]:
    """Which hypotheses are rejected at false discovery rate alpha."""
    m = len(ps)
    order = sorted(range(m), key=ps.__getitem__)
    last = max((k for k, i in enumerate(order, 1) if ps[i] <= k * alpha / m), default=0)
    rejected = set(order[:last])
    return [i in rejected for i in range(m)]


def rejection_threshold(counted: list[tuple[float, int]], alpha: float) -> float:
    """The largest p-value that Benjamini-Hochberg rejects, from (p, number of hypotheses); below 0 if none is."""
    m, rank, out = sum(n for _, n in counted), 0, -1.0
    for p, n in sorted(counted):
        rank += n
        if p <= rank * alpha / m:
            out = p
    return out


def attenuation(value: float, reference: float) -> float:
    """1 for a vanished effect, 0 for one as large as the reference."""
    return 0.0 if reference == 0 else 1 - min(1.0, abs(value / reference))


def shrunk_score(delta: float, n: float, k: float) -> float:
    return delta * n / (n + k)
