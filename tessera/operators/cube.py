"""The signature cube: one scan that answers every conjunction over a set of atoms.

Each row's truth of every atom becomes a bit; rows are grouped by their bits with decomposable aggregates, and a conjunction is
the fold over signatures that contain its bits. A null predicate is a 0 bit. Signatures are as many as the data has
combinations, at most; beyond most_signatures the cube is refused and candidates are measured by fused conditional aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.expressions import predicate, with_value
from tessera.operators.measure import Measurement, execute_many, guarded
from tessera.plans.canonical import key
from tessera.plans.model import Constraint, Objective

BITS = 62
MOST_SIGNATURES = 200_000


def signatures(df: DataFrame, atoms: Sequence[Constraint]) -> list[Column]:
    """Atom truths as bits of longs, BITS in each."""
    out = []
    for at in range(0, len(atoms), BITS):
        bits = [F.when(predicate(a, df.schema), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, a in enumerate(atoms[at : at + BITS])]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"sig{at // BITS}"))
    return out or [F.lit(0).cast("long").alias("sig0")]


def cube(df: DataFrame, objective: Objective, atoms: Sequence[Constraint]) -> DataFrame:
    """(sig..., rows, n, total, low, high) for each signature."""
    rows, name, kind = with_value(df, objective)
    value = F.col(name)
    if objective.aggregation.lower() == "count":
        return rows.groupBy(*signatures(df, atoms)).agg(F.count("*").alias("rows"), F.count(value).alias("n"))
    value = value.cast("double")
    return rows.groupBy(*signatures(df, atoms)).agg(F.count("*").alias("rows"), F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


class CubeMeasurer:
    """Measures conjunctions of known atoms from a collected cube; others, and objectives with too many signatures, by scans."""

    def __init__(self, df: DataFrame, objective: Objective, atoms: Sequence[Constraint], most_signatures: int = MOST_SIGNATURES):
        self.df, self.objective = df, objective
        self.bit = {key([a]): i for i, a in enumerate(atoms)}
        found = cube(df, objective, atoms).limit(most_signatures + 1).collect()
        self.rows = None if len(found) > most_signatures else found

    def __call__(self, segments: list[list[Constraint]]) -> list[Measurement | None]:
        if self.rows is None or any(key([c]) not in self.bit for s in segments for c in s):
            return list(execute_many(self.df, self.objective, segments))
        return [self.fold(s) for s in segments]

    def fold(self, segment: list[Constraint]) -> Measurement:
        masks: dict[int, int] = {}
        for c in segment:
            word, bit = divmod(self.bit[key([c])], BITS)
            masks[word] = masks.get(word, 0) | 1 << bit
        hit = [r for r in self.rows if all(r[f"sig{w}"] & m == m for w, m in masks.items())]
        support, n = sum(r["rows"] for r in hit), sum(r["n"] for r in hit)
        agg = self.objective.aggregation.lower()
        if agg == "count":
            return Measurement(float(n), support)
        if not n:
            return Measurement(None, support)
        own = [r for r in hit if r["n"]]
        total = sum(r["total"] for r in own)
        value = {"avg": total / n, "sum": total, "min": min(r["low"] for r in own), "max": max(r["high"] for r in own)}[agg]
        return Measurement(guarded(value), support)
