"""Measures an objective and its row support inside segments."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.expressions import aggregated, segment, with_value
from tessera.plans.errors import NonFiniteValue, RequestShape
from tessera.plans.model import Constraint, Objective

ROW_COUNT = "row_count"


@dataclass(frozen=True)
class Measurement:
    value: float | None
    support: int


def measured(df: DataFrame, objective: Objective, constraints: list[Constraint] = (), value: str = "value", support: str = "support") -> DataFrame:
    """One row (value, support). The filter stands after the value, so windows see rows outside the segment."""
    test = segment(constraints, df.schema)
    rows, name, kind = with_value(df, objective)
    return rows.where(test).agg(aggregated(objective.aggregation.lower(), F.col(name), kind).alias(value), F.count(F.lit(1)).alias(support))


def guarded(value: float | None) -> float | None:
    if value is not None and not math.isfinite(value):
        raise NonFiniteValue(str(value))
    return value


def execute(df: DataFrame, objective: Objective, constraints: list[Constraint] = ()) -> dict[str, float | int | None]:
    """The value under the objective's label and the support as row_count."""
    if objective.label == ROW_COUNT:
        raise RequestShape(f"{ROW_COUNT} is reserved")
    row = measured(df, objective, constraints).first()
    return {objective.label: guarded(row["value"]), ROW_COUNT: row["support"]}


def execute_many(df: DataFrame, objective: Objective, segments: list[list[Constraint]], at_once: int = 20) -> list[Measurement]:
    """Measures many segments with conditional aggregates, at_once segments in each scan."""
    rows, name, kind = with_value(df, objective)
    out = []
    for i in range(0, len(segments), at_once):
        aggregates = []
        for s in segments[i : i + at_once]:
            test = segment(s, df.schema)
            aggregates += [aggregated(objective.aggregation.lower(), F.when(test, F.col(name)), kind), F.count(F.when(test, 1))]
        row = rows.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggregates)]).first()
        out += [Measurement(guarded(row[2 * k]), row[2 * k + 1]) for k in range(len(aggregates) // 2)]
    return out
