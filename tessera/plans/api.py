"""The request surface: introspect, execute, analyze and text of documents, from plain dictionaries to plain results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tessera.operators import analyze as A
from tessera.operators.measure import execute as run_objective
from tessera.plans.errors import RequestShape
from tessera.plans.model import Objective, Ref, check_request, read_constraints, read_expression
from tessera.sources.profile import bind_targets, check_bins, profile


def introspect(df: DataFrame, targets: list[str] = (), quantile_bins: int = 0, distinct_cap: int = 50) -> dict[str, Any]:
    check_bins(quantile_bins)
    bound = [{"target": t, "column": c, "matched": m} for t, c, m in bind_targets(df.schema, list(targets))]
    return {"columns": profile(df, distinct_cap, quantile_bins), "targets": bound}


def read_objective(request: dict[str, Any]) -> Objective:
    expression = read_expression(request["expression"]) if request.get("expression") else Ref(str(request.get("field", "")))
    return Objective(str(request.get("aggregation", "")), expression, request.get("direction", "maximize"), request.get("entity"), request.get("time"), request.get("label", ""))


def execute(df: DataFrame, request: dict[str, Any]) -> dict[str, Any]:
    constraints = read_constraints(request.get("filters"))
    objective = read_objective(request)
    check_request(objective.aggregation, objective.expression, constraints)
    return run_objective(df, objective, constraints)


def analyze(df: DataFrame, request: dict[str, Any]) -> DataFrame:
    pairs = lambda key: [(c["name"], int(c.get("bins", 0))) for c in request.get(key) or []]
    constraints = read_constraints(request.get("filters"))
    match request.get("kind"):
        case "contingency":
            return A.contingency(df, pairs("columns"), constraints)
        case "moments":
            return A.moments(df, list(request.get("variables") or []), pairs("group_by"), constraints)
        case "stratified_effect" | "sampled_effect" as kind:
            if not request.get("aggregation"):
                raise RequestShape("an effect needs an aggregation")
            objective, treated = read_objective(request), read_constraints(request.get("segment"))  # filters do not apply to effects
            if kind == "sampled_effect":
                return A.sampled_effect(df, objective, treated, pairs("adjust"), float(request.get("fraction", 0)), int(request.get("seed", 0)))
            return A.stratified_effect(df, objective, treated, pairs("adjust"), int(request.get("random_bins", 0)), int(request.get("seed", 0)))
        case other:
            raise RequestShape(f"no analysis {other!r}")
