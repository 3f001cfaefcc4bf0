"""Compiles value expressions and constraints to Columns, with coarse types checked on the way."""

from __future__ import annotations

import operator
from functools import reduce, singledispatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ieee import divide
from tessera.plans import model as M
from tessera.plans.errors import NonNumeric, RequestShape, TypeIncompatible, UnknownOperator
from tessera.sources.profile import BOOLEAN, NUMERIC, STRING, TEMPORAL, numeric, orderable, resolve

Typed = tuple[Column, str]

_compare = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_arithmetic = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": divide}
_spark_cast = {"DOUBLE": ("double", NUMERIC), "VARCHAR": ("string", STRING), "BOOLEAN": ("boolean", BOOLEAN)}


def kind_of(value: M.Scalar) -> str:
    return BOOLEAN if isinstance(value, bool) else STRING if isinstance(value, str) else NUMERIC


class Scope:
    """What an expression is compiled against: a schema, and the entity's ordered history if windows are allowed."""

    def __init__(self, schema: T.StructType, entity: str | None = None, time: str | None = None):
        self.schema, self.entity, self.time = schema, entity, time

    def history(self):
        """One entity's rows in time order; the other columns, in schema order, break ties."""
        if not (self.entity and self.time):
            raise RequestShape("a window needs an entity and a time column")
        entity, time = resolve(self.schema, self.entity), resolve(self.schema, self.time)
        if not orderable(time.kind):
            raise TypeIncompatible(f"{time.name} has no order")
        rest = [resolve(self.schema, f.name) for f in self.schema.fields if f.name not in (entity.name, time.name)]
        return Window.partitionBy(entity.column).orderBy(*[c.column.asc_nulls_last() for c in (time, *rest)])


def aggregated(agg: str, value: Column, kind: str) -> Column:
    """An aggregate of an operand: count takes any type, the others numbers and booleans as 0/1. Always a double."""
    if agg == "count":
        return F.count(value).cast("double")
    if kind == BOOLEAN:
        value, kind = value.cast("int"), NUMERIC
    if kind != NUMERIC:
        raise NonNumeric(f"{agg} over a {kind} value")
    if agg == "sum":
        # an integer sum beyond 64 bits widens
        return F.sum(value).cast("double")
    return {"avg": F.avg, "min": F.min, "max": F.max}[agg](value).cast("double")


def operand(value: Column, kind: str, agg: str, data_type: T.DataType | None = None) -> Column:
    """Operands in double, summed integers exactly: averages of decimals would round, sums of longs overflow."""
    if agg == "sum" and isinstance(data_type, T.IntegralType):
        return value.cast("decimal(38,0)")
    return value.cast("double") if kind == NUMERIC else value


@singledispatch
def compiled(e: M.Expression, scope: Scope) -> Typed:
    raise TypeIncompatible(f"no meaning for {type(e).__name__}")


@compiled.register
def _(e: M.Ref, scope: Scope) -> Typed:
    c = resolve(scope.schema, e.name)
    return c.column, c.coarse


@compiled.register
def _(e: M.Value, scope: Scope) -> Typed:
    return F.lit(e.value), kind_of(e.value)


@compiled.register
def _(e: M.Cast, scope: Scope) -> Typed:
    value, kind = compiled(e.operand, scope)
    target, result = _spark_cast[e.to.strip().upper()]
    if result != STRING and kind in (STRING, TEMPORAL):
        raise TypeIncompatible(f"{kind} to {e.to}")
    return value.cast(target), result


@compiled.register
def _(e: M.Comparison, scope: Scope) -> Typed:
    (left, a), (right, b) = compiled(e.left, scope), compiled(e.right, scope)
    if a != b:
        raise TypeIncompatible(f"{a} {e.op} {b}")
    # nulls compare to 0
    return F.when(_compare[e.op](left, right), 1).otherwise(0), NUMERIC


@compiled.register
def _(e: M.Arithmetic, scope: Scope) -> Typed:
    (left, a), (right, b) = compiled(e.left, scope), compiled(e.right, scope)
    if (a, b) != (NUMERIC, NUMERIC):
        raise NonNumeric(f"{a} {e.op} {b}")
    return _arithmetic[e.op](left.cast("double"), right.cast("double")), NUMERIC


@compiled.register
def _(e: M.Case, scope: Scope) -> Typed:
    out = None
    for when, then in e.branches:
        (test, kind), (value, result) = compiled(when, scope), compiled(then, scope)
        if kind not in (BOOLEAN, NUMERIC):
            raise TypeIncompatible(f"a {kind} condition")
        if result != NUMERIC:
            raise NonNumeric(f"a {result} branch")
        test = test != 0 if kind == NUMERIC else test
        out = F.when(test, value.cast("double")) if out is None else out.when(test, value.cast("double"))
    if e.default is not None:
        value, result = compiled(e.default, scope)
        if result != NUMERIC:
            raise NonNumeric(f"a {result} default")
        out = out.otherwise(value.cast("double"))
    return out, NUMERIC


@compiled.register
def _(e: M.Lag, scope: Scope) -> Typed:
    value, kind = compiled(e.inner, scope)
    return F.lag(value, e.offset).over(scope.history()), kind


@compiled.register
def _(e: M.Trailing, scope: Scope) -> Typed:
    value, kind = compiled(e.inner, scope)
    agg = e.agg.lower()
    before = scope.history().rowsBetween(-e.size, -1)
    if agg == "count":
        return F.count(value).over(before).cast("double"), NUMERIC
    if kind == BOOLEAN:
        value, kind = value.cast("int"), NUMERIC
    if kind != NUMERIC:
        raise NonNumeric(f"trailing {agg} over a {kind} value")
    return {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg](value.cast("double")).over(before), NUMERIC


def predicate(c: M.Constraint, schema: T.StructType) -> Column:
    c.check()
    if c.op in M.THRESHOLD_OPS:
        return _compare[M.THRESHOLD_OPS[c.op]](numeric(schema, c.field).column, F.lit(float(c.value)))
    own = resolve(schema, c.field)
    for v in c.members:
        if kind_of(v) != own.coarse:
            raise TypeIncompatible(f"{c.field} is {own.coarse}, {v!r} is {kind_of(v)}")
    if c.op in M.EQUALITY_OPS:
        return _compare[M.EQUALITY_OPS[c.op]](own.column, F.lit(c.value))
    if c.op in M.MEMBER_OPS:
        inside = own.column.isin(*c.value)
        return inside if c.op == "in" else ~inside
    raise UnknownOperator(c.op)


def segment(constraints, schema: T.StructType) -> Column:
    """A conjunction; no predicates hold everywhere."""
    return reduce(operator.and_, [predicate(c, schema) for c in constraints], F.lit(True))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_value(df: DataFrame, objective: M.Objective) -> tuple[DataFrame, str, str]:
    """df with the objective's value per row in a new column, its name and coarse type; windows see the whole history."""
    objective.check()
    value, kind = compiled(objective.expression, Scope(df.schema, objective.entity, objective.time))
    data_type = resolve(df.schema, objective.expression.name).kind if isinstance(objective.expression, M.Ref) else None
    if objective.aggregation.lower() != "count":
        if kind not in (NUMERIC, BOOLEAN):
            raise NonNumeric(f"{objective.aggregation} over a {kind} value")
        value = operand(value, kind, objective.aggregation.lower(), data_type)
    name = free_name(df, "objective_value")
    return df.withColumn(name, value), name, kind
