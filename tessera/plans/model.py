"""The typed plan: value expressions, constraints, objectives, and their JSON wire form.

Expressions are immutable trees of eight node types. Each node knows its children, how it reads as a label, and its wire form;
what it means over data is in operators.expressions.
"""

from __future__ import annotations

import json
import math
import operator
from dataclasses import dataclass, field
from typing import Any, ClassVar

from tessera.plans.errors import NonFiniteValue, RequestShape, TypeIncompatible, UnknownAggregation, UnknownCast, UnknownOperator

# The closed lists of the plan language.
AGGREGATIONS = ("avg", "sum", "min", "max", "count")
CASTS = ("DOUBLE", "VARCHAR", "BOOLEAN")
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
ARITHMETIC = ("+", "-", "*", "/")
THRESHOLD_OPS = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
EQUALITY_OPS = {"eq": "=", "neq": "!="}
MEMBER_OPS = {"in": "IN", "not_in": "NOT IN"}
MAX_DEPTH = 6
MAX_WINDOW = 10_000
MAXIMIZE, MINIMIZE = "maximize", "minimize"

Scalar = float | str | bool


def number_text(x: float) -> str:
    """Shortest decimal form: whole numbers without a point, exponents of two digits from 1e21 or below 1e-4."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    if 1e-4 <= abs(x) < 1e21 and "e" in text:
        return format(x, "f").rstrip("0").rstrip(".")
    return text


def scalar_text(x: Scalar) -> str:
    return ("True" if x else "False") if isinstance(x, bool) else x if isinstance(x, str) else number_text(x)


def scalar_wire(x: Scalar) -> dict[str, Scalar]:
    return {"bool": x} if isinstance(x, bool) else {"string": x} if isinstance(x, str) else {"number": x}


def scalar_read(wire: Any) -> Scalar:
    if not isinstance(wire, dict) or len(given := {k: v for k, v in wire.items() if v is not None}) != 1:
        raise TypeIncompatible(f"a literal holds one of number, string, bool: {wire!r}")
    (kind, value), = given.items()
    wanted = {"number": (int, float), "string": str, "bool": bool}.get(kind)
    if wanted is None or not isinstance(value, wanted) or (kind == "number" and isinstance(value, bool)):
        raise TypeIncompatible(f"not a {kind} literal: {value!r}")
    return float(value) if kind == "number" else value


def finite(x: Scalar, where: str) -> None:
    if isinstance(x, float | int) and not isinstance(x, bool) and not math.isfinite(x):
        raise NonFiniteValue(f"{where}: {x}")


class Expression:
    kind: ClassVar[str]
    windowed: ClassVar[bool] = False

    def children(self) -> tuple[Expression, ...]:
        return ()

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children()), default=0)

    def columns(self) -> list[str]:
        """Columns in reading order, repeats kept."""
        return [e.name for e in self.walk() if isinstance(e, Ref)]

    def has_window(self) -> bool:
        return any(e.windowed for e in self.walk())

    def check(self) -> None:
        """This node alone, without a schema."""

    def text(self) -> str:
        raise NotImplementedError

    def wire(self) -> dict[str, Any]:
        raise NotImplementedError


@dataclass(frozen=True)
class Ref(Expression):
    name: str
    kind = "column_ref"

    def text(self) -> str:
        return self.name

    def wire(self):
        return {"kind": self.kind, "column": self.name}


@dataclass(frozen=True)
class Value(Expression):
    value: Scalar
    kind = "literal"

    def check(self) -> None:
        finite(self.value, "literal")

    def text(self) -> str:
        return scalar_text(self.value)

    def wire(self):
        return {"kind": self.kind, "literal": scalar_wire(self.value)}


@dataclass(frozen=True)
class Cast(Expression):
    operand: Expression
    to: str
    kind = "cast"

    def children(self):
        return (self.operand,)

    def check(self) -> None:
        if self.to.strip().upper() not in CASTS:
            raise UnknownCast(self.to)

    def text(self) -> str:
        return f"{self.operand.text()}::{self.to}"

    def wire(self):
        return {"kind": self.kind, "operand": self.operand.wire(), "cast_type": self.to}


@dataclass(frozen=True)
class Binary(Expression):
    op: str
    left: Expression
    right: Expression
    allowed: ClassVar[tuple[str, ...]] = ()

    def children(self):
        return (self.left, self.right)

    def check(self) -> None:
        if self.op not in self.allowed:
            raise UnknownOperator(self.op)

    def text(self) -> str:
        return f"{self.left.text()} {self.op} {self.right.text()}"

    def wire(self):
        return {"kind": self.kind, "op": self.op, "left": self.left.wire(), "right": self.right.wire()}


class Comparison(Binary):
    kind = "comparison"
    allowed = COMPARISONS


class Arithmetic(Binary):
    kind = "arithmetic"
    allowed = ARITHMETIC


@dataclass(frozen=True)
class Case(Expression):
    branches: tuple[tuple[Expression, Expression], ...]
    default: Expression | None = None
    kind = "case"

    def children(self):
        return (*(e for b in self.branches for e in b), *([self.default] if self.default else []))

    def check(self) -> None:
        if not self.branches:
            raise TypeIncompatible("a case has no branches")

    def text(self) -> str:
        arms = "".join(f" WHEN {w.text()} THEN {t.text()}" for w, t in self.branches)
        return f"CASE{arms}{f' ELSE {self.default.text()}' if self.default else ''} END"

    def wire(self):
        return {"kind": self.kind, "cases": [{"when": w.wire(), "then": t.wire()} for w, t in self.branches]} | ({"else": self.default.wire()} if self.default else {})


def _span(n: int, what: str) -> None:
    if not 1 <= n <= MAX_WINDOW:
        raise TypeIncompatible(f"{what} {n} is not from 1 to {MAX_WINDOW}")


@dataclass(frozen=True)
class Lag(Expression):
    inner: Expression
    offset: int
    kind = "lag"
    windowed = True

    def children(self):
        return (self.inner,)

    def check(self) -> None:
        _span(self.offset, "offset")

    def text(self) -> str:
        return f"lag({self.inner.text()}, {self.offset})"

    def wire(self):
        return {"kind": self.kind, "inner": self.inner.wire(), "offset": self.offset}


@dataclass(frozen=True)
class Trailing(Expression):
    agg: str
    inner: Expression
    size: int
    kind = "trailing_aggregate"
    windowed = True

    def children(self):
        return (self.inner,)

    def check(self) -> None:
        if self.agg.lower() not in AGGREGATIONS:
            raise UnknownAggregation(self.agg)
        _span(self.size, "window")

    def text(self) -> str:
        return f"{self.agg}({self.inner.text()}) over trailing {self.size}"

    def wire(self):
        return {"kind": self.kind, "inner": self.inner.wire(), "window_size": self.size, "window_agg": self.agg}


def check_windows(expr: Expression) -> None:
    """Rejects a window below a window and spans out of range."""
    for e in expr.walk():
        if e.windowed:
            e.check()
            if e.inner.has_window():
                raise TypeIncompatible("a window may not hold another window")


def check_expression(expr: Expression, max_depth: int | None = None) -> None:
    for e in expr.walk():
        e.check()
    check_windows(expr)
    if max_depth is not None and expr.depth() > max_depth:
        raise RequestShape(f"an expression of depth {expr.depth()} exceeds {max_depth}")


def read_expression(wire: Any) -> Expression:
    """A tree from its wire form."""
    if not isinstance(wire, dict):
        raise TypeIncompatible(f"not an expression: {wire!r}")
    sub = lambda key: read_expression(wire.get(key))
    makers = {
        "column_ref": lambda: Ref(str(wire.get("column", ""))),
        "literal": lambda: Value(scalar_read(wire.get("literal"))),
        "cast": lambda: Cast(sub("operand"), str(wire.get("cast_type", ""))),
        "comparison": lambda: Comparison(str(wire.get("op", "")), sub("left"), sub("right")),
        "arithmetic": lambda: Arithmetic(str(wire.get("op", "")), sub("left"), sub("right")),
        "case": lambda: Case(tuple((read_expression(c.get("when")), read_expression(c.get("then"))) for c in wire.get("cases") or []), sub("else") if wire.get("else") else None),
        "lag": lambda: Lag(sub("inner"), int(wire.get("offset", 0))),
        "trailing_aggregate": lambda: Trailing(str(wire.get("window_agg", "")), sub("inner"), int(wire.get("window_size", 0))),
    }
    if wire.get("kind") not in makers:
        raise TypeIncompatible(f"unknown expression kind {wire.get('kind')!r}")
    return makers[wire["kind"]]()


@dataclass(frozen=True)
class Constraint:
    """One predicate. value: a number for thresholds, a scalar for equality, a tuple of scalars for membership."""

    field: str
    op: str
    value: Any

    @property
    def members(self) -> tuple[Scalar, ...]:
        return self.value if self.op in MEMBER_OPS else (self.value,)

    def check(self) -> None:
        if self.op not in THRESHOLD_OPS | EQUALITY_OPS | MEMBER_OPS:
            raise UnknownOperator(self.op)
        if self.op in MEMBER_OPS and not self.value:
            raise TypeIncompatible(f"an empty set for {self.field}")
        for v in self.members:
            finite(v, self.field)

    def text(self) -> str:
        if self.op in MEMBER_OPS:
            return f"{self.field} {MEMBER_OPS[self.op]} {{{', '.join(map(scalar_text, self.value))}}}"
        return f"{self.field} {(THRESHOLD_OPS | EQUALITY_OPS).get(self.op, self.op)} {scalar_text(self.value)}"

    def wire(self) -> dict[str, Any]:
        return {"field": self.field, "op": self.op, "value": list(self.value) if self.op in MEMBER_OPS else self.value}


def read_constraint(wire: dict[str, Any]) -> Constraint:
    """A constraint from {field, op, value}; the operator says what value must be."""
    name, op, value = str(wire.get("field", "")), str(wire.get("op", "")), wire.get("value")
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if op in THRESHOLD_OPS:
        if not number:
            raise RequestShape(f"{name} {op} needs a number, not {value!r}")
        return Constraint(name, op, float(value))
    if op in EQUALITY_OPS:
        if not number and not isinstance(value, str | bool):
            raise RequestShape(f"{name} {op} needs a scalar, not {value!r}")
        return Constraint(name, op, float(value) if number else value)
    if op in MEMBER_OPS:
        if not isinstance(value, list) or not all(isinstance(v, int | float | str | bool) for v in value):
            raise RequestShape(f"{name} {op} needs an array of scalars, not {value!r}")
        return Constraint(name, op, tuple(v if isinstance(v, str | bool) else float(v) for v in value))
    raise UnknownOperator(op)


def read_constraints(wire: list[dict] | None) -> list[Constraint]:
    return [read_constraint(w) for w in wire or []]


@dataclass(frozen=True)
class Target:
    field: str
    direction: str
    aggregation: str | None = None
    value: Expression | None = None

    def expression(self) -> Expression:
        return self.value or Ref(self.field)


@dataclass(frozen=True)
class Matrix:
    """What is optimised (targets) under which hard constraints."""

    targets: tuple[Target, ...] = ()
    constraints: tuple[Constraint, ...] = ()

    def wire(self) -> dict[str, Any]:
        """A target's value is a JSON string that holds the tree."""
        return {
            "targets": [{"field": t.field, "direction": t.direction, "aggregation": t.aggregation, "value": json.dumps(t.value.wire()) if t.value else ""} for t in self.targets],
            "constraints": [c.wire() for c in self.constraints],
        }


def read_matrix(wire: dict[str, Any]) -> Matrix:
    targets = []
    for t in wire.get("targets") or []:
        if t.get("direction") not in (MAXIMIZE, MINIMIZE):
            raise RequestShape(f"direction {t.get('direction')!r}")
        value = read_expression(json.loads(t["value"])) if t.get("value") else None
        targets.append(Target(str(t.get("field", "")), t["direction"], t.get("aggregation"), value))
    return Matrix(tuple(targets), tuple(read_constraints(wire.get("constraints"))))


@dataclass(frozen=True)
class Objective:
    """One aggregation over one value, with a direction; windows need an entity and a time column."""

    aggregation: str
    expression: Expression
    direction: str = MAXIMIZE
    entity: str | None = None
    time: str | None = None
    label: str = field(default="")

    def __post_init__(self):
        if not self.label:
            bare = isinstance(self.expression, Ref)
            object.__setattr__(self, "label", self.expression.name if bare else f"{self.aggregation}({self.expression.text()})")

    @staticmethod
    def of(matrix: Matrix, default_aggregation: str = "avg", **binding) -> Objective:
        """The first target."""
        if not matrix.targets:
            raise RequestShape("no target")
        t = matrix.targets[0]
        return Objective(t.aggregation or default_aggregation, t.expression(), t.direction, **binding)

    def check(self) -> None:
        if self.aggregation.lower() not in AGGREGATIONS:
            raise UnknownAggregation(self.aggregation)
        check_expression(self.expression)
        if self.expression.has_window() and not (self.entity and self.time):
            raise RequestShape("a windowed objective needs an entity and a time column")

    def improves(self, value: float, than: float) -> bool:
        return value > than if self.direction == MAXIMIZE else value < than

    def delta(self, value: float, baseline: float) -> float:
        return value - baseline if self.direction == MAXIMIZE else baseline - value

    def satisfied(self, value: float, constraints: list[Constraint]) -> bool:
        """Hard constraints bind the measured value of a bare column objective whose name they carry, case-sensitively."""
        if not isinstance(self.expression, Ref):
            return True
        tests = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge, "eq": operator.eq, "neq": operator.ne}
        own = [c for c in constraints if c.field == self.expression.name and c.op in tests and not isinstance(c.value, str)]
        return all(tests[c.op](value, float(c.value)) for c in own)


def check_request(aggregation: str, expression: Expression | None, constraints: list[Constraint]) -> None:
    """All that can be rejected without a schema."""
    if aggregation.lower() not in AGGREGATIONS:
        raise UnknownAggregation(aggregation)
    if expression is not None:
        check_expression(expression)
    for c in constraints:
        c.check()


def usable_number(measured: dict[str, Any], label: str) -> float | None:
    value = measured.get(label)
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
