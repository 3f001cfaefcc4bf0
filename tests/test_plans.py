import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.plans import canonical
from tessera.plans import model as M
from tessera.plans.errors import NonFiniteValue, RequestShape, TypeIncompatible, UnknownAggregation, UnknownCast, UnknownOperator

scalars = st.one_of(st.booleans(), st.text(max_size=6), st.floats(allow_nan=False, allow_infinity=False))
constraints = st.one_of(
    st.builds(M.Constraint, st.text(min_size=1, max_size=5), st.sampled_from(["lt", "gte"]), st.floats(allow_nan=False, allow_infinity=False)),
    st.builds(M.Constraint, st.text(min_size=1, max_size=5), st.sampled_from(["eq", "neq"]), scalars),
    st.builds(M.Constraint, st.text(min_size=1, max_size=5), st.sampled_from(["in", "not_in"]), st.lists(scalars, min_size=1, max_size=3).map(tuple)),
)


@given(st.lists(constraints, max_size=4), st.randoms())
def test_key_depends_on_the_set_only(found, rng):
    again = found + found[:1]
    rng.shuffle(again)
    assert canonical.key(again) == canonical.key(found)
    assert len(canonical.components(canonical.key(found))) == len({canonical.component(c) for c in found})


def test_key_keeps_types_apart_and_ignores_case_and_member_order():
    C = M.Constraint
    assert canonical.key([C("a", "eq", True)]) != canonical.key([C("a", "eq", "True")])
    assert canonical.key([C("A", "eq", "x")]) == canonical.key([C("a", "eq", "x")])
    assert canonical.key([C("a", "in", ("x", "y"))]) == canonical.key([C("a", "in", ("y", "x", "y"))])
    assert canonical.components("") == []
    assert canonical.derived_id("g", "state", "k") == canonical.derived_id("g", "state", "k") != canonical.derived_id("h", "state", "k")


def test_labels():
    flag = M.Comparison("=", M.Ref("Transported"), M.Value(True))
    assert M.Objective("avg", flag).label == "avg(Transported = True)"
    assert M.Cast(M.Ref("x"), "DOUBLE").text() == "x::DOUBLE"
    assert M.Trailing("avg", M.Ref("x"), 5).text() == "avg(x) over trailing 5"
    assert M.Constraint("HomePlanet", "in", ("Europa", "Mars")).text() == "HomePlanet IN {Europa, Mars}"
    assert M.Constraint("Age", "lte", 100.0).text() == "Age <= 100"


def test_expressions_round_trip():
    e = M.Case(((M.Comparison("<", M.Ref("q"), M.Value(2.5)), M.Arithmetic("/", M.Ref("a"), M.Cast(M.Ref("b"), "DOUBLE"))),), M.Trailing("sum", M.Ref("a"), 3))
    assert M.read_expression(json.loads(json.dumps(e.wire()))) == e
    assert e.depth() == 4 and e.has_window() and e.columns() == ["q", "a", "b", "a"]
    m = M.Matrix((M.Target("a", "maximize", "avg", e),), (M.Constraint("q", "lt", 3.0),))
    assert M.read_matrix(json.loads(json.dumps(m.wire()))) == m


@pytest.mark.parametrize(("build", "error"), [
    (lambda: M.check_request("median", None, []), UnknownAggregation),
    (lambda: M.check_request("avg", M.Cast(M.Ref("a"), "DATE"), []), UnknownCast),
    (lambda: M.check_request("avg", M.Comparison("~", M.Ref("a"), M.Ref("b")), []), UnknownOperator),
    (lambda: M.check_request("avg", M.Value(math.inf), []), NonFiniteValue),
    (lambda: M.check_request("avg", M.Case(()), []), TypeIncompatible),
    (lambda: M.check_request("avg", M.Lag(M.Lag(M.Ref("a"), 1), 1), []), TypeIncompatible),
    (lambda: M.check_request("avg", M.Lag(M.Ref("a"), 10_001), []), TypeIncompatible),
    (lambda: M.check_request("avg", None, [M.Constraint("a", "in", ())]), TypeIncompatible),
    (lambda: M.check_request("avg", None, [M.Constraint("a", "lt", math.nan)]), NonFiniteValue),
    (lambda: M.read_constraint({"field": "a", "op": "lt", "value": "x"}), RequestShape),
    (lambda: M.read_constraint({"field": "a", "op": "in", "value": 3}), RequestShape),
    (lambda: M.read_constraint({"field": "a", "op": "like", "value": "x"}), UnknownOperator),
    (lambda: M.read_expression({"kind": "literal", "literal": {"number": 1, "string": "a"}}), TypeIncompatible),
    (lambda: M.Objective("avg", M.Lag(M.Ref("a"), 1)).check(), RequestShape),
    (lambda: M.check_expression(M.Cast(M.Cast(M.Ref("a"), "DOUBLE"), "DOUBLE"), 2), RequestShape),
])
def test_rejections(build, error):
    with pytest.raises(error):
        build()


def test_direction_and_hard_constraints():
    o = M.Objective("avg", M.Ref("cost"), M.MINIMIZE)
    assert o.improves(1, 2) and o.delta(1, 2) == 1
    assert not o.satisfied(5, [M.Constraint("cost", "lt", 3.0)]) and o.satisfied(5, [M.Constraint("Cost", "lt", 3.0)])
    assert M.usable_number({"a": True}, "a") is None and M.usable_number({"a": 2}, "a") == 2.0
    assert canonical.finding_seed("") == 0xCBF29CE484222325
