"""Measurement, filter, expression, window, profile and grouped-analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import analyze as A
from tessera.operators.measure import measured
from tessera.plans.model import Arithmetic, Case, Cast, Comparison, Constraint, Lag, Objective, Ref, Trailing, Value
from tessera.queries.registry import query, r6, rounded
from tessera.sources.profile import describe, distinct_values, quantile_cuts


def C(field: str, op: str, value) -> Constraint:  # noqa: N802
    return Constraint(field, op, value)


def measure(name: str, table: str, agg: str, expr, constraints=(), value_sql: str = "", where: str = "TRUE", entity=None, time=None, inner: str | None = None, digits: int = 6) -> None:
    objective = Objective(agg, expr, entity=entity, time=time)
    query(name, lambda t: rounded(measured(t(table), objective, list(constraints)), digits), f"SELECT round(CAST({value_sql} AS DOUBLE), {digits}) + 0.0 AS value, count(*) AS support FROM {inner or table} WHERE {where}")


qty, price, discount, flag = Ref("l_quantity"), Ref("l_extendedprice"), Ref("l_discount"), Ref("l_returnflag")
for agg in ("avg", "sum", "min", "max"):
    measure(f"exec_{agg}", "lineitem", agg, price, [C("l_quantity", "gt", 25.0)], f"{agg}(l_extendedprice)", "l_quantity > 25", digits=2 if agg == "sum" else 6)
measure("exec_count_string", "lineitem", "count", flag, [], "count(l_returnflag)")
measure("exec_empty_null", "lineitem", "avg", price, [C("l_quantity", "gt", 1e9)], "avg(l_extendedprice)", "l_quantity > 1e9")
measure("exec_empty_count_zero", "lineitem", "count", price, [C("l_quantity", "gt", 1e9)], "count(l_extendedprice)", "l_quantity > 1e9")
measure("exec_support", "lineitem", "avg", Case(((Comparison(">", qty, Value(40.0)), price),)), [C("l_returnflag", "eq", "R")], "avg(CASE WHEN l_quantity > 40 THEN l_extendedprice END)", "l_returnflag = 'R'")
measure("exec_bool_rate", "lineitem", "avg", Cast(Comparison("=", flag, Value("R")), "BOOLEAN"), [], "avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)")
measure("exec_column_objective", "orders", "sum", Ref("o_orderkey"), [C("o_orderstatus", "eq", "F")], "sum(o_orderkey)", "o_orderstatus = 'F'")
measure("exec_revenue_segment", "lineitem", "avg", Arithmetic("*", price, Arithmetic("-", Value(1.0), discount)), [C("l_returnflag", "eq", "R"), C("l_quantity", "gt", 25.0)], "avg(l_extendedprice * (1 - l_discount))", "l_returnflag = 'R' AND l_quantity > 25")

for op, sign in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    measure(f"flt_{op}", "lineitem", "avg", price, [C("L_QUANTITY", op, 24.0)], "avg(l_extendedprice)", f"l_quantity {sign} 24")
measure("flt_eq", "orders", "avg", Ref("o_totalprice"), [C("o_orderstatus", "eq", "F")], "avg(o_totalprice)", "o_orderstatus = 'F'")
measure("flt_neq", "orders", "avg", Ref("o_totalprice"), [C("o_orderstatus", "neq", "F")], "avg(o_totalprice)", "o_orderstatus <> 'F'")
measure("flt_in", "customer", "avg", Ref("c_acctbal"), [C("c_mktsegment", "in", ("BUILDING", "MACHINERY"))], "avg(c_acctbal)", "c_mktsegment IN ('BUILDING', 'MACHINERY')")
measure("flt_not_in", "customer", "avg", Ref("c_acctbal"), [C("c_mktsegment", "not_in", ("BUILDING", "MACHINERY"))], "avg(c_acctbal)", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
measure("flt_conjunction", "lineitem", "max", price, [C("l_returnflag", "in", ("A", "R")), C("l_linestatus", "eq", "F"), C("l_discount", "lte", 0.05)], "max(l_extendedprice)", "l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_discount <= 0.05")

some_price = Case(((Comparison(">", qty, Value(30.0)), price),))
some_sql = "CASE WHEN l_quantity > 30 THEN l_extendedprice END"
measure("expr_cast_double", "lineitem", "sum", Cast(Ref("l_linenumber"), "DOUBLE"), [], "sum(CAST(l_linenumber AS DOUBLE))")
measure("expr_cast_varchar_count", "lineitem", "count", Cast(some_price, "VARCHAR"), [], f"count(CAST({some_sql} AS VARCHAR))")
measure("expr_cast_bool", "lineitem", "sum", Cast(Arithmetic("-", Ref("l_linenumber"), Value(1.0)), "BOOLEAN"), [], "sum(CAST(CAST(l_linenumber - 1 AS BOOLEAN) AS INT))")
for op, word in (("=", "eq"), ("!=", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    measure(f"expr_compare_{word}", "lineitem", "avg", Comparison(op, qty, Value(25.0)), [], f"avg(CASE WHEN l_quantity {op} 25 THEN 1 ELSE 0 END)")
measure("expr_compare_null_is_zero", "lineitem", "avg", Comparison(">", some_price, Value(10000.0)), [], f"avg(CASE WHEN ({some_sql}) > 10000 THEN 1 ELSE 0 END)")
measure("expr_arith", "lineitem", "avg", Arithmetic("/", Arithmetic("+", price, Arithmetic("*", qty, Value(2.0))), Arithmetic("-", qty, Value(0.5))), [], "avg((l_extendedprice + l_quantity * 2.0) / (l_quantity - 0.5))")
measure("expr_case_bucket", "lineitem", "avg", Case(((Comparison("<", qty, Value(10.0)), Value(1.0)), (Comparison("<", qty, Value(30.0)), Value(2.0))), Value(3.0)), [], "avg(CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 30 THEN 2 ELSE 3 END)")
measure("expr_case_no_else", "lineitem", "sum", some_price, [], f"sum({some_sql})", digits=2)
measure("expr_nested_depth", "lineitem", "avg", Case(((Comparison(">", Arithmetic("*", price, Arithmetic("-", Value(1.0), discount)), Value(20000.0)), price),), Value(0.0)), [], "avg(CASE WHEN l_extendedprice * (1 - l_discount) > 20000 THEN l_extendedprice ELSE 0 END)")

history = "PARTITION BY user_id ORDER BY ts"
value = Ref("value")


def windowed(name: str, agg: str, expr, sql: str, constraints=(), where: str = "TRUE", digits: int = 6) -> None:
    measure(name, "events", agg, expr, constraints, f"{agg}(w)", where, "user_id", "ts", f"(SELECT *, {sql} AS w FROM events)", digits)


windowed("win_lag1", "avg", Lag(value, 1), f"lag(value, 1) OVER ({history})")
windowed("win_lag3_rising", "avg", Comparison(">", value, Lag(value, 3)), f"CASE WHEN value > lag(value, 3) OVER ({history}) THEN 1 ELSE 0 END")
for agg in ("avg", "sum", "min", "max", "count"):
    windowed(f"win_trailing_{agg}", "avg", Trailing(agg, value, 5), f"{agg}(value) OVER ({history} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
windowed("win_velocity_ratio", "avg", Arithmetic("/", Trailing("count", value, 3), Arithmetic("+", Trailing("count", value, 10), Value(1.0))), f"count(value) OVER ({history} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) / (count(value) OVER ({history} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) + 1.0)")
windowed("win_filter_after_window", "avg", Trailing("sum", value, 4), f"sum(value) OVER ({history} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)", [C("event_type", "eq", "click")], "event_type = 'click'")

query("prof_schema", lambda t: t("lineitem").sparkSession.createDataFrame(describe(t("lineitem")), "column string, type string"), """
    SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN column_type LIKE 'TIMESTAMP%' THEN 'temporal' ELSE 'string' END AS type
    FROM (DESCRIBE SELECT * FROM lineitem)""")
query("prof_distinct_capped", lambda t: distinct_values(t("customer"), ["c_mktsegment", "c_nationkey"]), """
    SELECT DISTINCT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer
    UNION ALL SELECT DISTINCT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer""")
query("prof_distinct_over_cap_absent", lambda t: distinct_values(t("part"), ["p_name", "p_brand"], cap=30), """SELECT DISTINCT 'p_brand' AS "column", p_brand AS value FROM part""")


def cuts_frame(t, bins):
    cuts = quantile_cuts(t("lineitem"), ["l_quantity", "l_extendedprice"], bins)
    return rounded(t("lineitem").sparkSession.createDataFrame([(c, i, v) for c, vs in cuts.items() for i, v in enumerate(vs)], "column string, i int, cut double"))


def cuts_sql(bins):
    shares = [round(i / bins, 6) for i in range(1, bins)]
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({i} AS INT) AS i, {r6(f'quantile_cont({c}, {p})')} AS cut FROM lineitem" for c in ("l_quantity", "l_extendedprice") for i, p in enumerate(shares))


for n in (4, 3):
    query(f"prof_quantiles_{n}", lambda t, n=n: cuts_frame(t, n), cuts_sql(n))


def binned(column: str, bins: int, table: str) -> str:
    shares = [round(i / bins, 6) for i in range(1, bins)]
    arms = " ".join(f"WHEN {column} <= (SELECT quantile_cont({column}, {p}) FROM {table}) THEN '{i}'" for i, p in enumerate(shares))
    return f"CASE {arms} ELSE '{bins - 1}' END"


query("ct_one", lambda t: A.contingency(t("lineitem"), [("l_returnflag", 0)]), "SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY 1")
query("ct_two", lambda t: A.contingency(t("lineitem"), [("l_returnflag", 0), ("l_linestatus", 0)]), "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
query("ct_binned", lambda t: A.contingency(t("lineitem"), [("l_quantity", 4)]), f"SELECT {binned('l_quantity', 4, 'lineitem')} AS l_quantity, count(*) AS count FROM lineitem GROUP BY 1")
query("ct_filtered", lambda t: A.contingency(t("lineitem"), [("l_quantity", 3)], [C("l_returnflag", "eq", "R")]), f"SELECT {binned('l_quantity', 3, 'lineitem')} AS l_quantity, count(*) AS count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
query("ct_mixed_stratified", lambda t: A.contingency(t("lineitem"), [("l_returnflag", 0), ("l_extendedprice", 4), ("l_linestatus", 0)]), f"SELECT l_returnflag, {binned('l_extendedprice', 4, 'lineitem')} AS l_extendedprice, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2, 3")

pair_sql = f"count(*) AS n, {r6('sum(l_quantity)')} AS sum_0, {r6('sum(l_quantity * l_quantity)')} AS sumsq_0, {r6('sum(l_discount)')} AS sum_1, {r6('sum(l_discount * l_discount)')} AS sumsq_1, {r6('sum(l_quantity * l_discount)')} AS cross_0_1"
query("mom_ungrouped", lambda t: rounded(A.moments(t("lineitem"), ["l_quantity", "l_discount"])), f"SELECT {pair_sql} FROM lineitem")
query("mom_grouped", lambda t: rounded(A.moments(t("lineitem"), ["l_quantity", "l_discount"], [("l_returnflag", 0)])), f"SELECT l_returnflag, {pair_sql} FROM lineitem GROUP BY 1")
query("mom_cross", lambda t: rounded(A.moments(t("lineitem"), ["l_quantity", "l_discount"], constraints=[C("l_linestatus", "eq", "O")])), f"SELECT {pair_sql} FROM lineitem WHERE l_linestatus = 'O'")

objective = Objective("avg", price)
treated = [C("l_returnflag", "eq", "R"), C("l_quantity", "gt", 25.0)]
seg = "(l_returnflag = 'R' AND l_quantity > 25)"
arms = f"count(*) AS n, count(CASE WHEN {seg} THEN 1 END) AS seg_n, {r6(f'avg(CASE WHEN {seg} THEN l_extendedprice END)')} AS seg_agg, count(CASE WHEN NOT {seg} THEN 1 END) AS base_n, {r6(f'avg(CASE WHEN NOT {seg} THEN l_extendedprice END)')} AS base_agg"
query("eff_naive", lambda t: rounded(A.stratified_effect(t("lineitem"), objective, treated)), f"SELECT {arms} FROM lineitem")
query("eff_stratified_raw", lambda t: rounded(A.stratified_effect(t("lineitem"), objective, treated, [("l_linestatus", 0)])), f"SELECT l_linestatus, {arms} FROM lineitem GROUP BY 1")
query("eff_stratified_binned", lambda t: rounded(A.stratified_effect(t("lineitem"), objective, treated, [("l_discount", 4), ("l_linestatus", 0)])), f"SELECT {binned('l_discount', 4, 'lineitem')} AS l_discount, l_linestatus, {arms} FROM lineitem GROUP BY 1, 2")
query("eff_sampled_full", lambda t: rounded(A.sampled_effect(t("lineitem"), objective, treated, fraction=1.0)), f"SELECT {arms} FROM lineitem")
query("eff_random_stratifier_counts", lambda t: A.stratified_effect(t("lineitem"), objective, treated, random_bins=4, seed=7).agg(F.sum("n").alias("n"), F.sum("seg_n").alias("seg_n")), f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN {seg} THEN 1 END) AS BIGINT) AS seg_n FROM lineitem")
query("eff_sampled_70", lambda t: A.sampled_effect(t("lineitem"), objective, treated, fraction=0.7, seed=7))
