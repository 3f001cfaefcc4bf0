"""Measurement and analytics over tiny tables with known results, and agreement of the ways to measure."""


from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import analyze as A
from tessera.operators import graph as G
from tessera.operators import textops as X
from tessera.operators.cube import CubeMeasurer
from tessera.operators.measure import execute, execute_many
from tessera.plans import api
from tessera.plans.errors import AmbiguousField, NonFiniteValue, NonNumeric, RequestShape, TypeIncompatible, UnknownField, UnsupportedFormat
from tessera.plans.model import Arithmetic, Case, Comparison, Constraint, Lag, Objective, Ref, Value
from tessera.sources.profile import distinct_values, profile, quantile_cuts, resolve
from tessera.sources.tabular import Stage, scan, to_parquet

C = Constraint


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(1, 10.0, "a", True), (2, 20.0, "b", False), (3, 30.0, "c", True)], "qty int, amount double, name string, flag boolean").cache()


def value(df, agg, expr, *constraints, **binding):
    o = Objective(agg, expr, **binding)
    r = execute(df, o, list(constraints))
    return r[o.label], r["row_count"]


def test_measures(orders):
    amount = Ref("Amount")
    assert value(orders, "avg", amount, C("QTY", "gt", 1.0)) == (25.0, 2)
    assert value(orders, "avg", amount, C("qty", "gt", 100.0)) == (None, 0)
    assert value(orders, "count", Ref("name"), C("qty", "gt", 100.0)) == (0.0, 0)
    assert value(orders, "avg", Ref("flag"))[0] == pytest.approx(2 / 3)
    assert value(orders, "avg", Comparison("=", Ref("name"), Value("a")))[0] == pytest.approx(1 / 3)
    with pytest.raises(NonFiniteValue):
        value(orders, "sum", Arithmetic("/", amount, Value(0.0)))
    for expr, error in ((Ref("name"), NonNumeric), (Ref("nope"), UnknownField), (Comparison("=", Ref("qty"), Value("a")), TypeIncompatible)):
        with pytest.raises(error):
            value(orders, "avg", expr)
    with pytest.raises(TypeIncompatible):
        value(orders, "avg", amount, C("name", "eq", 1.0))
    with pytest.raises(RequestShape):
        execute(orders, Objective("avg", amount, label="row_count"))


def test_large_integer_sums_do_not_overflow(spark):
    df = spark.createDataFrame([(2**62,)] * 4, "x long")
    assert value(df, "sum", Ref("x"))[0] == float(2**64)


def test_nulls_compare_to_zero_and_a_case_without_default_is_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert value(df, "avg", Comparison(">", Ref("x"), Value(2.0)))[0] == pytest.approx(1 / 3)
    assert value(df, "sum", Case(((Comparison(">", Ref("x"), Value(2.0)), Value(5.0)),))) == (5.0, 3)
    assert value(df, "count", Ref("x"), C("x", "not_in", (1.0,))) == (1.0, 1)


def test_windows_see_rows_outside_the_segment(spark):
    df = spark.createDataFrame([("u", 1, 10.0), ("u", 2, 20.0), ("u", 3, 40.0)], "who string, t int, v double")
    o = Arithmetic("-", Ref("v"), Lag(Ref("v"), 1))
    assert value(df, "avg", o, C("t", "gt", 2.0), entity="who", time="t") == (20.0, 1)


def test_ambiguous_columns(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        schema = spark.createDataFrame([(1, 2)], "a int, A int").schema
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    with pytest.raises(AmbiguousField):
        resolve(schema, "a")


def test_all_ways_to_measure_agree(spark):
    df = spark.range(2000).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, (F.col("id") % 13).cast("double")).alias("y"), (F.col("id") % 3).cast("string").alias("g"))
    atoms = [C("g", "eq", "0"), C("g", "eq", "1"), C("x", "lte", 3.0), C("x", "gt", 5.0)]
    segments = [[a] for a in atoms] + [[atoms[0], atoms[2]], [atoms[0], atoms[1]], []]
    for agg in ("avg", "sum", "min", "max", "count"):
        o = Objective(agg, Ref("y"))
        a, b = CubeMeasurer(df, o, atoms)(segments), execute_many(df, o, segments)
        for s, x, y in zip(segments, a, b, strict=True):
            one = execute(df, o, s)
            assert x.support == y.support == one["row_count"]
            for v in (x.value, y.value):
                assert v == pytest.approx(one[o.label]) if v is not None else one[o.label] is None


def test_profile(spark):
    df = spark.createDataFrame([("a", "x", "p", 1), ("a", "y", None, 2), ("b", "z", "q", 4)], "low string, high string, gap string, n int")
    found = {}
    for r in distinct_values(df, ["low", "high", "gap"], cap=2).collect():
        found.setdefault(r.column, set()).add(r.value)
    assert found == {"low": {"a", "b"}, "gap": {"p", "q"}}
    assert quantile_cuts(df, ["n"], 2) == {"n": [2.0]}
    assert {c["name"]: c["cuts"] for c in profile(df, bins=4)}["low"] == []
    with pytest.raises(RequestShape):
        quantile_cuts(df, ["n"], 33)


def test_analytics(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "g string, n int")
    assert {tuple(r) for r in A.contingency(df, [("g", 0)]).collect()} == {("a", 2), ("b", 2)}
    m = A.moments(df, ["n"]).first()
    assert (m["n"], m["sum_0"], m["sumsq_0"]) == (4, 10.0, 30.0)
    e = A.stratified_effect(df, Objective("avg", Ref("n")), [C("g", "eq", "a")]).first()
    assert tuple(e) == (4, 2, 1.5, 2, 3.5)
    assert A.sampled_effect(df, Objective("avg", Ref("n")), [C("g", "eq", "a")], fraction=1.0).first()["n"] == 4
    for n, f in ((100, 0.7), (5000, 0.31), (3, 0.1)):
        assert A.exact_sample(spark.range(n).toDF("n"), f, 1).distinct().count() == round(n * f)
    assert A.moments(df, ["n"], constraints=[C("n", "gt", 9.0)]).first()["sum_0"] == 0.0
    empty = A.stratified_effect(df.where("false"), Objective("avg", Ref("n")), [C("g", "eq", "a")]).collect()
    assert len(empty) == 1 and empty[0]["n"] == 0
    with pytest.raises(RequestShape):
        A.contingency(df, [("g", 0)] * 5)
    with pytest.raises(NonNumeric):
        A.contingency(df, [("g", 4)])


def test_a_null_segment_is_in_neither_arm(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "g string, n int")
    e = A.stratified_effect(df, Objective("avg", Ref("n")), [C("g", "eq", "a")]).first()
    assert (e["n"], e["seg_n"], e["base_n"]) == (3, 1, 1)


def test_requests(orders):
    request = {"aggregation": "avg", "field": "amount", "filters": [{"field": "qty", "op": "gt", "value": 1}]}
    assert api.execute(orders, request) == {"amount": 25.0, "row_count": 2}
    assert api.analyze(orders, {"kind": "contingency", "columns": [{"name": "flag"}]}).count() == 2
    assert api.introspect(orders, ["AMOUNT", "x"])["targets"] == [{"target": "AMOUNT", "column": "amount", "matched": True}, {"target": "x", "column": None, "matched": False}]
    with pytest.raises(RequestShape):
        api.analyze(orders, {"kind": "cube"})


def test_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,name\n1,a\n,b\n")
    df = scan(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("name").collect()] == [(1, "a"), (None, "b")]
    stage, path = Stage(spark, capacity=1), to_parquet(df, str(tmp_path / "a.parquet"))
    with stage.use(path) as first, stage.use(path) as again:
        assert first is again and again.count() == 2 and len(stage.kept) == 1
        other = to_parquet(df.limit(1), str(tmp_path / "b.parquet"))
        with stage.use(other) as third:  # both are in use
            assert third.count() == 1 and len(stage.kept) == 2
        assert len(stage.kept) == 1
    to_parquet(spark.createDataFrame([(1, "a")] * 5, "x int, name string"), path)
    with stage.use(path) as fresh:  # new files under an old name are another source
        assert fresh.count() == 5
    with pytest.raises(Exception), stage.use(str(tmp_path / "none.parquet")):
        pass
    assert len(stage.kept) == 1
    fills = []
    with ThreadPoolExecutor(4) as pool:
        def one(_):
            with stage.use(other) as d:
                fills.append(d)
        list(pool.map(one, range(4)))
    assert len({id(d) for d in fills}) == 1
    with pytest.raises(UnsupportedFormat):
        scan(spark, "a.xlsx")


def test_quantiles_of_many_values_equal_the_aggregate(spark):
    df = spark.range(5000).selectExpr("id", "cast(pow(id % 997, 2) as double) AS a", "case when id % 3 > 0 then cast(id * 7919 % 5003 as double) end AS b", "cast(null as double) AS c", "case when id = 7 then double('infinity') else 1.0 end AS d")
    for bins in (2, 4, 7, 32):
        assert quantile_cuts(df, ["a", "b", "c", "d", "id"], bins, held=1) == quantile_cuts(df, ["a", "b", "c", "d", "id"], bins)


def test_samples_of_a_fixed_size(spark):
    hot = spark.range(60_000).selectExpr("if(id % 3 = 0, -1, id) AS n", "map('k', id % 2) AS m")
    for f in (0.1, 0.5, 0.7, 0.999):
        a, b = A.exact_sample(hot, f, 3), A.exact_sample(hot.repartition(7, "n"), f, 3)
        assert a.count() == round(60_000 * f) and a.columns == ["n", "m"]
        assert a.groupBy("n").count().exceptAll(b.groupBy("n").count()).isEmpty()  # the same rows, however they are split


def test_distinct_values_beyond_the_head(spark):
    df = spark.range(30_000).selectExpr("if(id < 20000, 1, id) AS late", "id % 50 AS fifty", "id % 51 AS more", "'x' AS one")
    found = {c: v for c, v in distinct_values(df).groupBy("column").count().collect()}
    assert found == {"fifty": 50, "one": 1}


def test_text(spark):
    df = spark.createDataFrame([("äb term_x Term [ p ][]",)], "text string")
    r = df.select(X.byte_start(F.col("text"), F.lit("b")).alias("at"), X.excerpt(F.col("text"), F.lit(0), F.lit(3)).alias("e"), X.leaked_terms(F.col("text"), ["term", "term_", "[ p"]).alias("t"), X.bracketed_terms(F.col("text")).alias("b")).first()
    assert (r.at, r.e, r.t, r.b) == (2, "äb", ["term", "[ p"], ["p"])
    assert df.select(X.excerpt(F.col("text"), F.lit(5), F.lit(2)).alias("e")).first().e == "äb term_x Term [ p ][]"


def test_upserts_never_blank_what_is_known(spark):
    old = spark.createDataFrame([("a", "g", True), ("b", "h", False)], "id string, goal string, pending boolean")
    new = spark.createDataFrame([("a", "", False), ("c", "k", True)], old.schema)
    found = {tuple(r) for r in G.upsert(old, new, ["id"], keep_known=["goal"], untouched=["pending"]).collect()}
    assert found == {("a", "g", True), ("b", "h", False), ("c", "k", True)}
