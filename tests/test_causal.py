"""Discovery and verification on a planted dataset, and search against planted segments."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import statistics as S
from tessera.operators import discovery as D
from tessera.operators import effects as E
from tessera.operators import publish as P
from tessera.operators import search as R
from tessera.operators.cube import CubeMeasurer
from tessera.operators.measure import Measurement, execute
from tessera.plans.canonical import key
from tessera.plans.errors import NonFiniteValue
from tessera.plans.model import Constraint, Objective, Ref
from tessera.sources.profile import profile

C = Constraint


@pytest.fixture(scope="module")
def planted(spark):
    """Z -> X, Z -> Y, A -> Y, and a lift where B = b1 and C; region touches nothing."""
    rng, n = np.random.default_rng(7), 2000
    z, a = rng.normal(size=n), rng.normal(size=n)
    x = 1.5 * z + rng.normal(size=n)
    b, c, region = rng.choice(["b0", "b1", "b2"], n), rng.random(n) < 0.5, rng.choice(["north", "south", "east", "west"], n)
    y = 1.2 * z + 1.0 * a + 2.0 * ((b == "b1") & c) + rng.normal(size=n)
    rows = list(zip(z.tolist(), x.tolist(), a.tolist(), b.tolist(), c.tolist(), y.tolist(), region.tolist(), strict=True))
    return spark.createDataFrame(rows, "Z double, X double, A double, B string, C boolean, Y double, region string").cache()


@pytest.fixture(scope="module")
def found(planted):
    return D.discover(planted, D.variables(profile(planted)))


def test_discovery(planted, found):
    skeleton, graph = found
    true = {D.edge(*e) for e in (("Z", "X"), ("Z", "Y"), ("A", "Y"), ("B", "Y"), ("C", "Y"))}
    assert len(skeleton.edges & true) / len(skeleton.edges) >= 0.8 and len(skeleton.edges & true) / len(true) >= 0.8
    assert D.edge("X", "Y") not in skeleton.edges and "Z" in skeleton.separators[D.edge("X", "Y")]
    assert ("A", "Y") in graph.directed
    again = D.discover(planted, D.variables(profile(planted)))
    assert again[0].edges == skeleton.edges and again[1].directed == graph.directed


def test_verification(planted, found):
    goal = Objective("avg", Ref("Y"))
    good = E.verify(planted, goal, [C("A", "gt", 0.0)], found[1], profile(planted), "a")
    assert good.status == E.VERIFIED and good.score >= 0.8 and good.scores["placebo"] >= 0.8
    graph = D.Orientation(found[0])
    graph.directed, graph.open = {("Z", "X"), ("Z", "Y"), ("A", "Y")}, set()
    bad = E.verify(planted, goal, [C("X", "gt", 0.0)], graph, profile(planted), "x")
    assert bad.status == E.CONFOUNDED and bad.adjust == ("Z",)
    open_ = D.Orientation(found[0])
    assert E.adjustment(open_, goal, [C("A", "gt", 0.0)]).status == E.NOT_IDENTIFIABLE


def test_adjustment_knows_every_tested_column():
    goal, o = Objective("avg", Ref("Y")), orientation(["AY", "ZA", "ZY"], directed=["AY", "ZA", "ZY"])
    o.found.columns = ["A", "Y", "Z", "region"]
    assert E.adjustment(o, goal, [C("region", "eq", "north")]) == E.Plan()
    assert E.adjustment(o, goal, [C("a", "gt", 0.0)]) == E.Plan("", ("Z",))
    assert E.adjustment(o, goal, [C("nope", "eq", "x")]) == E.Plan(E.NOT_IDENTIFIABLE, blocking=("nope",))
    assert E.adjustment(o, Objective("avg", Ref("z")), [C("A", "gt", 0.0)]) == E.Plan()


def test_tests_of_a_level_equal_single_tests(planted, spark):
    """One scan for all sets of columns, nulls in some of them, against a plain computation by numpy."""
    df = planted.withColumn("Z", F.when(F.abs("A") < 1.5, F.col("Z"))).withColumn("region", F.when(F.col("Y") > -2, F.col("region"))).cache()
    by = {v.name: v for v in D.variables(profile(df))}
    asked = [(a, b, s) for a, b in itertools.combinations(sorted(by), 2) for n in range(3) for s in itertools.combinations(sorted(set(by) - {a, b}), n)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("level", "level")
    together = D.independence_ps(df, by, asked)
    sets = len({(a, b, *s) for a, b, s in asked})
    assert len(jobs.getJobIdsForGroup("level")) < sets / 4
    pd = df.toPandas()
    for (a, b, s), p in list(zip(asked, together, strict=True))[::7]:
        if by[a].numeric and by[b].numeric and all(by[x].numeric for x in s):
            m = pd[[a, b, *s]].dropna().to_numpy(float)
            r = -np.linalg.inv(np.corrcoef(m.T))
            rho = r[0, 1] / np.sqrt(r[0, 0] * r[1, 1])
            assert p == pytest.approx(math.erfc(abs(math.sqrt(len(m) - len(s) - 3) * math.atanh(rho)) / math.sqrt(2)), abs=1e-9)
        elif not s:
            cuts = {n: np.quantile(pd[n].dropna().to_numpy(float), [0.25, 0.5, 0.75]) for n in (a, b) if by[n].numeric}
            own = pd[[a, b]].dropna()
            codes = [np.searchsorted(cuts[n], own[n].to_numpy(float)) if n in cuts else own[n].astype("category").cat.codes for n in (a, b)]
            table = np.zeros((codes[0].max() + 1, codes[1].max() + 1))
            np.add.at(table, tuple(np.asarray(c) for c in codes), 1)
            expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
            g, dof = 2 * (table[table > 0] * np.log((table / expected)[table > 0])).sum(), (np.array(table.shape) - 1).prod()
            assert p == pytest.approx(S.chi_square_tail(g, dof), abs=1e-9)
    bad = df.withColumn("A", F.when(F.col("A") > 2, float("inf")).otherwise(F.col("A")))
    assert [isinstance(p, NonFiniteValue) for p in D.independence_ps(bad, by, [("A", "X", ()), ("X", "Y", ()), ("A", "Y", ("X",))])] == [True, False, True]


def orientation(edges, separators=None, directed=(), status=None):
    s = D.Skeleton({D.edge(*e) for e in edges}, {D.edge(*k): v for k, v in (separators or {}).items()})
    s.status = {e: (status or {}).get(e, D.TESTED) for e in s.edges}
    o = D.Orientation(s)
    for e in directed:
        o.orient(*e)
    return o


def test_orientation_rules():
    o = orientation(["xz", "yz"], {"xy": ()})
    o.colliders()
    assert o.directed == {("x", "z"), ("y", "z")}
    o = orientation(["xz", "yz"], {"xy": ("z",)})
    o.colliders()
    assert not o.directed
    for edges, directed, forced in (
        (["ab", "bc"], ["ab"], ("b", "c")),
        (["ab", "bc", "ac"], ["ab", "bc"], ("a", "c")),
        (["ab", "ac", "ad", "cb", "db"], ["cb", "db"], ("a", "b")),
        (["ab", "ac", "ad", "cd", "db"], ["cd", "db"], ("a", "b")),
    ):
        o = orientation(edges, directed=directed)
        assert o.implied(*forced), forced
    o = orientation(["xz", "yz"], {"xy": ()}, status={("x", "z"): D.UNKNOWN})
    o.colliders()
    assert not o.directed


def test_failed_tests_and_budgets_keep_edges():
    def broken(a, b, s):
        raise NonFiniteValue(a)

    s = D.skeleton(["a", "b", "c"], D.one_by_one(broken))
    assert len(s.edges) == 3 and set(s.status.values()) == {D.UNKNOWN}
    with pytest.raises(ZeroDivisionError):  # an error of the program is no result
        D.skeleton(["a", "b", "c"], D.one_by_one(lambda a, b, s: 1 / 0))
    s = D.skeleton(["a", "b", "c"], D.one_by_one(lambda a, b, s: 0.0), max_tests=4)
    assert s.truncated and set(s.status.values()) == {D.CAPPED}
    assert D.capped_columns(["a", "b", "c", "d"], ["b"], D.one_by_one(lambda x, y, s: {"a": 0.5, "c": 0.1, "d": 0.2}[x]), 3) == (["b", "c", "d"], ["a"])
    assert D.layers({("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")}) == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 3}


def test_reweighting():
    rows = [{"n": 100, "seg_n": 40, "seg_agg": 3.0, "base_n": 60, "base_agg": 1.0}, {"n": 300, "seg_n": 10, "seg_agg": 2.0, "base_n": 290, "base_agg": 1.0}]
    assert E.reweighted(rows) is None and E.reweighted(rows, 5) == 1.25
    assert E.reweighted_leniently([*rows, {"n": 5, "seg_n": 0, "seg_agg": None, "base_n": 5, "base_agg": 1.0}]) == 1.25
    assert E.collapses(1.0, 0.4) and E.collapses(1.0, -1.0) and not E.collapses(0.0, 1.0) and not E.collapses(1.0, 0.6)


def test_claims(planted):
    goal = Objective("avg", Ref("Y"))
    assert E.measure_claim(planted, goal, [C("A", "gt", 0.0)]).agrees
    assert E.measure_claim(planted, goal, [C("A", "gt", 100.0)]) is None
    assert E.grounding_message([C("nope", "eq", "x"), C("region", "eq", "moon")], profile(planted)) == "unknown columns: nope; unknown values: region = moon"


def searches(planted):
    goal = Objective("avg", Ref("Y"))
    atoms = R.schema_atoms(profile(planted, bins=3), exclude=["Y"])
    base = execute(planted, goal)[goal.label]
    measure = CubeMeasurer(planted, goal, [a.constraint for a in atoms])
    make = lambda: R.Search(goal, measure, base)
    return R.beam(make(), atoms), R.tree_search(make(), atoms)


def test_tree_search_is_no_worse_than_beam(planted):
    by_beam, by_tree = searches(planted)
    best = lambda s: max(s.delta(key(c)) for c, _ in s.winners())
    assert len(by_tree.seen) <= 200 and len(by_beam.seen) <= 200
    assert best(by_tree) >= best(by_beam) - 1e-9 or len(by_tree.winners()) >= len(by_beam.winners())
    assert any({("B", "b1"), ("C", True)} <= {(c.field, c.value) for c in s} for s, _ in by_tree.winners())


def fake(values):
    table = {key(s): Measurement(*v) for s, v in values}
    return lambda segments: [table.get(key(s)) for s in segments]


def test_search_rules():
    goal, (a, b) = Objective("max", Ref("y")), (C("a", "eq", "1"), C("b", "eq", "1"))
    atoms = [R.Atom(a), R.Atom(b)]
    s = R.beam(R.Search(goal, fake([([a], (10, 50)), ([b], (1, 50)), ([a, b], (1, 50))]), 0), atoms)
    assert len(s.winners()) == 1 and s.winners()[0][1].value == 1
    s = R.beam(R.Search(goal, fake([([a], (10, 29)), ([b], (1, 50)), ([a, b], (99, 50))]), 0), atoms)
    assert not s.winners() and s.starved([a, b])
    assert R.contradictory([a, C("A", "eq", "2")]) and not R.contradictory([a, C("a", "neq", "2")])
    s = R.beam(R.Search(goal, fake([]), 0, budget=1), atoms)
    assert s.stopped == "budget" and len(s.seen) == 1
    findings = [R.Finding(str(i), (a,), (a,), v, n) for i, (v, n) in enumerate([(10, 5), (6, 30), (4, 100), (50, 0)])]
    assert R.s_star(findings, goal) == 6 and R.s_star([], goal) is None
    assert R.materially_better(goal, 1.05, 1.0) and not R.materially_better(goal, 1.04, 1.0)
    assert [x.constraint for x in R.finding_atoms(findings)] == [a] and len(R.finding_atoms(findings)[0].sources) == 4
    order = [x.constraint.field for x in R.column_rounds([R.Atom(C("a", "eq", str(i))) for i in range(3)] + [R.Atom(C("b", "eq", "x"), prior=0.5)])]
    assert order == ["b", "a", "a", "a"]  # the ranked column first, then one atom of each column in every round


def test_greedy_growth():
    goal, segs = Objective("max", Ref("y")), [C(f, "eq", "1") for f in "abc"]
    values = {frozenset(s): Measurement(v, n) for s, v, n in (("a", 5.0, 9), ("b", 0.5, 9), ("ab", 7.0, 9), ("ac", 4.0, 9))}
    asked = []

    def measure(segments):
        asked.append(len(segments))
        return [values.get(frozenset(c.field for c in s), Measurement(None, 0)) for s in segments]

    out = R.greedy(goal, measure, lambda at, attempt: [s for s in segs if s not in at], 1.0)
    assert [(tuple(c.field for c in r.segment), r.effect) for r in out] == [(("a",), 4.0), (("a", "b"), 2.0), (("a", "c"), -1.0), (("b",), -0.5)]
    assert asked[2:4] == [1, 1]  # a segment without rows is proposed once more


def test_publication():
    goal = Objective("avg", Ref("y"))
    a, b, c = (C(f, "eq", "1") for f in "abc")
    make = lambda i, fs, score, src=("x",): P.Candidate(key(fs), tuple(fs), score, 100, score, src)
    kept = P.contained([make(0, [a], 1.0), make(1, [a, b], 1.2), make(2, [a, c], 0.85)])
    assert {x.canonical for x in kept} == {key([a, b]), key([a, c])}
    merged = P.deduplicated([make(0, [a], 1.0, ("x",)), make(1, [a], 2.0, ("y",))])
    assert len(merged) == 1 and merged[0].score == 2.0 and set(merged[0].sources) == {"x", "y"}
    findings = [R.Finding("thin", (a,), (a,), 100.0, 1), R.Finding("wide", (b,), (b,), 30.0, 1000), R.Finding("worse", (c,), (c,), -1.0, 10)]
    assert [f.id for f in P.promoted(findings, goal, 0.0, 2)] == ["wide", "thin"]
    assert [p.sources for p in P.published(findings, goal, 0.0)] == [("wide",), ("thin",)]
    assert P.overlap([a, b], [a, c]) == 0.5 and [f.id for f in P.claim_matches(findings, [b])] == ["wide"]
    rows = P.write_back("g", [([a, b], 2.0, 40)], goal, 0.5)
    assert rows[0]["effect_size"] == 1.5 and rows == P.write_back("g", [([b, a], 2.0, 40)], goal, 0.5)


def test_planted_columns_at_the_edges_of_thirds(spark):
    """Rows whose draw lies between a third and 0.333333, or two thirds and 0.666667, fall as they do in SQL."""
    import duckdb

    from tessera.queries import planted as Q

    draw = lambda k: (((k * 8231 + 15488794) % Q.PRIME) ** 2 % Q.PRIME * 6262 + k * k % Q.PRIME) % Q.PRIME
    keys = [k for k in range(Q.PRIME) if draw(k) in (333334, 666669)][:6]
    rows = spark.createDataFrame([(k // 8, k % 8) for k in keys], "l_orderkey long, l_linenumber int")
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?)", [(k // 8, k % 8) for k in keys])
    same = con.execute(f"WITH {Q.PLANTED} SELECT B, Y FROM planted ORDER BY 1, 2").fetchall()
    assert keys and [tuple(r) for r in Q.planted(lambda _: rows).select("B", "Y").orderBy("B", "Y").collect()] == same


def test_a_sweep_reads_the_rows_a_few_times(planted, spark, monkeypatch):
    """Tests over cells equal tests over rows, nulls and infinities too; a sweep scans the rows a fixed number of times, whatever its tests."""
    df = planted.withColumn("Z", F.when(F.abs("A") < 1.5, F.col("Z"))).withColumn("region", F.when(F.col("Y") > -2, F.col("region")))
    by = {v.name: v for v in D.variables(profile(df))}
    asked = [(a, b, s) for a, b in itertools.combinations(sorted(by), 2) for n in range(3) for s in itertools.combinations(sorted(set(by) - {a, b}), n)]
    for rows in (df, df.withColumn("A", F.when(F.col("A") > 2, float("inf")).otherwise(F.col("A"))), df.where("A > 100")):
        cuts = D.all_cuts(rows, [n for n in by if by[n].numeric], 4)
        cells = D.folded(rows, list(by.values()), 4, cuts)
        plain, over_cells = (D.independence_ps(rows, by, asked, 4, cuts, c) for c in (None, cells))
        cells.cells.unpersist()
        assert [str(p) if isinstance(p, Exception) else p for p in over_cells] == [str(p) if isinstance(p, Exception) else p and pytest.approx(p, rel=1e-6, abs=1e-12) for p in plain]
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda a: seen.add(1) or a, "double")
    own = planted.select(*[F.col(c) for c in planted.columns if c != "A"], counted("A").alias("A"))
    few = D.discover(own, list(by.values()))
    assert few[0].tests > 50 and 0 < seen.value <= 4 * 2000
    monkeypatch.setattr(D, "MAX_CELLS", 1)
    many = D.discover(planted, list(by.values()))
    assert (few[0].edges, few[0].separators, few[1].directed) == (many[0].edges, many[0].separators, many[1].directed)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """5,000 draws in 36 rows each, with keys of their own."""
    from tessera.queries import planted as Q

    out = tmp_path_factory.mktemp("repeated")
    key = F.col("draw") + Q.PRIME * F.col("copy")
    rows = spark.range(25_000, 30_000).withColumnRenamed("id", "draw").crossJoin(spark.range(36).withColumnRenamed("id", "copy"))
    rows.select((key / 8).cast("long").alias("l_orderkey"), (key % 8).cast("int").alias("l_linenumber")).write.parquet(f"{out}/lineitem.parquet")
    spark.range(1).write.parquet(f"{out}/region.parquet")
    return out


@pytest.mark.parametrize("name", ["planted_verify", "planted_verify_confounded", "planted_refutations", "planted_placebo_columns", "planted_oriented", "planted_oriented_by_prior", "planted_layers", "planted_separator", "planted_verify_edgeless", "planted_verify_open"])
def test_rows_that_repeat_a_draw_are_no_evidence(spark, repeated, name):
    import duckdb

    from tessera.queries.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{repeated}/lineitem.parquet/*.parquet'")
    by_text = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert by_text(QUERIES[name](spark, str(repeated)).collect()) == by_text(con.execute(ORACLES[name]).fetchall())


def test_cells_on_the_driver_are_tested_without_jobs(planted, spark):
    """Sums over cells that the driver holds equal sums over the table of cells, with nulls, and cost no job."""
    df = planted.withColumn("Z", F.when(F.abs("A") < 1.5, F.col("Z"))).withColumn("region", F.when(F.col("Y") > -2, F.col("region")))
    by = {v.name: v for v in D.variables(profile(df))}
    asked = [(a, b, s) for a, b in itertools.combinations(sorted(by), 2) for n in range(3) for s in itertools.combinations(sorted(set(by) - {a, b}), n)]
    cuts = D.all_cuts(df, [n for n in by if by[n].numeric], 4)
    cells = D.folded(df, list(by.values()), 4, cuts)
    found, jobs = jobs_of(spark, lambda: D.independence_ps(df, by, asked, 4, cuts, cells))
    table = D.independence_ps(df, by, asked, 4, cuts, D.Folded(cells.cells, cells.place))
    assert jobs == 0 and found == [p and pytest.approx(p, rel=1e-6, abs=1e-12) for p in table]
    assert D.independence_ps(df, by, asked[:30], 4, cuts, D.folded(df.where("A > 100"), list(by.values()), 4, cuts)) == [None] * 30


def jobs_of(spark, run):
    sc, group = spark.sparkContext, f"counted-{time.monotonic_ns()}"
    sc.setJobGroup(group, group)
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_no_task_holds_the_values_of_many_draws(spark, monkeypatch):
    from tessera.sources import profile as PR

    df = spark.range(0, 150_001, 1, 4).selectExpr("CAST(id * 7919 % 150001 AS DOUBLE) AS a")
    monkeypatch.setattr(PR.F, "percentile", lambda *_: pytest.fail("one task holds all values"))
    assert PR.quantile_cuts(df, ["a"], 4) == {"a": [37500.0, 75000.0, 112500.0]}


def test_a_cut_within_equal_values_is_that_value(spark):
    """As in SQL and in percentile: a mean weighted by shares of thirds may be off by a bit, and rows on the cut would change bins."""
    from tessera.sources.profile import quantile_cuts

    same = [0.9, 1.7, 1.8]
    df = spark.range(20).selectExpr(*[f"CAST({v} AS DOUBLE) AS c{i}" for i, v in enumerate(same)])
    assert quantile_cuts(df, df.columns, 3, held=1) == {f"c{i}": [v, v] for i, v in enumerate(same)}


def test_draws_are_found_by_bits(spark):
    """Each residue once and each key below 0 as itself, whatever the words they lie in; tasks send words, not keys."""
    from tessera.queries import planted as Q

    keys = [-1, -64, -65, -700_000, 0, 63, 64, 65, Q.PRIME - 1, Q.PRIME, Q.PRIME + 64, 40 * Q.PRIME + 777, 777, 2**30]
    cut = lambda k: (abs(k) // 8 * (1 if k >= 0 else -1), abs(k) % 8 * (1 if k >= 0 else -1))
    rows = spark.createDataFrame([cut(k) for k in keys] * 3, "l_orderkey long, l_linenumber int")
    once = sorted({k % Q.PRIME if k >= 0 else k for k in keys})
    plain = Q.planted(lambda _: spark.createDataFrame([cut(k) for k in once], "l_orderkey long, l_linenumber int"))
    with Q.draws(lambda _: rows) as found:
        assert sorted(found.collect()) == sorted(plain.collect())
        assert "bit_or" in found._jdf.queryExecution().toString()


def test_a_subsample_costs_two_aggregates(spark):
    """Scores over arms equal those of the same draws taken one by one; a null segment counts in a stratum and in no arm."""
    rows = [(float(i % 7) + (i % 3 == 0) * 2, "xyz"[i % 3], None if i % 11 == 0 else i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "y double, s string, t long").coalesce(1).cache()
    for agg in ("avg", "sum", "count"):
        goal, treated = Objective(agg, Ref("y")), [Constraint("t", "gt", 2)]
        got = E.rows_of(E.stability_rows(df, goal, treated, [("s", 0)], 5, draws=6))
        flags = df.select("*", *[(F.rand(5 + k) < E.SHARE).alias(f"d{k}") for k in range(6)])
        plain = [E.reweighted_leniently(E.rows_of(E.stratified_effect(flags.where(f"d{k}"), goal, treated, [("s", 0)]))) for k in range(6)]
        for reference in (plain[0], 0.97 * max(plain), -1.0):
            want = sum(p * reference > 0 and abs(p - reference) <= 0.05 * abs(reference) for p in plain) / 6
            assert E.stability(got, reference, 6, 0.05) == want
        assert len(got[0]) <= 3 + 2 * 6
    alone = E.rows_of(E.stability_rows(df.where("t > 2"), Objective("count", Ref("y")), [Constraint("t", "gt", 2)], [], 5, draws=2))
    assert E.stability(alone, float(alone[0]["n_0"]), 2) == 1.0


@pytest.mark.parametrize("name, most", [("planted_layers", 14), ("planted_oriented", 14), ("planted_oriented_by_prior", 14), ("planted_verify_edgeless", 14), ("planted_verify_open", 14), ("planted_placebo_columns", 20), ("planted_refutations", 30), ("planted_separator", 14)])
def test_a_query_takes_few_jobs(spark, repeated, name, most):
    from tessera.queries.registry import QUERIES

    assert jobs_of(spark, lambda: QUERIES[name](spark, str(repeated)).collect())[1] <= most


def test_one_scan_counts_rows_and_estimates_quantiles(spark):
    """Of many rows: a scan for their number and the estimates, another one for the values near them."""
    from tessera.sources.profile import quantile_cuts

    df = spark.range(0, 3001, 1, 2).selectExpr("CAST(id * 79 % 3001 AS DOUBLE) AS a", "CASE WHEN id % 3 > 0 THEN CAST(id AS DOUBLE) END AS b").cache()
    found, jobs = jobs_of(spark, lambda: quantile_cuts(df, ["a", "b"], 4, held=1))
    assert found == quantile_cuts(df, ["a", "b"], 4) and jobs <= 7


def test_few_combinations_are_folded_without_counting_them(planted, spark, monkeypatch):
    """Cuts and the levels of texts bound the cells; where the bound is too high, they are counted. The graph is the same."""
    counted, plain = [], D.F.xxhash64
    monkeypatch.setattr(D.F, "xxhash64", lambda *a: counted.append(len(a)) or plain(*a))
    few = D.discover(planted, D.variables(profile(planted)))
    assert not counted
    monkeypatch.setattr(D, "HELD_NUMBERS", 200_000)
    more = D.discover(planted, D.variables(profile(planted)))
    assert counted == [7] and few[0].p == {e: pytest.approx(p, rel=1e-6, abs=1e-12) for e, p in more[0].p.items()}
    assert (few[0].edges, few[0].separators, few[1].directed) == (more[0].edges, more[0].separators, more[1].directed)
    texts = planted.select("B", "C", "region")
    assert D.discover(texts, D.variables(profile(texts)))[0].tests >= 3


def test_values_at_ranks_are_found_without_a_join(spark, monkeypatch):
    """Ranks that fall on one value, on nulls' neighbours and on the ends are found where they are counted."""
    from tessera.sources import profile as PR

    df = spark.range(0, 30_000, 1, 3).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id DIV 10000 AS DOUBLE) AS b", "CASE WHEN id % 2 > 0 THEN -CAST(id AS DOUBLE) END AS c", "CAST(NULL AS DOUBLE) AS d").cache()
    plain = {bins: PR.quantile_cuts(df, df.columns, bins) for bins in (4, 32)}
    monkeypatch.setattr(PR, "small_table", lambda *_: pytest.fail("a table of ranks is joined"))
    monkeypatch.setattr(PR, "ranked_cuts", lambda _, own, __: dict.fromkeys(own, []) if set(own) <= {"d"} else pytest.fail("a rank was missed"))
    assert {bins: PR.quantile_cuts(df, df.columns, bins, held=1) for bins in (4, 32)} == {bins: {c: pytest.approx(v, rel=1e-12) for c, v in own.items()} for bins, own in plain.items()}


def test_a_value_is_compared_with_the_brackets_of_its_column(spark, monkeypatch):
    """Not with those of all columns: the comparisons of a row are as many as all brackets, not that many for each column."""
    from tessera.sources import profile as PR

    plans, explode = [], PR.F.explode
    df = spark.range(0, 30_000, 1, 3).selectExpr(*[f"CAST(id * {7 + 2 * i} % 30000 AS DOUBLE) AS c{i}" for i in range(5)]).cache()
    monkeypatch.setattr(PR.F, "explode", lambda x: plans.append(str(df.select(x.alias("x"))._jdf.queryExecution().analyzed())) or explode(x))
    assert PR.quantile_cuts(df, df.columns, 4, held=1) == PR.quantile_cuts(df, df.columns, 4)
    assert len(plans) == 1 and plans[0].count(" > ") == 5 * 3


def test_distinct_values_are_found_in_one_scan(spark):
    """Of columns at the cap, above it and without values; a task sends one value more than the cap at most."""
    from tessera.sources.profile import distinct_values

    df = spark.range(0, 9000, 1, 3).selectExpr("CAST(id % 4 AS STRING) AS at", "CAST(greatest(id - 8990, 0) AS STRING) AS above", "CAST(NULL AS STRING) AS none", "id % 3 = 0 AS flag", "id")
    found = distinct_values(df, cap=4)
    assert sorted(map(tuple, found.collect())) == [*(("at", str(i)) for i in range(4)), ("flag", "false"), ("flag", "true")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 9000") == 1 and "WindowGroupLimit" in plan


def test_a_result_that_the_driver_has_reads_no_table(spark, repeated):
    """lineitem is the only table that is opened: each opening is a job that reads the schema."""
    from tessera.queries import planted as Q
    from tessera.queries.registry import QUERIES

    with pytest.MonkeyPatch.context() as patch:
        opened, plain = [], type(spark.read).parquet
        patch.setattr(type(spark.read), "parquet", lambda self, path: opened.append(path.rpartition("/")[2]) or plain(self, path))
        assert QUERIES["planted_verify_edgeless"](spark, str(repeated)).collect() == [("",)]
    assert opened == ["lineitem.parquet"] and Q.frame(None, [("a", 1)], "a string, b long").collect() == [("a", 1)]
