"""Statistical, causal and search queries."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tessera.functions import statistics as S
from tessera.operators import discovery as D
from tessera.operators import effects as E
from tessera.operators import publish as P
from tessera.operators import search as R
from tessera.operators.analyze import collected_moments, contingency, moments, stratified_effect
from tessera.operators.cube import CubeMeasurer, cube
from tessera.operators.measure import execute
from tessera.plans.canonical import key
from tessera.plans.model import Constraint
from tessera.queries.measuring import arms, binned, objective, seg, treated
from tessera.queries.registry import query, r6, rounded
from tessera.sources.profile import profile

NAMES = ["l_quantity", "l_extendedprice", "l_discount"]


def frame(t, rows, schema):
    return t("region").sparkSession.createDataFrame(rows, schema)


def matrix(t):
    (m,) = collected_moments(moments(t("lineitem"), NAMES), 3)
    cross = {(i, j): m[f"cross_{i}_{j}"] for i in range(3) for j in range(i + 1, 3)}
    return m["n"], S.correlation_matrix(m["n"], [m[f"sum_{i}"] for i in range(3)], [m[f"sumsq_{i}"] for i in range(3)], cross)


query("stat_pearson", lambda t: rounded(frame(t, [(matrix(t)[1][0][1],)], "r double")), f"SELECT {r6('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem")
query("stat_partial_corr_3var", lambda t: rounded(frame(t, [(S.partial_correlation(matrix(t)[1]),)], "r double")), f"""
    WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem)
    SELECT {r6('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} AS r FROM c""")


def g_test(t, columns):
    g, dof, p = S.conditional_g({tuple(r[:-1]): r[-1] for r in contingency(t("lineitem"), columns).collect()})
    return g, dof, p


def g_sql(keys: str, strata: str) -> str:
    by = f"PARTITION BY {strata}" if strata else "PARTITION BY 1"
    also = f", {strata}" if strata else ""
    return f"""
    WITH base AS ({keys}), c AS (SELECT x, y{also}, count(*) AS o FROM base GROUP BY ALL),
    e AS (SELECT *, sum(o) OVER (PARTITION BY x{also}) AS r, sum(o) OVER (PARTITION BY y{also}) AS k, sum(o) OVER ({by}) AS n FROM c),
    d AS (SELECT 2 * sum(o * ln(o * n / (r * k))) AS g, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM e {f'GROUP BY {strata}' if strata else ''})
    SELECT round(sum(g), 4) + 0.0 AS g, CAST(sum(dof) AS BIGINT) AS dof FROM d WHERE dof > 0"""


query("stat_g_test", lambda t: rounded(frame(t, [g_test(t, [("l_returnflag", 0), ("l_linestatus", 0)])[:2]], "g double, dof long"), 4), g_sql("SELECT l_returnflag AS x, l_linestatus AS y FROM lineitem", ""))
query("stat_conditional_g", lambda t: rounded(frame(t, [g_test(t, [("l_returnflag", 0), ("l_linestatus", 0), ("l_quantity", 4)])[:2]], "g double, dof long"), 4), g_sql(f"SELECT l_returnflag AS x, l_linestatus AS y, {binned('l_quantity', 4, 'lineitem')} AS s FROM lineitem", "s"))


def bh(t):
    """Every hypothesis is a row; the driver sees different p-values with their numbers only."""
    p = t("orders").select("o_orderkey", (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) / 10007.0 * F.pmod("o_orderkey", F.lit(5)) / 4.0).alias("p"))
    threshold = S.rejection_threshold([(r.p, r.n) for r in p.groupBy("p").agg(F.count("*").alias("n")).collect()], 0.05)
    return p.select("o_orderkey", (F.col("p") <= threshold).alias("rejected"))


query("stat_bh_reject", bh, """
    WITH p AS (SELECT o_orderkey, ((o_orderkey * 7919) % 10007) / 10007.0 * (o_orderkey % 5) / 4.0 AS p FROM orders),
    k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p)
    SELECT o_orderkey, p <= coalesce((SELECT max(p) FROM k WHERE p <= k * 0.05 / m), -1) AS rejected FROM k""")
strata = [("l_linestatus", 0), ("l_discount", 3)]
strata_sql = f"SELECT l_linestatus, {binned('l_discount', 3, 'lineitem')} AS b, count(*) AS n, count(CASE WHEN {seg} THEN 1 END) AS seg_n, avg(CASE WHEN {seg} THEN l_extendedprice END) AS s, count(CASE WHEN NOT {seg} THEN 1 END) AS base_n, avg(CASE WHEN NOT {seg} THEN l_extendedprice END) AS o FROM lineitem GROUP BY 1, 2"
adjusted = lambda t: E.rows_of(stratified_effect(t("lineitem"), objective, treated, strata))
query("stat_reweight_strict", lambda t: rounded(frame(t, [(E.reweighted(adjusted(t)),)], "effect double")), f"WITH s AS ({strata_sql}) SELECT CASE WHEN min(least(seg_n, base_n)) >= 20 THEN {r6('sum((s - o) * n) / sum(n)')} END AS effect FROM s")
query("stat_reweight_lenient", lambda t: rounded(frame(t, [(E.reweighted_leniently(adjusted(t)),)], "effect double")), f"WITH s AS ({strata_sql}) SELECT {r6('sum((s - o) * n) / sum(n)')} AS effect FROM s WHERE s IS NOT NULL AND o IS NOT NULL")
query("stat_collapse", lambda t: frame(t, [(E.collapses(E.difference(E.rows_of(stratified_effect(t("lineitem"), objective, treated))), E.reweighted_leniently(adjusted(t))),)], "collapses boolean"), f"""
    WITH s AS ({strata_sql}), a AS (SELECT sum((s - o) * n) / sum(n) AS adj FROM s WHERE s IS NOT NULL AND o IS NOT NULL), e AS (SELECT {arms} FROM lineitem)
    SELECT seg_agg <> base_agg AND ((seg_agg - base_agg) * adj < 0 OR abs(adj) < 0.5 * abs(seg_agg - base_agg)) AS collapses FROM a, e""")
CAUSAL = [D.Variable(n, k) for n, k in (("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_returnflag", False), ("l_linestatus", False))]


def sweep(t):
    return D.discover(t("lineitem"), CAUSAL)


query("pc_skeleton", lambda t: frame(t, [(a, b, s.status[a, b]) for s in [sweep(t)[0]] for a, b in sorted(s.edges)] , "a string, b string, status string"))
query("refutation_scores", lambda t: frame(t, [(E.stability(E.rows_of(E.stability_rows(t("lineitem"), objective, treated, [], 5)), E.difference(E.rows_of(stratified_effect(t("lineitem"), objective, treated)))),)], "stability double"))

columns = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


def vocabulary(t):
    return R.schema_atoms(profile(t("lineitem").select(*columns).withColumn("l_quantity", F.col("l_quantity").cast("double")), bins=3))


atoms_of_flags = [Constraint("l_returnflag", "eq", "A"), Constraint("l_returnflag", "eq", "N"), Constraint("l_returnflag", "eq", "R"), Constraint("l_linestatus", "eq", "F"), Constraint("l_linestatus", "eq", "O"), Constraint("l_quantity", "gt", 25.0)]
flag_sql = ["l_returnflag = 'A'", "l_returnflag = 'N'", "l_returnflag = 'R'", "l_linestatus = 'F'", "l_linestatus = 'O'", "l_quantity > 25"]


def measured_segments(t, segments):
    found = CubeMeasurer(t("lineitem"), objective, atoms_of_flags)(segments)
    return [(i, m.value, m.support) for i, m in enumerate(found)]


def segments_sql(tests, having=""):
    return " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS segment, {r6('avg(l_extendedprice)')} AS value, count(*) AS support FROM lineitem WHERE {w} {having}" for i, w in enumerate(tests))




pairs = [p for p in itertools.combinations(range(6), 2)]
schema = "segment int, value double, support long"
query("cube_signatures", lambda t: rounded(cube(t("lineitem"), objective, atoms_of_flags).select("sig0", "rows", "n", "total", "low", "high"), 2), f"""
    SELECT CAST({' + '.join(f'CASE WHEN {w} THEN {1 << i} ELSE 0 END' for i, w in enumerate(flag_sql))} AS BIGINT) AS sig0, count(*) AS rows, count(l_extendedprice) AS n,
           round(sum(l_extendedprice), 2) + 0.0 AS total, round(min(l_extendedprice), 2) + 0.0 AS low, round(max(l_extendedprice), 2) + 0.0 AS high FROM lineitem GROUP BY 1""")
query("cube_singles", lambda t: rounded(frame(t, measured_segments(t, [[a] for a in atoms_of_flags]), schema)), segments_sql(flag_sql))
query("cube_pairs", lambda t: rounded(frame(t, measured_segments(t, [[atoms_of_flags[i], atoms_of_flags[j]] for i, j in pairs]), schema)), segments_sql([f"{flag_sql[i]} AND {flag_sql[j]}" for i, j in pairs]))
query("cube_pairs_supported", lambda t: rounded(frame(t, [r for r in measured_segments(t, [[atoms_of_flags[i], atoms_of_flags[j]] for i, j in pairs]) if r[2] >= 30], schema)), segments_sql([f"{flag_sql[i]} AND {flag_sql[j]}" for i, j in pairs], "HAVING count(*) >= 30"))
query("atoms_schema", lambda t: frame(t, [(a.constraint.field, a.constraint.op, str(a.constraint.value)) for a in R.schema_atoms(profile(t("lineitem").select("l_returnflag", "l_linestatus")))], "field string, op string, value string"), """
    SELECT DISTINCT 'l_returnflag' AS field, 'eq' AS op, l_returnflag AS value FROM lineitem UNION ALL SELECT DISTINCT 'l_linestatus', 'eq', l_linestatus FROM lineitem""")


def single_findings(t):
    return [R.Finding(str(i), (a,), (a,), v, n) for (i, v, n), a in zip(measured_segments(t, [[a] for a in atoms_of_flags]), atoms_of_flags, strict=True)]


singles_sql = f"WITH f AS ({segments_sql(flag_sql)}), b AS (SELECT avg(l_extendedprice) AS base FROM lineitem)"
baseline = lambda t: execute(t("lineitem"), objective)[objective.label]
query("s_star", lambda t: rounded(frame(t, [(R.s_star(single_findings(t), objective),)], "s_star double")), f"{singles_sql} SELECT max(value) AS s_star FROM f WHERE support >= 30")
query("materially_better", lambda t: frame(t, [(int(f.id), R.materially_better(objective, f.value, b)) for b in [baseline(t)] for f in single_findings(t)], "segment int, better boolean"), f"{singles_sql} SELECT segment, value > base AND abs(value - base) / greatest(abs(base), 1e-9) >= 0.05 AS better FROM f, b")
query("beam_level1", lambda t: rounded(frame(t, sorted(((int(f.id), f.value - baseline(t)) for f in single_findings(t)), key=lambda x: -x[1])[:3], "segment int, delta double"), 4), f"{singles_sql} SELECT segment, round(value - base, 4) + 0.0 AS delta FROM f, b ORDER BY value - base DESC LIMIT 3")
query("shrunk_rank", lambda t: rounded(frame(t, [(int(f.id), P.shrunk_score(f.value - baseline(t), f.support, 30)) for f in single_findings(t)], "segment int, score double"), 3), f"{singles_sql} SELECT segment, round((value - base) * support / (support + 30), 3) + 0.0 AS score FROM f, b")
query("promote_top_n", lambda t: frame(t, [(int(f.id),) for f in P.promoted(single_findings(t), objective, baseline(t), 3)], "segment int"), f"{singles_sql} SELECT segment FROM f, b ORDER BY (value - base) * support / (support + 30) DESC, CAST(segment AS VARCHAR) LIMIT 3")
query("publish_dedupe", lambda t: P.best_by_key(t("orders").select("o_orderpriority", F.round("o_totalprice", 2).alias("score"), F.array(F.col("o_orderstatus")).alias("sources")), "o_orderpriority", "score", "sources").withColumn("sources", F.array_join("sources", ",")), """
    SELECT o_orderpriority, max(round(o_totalprice, 2)) AS score, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS sources FROM orders GROUP BY 1""")
query("claim_overlap", lambda t: frame(t, [(i, P.overlap([atoms_of_flags[a], atoms_of_flags[b]], [atoms_of_flags[2], atoms_of_flags[5]])) for i, (a, b) in enumerate(pairs)], "segment int, overlap double"), f"SELECT * FROM (VALUES {', '.join(f'(CAST({i} AS INT), CAST({((a in (2, 5)) + (b in (2, 5))) / 2} AS DOUBLE))' for i, (a, b) in enumerate(pairs))}) v(segment, overlap)")


def searched(t, policy):
    df = t("lineitem")
    atoms = vocabulary(t)
    s = R.Search(objective, CubeMeasurer(df, objective, [a.constraint for a in atoms]), baseline(t))
    (R.beam if policy == "beam" else R.tree_search)(s, atoms)
    return s


def winners(t, policy):
    s = searched(t, policy)
    return frame(t, [(key(c), m.value, m.support) for c, m in s.winners()], "segment string, value double, support long")


query("beam_search", lambda t: winners(t, "beam"))
query("uct_search", lambda t: winners(t, "uct"))


def publications(t):
    s = searched(t, "beam")
    found = [R.Finding(key(c), tuple(c), tuple(c), m.value, m.support) for c, m in s.winners()]
    return frame(t, [(" AND ".join(x.text() for x in p.filters), p.value, p.support, p.score) for p in P.published(found, objective, s.baseline)], "segment string, value double, support long, score double")


query("publish_containment", publications)


query("claim_measurement", lambda t: frame(t, [(c.value, c.baseline, c.support, c.agrees) for c in [E.measure_claim(t("lineitem"), objective, treated)]], "value double, baseline double, support long, agrees boolean").transform(rounded), f"SELECT {r6(f'avg(CASE WHEN {seg} THEN l_extendedprice END)')} AS value, {r6('avg(l_extendedprice)')} AS baseline, count(CASE WHEN {seg} THEN 1 END) AS support, avg(CASE WHEN {seg} THEN l_extendedprice END) > avg(l_extendedprice) AS agrees FROM lineitem")
