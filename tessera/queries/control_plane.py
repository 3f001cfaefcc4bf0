"""Graph, vector, control-plane, text and event queries over the test tables in the roles of the engine's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import control as K
from tessera.operators import graph as G
from tessera.operators import textops as X
from tessera.operators import vectors as V
from tessera.queries.registry import query, r6, rounded
from tessera.sources.tabular import document_sample, pages, registered

# Derived tables: expressions that both engines read alike.
TABLES = {
    "edges": ("orders", ["'s' || CAST(o_custkey % 7 AS STRING) AS state_id", "'i' || CAST(o_custkey AS STRING) AS intervention_id", "'o' || CAST(o_orderkey AS STRING) AS outcome_id", "o_totalprice AS effect_size", "CAST((o_orderkey * 37) % 1009 AS DOUBLE) / 1009 AS confidence", "CASE WHEN o_orderkey % 3 = 0 THEN 'causal_inferred' WHEN o_orderkey % 3 = 1 THEN 'observational' END AS epistemic_source", "o_orderkey % 11 = 0 AS superseded", "CAST(o_orderkey % 5 AS INT) AS graph_version"]),
    "interventions": ("customer", ["'i' || CAST(c_custkey AS STRING) AS intervention_id", "c_custkey % 4 = 0 AS sleep_derived", "CASE WHEN c_custkey % 5 = 0 THEN 'extract' ELSE 'filter' END AS type", "'g' || CAST(c_custkey % 50 AS STRING) AS goal_id", "CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE '[{\"field\":\"seg\",\"op\":\"eq\",\"value\":\"' || c_mktsegment || '\"},{\"field\":\"n\",\"op\":\"gte\",\"value\":' || CAST(c_custkey % 9 AS STRING) || '.5}]' END AS effective_filters", "c_mktsegment AS segment", "CAST(c_custkey % 9 AS STRING) AS digit", "CASE WHEN c_custkey % 6 = 0 THEN '[]' WHEN c_custkey % 6 = 1 THEN 'bad' ELSE '[{\"field\":\"a\",\"op\":\"eq\",\"value\":\"b\"}]' END AS new_filters"]),
    "outcomes": ("orders", ["'o' || CAST(o_orderkey AS STRING) AS outcome_id", "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status", "o_totalprice AS value", "'g' || CAST(o_custkey % 50 AS STRING) AS goal_id", "CAST((o_orderkey * 37) % 1009 AS DOUBLE) / 1009 AS confidence"]),
    "evidence": ("supplier", ["'h' || CAST(s_suppkey % 20 AS STRING) AS heuristic_id", "CASE s_suppkey % 3 WHEN 0 THEN 'i' || CAST(s_suppkey AS STRING) WHEN 1 THEN 's' || CAST(s_suppkey % 7 AS STRING) ELSE 'o' || CAST(s_suppkey AS STRING) END AS node_id"]),
    "causal_edges": ("lineitem", ["CASE l_linenumber % 2 WHEN 0 THEN 'g0' ELSE 'g1' END AS goal", "l_returnflag AS ref", "CAST(l_suppkey % 4 AS INT) AS version", "'c' || CAST(l_suppkey AS STRING) AS col_a", "'d' || CAST(l_partkey AS STRING) AS col_b", "'a_to_b' AS direction", "'discovered' AS provenance", "CAST(0.5 AS DOUBLE) AS confidence", "'tested' AS status"]),
    "metas": ("supplier", ["CASE s_suppkey % 2 WHEN 0 THEN 'g0' ELSE 'g1' END AS goal", "CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS ref", "CAST(s_suppkey % 3 AS INT) AS version"]),
    "datasets": ("customer", ["c_custkey AS dataset_id", "c_name AS name", "'u' || CAST(c_nationkey AS STRING) AS owner_id", "c_mktsegment AS ref", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 17 END AS last_accessed_at", "c_custkey % 23 AS created_at"]),
    "goals": ("orders", ["o_orderkey AS goal_id", "o_custkey AS dataset_id", "CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 5 AS INT) END AS budget", "o_orderpriority AS ref"]),
    "shares": ("supplier", ["s_suppkey AS dataset_id", "'u' || CAST(s_nationkey AS STRING) AS user_id", "s_suppkey % 13 AS created_at"]),
    "runs": ("events", ["user_id AS goal_id", "ts AS started_at", "event_type AS status"]),
    "verifications": ("lineitem", ["l_orderkey AS goal_id", "l_partkey AS intervention_id", "l_linenumber % 2 = 0 AS budgeted", "CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'N' THEN 'pending' ELSE 'verified' END AS status", "l_shipdate AS lease_deadline"]),
    "vectors": ("embeddings", ["vec_id AS node_id", "CASE WHEN label < 8 THEN 'g' || CAST(label AS STRING) END AS goal_id", "embedding"]),
    "vector_goals": ("nation", ["'g' || CAST(n_nationkey AS STRING) AS goal_id", "'d' || CAST(n_regionkey AS STRING) AS dataset_id"]),
    "nodes": ("embeddings", ["vec_id AS node_id", "vec_id % 5 = 0 AS stale", "vec_id % 50 = 0 AS embedding_pending", "label"]),
}


def table(t, name):
    base, expressions = TABLES[name]
    return t(base).selectExpr(*expressions)


def named(name: str, make, used: list[str], sql: str) -> None:
    ctes = ", ".join(f"{n} AS (SELECT {', '.join(TABLES[n][1])} FROM {TABLES[n][0]})" for n in used)
    query(name, lambda t: make(*[table(t, n) for n in used]), f"WITH {ctes} {sql}")


named("g_eligible_findings", lambda e, i, o: G.eligible_findings(e, i, o).select("outcome_id", "intervention_id", "state_id"), ["edges", "interventions", "outcomes"], """
    SELECT e.outcome_id, e.intervention_id, e.state_id FROM edges e JOIN interventions i USING (intervention_id) JOIN outcomes o USING (outcome_id)
    WHERE coalesce(epistemic_source, 'observational') = 'observational' AND NOT sleep_derived AND status IN ('verified', 'confirmed', 'corrected')""")
named("g_trace", G.trace, ["evidence", "edges"], "SELECT DISTINCT heuristic_id, state_id, intervention_id, outcome_id FROM evidence JOIN edges ON node_id IN (state_id, intervention_id, outcome_id)")
live = "epistemic_source = 'causal_inferred' AND NOT superseded"
named("g_evidence_max", G.strongest_evidence, ["evidence", "edges"], f"""
    SELECT heuristic_id, m.intervention_id, m.confidence FROM (SELECT heuristic_id, max({{'confidence': confidence, 'intervention_id': intervention_id}}) AS m FROM evidence JOIN edges ON node_id = intervention_id WHERE {live} GROUP BY 1)""")
named("g_evidence_latest", G.newest_evidence, ["edges"], f"SELECT intervention_id, m.graph_version, m.confidence FROM (SELECT intervention_id, max({{'graph_version': graph_version, 'confidence': confidence}}) AS m FROM edges WHERE {live} GROUP BY 1)")
named("g_stale", G.stale_heuristics, ["evidence", "outcomes"], "SELECT heuristic_id, coalesce(bool_or(status = 'rejected'), false) AS stale FROM evidence LEFT JOIN outcomes ON node_id = outcome_id GROUP BY 1")
named("g_supersede", lambda e: G.supersede(e, "i7", 3, True).select("outcome_id", "superseded"), ["edges"], "SELECT outcome_id, CASE WHEN intervention_id = 'i7' AND epistemic_source = 'causal_inferred' AND graph_version < 3 THEN true ELSE superseded END AS superseded FROM edges")
named("g_supersede_unconfirmed", lambda e: G.supersede(e, "i7", 3, False).select("outcome_id", "superseded"), ["edges"], "SELECT outcome_id, CASE WHEN intervention_id = 'i7' AND epistemic_source = 'causal_inferred' AND graph_version <= 3 THEN true ELSE superseded END AS superseded FROM edges")
named("g_latest_graph", lambda c, m: G.latest_graph(m, c).select("goal", "ref", "version", "col_a", "col_b"), ["causal_edges", "metas"], "SELECT goal, ref, version, col_a, col_b FROM causal_edges WHERE (goal, ref, version) IN (SELECT goal, ref, max(version) FROM metas GROUP BY 1, 2)")
GRAPH_HERE = "goal = 'g0' AND ref = 'A'"
CORRECTED = ["direction", "provenance", "confidence", "status", "version"]


def corrected(action: str, source: str, target: str):
    """One correction of the graph of g0 over A; source and target: expressions over its edges at the served version."""

    def make(c, m):
        names = c.select("goal", "ref", F.col("col_a").alias("name")).union(c.select("goal", "ref", F.col("col_b").alias("name"))).distinct()
        served = c.join(m.where(GRAPH_HERE).groupBy("goal", "ref").agg(F.max("version").alias("version")), ["goal", "ref", "version"], "left_semi")
        pair = served.agg(F.min(F.struct("col_a", "col_b")).alias("first"), F.min("col_a").alias("low"), F.max("col_a").alias("high")).selectExpr(f"upper({source}) AS s", f"{target} AS t").first()  # one row
        return G.correct_edge(m, names, c, "g0", "A", action, pair.s, pair.t).groupBy(*CORRECTED).count()

    return make


def corrected_sql(action: str) -> str:
    served = f"served AS (SELECT * FROM causal_edges WHERE {GRAPH_HERE} AND version = (SELECT max(version) FROM metas WHERE {GRAPH_HERE}))"
    hit = "(col_a, col_b) = (SELECT (f.col_a, f.col_b) FROM (SELECT col_a, col_b FROM served ORDER BY col_a, col_b LIMIT 1) f)"
    kept = f"SELECT direction, provenance, confidence, status, version + 1 AS version FROM served WHERE NOT {hit}"
    more = {
        "flip": f" UNION ALL SELECT 'b_to_a', 'analyst', 1.0, 'tested', version + 1 FROM served WHERE {hit}",
        "delete": "",
        "add": f" UNION ALL SELECT direction, provenance, confidence, status, version + 1 FROM served WHERE {hit} UNION ALL SELECT 'b_to_a', 'analyst', 1.0, 'tested', max(version) + 1 FROM metas WHERE {GRAPH_HERE}",
    }
    return f", {served}, r AS ({kept}{more[action]}) SELECT direction, provenance, confidence, status, CAST(version AS INT) AS version, count(*) AS count FROM r GROUP BY ALL"


for action, source, target in (("flip", "first.col_b", "first.col_a"), ("delete", "first.col_a", "first.col_b"), ("add", "high", "low")):
    base, sql = corrected(action, source, target), corrected_sql(action)
    ctes = ", ".join(f"{n} AS (SELECT {', '.join(TABLES[n][1])} FROM {TABLES[n][0]})" for n in ("causal_edges", "metas"))
    query(f"g_correct_edge_{action}", lambda t, make=base: make(table(t, "causal_edges"), table(t, "metas")), f"WITH {ctes} {sql}")
named("g_missing_ids", lambda e, n: G.unresolved_ids(e.select("node_id"), n.select(F.col("intervention_id").alias("node_id"))), ["evidence", "edges"], "SELECT node_id, found FROM (SELECT a.node_id, count(e.intervention_id) AS found FROM (SELECT DISTINCT node_id FROM evidence) a LEFT JOIN edges e ON e.intervention_id = a.node_id GROUP BY 1) WHERE found <> 1")
named("g_source_conjunctions", lambda i: G.source_conjunctions(i).select("intervention_id", F.size("filters").cast("long").alias("n")), ["interventions"], "SELECT intervention_id, CAST(1 AS BIGINT) AS n FROM interventions WHERE new_filters NOT IN ('[]', 'bad')")
named("g_extraction_outcomes", lambda e, i: G.extraction_outcomes(e, i, "g10"), ["edges", "interventions"], """
    SELECT outcome_id, intervention_id, confidence FROM edges JOIN interventions USING (intervention_id)
    WHERE type = 'extract' AND goal_id = 'g10' AND coalesce(epistemic_source, 'observational') = 'observational'""")
named("g_labelled_matches", lambda v, e: G.labelled_matches(v.select("heuristic_id").distinct(), G.strongest_evidence(v, e)).select("heuristic_id", "confidence", "epistemic_source"), ["evidence", "edges"], f"""
    SELECT heuristic_id, confidence, CASE WHEN confidence IS NULL THEN 'observational' ELSE 'causal_inferred' END AS epistemic_source
    FROM (SELECT DISTINCT heuristic_id FROM evidence) LEFT JOIN (SELECT heuristic_id, max(confidence) AS confidence FROM evidence JOIN edges ON node_id = intervention_id WHERE {live} GROUP BY 1) USING (heuristic_id)""")
named("g_records_with_segments", lambda e, i: G.with_segments(e.select("outcome_id", "intervention_id"), i.where("type = 'extract'")).select("outcome_id", "segment"), ["edges", "interventions"], """
    SELECT outcome_id, CASE WHEN effective_filters IS NULL OR effective_filters = 'bad' THEN '' ELSE 'seg = ' || segment || ' AND n >= ' || digit || '.5' END AS segment
    FROM edges LEFT JOIN (SELECT * FROM interventions WHERE type = 'extract') i USING (intervention_id)""")
named("g_upsert", lambda o: G.upsert(o.select("outcome_id", "status", "goal_id"), o.where("value > 200000").select("outcome_id", F.lit("confirmed").alias("status"), F.lit("").alias("goal_id")), ["outcome_id"], keep_known=["goal_id"]), ["outcomes"], "SELECT outcome_id, CASE WHEN value > 200000 THEN 'confirmed' ELSE status END AS status, goal_id FROM outcomes")
resolvable = "EXISTS (SELECT 1 FROM edges e WHERE e.outcome_id = outcomes.outcome_id AND coalesce(epistemic_source, 'observational') = 'observational')"
for name, outcome in (("g_resolve_outcome", "o5"), ("g_resolve_causal_outcome", "o3")):
    named(name, lambda o, e, x=outcome: rounded(G.resolve_outcome(o, e, x, "corrected", 0.9, 1.5)[0].select("outcome_id", "status", "value")), ["outcomes", "edges"], f"""
        SELECT outcome_id, CASE WHEN outcome_id = '{outcome}' AND {resolvable} THEN 'corrected' ELSE status END AS status,
               {r6(f"CASE WHEN outcome_id = '{outcome}' AND {resolvable} THEN 1.5 ELSE value END")} AS value FROM outcomes""")
named("g_resolve_edges", lambda o, e: rounded(G.resolve_outcome(o, e, "o5", "verified", 0.9)[1].select("outcome_id", "confidence")), ["outcomes", "edges"], f"SELECT outcome_id, {r6('CASE WHEN outcome_id = ' + chr(39) + 'o5' + chr(39) + ' THEN 0.9 ELSE confidence END')} AS confidence FROM edges")
named("g_delete_goal", lambda i, e: G.delete_goal(i.select(F.col("intervention_id").alias("node_id"), "goal_id"), e, "g7")[1].select("outcome_id", "intervention_id"), ["interventions", "edges"], "SELECT outcome_id, intervention_id FROM edges WHERE intervention_id NOT IN (SELECT intervention_id FROM interventions WHERE goal_id = 'g7')")
named("g_delete_node", lambda i, e: G.delete_node(i.select(F.col("intervention_id").alias("node_id"), "goal_id"), e, "i7")[1].groupBy("intervention_id").count(), ["interventions", "edges"], "SELECT intervention_id, count(*) AS count FROM edges WHERE intervention_id <> 'i7' GROUP BY 1")
named("g_without_goal", lambda o: G.without_goal(o, "g7").groupBy("goal_id").count(), ["outcomes"], "SELECT goal_id, count(*) AS count FROM outcomes WHERE goal_id IS DISTINCT FROM 'g7' GROUP BY 1")

DISTANCE = "1 - list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"
HITS = f"hits AS (SELECT a.node_id, a.goal_id, {DISTANCE} AS distance FROM vectors a, vectors q WHERE q.node_id = 0)"


def query_vector(v):
    return [float(x) for x in v.where("node_id = 0").first()["embedding"]]


def near(v, k=10, floor=2.0):
    return V.nearest(v, query_vector(v), k, floor)


named("vec_topk", lambda v: rounded(near(v)), ["vectors"], f", {HITS} SELECT node_id, {r6('distance')} AS distance FROM hits ORDER BY distance, node_id LIMIT 10")
named("vec_topk_floor", lambda v: rounded(near(v, 100, 0.8)), ["vectors"], f", {HITS} SELECT node_id, {r6('distance')} AS distance FROM hits WHERE distance <= 0.8 ORDER BY distance, node_id LIMIT 100")
named("vec_scope_goal", lambda v, g: rounded(V.nearest(V.in_scope(v, g, goal="g3"), query_vector(v), 10, 2.0)), ["vectors", "vector_goals"], f", {HITS} SELECT node_id, {r6('distance')} AS distance FROM hits WHERE goal_id = 'g3' ORDER BY distance, node_id LIMIT 10")
named("vec_scope_dataset", lambda v, g: rounded(V.nearest(V.in_scope(v, g, dataset="d1"), query_vector(v), 10, 2.0)), ["vectors", "vector_goals"], f", {HITS} SELECT node_id, {r6('distance')} AS distance FROM hits LEFT JOIN vector_goals USING (goal_id) WHERE goal_id IS NULL OR dataset_id = 'd1' ORDER BY distance, node_id LIMIT 10")
named("vec_scope_access", lambda v, g: rounded(V.nearest(V.in_scope(v, g, visible=g.where("dataset_id in ('d0', 'd2')")), query_vector(v), 10, 2.0)), ["vectors", "vector_goals"], f", {HITS} SELECT node_id, {r6('distance')} AS distance FROM hits WHERE goal_id IN (SELECT goal_id FROM vector_goals WHERE dataset_id IN ('d0', 'd2')) ORDER BY distance, node_id LIMIT 10")
named("vec_reconcile_anti", lambda n, v: V.to_embed(n, v.where("goal_id is not null")).select("node_id"), ["nodes", "vectors"], "SELECT DISTINCT node_id FROM nodes WHERE embedding_pending OR node_id NOT IN (SELECT node_id FROM vectors WHERE goal_id IS NOT NULL)")
named("vec_hydrate_rank", lambda v, n: rounded(V.hydrate(near(v, 20), n).select("node_id", "label", "distance")), ["vectors", "nodes"], f", {HITS}, top AS (SELECT * FROM hits ORDER BY distance, node_id LIMIT 20) SELECT node_id, label, {r6('distance')} AS distance FROM top JOIN nodes USING (node_id) WHERE NOT stale")
named("vec_orphans", lambda v, n: V.orphans(near(v, 20), n.where("label < 5")).select("node_id"), ["vectors", "nodes"], f", {HITS}, top AS (SELECT * FROM hits ORDER BY distance, node_id LIMIT 20) SELECT node_id FROM top WHERE node_id NOT IN (SELECT node_id FROM nodes WHERE label < 5) AND EXISTS (SELECT 1 FROM top JOIN nodes USING (node_id) WHERE label < 5)")
named("vec_prior", lambda v: rounded(near(v, 8).select("node_id", V.retrieval_prior(F.col("distance")).alias("prior"))), ["vectors"], f", {HITS} SELECT node_id, {r6('1 - distance / 2')} AS prior FROM hits ORDER BY distance, node_id LIMIT 8")

named("ctl_dataset_counts", lambda d, g: K.dataset_counts(d, g).select("dataset_id", "objectives"), ["datasets", "goals"], "SELECT dataset_id, count(goal_id) AS objectives FROM datasets LEFT JOIN goals USING (dataset_id) GROUP BY 1")
access = "owner_id = 'u5' OR dataset_id IN (SELECT dataset_id FROM shares WHERE user_id = 'u5')"
named("ctl_accessible", lambda d, s: K.accessible(d, s, "u5").select("dataset_id"), ["datasets", "shares"], f"SELECT dataset_id FROM datasets WHERE {access}")
named("ctl_goal_visible", lambda g, d, s: K.visible_goals(g, d, s, "u5").select("goal_id"), ["goals", "datasets", "shares"], f"SELECT goal_id FROM goals WHERE dataset_id IN (SELECT dataset_id FROM datasets WHERE {access})")
named("ctl_latest_run", lambda r: K.latest_per(r, "goal_id", "started_at").select("goal_id", "status"), ["runs"], "SELECT goal_id, arg_max(status, started_at) AS status FROM runs GROUP BY 1")
named("ctl_goals_with_runs", lambda g, r: K.goals_with_runs(g, r).select("goal_id", "status"), ["goals", "runs"], "SELECT goal_id, coalesce(status, 'no run') AS status FROM goals LEFT JOIN (SELECT goal_id, arg_max(status, started_at) AS status FROM runs GROUP BY 1) USING (goal_id)")
named("ctl_inventory_top", lambda d: K.inventory(d).select("dataset_id").limit(25), ["datasets"], "SELECT dataset_id FROM datasets ORDER BY last_accessed_at DESC NULLS LAST, created_at DESC, dataset_id LIMIT 25")
named("ctl_budget", lambda v, g: K.budget_used(v, g).select("goal_id", "used", "left"), ["verifications", "goals"], "SELECT goal_id, coalesce(n, 0) AS used, coalesce(budget, 10) - coalesce(n, 0) AS left FROM goals LEFT JOIN (SELECT goal_id, count(*) AS n FROM verifications WHERE budgeted AND status <> 'failed' GROUP BY 1) USING (goal_id)")
named("ctl_reap", lambda v: K.reap(v, __import__("datetime").datetime(1995, 6, 1)).groupBy("status").count(), ["verifications"], "SELECT CASE WHEN status = 'pending' AND lease_deadline < TIMESTAMP '1995-06-01' THEN 'failed' ELSE status END AS status, count(*) AS count FROM verifications GROUP BY 1")
query("ctl_stale_overlap", lambda t: K.stale_by_columns(t("part").select(F.col("p_partkey").alias("intervention_id"), F.split("p_type", " ").alias("adjustment_set")), ["BRASS", "SMALL", "ECONOMY"]), "SELECT DISTINCT p_partkey AS intervention_id FROM part WHERE list_has_any(string_split(p_type, ' '), ['BRASS', 'SMALL', 'ECONOMY'])")
named("ctl_ref_usage", lambda g, d: K.ref_usage("BUILDING", g, d), ["goals", "datasets"], "SELECT (SELECT count(*) FROM goals WHERE ref = 'BUILDING') AS goals, (SELECT count(*) FROM datasets WHERE ref = 'BUILDING') AS datasets")
named("ctl_name_search", lambda d: K.name_matches(d, "er#00000001").select("dataset_id"), ["datasets"], "SELECT dataset_id FROM datasets WHERE position('er#00000001' IN lower(name)) > 0")
query("ctl_auto_name", lambda t: t("customer").select("c_custkey", K.auto_name(F.concat(F.lit("s3/In Box/"), "c_name")).alias("name")), "SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9._-]', '_', 'g')) || '-' || substr(md5('s3/In Box/' || c_name), 1, 6) AS name FROM customer")
named("ctl_conf_hist", K.confidence_histogram, ["outcomes"], "SELECT CAST(least(greatest(floor(confidence * 10), 0), 9) AS INT) AS bin, count(*) AS n FROM outcomes GROUP BY 1")
named("ctl_bar_heights", lambda o: rounded(K.bar_heights(K.confidence_histogram(o))), ["outcomes"], f"SELECT bin, {r6('greatest(n * 88.0 / max(n) OVER (), 3.0)')} AS height FROM (SELECT CAST(least(greatest(floor(confidence * 10), 0), 9) AS INT) AS bin, count(*) AS n FROM outcomes GROUP BY 1)")
named("ctl_deletable", lambda g, r, v: K.deletable(g, r.withColumn("status", F.when(F.col("status") == "click", "running").otherwise("done")), v).select("goal_id"), ["goals", "runs", "verifications"], "SELECT goal_id FROM goals WHERE goal_id NOT IN (SELECT goal_id FROM runs WHERE status = 'click') AND goal_id NOT IN (SELECT goal_id FROM verifications WHERE status = 'pending')")
query("ctl_row_counts", lambda t: K.row_counts({n: t(n) for n in ("nation", "orders", "region")}), 'SELECT \'nation\' AS "table", count(*) AS rows FROM nation UNION ALL SELECT \'orders\', count(*) FROM orders UNION ALL SELECT \'region\', count(*) FROM region')
named("ctl_ref_scope", lambda g, d: registered(g, d.where("dataset_id < 0 or ref = 'BUILDING'").select(F.lit("1-URGENT").alias("ref"))).select("goal_id"), ["goals", "datasets"], "SELECT goal_id FROM goals WHERE ref = '1-URGENT'")
named("ctl_queue_claim", lambda o: K.resolve_queue(K.claim_queue(o.select("outcome_id", "status", F.lit(None).cast("string").alias("resolution")), "o1"), "o2", "confirm").groupBy("status", "resolution").count(), ["outcomes"], "SELECT CASE WHEN status = 'pending' AND outcome_id = 'o1' THEN 'claimed' WHEN status = 'pending' AND outcome_id = 'o2' THEN 'resolved' ELSE status END AS status, CASE WHEN status = 'pending' AND outcome_id = 'o2' THEN 'confirm' END AS resolution, count(*) AS count FROM outcomes GROUP BY 1, 2")
named("ctl_share_list", lambda s, d: K.share_list(s, d.select(F.col("owner_id").alias("user_id")).distinct()).select("dataset_id", "user_id", "created_at"), ["shares", "datasets"], "SELECT dataset_id, user_id, created_at FROM shares WHERE user_id IN (SELECT owner_id FROM datasets)")

query("doc_sample", lambda t: document_sample(t("documents"), "text").select("doc_id", F.md5("sample").alias("sample_md5")), "SELECT doc_id, md5(left(text, 4000)) AS sample_md5 FROM documents")
query("doc_locate_bytes", lambda t: X.locate(pages(t("documents"), "doc_id", "text"), F.lit("des")).select("doc_id", "page_idx", "char_start", "char_end"), r"""
    WITH p AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS page_idx, unnest(string_split(text, chr(10))) AS text FROM documents),
    h AS (SELECT doc_id, page_idx, CAST(strlen(left(text, instr(text, 'des') - 1)) AS INT) AS s FROM p WHERE instr(text, 'des') > 0)
    SELECT doc_id, min(page_idx) AS page_idx, arg_min(s, page_idx) AS char_start, CAST(arg_min(s, page_idx) + 3 AS INT) AS char_end FROM h GROUP BY 1""")
query("doc_excerpt", lambda t: t("conversations").select("conv_id", "turn", X.excerpt(F.col("text"), F.lit(0), F.lit(10)).alias("excerpt")).where(F.col("excerpt").rlike(r"\A[ -~]*\z")), "SELECT conv_id, turn, excerpt FROM (SELECT conv_id, turn, CASE WHEN strlen(text) >= 10 THEN left(text, 10) ELSE text END AS excerpt FROM conversations) WHERE regexp_full_match(excerpt, '[ -~]*')")
query("doc_leak_terms", lambda t: t("documents").select("doc_id", F.array_join(X.leaked_terms(F.col("text"), ["the", "des", "license"]), ",").alias("terms")), r"""
    SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])the($|[^\pL\pN_])') THEN 'the' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])des($|[^\pL\pN_])') THEN 'des' END,
           CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])license($|[^\pL\pN_])') THEN 'license' END) AS terms FROM documents""")
query("doc_bracket_terms", lambda t: t("part").select("p_partkey", F.array_join(X.bracketed_terms(F.concat(F.lit("x [ "), "p_brand", F.lit(" ] y [] z ["), "p_type", F.lit("]"))), "|").alias("terms")), "SELECT p_partkey, trim(p_brand) || '|' || trim(p_type) AS terms FROM part")
query("doc_valid_definition", lambda t: t("documents").select("doc_id", X.valid_definition(F.col("text")).alias("valid")), r"SELECT doc_id, length(trim(text)) > 0 AND strlen(text) <= 2000 AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AS valid FROM documents")
named("doc_review_queue", lambda o: K.review_queue(o, o.select("goal_id").distinct().withColumn("review_threshold", F.when(F.col("goal_id") == "g3", F.lit(0.2)))).select("outcome_id"), ["outcomes"], "SELECT outcome_id FROM outcomes WHERE confidence < CASE WHEN goal_id = 'g3' THEN 0.2 ELSE 0.8 END")

query("evt_latest_per_type", lambda t: rounded(K.latest_per_type(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")), f"SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, {r6('arg_max(value, ts)')} AS value FROM events GROUP BY 1, 2")
query("evt_ring_256", lambda t: K.ring(t("events"), "event_type", ["ts"], 256).select("event_id", "event_type"), "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) <= 256")

query("ctl_earliest_admin", lambda t: K.earliest_admin(t("customer").selectExpr("c_custkey AS user_id", "CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'member' END AS role", "c_nationkey AS created_at")).select("user_id"), "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 7 = 0 ORDER BY c_nationkey, c_custkey LIMIT 1")
named("ctl_orphaned_runs", lambda r: K.orphaned_runs(r.withColumn("status", F.when(F.col("status") == "click", "running").otherwise(F.col("status"))).withColumn("failure_reason", F.lit(None).cast("string")), "restarted").groupBy("status", "failure_reason").count(), ["runs"], "SELECT CASE WHEN status = 'click' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'click' THEN 'restarted' END AS failure_reason, count(*) AS count FROM runs GROUP BY 1, 2")
named("ctl_running_first_top", lambda r: K.running_first(r.select("started_at", F.when(F.col("status") == "click", "running").otherwise("done").alias("status"), F.col("started_at").alias("created_at"), "goal_id")).select("goal_id", "status").limit(30), ["runs"], "SELECT goal_id, CASE WHEN status = 'click' THEN 'running' ELSE 'done' END AS status FROM runs ORDER BY status = 'click' DESC, started_at DESC LIMIT 30")
query("doc_pages", lambda t: pages(t("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("page_idx").cast("long").alias("last_page")), "SELECT doc_id, len(string_split(text, chr(10))) AS pages, len(string_split(text, chr(10))) - 1 AS last_page FROM documents")
