"""The findings graph as DataFrames.

edges of triplets: (state_id, intervention_id, outcome_id, effect_size, confidence, epistemic_source, superseded, graph_version);
interventions and outcomes carry their own attributes; evidence: (heuristic_id, node_id). Every query is equi-joins and
aggregations on ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.errors import RequestShape, UnknownField
from tessera.plans.model import EQUALITY_OPS, MEMBER_OPS, THRESHOLD_OPS

# Fixed values
EDGE = ("goal", "ref", "version", "col_a", "col_b", "direction", "provenance", "confidence", "status")
DIRECTIONS = ("a_to_b", "b_to_a", "undirected")
OBSERVATIONAL, CAUSAL = "observational", "causal_inferred"
ELIGIBLE_STATUS = ("verified", "confirmed", "corrected")
FILTERS = "array<struct<field: string, op: string, value: string>>"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_known: list[str] = (), untouched: list[str] = ()) -> DataFrame:
    """new over old by key. keep_known: a blank or null new value keeps the old one; untouched: an old row's value stays."""
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("had"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("has"))

    def pick(c: str) -> Column:
        fresh = F.col(f"new_{c}")
        if c in untouched:
            return F.when(F.col("had"), F.col(f"old_{c}")).otherwise(fresh)
        if c in keep_known:
            is_text = dict(new.dtypes)[c] == "string"
            return F.coalesce(F.nullif(fresh, F.lit("")) if is_text else fresh, F.col(f"old_{c}"))
        return F.when(F.col("has"), fresh).otherwise(F.col(f"old_{c}"))

    return a.join(b, keys, "full").select(*keys, *[pick(c).alias(c) for c in columns])


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def eligible_findings(edges: DataFrame, interventions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Findings a search may build on: not derived by a search, accepted, observational (as null is)."""
    found = edges.where(F.coalesce("epistemic_source", F.lit(OBSERVATIONAL)) == OBSERVATIONAL)
    found = found.join(interventions.where(~F.coalesce("sleep_derived", F.lit(False))), "intervention_id")
    return found.join(outcomes.where(F.col("status").isin(*ELIGIBLE_STATUS)), "outcome_id")


def stale_heuristics(evidence: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(heuristic_id, stale): stale if any outcome it rests on was rejected."""
    rows = evidence.join(outcomes.select(F.col("outcome_id").alias("node_id"), "status"), "node_id", "left")
    return rows.groupBy("heuristic_id").agg((F.sum(F.when(F.col("status") == "rejected", 1).otherwise(0)) > 0).alias("stale"))


def trace(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Triplets that a heuristic's evidence touches at any of their three nodes, once each."""
    evidence = evidence.distinct()
    parts = [evidence.join(edges, evidence["node_id"] == edges[c]).select("heuristic_id", "state_id", "intervention_id", "outcome_id") for c in ("state_id", "intervention_id", "outcome_id")]
    return reduce(DataFrame.unionByName, parts).distinct()


def live_causal(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("epistemic_source") == CAUSAL) & ~F.coalesce("superseded", F.lit(False)))


def strongest_evidence(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(heuristic_id, intervention_id, confidence): of its live causal edges the one of most confidence."""
    rows = evidence.withColumnRenamed("node_id", "intervention_id").join(live_causal(edges), "intervention_id")
    return rows.groupBy("heuristic_id").agg(F.max(F.struct("confidence", "intervention_id")).alias("m")).select("heuristic_id", "m.intervention_id", "m.confidence")


def newest_evidence(edges: DataFrame) -> DataFrame:
    """(intervention_id, graph_version, confidence): the latest version wins."""
    return live_causal(edges).groupBy("intervention_id").agg(F.max(F.struct("graph_version", "confidence")).alias("m")).select("intervention_id", "m.*")


def supersede(edges: DataFrame, intervention: str, version: int, confirmed: bool) -> DataFrame:
    """Marks an intervention's older causal edges; a non-confirmation marks its own version too."""
    older = F.col("graph_version") < version if confirmed else F.col("graph_version") <= version
    hit = (F.col("intervention_id") == intervention) & (F.col("epistemic_source") == CAUSAL) & older
    return edges.withColumn("superseded", F.when(hit, True).otherwise(F.col("superseded")))


def latest_graph(meta: DataFrame, causal_edges: DataFrame) -> DataFrame:
    """Edges at exactly the newest committed version of each goal and source."""
    newest = meta.groupBy("goal", "ref").agg(F.max("version").alias("version"))
    return causal_edges.join(newest, ["goal", "ref", "version"], "left_semi")


def correct_edge(meta: DataFrame, columns: DataFrame, causal_edges: DataFrame, goal: str, ref: str, action: str, source: str, target: str, direction: str = "") -> DataFrame:
    """The next version of a goal's graph over one source, with one edge flipped, deleted or added by an analyst.

    Rows (goal, ref, version, col_a, col_b, direction, provenance, confidence, status): the edges of the newest committed version,
    each with its own provenance, and the corrected one as the analyst's at full confidence. `flip` and `add` say that source causes
    target, unless a direction of the ordered pair is given; an add of a pair that has an edge re-orients that edge. Names may differ
    in case from the graph's columns (goal, ref, name); unknown ones, and a flip or delete of no edge, are errors.
    """
    if action not in ("flip", "delete", "add"):
        raise RequestShape(f"no correction {action!r}")
    if direction not in ("", *DIRECTIONS):
        raise RequestShape(f"no direction {direction!r}")
    if source.lower() == target.lower():
        raise RequestShape("a column is no cause of itself")
    here = (F.col("goal") == goal) & (F.col("ref") == ref)
    version = meta.where(here).agg(F.max("version")).first()[0]
    if version is None:
        raise UnknownField(f"no graph of {goal} over {ref}")
    known = {r.name.lower(): r.name for r in columns.where(here & F.lower("name").isin(source.lower(), target.lower())).select("name").collect()}  # two columns
    if lacking := [n for n in (source, target) if n.lower() not in known]:
        raise UnknownField(lacking[0])
    cause, effect = known[source.lower()], known[target.lower()]
    a, b = min(cause, effect), max(cause, effect)
    way = direction or ("a_to_b" if cause == a else "b_to_a")
    current = causal_edges.where(here & (F.col("version") == version)).select(*EDGE).withColumn("version", (F.col("version") + 1).cast(dict(causal_edges.dtypes)["version"]))
    hit = (F.col("col_a") == a) & (F.col("col_b") == b)
    matched = not current.where(hit).isEmpty()
    if not matched and action != "add":
        raise UnknownField(f"no edge between {cause} and {effect}")
    mine = {"direction": F.lit(way), "provenance": F.lit("analyst"), "confidence": F.lit(1.0), "status": F.lit("tested")}
    kept = current.where(~hit)
    if action == "delete":
        return kept
    if matched:
        return kept.unionByName(current.where(hit).withColumns(mine).select(*EDGE))
    own = {"goal": F.lit(goal), "ref": F.lit(ref), "version": F.lit(version + 1).cast(dict(causal_edges.dtypes)["version"]), "col_a": F.lit(a), "col_b": F.lit(b)}
    return kept.unionByName(causal_edges.sparkSession.range(1).select(*[c.alias(n) for n, c in (own | mine).items()]).select(*EDGE))


def unresolved_ids(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, found): asked ids that resolve to no node or to several."""
    have = nodes.groupBy("node_id").agg(F.count("*").alias("found"))
    return asked.distinct().join(have, "node_id", "left").select("node_id", F.coalesce("found", F.lit(0)).alias("found")).where("found <> 1")


def source_conjunctions(interventions: DataFrame) -> DataFrame:
    """Decoded new_filters, without those that do not parse or are empty."""
    return interventions.withColumn("filters", F.from_json("new_filters", FILTERS)).where("filters is not null and size(filters) > 0")


def without_goal(df: DataFrame, goal: str, column: str = "goal_id") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(goal)))


def delete_goal(nodes: DataFrame, edges: DataFrame, goal: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without a goal's nodes and every edge that touches one. nodes: (node_id, goal_id, ...); edges: (state_id, ...)."""
    kept = without_goal(nodes, goal)
    return kept, detached(edges, nodes.where(F.col("goal_id") == goal))


def delete_node(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without one node and its edges; an unknown id changes nothing."""
    return nodes.where(~F.col("node_id").eqNullSafe(F.lit(node))), detached(edges, nodes.where(F.col("node_id") == node))


def wiped(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The empty tables that a wipe leaves, of unchanged columns."""
    return tuple(t.where("false") for t in tables)


def detached(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for c in ("state_id", "intervention_id", "outcome_id"):
        edges = edges.join(gone.select(F.col("node_id").alias(c)).distinct(), c, "left_anti")
    return edges


def is_observational() -> Column:
    return F.coalesce(F.col("epistemic_source"), F.lit(OBSERVATIONAL)) == OBSERVATIONAL


def resolve_outcome(outcomes: DataFrame, edges: DataFrame, outcome: str, status: str, confidence: float, value: float | None = None, provenance: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, edges) after a person resolved an outcome: its status and, corrected, its value and provenance, and its edge's confidence.

    Only an outcome with an observational inbound edge is resolved, and only such edges get the confidence; a causal finding about
    the same outcome stays as it is.
    """
    hit = edges.where((F.col("outcome_id") == outcome) & is_observational()).select("outcome_id").distinct()
    marked = outcomes.join(F.broadcast(hit.withColumn("resolved", F.lit(True))), "outcome_id", "left")  # one id
    own = {"status": F.lit(status)}
    if value is not None:
        own["value"] = F.lit(value)
        if "provenance" in outcomes.columns:
            own["provenance"] = F.lit(provenance)
    out = marked.withColumns({c: F.when(F.col("resolved"), v.cast(dict(outcomes.dtypes)[c])).otherwise(F.col(c)) for c, v in own.items()})
    touched = (F.col("outcome_id") == outcome) & is_observational()
    return out.select(*outcomes.columns), edges.withColumn("confidence", F.when(touched, F.lit(confidence)).otherwise(F.col("confidence")))


def extraction_outcomes(edges: DataFrame, interventions: DataFrame, goal: str) -> DataFrame:
    """A goal's extracted outcomes with their intervention and the confidence of the observational edge between them."""
    own = interventions.where((F.col("type") == "extract") & (F.col("goal_id") == goal)).select("intervention_id")
    return edges.where(is_observational()).join(own, "intervention_id").select("outcome_id", "intervention_id", "confidence")


def create_heuristic(heuristic: str, evidence: list[str], nodes: DataFrame) -> DataFrame:
    """Its evidence rows (heuristic_id, node_id); an id that resolves to no node or to several is an error, so none is abstracted from incomplete evidence."""
    asked = nodes.sparkSession.createDataFrame([(heuristic, n) for n in dict.fromkeys(evidence)], "heuristic_id string, node_id string")
    missing = sorted(r.node_id for r in unresolved_ids(asked.select("node_id"), nodes).collect())  # at most the asked ids
    if missing:
        raise UnknownField(", ".join(missing))
    return asked


def labelled_matches(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Matches with how they are known: causal with a confidence, or observational."""
    rows = matches.join(evidence.select("heuristic_id", "confidence"), "heuristic_id", "left")
    return rows.withColumn("epistemic_source", F.when(F.col("confidence").isNull(), OBSERVATIONAL).otherwise(CAUSAL))


def segment_label(filters: Column) -> Column:
    """Encoded filters as a person reads them: `field = value` joined by AND; what does not parse is an empty segment."""
    signs = F.create_map(*[F.lit(x) for pair in (THRESHOLD_OPS | EQUALITY_OPS | MEMBER_OPS).items() for x in pair])
    plain = lambda v: F.regexp_replace(v, r"^(-?[0-9]+)\.0$", "$1")

    def text(f: Column) -> Column:
        members = F.concat(F.lit("{"), F.array_join(F.transform(F.from_json(f["value"], "array<string>"), plain), ", "), F.lit("}"))
        return F.concat_ws(" ", f["field"], F.coalesce(signs[f["op"]], f["op"]), F.when(f["op"].isin(*MEMBER_OPS), members).otherwise(plain(f["value"])))

    return F.coalesce(F.array_join(F.transform(F.from_json(filters, FILTERS), text), " AND "), F.lit(""))


def with_segments(records: DataFrame, interventions: DataFrame) -> DataFrame:
    """Verification records with their intervention's effective filters; an unknown one has an empty segment."""
    own = interventions.select("intervention_id", segment_label(F.col("effective_filters")).alias("segment"))
    return records.join(own, "intervention_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))
