"""Control-plane queries: datasets, goals, runs, verification queue and audit log as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
CONFIDENCE_BINS, REVIEW_THRESHOLD, DEFAULT_BUDGET, LEASE_SECONDS = 10, 0.8, 10, 90


def dataset_counts(datasets: DataFrame, goals: DataFrame) -> DataFrame:
    """Datasets with their number of objectives, 0 included."""
    n = goals.groupBy("dataset_id").agg(F.count("goal_id").alias("objectives"))
    return datasets.join(n, "dataset_id", "left").withColumn("objectives", F.coalesce("objectives", F.lit(0)))


def accessible(datasets: DataFrame, shares: DataFrame, user: str) -> DataFrame:
    """Datasets that a user owns or that are shared with the user."""
    shared = shares.where(F.col("user_id") == user).select("dataset_id").distinct().withColumn("shared", F.lit(True))
    return datasets.join(shared, "dataset_id", "left").where((F.col("owner_id") == user) | F.col("shared").isNotNull()).drop("shared")


def visible_goals(goals: DataFrame, datasets: DataFrame, shares: DataFrame, user: str) -> DataFrame:
    return goals.join(accessible(datasets, shares, user).select("dataset_id"), "dataset_id", "left_semi")


def share_list(shares: DataFrame, users: DataFrame) -> DataFrame:
    return shares.join(users, "user_id").orderBy("created_at", "user_id")


def latest_per(df: DataFrame, by: str, time: str) -> DataFrame:
    """The newest row of each key, found with one aggregation and no sort."""
    rest = [c for c in df.columns if c not in (by, time)]
    return df.groupBy(by).agg(F.max(F.struct(time, *rest)).alias("m")).select(by, "m.*")


def goals_with_runs(goals: DataFrame, runs: DataFrame) -> DataFrame:
    """Goals with the status of their latest run, or `no run`."""
    last = latest_per(runs, "goal_id", "started_at").select("goal_id", "status")
    return goals.join(last, "goal_id", "left").withColumn("status", F.coalesce("status", F.lit("no run")))


def inventory(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.col("last_accessed_at").desc_nulls_last(), F.col("created_at").desc(), "dataset_id")


def running_first(objectives: DataFrame) -> DataFrame:
    return objectives.orderBy((F.col("status") == "running").desc(), F.col("created_at").desc())


def newest_first(df: DataFrame, time: str = "created_at") -> DataFrame:
    return df.orderBy(F.col(time).desc())


def earliest_admin(users: DataFrame) -> DataFrame:
    return users.where("role = 'admin'").orderBy("created_at", "user_id").limit(1)


def name_matches(df: DataFrame, query: str, column: str = "name") -> DataFrame:
    return df.where(F.instr(F.lower(F.col(column)), query.lower()) > 0)


def auto_name(ref: Column) -> Column:
    """The reference's base name, lower case, other characters as _, and six digits of its MD5."""
    base = F.element_at(F.split(ref, "/"), -1)
    return F.concat(F.lower(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_")), F.lit("-"), F.substring(F.md5(ref), 1, 6))


def resolve_queue(queue: DataFrame, outcome: str, resolution: str) -> DataFrame:
    """Resolves a pending entry; other entries stay."""
    hit = (F.col("outcome_id") == outcome) & (F.col("status") == "pending")
    return queue.withColumn("resolution", F.when(hit, resolution).otherwise(F.col("resolution"))).withColumn("status", F.when(hit, "resolved").otherwise(F.col("status")))


def claim_queue(queue: DataFrame, outcome: str, claim: bool = True) -> DataFrame:
    was, now = ("pending", "claimed") if claim else ("claimed", "pending")
    hit = (F.col("outcome_id") == outcome) & (F.col("status") == was)
    return queue.withColumn("status", F.when(hit, now).otherwise(F.col("status")))


def reap(verifications: DataFrame, now) -> DataFrame:
    """Pending verifications whose lease has run out have failed."""
    late = (F.col("status") == "pending") & (F.col("lease_deadline") < F.lit(now))
    return verifications.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def orphaned_runs(runs: DataFrame, reason: str) -> DataFrame:
    hit = F.col("status") == "running"
    return runs.withColumn("failure_reason", F.when(hit, reason).otherwise(F.col("failure_reason"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def budget_used(verifications: DataFrame, goals: DataFrame, default: int = DEFAULT_BUDGET) -> DataFrame:
    """(goal_id, used, budget, left): budgeted verifications that did not fail against the goal's budget or the default."""
    used = verifications.where(F.col("budgeted") & (F.col("status") != "failed")).groupBy("goal_id").agg(F.count("*").alias("used"))
    out = goals.select("goal_id", F.coalesce("budget", F.lit(default)).alias("budget")).join(used, "goal_id", "left")
    return out.select("goal_id", F.coalesce("used", F.lit(0)).alias("used"), "budget", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("left"))


def dispatch_decision(in_flight: int, cap: int, budgeted: bool, used: int, budget: int, pending_same: bool) -> str:
    """What happens to a verification request after expired leases are reaped: coalesce, wait, refuse, or accept."""
    if pending_same:
        return "coalesced"
    if in_flight >= (cap - 1 if budgeted else cap):
        return "at_capacity"
    return "over_budget" if budgeted and used >= budget else "accepted"


def renew(verifications: DataFrame, holder: Column, now, seconds: int = LEASE_SECONDS) -> DataFrame:
    """A heartbeat: the pending verifications that holder selects, and whose lease has not run out, get a lease from now on."""
    alive = holder & (F.col("status") == "pending") & (F.col("lease_deadline") >= F.lit(now))
    fresh = F.lit(now).cast("timestamp_ntz") + F.expr(f"interval {int(seconds)} seconds")
    return verifications.withColumn("lease_deadline", F.when(alive, fresh).otherwise(F.col("lease_deadline")))


def dispatch(verifications: DataFrame, goals: DataFrame, goal, intervention, version: int, now, cap: int, budgeted: bool, default: int = DEFAULT_BUDGET, seconds: int = LEASE_SECONDS) -> tuple[str, DataFrame]:
    """(decision, verifications afterwards) of one request, as one transaction over the table.

    Expired leases are reaped first. A request that is pending already is coalesced; then the cap on pending ones counts, of which
    one is kept free of budgeted requests; then the goal's budget. An accepted one is pending under a fresh lease: it replaces the row
    of its key (goal_id, intervention_id, graph_version), or is added.
    """
    reaped = reap(verifications, now)
    mine = (F.col("goal_id") == goal) & (F.col("intervention_id") == intervention) & (F.col("graph_version") == version)
    spent = (F.col("goal_id") == goal) & F.col("budgeted") & (F.col("status") != "failed")
    pending = F.col("status") == "pending"
    row = reaped.agg(F.count(F.when(mine & pending, 1)).alias("same"), F.count(F.when(pending, 1)).alias("flying"), F.count(F.when(spent, 1)).alias("used")).first()
    own = goals.where(F.col("goal_id") == goal).agg(F.max("budget")).first()[0]
    decision = dispatch_decision(row.flying, cap, budgeted, row.used, default if own is None else own, row.same > 0)
    if decision != "accepted":
        return decision, reaped
    kinds = dict(verifications.dtypes)
    fresh = {"goal_id": F.lit(goal), "intervention_id": F.lit(intervention), "graph_version": F.lit(version), "budgeted": F.lit(budgeted), "status": F.lit("pending"), "lease_deadline": F.lit(now).cast("timestamp_ntz") + F.expr(f"interval {int(seconds)} seconds")}
    added = verifications.sparkSession.range(1).select(*[fresh.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in verifications.columns])
    return decision, reaped.where(~mine).unionByName(added)


def stale_by_columns(verifications: DataFrame, columns: list[str]) -> DataFrame:
    """Interventions whose adjustment set has one of the columns, once each, in order."""
    return verifications.where(F.arrays_overlap("adjustment_set", F.array(*map(F.lit, columns)))).select("intervention_id").distinct().orderBy("intervention_id")


def ref_usage(ref: str, goals: DataFrame, datasets: DataFrame) -> DataFrame:
    a = goals.where(F.col("ref") == ref).agg(F.count("*").alias("goals"))
    b = datasets.where(F.col("ref") == ref).agg(F.count("*").alias("datasets"))
    return a.join(F.broadcast(b))  # one row each


def deletable(goals: DataFrame, runs: DataFrame, verifications: DataFrame) -> DataFrame:
    """Goals without a running run or a pending verification."""
    busy = runs.where("status = 'running'").select("goal_id").unionByName(verifications.where("status = 'pending'").select("goal_id"))
    return goals.join(busy, "goal_id", "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in sorted(tables.items())])


def reset(tables: dict[str, DataFrame], kept: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The tables after a reset: those named are kept, the others are empty, and all have their columns."""
    names = set(kept)
    return {n: t if n in names else t.where("false") for n, t in tables.items()}


def append_audit(df: DataFrame, path: str, actor: str, action: str) -> None:
    """Insert-only: each row of df becomes a JSON detail."""
    df.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.to_json(F.struct("*")).alias("detail")).write.mode("append").parquet(path)


def confidence_bin(confidence: Column, bins: int = CONFIDENCE_BINS) -> Column:
    return F.least(F.greatest(F.floor(confidence * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def confidence_histogram(outcomes: DataFrame, column: str = "confidence") -> DataFrame:
    return outcomes.groupBy(confidence_bin(F.col(column)).alias("bin")).agg(F.count("*").alias("n"))


def bar_heights(histogram: DataFrame) -> DataFrame:
    """Bars as a share of the highest, to 88, at least 3."""
    most = histogram.agg(F.max("n").alias("most"))
    return histogram.join(F.broadcast(most)).select("bin", F.greatest(F.col("n") / F.col("most") * 88, F.lit(3.0)).alias("height"))


def review_queue(outcomes: DataFrame, goals: DataFrame, default: float = REVIEW_THRESHOLD) -> DataFrame:
    """Outcomes below their goal's threshold, or the default."""
    own = goals.select("goal_id", "review_threshold")
    return outcomes.join(own, "goal_id", "left").where(F.col("confidence") < F.coalesce("review_threshold", F.lit(default))).drop("review_threshold")


def latest_per_type(events: DataFrame, by: list[str], time: str) -> DataFrame:
    rest = [c for c in events.columns if c not in (*by, time)]
    return events.groupBy(*by).agg(F.max(F.struct(time, *rest)).alias("m")).select(*by, "m.*")


def ring(events: DataFrame, by: str, order: list[str], size: int = 256) -> DataFrame:
    """The newest `size` events of each key."""
    w = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def resolution(status: str | None, verdict: str, stored: str | None = None) -> tuple[str, str]:
    """(action, verdict) for an analyst's verdict on an outcome: resolve, insert, repair or conflict."""
    if status is None:
        return "insert_resolved", verdict
    if status in ("pending", "claimed"):
        return "resolve", verdict
    return ("repair", verdict) if stored == verdict else ("conflict", stored or "")


def resolved_confidence(verdict: str, rejected: float = 0.0) -> float:
    return rejected if verdict == "reject" else 1.0


def resolve_outcomes(queue: DataFrame, outcomes: DataFrame, edges: DataFrame, outcome: str, verdict: str, value: float | None = None, rejected: float = 0.0) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """(action, queue, outcomes, edges) after an analyst's verdict on an outcome: confirm, correct or reject.

    An entry that is open is resolved, and an outcome that was never queued gets a resolved entry. One that was resolved by
    the same verdict is repaired: outcome and edge are written again from the stored verdict. One resolved otherwise is a conflict, and
    nothing changes.
    """
    from tessera.operators.graph import resolve_outcome

    found = queue.where(F.col("outcome_id") == outcome).agg(F.max("status").alias("status"), F.max("resolution").alias("resolution")).first()
    action, stored = resolution(found.status, verdict, found.resolution)
    if action == "conflict":
        return action, queue, outcomes, edges
    if action == "resolve":
        queue = queue.withColumns({"resolution": F.when(F.col("outcome_id") == outcome, verdict).otherwise(F.col("resolution")), "status": F.when(F.col("outcome_id") == outcome, "resolved").otherwise(F.col("status"))})
    elif action == "insert_resolved":
        own = {"outcome_id": F.lit(outcome), "status": F.lit("resolved"), "resolution": F.lit(verdict)}
        queue = queue.unionByName(queue.sparkSession.range(1).select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in queue.dtypes]))
    status = {"confirm": "confirmed", "correct": "corrected", "reject": "rejected"}[stored]
    outcomes, edges = resolve_outcome(outcomes, edges, outcome, status, resolved_confidence(stored, rejected), value if stored == "correct" else None)
    return action, queue, outcomes, edges
