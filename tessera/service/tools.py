"""Tools for agents over JSON-RPC: search of heuristics, tracing of their evidence, submission of goals and verification of findings."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import vectors as V
from tessera.plans.errors import RequestError, RequestShape
from tessera.plans.interfaces import Embedder

# Names of the tools, and what is said of an effect that was inferred.
SEARCH, TRACE, SUBMIT, VERIFY = "get_optimized_heuristics", "trace_causal_chain", "submit_analyst_goal", "verify_finding"
PROTOCOL = "2025-06-18"
CAVEAT = "inferred from observational data under the discovered causal graph"
TEXT = {"type": "string"}
TOOLS = {
    SEARCH: ("Heuristics most relevant to a description of a state, nearest first.", {"operational_state": TEXT, "k": {"type": "integer"}, "goal_id": TEXT}, ["operational_state"]),
    TRACE: ("The triplets that support a heuristic.", {"meta_heuristic_id": TEXT}, ["meta_heuristic_id"]),
    SUBMIT: ("Registers a goal over a data source.", {"goal": TEXT, "import_path": TEXT}, ["goal", "import_path"]),
    VERIFY: ("Asks for the verification of a finding; the result comes later.", {"goal_id": TEXT, "finding_id": TEXT}, ["goal_id", "finding_id"]),
}


class Tools:
    """tables: vectors (node_id, goal_id, embedding), goals, heuristics (node_id, definition, stale), evidence and edges."""

    def __init__(self, tables: dict[str, DataFrame], embed: Embedder, submit: Callable[[str, str], str], verify: Callable[[str, str], str], floor: float = V.DISTANCE_FLOOR):
        self.tables, self.embed, self.submit, self.verify, self.floor = tables, embed, submit, verify, floor

    def call(self, name: str, given: dict[str, Any]) -> dict[str, Any]:
        if name not in TOOLS:
            raise RequestShape(f"no tool {name}")
        for field in TOOLS[name][2]:
            if not str(given.get(field) or "").strip():
                raise RequestShape(f"{field} must not be empty")
        t = self.tables
        if name == SEARCH:
            vector = self.embed([given["operational_state"].strip()])[0]
            scope = V.in_scope(t["vectors"], t["goals"], goal=str(given.get("goal_id") or "").strip() or None)
            hits = V.hydrate(V.nearest(scope, vector, given.get("k"), self.floor), t["heuristics"]).withColumnRenamed("node_id", "heuristic_id")
            labelled = G.labelled_matches(hits, G.strongest_evidence(t["evidence"], t["edges"])).orderBy("distance", "heuristic_id")
            return {"heuristics": [self.match(r) for r in labelled.collect()]}  # at most MAX_K
        if name == TRACE:
            rows = self.traced(given["meta_heuristic_id"]).orderBy("intervention_id", "outcome_id", "state_id", "epistemic_source")
            return {"triplets": [{k: v for k, v in r.asDict().items() if k != "caveat" or v} for r in rows.toLocalIterator()]}  # the message holds one heuristic's evidence
        if name == SUBMIT:
            return {"optimization_function_id": self.submit(given["goal"], given["import_path"])}
        detail = self.verify(given["goal_id"], given["finding_id"])
        return {"dispatched": detail in ("accepted", "coalesced"), "detail": detail}

    def traced(self, heuristic: str) -> DataFrame:
        """The triplets that the tool tells of, as a table, for heuristics whose evidence no message holds; caveat: null if there is none."""
        own = self.tables["evidence"].where(F.col("heuristic_id") == heuristic).select("node_id").distinct()
        edges = self.tables["edges"].select("state_id", "intervention_id", "outcome_id", F.coalesce("epistemic_source", F.lit(G.OBSERVATIONAL)).alias("epistemic_source")).distinct()
        touched = [edges.join(own.withColumnRenamed("node_id", c), c, "left_semi").select(*edges.columns) for c in ("state_id", "intervention_id", "outcome_id")]
        return reduce(DataFrame.unionByName, touched).distinct().withColumn("caveat", F.when(F.col("epistemic_source") == G.CAUSAL, CAVEAT))

    @staticmethod
    def match(r) -> dict[str, Any]:
        out = {"id": r.heuristic_id, "definition": r.definition, "epistemic_source": r.epistemic_source}
        return out | ({"refutation_confidence": r.confidence, "caveat": CAVEAT} if r.epistemic_source == G.CAUSAL else {})

    def answer(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The reply to a JSON-RPC message; None to a notification. Only the engine's own refusals are told, other failures are masked."""
        if "id" not in message:
            return None
        reply = lambda **x: {"jsonrpc": "2.0", "id": message["id"], **x}
        given = message.get("params") or {}
        match message.get("method"):
            case "initialize":
                return reply(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}})
            case "tools/list":
                return reply(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]})
            case "tools/call":
                try:
                    found, failed = json.dumps(self.call(given.get("name", ""), given.get("arguments") or {})), False
                except RequestError as error:
                    found, failed = str(error), True
                except Exception:
                    found, failed = "internal error", True
                return reply(result={"content": [{"type": "text", "text": found}], "isError": failed})
        return reply(error={"code": -32601, "message": f"no method {message.get('method')}"})
