"""Keys of segments and the ids derived from them: equal for equal sets of predicates, whatever their order, case or repeats."""

from __future__ import annotations

import hashlib
import json
import uuid

from tessera.plans.model import MEMBER_OPS, Constraint, scalar_wire

SEPARATOR = "\x1f"


def component(c: Constraint) -> str:
    values = [scalar_wire(v) for v in c.members]
    if c.op in MEMBER_OPS:
        values = sorted({json.dumps(v, sort_keys=True): v for v in values}.items())
        values = [v for _, v in values]
    return json.dumps({"field": c.field.lower(), "op": c.op, "values": values}, sort_keys=True, separators=(",", ":"))


def key(constraints) -> str:
    return SEPARATOR.join(sorted({component(c) for c in constraints}))


def components(canonical: str) -> list[str]:
    return canonical.split(SEPARATOR) if canonical else []


def namespace(goal: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_OID, goal)


def derived_id(goal: str, role: str, canonical: str = "") -> str:
    return str(uuid.uuid5(namespace(goal), f"{role}|{canonical}"))


def baseline_state_id(goal: str) -> str:
    return derived_id(goal, "baseline_state")


def causal_id(*parts: str) -> str:
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()


def finding_seed(intervention: str) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in intervention.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h
