"""What a model may be asked for. Each has a deterministic stand-in that needs no model, so every run can be repeated."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from typing import Protocol

from tessera.plans.errors import RequestShape
from tessera.plans.model import Constraint


class Proposer(Protocol):
    """Predicates to add to a segment; attempt counts from 0, as an expansion without rows is asked once more."""

    def __call__(self, segment: tuple[Constraint, ...], attempt: int) -> list[Constraint]: ...


class Critic(Protocol):
    """(columns worth searching, the best first; columns to leave out) of a schema's columns."""

    def __call__(self, columns: Sequence[str], objective: str) -> tuple[list[str], list[str]]: ...


class Embedder(Protocol):
    """A vector of each text."""

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class OrientationPrior(Protocol):
    """For open edges the direction (cause, effect), or None to abstain."""

    def __call__(self, edges: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[str, str] | None]: ...


def silent_critic(columns: Sequence[str], objective: str) -> tuple[list[str], list[str]]:
    """No opinion."""
    return [], []


def abstaining_prior(edges: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[str, str] | None]:
    return dict.fromkeys(edges)


class HashedEmbedder:
    """Unit vectors from hashed words: texts that share words are near each other."""

    def __init__(self, dimension: int = 768):
        if dimension < 1:
            raise RequestShape(f"dimension {dimension}")
        self.dimension = dimension

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[(h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length for x in out] if length else out
