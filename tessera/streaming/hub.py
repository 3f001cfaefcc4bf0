"""The event hub of a driver: frames of a goal for its subscribers, with a ring that late ones replay."""

from __future__ import annotations

import queue
from collections import defaultdict, deque

RING, BACKLOG = 256, 64
#: Kinds of which only the newest frame is kept.
COALESCED = frozenset({"histogram"})


class Hub:
    def __init__(self, size: int = RING, coalesced: frozenset[str] = COALESCED):
        self.coalesced = coalesced
        self.rings: dict[str, deque] = defaultdict(lambda: deque(maxlen=size))
        self.subscribers: dict[str, list[queue.Queue]] = defaultdict(list)

    def publish(self, goal: str, kind: str, body) -> None:
        ring = self.rings[goal]
        at = next((i for i, (k, _) in enumerate(ring) if k == kind), None) if kind in self.coalesced else None
        if at is None:
            ring.append((kind, body))
        else:
            ring[at] = (kind, body)
        for q in self.subscribers[goal]:
            try:
                q.put_nowait((kind, body))
            except queue.Full:  # a slow subscriber loses frames
                pass

    def subscribe(self, goal: str, backlog: int = BACKLOG) -> tuple[list, queue.Queue]:
        """The frames so far and a queue of those to come."""
        q: queue.Queue = queue.Queue(backlog)
        self.subscribers[goal].append(q)
        return list(self.rings[goal]), q

    def unsubscribe(self, goal: str, q: queue.Queue) -> None:
        self.subscribers[goal].remove(q)
