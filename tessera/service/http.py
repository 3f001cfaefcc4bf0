"""Requests over HTTP and event streams, on the standard library.

POST /introspect, /execute and /analyze take the request surface's dictionaries with a `data_source_ref`; GET /goals/ID/stream is a
server-sent event stream. A request that the engine refuses is a 400 with its message; any other failure is a masked 500.
"""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame

from tessera.plans import api
from tessera.plans.errors import RequestError, RequestShape
from tessera.streaming.hub import Hub

# Fixed values
KEEPALIVE_SECONDS, MAX_BODY, AT_ONCE = 30.0, 1 << 20, 8
KEEPALIVE = b": keepalive\n\n"


def frames(hub: Hub, goal: str, keepalive: float = KEEPALIVE_SECONDS, stop: Callable[[], bool] = lambda: False) -> Iterator[bytes]:
    """A goal's events as server-sent frames: those so far, then the new ones, and a comment whenever it has been quiet."""
    replay, live = hub.subscribe(goal)
    try:
        for kind, body in replay:
            yield frame(kind, body)
        while not stop():
            try:
                yield frame(*live.get(timeout=keepalive))
            except queue.Empty:
                yield KEEPALIVE
    finally:
        hub.unsubscribe(goal, live)


def frame(kind: str, body: Any) -> bytes:
    return f"data: {json.dumps({'type': kind, 'payload': body})}\n\n".encode()


class Service:
    """Answers requests; sources: from a reference to its rows. At most AT_ONCE requests run at a time."""

    def __init__(self, sources: Callable[[str], DataFrame], hub: Hub | None = None, keepalive: float = KEEPALIVE_SECONDS):
        self.sources, self.hub, self.keepalive, self.slots = sources, hub or Hub(), keepalive, threading.BoundedSemaphore(AT_ONCE)

    def answer(self, path: str, request: dict[str, Any]) -> tuple[int, dict[str, Any]]:
        if not self.slots.acquire(blocking=False):
            return 503, {"error": "too many requests at once"}
        try:
            ref = request.get("data_source_ref")
            if not ref:
                raise RequestShape("data_source_ref is required")
            match path:
                case "/introspect":
                    return 200, api.introspect(self.sources(ref), request.get("targets") or [], int(request.get("quantile_bins") or 0))
                case "/execute":
                    return 200, api.execute(self.sources(ref), request)
                case "/analyze":
                    return 200, {"kind": request.get("kind"), "rows": [r.asDict() for r in api.analyze(self.sources(ref), request).collect()]}  # bounded by bins and categories
            return 404, {"error": f"no such path: {path}"}
        except RequestError as error:
            return 400, {"error": str(error), "kind": type(error).__name__}
        except Exception:
            return 500, {"error": "internal error"}
        finally:
            self.slots.release()

    def server(self, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
        """A server that is not started yet; port 0 takes a free one."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args) -> None: ...

            def reply(self, status: int, body: dict[str, Any]) -> None:
                data = json.dumps(body, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_POST(self) -> None:  # noqa: N802
                size = int(self.headers.get("Content-Length") or 0)
                if size > MAX_BODY:
                    return self.reply(413, {"error": "the request is too large"})
                try:
                    request = json.loads(self.rfile.read(size))
                except ValueError:
                    return self.reply(400, {"error": "invalid request body"})
                if not isinstance(request, dict):
                    return self.reply(400, {"error": "invalid request body"})
                return self.reply(*service.answer(self.path, request))

            def do_GET(self) -> None:  # noqa: N802
                parts = self.path.strip("/").split("/")
                if len(parts) != 3 or parts[0] != "goals" or parts[2] != "stream":
                    return self.reply(404, {"error": f"no such path: {self.path}"})
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.send_header("Cache-Control", "no-cache")
                self.end_headers()
                try:
                    for data in frames(service.hub, parts[1], service.keepalive):
                        self.wfile.write(data)
                        self.wfile.flush()
                except OSError:  # the client has gone
                    return None

        out = ThreadingHTTPServer((host, port), Handler)
        out.daemon_threads = True
        return out
