"""A facade: submit analyses, follow them through the stages and read their results; in-process or over HTTP.

Work is done by Spark; what is here is the order of things. A request waits in a queue, a worker
takes it through the seven stages, failures are classified and tried again where that may help, and
observers hear of every event.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

#: The stages of a run, in order; categories of errors that are tried again; retries and workers at most.
STAGES = ("recepcion", "validacion", "preparacion", "coordinacion", "procesamiento", "respuesta", "finalizacion")
RECOVERABLE = ("communication", "processing", "temporary")
MAX_RETRIES, MAX_WORKERS, MAX_DEPTH = 3, 10, 10_000
VERSION = "1.0"
_ENDED = ("completed", "failed", "cancelled", "stopped")


class Fault(Exception):
    """A failure of a known category."""

    def __init__(self, message: str, category: str = "processing"):
        super().__init__(message)
        self.category = category


@dataclass
class Run:
    """One analysis: its request, where it is and how it ended."""

    process_id: str
    request: dict
    state: str = "queued"
    stage: str | None = None
    completed: list[str] = field(default_factory=list)
    attempts: int = 0
    error: str | None = None
    result: object = None


class Engine:
    """Takes analyses (``analyse``: session and request to a DataFrame or a value) through queue, stages, retries and results."""

    def __init__(self, spark: SparkSession | None, analyse: Callable, workers: int = MAX_WORKERS, depth: int = MAX_DEPTH):
        self.spark, self.analyse, self.depth = spark, analyse, depth
        self.runs: dict[str, Run] = {}
        self.observers: list[Callable[[str, Run], None]] = []
        self.events: Counter = Counter()
        self._lock = threading.RLock()
        self._pool = ThreadPoolExecutor(max_workers=workers)

    def observe(self, listener: Callable[[str, Run], None]) -> None:
        self.observers.append(listener)

    def _tell(self, event: str, run: Run) -> None:
        with self._lock:
            self.events[event] += 1
        for listener in self.observers:
            listener(event, run)

    def submit(self, request: dict, source: str = "ecg", process_id: str | None = None) -> dict:
        """Queues a request; refused if its source isn't the right one, its process runs already, or the queue is full."""
        process_id = process_id or str(uuid.uuid4())
        with self._lock:
            if source != "ecg":
                return {"success": False, "process_id": process_id, "message": "rejected_source"}
            if len(self._pending()) >= self.depth:
                return {"success": False, "process_id": process_id, "message": "queue_full"}
            known = self.runs.get(process_id)
            if known and known.state not in _ENDED:
                return {"success": False, "process_id": process_id, "message": "already_queued"}
            run = self.runs[process_id] = Run(process_id, request)
            position = len(self._pending())
        self._tell("enqueued", run)
        return {"success": True, "process_id": process_id, "message": "queued", "position": position}

    def _pending(self) -> list[Run]:
        return [r for r in self.runs.values() if r.state == "queued"]

    def start(self) -> list:
        """Hands what is queued to the workers; the futures of the runs."""
        with self._lock:
            taken = self._pending()
            for r in taken:
                r.state = "assigned"
        return [self._pool.submit(self._execute, r) for r in taken]

    def process_pending(self) -> int:
        """Runs what is queued here and now, first in first out."""
        n = 0
        while pending := self._pending():
            self._execute(pending[0])
            n += 1
        return n

    def _execute(self, run: Run) -> Run:
        run.state = "running"
        self._tell("processing_started", run)
        while run.state == "running":
            run.attempts += 1
            try:
                for stage in STAGES:
                    if run.state != "running":
                        return run
                    run.stage = stage
                    if stage == "procesamiento":
                        run.result = self.analyse(self.spark, run.request)
                    if stage not in run.completed:
                        run.completed.append(stage)
                run.state = "completed"
            except Exception as e:
                run.error, category = str(e), getattr(e, "category", "system_internal")
                if category in RECOVERABLE and run.attempts <= MAX_RETRIES:
                    self._tell("retry", run)
                    continue
                run.state = "cancelled" if category in RECOVERABLE else "failed"
        self._tell(run.state, run)
        return run

    def stop(self, process_id: str) -> None:
        run = self.runs[process_id]
        if run.state not in _ENDED:
            run.state = "stopped"
            self._tell("stopped", run)

    def status(self, process_id: str) -> dict:
        run = self.runs.get(process_id)
        if run is None:
            return {"success": False, "process_id": process_id, "message": "process_not_found"}
        position = next((i + 1 for i, r in enumerate(self._pending()) if r is run), 0)
        return {"success": True, "process_id": process_id, "state": run.state, "stage": run.stage, "completed": run.completed, "attempts": run.attempts, "position": position, "error": run.error}

    def result(self, process_id: str, rows: int = 1000) -> dict:
        """The result of a run that has completed; of a DataFrame its first ``rows`` rows."""
        run = self.runs.get(process_id)
        if run is None or run.state != "completed":
            return {"success": False, "process_id": process_id, "message": "no_result"}
        value = run.result
        return {"success": True, "process_id": process_id, "result": [r.asDict(recursive=True) for r in value.limit(rows).collect()] if isinstance(value, DataFrame) else value}

    def info(self) -> dict:
        states = Counter(r.state for r in self.runs.values())
        return {"version": VERSION, "ready": self.spark is None or not self.spark.sparkContext._jsc.sc().isStopped(), "runs": dict(states), "events": dict(self.events), "stages": list(STAGES)}


def serve(engine: Engine, port: int = 0) -> ThreadingHTTPServer:
    """An HTTP service of the engine on this machine: analyses (POST), their state, status and result, health and information."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _send(self, code: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self):  # noqa: N802
            if self.path.rstrip("/") != "/analyses":
                return self._send(404, {"success": False, "message": "not_found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            except ValueError:
                return self._send(422, {"success": False, "message": "invalid_structure"})
            out = engine.submit(request, request.get("source", "ecg"), request.get("process_id"))
            if out["success"]:
                engine.start()
            return self._send(202 if out["success"] else 409, out)

        def do_GET(self):  # noqa: N802
            parts = [p for p in self.path.split("?")[0].split("/") if p]
            info = engine.info()
            fixed = {
                (): {"service": "analysis", "version": VERSION}, ("health", "motor"): {"success": info["ready"], "status": "available" if info["ready"] else "unavailable"}, ("health", "coordinator"): {"success": info["ready"], "status": "ready"},
                ("info", "version"): {"version": VERSION}, ("info", "service"): info, ("info", "modules"): {"modules": list(STAGES), "count": len(STAGES)},
            }
            if tuple(parts) in fixed:
                return self._send(200, fixed[tuple(parts)])
            if len(parts) in (2, 3) and parts[0] == "analyses":
                status, result = engine.status(parts[1]), engine.result(parts[1])
                if not status["success"]:
                    return self._send(404, status)
                if len(parts) == 2:
                    return self._send(200, status | {"result": result.get("result")})
                if parts[2] in ("status", "result"):
                    return self._send(200, status if parts[2] == "status" else result)
            return self._send(404, {"success": False, "message": "not_found"})

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
