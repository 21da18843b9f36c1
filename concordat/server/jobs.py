"""Jobs in a sqlite file: queued -> running -> completed, failed or interrupted; progress never falls."""

from __future__ import annotations

import json
import sqlite3
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession

NEXT = {"queued": ("running", "failed", "interrupted"), "running": ("completed", "failed", "interrupted")}


class JobStore:
    def __init__(self, path: str) -> None:
        self.lock, self.db = threading.Lock(), sqlite3.connect(path, check_same_thread=False)
        with self.db:
            self.db.execute("create table if not exists jobs (id text primary key, kind text, status text, progress real, message text, payload text, result text, error text)")
            # What ran when the last process ended can't go on.
            self.db.execute("update jobs set status = 'interrupted' where status in ('queued', 'running')")

    def create(self, kind: str, payload: object) -> str:
        key = uuid.uuid4().hex
        with self.lock, self.db:
            self.db.execute("insert into jobs values (?, ?, 'queued', 0, '', ?, null, null)", (key, kind, json.dumps(payload)))
        return key

    def get(self, key: str) -> dict:
        row = self.db.execute("select * from jobs where id = ?", (key,)).fetchone()
        if row is None:
            raise KeyError(key)
        names = ("id", "kind", "status", "progress", "message", "payload", "result", "error")
        return {n: json.loads(v) if n in ("payload", "result") and v is not None else v for n, v in zip(names, row)}

    def update(self, key: str, status: str | None = None, progress: float | None = None, message: str | None = None, result: object = None, error: str | None = None) -> None:
        with self.lock, self.db:
            now = self.get(key)
            if status and status != now["status"] and status not in NEXT.get(now["status"], ()):
                raise ValueError(f"a job can't go from {now['status']} to {status}")
            self.db.execute(
                "update jobs set status = ?, progress = ?, message = ?, result = ?, error = ? where id = ?",
                (status or now["status"], max(now["progress"], min(1.0, progress or 0.0)), now["message"] if message is None else message, json.dumps(result) if result is not None else json.dumps(now["result"]) if now["result"] is not None else None, error or now["error"], key),
            )


class JobManager:
    """Runs jobs on a few threads; with a session, each sets a Spark job group of its own, so that it can be cancelled."""

    def __init__(self, store: JobStore, workers: int = 2, spark: SparkSession | None = None) -> None:
        self.store, self.pool, self.spark = store, ThreadPoolExecutor(workers), spark

    def cancel(self, key: str) -> None:
        """Stops the Spark jobs of a running job, which then fails."""
        if self.spark:
            self.spark.sparkContext.cancelJobGroup(key)

    def submit(self, kind: str, payload: object, work: Callable[[object, Callable[[float, str], None]], object]) -> tuple[str, Future]:
        key = self.store.create(kind, payload)

        def go() -> None:
            self.store.update(key, "running")
            if self.spark:
                self.spark.sparkContext.setJobGroup(key, kind, interruptOnCancel=True)
            try:
                done = work(payload, lambda progress, message="": self.store.update(key, progress=progress, message=message))
            except Exception as problem:  # the job's failure is its result
                self.store.update(key, "failed", error=f"{type(problem).__name__}: {problem}")
            else:
                self.store.update(key, "completed", 1.0, result=done)

        return key, self.pool.submit(go)
