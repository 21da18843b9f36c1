"""A read-only HTTP interface over written results: /api/health, /api/meta, /api/studies, /api/genes, /api/genes/<symbol>."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from concordat.operators import serve

LOCAL = ("127.0.0.1", "localhost", "::1")
_PATH = re.compile(r"^(?:/|[A-Za-z]:\\|file:)")


class Results:
    """Tables below a run's output folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def rows(df: DataFrame, redact: bool = False) -> list[dict]:
    """A bounded frame as plain values; local paths are left out for other machines."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    return [{k: "" if redact and isinstance(v, str) and _PATH.match(v) else v for k, v in r.items()} for r in found]


def respond(results: Results, path: str, query: dict[str, str], redact: bool = False) -> tuple[int, object]:
    """(status, body) of a GET request."""
    scores = lambda: results.table("scores")
    number = lambda k: float(query[k]) if query.get(k) else None
    try:
        if path == "/api/health":
            return 200, rows(serve.health(scores(), results.table("evidence")))[0]
        if path == "/api/meta":
            return 200, {"columns": scores().columns, "sorts": list(serve.SORTS)}
        if path == "/api/studies":
            studies = serve.study_table(results.table("harmonized"))
            limit, offset = serve.bounded(query.get("limit"), "limit", serve.DEFAULT_ROWS, 1), serve.bounded(query.get("offset"), "offset", 0, 0, 10_000_000)
            return 200, {"total": studies.count(), "items": rows(studies.orderBy("study_id").offset(offset).limit(limit), redact)}
        if path == "/api/genes":
            filters = {"q": query.get("q", ""), "direction": query.get("direction", ""), "min_units": query.get("min_units") or None, "min_score": number("min_score")}
            page = serve.entity_page(scores(), query.get("sort", "quality_rank"), query.get("order") == "desc", query.get("limit"), query.get("offset"), **filters)
            return 200, {"total": serve.filtered(scores(), **filters).count(), "items": rows(page)}
        if path.startswith("/api/genes/"):
            found = rows(serve.entity_detail(scores(), results.table("evidence"), unquote(path[len("/api/genes/") :])), redact)
            return (200, found) if found else (404, {"error": "no such entity"})
    except ValueError as problem:
        return 400, {"error": str(problem)}
    return 404, {"error": "no such route"}


def server(results: Results, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    redact = host not in LOCAL

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            name = self.headers.get("Host", "").rsplit(":", 1)[0].strip("[]")
            parts = urlsplit(self.path)
            allowed = redact or name in LOCAL  # a page elsewhere can't reach a local server under another name
            status, body = respond(results, parts.path, {k: v[0] for k, v in parse_qs(parts.query).items()}, redact) if allowed else (403, {"error": "unknown host"})
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        log_message: Callable = lambda *_: None

    return ThreadingHTTPServer((host, port), Handler)
