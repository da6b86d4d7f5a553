"""Scans over HTTP, for callers without Spark: POST /api/v1/scan_data with a JSON list of records; and the client."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .cli import words
from .errors import RemoteError
from .operators.flatten import flatten_json
from .operators.profile import field_stats, histogram
from .plans.scan import scan
from .sources import readers, sinks

HOST, PORT, PATH = "127.0.0.1", 10399, "/api/v1/scan_data"


def scanned(spark: SparkSession, items: list[dict], format: str = "short", langs: str | None = None, contexts: str | None = None, limit: int = 1000, **options) -> dict:
    """{"results": rows of the short headers, "data": the report, "stats": statistics} of records."""
    records = [json.dumps(x) for x in items]
    raw = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "k long, r string")
    df = readers.json_frame(raw, "r")
    report = sinks.displayed(scan(df, langs=words(langs), contexts=words(contexts), limit=limit, **options), format)
    stats = field_stats(histogram(flatten_json(raw.select("k", F.parse_json("r").alias("v")), "v", ["k"])))
    rows = lambda d: [r.asDict(recursive=True) for r in d.collect()]
    return {"results": rows(sinks.result_rows(report)), "data": rows(report), "stats": rows(stats)}


def server(spark: SparkSession, host: str = HOST, port: int = PORT) -> ThreadingHTTPServer:
    """A server that hasn't begun to serve; port 0 takes any."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self) -> None:  # noqa: N802 - the base class's name
            url = urllib.parse.urlsplit(self.path)
            if url.path != PATH:
                return self.answer(404, {"error": "no such path"})
            q = {k: v[-1] for k, v in urllib.parse.parse_qs(url.query).items()}
            try:
                items = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                limit = int(q.get("limit", 1000))
                if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
                    raise ValueError("a list of records is wanted")
            except ValueError as e:
                return self.answer(400, {"error": str(e)})
            try:
                self.answer(200, scanned(spark, items, q.get("format", "short"), q.get("langs"), q.get("contexts"), limit))
            except Exception as e:  # noqa: BLE001 - told to the caller
                self.answer(500, {"error": str(e)[:500]})

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def scan_remotely(root: str, items: list[dict], retries: int = 0, delay: float = 1.0, timeout: float | None = None, **query: str) -> dict:
    """What a server's scan of records gives; retried after a fixed delay while it isn't reached or fails."""
    url = root.rstrip("/") + PATH + ("?" + urllib.parse.urlencode(query) if query else "")
    for n in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(items).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code < 500 or n == retries:
                raise RemoteError(f"{url}: {e.code} {e.read()[:200]!r}") from e
        except OSError as e:
            if n == retries:
                raise RemoteError(f"{url}: {e}") from e
        time.sleep(delay)
    raise RemoteError(url)
