"""HTTP surface: /status, /api/datasets, /api/query, /upload/auto, /upload/raw, /upload/remote."""

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from . import __version__
from .engine import Engine
from .sources.sniff import clean


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def respond(engine: Engine, method: str, target: str, body: bytes) -> tuple[int, bytes]:
    """Status and JSON body of a request; the server and the tests share it."""
    url = urlparse(target)
    try:
        return 200, json.dumps(_answer(engine, method, url.path, parse_qs(url.query), body)).encode()
    except Refused as e:
        return e.status, json.dumps({"error": str(e)}).encode()
    except Exception as e:  # noqa: BLE001  any failure of a query is the server's answer
        return 500, json.dumps({"error": str(e)}).encode()


def _fields(body: bytes, names: set[str]) -> dict:
    try:
        got = json.loads(body)
    except ValueError as e:
        raise Refused(400, "the body is not JSON") from e
    if not isinstance(got, dict) or set(got) - names:
        raise Refused(400, "unknown fields")
    return got


def _answer(engine: Engine, method: str, path: str, query: dict, body: bytes):
    reads = {"/status": lambda: {"status": "ok"}, "/api/datasets": engine.catalog.list}
    if path in reads:
        return reads[path]()
    if path not in ("/api/query", "/upload/auto", "/upload/raw", "/upload/remote"):
        raise Refused(404, "no such page")
    if method != "POST":
        raise Refused(405, "POST only")
    if path == "/api/query":
        return json.loads(engine.json(_fields(body, {"sql"}).get("sql", "")))
    if path == "/upload/remote":
        got = _fields(body, {"name", "url"})
        if not all(isinstance(got.get(k), str) and got[k] for k in ("name", "url")):
            raise Refused(400, "name and url are needed")
        return engine.catalog.load_url(got["name"], got["url"])
    name = query.get("name", ["dataset"])[0]
    return engine.catalog.load(body, name) if path == "/upload/auto" else engine.catalog.keep_raw(name, body)


def serve(engine: Engine, port: int = 8822, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = respond(engine, self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m lodeframe.server", description=__doc__)
    p.add_argument("--expose", action="store_true", help="listen on all addresses, not only on this machine's own")
    p.add_argument("--port-http", type=int, default=8822)
    p.add_argument("--wdir", help="the dataset folder: any path that driver and executors share")
    p.add_argument("--samples", metavar="FOLDER", help="load a folder of delimited files first, those that aren't datasets yet")
    p.add_argument("--version", action="version", version=__version__)
    return p.parse_args(given)


def load_samples(engine: Engine, folder: str) -> list[dict]:
    """A dataset of each file whose name no dataset has."""
    known = {m["name"] for m in engine.catalog.list()}
    return [engine.catalog.load(e.path, e.stem) for e in engine.catalog.files.list(folder) if e.is_file and clean(e.stem, "dataset") not in known]


def main(given: list[str] | None = None) -> ThreadingHTTPServer:
    got = arguments(given)
    engine = Engine(SparkSession.builder.getOrCreate(), got.wdir)
    if got.samples:
        load_samples(engine, got.samples)
    return serve(engine, got.port_http, "0.0.0.0" if got.expose else "127.0.0.1")  # noqa: S104  asked for


if __name__ == "__main__":
    main().serve_forever()
