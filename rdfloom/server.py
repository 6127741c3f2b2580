"""SPARQL protocol over HTTP: GET and POST /sparql, / and /stats."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from rdfloom.engine import Dataset, Result
from rdfloom.errors import Busy, QueryError, QueryTimeout, UnsupportedError
from rdfloom.governor import Governor
from rdfloom.results import FORMATS, serialise

#: Bytes of a response that are held before they are sent.
CHUNK = 1 << 16
PAGE = "<!DOCTYPE html><title>SPARQL</title><form action=/sparql><textarea name=query rows=12 cols=90>SELECT * WHERE { ?s ?p ?o } LIMIT 10</textarea><br><select name=format><option>tsv<option>csv<option>json<option>xml</select> <button>Run</button></form>"


def wanted(accept: str, given: str | None) -> str:
    """Format of a request: its format parameter, or what it accepts."""
    if given:
        return given
    for form, kind in FORMATS.items():
        if kind.split(";")[0] in accept:
            return form
    return "xml" if "xml" in accept and "html" not in accept else "json"


def make(data: Dataset, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server that runs queries as the governor has room for them; others wait, and are refused after a while."""
    governor = Governor(data.settings)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, body: str, kind: str = "text/plain; charset=utf-8", **headers: str) -> None:
            raw = body.encode()
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(raw)), "Access-Control-Allow-Origin": "*", **{k.replace("_", "-"): v for k, v in headers.items()}}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/":
                self.reply(200, PAGE, "text/html; charset=utf-8")
            elif url.path == "/stats":
                self.reply(200, json.dumps({p: vars(s) for p, s in data.statistics().items()}), "application/json")
            elif url.path == "/sparql":
                self.answer({k: v[0] for k, v in parse_qs(url.query).items()})
            else:
                self.reply(404, "not found\n")

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if url.path != "/sparql":
                self.reply(404, "not found\n")
                return
            args = {k: v[0] for k, v in parse_qs(url.query).items()}
            if self.headers.get("Content-Type", "").startswith("application/x-www-form-urlencoded"):
                args |= {k: v[0] for k, v in parse_qs(body).items()}
            else:
                args["query"] = body
            self.answer(args)

        def answer(self, args: dict[str, str]) -> None:
            if not args.get("query"):
                self.reply(400, "no query\n")
                return
            form = wanted(self.headers.get("Accept", ""), args.get("format"))
            if form not in FORMATS:
                self.reply(400, f"unknown format {form}\n")
                return
            began = time.perf_counter()
            try:
                with governor.room(data.reservation(args["query"])):
                    waited = time.perf_counter()
                    result = data.run(args["query"])
                    try:
                        self.stream(result, form, began, waited)
                    finally:
                        result.close()
            except Busy:
                self.reply(503, "too many queries; try again later\n", Retry_After="10")
            except QueryTimeout as e:
                self.reply(408, f"{e}\n")
            except UnsupportedError as e:
                self.reply(400, f"unsupported: {e}\n")
            except QueryError as e:
                self.reply(400, f"{e}\n")
            except (BrokenPipeError, ConnectionError):
                self.close_connection = True
            except Exception as e:
                self.reply(500, f"{type(e).__name__}: {str(e)[:500]}\n")

        def stream(self, result: Result, form: str, began: float, waited: float) -> None:
            """The rows have been computed; they are sent in chunks as they come from the executors."""
            kind = FORMATS["nt"] if result.form in ("DESCRIBE", "CONSTRUCT") and form in ("nt", "xml") else FORMATS[form]
            now = time.perf_counter()
            head = {"Content-Type": kind, "Transfer-Encoding": "chunked", "Access-Control-Allow-Origin": "*", "X-Query-Micros": str(round(1e6 * (now - began))), "X-Wait-Micros": str(round(1e6 * (waited - began))), "X-Execute-Micros": str(round(1e6 * (now - waited)))}
            parts, held, size = serialise(result, form), [], 0
            self.send_response(200)
            for k, v in (head | ({"X-Query-Hints": "; ".join(result.hints)} if result.hints else {})).items():
                self.send_header(k, v)
            self.end_headers()
            try:
                for part in parts:
                    held.append(part.encode())
                    size += len(held[-1])
                    if size >= CHUNK:
                        self.chunk(held)
                        held, size = [], 0
                if held:
                    self.chunk(held)
                self.wfile.write(b"0\r\n\r\n")
            except Exception:  # the status is out: a body without its end tells the client
                self.close_connection = True

        def chunk(self, held: list[bytes]) -> None:
            body = b"".join(held)
            self.wfile.write(b"%x\r\n%s\r\n" % (len(body), body))

    return ThreadingHTTPServer((host or data.settings.host, data.settings.port if port is None else port), Handler)
