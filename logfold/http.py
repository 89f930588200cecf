"""The service over HTTP: POST /events and /users, GET /dashboard, /reports/{events,users} and /health."""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from logfold.runtime import Result, Service

#: Path of a write, and the member of its body besides request_id and payload.
WRITES = {"/events": "event_type", "/users": "user_id"}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet; one thread per request, reads bounded by the service."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_: object) -> None:
            pass

        def reply(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def fail(self, status: int, why: str | None) -> None:
            self.reply(status, {"detail": why})

        def do_POST(self) -> None:
            subject = WRITES.get(urlsplit(self.path).path)
            if subject is None:
                return self.fail(404, "no such path")
            length = int(self.headers.get("Content-Length") or 0)
            if length > service.limits.payload_bytes:
                self.close_connection = True
                return self.fail(413, "payload too large")
            try:
                body = json.loads(self.rfile.read(length))
                given = [body.get(k) for k in ("request_id", subject)]
                payload = body.get("payload", {})
                if not (all(isinstance(x, str) and x for x in given) and isinstance(payload, dict)):
                    raise ValueError(f"request_id and {subject} must be non-empty texts, payload an object")
            except (ValueError, AttributeError) as e:
                return self.fail(422, str(e))
            r = (service.post_event if subject == "event_type" else service.post_user)(*given, payload)
            status = r.data["status"] if r.success and r.data else "error"
            self.reply(r.status_code, {"success": r.success, "status": status, "request_id": r.request_id, "error": r.error})

        def read(self, r: Result) -> None:
            self.reply(200, r.data) if r.success else self.fail(r.status_code, r.error)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/dashboard":
                return self.read(service.dashboard(dict(parse_qsl(url.query))))
            if url.path.startswith("/reports/"):
                return self.read(service.report(url.path.removeprefix("/reports/")))
            if url.path == "/health":
                try:
                    h = service.health()
                except RuntimeError as e:
                    return self.fail(503, str(e))
                return self.reply(200 if h.healthy else 503, asdict(h) | {"healthy": h.healthy, "queue_pct": h.queue_pct, "queue_warning": h.queue_warning})
            self.fail(404, "no such path")

    return ThreadingHTTPServer((host, port), Handler)
