"""The operations of a knowledge base as a loopback HTTP service and as a tool service on standard input and output."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

from kbspark.base import OPERATIONS, REQUIRED, KbError, KnowledgeBase, call

VERSION = "0.1"
#: Default protocol version of the tool service (a fixed value), bytes of a request's body, code of an unknown method.
PROTOCOL, BODY_LIMIT, NO_METHOD = "2025-06-18", 32 << 20, -32601
_JSON_TYPES = {str: "string", int: "integer", bool: "boolean"}


def dumps(x) -> str:
    return json.dumps(x, default=str)


def _typed(name: str, given: dict[str, str]) -> dict:
    """Arguments of a query string by the types of the operation."""
    out = {}
    for k, v in given.items():
        kind = OPERATIONS[name][2].get(k, str)
        try:
            out[k] = v.lower() in ("1", "t", "true") if kind is bool else kind(v)
        except ValueError as e:
            raise KbError(f"{k}: {v!r}") from e
    return out


def answer(open_kb: Callable[[str], KnowledgeBase], method: str, target: str, body: bytes = b"") -> tuple[int, dict | list]:
    """Status and JSON of one HTTP request; what changes something goes by POST, the rest by GET."""
    url = urlsplit(target)
    name, given = url.path.strip("/"), dict(parse_qsl(url.query))
    if name == "health":
        return 200, {"status": "ok", "version": VERSION}
    if name not in OPERATIONS:
        return 404, {"error": f"no operation {name!r}"}
    wanted = "POST" if OPERATIONS[name][3] else "GET"
    if method != wanted:
        return 405, {"error": f"use {wanted}"}
    try:
        kb = open_kb(given.pop("kb", ""))
        if name == "retain":
            given["path"] = given.pop("as", given.get("path", ""))
        arguments = _typed(name, given)
        if name == "retain":
            arguments["content"] = body.decode(errors="replace")
        return 200, call(kb, name, arguments)
    except Exception as e:  # noqa: BLE001 - a request's failure is its answer
        return 400, {"error": str(e)}


def http_server(open_kb: Callable[[str], KnowledgeBase], host: str = "127.0.0.1", port: int = 3978) -> HTTPServer:
    if host != "localhost" and not ipaddress.ip_address(host).is_loopback:
        raise KbError(f"{host} isn't a loopback address")

    class Handler(BaseHTTPRequestHandler):
        def _serve(self):
            length = int(self.headers.get("Content-Length") or 0)
            status, out = (413, {"error": "the body is too large"}) if length > BODY_LIMIT else answer(open_kb, self.command, self.path, self.rfile.read(length))
            data = dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _serve

        def log_message(self, *_):
            pass

    return HTTPServer((host, port), Handler)


def tools() -> list[dict]:
    out = []
    for name, (_, about, kinds, _) in OPERATIONS.items():
        properties = {"kb": {"type": "string"}, **{k: {"type": _JSON_TYPES[t]} for k, t in kinds.items()}}
        out.append({"name": f"kb_{name}", "description": about, "inputSchema": {"type": "object", "properties": properties, "required": list(REQUIRED.get(name, ()))}})
    return out


def _call_tool(open_kb: Callable[[str], KnowledgeBase], params: dict) -> dict:
    try:
        arguments = dict(params.get("arguments") or {})
        text, failed = dumps(call(open_kb(arguments.pop("kb", "")), str(params.get("name", "")).removeprefix("kb_"), arguments)), False
    except Exception as e:  # noqa: BLE001 - a tool's failure is its result
        text, failed = f"{params.get('name')}: {e}", True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def tool_service(open_kb: Callable[[str], KnowledgeBase], lines: Iterable[str], write: Callable[[str], object]) -> None:
    """JSON-RPC, one message a line; notifications and lines that aren't JSON objects get no answer."""
    for line in lines:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if not isinstance(message, dict) or message.get("id") is None:
            continue
        method, params = message.get("method"), message.get("params") or {}
        out: dict = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            out["result"] = {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "kbspark", "version": VERSION}}
        elif method == "tools/list":
            out["result"] = {"tools": tools()}
        elif method == "tools/call":
            out["result"] = _call_tool(open_kb, params)
        elif method == "ping":
            out["result"] = {}
        else:
            out["error"] = {"code": NO_METHOD, "message": f"no method {method!r}"}
        write(dumps(out) + "\n")
