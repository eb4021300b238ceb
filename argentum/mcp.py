"""The library's tools for language-model clients: JSON-RPC messages, one a line."""

from __future__ import annotations

import json

from argentum.operators import stats
from argentum.plans.library import Library

_TEXT = {"type": "string"}
_SEARCH = {n: _TEXT for n in ("text", "person", "category", "date", "after", "before", "location", "sort", "model")} | {
    "kinds": {"type": "array", "items": _TEXT}, "exts": {"type": "array", "items": _TEXT}, "paths": {"type": "array", "items": _TEXT}, "km": {"type": "number"}, "k": {"type": "integer"},
}
TOOLS = {
    "stats": ("Totals of the library", {}),
    "find_duplicates": ("Files with the same content, and on request files that look alike", {"include_similar": {"type": "boolean"}}),
    "search": ("Files that match all filters, ranked by a text on request", _SEARCH),
}
PROTOCOL, UNKNOWN_METHOD, BAD_REQUEST = "2024-11-05", -32601, -32700


def call(lib: Library, name: str, arguments: dict, embedder=None) -> str:
    """A tool's answer as JSON text."""
    if name not in TOOLS:
        raise LookupError(f"no tool {name!r}")
    if extra := set(arguments) - set(TOOLS[name][1]):
        raise ValueError(f"{name} takes no {', '.join(sorted(extra))}")
    if name == "find_duplicates":
        return lib.find_duplicates(bool(arguments.get("include_similar"))).head().document
    rows = stats.tool_stats(lib.file_hashes, lib.embeddings) if name == "stats" else lib.search(embedder=embedder, **arguments)
    found = [r.asDict(recursive=True) for r in rows.collect()]  # one row, or at most k
    return json.dumps(found[0] if name == "stats" else {"results": found}, ensure_ascii=False, default=str)


def answer(lib: Library, line: str, embedder=None) -> str | None:
    """The reply to one message; none to a notification."""
    try:
        message = json.loads(line)
        method, params = message["method"], message.get("params") or {}
    except (ValueError, KeyError, TypeError):
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": BAD_REQUEST, "message": "not a message"}})
    if "id" not in message:
        return None
    out: dict = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        out["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "argentum", "version": "2"}}
    elif method == "tools/list":
        out["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p) in TOOLS.items()]}
    elif method == "tools/call":
        try:
            text, failed = call(lib, params.get("name", ""), params.get("arguments") or {}, embedder), False
        except (ValueError, LookupError, TypeError) as e:
            text, failed = str(e), True
        out["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        out["error"] = {"code": UNKNOWN_METHOD, "message": f"no method {method!r}"}
    return json.dumps(out, ensure_ascii=False)


def serve(lib: Library, lines, out, embedder=None) -> None:
    for line in lines:
        if line.strip() and (reply := answer(lib, line, embedder)) is not None:
            out.write(reply + "\n")
            out.flush()
