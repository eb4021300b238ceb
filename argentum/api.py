"""The read and write routes of the gallery and the labelling page, as functions of a library, and a small server for them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.operators import faces, search
from argentum.plans.library import Library
from argentum.sources.files import opened

#: Most rows that a route returns.
MOST_ROWS = 500


def _rows(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def _hex(text: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]+", text or ""):
        raise ValueError(f"{text!r} is no content hash")
    return text


def _files(lib: Library, q: dict) -> dict:
    if "hash" in q:
        return {"files": _rows(search.files_by_hash(lib.file_hashes, q["hash"]))}
    offset, limit = int(q.get("offset", 0)), int(q.get("limit", 200))
    return {"files": _rows(search.page(lib.file_hashes, q.get("view", "all"), offset, limit).select("path", "hash", "size_bytes", "exif_date", "modified_at"))}


def _faces(lib: Library, q: dict) -> dict:
    people, clusters, alone = lib.faces_view()
    return {"people": _rows(people), "clusters": _rows(clusters), "singletons": _rows(alone)}


def _location(lib: Library, q: dict) -> dict:
    row = lib.file_hashes.where(F.col("hash") == _hex(q.get("hash", ""))).select("gps_lat", "gps_lon", "location_name").head()
    if row is None:
        raise LookupError("no such file")
    return row.asDict()


def _raw(lib: Library, q: dict) -> dict:
    """A file's bytes, if the library has its path; nothing else on the disk can be asked for."""
    row = lib.file_hashes.where(F.col("path") == q.get("path", "")).select("path", "mime", "ext").head()
    if row is None:
        raise LookupError("no such file")
    with opened(row.path) as f:
        return {"mime": row.mime or "application/octet-stream", "bytes": f.read(0, f.size)}


GET: list[tuple[str, Callable]] = [
    (r"/api/files", _files),
    (r"/api/faces", _faces),
    (r"/api/cluster/(-?\d+)", lambda lib, q, cluster: {"faces": _rows(faces.cluster_detail(lib.file_hashes, lib.faces, int(cluster)))}),
    (r"/api/person/([^/]+)", lambda lib, q, name: {"faces": _rows(faces.person_detail(lib.file_hashes, lib.faces, lib.people, unquote(name)))}),
    (r"/api/search/person", lambda lib, q: {"files": _rows(faces.search_by_person(lib.file_hashes, lib.faces, lib.people, q.get("name", "")))}),
    (r"/api/location", _location),
    (r"/api/raw", _raw),
]


def _assign(lib: Library, b: dict) -> None:
    changed, people = faces.assign(lib.faces, lib.people, [int(x) for x in b["ids"]], str(b["name"]))
    lib.write("people", people)
    lib.write("faces", changed)


def _changes(name: str, change: Callable[[Library, dict], DataFrame]) -> Callable[[Library, dict], None]:
    return lambda lib, b: lib.write(name, change(lib, b))


POST: dict[str, Callable[[Library, dict], None]] = {
    "/api/assign": _assign,
    "/api/new-person": _assign,
    "/api/remove-face": _changes("faces", lambda lib, b: faces.remove_face(lib.faces, int(b["id"]))),
    "/api/delete-person": _changes("faces", lambda lib, b: faces.delete_person(lib.faces, str(b["name"]))),
    "/api/set-full-name": _changes("people", lambda lib, b: faces.set_full_name(lib.people, str(b["name"]), str(b["full_name"]))),
    "/api/dissolve-cluster": _changes("faces", lambda lib, b: faces.dissolve_cluster(lib.faces, int(b["cluster_id"]))),
    "/api/set-primary": _changes("faces", lambda lib, b: faces.set_primary(lib.faces, str(b["name"]), int(b["id"]))),
}


def get(lib: Library, url: str) -> dict:
    """The answer of a read route; LookupError for what there isn't, ValueError for what can't be meant."""
    parts = urlsplit(url)
    q = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    for pattern, route in GET:
        if m := re.fullmatch(pattern, parts.path):
            return route(lib, q, *m.groups())
    raise LookupError(f"no route {parts.path}")


def post(lib: Library, path: str, body: dict) -> dict:
    """Carry out a write route on the library's tables."""
    if path not in POST:
        raise LookupError(f"no route {path}")
    try:
        POST[path](lib, body)
    except (KeyError, TypeError) as e:
        raise ValueError(f"the request lacks {e}") from e
    return {"ok": True}


def server(lib: Library, port: int = 0) -> ThreadingHTTPServer:
    """A server on this machine alone; writes are carried out one at a time."""
    writing = Lock()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, work: Callable[[], dict]) -> None:
            try:
                status, out = 200, work()
            except LookupError as e:
                status, out = 404, {"error": {"message": str(e)}}
            except (ValueError, OSError) as e:
                status, out = 400, {"error": {"message": str(e)}}
            kind, data = (out["mime"], out["bytes"]) if "bytes" in out else ("application/json", json.dumps(out, ensure_ascii=False, default=str).encode())
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._answer(lambda: get(lib, self.path))

        def do_POST(self):
            def work():
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                with writing:
                    return post(lib, urlsplit(self.path).path, body)

            self._answer(work)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
