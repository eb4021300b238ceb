"""Operators on real files, on pixels, and the surfaces that users meet (S, V, T, U), each over whole tables."""

from __future__ import annotations

import contextlib
import io
import os
import sqlite3
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from argentum import api, cli
from argentum.functions import imaging, media
from argentum.operators import face_job
from argentum.plans import config
from argentum.plans.library import Library
from argentum.queries.sources import exif_jpeg, movie
from argentum.sources import catalogs, importing, scan, sinks
from argentum.storage import materialize, scratch_dir, table
from argentum.streaming import ledger
from argentum.streaming.progress import Progress

from .registry import query, raw_query

_EXTS = ["jpg", "PNG", "txt", "mov", "tif", "heic", "m4v", "dng"]


def _folder(spark, name: str) -> str:
    """A new folder in the shared scratch folder, as a path of the file system."""
    path = f"{scan.mounted(scratch_dir(spark))}/{name}-{uuid.uuid4().hex[:8]}"
    os.makedirs(path)
    return path


def _page_files(spark, sf_dir: str) -> str:
    """Every page's html as a file, a tenth of them empty, extensions in turn."""
    root = _folder(spark, "pages")

    def put(batches):
        for pdf in batches:
            for i, html in zip(pdf["page_id"], pdf["html"]):
                folder = f"{root}/{i % 7}/{i % 3}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{i}.{_EXTS[i % len(_EXTS)]}", "wb") as f:
                    f.write(b"" if i % 10 == 0 else html.encode())
            yield pdf[["page_id"]]

    table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(put, "page_id bigint").foreach(lambda _: None)
    return root


_FILE = "CAST(page_id % 7 AS VARCHAR) || '/' || CAST(page_id % 3 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.' || ['jpg', 'PNG', 'txt', 'mov', 'tif', 'heic', 'm4v', 'dng'][page_id % 8 + 1]"
_WALKED = "page_id % 8 NOT IN (2, 4, 6)"
_BODY = "CASE WHEN page_id % 10 = 0 THEN '' ELSE html END"


@raw_query("s01_walk", f"SELECT {_FILE} AS name, CAST(octet_length(encode({_BODY})) AS BIGINT) AS size_bytes FROM pages WHERE {_WALKED}")
def walked(spark, sf_dir):
    root = _page_files(spark, sf_dir)
    return scan.walk(spark, root).select(F.substring("path", len(root) + 2, 1000).alias("name"), "size_bytes")


@raw_query("s02_scan_folder", f"SELECT {_FILE} AS name, sha256({_BODY}) AS hash, lower(['jpg', 'PNG', 'txt', 'mov', 'tif', 'heic', 'm4v', 'dng'][page_id % 8 + 1]) AS ext, CASE WHEN page_id % 10 <> 0 THEN 'application/octet-stream' END AS mime, CAST(NULL AS VARCHAR) AS error FROM pages WHERE {_WALKED}")
def scanned(spark, sf_dir):
    """Files digested from their paths; empty ones have no type."""
    root = _page_files(spark, sf_dir)
    return scan.scan(spark, root).select(F.substring("path", len(root) + 2, 1000).alias("name"), "hash", "ext", "mime", "error")


@query("s45_read_budget", "SELECT path, greatest(20.0::DOUBLE, size_bytes * 100000 / 20000000.0) AS seconds, greatest(20.0::DOUBLE, size_bytes * 100000 / 5000000.0) AS slow FROM file_hashes")
def budgets(lib):
    def run(batches):
        for pdf in batches:
            size = pdf["size_bytes"] * 100_000
            yield pdf[["path"]].assign(seconds=[float(scan.read_budget(n)) for n in size], slow=[float(scan.read_budget(n, 5)) for n in size])

    return lib.file_hashes.select("path", "size_bytes").mapInPandas(run, "path string, seconds double, slow double")


@query("s04_exif_of_files", "SELECT path, exif_date FROM file_hashes WHERE exif_date NOT LIKE '0000%'")
def exif_of_files(lib):
    """Each file's capture date, written into a JPEG and read back."""

    def run(batches):
        for pdf in batches:
            heads = [exif_jpeg(d.replace("-", ":").replace("T", " ")) for d in pdf["exif_date"]]
            yield pdf[["path"]].assign(exif_date=[media.read_exif(h)["exif_date"] for h in heads])

    return lib.file_hashes.where("exif_date NOT LIKE '0000%'").select("path", "exif_date").mapInPandas(run, "path string, exif_date string")


@raw_query("s44_movie_boxes", "SELECT doc_id, doc_id / 600.0::DOUBLE AS duration_secs, strftime(to_timestamp(3700000000 + doc_id - 2082844800) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS taken, 1920 AS width, 'avc1' AS codec, doc_id % 2 = 0 AS found FROM documents")
def movie_boxes(spark, sf_dir):
    """A movie for each document: box walk, movie and track headers; every second one is cut before its end."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["doc_id"].tolist():
                data = movie(i, 600, 3_700_000_000 + i)
                m, cut = media.read_video(data), media.find_moov(data[: len(data) - i % 2])
                out.append((i, m["duration_secs"], m["exif_date"], m["width"], m["codec"], cut is not None))
            yield pd.DataFrame(out, columns=["doc_id", "duration_secs", "taken", "width", "codec", "found"])

    return table(spark, sf_dir, "documents").select("doc_id").mapInPandas(run, "doc_id bigint, duration_secs double, taken string, width int, codec string, found boolean")


@query("s18_html_page", "SELECT hash, count(*) - 1 AS removed FROM file_hashes GROUP BY hash HAVING count(*) > 1")
def html_page(lib):
    """The page of duplicates as written, taken apart again."""
    from argentum.operators.duplicates import groups_by_waste

    page = f"{_folder(lib.spark, 'page')}/page.html"
    sinks.html_page(groups_by_waste(lib.file_hashes), page)
    lines = lib.spark.read.text(f"file:{page}").where("value LIKE '<section%'")
    return lines.select(F.regexp_extract("value", r"data-hash=(\w+)", 1).alias("hash"), (F.size(F.split("value", "<li>")) - 1).cast("bigint").alias("removed"))


@query("s27_schema_check", "SELECT * FROM (VALUES ('AgLibraryFile.folder', 'ValueError'), ('AgLibraryRootFolder', 'ValueError'), ('nothing', 'read')) t(lacks, outcome)")
def schema_check(lib):
    rows = []
    for lacks in ("AgLibraryFile.folder", "AgLibraryRootFolder", "nothing"):
        path = f"{_folder(lib.spark, 'catalog')}/x.lrcat"
        con = sqlite3.connect(path)
        for name, columns in catalogs.CATALOG_TABLES.items():
            if name != lacks:
                con.execute(f"CREATE TABLE {name}({', '.join(c for c in columns if f'{name}.{c}' != lacks)})")
        con.commit()
        con.close()
        try:
            catalogs.catalog_tables(lib.spark, path)
            rows.append((lacks, "read"))
        except ValueError:
            rows.append((lacks, "ValueError"))
    return lib.spark.createDataFrame(rows, "lacks string, outcome string")


@query("s47_catalog_choice", "SELECT * FROM (VALUES ('folder', 'a.lrcat'), ('file', 'b.lrcat'), ('no such file', NULL), ('empty folder', NULL)) t(asked, catalog)")
def catalog_choice(lib):
    root = _folder(lib.spark, "catalogs")
    os.makedirs(f"{root}/empty")
    for name in ("b.lrcat", "a.lrcat", "c.txt"):
        open(f"{root}/{name}", "w").close()
    asked = {"folder": root, "file": f"{root}/b.lrcat", "no such file": f"{root}/d.lrcat", "empty folder": f"{root}/empty"}
    got = {k: catalogs.find_catalog(p) for k, p in asked.items()}
    return lib.spark.createDataFrame([(k, os.path.basename(p) if p else None) for k, p in got.items()], "asked string, catalog string")


def _libraries(spark) -> str:
    """A folder with a library of every kind, by name."""
    root = _folder(spark, "libraries")
    for path in ("package.photoslibrary", "database/database", "database/Masters", "older/Masters", "older/Database", "takeout/Takeout/Google Photos", "album", "plain/x", *(f"{p}/{c}" for p in ("fanout", "fanout-below/originals") for c in "01234567"), *(f"mixed/{c}" for c in "01234567"), *(f"mixed/other{n}" for n in range(9))):
        os.makedirs(f"{root}/{path}")
    for path in ("database/database/Photos.sqlite", "album/1.jpg.supplemental-metadata.json", "plain/x/1.jpg"):
        open(f"{root}/{path}", "w").close()
    os.makedirs(f"{root}/catalog")
    open(f"{root}/catalog/a.lrcat", "w").close()
    return root


_KINDS = "('package.photoslibrary', 'apple-photos', true), ('database', 'apple-photos', true), ('older', 'apple-photos', true), ('fanout', 'apple-photos', true), ('fanout-below', 'apple-photos', true), ('mixed', NULL, false), ('takeout', 'google-takeout', true), ('album', 'google-takeout', true), ('catalog', 'lightroom', true), ('plain', NULL, false)"


@query("s48_providers_of_folders", f"SELECT name, provider FROM (VALUES {_KINDS}) t(name, provider, found)")
def providers(lib):
    root = _libraries(lib.spark)
    return lib.spark.createDataFrame([(n, catalogs.detect(f"{root}/{n}")) for n in sorted(os.listdir(root))], "name string, provider string")


@query("s33_discover", f"SELECT name, provider FROM (VALUES {_KINDS}) t(name, provider, found) WHERE found")
def discover(lib):
    root = _libraries(lib.spark)
    below = [(os.path.basename(p), provider) for provider, p in catalogs.discover([root]) if p != root]
    return lib.spark.createDataFrame(below, "name string, provider string")


@query("s34_layouts", "SELECT * FROM (VALUES ('database', 'database', 'any'), ('layout', 'layout', 'Masters'), ('ask', 'ask', NULL)) t(case_, how, found)")
def layouts(lib):
    root = _libraries(lib.spark)
    os.makedirs(f"{root}/any")
    asked = {"database": (f"{root}/older", f"{root}/any"), "layout": (f"{root}/older", f"{root}/no-such"), "ask": (f"{root}/plain", None)}
    got = {k: catalogs.locate(p, d, ["originals", "masters"]) for k, (p, d) in asked.items()}
    return lib.spark.createDataFrame([(k, how, p and os.path.basename(p)) for k, (how, p) in got.items()], "case_ string, how string, found string")


@raw_query("s39_disk_usage", f"SELECT 'files' AS component, CAST(sum(octet_length(encode({_BODY}))) AS BIGINT) AS bytes, true AS rebuildable FROM pages UNION ALL SELECT 'one', CAST(sum(octet_length(encode({_BODY}))) AS BIGINT), false FROM pages WHERE page_id % 7 = 1")
def usage(spark, sf_dir):
    root = _page_files(spark, sf_dir)
    return spark.createDataFrame(sinks.disk_usage({"files": (root, True), "one": (f"{root}/1", False), "none": (f"{root}/no-such", False)}), "component string, bytes bigint, rebuildable boolean")


@raw_query("s46_import", "SELECT count(*) AS files, count(*) FILTER (WHERE page_id % 3 <> 0) AS matched, count(*) FILTER (WHERE page_id % 3 = 0) AS unmatched, count(*) FILTER (WHERE page_id % 3 <> 0) AS set_, count(*) FILTER (WHERE page_id % 3 <> 0) AS right_afterwards FROM pages")
def imported(spark, sf_dir):
    """An export made of the pages: dates of two thirds are in sidecars, are set, and are right afterwards."""
    root = _folder(spark, "export")

    def put(batches):
        for pdf in batches:
            for i in pdf["page_id"].tolist():
                folder = f"{root}/Google Photos/{i % 5}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{i}.jpg", "w") as f:
                    f.write(str(i))
                if i % 3:
                    with open(f"{folder}/{i}.jpg.supplemental-metadata.json", "w") as f:
                        f.write('{"photoTakenTime":{"timestamp":"%d"}}' % (1_500_000_000 + i))
            yield pdf

    table(spark, sf_dir, "pages").select("page_id").mapInPandas(put, "page_id bigint").foreach(lambda _: None)
    first, second = importing.import_library(spark, root), importing.import_library(spark, root, dry_run=True)
    row = (first["files"], first["matched"], first["unmatched"], first["outcomes"].get("set", 0), second["already_correct"])
    return spark.createDataFrame([row], "files bigint, matched bigint, unmatched bigint, set_ bigint, right_afterwards bigint")


@query("s53_report", "SELECT 'files' AS section, '' AS name, count(*) AS n FROM file_hashes UNION ALL SELECT 'type', ext_, count(*) FROM (SELECT coalesce(lower(nullif(ext, '')), '(none)') || ' ' || coalesce(nullif(mime, ''), '(unknown)') AS ext_, size_bytes FROM file_hashes) GROUP BY ext_ UNION ALL SELECT 'model', model_id, count(*) FROM emb GROUP BY model_id UNION ALL SELECT 'command', c || ' ' || s, 1 FROM (VALUES ('scan','success'),('faces','crashed'),('embed','success'),('classify','never'),('dedupe','failed'),('fix-dates','never'),('prune','never'),('locations','never')) t(c, s)")
def report(lib):
    return lib.report(types=1000)


# --- pixels -----------------------------------------------------------------


@query("v26_image_tensor", "SELECT id, round((id % 256 / 255.0 - 0.5) / 0.5, 5) AS low, round((id % 256 / 255.0 - 0.5) / 0.5, 5) AS high, 3 * 16 * 16 AS numbers FROM faces")
def image_tensor(lib):
    """Images of one shade, resized and scaled."""

    def run(batches):
        for pdf in batches:
            t = [imaging.image_to_tensor(np.full((20 + i % 9, 30, 3), i % 256, np.uint8), 16) for i in pdf["id"].tolist()]
            yield pdf[["id"]].assign(low=[round(float(x.min()), 5) for x in t], high=[round(float(x.max()), 5) for x in t], numbers=[x.size for x in t])

    return lib.faces.select("id").mapInPandas(run, "id bigint, low double, high double, numbers int")


@query("v28_similarity_transform", "SELECT id, round((1 + id % 7) * cos(radians(id % 360)), 6) AS a, round((1 + id % 7) * sin(radians(id % 360)), 6) AS b, round(CAST(id AS DOUBLE), 6) AS dx FROM faces")
def transform(lib):
    """Landmarks turned, scaled and shifted; the map that undoes nothing else is found."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"].tolist():
                turn, size = np.radians(i % 360), 1 + i % 7
                m = size * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
                got = imaging.similarity_transform(imaging.ALIGNED, imaging.ALIGNED @ m.T + [i, -i])
                out.append((i, *(round(float(x), 6) + 0.0 for x in (got[0, 0], got[1, 0], got[0, 2]))))
            yield pd.DataFrame(out, columns=["id", "a", "b", "dx"])

    return lib.faces.select("id").mapInPandas(run, "id bigint, a double, b double, dx double")


@query("v32_orientation", "SELECT id, CASE id % 8 WHEN 0 THEN 'abcdef' WHEN 1 THEN 'cbafed' WHEN 2 THEN 'fedcba' WHEN 3 THEN 'defabc' WHEN 4 THEN 'adbecf' WHEN 5 THEN 'daebfc' WHEN 6 THEN 'fcebda' ELSE 'cfbead' END AS pixels, 40 AS side FROM faces")
def orientation(lib):
    """A 2 x 3 image with six different pixels, for each of the eight orientations; a square crop around a box."""

    def run(batches):
        for pdf in batches:
            image = np.arange(6).reshape(2, 3, 1)
            seen = ["".join("abcdef"[k] for k in imaging.orient(image, 1 + i % 8).ravel()) for i in pdf["id"].tolist()]
            crops = [imaging.crop_face(np.zeros((90, 120, 3)), (i % 100, i % 70, 20, 20), size=40).shape for i in pdf["id"].tolist()]
            yield pdf[["id"]].assign(pixels=seen, side=[s[0] if s[0] == s[1] else -1 for s in crops])

    return lib.faces.select("id").mapInPandas(run, "id bigint, pixels string, side int")


@query("v27_detections", "SELECT id, round((id % 8 * 8 - 4) / 0.5, 5) AS x1, round((id % 8 * 8 + 12) / 0.5, 5) AS x2, 1 AS faces FROM faces")
def detections(lib):
    """A detector's raw outputs with two overlapping hits, decoded at half scale; the better one stays."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"].tolist():
                scores, distances, offsets = np.zeros(128), np.zeros((128, 4)), np.zeros((128, 10))
                cell = 2 * (i % 8)
                scores[[cell, cell + 1]], distances[[cell, cell + 1]] = [0.9, 0.8], [0.5, 0.5, 1.5, 1.5]
                got = imaging.decode_detections({8: (scores, distances, offsets)}, 64, 0.5)
                out.append((i, round(got[0]["bbox"][0], 5), round(got[0]["bbox"][2], 5), len(got)))
            yield pd.DataFrame(out, columns=["id", "x1", "x2", "faces"])

    return lib.faces.select("id").mapInPandas(run, "id bigint, x1 double, x2 double, faces int")


def _number(path: str) -> int:
    return int(path.rsplit("/", 1)[1].split(".")[0])


def _load(path: str) -> np.ndarray:
    i = _number(path)
    if i % 7 == 0:
        raise OSError("damaged")
    image = np.zeros((64, 64, 3))
    if i % 5:
        image[i % 20 : i % 20 + 30, i % 13 : i % 13 + 30] = 50 + i % 200
    return image


def _detect(image: np.ndarray) -> list[dict]:
    """One face: the box of all bright pixels."""
    ys, xs = np.nonzero(image[:, :, 0])
    if not len(ys):
        return []
    x, y, w, h = xs.min(), ys.min(), xs.max() + 1 - xs.min(), ys.max() + 1 - ys.min()
    marks = [[x + w * a, y + h * b] for a, b in ((0.3, 0.4), (0.7, 0.4), (0.5, 0.6), (0.35, 0.8), (0.65, 0.8))]
    return [{"bbox": [x, y, x + w, y + h], "score": 0.9, "landmarks": marks}]


def _embed(faces: list[np.ndarray]) -> np.ndarray:
    return np.array([[f.mean(), f.std(), f[56, 56, 0], 1.0] for f in faces])


_FIRST = "(SELECT hash, CAST(regexp_extract(min(path), '/([0-9]+)\\.', 1) AS BIGINT) AS i FROM file_hashes GROUP BY hash)"


def _detected(lib):
    from argentum.operators.pending import first_path_by_hash

    return materialize(face_job.detect_faces(first_path_by_hash(lib.file_hashes), _load, _detect, _embed), "detected")


@query("v30_face_pipeline", f"SELECT hash, CASE WHEN i % 7 <> 0 AND i % 5 <> 0 THEN CAST(i % 13 AS VARCHAR) || ',' || CAST(i % 20 AS VARCHAR) || ',30,30' END AS bbox, i % 7 = 0 AS failed FROM {_FIRST}")
def face_pipeline(lib):
    """Loading, detection, alignment and vectors with stand-ins for the models."""
    return _detected(lib).select("hash", "bbox", F.col("error").isNotNull().alias("failed"))


@query("v29_face_vectors", f"SELECT hash, 1.0::DOUBLE AS length, CAST(row_number() OVER (ORDER BY hash) + 9 AS BIGINT) AS id FROM {_FIRST} WHERE i % 7 <> 0 AND i % 5 <> 0")
def face_vectors(lib):
    """Unit vectors of aligned faces, numbered in order of content."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return face_job.faces_of(_detected(lib), 10).select("hash", F.round(F.sqrt(square), 4).alias("length"), "id")


@query("v30_scan_marks", f"SELECT hash FROM {_FIRST} WHERE i % 7 <> 0")
def scan_marks(lib):
    return face_job.scanned_of(_detected(lib))


# --- surfaces ---------------------------------------------------------------


@query("t09_locks", "SELECT * FROM (VALUES ('scan', true, 'RuntimeError', false), ('embed', true, 'RuntimeError', false)) t(command, held, second, after_)")
def locks(lib):
    held = ledger.Locks(_folder(lib.spark, "locks"))
    rows = []
    for command in ("scan", "embed"):
        with held.hold(command):
            during = held.is_locked(command)
            try:
                with held.hold(command):
                    second = "held"
            except RuntimeError:
                second = "RuntimeError"
        rows.append((command, during, second, held.is_locked(command)))
    return lib.spark.createDataFrame(rows, "command string, held boolean, second string, after_ boolean")


@query("t11_progress", "SELECT 'scan ' || CAST(k AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS line FROM (SELECT count(*) AS n FROM file_hashes), range(1, 100000000) r(k) WHERE k <= n AND (k % 25 = 0 OR k = n)")
def progress(lib):
    n, out = lib.file_hashes.count(), io.StringIO()
    bar = Progress(n, "scan", out, terminal=False)
    for _ in range(n):
        bar.add()
    return lib.spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


def _stored(lib, *names: str) -> Library:
    """A library in a folder of its own, with copies of some tables."""
    own = Library(lib.spark, home=_folder(lib.spark, "home"), model="acme/base-224")
    for name in names:
        own.write(name, lib.table(name))
    return own


@query("u08_command_line", "SELECT path AS line FROM (SELECT path, row_number() OVER (PARTITION BY hash ORDER BY coalesce(CASE WHEN exif_date IS NOT NULL AND exif_date NOT LIKE '0000%' THEN exif_date END, least(created_at, modified_at), ''), path) AS rn FROM file_hashes) WHERE rn > 1")
def command_line(lib):
    """What the command prints about a stored library."""
    own = _stored(lib, "file_hashes")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        cli.main(["--home", own.home, "dedupe"], lib.spark)
    return lib.spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


@query("u08_commands", "SELECT * FROM (VALUES ('classify'), ('config'), ('dedupe'), ('embed'), ('faces'), ('fix-dates'), ('gallery'), ('import'), ('locations'), ('mcp'), ('prune'), ('scan'), ('search'), ('stats'), ('watch')) t(command)")
def commands(lib):
    """The commands besides the engine's own three (people, sql, status)."""
    names = set(next(a for a in cli.parser()._actions if a.dest == "command").choices) - {"people", "sql", "status"}
    return lib.spark.createDataFrame([(n,) for n in sorted(names)], "command string")


@query("u09_config", "SELECT * FROM (VALUES ('explicit', 'explicit', NULL), ('environment', 'home', 'configured'), ('configured', 'configured', NULL), ('none', 'home', NULL)) t(case_, used, passed_over)")
def configuration(lib):
    root = _folder(lib.spark, "home")
    with open(f"{root}/config.toml", "w") as f:
        f.write('default_library = "configured"\n')
    named, bare = {config.HOME_VARIABLE: root}, _folder(lib.spark, "bare")
    got = {"explicit": config.resolve_library("explicit", named), "environment": config.resolve_library(None, named), "configured": (config.load_config(root).default_library, None), "none": config.resolve_library(None, {config.HOME_VARIABLE: bare})}
    said = lambda p: None if p is None else "home" if p in (root, bare) else p
    return lib.spark.createDataFrame([(k, said(a), said(b)) for k, (a, b) in got.items()], "case_ string, used string, passed_over string")


_ROUTES = """SELECT 'files' AS route, CAST(least(200, count(*)) AS BIGINT) AS n FROM file_hashes UNION ALL SELECT 'date', least(200, count(DISTINCT hash)) FROM file_hashes
UNION ALL SELECT 'people', count(DISTINCT person_label) FROM faces WHERE confirmed = 1 AND person_label IS NOT NULL
UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM faces WHERE cluster_id IS NOT NULL AND (confirmed = 0 OR person_label IS NULL)
UNION ALL SELECT 'cluster 3', least(500, count(*)) FROM faces JOIN file_hashes USING (hash) WHERE cluster_id = 3
UNION ALL SELECT 'person_0', least(500, count(*)) FROM faces JOIN file_hashes USING (hash) WHERE confirmed = 1 AND person_label = 'person_0'
UNION ALL SELECT 'search person_2', least(500, count(DISTINCT path)) FROM faces JOIN file_hashes USING (hash) WHERE confirmed = 1 AND person_label = 'person_2'
UNION ALL SELECT 'location', count(DISTINCT hash) FROM file_hashes WHERE path = (SELECT min(path) FROM file_hashes)
UNION ALL SELECT 'raw', 404 UNION ALL SELECT 'none', 404"""


@query("u06_read_routes", _ROUTES)
def read_routes(lib):
    """Every read route of the page; refusals count as their status."""
    first = lib.file_hashes.agg(F.min_by("hash", "path").alias("h")).head().h
    asked = {"files": ("/api/files", "files"), "date": ("/api/files?view=date", "files"), "people": ("/api/faces", "people"), "clusters": ("/api/faces", "clusters"), "cluster 3": ("/api/cluster/3", "faces"), "person_0": ("/api/person/person_0", "faces"), "search person_2": ("/api/search/person?name=person_2", "files"), "location": (f"/api/location?hash={first}", None), "raw": ("/api/raw?path=/etc/hostname", None), "none": ("/api/none", None)}
    rows = []
    for name, (url, field) in asked.items():
        try:
            got = api.get(lib, url)
            rows.append((name, len(got[field]) if field else 1))
        except LookupError:
            rows.append((name, 404))
    return lib.spark.createDataFrame(rows, "route string, n bigint")


_AFTER = """SELECT id, CASE WHEN id IN (1, 2) THEN 'person_0' WHEN id = 10 THEN 'ada_lovelace' WHEN id = 3 OR person_label = 'person_5' THEN NULL ELSE person_label END AS person_label,
CASE WHEN id IN (1, 2, 10) THEN 1 WHEN id = 3 OR coalesce(person_label = 'person_5', false) THEN 0 ELSE confirmed END AS confirmed,
CASE WHEN id = 3 OR cluster_id = 4 THEN NULL ELSE cluster_id END AS cluster_id,
CASE WHEN id = 3 OR (person_label = 'person_5' AND id NOT IN (1, 2, 10)) THEN 0 WHEN CASE WHEN id IN (1, 2) THEN 'person_0' WHEN id = 10 THEN 'ada_lovelace' ELSE person_label END = 'person_0' THEN CAST(id = 2 AS INTEGER) ELSE is_primary END AS is_primary FROM faces"""


@query("u07_write_routes", _AFTER)
def write_routes(lib):
    """All write routes, one after another, on a stored library; the faces afterwards."""
    own = _stored(lib, "faces", "people")
    for path, body in [
        ("/api/assign", {"ids": [1, 2], "name": "person_0"}), ("/api/new-person", {"ids": [10], "name": "Ada Lovelace"}), ("/api/remove-face", {"id": 3}), ("/api/delete-person", {"name": "person_5"}),
        ("/api/set-full-name", {"name": "person_1", "full_name": "Someone Else"}), ("/api/dissolve-cluster", {"cluster_id": 4}), ("/api/set-primary", {"name": "person_0", "id": 2}),
    ]:
        api.post(own, path, body)
    return own.faces.select("id", "person_label", "confirmed", "cluster_id", "is_primary")
