import hashlib
import io
import json
import os
import sqlite3
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from argentum import api, cli, mcp
from argentum.functions import media
from argentum.operators import pending
from argentum.operators.selection import PathSelection, Selection, expand_date, normalise_bound
from argentum.plans import config
from argentum.plans.library import Library, image_size, open_home, resolve_model
from argentum.queries.sources import exif_jpeg, movie
from argentum.sources import catalogs, importing, scan, sinks, takeout
from argentum.streaming import ledger, progress, watch


def test_scan_reads_metadata_and_skips_known(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.jpg": exif_jpeg("2020:05:06 07:08:09"), "sub/b.MOV": movie(), "c.txt": b"no", "d.png": b"\x89PNG\r\n\x1a\n" + bytes(9), "f.heic": b"garbage that is long enough"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.jpg", "b.MOV", "d.png", "f.heic"}
    assert got["a.jpg"].exif_date == "2020-05-06T07:08:09" and got["a.jpg"].mime == "image/jpeg" and abs(got["a.jpg"].gps_lat - 48.856667) < 1e-6
    assert got["b.MOV"].mime == "video/quicktime" and got["b.MOV"].width == 1920 and got["b.MOV"].codec == "avc1" and got["b.MOV"].ext == "mov"
    assert got["f.heic"].mime == "application/octet-stream"
    known = spark.createDataFrame([(got["a.jpg"].path,)], "path string")
    assert scan.scan(spark, str(tmp_path), known, PathSelection(kinds=["image"])).count() == 2


def test_scan_takes_large_and_empty_files(spark, tmp_path):
    head, moov = movie()[:16], movie()[16:]
    assert moov[4:8] == b"moov"
    large = 3 << 30
    with (tmp_path / "large.mov").open("wb") as f:  # ftyp, 3 GiB of mdat with a long size, moov
        f.write(head + (1).to_bytes(4, "big") + b"mdat" + large.to_bytes(8, "big"))
        f.seek(len(head) + large)
        f.write(moov)
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "link.jpg").symlink_to(tmp_path / "empty.jpg")
    got = {os.path.basename(r.path): r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"large.mov", "empty.jpg"}
    big, none = got["large.mov"], got["empty.jpg"]
    assert big.error is None and (big.size_bytes, big.mime, big.codec, big.duration_secs) == (len(head) + large + len(moov), "video/quicktime", "avc1", 2.5)
    assert len(big.hash) == 64 and (none.hash, none.size_bytes, none.mime, none.error) == (hashlib.sha256(b"").hexdigest(), 0, None, None)


def test_files_that_hang_or_are_gone_become_errors(spark, tmp_path):
    os.mkfifo(tmp_path / "hangs.mov")
    (tmp_path / "a.jpg").write_bytes(exif_jpeg("2020:05:06 07:08:09"))
    files = spark.createDataFrame([(str(tmp_path / n), 1) for n in ("hangs.mov", "gone.jpg", "a.jpg")], "path string, size_bytes bigint").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS modified")
    got = {os.path.basename(r.path): r for r in scan.file_records(files, floor_s=0.5).collect()}
    assert got["hangs.mov"].hash is None and "TimeoutError" in got["hangs.mov"].error
    assert got["gone.jpg"].hash is None and "FileNotFoundError" in got["gone.jpg"].error
    assert got["a.jpg"].exif_date == "2020-05-06T07:08:09" and got["a.jpg"].error is None


def test_scan_through_spark_equals_scan_of_paths(spark, tmp_path, monkeypatch):
    for name, data in {"a.jpg": exif_jpeg("2020:05:06 07:08:09"), "b.mov": movie(), "c.png": b"\x89PNG\r\n\x1a\n" + bytes(9), "d.mov": movie()[:16] + (9_000_008).to_bytes(4, "big") + b"free" + bytes(9_000_000) + movie()[16:]}.items():
        (tmp_path / name).write_bytes(data)
    names = [c for c in scan.scan(spark, str(tmp_path)).columns]
    want = sorted(tuple(r) for r in scan.scan(spark, str(tmp_path)).collect())
    monkeypatch.setattr(scan, "mounted", lambda root: None)
    got = [{n: r[n] for n in names} for r in scan.scan(spark, f"file:{tmp_path}").collect()]
    for r in got:
        r["path"] = r["path"].replace("file:", "")
        r["modified_at"] = next(w[names.index("modified_at")] for w in want if w[0] == r["path"])[:23] + r["modified_at"][23:]
    cut = lambda rows: sorted((r["path"], r["hash"], r["size_bytes"], r["mime"], r["exif_date"] or "", r["codec"] or "", r["error"] or "") for r in rows)
    assert cut(got) == cut([dict(zip(names, w)) for w in want])


def test_movie_boxes_and_damage():
    m = media.read_video(movie())
    assert (m["duration_secs"], m["width"], m["codec"], m["gps_lat"]) == (2.5, 1920, "avc1", 48.8566)
    for cut in range(0, len(movie()), 7):
        media.read_video(movie()[:cut])
        media.read_exif(exif_jpeg("2020:05:06 07:08:09")[:cut])
    assert media.read_exif(exif_jpeg("0000:00:00 00:00:00"))["exif_date"] is None
    assert media.read_exif(exif_jpeg("2020:05:06 07:08:09", ref=b"S"))["gps_lat"] < 0
    assert media.iso6709("+10+20") == (10.0, 20.0) and media.iso6709("+10") is None and media.iso6709("+10+200") is None


def test_dhash_tells_directions():
    ramp = np.tile(np.arange(64), (64, 1))
    assert media.dhash(ramp) == 0 and media.dhash(ramp[:, ::-1]) == -1


@pytest.mark.parametrize(
    ("name", "sidecars", "status", "hit"),
    [
        ("a.jpg", ["a.jpg.supplemental-metadata.json", "a.jpg.json"], "found", "a.jpg.supplemental-metadata.json"),
        ("a.jpg", ["a.jpg.json", "a.jpg.x.json"], "found", "a.jpg.json"),
        ("a.jpg", ["a.jpg.supp.json"], "found", "a.jpg.supp.json"),
        ("a.jpg", ["a.jpg.s.json", "a.jpg.t.json"], "ambiguous", None),
        ("a.jpg", ["ab.jpg.json"], "missing", None),
        ("a(1).jpg", ["a.jpg(1).json", "a.jpg.json"], "found", "a.jpg(1).json"),
        ("a(1).jpg", ["a.jpg.supplemental(1).json", "a.jpg.json"], "found", "a.jpg.supplemental(1).json"),
        ("a(1).jpg", ["a.jpg.json"], "found", "a.jpg.json"),
        ("a-edited.jpg", ["a.jpg.json"], "found", "a.jpg.json"),
        ("a-edited(2).jpg", ["a.jpg.json"], "found", "a.jpg.json"),
        ("Trip (Copenhagen).jpg", ["Trip.jpg.json"], "missing", None),
        ("a.jpg", ["metadata.json"], "missing", None),
    ],
)
def test_sidecar_rules(spark, name, sidecars, status, hit):
    listing = spark.createDataFrame([("d", s) for s in sidecars] + [("other", name + ".json")], "dir string, name string")
    got = takeout.match_sidecars(spark.createDataFrame([("d", name)], "dir string, name string"), takeout.sidecar_index(listing)).head()
    assert (got.status, got.sidecar) == (status, hit)


def test_catalog(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.lrcat")
    con.executescript("""CREATE TABLE AgLibraryFile(id_local, folder); CREATE TABLE AgLibraryFolder(id_local, rootFolder, pathFromRoot); CREATE TABLE AgLibraryRootFolder(id_local, absolutePath);
    INSERT INTO AgLibraryFile VALUES (1, 10), (2, 10), (3, 11); INSERT INTO AgLibraryFolder VALUES (10, 5, 'a/'), (11, 5, ''), (12, 5, 'unused/'); INSERT INTO AgLibraryRootFolder VALUES (5, '/p/');""")
    con.commit()
    tables = catalogs.catalog_tables(spark, catalogs.find_catalog(str(tmp_path)))
    assert [r.folder for r in catalogs.catalog_folders(tables).collect()] == ["/p", "/p/a"]
    assert catalogs.detect(str(tmp_path)) == "lightroom" and ("lightroom", str(tmp_path)) in catalogs.discover([str(tmp_path.parent)])
    con.execute("DROP TABLE AgLibraryFolder")
    con.commit()
    with pytest.raises(ValueError, match="AgLibraryFolder"):
        catalogs.catalog_tables(spark, str(tmp_path / "x.lrcat"))


def test_providers_and_layouts(tmp_path):
    lib = tmp_path / "Pics.photoslibrary" / "originals"
    for c in "0123456789":
        (lib / c).mkdir(parents=True)
    assert catalogs.detect(str(lib.parent)) == "apple-photos" and catalogs.has_hex_fanout(str(lib))
    (tmp_path / "t" / "Photos").mkdir(parents=True)
    (tmp_path / "t" / "Photos" / "a.jpg.supplemental-metadata.json").write_text("{}")
    assert catalogs.detect(str(tmp_path / "t")) == "google-takeout"
    assert catalogs.locate(str(tmp_path / "t"), None, ["photos"])[0] == "layout" and catalogs.locate(str(tmp_path), None, ["zz"]) == ("ask", None)


def test_library_on_disk(spark, tmp_path):
    lib = Library(spark, home=str(tmp_path), model="a/b")
    assert lib.file_hashes.count() == 0
    rows = spark.createDataFrame([("/x.jpg", "h1", 5), ("/y.jpg", "h1", 5)], "path string, hash string, size_bytes bigint")
    lib.upsert("file_hashes", rows, ["path"])
    lib.upsert("file_hashes", spark.createDataFrame([("/y.jpg", "h2", 7)], "path string, hash string, size_bytes bigint"), ["path"])
    assert sorted((r.path, r.hash) for r in lib.file_hashes.collect()) == [("/x.jpg", "h1"), ("/y.jpg", "h2")]
    lib.upsert("embeddings", spark.createDataFrame([("a/b", "h1", [1.0, 0.0], "t"), ("c/d", "h2", [0.0, 1.0], "t")], "model_id string, hash string, embedding array<float>, embedded_at string"), ["model_id", "hash"])
    assert lib.model() == "a/b" and [r.model_id for r in lib.models().collect()] == ["a/b", "c/d"]
    with pytest.raises(LookupError, match="a/b, c/d"):
        lib.model("no/such")

    class One:
        def embed(self, text=None, image=None):
            return [1.0, 0.0]

    assert [r.path for r in lib.search(text="x", embedder=One()).collect()] == ["/x.jpg"]
    with pytest.raises(ValueError):
        lib.search()
    with pytest.raises(LookupError):
        lib.geocode("nowhere")
    assert lib.sql("SELECT count(*) AS n FROM file_hashes").head().n == 2
    assert open_home(spark, str(tmp_path)).file_hashes.count() == 2


def test_ledger_records_runs(spark, tmp_path):
    lib = Library(spark, home=str(tmp_path / "lib"))
    locks = ledger.Locks(str(tmp_path / "locks"))
    book = ledger.Ledger(spark, lambda: lib.pipeline_runs, lambda df: lib.write("pipeline_runs", df), locks)
    with book.track("scan") as note:
        assert {r.command: r.state for r in book.status().collect()}["scan"] == "running"
        with pytest.raises(RuntimeError), book.track("scan"):
            pass
        note["summary"] = "3 files"
    with pytest.raises(ZeroDivisionError), book.track("embed"):
        1 / 0
    got = {r.command: (r.status, r.summary) for r in lib.pipeline_runs.collect()}
    assert got["scan"] == ("success", "3 files") and got["embed"][0] == "failed"
    assert ledger.has_problem(book.status()).head().has_problem
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.lock").write_text("")
    assert locks.clear_legacy(str(tmp_path / "old")) == ["x.lock"]


def test_dates_are_written_back(spark, tmp_path):
    p = tmp_path / "a.jpg"
    p.write_bytes(b"x")
    plan = spark.createDataFrame([(str(p), "2020-05-06T07:08:09"), (str(tmp_path / "gone.jpg"), "2020-05-06T07:08:09"), (str(p), "bad")], "path string, taken string")
    assert sorted(r.outcome for r in sinks.apply_dates(plan.coalesce(1)).collect()) == ["error", "set", "skipped"]
    assert p.stat().st_mtime > 1_588_000_000
    assert sinks.disk_usage({"a": (str(p), True), "all": (str(tmp_path), False)})[0][1] >= 1


def test_html_page(spark, tmp_path):
    groups = spark.createDataFrame([("h", "/a<b>", ["/c"], 5)], "hash string, keep string, remove array<string>, waste bigint")
    sinks.html_page(groups, str(tmp_path / "p.html"))
    text = (tmp_path / "p.html").read_text()
    assert "/a&lt;b&gt;" in text and "/c" in text
    sinks.html_page(groups, str(tmp_path / "l.html"), live=True)
    assert "/c" not in (tmp_path / "l.html").read_text()


def test_dates_and_names_of_models():
    assert expand_date("2020-12") == ("2020-12-01T00:00:00", "2021-01-01T00:00:00") and normalise_bound("2020-01-01T05:00:00") == "2020-01-01T05:00:00"
    for bad in ("", "x", "2020-13", "2020-02-30", "1-2-3-4"):
        with pytest.raises(ValueError):
            expand_date(bad)
    assert image_size("a/b-384") == 384 and resolve_model() == "google/siglip-base-patch16-224"
    assert Selection().is_empty() and not Selection(exts=["jpg"]).is_empty()


def test_upsert_leaves_one_row_of_a_key(spark):
    old = spark.createDataFrame([("a", "h0", 0), ("b", "h0", 0)], "path string, hash string, at int")
    new = spark.createDataFrame([("a", "h1", 1), ("a", "h9", 3), ("a", "h2", 2), ("c", "h3", 1), ("c", "h3", 1)], "path string, hash string, at int").repartition(3)
    rows = lambda df: sorted((r.path, r.hash) for r in df.collect())
    assert rows(pending.upsert(old, new, ["path"], "at")) == [("a", "h9"), ("b", "h0"), ("c", "h3")]
    assert rows(pending.upsert(old, new.drop("at"), ["path"])) == [("a", "h9"), ("b", "h0"), ("c", "h3")]
    assert pending.upsert(old, new.select("path"), ["path"]).count() == 3


def test_a_replacement_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch):
    rows = lambda n: spark.createDataFrame([("/x.jpg", f"h{n}", 5)], "path string, hash string, size_bytes bigint")
    lib = Library(spark, home=str(tmp_path))
    lib.write("file_hashes", rows(1))
    real = Library._move
    for broken_at in (1, 2):
        moves = []
        monkeypatch.setattr(Library, "_move", lambda self, a, b: moves.append(a) or (real(self, a, b) if len(moves) < broken_at else 1 / 0))
        with pytest.raises(ZeroDivisionError):
            Library(spark, home=str(tmp_path)).write("file_hashes", rows(2))
        monkeypatch.setattr(Library, "_move", real)
        assert [r.hash for r in Library(spark, home=str(tmp_path)).file_hashes.collect()] == ["h1"]
    Library(spark, home=str(tmp_path)).write("file_hashes", rows(3))
    assert [r.hash for r in Library(spark, home=str(tmp_path)).file_hashes.collect()] == ["h3"]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".old")]


def test_a_failed_stage_gets_its_batches_again(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    seen, broken = [], [True]

    def stage(batch, batch_id):
        if broken[0]:
            raise OSError("disk full")
        seen.append((batch_id, sorted(r.x for r in batch.collect())))

    def cycle(x=None):
        if x is not None:
            spark.createDataFrame([(x,)], "x int").write.mode("append").parquet(str(drop))
        q = watch.watch(spark.readStream.schema("x int").parquet(str(drop)), [("never", lambda b, i: 1 / 0), ("stage", stage)], str(out / "checkpoint"), once=True)
        q.awaitTermination()

    cycle(1)
    cycle(2)
    assert seen == []
    broken[0] = False
    cycle(3)
    assert seen == [(0, [1]), (1, [2]), (2, [3])]
    cycle()
    assert len(seen) == 3 and len(list((out / "checkpoint-failed" / "never").iterdir())) == 3


def test_import_of_an_export_sets_dates(spark, tmp_path):
    album = tmp_path / "Takeout" / "Google Photos" / "2020"
    album.mkdir(parents=True)
    for i in range(6):
        (album / f"{i}.jpg").write_bytes(exif_jpeg("2020:05:06 07:08:09"))
        if i < 4:
            (album / f"{i}.jpg.supplemental-metadata.json").write_text('{"photoTakenTime":{"timestamp":"%d"},"geoData":{"latitude":1.5,"longitude":2.0}}' % (1_500_000_000 + i))
    os.utime(album / "0.jpg", (1_500_000_000, 1_500_000_000))
    dry = importing.import_library(spark, str(tmp_path), dry_run=True)
    assert {k: dry[k] for k in ("provider", "files", "matched", "unmatched", "pending", "already_correct", "with_location")} == {"provider": "google-takeout", "files": 6, "matched": 4, "unmatched": 2, "pending": 3, "already_correct": 1, "with_location": 4}
    assert (album / "1.jpg").stat().st_mtime > 1_600_000_000
    assert importing.import_library(spark, str(tmp_path))["outcomes"] == {"set": 3}
    assert (album / "3.jpg").stat().st_mtime == 1_500_000_003
    with pytest.raises(LookupError):
        importing.import_library(spark, str(tmp_path / "Takeout" / "nothing"))
    assert importing.import_library(spark, str(tmp_path), "apple-photos", str(album))["files"] == 6


def test_provider_rules(tmp_path):
    lib = tmp_path / "any" / "Masters"
    lib.mkdir(parents=True)
    assert catalogs.detect(str(lib.parent)) is None
    (tmp_path / "any" / "database").mkdir()
    (tmp_path / "any" / "database" / "Photos.sqlite").write_bytes(b"")
    assert catalogs.detect(str(lib.parent)) == "apple-photos"
    for c in "0123456789":
        (tmp_path / "kept" / c).mkdir(parents=True)
    assert catalogs.detect(str(tmp_path / "kept")) == "apple-photos"
    for n in range(10):
        (tmp_path / "kept" / f"other{n}").mkdir()
    assert catalogs.detect(str(tmp_path / "kept")) is None
    (tmp_path / "c.lrcat").write_bytes(b"")
    assert catalogs.find_catalog(str(tmp_path / "c.lrcat")) == str(tmp_path / "c.lrcat") and catalogs.find_catalog(str(tmp_path / "d.lrcat")) is None
    assert catalogs.detect(str(tmp_path / "c.lrcat")) == "lightroom"


def test_config_and_which_library(tmp_path):
    home = str(tmp_path)
    named = {config.HOME_VARIABLE: home}
    assert config.load_config(home) == config.Config() and config.resolve_library(None, named) == (home, None)
    (tmp_path / "config.toml").write_text('default_library = "/data/lib"\nmin_read_rate_mb_s = 5\nunknown = 1\n')
    assert config.load_config(home).min_read_rate_mb_s == 5
    assert config.resolve_library(None, named) == (home, "/data/lib") and config.resolve_library("/x", named) == ("/x", None)
    for bad in ("default_library = 3", "min_read_rate_mb_s = 0", "min_read_rate_mb_s = true", "= broken"):
        (tmp_path / "config.toml").write_text(bad)
        with pytest.raises(ValueError):
            config.load_config(home)


def test_progress_lines():
    out = io.StringIO()
    p = progress.Progress(60, "scan", out, terminal=False)
    for _ in range(60):
        p.add()
    assert out.getvalue().splitlines() == ["scan 25/60", "scan 50/60", "scan 60/60"]
    bar = progress.Progress(2, "x", out := io.StringIO(), terminal=True)
    bar.add(), bar.add()
    assert out.getvalue().endswith("[####################] 2/2\n")


def test_commands(spark, tmp_path, capsys):
    media_dir, home = tmp_path / "media", str(tmp_path / "home")
    media_dir.mkdir()
    for name, data in {"a.jpg": exif_jpeg("2020:05:06 07:08:09"), "b.jpg": exif_jpeg("2020:05:06 07:08:09"), "c.mov": movie(), "d.png": b"\x89PNG\r\n\x1a\n" + bytes(9)}.items():
        (media_dir / name).write_bytes(data)

    def said(*args, code=0):
        assert cli.main(["--home", home, *args], spark) == code
        return capsys.readouterr().out

    assert said("scan", str(media_dir)).startswith("4\t")
    assert said("dedupe").split() == [str(media_dir / "b.jpg")]
    whole = json.loads(said("--json", "dedupe", "--similar"))
    assert whole["total_files"] == 4 and [g["remove"] for g in whole["duplicate_groups"]] == [[str(media_dir / "b.jpg")]] and whole["similar_groups"] == []
    embedder = ("--embedder", "argentum.operators.classify:stand_in", "--model", "acme/base-224")
    assert len(said("embed", *embedder).split()) == 3
    assert said("embed", *embedder) == ""
    assert len(said("classify", *embedder, "--margin", "0").split("\n")) > 1
    assert f"library\t{home}" in said("config")
    (media_dir / "d.png").unlink()
    assert said("prune", "--dry-run").split() == [str(media_dir / "d.png"), "remove"]
    assert said("prune") != "" and said("stats").startswith("3\t")
    (media_dir / "e.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(19))
    assert said("watch", str(media_dir), "--once").startswith("4\t")
    assert "google" not in said("import", str(media_dir), "--provider", "apple-photos", "--originals", str(media_dir))
    said("embed", "--embedder", "nothing", code=1)
    said("gallery", code=1)
    said("import", str(media_dir), code=1)
    page = str(tmp_path / "page.html")
    said("gallery", page)
    assert "b.jpg" in open(page).read()


def test_tools_answer_messages(spark, tmp_path):
    lib = Library(spark, {"file_hashes": spark.createDataFrame([("/a.jpg", "h", 5, "jpg"), ("/b.jpg", "h", 5, "jpg")], "path string, hash string, size_bytes bigint, ext string").selectExpr("*", *(f"CAST(NULL AS {t}) AS {n}" for n, t in (("created_at", "string"), ("modified_at", "string"), ("mime", "string"), ("phash", "bigint"), ("exif_date", "string"))))})
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), ask(3, "tools/call", name="find_duplicates", arguments={}), ask(4, "tools/call", name="search", arguments={"exts": ["jpg"], "k": 1}), ask(5, "tools/call", name="search"), ask(6, "nothing"), "{"]
    out = io.StringIO()
    mcp.serve(lib, lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None]
    assert {t["name"] for t in got[1]["result"]["tools"]} == set(mcp.TOOLS)
    assert json.loads(got[2]["result"]["content"][0]["text"])["duplicate_groups"][0]["remove"] == ["/b.jpg"]
    assert [r["path"] for r in json.loads(got[3]["result"]["content"][0]["text"])["results"]] == ["/a.jpg"]
    assert got[4]["result"]["isError"] and "error" in got[5] and "error" in got[6]


def test_server_answers_and_refuses(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"pixels")
    lib = Library(spark, home=str(tmp_path / "home"))
    lib.write("file_hashes", spark.createDataFrame([(str(tmp_path / "x.jpg"), "ab", 6, "jpg", "image/jpeg")], "path string, hash string, size_bytes bigint, ext string, mime string"))
    lib.write("faces", spark.createDataFrame([(1, "ab", 4, 0), (2, "ab", 4, 0)], "id bigint, hash string, cluster_id bigint, confirmed int"))
    with api.server(lib) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"
        ask = lambda path, body=None: json.load(urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode())))
        assert ask("/api/files")["files"][0]["hash"] == "ab" and len(ask("/api/cluster/4")["faces"]) == 2
        assert urllib.request.urlopen(f"{base}/api/raw?path={tmp_path}/x.jpg").read() == b"pixels"
        assert ask("/api/new-person", {"ids": [1], "name": "Ada L"}) == {"ok": True}
        assert len(ask("/api/faces")["people"]) == 1 and ask("/api/location?hash=ab")["gps_lat"] is None
        for path, body, code in (("/api/raw?path=/etc/passwd", None, 404), ("/api/location?hash=x'", None, 400), ("/none", None, 404), ("/api/assign", {"ids": [1]}, 400), ("/api/set-primary", {"name": "nobody", "id": 1}, 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(path, body)
            assert e.value.code == code
        server.shutdown()
