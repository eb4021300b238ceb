"""Command line over the library: ``python -m argentum.cli COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from argentum import api, mcp
from argentum.functions import columns as C
from argentum.operators import duplicates, places, vectors
from argentum.operators import faces as face_ops
from argentum.operators.pending import prune_guard, prune_plan, upsert
from argentum.plans import config
from argentum.plans.library import Library, open_home, resolve_model
from argentum.sources import importing, sinks
from argentum.sources import scan as scan_source
from argentum.streaming import ledger
from argentum.streaming import watch as watching


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="argentum", description="Media-library analytics on Spark")
    p.add_argument("--home", help="folder of the library's tables")
    p.add_argument("--json", action="store_true", help="print one JSON document")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="read a folder of media into the library")
    scan.add_argument("folder")
    scan.add_argument("--retry-incomplete", action="store_true")
    search = sub.add_parser("search", help="paths that match all filters")
    for flag in ("person", "category", "date", "after", "before", "location", "sort", "model"):
        search.add_argument(f"--{flag}")
    for flag in ("type", "ext", "mime", "path"):
        search.add_argument(f"--{flag}", action="append", default=[])
    search.add_argument("--km", type=float, default=10.0)
    search.add_argument("-k", type=int, default=20)
    dedupe = sub.add_parser("dedupe", help="paths that could go")
    dedupe.add_argument("--similar", action="store_true")
    sub.add_parser("stats", help="totals").add_argument("--check", action="store_true", help="end with 1 if a command failed or crashed")
    sub.add_parser("status", help="last runs")
    where = sub.add_parser("locations", help="cluster places")
    where.add_argument("--km", type=float, default=50.0)
    sub.add_parser("faces", help="cluster faces")
    sub.add_parser("people", help="named people")
    gallery = sub.add_parser("gallery", help="a page of duplicates")
    gallery.add_argument("file", nargs="?")
    gallery.add_argument("--serve", type=int, metavar="PORT", help="answer the page's routes on this machine instead")
    fix = sub.add_parser("fix-dates", help="capture dates as file times")
    fix.add_argument("--dry-run", action="store_true")
    sub.add_parser("sql", help="a query over the tables").add_argument("text")
    bring = sub.add_parser("import", help="locate another program's originals and recover their dates")
    bring.add_argument("folder")
    bring.add_argument("--provider", choices=list(importing.LAYOUTS))
    bring.add_argument("--originals")
    bring.add_argument("--dry-run", action="store_true")
    prune = sub.add_parser("prune", help="drop rows of files that are gone")
    prune.add_argument("--dry-run", action="store_true")
    prune.add_argument("--force", action="store_true")
    prune.add_argument("--trust-missing-folders", action="store_true")
    for name, what in (("embed", "vectors of images and videos"), ("classify", "categories of embedded contents")):
        job = sub.add_parser(name, help=what)
        job.add_argument("--embedder", required=True, metavar="MODULE:FUNCTION", help="function(model, 'image' or 'text') that returns vectors for a list of items")
        job.add_argument("--model")
    sub.choices["embed"].add_argument("--batch", type=int, default=96)
    sub.choices["classify"].add_argument("--margin", type=float, default=0.05)
    sub.choices["classify"].add_argument("--reprocess", action="store_true")
    watch = sub.add_parser("watch", help="scan a folder's new files again and again")
    watch.add_argument("folder")
    watch.add_argument("--interval", type=int, default=watching.INTERVAL_S)
    watch.add_argument("--once", action="store_true")
    watch.add_argument("--prune", action="store_true")
    watch.add_argument("--embedder", metavar="MODULE:FUNCTION")
    sub.add_parser("config", help="home, library and model in use")
    sub.add_parser("mcp", help="answer a language-model client on standard input and output")
    return p


def load_embedder(spec: str, model: str, kind: str) -> Callable:
    """The vectors' function that ``module:function`` gives for a model and a kind of items."""
    module, colon, name = spec.partition(":")
    if not (module and colon and name):
        raise ValueError(f"an embedder is named module:function, not {spec!r}")
    try:
        return getattr(importlib.import_module(module), name)(model, kind)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no embedder {spec!r}: {e}") from e


def prune(lib: Library, dry_run: bool = False, force: bool = False, trust: bool = False):
    """(path, action) of files that are gone; unless dry, their rows and the vectors of contents without a file go."""
    files = lib.file_hashes
    parents = files.select(C.parent_folder("path").alias("path")).distinct()
    plan = prune_plan(files, scan_source.existing(files.select("path")), scan_source.existing(parents).withColumnRenamed("path", "parent"), trust)
    plan = lib.keep(plan, "prune-plan")
    if not dry_run:
        prune_guard(plan, files, force)
        lib.write("file_hashes", files.join(plan.where("action = 'remove'"), "path", "left_anti"))
        lib.write("embeddings", lib.embeddings.join(lib.file_hashes.where("hash IS NOT NULL").select("hash"), "hash", "left_semi").select(*lib.embeddings.columns))
    return plan.orderBy("path")


def watch_stages(lib: Library, a: argparse.Namespace) -> watching.Stages:
    """What a watch does with new files."""

    def scan(batch, _):
        wanted = batch.where(C.path_ext(batch["path"]).isin(scan_source.WALKED))
        lib.upsert("file_hashes", scan_source.file_records(wanted).where("hash IS NOT NULL").drop("error"), ["path"])

    stages = [("scan", scan)]
    if a.embedder:
        stages.append(("embed", lambda batch, _: lib.run_embed(load_embedder(a.embedder, resolve_model(None, lib.configured_model), "image"))))
    if a.prune:
        stages.append(("prune", lambda batch, _: prune(lib)))
    return stages


def run(lib: Library, a: argparse.Namespace):
    """The command's rows, or None for a command without any."""
    if a.command == "scan":
        known = lib.file_hashes.where("mime IS NOT NULL") if a.retry_incomplete else None
        new = scan_source.scan(lib.spark, a.folder, known).where("hash IS NOT NULL").drop("error")
        lib.write("file_hashes", upsert(lib.file_hashes, new, ["path"]))
        return lib.stats()
    if a.command == "search":
        filters = {"kinds": a.type, "exts": a.ext, "mimes": a.mime, "paths": a.path, "km": a.km}
        return lib.search(person=a.person, category=a.category, date=a.date, after=a.after, before=a.before, location=a.location, sort=a.sort, k=a.k, model=a.model, **filters)
    if a.command == "dedupe":
        if not a.json:
            return duplicates.losers(lib.file_hashes).orderBy("path")
        arrays = {"duplicate_groups": duplicates.group_documents(lib.file_hashes)}
        if a.similar:
            arrays["similar_groups"] = duplicates.similar_documents(lib.file_hashes)
        return sinks.frame(sys.stdout, {"total_files": lib.file_hashes.count()}, arrays)
    if a.command == "stats":
        if a.check and ledger.has_problem(ledger.status(lib.pipeline_runs)).head().has_problem:
            raise RuntimeError("a command failed or crashed")
        return lib.stats()
    if a.command == "locations":
        return places.summary_lines(lib.run_locations(a.km))
    if a.command == "gallery":
        if a.serve is None and not a.file:
            raise ValueError("a gallery needs a file to write, or --serve")
        if a.serve is not None:
            with api.server(lib, a.serve) as server:
                print(f"http://127.0.0.1:{server.server_address[1]}", flush=True)
                server.serve_forever()
        return sinks.html_page(duplicates.groups_by_waste(lib.file_hashes), a.file)
    if a.command == "fix-dates":
        plan = sinks.fix_dates_plan(lib.file_hashes)
        return plan if a.dry_run else sinks.apply_dates(plan)
    if a.command == "import":
        found = importing.import_library(lib.spark, a.folder, a.provider, a.originals, a.dry_run)
        return lib.spark.createDataFrame([(k, str(v)) for k, v in found.items()], "field string, value string")
    if a.command == "prune":
        return prune(lib, a.dry_run, a.force, a.trust_missing_folders)
    if a.command == "embed":
        model = resolve_model(a.model, lib.configured_model)
        return lib.run_embed(load_embedder(a.embedder, model, "image"), model, a.batch).select("hash")
    if a.command == "classify":
        texts = load_embedder(a.embedder, lib.model(a.model), "text")(list(vectors.PROMPTS.values()))
        prompts = {name: [float(x) for x in v] for name, v in zip(vectors.PROMPTS, texts)}
        return lib.run_classify(prompts, a.margin, a.reprocess, a.model).select("hash", "category")
    if a.command == "watch":
        stream = watching.media_stream(lib.spark, a.folder)
        watching.watch(stream, watch_stages(lib, a), f"{lib.home.rstrip('/')}/watch-checkpoint", a.once, a.interval).awaitTermination()
        return lib.stats()
    if a.command == "config":
        home, _ = config.resolve_home()
        rows = [("home", home), ("library", lib.home), ("model", resolve_model(None, lib.configured_model)), ("read rate", f"{config.load_config(home).min_read_rate_mb_s or scan_source.io.RATE_MB} MB/s")]
        return lib.spark.createDataFrame(rows, "setting string, value string")
    if a.command == "mcp":
        return mcp.serve(lib, sys.stdin, sys.stdout)
    return {
        "status": lambda: ledger.status(lib.pipeline_runs),
        "faces": lib.run_clustering,
        "people": lambda: face_ops.list_persons(lib.faces, lib.people),
        "sql": lambda: lib.sql(a.text),
    }[a.command]()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("argentum").getOrCreate()
    try:
        rows = run(open_home(spark, a.home), a)
        if rows is None:
            return 0
        found = (r.asDict(recursive=True) for r in rows.toLocalIterator())
        if a.json:
            print(sinks.envelope({"rows": list(found)}))
        else:
            for r in found:
                print("\t".join("" if v is None else str(v) for v in r.values()))
        return 0
    except (ValueError, LookupError, RuntimeError) as e:
        print(sinks.error_document(str(e)) if a.json else f"error: {e}", file=sys.stdout if a.json else sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())


