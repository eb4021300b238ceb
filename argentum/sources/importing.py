"""Importing another program's library: where its originals are, which files they hold, and what dates its sidecars know."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.sources import catalogs, scan, sinks, takeout
from argentum.storage import materialize

#: Folders of originals below a library, by provider.
LAYOUTS = {"apple-photos": catalogs.ORIGINALS, "google-takeout": catalogs.EXPORTS, "lightroom": []}


def catalog_roots(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(folder, whether it is there now) of a catalog's folders."""
    path = catalogs.find_catalog(root)
    if path is None:
        return []
    folders = catalogs.catalog_folders(catalogs.catalog_tables(spark, path))
    return [(r.folder, os.path.isdir(r.folder)) for r in folders.collect()]


def locate_originals(spark: SparkSession, root: str, provider: str, originals: str | None = None) -> tuple[str, list[str]]:
    """(how, folders): the given folder, the catalog's folders that are there, a known layout, or the folder itself."""
    if originals is not None:
        return "given", [originals]
    if provider == "lightroom":
        there = [folder for folder, online in catalog_roots(spark, root) if online]
        if there:
            return "catalog", there
    how, where = catalogs.locate(root, None, LAYOUTS[provider])
    if where is not None:
        return how, [where]
    if catalogs.has_hex_fanout(root) or (provider == "google-takeout" and catalogs.is_takeout(root)):
        return "folder", [root]
    raise LookupError(f"no originals found in {root!r}; name their folder")


def recovered_dates(spark: SparkSession, root: str, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, counts, survey) of an export: (path, taken) to be written, and how many there are of what."""
    split = lambda c: (F.regexp_extract(c, r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(c, r"([^/]*)$", 1).alias("name"))
    media = files.select(*split("path"), F.floor(F.col("modified").cast("double")).cast("bigint").alias("mtime"))
    listing = scan.listing(spark, root).where(F.lower("path").endswith(".json")).select(*split("path"))
    matches = materialize(takeout.match_sidecars(media.select("dir", "name"), takeout.sidecar_index(listing)), "sidecar-matches")
    wanted = matches.where("sidecar IS NOT NULL").withColumn("path", F.concat_ws("/", "dir", "sidecar"))
    texts = scan.small_texts(wanted.select("path").distinct())
    rows = takeout.parse_sidecars(wanted.join(texts, "path")).select("dir", "name", "taken", "lat").join(media, ["dir", "name"])
    pending, counts = takeout.recover_dates(rows.select(F.concat_ws("/", "dir", "name").alias("path"), "taken", "mtime", "lat"))
    return pending, counts, takeout.survey(matches)


def import_library(spark: SparkSession, root: str, provider: str | None = None, originals: str | None = None, dry_run: bool = False) -> dict:
    """Locate a library's originals, count its files, and set the dates that an export's sidecars know.

    Returns a summary: provider, root, via, roots, files, and for an export what
    matched, what was pending, and the outcomes of the writes (none in a dry run).
    """
    root = root.rstrip("/") or "/"
    provider = provider or catalogs.detect(root)
    if provider is None:
        raise LookupError(f"{root!r} is no library of {', '.join(catalogs.PROVIDERS)}")
    via, roots = locate_originals(spark, root, provider, originals)
    walked = [scan.walk(spark, r) for r in roots]
    files = walked[0]
    for more in walked[1:]:
        files = files.union(more)
    files = materialize(files.select("path", "size_bytes", "modified").distinct(), "import-files")
    out = {"provider": provider, "root": root, "via": via, "roots": roots, "files": files.count(), "dry_run": dry_run}
    if provider == "apple-photos":
        out |= catalogs.library_shape(files).select("optimised", "referenced").head().asDict()
    if provider != "google-takeout":
        return out
    pending, counts, survey = recovered_dates(spark, roots[0], files)
    pending = materialize(pending, "pending-dates")
    out |= survey.head().asDict() | counts.head().asDict()
    if not dry_run:
        done = sinks.apply_times(pending).groupBy("outcome").count().collect()
        out |= {"outcomes": {r.outcome: r["count"] for r in done}}
    return out
