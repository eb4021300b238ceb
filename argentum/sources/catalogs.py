"""Other importers: photo catalogs in SQLite, package shapes, provider detection and layouts."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalog's tables and the columns that are read from them.
CATALOG_TABLES = {"AgLibraryFile": ["id_local", "folder"], "AgLibraryFolder": ["id_local", "rootFolder", "pathFromRoot"], "AgLibraryRootFolder": ["id_local", "absolutePath"]}


def find_catalog(path: str) -> str | None:
    """The catalog itself, or a folder's first catalog by name."""
    if path.endswith(".lrcat"):
        return path if os.path.isfile(path) else None
    names = sorted(n for n in os.listdir(path) if n.endswith(".lrcat")) if os.path.isdir(path) else []
    return os.path.join(path, names[0]) if names else None


def catalog_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The catalog's tables, read from a private copy; a missing table or column is named."""
    with tempfile.TemporaryDirectory() as d:
        copy = shutil.copy(path, os.path.join(d, "copy.lrcat"))
        con = sqlite3.connect(copy)
        try:
            out = {}
            for name, columns in CATALOG_TABLES.items():
                there = {r[1] for r in con.execute(f"PRAGMA table_info({name})")}
                if missing := [c for c in columns if c not in there]:
                    raise ValueError(f"not a known catalog: {name} lacks {', '.join(missing)}")
                rows = con.execute(f"SELECT {', '.join(columns)} FROM {name}").fetchall()
                kinds = ", ".join(f"{c} {'string' if 'ath' in c else 'bigint'}" for c in columns)
                out[name] = spark.createDataFrame(rows, kinds)
            return out
        finally:
            con.close()


def catalog_folders(tables: dict[str, DataFrame]) -> DataFrame:
    """(folder): distinct folders of catalogued files, without trailing slashes, in order."""
    files, folders, roots = (tables[n] for n in CATALOG_TABLES)
    rows = files.select("folder").join(folders.withColumnRenamed("id_local", "folder"), "folder").join(roots.withColumnRenamed("id_local", "rootFolder"), "rootFolder")
    return rows.select(F.regexp_replace(F.concat("absolutePath", "pathFromRoot"), "/+$", "").alias("folder")).distinct().orderBy("folder")


def library_shape(sizes: DataFrame, package_bytes: int | None = None) -> DataFrame:
    """One row from sizes (size_bytes): files, bytes, lower median, and whether originals are elsewhere.

    A library is optimised if its median is below 300 KiB; it is referenced if it
    holds at most 100 files that make up less than a tenth of the package.
    """
    got = sizes.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size_bytes)").cast("bigint").alias("median"))
    total = F.lit(package_bytes) if package_bytes is not None else F.col("bytes")
    return got.select("files", "bytes", "median", F.coalesce(F.col("median") < 300 * 1024, F.lit(False)).alias("optimised"), ((F.col("files") <= 100) & (F.col("bytes") * 10 < total)).alias("referenced"))


def _folders(path: str) -> list[str]:
    try:
        return sorted(e.name for e in os.scandir(path) if e.is_dir())
    except OSError:
        return []


def has_hex_fanout(path: str) -> bool:
    """At least eight folders named by one hex digit, and most of the folders so named."""
    names = _folders(path)
    hexes = [n for n in names if len(n) == 1 and n in "0123456789abcdefABCDEF"]
    return len(hexes) >= 8 and len(hexes) * 2 > len(names)


# Names by which libraries and exports are told.
ORIGINALS = ["originals", "Masters", "Originals"]
PHOTOS_DATABASE, PACKAGE, EXPORTS, SIDECAR_MARK = "database/Photos.sqlite", ".photoslibrary", ["Google Photos", "Takeout/Google Photos"], ".supplemental-metadat"


def is_apple_photos(path: str) -> bool:
    """A package by name, a database beside originals, or a fan-out of originals, be it the folder itself."""
    inside = lambda name: os.path.isdir(os.path.join(path, name))
    complete = os.path.exists(os.path.join(path, PHOTOS_DATABASE)) and any(map(inside, ORIGINALS))
    older = inside("Masters") and inside("Database")
    return path.rstrip("/").endswith(PACKAGE) or complete or older or any(has_hex_fanout(os.path.join(path, n)) for n in ("", *ORIGINALS))


def is_lightroom(path: str) -> bool:
    """A catalog, or a folder that holds one."""
    return path.endswith(".lrcat") or find_catalog(path) is not None


def has_sidecars(path: str) -> bool:
    try:
        return any(SIDECAR_MARK in n for n in os.listdir(path))
    except OSError:
        return False


def is_takeout(path: str) -> bool:
    """An export's folder, or sidecars in the folder or in one of its first 64 folders."""
    if any(os.path.isdir(os.path.join(path, n)) for n in EXPORTS):
        return True
    return any(map(has_sidecars, [path, *(os.path.join(path, n) for n in _folders(path)[:64])]))


#: Providers in the order in which they are tried.
PROVIDERS: dict[str, Callable[[str], bool]] = {"apple-photos": is_apple_photos, "lightroom": is_lightroom, "google-takeout": is_takeout}


def detect(path: str) -> str | None:
    return next((name for name, fits in PROVIDERS.items() if fits(path)), None)


def discover(roots: list[str]) -> list[tuple[str, str]]:
    """(provider, path) of the roots and of the folders one level below them."""
    out = []
    for root in roots:
        for p in [root, *(os.path.join(root, n) for n in _folders(root))]:
            if (name := detect(p)) and (name, p) not in out:
                out.append((name, p))
    return out


def locate(path: str, database: str | None, layouts: list[str]) -> tuple[str, str | None]:
    """Where the originals are: the database's word, else a known folder layout, else ask."""
    if database and os.path.isdir(database):
        return "database", database
    below = {n.lower(): n for n in _folders(path)}
    for layout in layouts:
        if layout.lower() in below:
            return "layout", os.path.join(path, below[layout.lower()])
    return "ask", None
