"""Scanning folders of media into file records.

Contents stay where they are: a task opens each of its files, digests it in
blocks, and reads of an image its head and of a movie its boxes by seeking, all
within the file's read budget.  Folders in stores that only Spark reads have their
digests from the JVM, and only heads and tails of the contents reach Python.
"""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.functions import media
from argentum.operators.selection import PathSelection
from argentum.sources import files as io
from argentum.sources.files import read_budget

#: Extensions that a walk takes; tif and m4v are not among them.
WALKED = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "mov", "heic", "mp4", "dng"]
#: Bytes of an image's head; bytes of each end of a content that comes through Spark; its largest content.
IMAGE_HEAD, ENDS, MOST_CONTENT = 16 << 20, 4 << 20, 2**31 - 1
_LISTED = "path string, size_bytes bigint, modified timestamp"
__all__ = ["WALKED", "existing", "file_records", "listing", "read_budget", "scan", "small_texts", "walk"]


def mounted(root: str) -> str | None:
    """The folder as a path of the file system, or null if it lies in another store."""
    root = re.sub(r"^file:/+", "/", root)
    return None if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) else root


def _listed(folder: str, deep: bool):
    """Regular files of a folder, links left out; what can't be read is passed over."""
    todo = [folder]
    while todo:
        try:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if deep:
                                todo.append(e.path)
                        elif e.is_file(follow_symlinks=False):
                            s = e.stat(follow_symlinks=False)
                            yield e.path, s.st_size, datetime.fromtimestamp(s.st_mtime_ns // 1000 / 1e6, UTC)
                    except OSError:
                        continue
        except OSError:
            continue


def _walk_mounted(spark: SparkSession, root: str) -> DataFrame:
    """Folders near the root are dealt out, each task walks its own."""
    want = 8 * spark.sparkContext.defaultParallelism
    shallow, level = [], [root]
    while level and len(level) < want:
        below = []
        for folder in level:
            try:
                with os.scandir(folder) as entries:
                    below += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
        shallow += level
        level = below
    folders = spark.createDataFrame([(p, False) for p in shallow] + [(p, True) for p in level], "folder string, deep boolean")

    def run(batches):
        for pdf in batches:
            for folder, deep in zip(pdf["folder"], pdf["deep"]):
                held = []
                for row in _listed(folder, bool(deep)):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["path", "size_bytes", "modified"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "size_bytes", "modified"])

    return folders.repartition(want).mapInPandas(run, _LISTED)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, modified) of all files below a folder."""
    if (folder := mounted(root)) is not None:
        return _walk_mounted(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def existing(paths: DataFrame) -> DataFrame:
    """(path) of those that are there now, as the tasks' file system sees them."""

    def run(batches):
        for pdf in batches:
            yield pdf[[os.path.lexists(p) for p in pdf["path"]]]

    return paths.select("path").mapInPandas(run, "path string")


def small_texts(paths: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(path, value) of small text files; one that can't be read, or is larger, has a null value."""

    def text(path: str) -> str | None:
        try:
            with io.opened(path) as f:
                return f.read(0, most).decode("utf-8", "replace") if f.size <= most else None
        except OSError:
            return None

    def run(batches):
        for pdf in batches:
            yield pdf[["path"]].assign(value=[text(p) for p in pdf["path"]])

    return paths.mapInPandas(run, "path string, value string")


def walk(spark: SparkSession, root: str, selection: PathSelection = PathSelection()) -> DataFrame:  # noqa: B008
    """(path, size_bytes, modified) of media files below a folder, empty ones included.

    In a store that only Spark reads there is ``content`` as well, unread unless a
    plan selects it and null over 2 GiB; Spark's reader leaves out empty files there.
    """
    if (folder := mounted(root)) is not None:
        rows = _walk_mounted(spark, folder)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        shown = ["path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
        rows = files.where(F.col("length") <= MOST_CONTENT).select(*shown, "content").union(files.where(F.col("length") > MOST_CONTENT).select(*shown, F.lit(None).cast("binary").alias("content")))
    return selection.apply(rows.where(C.path_ext(F.col("path")).isin(WALKED)))


_META = "path string, hash string, size_bytes bigint, created_at string, modified_at string, ext string, mime string, exif_date string, gps_lat double, gps_lon double, width int, height int, duration_secs double, codec string, error string"
_LOOKED = "path string, size_bytes bigint, modified timestamp, hash string, head binary, error string"


def _looked_at(files: DataFrame, rate_mb: int, floor_s: float) -> DataFrame:
    """Digest and first bytes of every file, or why there are none."""

    def look(path: str):
        try:
            size = io.within(io.STAT_S, lambda p, _: os.stat(p).st_size, path)
            return size, *io.within(read_budget(size, rate_mb, floor_s), io.digest, path), None
        except Exception as e:  # a file that can't be read must not fail the scan
            return None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            got = [look(p) for p in pdf["path"]]
            yield pdf[["path"]].assign(size_bytes=[n if g[0] is None else g[0] for g, n in zip(got, pdf["size_bytes"])], modified=pdf["modified"], hash=[g[1] for g in got], head=[g[2] for g in got], error=[g[3] for g in got])

    return files.select("path", "size_bytes", "modified").mapInPandas(run, _LOOKED)


def file_records(files: DataFrame, rate_mb: int = io.RATE_MB, floor_s: float = io.FLOOR_S) -> DataFrame:
    """File records: content digest, dates, sniffed type, then EXIF or movie metadata by effective type.

    A file without ``content`` is read from its path.  One that can't be read, or not
    within its budget, has no hash and says why in ``error``; one whose metadata
    can't be read keeps its record and says so there.
    """
    utc = F.concat(F.date_format(F.to_utc_timestamp("modified", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    through_spark = "content" in files.columns
    if through_spark:
        missing = F.when(F.col("content").isNull(), "OverflowError: larger than Spark reads in one piece")
        ends = [F.substring("content", 1, 64).alias("head"), missing.alias("error"), F.substring("content", 1, ENDS).alias("begin"), F.when(F.col("size_bytes") > ENDS, F.substring("content", -ENDS, ENDS)).alias("end")]
        rows = files.select("path", "size_bytes", "modified", F.sha2("content", 256).alias("hash"), *ends)
    else:
        rows = _looked_at(files, rate_mb, floor_s).select("*", F.lit(None).cast("binary").alias("begin"), F.lit(None).cast("binary").alias("end"))
    rows = rows.select("path", "hash", "size_bytes", F.lit(None).cast("string").alias("created_at"), utc.alias("modified_at"), C.path_ext(F.col("path")).alias("ext"), C.sniff(F.col("head")).alias("mime"), "error", "begin", "end")
    rows = rows.withColumn("mime", F.coalesce("mime", F.when(F.col("hash").isNotNull() & (F.col("size_bytes") > 0), C.UNKNOWN_MIME)))
    kind = C.effective_mime(F.col("mime"), F.col("ext"))
    known = F.when(kind.isin("image/jpeg", "image/tiff", "image/heic"), "image").when(kind.isin(C.VIDEO_MIMES), "video")
    rows = rows.withColumn("kind", F.when(F.col("hash").isNotNull() & (F.col("size_bytes") > 0), known))
    if through_spark:  # only what is parsed is sent
        rows = rows.withColumn("begin", F.when(F.col("kind").isNotNull(), F.col("begin"))).withColumn("end", F.when(F.col("kind") == "video", F.col("end")))

    def parse(kind: str, source) -> dict:
        return media.read_exif(source.read(0, min(source.size, IMAGE_HEAD))) if kind == "image" else media.read_video(source)

    def from_path(kind: str, path: str, _):
        with io.opened(path) as source:
            return parse(kind, source)

    def read(batches):
        names = [c.split(" ")[0] for c in _META.split(", ")]
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                got, error = {}, r["error"]
                try:
                    if r["kind"] and through_spark:
                        begin = bytes(r["begin"])
                        size = len(begin) if r["kind"] == "image" else int(r["size_bytes"])
                        got = parse(r["kind"], media.EndsSource(begin, bytes(r["end"] or b""), size))
                    elif r["kind"]:
                        got = io.within(read_budget(int(r["size_bytes"]), rate_mb, floor_s), from_path, r["kind"], r["path"])
                except Exception as e:  # a damaged file must not fail the scan
                    error = f"{type(e).__name__}: {e}"
                out.append([error if n == "error" else r[n] if n in r else got.get(n) for n in names])
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(read, _META)


def scan(spark: SparkSession, root: str, known: DataFrame | None = None, selection: PathSelection = PathSelection()) -> DataFrame:  # noqa: B008
    """Records of a folder's files, without those whose path is already ``known``."""
    files = walk(spark, root, selection)
    if known is not None:
        files = files.join(known.select("path"), "path", "left_anti")
    return file_records(files)
