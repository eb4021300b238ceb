"""Writers: JSON lines, documents, GeoJSON, HTML pages, vectors for a page, file dates."""

from __future__ import annotations

import html
import json
import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions import columns as C


def append_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object per record, missing fields left out."""
    records.write.mode("append").option("ignoreNullFields", "true").json(path)


def envelope(body: dict) -> str:
    return json.dumps({"schema_version": 1} | body, ensure_ascii=False)


def error_document(message: str) -> str:
    return json.dumps({"error": {"message": message}}, ensure_ascii=False)


def frame(out, fields: dict, arrays: dict[str, DataFrame]) -> None:
    """Write one JSON document to a stream: fields, then arrays whose items are the rows of (document), one at a time."""
    out.write(envelope(fields)[:-1])
    for name, rows in arrays.items():
        out.write(f', {json.dumps(name)}: [')
        for i, r in enumerate(rows.toLocalIterator()):
            out.write(("," if i else "") + "\n" + r["document"])
        out.write("]")
    out.write("}\n")


def geojson(clusters: DataFrame) -> DataFrame:
    """One row: a FeatureCollection of points, longitude first."""
    point = F.struct(F.lit("Point").alias("type"), F.array("centroid_lon", "centroid_lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("id", "name", "photo_count", "radius_km").alias("properties"))
    rows = clusters.agg(F.sort_array(F.collect_list(F.struct((-F.col("photo_count")).alias("a"), F.col("id").alias("b"), feature.alias("f")))).alias("rows"))
    return rows.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("rows", lambda r: r["f"]).alias("features"))).alias("document"))


def file_json(files: DataFrame, labelled: DataFrame) -> DataFrame:
    """(path, document): a file's dates, place, size and labelled faces."""
    rows = files.join(labelled, "hash", "left")
    fields = ["path", "hash", "size_bytes", "created_at", "modified_at", "exif_date", "gps_lat", "gps_lon", "width", "height", "faces"]
    return rows.select("path", F.to_json(F.struct(*fields)).alias("document"))


def html_page(groups: DataFrame, path: str, title: str = "Duplicates", live: bool = False) -> None:
    """A page of duplicate groups (hash, keep, remove, waste); a live page leaves the rows to its API."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title>\n<script>const LIVE = {json.dumps(live)};</script>\n")
        for r in () if live else groups.toLocalIterator():
            f.write(f"<section data-hash={r['hash']}><h2>{html.escape(r['keep'])}</h2><ul>" + "".join(f"<li>{html.escape(p)}</li>" for p in r["remove"]) + "</ul></section>\n")


def data_block(files: DataFrame, groups: DataFrame, keep: DataFrame, live: bool) -> DataFrame:
    """One row: the page's data as JSON; a live page omits the file arrays."""
    g = groups.agg(F.sort_array(F.collect_list(F.struct("hash", "keep", "remove"))).alias("groups"))
    if live:
        return g.select(F.to_json(F.struct("groups")).alias("document"))
    a = files.agg(F.sort_array(F.collect_list("path")).alias("all_files"))
    k = keep.agg(F.sort_array(F.collect_list("path")).alias("keep_files"))
    return g.join(a).join(k).select(F.to_json(F.struct("groups", "all_files", "keep_files")).alias("document"))


def page_vectors(files: DataFrame, embeddings: DataFrame, model: str, most_bytes: int = 24 << 20) -> DataFrame:
    """(hash, embedding) of live contents in order, all as long as the first; none if they exceed ``most_bytes`` as halves."""
    rows = embeddings.where(F.col("model_id") == model).join(files.select("hash"), "hash", "left_semi")
    first = rows.agg(F.min_by(F.size("embedding"), "hash").alias("n"))
    rows = rows.join(F.broadcast(first)).where(F.size("embedding") == F.col("n"))
    total = rows.agg((2 * F.sum(F.size("embedding"))).alias("bytes"))
    return rows.join(F.broadcast(total)).where(F.col("bytes") <= most_bytes).select("hash", "embedding").orderBy("hash")


def fix_dates_plan(files: DataFrame) -> DataFrame:
    """(path, taken): files with a well-formed capture date, to become their modification time."""
    strict = F.col("exif_date").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
    return files.where(C.is_real_date(F.col("exif_date")) & strict).select("path", F.col("exif_date").alias("taken"))


def _set_times(plan: DataFrame, seconds) -> DataFrame:
    """(path, outcome): set, skipped (no such file) or error; ``seconds`` turns a row's ``taken`` into an epoch time."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, taken in zip(pdf["path"], pdf["taken"]):
                try:
                    at = seconds(taken)
                    os.utime(path, (at, at))
                    out.append("set")
                except FileNotFoundError:
                    out.append("skipped")
                except (OSError, ValueError):
                    out.append("error")
            yield pdf[["path"]].assign(outcome=out)

    return plan.select("path", "taken").mapInPandas(run, "path string, outcome string")


def apply_dates(plan: DataFrame) -> DataFrame:
    """Sets modification times from dates in local time."""
    return _set_times(plan, lambda taken: datetime.strptime(taken, "%Y-%m-%dT%H:%M:%S").timestamp())


def apply_times(plan: DataFrame) -> DataFrame:
    """Sets modification times from epoch seconds."""
    return _set_times(plan, float)


def disk_usage(parts: dict[str, tuple[str, bool]]) -> list[tuple[str, int, bool]]:
    """(component, bytes, rebuildable) of named folders, largest first."""

    def size(path: str) -> int:
        return os.path.getsize(path) if os.path.isfile(path) else sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)

    return sorted(((n, size(p), again) for n, (p, again) in parts.items() if os.path.exists(p)), key=lambda x: (-x[1], x[0]))
