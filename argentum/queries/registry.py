"""Registration of queries: a callable on the derived library, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argentum.fixtures import BASE_MODEL, duckdb_views, spark_tables
from argentum.plans.library import Library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def library(spark: SparkSession, sf_dir: str) -> Library:
    return Library(spark, spark_tables(spark, sf_dir), model=BASE_MODEL)


def query(name: str, sql: str | None = None):
    """Register a function of the library; ``sql`` may use the derived tables as views."""

    def add(f: Callable[[Library], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(library(spark, sf_dir))
        if sql is not None:
            more, views = sql.lstrip(), duckdb_views()
            if more.startswith("WITH RECURSIVE "):
                more, views = "WITH " + more[15:], views.replace("WITH", "WITH RECURSIVE", 1)
            ORACLE_SQL[name] = views + (",\n" + more[5:] if more.startswith("WITH ") else "\n" + more)
        return f

    return add


def raw_query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` reads the generated tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: SQL texts that several twins share.
EFF = "CASE WHEN exif_date IS NOT NULL AND exif_date NOT LIKE '0000%' THEN exif_date ELSE modified_at END"
BEST = "coalesce(CASE WHEN exif_date IS NOT NULL AND exif_date NOT LIKE '0000%' THEN exif_date END, least(created_at, modified_at), '')"
PHOTO = "('image/jpeg','image/png','image/gif','image/webp','image/bmp','image/tiff','image/heic')"
VIDEO = "('video/quicktime','video/mp4')"
EXT_MIME = "CASE lower(ext) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'bmp' THEN 'image/bmp' WHEN 'tiff' THEN 'image/tiff' WHEN 'tif' THEN 'image/tiff' WHEN 'dng' THEN 'image/tiff' WHEN 'heic' THEN 'image/heic' WHEN 'mov' THEN 'video/quicktime' WHEN 'mp4' THEN 'video/mp4' WHEN 'm4v' THEN 'video/mp4' END"
EFF_MIME = f"coalesce(CASE WHEN mime IN {PHOTO} OR mime IN {VIDEO} THEN mime END, {EXT_MIME})"
STATS_PHOTO = f"(mime IN {PHOTO} OR (mime IS NULL AND lower(ext) IN ('jpg','jpeg','png','gif','webp','bmp','tiff','heic','dng')))"
STATS_VIDEO = f"(mime IN {VIDEO} OR (mime IS NULL AND lower(ext) IN ('mov','mp4')))"


def km_sql(lat: float, lon: float) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(gps_lat - {lat!r}) / 2), 2) + cos(radians({lat!r})) * cos(radians(gps_lat)) * pow(sin(radians(gps_lon - {lon!r}) / 2), 2))))"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
