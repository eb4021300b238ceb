"""Schemas of the library's tables; a missing table reads as an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "file_hashes": "path string, hash string, size_bytes bigint, created_at string, modified_at string, ext string, mime string, phash bigint, exif_date string, gps_lat double, gps_lon double, width int, height int, duration_secs double, codec string, location_name string, location_cluster_id bigint",
    "faces": "id bigint, hash string, bbox string, landmark string, embedding array<float>, cluster_id bigint, person_label string, confirmed int, is_primary int",
    "faces_scanned": "hash string, scanned_at string",
    "people": "name string, full_name string",
    "embeddings": "model_id string, hash string, embedding array<float>, embedded_at string",
    "classifications": "model_id string, hash string, category string, confidence double, classified_at string",
    "location_clusters": "id bigint, centroid_lat double, centroid_lon double, name string, photo_count bigint, radius_km double, created_at string",
    "geocode_cache": "query string, lat double, lon double, resolved_at string",
    "gazetteer": "name string, cc string, lat double, lon double",
    "pipeline_runs": "command string, started_at string, finished_at string, status string, duration_ms bigint, summary string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def evolve(df: DataFrame, name: str) -> DataFrame:
    """Adds the columns that an older table lacks, as nulls; running it again changes nothing."""
    return empty(df.sparkSession, name).unionByName(df, allowMissingColumns=True)
