"""Library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions import columns as C


def totals(files: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """One row: files, bytes, kinds, duplicates, faces and named people."""
    mime, ext = F.col("mime"), F.col("ext")
    base = files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.count_if(C.stats_is_photo(mime, ext)).alias("photos"), F.count_if(C.stats_is_video(mime, ext)).alias("videos"),
    )
    named = faces.where("confirmed = 1 AND person_label IS NOT NULL")
    people_seen = faces.agg(F.count("*").alias("faces")).join(named.agg(F.countDistinct("person_label").alias("named_people")))
    return base.join(duplicate_totals(files)).join(people_seen)


def duplicate_totals(files: DataFrame) -> DataFrame:
    """One row: groups of equal content, files in them, bytes that copies waste."""
    groups = files.groupBy("hash").agg(F.count("*").alias("n"), F.max("size_bytes").alias("size"))
    again = F.col("n") > 1
    return groups.agg(
        F.count_if(again).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(again, F.col("size") * (F.col("n") - 1))), F.lit(0)).alias("wasted_bytes"),
    )


def by_type(files: DataFrame, limit: int = 12) -> DataFrame:
    rows = files.select(C.ascii_lower(F.coalesce(F.nullif("ext", F.lit("")), F.lit("(none)"))).alias("ext"), F.coalesce(F.nullif("mime", F.lit("")), F.lit("(unknown)")).alias("mime"), "size_bytes")
    rows = rows.groupBy("ext", "mime").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return rows.orderBy(F.desc("bytes"), "ext", "mime").limit(limit)


def tool_stats(files: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: counts that the tool surface reports."""
    return files.agg(
        F.count("*").alias("total_files"), F.sum("size_bytes").alias("total_bytes"), F.countDistinct("hash").alias("unique_files"),
        F.count_if(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).alias("with_gps"),
        F.min(F.when(C.is_real_date(F.col("exif_date")), F.col("exif_date"))).alias("earliest"), F.max(F.when(C.is_real_date(F.col("exif_date")), F.col("exif_date"))).alias("latest"),
    ).join(embeddings.agg(F.count("*").alias("embeddings")))


def counts_by_model(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("model_id").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims")).orderBy("model_id")


def retry_summary(files: DataFrame) -> DataFrame:
    """One row: rows that a retry would visit, and what became of the rest."""
    return files.agg(
        F.count("*").alias("walked"), F.count_if(F.col("mime").isNull()).alias("incomplete"),
        F.count_if(F.col("mime").isNotNull() & (F.col("mime") != C.UNKNOWN_MIME)).alias("identified"), F.count_if(F.col("mime") == C.UNKNOWN_MIME).alias("unresolved"),
    )
