"""Incremental work: what a step has not done yet, and what no longer belongs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions import columns as C


def known_mime_paths(files: DataFrame) -> DataFrame:
    """Paths with a stored type; the unknown type counts as one."""
    return files.where("mime IS NOT NULL").select("path")


def difference(walked: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    return walked.join(known, key, "left_anti")


def pending_images(files: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """(hash, path): contents to embed for a model, by stored type, or by extension where none is stored."""
    stored = F.col("mime").isin(C.PHOTO_MIMES + C.VIDEO_MIMES)
    by_ext = F.col("mime").isNull() & C.ascii_lower(F.col("ext")).isin(C.STATS_PHOTO_EXTS + C.STATS_VIDEO_EXTS)
    rows = files.where((stored | by_ext) & (C.ascii_lower(F.coalesce("ext", F.lit(""))) != "dng"))
    done = embeddings.where(F.col("model_id") == model).select("hash")
    return rows.join(done, "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path")).orderBy("hash")


def pending_hashes(files: DataFrame, embeddings: DataFrame, classifications: DataFrame, model: str) -> DataFrame:
    """Embedded contents not yet classified for a model, without those that have a video file."""
    video = files.where(C.stats_is_video(F.col("mime"), F.col("ext"))).select("hash")
    rows = embeddings.where(F.col("model_id") == model).select("hash").distinct()
    done = classifications.where(F.col("model_id") == model).select("hash")
    return rows.join(done, "hash", "left_anti").join(video, "hash", "left_anti").orderBy("hash")


def exclude_video_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Hashes whose last file by path is no video; hashes without a file stay."""
    last = files.groupBy("hash").agg(F.max_by(F.struct("mime", "ext"), "path").alias("f"))
    video = last.where(F.coalesce(C.effective_mime(F.col("f.mime"), F.col("f.ext")).isin(C.VIDEO_MIMES), F.lit(False)))
    return hashes.join(video, "hash", "left_anti")


def first_path_by_hash(files: DataFrame) -> DataFrame:
    return files.groupBy("hash").agg(F.min("path").alias("path"))


def select_unscanned(files: DataFrame, scanned: DataFrame, faces: DataFrame, limit: int | None = None) -> DataFrame:
    """(hash, path): first path of each content with neither a scan mark nor a face."""
    skip = scanned.select("hash").union(faces.select("hash")).distinct()
    rows = first_path_by_hash(files.join(skip, "hash", "left_anti")).orderBy("path")
    return rows if limit is None else rows.limit(limit)


def orphan_embeddings(embeddings: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors of any model whose content is in no file."""
    return embeddings.join(files.where("hash IS NOT NULL").select("hash"), "hash", "left_anti")


def orphan_cache_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """Cache files whose name begins with a content hash that is in no file."""
    rows = names.withColumn("hash", C.hash_from_cache_name(F.col("name"))).where("hash IS NOT NULL")
    return rows.join(files.select("hash"), "hash", "left_anti").select("name")


def prune_plan(files: DataFrame, present: DataFrame, parents: DataFrame, trust_missing_parents: bool = False) -> DataFrame:
    """(path, action): remove rows of missing files, but only where their folder is there.

    ``present`` lists existing paths, ``parents`` existing folders.
    """
    gone = files.select("path", C.parent_folder("path").alias("parent")).join(present.select("path"), "path", "left_anti")
    known = gone.join(parents.withColumn("there", F.lit(True)), "parent", "left")
    trusted = F.lit(True) if trust_missing_parents else F.coalesce("there", F.lit(False))
    return known.select("path", F.when(trusted, "remove").otherwise("unreachable").alias("action"))


def prune_guard(plan: DataFrame, files: DataFrame, force: bool = False) -> None:
    """Refuse to remove a hundred rows or more that are over a fifth of all, unless forced."""
    n, total = plan.where("action = 'remove'").count(), files.count()
    if n >= 100 and n * 5 > total and not force:
        raise RuntimeError(f"{n} of {total} rows would be removed; force it if that is meant")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``new`` replaces rows of equal keys; columns that it lacks become null.

    Of new rows with equal keys the one with the greatest ``order`` wins, among
    those (or without an order) the one whose other columns compare greatest.
    """
    others = [c for c in new.columns if c not in keys]
    rank = [order, *(c for c in others if c != order)] if order else others
    if rank:
        last = new.groupBy(*keys).agg(F.max(F.struct(*rank)).alias("_last")).select(*keys, "_last.*").select(*new.columns)
    else:
        last = new.distinct()
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def replace_by_hash(faces: DataFrame, hash_value: str, new: DataFrame) -> DataFrame:
    """All faces of one content replaced; labels of the old ones are gone."""
    return faces.where(F.col("hash") != hash_value).unionByName(new, allowMissingColumns=True)


def mark_scanned(scanned: DataFrame, hashes: DataFrame, when: str) -> DataFrame:
    """Marks added for hashes that have none."""
    new = hashes.select("hash").distinct().join(scanned, "hash", "left_anti")
    return scanned.unionByName(new.withColumn("scanned_at", F.lit(when)))


def hashes_with_faces(faces: DataFrame) -> DataFrame:
    return faces.select("hash").distinct().orderBy("hash")


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
