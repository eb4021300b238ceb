"""Labelling and maintenance (M): each query returns the changed table."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.operators import faces, pending, places
from argentum.schemas import evolve

from .registry import query

_COLS = ["id", "cluster_id", "person_label", "confirmed", "is_primary"]


@query("m01_assign", "SELECT id, cluster_id, CASE WHEN id IN (1, 2, 9) THEN 'new_person' ELSE person_label END AS person_label, CASE WHEN id IN (1, 2, 9) THEN 1 ELSE confirmed END AS confirmed, is_primary FROM faces")
def assign(lib):
    return faces.assign(lib.faces, lib.people, [1, 2, 9], "New Person")[0].select(*_COLS)


@query("m01_new_person", "SELECT name, full_name FROM people UNION ALL SELECT 'new_person', 'New Person'")
def new_person(lib):
    return faces.assign(lib.faces, lib.people, [1], "New  Person")[1]


@query("m02_remove_face", "SELECT id, CASE WHEN id <> 6 THEN cluster_id END AS cluster_id, CASE WHEN id <> 6 THEN person_label END AS person_label, CASE WHEN id = 6 THEN 0 ELSE confirmed END AS confirmed, CASE WHEN id = 6 THEN 0 ELSE is_primary END AS is_primary FROM faces")
def remove(lib):
    return faces.remove_face(lib.faces, 6).select(*_COLS)


@query("m03_dissolve_cluster", "SELECT id, CASE WHEN cluster_id = 2 THEN NULL ELSE cluster_id END AS cluster_id FROM faces")
def dissolve(lib):
    return faces.dissolve_cluster(lib.faces, 2).select("id", "cluster_id")


@query("m04_rename", "SELECT name, CASE WHEN name = 'person_3' THEN 'Zoe Q.' ELSE full_name END AS full_name FROM people")
def rename(lib):
    return faces.set_full_name(lib.people, "person_3", "  Zoe   Q. ")


@query("m05_delete_person", "SELECT id, CASE WHEN person_label = 'person_1' THEN NULL ELSE person_label END AS person_label, CASE WHEN person_label = 'person_1' THEN 0 ELSE confirmed END AS confirmed FROM faces")
def delete(lib):
    return faces.delete_person(lib.faces, "person_1").select("id", "person_label", "confirmed")


@query("m06_set_primary", "SELECT id, CASE WHEN person_label = p THEN CASE WHEN id = m THEN 1 ELSE 0 END ELSE is_primary END AS is_primary FROM faces, (SELECT min(id) AS m, min_by(person_label, id) AS p FROM faces WHERE person_label IS NOT NULL)")
def primary(lib):
    first = lib.faces.where("person_label IS NOT NULL").orderBy("id").select("id", "person_label").head()
    return faces.set_primary(lib.faces, first.person_label, first.id).select("id", "is_primary")


@query("m07_update_clusters", "SELECT id, CASE WHEN id < 100 THEN id % 3 ELSE cluster_id END AS cluster_id FROM faces")
def update(lib):
    new = lib.faces.where("id < 100").select("id", (F.col("id") % 3).alias("cluster_id"))
    return faces.update_cluster_assignments(lib.faces, new).select("id", "cluster_id")


_PRUNE = "SELECT path, CASE WHEN path LIKE '/lib/src3/%' THEN 'unreachable' ELSE 'remove' END AS action FROM file_hashes WHERE ext = 'png' OR path LIKE '/lib/src3/%'"


@query("m08_prune_plan", _PRUNE)
def prune(lib):
    there = ~(F.col("ext") == "png") & ~F.col("path").startswith("/lib/src3/")
    parents = lib.file_hashes.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent")).distinct().where(~F.col("parent").startswith("/lib/src3/"))
    return pending.prune_plan(lib.file_hashes, lib.file_hashes.where(there).select("path"), parents)


@query("m09_trusted_absence", "SELECT path, 'remove' AS action FROM file_hashes WHERE ext = 'png' OR path LIKE '/lib/src3/%'")
def trusted(lib):
    there = ~(F.col("ext") == "png") & ~F.col("path").startswith("/lib/src3/")
    none = lib.spark.createDataFrame([], "parent string")
    return pending.prune_plan(lib.file_hashes, lib.file_hashes.where(there).select("path"), none, trust_missing_parents=True)


@query("m10_backfill_names", "SELECT path, CASE WHEN gps_lat IS NULL THEN NULL WHEN gps_lat > 52.2 THEN 'Berlin, DE' WHEN gps_lat > 50 THEN 'London, GB' WHEN gps_lat > 45 THEN 'Paris, FR' WHEN gps_lon > 10 THEN 'Istanbul, TR' ELSE 'Madrid, ES' END AS location_name FROM file_hashes")
def backfill(lib):
    anchors = lib.gazetteer.where("name IN ('Paris', 'London', 'Berlin', 'Madrid', 'Istanbul')")
    return places.backfill_names(lib.file_hashes, anchors).select("path", "location_name")


@query("m11_schema_evolution", "SELECT path, CAST(NULL AS DOUBLE) AS duration_secs, CAST(NULL AS VARCHAR) AS codec FROM file_hashes")
def evolution(lib):
    return evolve(evolve(lib.file_hashes.drop("duration_secs", "codec"), "file_hashes"), "file_hashes").select("path", "duration_secs", "codec")


@query("m12_legacy_classifications", "SELECT 0 AS n")
def legacy(lib):
    """A table from before models were recorded is dropped rather than guessed at."""
    old = lib.classifications.drop("model_id")
    kept = lib.classifications.limit(0) if "model_id" not in old.columns else old
    return kept.agg(F.count("*").cast("int").alias("n"))
