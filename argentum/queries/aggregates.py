"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.operators import duplicates, faces, pending, places, stats, vectors
from argentum.sources import takeout
from argentum.storage import materialize
from argentum.streaming import ledger

from .registry import BEST, STATS_PHOTO, STATS_VIDEO, query

_GROUPS = "SELECT hash, count(*) AS n, max(size_bytes) AS size FROM file_hashes GROUP BY hash"
_TOTALS = f"""
SELECT (SELECT count(*) FROM file_hashes) AS files, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM file_hashes) AS bytes,
  (SELECT count(*) FROM file_hashes WHERE {STATS_PHOTO}) AS photos, (SELECT count(*) FROM file_hashes WHERE {STATS_VIDEO}) AS videos,
  (SELECT count(*) FROM ({_GROUPS}) WHERE n > 1) AS duplicate_groups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ({_GROUPS}) WHERE n > 1) AS duplicate_files,
  (SELECT CAST(coalesce(sum(size * (n - 1)), 0) AS BIGINT) FROM ({_GROUPS}) WHERE n > 1) AS wasted_bytes,
  (SELECT count(*) FROM faces) AS faces, (SELECT count(DISTINCT person_label) FROM faces WHERE confirmed = 1 AND person_label IS NOT NULL) AS named_people
"""


@query("a01_library_totals", _TOTALS)
def totals(lib):
    return lib.stats()


@query("a02_kind_counts", f"SELECT count(*) FILTER (WHERE {STATS_PHOTO}) AS photos, count(*) FILTER (WHERE {STATS_VIDEO}) AS videos FROM file_hashes")
def kinds(lib):
    mime, ext = F.col("mime"), F.col("ext")
    return lib.file_hashes.agg(F.count_if(C.stats_is_photo(mime, ext)).alias("photos"), F.count_if(C.stats_is_video(mime, ext)).alias("videos"))


@query("a03_duplicate_group_count", f"SELECT count(*) AS duplicate_groups FROM ({_GROUPS}) WHERE n > 1")
def group_count(lib):
    return stats.duplicate_totals(lib.file_hashes).select("duplicate_groups")


@query("a04_duplicate_file_count", f"SELECT CAST(sum(n) AS BIGINT) AS duplicate_files FROM ({_GROUPS}) WHERE n > 1")
def file_count(lib):
    return stats.duplicate_totals(lib.file_hashes).select("duplicate_files")


@query("a05_wasted_bytes", f"SELECT CAST(sum(size * (n - 1)) AS BIGINT) AS wasted_bytes FROM ({_GROUPS}) WHERE n > 1")
def wasted(lib):
    return stats.duplicate_totals(lib.file_hashes).select("wasted_bytes")


@query("a06_by_type", "SELECT lower(coalesce(nullif(ext, ''), '(none)')) AS ext, coalesce(nullif(mime, ''), '(unknown)') AS mime, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM file_hashes GROUP BY 1, 2 ORDER BY bytes DESC, 1, 2 LIMIT 12")
def by_type(lib):
    return stats.by_type(lib.file_hashes)


_RANKED = f"SELECT *, {BEST} AS best_date, row_number() OVER (PARTITION BY hash ORDER BY {BEST}, path) AS rn, count(*) OVER (PARTITION BY hash) AS n FROM file_hashes"


@query("a07_duplicate_groups", f"SELECT hash, path, best_date, CAST(rn AS INTEGER) AS rn, n FROM ({_RANKED}) WHERE n > 1")
def duplicate_groups(lib):
    return duplicates.duplicate_files(lib.file_hashes).select("hash", "path", "best_date", "rn", "n")


@query("a08_losers", f"SELECT path FROM ({_RANKED}) WHERE rn > 1")
def losers(lib):
    return duplicates.losers(lib.file_hashes)


@query("a09_groups_by_waste", f"SELECT hash, max(path) FILTER (WHERE rn = 1) AS keep, string_agg(path, ';' ORDER BY rn) FILTER (WHERE rn > 1) AS remove, max(size_bytes) FILTER (WHERE rn = 1) * (count(*) - 1) AS waste FROM ({_RANKED}) WHERE n > 1 GROUP BY hash")
def by_waste(lib):
    return duplicates.groups_by_waste(lib.file_hashes).withColumn("remove", F.concat_ws(";", "remove"))


# The greedy leader rule as it reads: fingerprints in path order, each claimed by the first leader within ten bits, or else a leader itself.
_LEADERS = """WITH RECURSIVE prints AS (SELECT phash, min(path) AS pos, row_number() OVER (ORDER BY min(path)) AS k FROM file_hashes WHERE phash IS NOT NULL GROUP BY phash),
walk(k, leaders, p, leader) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(p BIGINT, pos VARCHAR)[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT k, CASE WHEN hit IS NULL THEN list_append(leaders, struct_pack(p := phash, pos := pos)) ELSE leaders END, phash, coalesce(hit, pos) FROM (
    SELECT prints.k, prints.phash, prints.pos, leaders, list_filter(leaders, lambda l: bit_count(xor(l.p, prints.phash)) <= 10)[1].pos AS hit FROM walk JOIN prints ON prints.k = walk.k + 1)),
led AS (SELECT leader, path FROM file_hashes JOIN walk ON phash = p WHERE leader IS NOT NULL),
alike AS (SELECT leader, path FROM led WHERE leader IN (SELECT leader FROM led GROUP BY leader HAVING count(*) > 1))
"""


@query("a10_similar_groups", _LEADERS + "SELECT leader, path FROM alike")
def similar_groups(lib):
    return duplicates.similar_groups(lib.file_hashes)


@query("a11_duplicates_json", _LEADERS + f"SELECT 'duplicate' AS kind, hash AS of, path FROM ({_RANKED}) r WHERE n > 1 AND rn > 1 UNION ALL SELECT 'kept', hash, path FROM ({_RANKED}) r WHERE n > 1 AND rn = 1 UNION ALL SELECT 'similar', leader, path FROM alike UNION ALL SELECT 'files', CAST(count(*) AS VARCHAR), NULL FROM file_hashes")
def duplicates_json(lib):
    """The whole document, taken apart again."""
    j = F.from_json("document", "total_files bigint, duplicate_groups array<struct<hash:string,keep:string,remove:array<string>>>, similar_groups array<struct<leader:string,files:array<string>>>")
    doc = materialize(lib.find_duplicates(include_similar=True).select(j.alias("j")).select("j.*"), "document")
    groups = doc.select(F.explode("duplicate_groups").alias("g")).select("g.*")
    alike = doc.select(F.explode("similar_groups").alias("g")).select("g.*")
    kind = lambda name, *cols: (F.lit(name).alias("kind"), *cols)
    out = groups.select(*kind("duplicate", F.col("hash").alias("of"), F.explode("remove").alias("path")))
    out = out.union(groups.select(*kind("kept", "hash", "keep"))).union(alike.select(*kind("similar", "leader", F.explode("files"))))
    return out.union(doc.select(*kind("files", F.col("total_files").cast("string"), F.lit(None).cast("string"))))


@query("a12_tool_stats", "SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(DISTINCT hash) AS unique_files, count(*) FILTER (WHERE gps_lat IS NOT NULL) AS with_gps, min(exif_date) FILTER (WHERE exif_date NOT LIKE '0000%') AS earliest, max(exif_date) FILTER (WHERE exif_date NOT LIKE '0000%') AS latest, (SELECT count(*) FROM emb) AS embeddings FROM file_hashes")
def tool_stats(lib):
    return stats.tool_stats(lib.file_hashes, lib.embeddings)


@query("a13_counts_by_model", "SELECT model_id, count(*) AS vectors, CAST(max(len(embedding)) AS INTEGER) AS dims FROM emb GROUP BY model_id")
def by_model(lib):
    return stats.counts_by_model(lib.embeddings)


_PEOPLE = "SELECT person_label AS label, min(coalesce(full_name, person_label)) AS full_name, string_agg(CAST(id AS VARCHAR), ',' ORDER BY is_primary DESC, id) AS face_ids, CAST(split_part(string_agg(CAST(id AS VARCHAR), ',' ORDER BY is_primary DESC, id), ',', 1) AS BIGINT) AS representative_id, count(DISTINCT hash) AS contents FROM faces LEFT JOIN people ON name = person_label WHERE confirmed = 1 AND person_label IS NOT NULL GROUP BY person_label"


@query("a14_people_view", _PEOPLE)
def people_view(lib):
    got = faces.people_view(lib.faces, lib.people)
    return got.select("label", "full_name", F.concat_ws(",", F.col("face_ids").cast("array<string>")).alias("face_ids"), "representative_id", F.size("hashes").cast("bigint").alias("contents"))


@query("a14_clusters_view", "SELECT cluster_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS face_ids, count(DISTINCT hash) AS contents FROM faces WHERE cluster_id IS NOT NULL AND (confirmed = 0 OR person_label IS NULL) GROUP BY cluster_id")
def clusters_view(lib):
    got = faces.clusters_view(lib.faces)
    return got.select("cluster_id", F.concat_ws(",", F.col("face_ids").cast("array<string>")).alias("face_ids"), F.size("hashes").cast("bigint").alias("contents"))


@query("a14_singletons_view", "SELECT id AS face_id, hash FROM faces WHERE cluster_id IS NULL AND (confirmed = 0 OR person_label IS NULL)")
def singletons_view(lib):
    return faces.singletons_view(lib.faces)


@query("a15_photos_per_person", "SELECT person_label, count(DISTINCT hash) AS photos FROM faces WHERE person_label IS NOT NULL GROUP BY person_label")
def photos_per_person(lib):
    return faces.photos_per_person(lib.faces)


_SPELLED = "SELECT CASE WHEN id % 3 = 0 THEN upper(person_label) ELSE person_label END AS label FROM faces WHERE person_label IS NOT NULL"


@query("a16_migrate_labels", f"SELECT lower(label) AS name, max_by(label, n * 4 + CASE WHEN label <> lower(label) THEN 1 ELSE 0 END) AS full_name FROM (SELECT label, count(*) AS n FROM ({_SPELLED}) GROUP BY label) GROUP BY 1")
def migrate_labels(lib):
    spelled = lib.faces.withColumn("person_label", F.when(F.col("id") % 3 == 0, F.upper("person_label")).otherwise(F.col("person_label")))
    return faces.migrate_labels(spelled)[0]


@query("a17_representative_path", "SELECT hash, min(path) AS path FROM file_hashes GROUP BY hash")
def representative(lib):
    return pending.first_path_by_hash(lib.file_hashes)


@query("a18_min_distance", "SELECT hash, round(min(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(gps_lat - 51.5074) / 2), 2) + cos(radians(51.5074)) * cos(radians(gps_lat)) * pow(sin(radians(gps_lon + 0.1278) / 2), 2))))), 6) AS distance_km FROM file_hashes WHERE gps_lat IS NOT NULL GROUP BY hash")
def min_distance(lib):
    from argentum.operators.selection import by_location

    return by_location(lib.file_hashes, 51.5074, -0.1278, 30000.0).select("hash", F.round("distance_km", 6).alias("distance_km"))


_CITY = "CASE WHEN gps_lat > 52.2 THEN 'Berlin' WHEN gps_lat > 50 THEN 'London' WHEN gps_lat > 45 THEN 'Paris' WHEN gps_lon > 10 THEN 'Istanbul' ELSE 'Madrid' END"


@query("a19_photos_per_place", f"SELECT count(*) AS photo_count FROM (SELECT {_CITY} AS city FROM file_hashes WHERE gps_lat IS NOT NULL) GROUP BY city")
def photos_per_place(lib):
    return places.location_clusters(lib.file_hashes, lib.gazetteer, 50.0)[0].select("photo_count")


@query("a20_run_counters", "SELECT count(*) AS processed, count(doc_hash) AS faces, count(*) - count(doc_hash) AS errors FROM (SELECT f.hash, d.hash AS doc_hash FROM faces f LEFT JOIN (SELECT DISTINCT hash FROM file_hashes) d USING (hash))")
def run_counters(lib):
    live = lib.file_hashes.select("hash", F.lit(1).alias("ok")).distinct()
    return lib.faces.join(live, "hash", "left").agg(F.count("*").alias("processed"), F.count("ok").alias("faces"), F.count_if(F.col("ok").isNull()).alias("errors"))


@query("a21_stage_averages", "SELECT command, avg(duration_ms) AS avg_ms FROM pipeline_runs WHERE duration_ms IS NOT NULL GROUP BY command")
def stage_averages(lib):
    return lib.pipeline_runs.where("duration_ms IS NOT NULL").groupBy("command").agg(F.avg("duration_ms").alias("avg_ms"))


@query("a22_place_centroids", f"SELECT round(avg(gps_lat), 6) AS lat, round(avg(gps_lon), 6) AS lon FROM (SELECT DISTINCT gps_lat, gps_lon, {_CITY} AS city FROM file_hashes WHERE gps_lat IS NOT NULL) GROUP BY city")
def place_centroids(lib):
    return places.location_clusters(lib.file_hashes, lib.gazetteer, 50.0)[0].select(F.round("centroid_lat", 6).alias("lat"), F.round("centroid_lon", 6).alias("lon"))


@query("a23_normalized_mean", "WITH s AS (SELECT i, sum(CAST(embedding[i] AS DOUBLE)) AS s FROM faces, range(1, 65) r(i) GROUP BY i), n AS (SELECT sqrt(sum(s * s)) AS n FROM s) SELECT CAST(i - 1 AS INTEGER) AS pos, round(s / n, 6) AS x FROM s, n")
def mean_vector(lib):
    return vectors.normalized_mean(lib.faces).select(F.posexplode("mean").alias("pos", "v")).select("pos", F.round("v", 6).alias("x"))


@query("a24_group_json", f"SELECT hash, CAST(count(*) AS INTEGER) AS files, max(size_bytes) FILTER (WHERE rn = 1) * (count(*) - 1) AS waste, max(best_date) FILTER (WHERE rn = 1) AS date FROM ({_RANKED}) WHERE n > 1 GROUP BY hash")
def group_json(lib):
    j = F.from_json("document", "waste bigint, date string, files array<struct<path:string,size:bigint>>")
    return duplicates.group_json(lib.file_hashes).select("hash", j.alias("j")).select("hash", F.size("j.files").alias("files"), "j.waste", "j.date")


@query("a25_has_problem", "SELECT true AS has_problem")
def has_problem(lib):
    return ledger.has_problem(ledger.status(lib.pipeline_runs))


def takeout_listing(lib):
    """Media and sidecars made of the library's paths: a third without, a tenth with two."""
    media = lib.file_hashes.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("i"))
    one = media.where("i % 3 <> 0").select("dir", F.concat("name", F.when(F.col("i") % 2 == 0, takeout.CANONICAL).otherwise(".supp.json")).alias("name"))
    two = media.where("i % 3 <> 0 AND i % 10 = 1").select("dir", F.concat("name", F.lit(".suppl.json")).alias("name"))
    return media.select("dir", "name"), takeout.sidecar_index(one.union(two))


@query("a26_takeout_survey", "SELECT count(*) FILTER (WHERE i % 3 <> 0 AND NOT (i % 10 = 1)) AS matched, count(*) FILTER (WHERE i % 3 = 0) AS unmatched, count(*) FILTER (WHERE i % 3 <> 0 AND i % 10 = 1) AS ambiguous, count(DISTINCT dir) AS folders FROM (SELECT doc_id AS i, source || '/' || lang AS dir FROM documents)")
def takeout_survey(lib):
    return takeout.survey(takeout.match_sidecars(*takeout_listing(lib)))


@query("a27_retry_summary", "SELECT count(*) AS walked, count(*) FILTER (WHERE mime IS NULL) AS incomplete, count(*) FILTER (WHERE mime <> 'application/octet-stream') AS identified, count(*) FILTER (WHERE mime = 'application/octet-stream') AS unresolved FROM file_hashes")
def retry_summary(lib):
    return stats.retry_summary(lib.file_hashes)


@query("a28_prune_guard", "SELECT 'RuntimeError' AS outcome")
def prune_guard(lib):
    plan = lib.file_hashes.select("path", F.lit("remove").alias("action"))
    try:
        pending.prune_guard(plan, lib.file_hashes)
        outcome = "accepted"
    except RuntimeError:
        outcome = "RuntimeError"
    return lib.spark.createDataFrame([(outcome,)], "outcome string")
