"""Joins and set operations (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.operators import duplicates, faces, pending, places, search, vectors
from argentum.operators import selection as sel
from argentum.sources.catalogs import catalog_folders

from .registry import EFF_MIME, PHOTO, STATS_VIDEO, VIDEO, dot_sql, query

BASE, LARGE = "acme/base-224", "acme/large-384"


@query("j01_search_by_person", "SELECT DISTINCT path FROM file_hashes JOIN faces USING (hash) WHERE confirmed = 1 AND person_label = 'person_2'")
def search_by_person(lib):
    return faces.search_by_person(lib.file_hashes, lib.faces, lib.people, "person_2")


@query("j02_list_persons", "SELECT DISTINCT coalesce(full_name, person_label) AS person FROM faces LEFT JOIN people ON name = person_label WHERE confirmed = 1 AND person_label IS NOT NULL")
def list_persons(lib):
    return faces.list_persons(lib.faces, lib.people)


@query("j03_labeled_faces", "SELECT hash, string_agg(CAST(id AS VARCHAR) || ':' || coalesce(full_name, person_label) || ':' || bbox, ';' ORDER BY id) AS faces FROM faces LEFT JOIN people ON name = person_label WHERE confirmed = 1 AND person_label IS NOT NULL GROUP BY hash")
def labeled_faces(lib):
    got = faces.labeled_faces_by_hash(lib.faces, lib.people)
    return got.select("hash", F.concat_ws(";", F.transform("faces", lambda f: F.concat_ws(":", f["id"].cast("string"), f["label"], f["bbox"]))).alias("faces"))


@query("j04_cluster_detail", "SELECT id, hash, path, bbox FROM faces JOIN file_hashes USING (hash) WHERE cluster_id = 3")
def cluster_detail(lib):
    return faces.cluster_detail(lib.file_hashes, lib.faces, 3)


@query("j05_person_detail", "SELECT id, hash, path, bbox, is_primary, 'Ahmet Arı' AS full_name FROM faces JOIN file_hashes USING (hash) WHERE confirmed = 1 AND person_label = 'person_0'")
def person_detail(lib):
    return faces.person_detail(lib.file_hashes, lib.faces, lib.people, "person_0")


@query("j06_paths_for_category", "SELECT DISTINCT path, category FROM file_hashes JOIN classifications USING (hash) WHERE model_id = 'acme/base-224' AND category = 'document'")
def paths_for_category(lib):
    got = lib.classifications.where((F.col("model_id") == BASE) & (F.col("category") == "document")).select("hash", "category").distinct()
    return lib.file_hashes.join(got, "hash").select("path", "category").distinct().orderBy("path")


@query("j07_face_lookup", "SELECT id, hash, path, bbox FROM faces JOIN file_hashes USING (hash) WHERE id = 7 ORDER BY path LIMIT 1")
def face_lookup(lib):
    return faces.face_lookup(lib.file_hashes, lib.faces, 7)




def _catalog(lib):
    """Catalog tables made of the library's paths: one root, a folder for each source and language."""
    rows = lib.file_hashes.select(F.regexp_extract("path", r"^(/lib/)", 1).alias("absolutePath"), F.regexp_extract("path", r"^/lib/(.*/)[^/]*$", 1).alias("pathFromRoot"), F.xxhash64("path").alias("file"))
    folders = rows.select(F.xxhash64("pathFromRoot").alias("id_local"), F.lit(1).alias("rootFolder"), "pathFromRoot").distinct()
    return {
        "AgLibraryFile": rows.select(F.col("file").alias("id_local"), F.xxhash64("pathFromRoot").alias("folder")),
        "AgLibraryFolder": folders,
        "AgLibraryRootFolder": rows.select(F.lit(1).alias("id_local"), "absolutePath").distinct(),
    }


_FOLDERS = "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM file_hashes"


@query("j08_catalog_join", _FOLDERS)
def catalog_join(lib):
    return catalog_folders(_catalog(lib))


_PENDING = f"(mime IN {PHOTO} OR mime IN {VIDEO} OR (mime IS NULL AND lower(ext) IN ('jpg','jpeg','png','gif','webp','bmp','tiff','heic','dng','mov','mp4'))) AND lower(coalesce(ext, '')) <> 'dng'"


@query("j09_pending_images", f"SELECT hash, min(path) AS path FROM file_hashes f WHERE {_PENDING} AND NOT EXISTS (SELECT 1 FROM emb e WHERE e.hash = f.hash AND e.model_id = 'acme/large-384') GROUP BY hash")
def pending_images(lib):
    return pending.pending_images(lib.file_hashes, lib.embeddings, LARGE)


@query("j10_pending_hashes", f"SELECT DISTINCT hash FROM emb e WHERE model_id = 'acme/base-224' AND NOT EXISTS (SELECT 1 FROM classifications c WHERE c.hash = e.hash AND c.model_id = 'acme/base-224') AND NOT EXISTS (SELECT 1 FROM file_hashes f WHERE f.hash = e.hash AND {STATS_VIDEO})")
def pending_hashes(lib):
    return pending.pending_hashes(lib.file_hashes, lib.embeddings, lib.classifications, BASE)


@query("j11_exclude_videos", f"WITH l AS (SELECT hash, max_by({EFF_MIME}, path) AS m, max_by(CASE WHEN {EFF_MIME} IN {VIDEO} THEN 1 ELSE 0 END, path) AS v FROM file_hashes GROUP BY hash) SELECT DISTINCT hash FROM emb WHERE model_id = 'acme/base-224' AND hash NOT IN (SELECT hash FROM l WHERE v = 1)")
def exclude_videos(lib):
    return pending.exclude_video_hashes(lib.file_hashes, lib.embeddings.where(F.col("model_id") == BASE).select("hash").distinct())


@query("j12_unscanned", "SELECT hash, min(path) AS path FROM file_hashes WHERE hash NOT IN (SELECT hash FROM faces_scanned) AND hash NOT IN (SELECT hash FROM faces) GROUP BY hash")
def unscanned(lib):
    return pending.select_unscanned(lib.file_hashes, lib.faces_scanned, lib.faces)


@query("j13_first_path_per_hash", "SELECT hash, min(path) AS path FROM file_hashes GROUP BY hash")
def first_path(lib):
    return pending.first_path_by_hash(lib.file_hashes)


@query("j14_orphan_embeddings", "SELECT model_id, hash FROM emb WHERE hash NOT IN (SELECT hash FROM file_hashes WHERE ext <> 'png')")
def orphan_embeddings(lib):
    return pending.orphan_embeddings(lib.embeddings, lib.file_hashes.where("ext <> 'png'")).select("model_id", "hash")


@query("j15_orphan_cache", "SELECT hash || '_256.jpg' AS name FROM (SELECT DISTINCT hash FROM file_hashes) WHERE hash NOT IN (SELECT hash FROM file_hashes WHERE ext <> 'png')")
def orphan_cache(lib):
    names = lib.file_hashes.select(F.concat("hash", F.lit("_256.jpg")).alias("name")).distinct().union(lib.spark.createDataFrame([("readme.txt",)], "name string"))
    return pending.orphan_cache_files(names, lib.file_hashes.where("ext <> 'png'"))


@query("j16_duplicate_rows", "SELECT path FROM file_hashes WHERE hash IN (SELECT hash FROM file_hashes GROUP BY hash HAVING count(*) > 1)")
def duplicate_rows(lib):
    return duplicates.duplicate_files(lib.file_hashes).select("path")


@query("j17_copies", "SELECT path, (SELECT count(*) FROM file_hashes g WHERE g.hash = f.hash) AS copies FROM file_hashes f")
def copies(lib):
    n = lib.file_hashes.groupBy("hash").agg(F.count("*").alias("copies"))
    return lib.file_hashes.join(n, "hash").select("path", "copies")


@query("j18_near_prints", "SELECT a.phash AS u, b.phash AS v, bit_count(xor(a.phash, b.phash)) AS bits FROM (SELECT DISTINCT phash FROM file_hashes) a, (SELECT DISTINCT phash FROM file_hashes) b WHERE a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 10")
def near_prints(lib):
    prints = lib.file_hashes.select("phash").distinct().withColumn("pos", F.col("phash"))
    return duplicates.band_pairs(prints).select("u", "v", F.col("bits").cast("tinyint").alias("bits"))


_COORD = "SELECT DISTINCT gps_lat, gps_lon FROM file_hashes WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL"
_KM2 = "2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))"


@query("j19_near_places", f"WITH c AS ({_COORD}), p AS (SELECT a.gps_lat AS lat1, a.gps_lon AS lon1, b.gps_lat AS lat2, b.gps_lon AS lon2, least(1.0, pow(sin(radians(b.gps_lat - a.gps_lat) / 2), 2) + cos(radians(a.gps_lat)) * cos(radians(b.gps_lat)) * pow(sin(radians(b.gps_lon - a.gps_lon) / 2), 2)) AS h FROM c a, c b WHERE (a.gps_lat, a.gps_lon) < (b.gps_lat, b.gps_lon)) SELECT lat1, lon1, lat2, lon2, round({_KM2}, 6) AS km FROM p WHERE {_KM2} <= 2.0")
def near_places(lib):
    pts = places.distinct_coordinates(lib.file_hashes)
    pairs = places.near_pairs(pts, 2.0)
    a, b = pts.select(F.col("id").alias("u"), F.struct("lat", "lon").alias("a")), pts.select(F.col("id").alias("v"), F.struct("lat", "lon").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    first, second = F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("a"))
    both = both.select(first.alias("p"), second.alias("q"), "km")
    return both.select(F.col("p.lat").alias("lat1"), F.col("p.lon").alias("lon1"), F.col("q.lat").alias("lat2"), F.col("q.lon").alias("lon2"), F.round("km", 6).alias("km"))


@query("j20_near_vectors", f"WITH e AS (SELECT vec_id AS id, embedding FROM embeddings) SELECT a.id AS u, b.id AS v, round(1 - {dot_sql('a.embedding', 'b.embedding')}, 6) AS distance FROM e a JOIN e b ON a.id < b.id WHERE 1 - {dot_sql('a.embedding', 'b.embedding')} <= 0.6")
def near_vectors(lib):
    return vectors.cosine_edges(lib.faces, 0.6).select("u", "v", F.round("distance", 6).alias("distance"))


@query("j21_nearest_city", f"WITH c AS ({_COORD}), d AS (SELECT c.gps_lat, c.gps_lon, g.name, g.cc, pow(sin(radians(g.lat - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - gps_lon) / 2), 2) AS h FROM c, gazetteer g) SELECT gps_lat AS lat, gps_lon AS lon, min_by(CASE WHEN name = '' THEN NULL ELSE name || ', ' || cc END, h) AS city FROM d GROUP BY gps_lat, gps_lon")
def nearest_city(lib):
    return places.nearest_city(places.distinct_coordinates(lib.file_hashes).drop("id"), lib.gazetteer)


@query("j22_intersection", "SELECT hash FROM file_hashes WHERE ext = 'jpg' INTERSECT SELECT hash FROM faces")
def intersection(lib):
    return lib.file_hashes.where("ext = 'jpg'").select("hash").distinct().join(lib.faces.select("hash"), "hash", "left_semi")


@query("j23_union", "SELECT hash FROM faces_scanned UNION SELECT hash FROM faces")
def union(lib):
    return lib.faces_scanned.select("hash").union(lib.faces.select("hash")).distinct()


@query("j24_difference", "SELECT path FROM file_hashes EXCEPT SELECT path FROM file_hashes WHERE mime IS NOT NULL")
def difference(lib):
    return pending.difference(lib.file_hashes.select("path"), pending.known_mime_paths(lib.file_hashes))


@query("j25_attached_store", "SELECT path, model_id FROM file_hashes JOIN emb USING (hash) WHERE model_id = 'acme/large-384'")
def attached(lib):
    return lib.file_hashes.join(lib.embeddings.where(F.col("model_id") == lib.model(LARGE)), "hash").select("path", "model_id")


@query("j26_paths_for_hash", "SELECT path FROM file_hashes WHERE hash = (SELECT hash FROM file_hashes GROUP BY hash ORDER BY count(*) DESC, hash LIMIT 1)")
def paths_for_hash(lib):
    top = lib.file_hashes.groupBy("hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hash").limit(1).head()
    return lib.file_hashes.where(F.col("hash") == top.hash).select("path").orderBy("path")


@query("j27_restricted_corpus", f"WITH q AS (SELECT embedding AS v FROM emb WHERE model_id = 'acme/base-224' AND vec_id = 0) SELECT e.hash, round({dot_sql('e.embedding', 'q.v')}, 6) AS score FROM emb e, q WHERE model_id = 'acme/base-224' AND e.hash IN (SELECT hash FROM file_hashes WHERE ext = 'heic')")
def restricted(lib):
    v = lib.embeddings.where("model_id = 'acme/base-224' AND vec_id = 0").select("embedding").head().embedding
    return search.scored(lib.embeddings, BASE, list(v), sel.by_exts(lib.file_hashes, ["heic"])).select("hash", F.round("score", 6).alias("score"))


