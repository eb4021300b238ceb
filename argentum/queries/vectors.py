"""Vectors, clustering and classification (V)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.functions.media import dhash
from argentum.operators import classify, clustering, places, vectors
from argentum.operators.numbering import dealt
from argentum.plans.library import image_size, resolve_model

from .registry import dot_sql, query

BASE = "acme/base-224"


_HALF = "list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(CAST(x AS DOUBLE) / pow(2, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10) END)"


@query("v01_half_floats", f"SELECT id, round(list_sum(list_transform(range(1, len(h) + 1), lambda i: h[i] * i)), 5) AS s FROM (SELECT id, {_HALF} AS h FROM faces)")
def half_floats(lib):
    """There and back, added up with each place's weight."""
    back = F.transform(vectors.from_f16(vectors.to_f16(F.col("embedding"))), lambda x, i: x.cast("double") * (i + 1))
    return lib.faces.select("id", F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


@query("v02_l2_normalize", "SELECT id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3)) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3 * CAST(x AS DOUBLE) * 3))), 6) AS s FROM faces")
def normalize(lib):
    v = C.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return lib.faces.select("id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("v03_cosine", f"SELECT a.id, round({dot_sql('a.embedding', 'b.embedding')} / sqrt({dot_sql('a.embedding', 'a.embedding')}) / sqrt({dot_sql('b.embedding', 'b.embedding')}), 6) AS cosine FROM faces a JOIN faces b ON b.id = a.id + 1")
def cosine(lib):
    b = lib.faces.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return lib.faces.join(b, "id").select("id", F.round(C.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("v04_dot", f"SELECT a.id, round(1 - {dot_sql('a.embedding', 'b.embedding')}, 6) AS distance FROM faces a JOIN faces b ON b.id = a.id + 1")
def dot(lib):
    b = lib.faces.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return lib.faces.join(b, "id").select("id", F.round(1 - C.dot(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("v05_average_linkage")
def linkage(lib):
    return clustering.average_linkage_cosine(lib.faces, 0.7)


@query("v06_centroid_merge")
def centroid_merge(lib):
    linked = clustering.average_linkage_cosine(lib.faces, 0.7)
    points = lib.faces.select("id", F.col("embedding").cast("array<double>").alias("v"))
    return clustering.merge_by_centroid(linked, points, 2, 0.35, 0.95)


@query("v07_cluster_faces")
def cluster_faces(lib):
    return clustering.cluster_faces(lib.faces, 0.7, 2)


@query("v08_label_clusters", "WITH c AS (SELECT id, id % 7 AS c, count(*) OVER (PARTITION BY id % 7) AS n, min(id) OVER (PARTITION BY id % 7) AS first FROM faces WHERE id % 7 < 6) SELECT id, CASE WHEN n >= 72 THEN (SELECT count(DISTINCT first) FROM c d WHERE d.n >= 72 AND d.first < c.first) END AS cluster_id FROM c")
def label(lib):
    by_label = lib.faces.select("id", (F.col("id") % 7).alias("cluster")).where("cluster < 6")
    return clustering.label_clusters(by_label, 72)


@query("v09_quality_gate", f"WITH s AS (SELECT i, sum(CAST(embedding[i] AS DOUBLE)) AS s FROM faces, range(1, 65) r(i) GROUP BY i), m AS (SELECT list(s / n ORDER BY i) AS v FROM s, (SELECT sqrt(sum(s * s)) AS n FROM s)) SELECT id, NOT ({dot_sql('embedding', 'm.v')} > 0.1) AND least(40 + id % 120, 40 + id % 90) >= 80 AS good FROM faces, m")
def gate(lib):
    return clustering.quality_gate(lib.faces, 80.0, 0.1).select("id", "good")


@query("v10_run_clustering")
def run_clustering(lib):
    return clustering.clustering_result(clustering.cluster_with_quality_gate(lib.faces, eps=0.7, min_samples=2, least_side=50.0))


@query("v11_bbox_min_side", "SELECT id, CAST(least(40 + id % 120, 40 + id % 90) AS DOUBLE) AS side FROM faces")
def min_side(lib):
    return lib.faces.select("id", C.bbox_min_side(F.col("bbox")).alias("side"))


_CITY = "CASE WHEN gps_lat > 52.2 THEN 'Berlin, DE' WHEN gps_lat > 50 THEN 'London, GB' WHEN gps_lat > 45 THEN 'Paris, FR' WHEN gps_lon > 10 THEN 'Istanbul, TR' ELSE 'Madrid, ES' END"


@query("v12_cluster_by_distance", f"SELECT gps_lat AS lat, gps_lon AS lon, min(gps_lat) OVER (PARTITION BY {_CITY}) AS first_lat FROM (SELECT DISTINCT gps_lat, gps_lon FROM file_hashes WHERE gps_lat IS NOT NULL)")
def by_distance(lib):
    got = places.cluster_by_distance(places.distinct_coordinates(lib.file_hashes), 50.0)
    first = got.groupBy("cluster").agg(F.min("lat").alias("first_lat"))
    return got.join(first, "cluster").select("lat", "lon", "first_lat")


@query("v13_locations", f"SELECT city AS name, round(avg(gps_lat), 6) AS lat, max(n) AS photo_count FROM (SELECT DISTINCT gps_lat, gps_lon, {_CITY} AS city FROM file_hashes WHERE gps_lat IS NOT NULL) JOIN (SELECT {_CITY} AS city, count(*) AS n FROM file_hashes WHERE gps_lat IS NOT NULL GROUP BY 1) USING (city) GROUP BY city")
def locations(lib):
    clusters, _ = places.location_clusters(lib.file_hashes, lib.gazetteer, 50.0)
    return clusters.select("name", F.round("centroid_lat", 6).alias("lat"), "photo_count")


_H = "least(1.0, pow(sin(radians(gps_lat - 48.8566) / 2), 2) + cos(radians(48.8566)) * cos(radians(gps_lat)) * pow(sin(radians(gps_lon - 2.3522) / 2), 2))"


@query("v14_haversine_asin", f"SELECT path, round(2 * 6371.0 * asin(sqrt({_H})), 6) AS km FROM file_hashes WHERE gps_lat IS NOT NULL")
def asin(lib):
    rows = lib.file_hashes.where("gps_lat IS NOT NULL")
    return rows.select("path", F.round(C.haversine_asin(F.lit(48.8566), F.lit(2.3522), F.col("gps_lat"), F.col("gps_lon")), 6).alias("km"))


@query("v15_haversine_atan2", f"SELECT path, round(2 * 6371.0 * atan2(sqrt({_H}), sqrt(1 - {_H})), 6) AS km FROM file_hashes WHERE gps_lat IS NOT NULL")
def atan2(lib):
    rows = lib.file_hashes.where("gps_lat IS NOT NULL")
    return rows.select("path", F.round(C.haversine_atan2(F.lit(48.8566), F.lit(2.3522), F.col("gps_lat"), F.col("gps_lon")), 6).alias("km"))


@query("v16_dhash")
def difference_hash(lib):
    images = [(k, np.add.outer(np.arange(32) * k, np.arange(48) * (3 - k)) % 251) for k in range(4)]
    return lib.spark.createDataFrame([(k, dhash(p)) for k, p in images], "image int, phash bigint")


@query("v17_hamming", "SELECT path, CAST(bit_count(xor(phash, -1::BIGINT)) AS INTEGER) AS bits FROM file_hashes")
def hamming(lib):
    return lib.file_hashes.select("path", C.hamming(F.col("phash"), F.lit(-1).cast("bigint")).alias("bits"))


def _prompts(lib) -> dict[str, list[float]]:
    got = {r.vec_id: list(r.embedding) for r in lib.embeddings.where(f"model_id = '{BASE}' AND vec_id < 4").select("vec_id", "embedding").collect()}
    return {name: got[i] for i, name in enumerate(vectors.PROMPTS)}


_NAMES = "CASE p.vec_id WHEN 0 THEN 'photo' WHEN 1 THEN 'screenshot' WHEN 2 THEN 'document' ELSE 'meme' END"
_CLASSIFIED = f"SELECT hash, CASE WHEN top - second > 0.05 THEN name ELSE 'unknown' END AS category, round(top, 6) AS confidence FROM (SELECT e.vec_id, any_value(e.hash) AS hash, max(s) AS top, max_by(name, s) AS name, list_sort(list(s), 'DESC')[2] AS second FROM (SELECT e.vec_id, e.hash, {_NAMES} AS name, {dot_sql('e.embedding', 'p.embedding')} AS s FROM emb e, emb p WHERE e.model_id = 'acme/base-224' AND p.model_id = 'acme/base-224' AND p.vec_id < 4) e GROUP BY e.vec_id)"


@query("v18_classify", _CLASSIFIED)
def zero_shot(lib):
    got = vectors.classify(lib.embeddings.where(f"model_id = '{BASE}'"), _prompts(lib), 0.05)
    return got.select("hash", "category", F.round("confidence", 6).alias("confidence"))


@query("v19_prompts", "SELECT * FROM (VALUES ('photo', 'a photo of a person, place, or thing'), ('screenshot', 'a screenshot of a phone or computer screen'), ('document', 'a photo of a document, receipt, or piece of paper'), ('meme', 'a meme image with text captions overlaid on a picture')) t(category, caption)")
def prompts(lib):
    return lib.spark.createDataFrame(list(vectors.PROMPTS.items()), "category string, caption string")


@query("v20_classify_job", f"SELECT DISTINCT hash, category FROM ({_CLASSIFIED}) c WHERE hash NOT IN (SELECT hash FROM classifications) AND hash NOT IN (SELECT hash FROM file_hashes WHERE mime IN ('video/quicktime','video/mp4') OR (mime IS NULL AND lower(ext) IN ('mov','mp4')))")
def classify_job(lib):
    return classify.classify_job(lib.file_hashes, lib.embeddings, lib.classifications, BASE, _prompts(lib)).select("hash", "category").distinct()


@query("v21_embed_job")
def embed_job(lib):
    got = classify.embed_job(lib.file_hashes, lib.embeddings, "acme/large-384", classify.hashing_embedder())
    return got.select("model_id", "hash", F.round(F.element_at("embedding", 1), 5).alias("first"))


@query("v22_embedder")
def embedder(lib):
    v = classify.hashing_embedder(4)(["a", "b"])
    return lib.spark.createDataFrame([(k, [round(float(x), 6) for x in row]) for k, row in zip("ab", v)], "item string, vector array<double>")


@query("v23_batch_check", "SELECT 'RuntimeError' AS outcome")
def batch_check(lib):
    one = classify.hashing_embedder(4)
    wrong = lambda items: one(items) if len(items) == 1 else -one(items)
    items = [str(i) for i in range(48)]
    try:
        classify.verify_batch(wrong, items, wrong(items))
        said = "accepted"
    except RuntimeError:
        said = "RuntimeError"
    return lib.spark.createDataFrame([(said,)], "outcome string")


@query("v24_clamp_batch", "SELECT * FROM (VALUES (0, 1), (96, 96), (5000, 768)) t(asked, used)")
def clamp(lib):
    return lib.spark.createDataFrame([(b, classify.clamp_batch(b)) for b in (0, 96, 5000)], "asked int, used int")


@query("v25_image_size", "SELECT * FROM (VALUES ('a/base-224', 224), ('a/base', 384), ('a/b-4096', 384)) t(model, pixels)")
def sizes(lib):
    return lib.spark.createDataFrame([(m, image_size(m)) for m in ("a/base-224", "a/base", "a/b-4096")], "model string, pixels int")


@query("v31_round_robin", "SELECT path, CAST((row_number() OVER (ORDER BY path) - 1) % 4 AS INTEGER) AS worker FROM file_hashes")
def round_robin(lib):
    """Files dealt out in turn, in path order."""
    return dealt(lib.file_hashes.select("path"), ["path"], 4)


@query("v33_model_resolution", "SELECT * FROM (VALUES ('x/y', 'x/y'), ('', 'google/siglip-base-patch16-224'), ('bad', 'ValueError')) t(asked, used)")
def resolution(lib):
    def said(m):
        try:
            return resolve_model(m or None)
        except ValueError:
            return "ValueError"

    return lib.spark.createDataFrame([(m, said(m)) for m in ("x/y", "", "bad")], "asked string, used string")


@query("v34_single_stage")
def single_stage(lib):
    return clustering.label_clusters(clustering.average_linkage_cosine(lib.faces, 0.7), 2)
