"""Windows, sorting, limits and top-k (W), and the flagship search."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.operators import duplicates, faces, places, search, vectors
from argentum.operators.numbering import numbered
from argentum.operators.selection import Selection

from .registry import BEST, EFF, EFF_MIME, PHOTO, dot_sql, km_sql, query

BASE = "acme/base-224"
_KEEP_EFF = f"SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {EFF}, path) AS rn FROM file_hashes"
_KEEP_BEST = f"SELECT *, {BEST} AS best_date, row_number() OVER (PARTITION BY hash ORDER BY {BEST}, path) AS rn FROM file_hashes"


@query("flagship_search", f"SELECT path, hash, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS distance_km, {EFF} AS date, size_bytes FROM file_hashes WHERE hash IN (SELECT hash FROM file_hashes WHERE {EFF} >= '2019-01-01T00:00:00' AND {EFF} < '2020-01-01T00:00:00') AND hash IN (SELECT hash FROM file_hashes WHERE {EFF_MIME} IN {PHOTO}) ORDER BY date DESC NULLS LAST, size_bytes DESC NULLS LAST, path LIMIT 50")
def flagship(lib):
    return lib.search(date="2019", kinds=["image"], sort="date,size", k=50)


@query("w01_keep_by_effective_date", f"SELECT hash, path FROM ({_KEEP_EFF}) WHERE rn = 1")
def keep_by_effective(lib):
    return search.keep_one_by_effective_date(lib.file_hashes).select("hash", "path")


@query("w02_keep_by_best_date", f"SELECT hash, path, best_date FROM ({_KEEP_BEST}) WHERE rn = 1")
def keep_by_best(lib):
    return search.keep_one_by_best_date(lib.file_hashes).select("hash", "path", "best_date")


@query("w03_multi_key_sort", f"SELECT path, {EFF} AS date, size_bytes, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, {EFF} ASC NULLS LAST, path) AS pos FROM file_hashes")
def multi_key(lib):
    """Every file with its place in the order."""
    rows = search.library_rows(lib.file_hashes).select("path", "date", "size_bytes")
    return numbered(rows, search.order_by(search.parse_sort("size,date:asc")), "pos", 1)


def _order(*keys):
    from pyspark.sql import Window

    return Window.orderBy(*keys)


_GPS = f"SELECT hash, min({km_sql(48.8566, 2.3522)}) AS km FROM file_hashes WHERE gps_lat IS NOT NULL AND {km_sql(48.8566, 2.3522)} <= 400 GROUP BY hash"


@query("w04_missing_last", "SELECT path, exif_date, row_number() OVER (ORDER BY exif_date ASC NULLS LAST, path) AS up, row_number() OVER (ORDER BY exif_date DESC NULLS LAST, path) AS down FROM file_hashes")
def missing_last(lib):
    """Every file's place going up and going down; missing dates are last either way."""
    rows = lib.file_hashes.select("path", "exif_date")
    up = numbered(rows, [F.asc_nulls_last("exif_date"), F.asc("path")], "up", 1)
    return numbered(up, [F.desc_nulls_last("exif_date"), F.asc("path")], "down", 1)


def _said(f) -> str:
    try:
        return ",".join(f"{n}:{'desc' if d else 'asc'}" for n, d in f())
    except ValueError:
        return "ValueError"


@query("w05_sort_spec", "SELECT * FROM (VALUES ('date', 'date:desc'), ('distance,size:asc', 'distance:asc,size:asc'), ('date,date', 'ValueError'), ('speed', 'ValueError'), ('', 'ValueError')) t(spec, keys)")
def sort_spec(lib):
    return lib.spark.createDataFrame([(s, _said(lambda s=s: search.parse_sort(s))) for s in ("date", "distance,size:asc", "date,date", "speed", "")], "spec string, keys string")


@query("w06_default_sort", "SELECT * FROM (VALUES ('ranked', 'relevance:desc'), ('placed', 'distance:asc'), ('plain', 'date:desc'), ('bad', 'ValueError')) t(query, keys)")
def default_sort(lib):
    rows = [("ranked", _said(lambda: search.resolve_sort(None, True, False))), ("placed", _said(lambda: search.resolve_sort(None, False, True))), ("plain", _said(lambda: search.resolve_sort(None, False, False))), ("bad", _said(lambda: search.resolve_sort("relevance", False, False)))]
    return lib.spark.createDataFrame(rows, "query string, keys string")


def _vector(lib, vec_id: int = 0) -> list[float]:
    return list(lib.embeddings.where(f"model_id = '{BASE}' AND vec_id = {vec_id}").select("embedding").head().embedding)


_SCORES = f"SELECT e.hash, {dot_sql('e.embedding', 'q.v')} AS score FROM emb e, (SELECT embedding AS v FROM emb WHERE model_id = 'acme/base-224' AND vec_id = 0) q WHERE model_id = 'acme/base-224'"


@query("w07_top_k", f"SELECT hash, round(score, 6) AS score FROM ({_SCORES}) ORDER BY score DESC, hash LIMIT 25")
def top_k(lib):
    return search.top_k(search.scored(lib.embeddings, BASE, _vector(lib)), 25).select("hash", F.round("score", 6).alias("score"))


@query("w08_search_top_k", f"WITH t AS (SELECT * FROM ({_SCORES}) ORDER BY score DESC, hash LIMIT 15) SELECT path, f.hash, round(score, 6) AS score FROM file_hashes f JOIN t USING (hash) ORDER BY score DESC, path LIMIT 15")
def ranked_search(lib):
    return search.search(lib, query=_vector(lib), model=BASE, k=15).select("path", "hash", F.round("score", 6).alias("score"))


@query("w08_total_matches", "SELECT count(*) AS total_matches FROM file_hashes JOIN emb USING (hash) WHERE model_id = 'acme/base-224' AND hash IN (SELECT hash FROM file_hashes WHERE ext = 'jpg')")
def total_matches(lib):
    return search.total_matches(lib, Selection(exts=["jpg"]), _vector(lib), BASE)


@query("w09_page", "SELECT path FROM file_hashes ORDER BY path LIMIT 50 OFFSET 100")
def page(lib):
    return search.page(lib.file_hashes, "files", 100, 50).select("path")


@query("w09_date_page", f"SELECT path FROM ({_KEEP_EFF}) WHERE rn = 1 ORDER BY path LIMIT 200 OFFSET 20")
def date_page(lib):
    return search.page(lib.file_hashes, "date", 20).select("path")


@query("w10_truncated_report", "SELECT lower(ext) AS ext, count(*) AS files FROM file_hashes GROUP BY 1 ORDER BY files DESC, 1 LIMIT 5")
def truncated(lib):
    return lib.file_hashes.groupBy(F.lower("ext").alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(5)


@query("w11_similar", f"WITH q AS (SELECT hash AS own FROM emb WHERE model_id = 'acme/base-224' AND vec_id = 0) SELECT hash, round(score, 6) AS score FROM ({_SCORES}), q WHERE hash <> own ORDER BY score DESC, hash LIMIT 24")
def similar(lib):
    own = lib.embeddings.where(f"model_id = '{BASE}' AND vec_id = 0").select("hash").head().hash
    return lib.similar(own).select("hash", F.round("score", 6).alias("score"))


@query("w12_sorted_groups", f"SELECT hash, nullif(max(best_date) FILTER (WHERE rn = 1), '') AS date, CAST(row_number() OVER (ORDER BY nullif(max(best_date) FILTER (WHERE rn = 1), '') ASC NULLS LAST, hash) AS INTEGER) AS pos FROM ({_KEEP_BEST}) GROUP BY hash HAVING count(*) > 1")
def sorted_groups(lib):
    got = duplicates.sort_groups(lib.file_hashes, "date:asc").select("hash", "date")
    return got.withColumn("pos", F.row_number().over(_order(F.asc_nulls_last("date"), "hash")))


@query("w13_date_buckets", f"SELECT substr(best_date, 1, 7) AS bucket, count(*) AS files FROM ({_KEEP_BEST}) WHERE rn = 1 AND best_date <> '' GROUP BY 1")
def date_buckets(lib):
    return search.date_buckets(lib.file_hashes, 7)


@query("w14_places_by_count", "SELECT photo_count, CAST(row_number() OVER (ORDER BY photo_count DESC) AS INTEGER) AS pos FROM (SELECT count(*) AS photo_count FROM (SELECT CASE WHEN gps_lat > 52.2 THEN 'Berlin' WHEN gps_lat > 50 THEN 'London' WHEN gps_lat > 45 THEN 'Paris' WHEN gps_lon > 10 THEN 'Istanbul' ELSE 'Madrid' END AS city FROM file_hashes WHERE gps_lat IS NOT NULL) GROUP BY city)")
def places_by_count(lib):
    got = places.location_clusters(lib.file_hashes, lib.gazetteer, 50.0)[0].select("photo_count")
    return got.withColumn("pos", F.row_number().over(_order(F.desc("photo_count"))))


@query("w15_detail_order", "SELECT person_label, id, CAST(row_number() OVER (PARTITION BY person_label ORDER BY is_primary DESC, id) AS INTEGER) AS pos FROM faces WHERE confirmed = 1 AND person_label IS NOT NULL")
def detail_order(lib):
    view = faces.people_view(lib.faces, lib.people)
    return view.select(F.col("label").alias("person_label"), F.posexplode("face_ids").alias("p", "id")).select("person_label", "id", (F.col("p") + 1).alias("pos"))


_NMS = """WITH RECURSIVE boxes AS (SELECT id % 20 AS image, CAST(id % 300 AS DOUBLE) AS x1, CAST(id % 200 AS DOUBLE) AS y1, CAST(id % 300 + 40 + id % 120 AS DOUBLE) AS x2, CAST(id % 200 + 40 + id % 90 AS DOUBLE) AS y2, id / 1000 AS score, row_number() OVER (ORDER BY id DESC) AS k FROM faces),
walk(k, kept, stays) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(image BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]), false
  UNION ALL
  SELECT k, CASE WHEN free THEN list_append(kept, own) ELSE kept END, free FROM (
    SELECT b.k, kept, struct_pack(image := b.image, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2) AS own,
      len(list_filter(kept, lambda o: o.image = b.image AND
        greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1))
        > 0.4 * ((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1))))) = 0 AS free
    FROM walk JOIN boxes b ON b.k = walk.k + 1))
SELECT image, x1, y1, x2, y2, score FROM boxes JOIN walk USING (k) WHERE stays"""


@query("w16_non_max_suppression", _NMS)
def nms(lib):
    from argentum.functions.columns import bbox_corners

    box = bbox_corners(F.col("bbox"))
    rows = lib.faces.select((F.col("id") % 20).alias("image"), *(box[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), (F.col("id") / 1000).alias("score"))
    return vectors.non_max_suppression(rows)


@query("w17_people_by_name", "SELECT coalesce(full_name, person_label) AS person, CAST(row_number() OVER (ORDER BY lower(coalesce(full_name, person_label)), person_label) AS INTEGER) AS pos FROM (SELECT DISTINCT person_label FROM faces WHERE confirmed = 1 AND person_label IS NOT NULL) LEFT JOIN people ON name = person_label")
def people_by_name(lib):
    view = faces.people_view(lib.faces, lib.people).select("label", "full_name")
    return view.withColumn("pos", F.row_number().over(_order(F.lower("full_name"), "label"))).select(F.col("full_name").alias("person"), "pos")
