"""Sources and sinks (S)."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.functions import media
from argentum.operators import faces, pending, places, search
from argentum.sources import catalogs, scan, sinks, takeout
from argentum.storage import scratch_dir, table

from .aggregates import takeout_listing
from .joins import _FOLDERS, _catalog
from .registry import query, raw_query


@raw_query("s02_file_records", "SELECT CAST(page_id AS VARCHAR) AS path, sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, 'application/octet-stream' AS mime FROM pages")
def records(spark, sf_dir):
    """Page bodies as files: digest, size and sniffed type without a UDF."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return rows.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("bigint").alias("size_bytes"), F.coalesce(C.sniff(F.col("content")), F.lit(C.UNKNOWN_MIME)).alias("mime"))


@query("s03_read_budget", "SELECT * FROM (VALUES (0, 20.0::DOUBLE), (2000000000, 100.0)) t(size_bytes, seconds)")
def budget(lib):
    return lib.spark.createDataFrame([(n, float(scan.read_budget(n))) for n in (0, 2_000_000_000)], "size_bytes bigint, seconds double")


def exif_jpeg(taken: str, lat=(48, 51, 24), ref=b"N") -> bytes:
    """A JPEG head with capture date and place."""
    date = taken.encode() + b"\x00"
    ifd0 = struct.pack("<H", 2) + struct.pack("<HHII", 0x8769, 4, 1, 100) + struct.pack("<HHII", 0x8825, 4, 1, 200) + struct.pack("<I", 0)
    sub = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(date), 300) + struct.pack("<I", 0)
    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, ref + b"\x00\x00\x00") + struct.pack("<HHII", 2, 5, 3, 340) + struct.pack("<HHI4s", 3, 2, 2, b"E\x00\x00\x00") + struct.pack("<HHII", 4, 5, 3, 370) + struct.pack("<I", 0)
    t = bytearray(400)
    for at, part in ((0, b"II*\x00" + struct.pack("<I", 8)), (8, ifd0), (100, sub), (200, gps), (300, date), (340, struct.pack("<6I", lat[0], 1, lat[1], 1, lat[2], 1)), (370, struct.pack("<6I", 2, 1, 21, 1, 8, 1))):
        t[at : at + len(part)] = part
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(t) + 8) + b"Exif\x00\x00" + bytes(t) + b"\xff\xd9"


@query("s04_exif", "SELECT '2020-05-06T07:08:09' AS exif_date, 48.856667::DOUBLE AS lat, 2.352222::DOUBLE AS lon")
def exif(lib):
    got = media.read_exif(exif_jpeg("2020:05:06 07:08:09"))
    return lib.spark.createDataFrame([(got["exif_date"], round(got["gps_lat"], 6), round(got["gps_lon"], 6))], "exif_date string, lat double, lon double")


@query("s05_dms_to_decimal", "SELECT * FROM (VALUES ('N', 1.505::DOUBLE), ('S', -1.505)) t(ref, x)")
def dms(lib):
    rows = lib.spark.createDataFrame([("N",), ("S",)], "ref string")
    return rows.select("ref", F.round(C.dms_to_decimal(F.lit(1), F.lit(30), F.lit(18), F.col("ref")), 6).alias("x"))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def movie(seconds=1_500, scale=600, created=3_700_000_000) -> bytes:
    """A small movie: one video track with size and codec, and a place in its keys."""
    mvhd = _box(b"mvhd", bytes(4), struct.pack(">IIII", created, created, scale, seconds), bytes(80))
    tkhd = _box(b"tkhd", bytes(4), bytes(20 + 16 + 36), struct.pack(">II", 1920 << 16, 1080 << 16))
    stsd = _box(b"stsd", bytes(8), struct.pack(">I", 16), b"avc1", bytes(8))
    trak = _box(b"trak", tkhd, _box(b"mdia", _box(b"hdlr", bytes(8), b"vide", bytes(12)), _box(b"minf", _box(b"stbl", stsd))))
    key = b"com.apple.quicktime.location.ISO6709"
    keys = _box(b"keys", bytes(8), struct.pack(">I", len(key) + 8), b"mdta", key)
    ilst = _box(b"ilst", _box(struct.pack(">I", 1), _box(b"data", bytes(8), b"+48.8566+002.3522/")))
    return _box(b"ftyp", b"qt  ", bytes(4)) + _box(b"moov", mvhd, trak, _box(b"meta", keys, ilst))


@query("s06_movie_metadata", "SELECT 2.5::DOUBLE AS duration_secs, 1920 AS width, 1080 AS height, 'avc1' AS codec, 48.8566::DOUBLE AS lat, true AS has_video, '2021-03-31T01:46:40' AS exif_date")
def movie_metadata(lib):
    m = media.read_video(movie())
    row = (m["duration_secs"], m["width"], m["height"], m["codec"], m["gps_lat"], m["has_video"], m["exif_date"])
    return lib.spark.createDataFrame([row], "duration_secs double, width int, height int, codec string, lat double, has_video boolean, exif_date string")


@query("s07_iso6709", "SELECT * FROM (VALUES ('+48.8566+002.3522/', 48.8566::DOUBLE, 2.3522::DOUBLE), ('-12.5-070.25+100.0/', -12.5, -70.25), ('+91.0+000.0/', NULL, NULL), ('x', NULL, NULL)) t(raw, lat, lon)")
def iso6709(lib):
    lat, lon = C.iso6709(F.col("raw"))
    return lib.spark.createDataFrame([(s,) for s in ("+48.8566+002.3522/", "-12.5-070.25+100.0/", "+91.0+000.0/", "x")], "raw string").select("raw", lat.alias("lat"), lon.alias("lon"))


@query("s08_apple_date", "SELECT * FROM (VALUES ('2021-05-06T07:08:09+0200', '2021-05-06T07:08:09'), ('2021/05/06 07:08:09', NULL)) t(raw, taken)")
def apple_date(lib):
    return lib.spark.createDataFrame([("2021-05-06T07:08:09+0200",), ("2021/05/06 07:08:09",)], "raw string").select("raw", C.apple_date(F.col("raw")).alias("taken"))


@query("s09_movie_date", "SELECT * FROM (VALUES (3700000000, '2021-03-31T01:46:40'), (0, NULL), (2082844800, NULL)) t(secs, taken)")
def movie_date(lib):
    return lib.spark.createDataFrame([(3_700_000_000,), (0,), (2_082_844_800,)], "secs bigint").select("secs", C.mvhd_date(F.col("secs")).alias("taken"))


@query("s10_moov_locator", "SELECT true AS found, false AS in_other")
def moov(lib):
    return lib.spark.createDataFrame([(media.find_moov(movie()) is not None, media.find_moov(_box(b"ftyp", b"qt  ")) is not None)], "found boolean, in_other boolean")


@query("s11_has_video", "SELECT true AS movie, true AS doubt, false AS audio_only")
def has_video(lib):
    audio = _box(b"moov", _box(b"trak", _box(b"mdia", _box(b"hdlr", bytes(8), b"soun", bytes(12)))))
    got = [media.read_video(x)["has_video"] for x in (movie(), b"junk", audio)]
    return lib.spark.createDataFrame([tuple(got)], "movie boolean, doubt boolean, audio_only boolean")


_HEADS = [
    ("jpeg", b"\xff\xd8\xff" + bytes(9), "image/jpeg"), ("png", b"\x89PNG\r\n\x1a\n" + bytes(4), "image/png"), ("gif", b"GIF89a" + bytes(6), "image/gif"), ("bmp", b"BM" + bytes(10), "image/bmp"),
    ("tiff", b"MM\x00*" + bytes(8), "image/tiff"), ("webp", b"RIFF\x00\x00\x00\x00WEBP", "image/webp"), ("heic", b"\x00\x00\x00\x18ftypheic", "image/heic"), ("mov", b"\x00\x00\x00\x18ftypqt  ", "video/quicktime"),
    ("mp4", b"\x00\x00\x00\x18ftypisom", "video/mp4"), ("old", b"\x00\x00\x00\x18mdat\x00\x00\x00\x00", "video/quicktime"), ("short", b"\xff\xd8\xff", None), ("text", b"hello world!", None),
]


@query("s12_sniff", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', " + (f"'{m}'" if m else "NULL") + ")" for n, _, m in _HEADS) + ") t(name, mime)")
def sniff(lib):
    return lib.spark.createDataFrame([(n, b) for n, b, _ in _HEADS], "name string, content binary").select("name", C.sniff(F.col("content")).alias("mime"))


@query("s13_upsert_files", "SELECT path, CASE WHEN ext = 'jpg' THEN 'new' ELSE hash END AS hash, CASE WHEN ext = 'jpg' THEN NULL ELSE 'x' END AS location_name FROM file_hashes")
def upsert(lib):
    old = lib.file_hashes.withColumn("location_name", F.lit("x"))
    new = lib.file_hashes.where("ext = 'jpg'").drop("location_name", "location_cluster_id").withColumn("hash", F.lit("new"))
    return pending.upsert(old, new, ["path"]).select("path", "hash", "location_name")


@query("s14_load_records", "SELECT path, hash, size_bytes, ext, mime, phash, width, height, codec FROM file_hashes")
def load(lib):
    return lib.file_hashes.select("path", "hash", "size_bytes", "ext", "mime", "phash", "width", "height", "codec")


@query("s15_jsonl", "SELECT path, exif_date FROM file_hashes")
def jsonl(lib):
    import uuid

    to = f"{scratch_dir(lib.spark)}/jsonl-{uuid.uuid4().hex[:8]}"
    sinks.append_jsonl(lib.file_hashes, to)
    return lib.spark.read.schema("path string, exif_date string").json(to)


@query("s16_envelope", """SELECT '{"schema_version": 1, "total": 3}' AS document, '{"error": {"message": "no"}}' AS error""")
def envelope(lib):
    return lib.spark.createDataFrame([(sinks.envelope({"total": 3}), sinks.error_document("no"))], "document string, error string")


_PLACE = "CASE WHEN gps_lat > 52.2 THEN 'Berlin, DE' WHEN gps_lat > 50 THEN 'London, GB' WHEN gps_lat > 45 THEN 'Paris, FR' WHEN gps_lon > 10 THEN 'Istanbul, TR' ELSE 'Madrid, ES' END"


@query("s17_geojson", f"SELECT name, photo_count, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(row_number() OVER (ORDER BY photo_count DESC, lat, lon) AS INTEGER) AS pos FROM (SELECT city AS name, avg(gps_lon) AS lon, avg(gps_lat) AS lat, max(n) AS photo_count FROM (SELECT DISTINCT gps_lat, gps_lon, {_PLACE} AS city FROM file_hashes WHERE gps_lat IS NOT NULL) JOIN (SELECT {_PLACE} AS city, count(*) AS n FROM file_hashes WHERE gps_lat IS NOT NULL GROUP BY 1) USING (city) GROUP BY city)")
def geojson(lib):
    """Every feature of the collection: longitude first, most photos first."""
    clusters, _ = places.location_clusters(lib.file_hashes, lib.gazetteer, 50.0)
    j = F.from_json("document", "type string, features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<name:string,photo_count:bigint>>>")
    rows = sinks.geojson(clusters).select(F.posexplode(j["features"]).alias("pos", "f"))
    at = F.col("f.geometry.coordinates")
    return rows.select("f.properties.name", "f.properties.photo_count", F.round(at[0], 6).alias("lon"), F.round(at[1], 6).alias("lat"), (F.col("pos") + 1).alias("pos"))


@query("s20_models", "SELECT DISTINCT model_id FROM emb")
def models(lib):
    return lib.models()


@query("s19_missing_model", "SELECT 'LookupError' AS outcome")
def missing_model(lib):
    try:
        lib.model("no/such")
        said = "found"
    except LookupError:
        said = "LookupError"
    return lib.spark.createDataFrame([(said,)], "outcome string")


@query("s21_model_slug", "SELECT DISTINCT model_id, replace(model_id, '/', '--') AS slug, model_id AS back FROM emb")
def slug(lib):
    rows = lib.models().withColumn("slug", C.model_slug(F.col("model_id")))
    return rows.withColumn("back", C.model_from_slug(F.col("slug")))


@query("s22_load_embeddings", "SELECT hash, CAST(len(embedding) AS INTEGER) AS dims FROM emb WHERE model_id = 'acme/large-384'")
def load_embeddings(lib):
    return lib.embeddings.where("model_id = 'acme/large-384'").select("hash", F.size("embedding").alias("dims"))


@query("s23_upsert_embeddings", "SELECT model_id, hash, embedded_at FROM emb WHERE model_id <> 'acme/large-384' UNION ALL SELECT DISTINCT model_id, hash, 'again' FROM emb WHERE model_id = 'acme/large-384'")
def upsert_embeddings(lib):
    """New rows replace old ones; of new rows with one key, which equal contents give, one stays."""
    new = lib.embeddings.where("model_id = 'acme/large-384'").withColumn("embedded_at", F.lit("again"))
    return pending.upsert(lib.embeddings, new, ["model_id", "hash"]).select("model_id", "hash", "embedded_at")


@query("s24_replace_faces", "SELECT id, hash FROM faces WHERE hash <> 'orphan_0' AND hash <> (SELECT hash FROM faces WHERE id = 3) UNION ALL SELECT 9001, hash FROM faces WHERE id = 3")
def replace_faces(lib):
    own = lib.faces.where("id = 3").select("hash").head().hash
    new = lib.spark.createDataFrame([(9001, own)], "id bigint, hash string")
    return pending.replace_by_hash(lib.faces.where("hash <> 'orphan_0'"), own, new).select("id", "hash")


@query("s25_upsert_classifications", "SELECT DISTINCT hash, CASE WHEN category = 'meme' THEN 'photo' ELSE category END AS category FROM classifications WHERE hash NOT IN (SELECT hash FROM classifications WHERE category = 'meme') UNION SELECT DISTINCT hash, 'photo' FROM classifications WHERE category = 'meme'")
def upsert_classifications(lib):
    new = lib.classifications.where("category = 'meme'").withColumn("category", F.lit("photo"))
    return pending.upsert(lib.classifications, new, ["model_id", "hash"]).select("hash", "category").distinct()


@query("s26_catalog_folders", _FOLDERS)
def catalog_folders(lib):
    return catalogs.catalog_folders(_catalog(lib))


@query("s28_sidecar_index", "SELECT doc_id AS i, 1 AS n FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 10 <> 1 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 10 = 1")
def sidecar_index(lib):
    _, sidecars = takeout_listing(lib)
    return sidecars.groupBy(F.regexp_extract("sidecar", r"^(\d+)\.", 1).cast("bigint").alias("i")).agg(F.count("*").cast("int").alias("n"))


@query("s29_match_sidecars", "SELECT doc_id AS i, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 10 = 1 AND doc_id % 2 = 1 THEN 'ambiguous' ELSE 'found' END AS status FROM documents")
def match(lib):
    got = takeout.match_sidecars(*takeout_listing(lib))
    return got.select(F.regexp_extract("name", r"^(\d+)\.", 1).cast("bigint").alias("i"), "status")


_SIDE = [("a", '{"photoTakenTime":{"timestamp":"1588748889"},"geoData":{"latitude":48.5,"longitude":2.25}}'), ("b", '{"photoTakenTime":{"timestamp":"x"},"geoData":{"latitude":0.0,"longitude":0.0}}'), ("c", "{}")]


@query("s30_parse_sidecar", "SELECT * FROM (VALUES ('a', 1588748889, 48.5::DOUBLE), ('b', NULL, NULL), ('c', NULL, NULL)) t(name, taken, lat)")
def parse(lib):
    return takeout.parse_sidecars(lib.spark.createDataFrame(_SIDE, "name string, value string")).select("name", "taken", "lat")


@query("s31_recover_dates", "SELECT count(*) FILTER (WHERE doc_id % 4 <> 0) AS pending, count(*) FILTER (WHERE doc_id % 4 = 0) AS already_correct, count(*) FILTER (WHERE doc_id % 3 <> 0) AS with_location FROM documents")
def recover(lib):
    i = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint")
    rows = lib.file_hashes.select("path", i.alias("taken"), F.when(i % 4 == 0, i).otherwise(i + 1).alias("mtime"), F.col("gps_lat").alias("lat"))
    return takeout.recover_dates(rows)[1]


@query("s32_library_shape", "SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, quantile_disc(size_bytes, 0.5) AS median, quantile_disc(size_bytes, 0.5) < 307200 AS optimised, count(*) <= 100 AND sum(size_bytes) * 10 < 1000000000 AS referenced FROM file_hashes")
def shape(lib):
    return catalogs.library_shape(lib.file_hashes, 1_000_000_000)


@query("s35_fix_dates_plan", "SELECT path, exif_date AS taken FROM file_hashes WHERE exif_date IS NOT NULL AND exif_date NOT LIKE '0000%'")
def fix_dates(lib):
    return sinks.fix_dates_plan(lib.file_hashes)


@query("s36_page_vectors", "SELECT DISTINCT hash FROM emb WHERE model_id = 'acme/large-384' AND hash IN (SELECT hash FROM file_hashes)")
def page_vectors(lib):
    return sinks.page_vectors(lib.file_hashes, lib.embeddings, "acme/large-384").select("hash").distinct()


@query("s37_raw_lookup", "SELECT path, size_bytes FROM file_hashes WHERE path = (SELECT min(path) FROM file_hashes)")
def raw_lookup(lib):
    first = lib.file_hashes.agg(F.min("path").alias("p")).head().p
    return lib.file_hashes.where(F.col("path") == first).select("path", "size_bytes")


@query("s38_cache_name", "SELECT hash || '_256.jpg' AS name, hash FROM file_hashes UNION ALL SELECT 'readme.txt', NULL")
def cache_name(lib):
    names = lib.file_hashes.select(F.concat("hash", F.lit("_256.jpg")).alias("name")).union(lib.spark.createDataFrame([("readme.txt",)], "name string"))
    return names.select("name", C.hash_from_cache_name(F.col("name")).alias("hash"))


@query("s40_geocode_cache", "SELECT lat, lon FROM geocode_cache WHERE query = 'paris, france'")
def geocode(lib):
    return lib.spark.createDataFrame([lib.geocode("  Paris, France ")], "lat double, lon double")


@query("s41_gazetteer", "SELECT name, cc, lat, lon FROM gazetteer")
def gazetteer(lib):
    return lib.gazetteer


@query("s42_faces_for_clustering", "SELECT id, CAST(len(embedding) AS INTEGER) AS dims, CAST(least(40 + id % 120, 40 + id % 90) AS DOUBLE) AS side FROM faces")
def faces_for_clustering(lib):
    return lib.faces.select("id", F.size("embedding").alias("dims"), C.bbox_min_side(F.col("bbox")).alias("side"))


@query("s43_scan_marks", "SELECT hash FROM faces_scanned UNION SELECT hash FROM faces")
def marks(lib):
    return pending.mark_scanned(lib.faces_scanned, lib.faces, "2024-03-01 00:00:00").select("hash")


@query("s43_hashes_with_faces", "SELECT DISTINCT hash FROM faces")
def with_faces(lib):
    return pending.hashes_with_faces(lib.faces)


@query("s49_file_json", "SELECT path, size_bytes FROM file_hashes")
def file_json(lib):
    got = sinks.file_json(lib.file_hashes, faces.labeled_faces_by_hash(lib.faces, lib.people))
    j = F.from_json("document", "path string, size_bytes bigint")
    return got.select(j["path"].alias("path"), j["size_bytes"].alias("size_bytes"))


@query("s50_rows_for_paths", "SELECT * FROM (SELECT path, CAST(0 AS INTEGER) AS pos FROM file_hashes ORDER BY path DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT path, CAST(2 AS INTEGER) AS pos FROM file_hashes ORDER BY path LIMIT 1)")
def rows_for_paths(lib):
    ends = lib.file_hashes.agg(F.max("path").alias("b"), F.min("path").alias("a")).head()
    return search.rows_for_paths(lib.file_hashes, [ends.b, "/no/such", ends.a]).select("path", "pos")


@query("s51_data_block", "SELECT (SELECT count(*) FROM (SELECT hash FROM file_hashes GROUP BY hash HAVING count(*) > 1)) AS n_groups, (SELECT count(*) FROM file_hashes) AS n_files, (SELECT count(DISTINCT hash) FROM file_hashes) AS n_keep")
def data_block(lib):
    from argentum.operators.duplicates import duplicate_groups

    got = sinks.data_block(lib.file_hashes, duplicate_groups(lib.file_hashes), search.keep_one_by_best_date(lib.file_hashes), False)
    j = F.from_json("document", "groups array<struct<hash:string>>, all_files array<string>, keep_files array<string>")
    return got.select(*(F.size(j[c]).cast("bigint").alias(n) for c, n in (("groups", "n_groups"), ("all_files", "n_files"), ("keep_files", "n_keep"))))


@query("s52_hit_lines", "SELECT path, CAST(size_bytes AS VARCHAR) || chr(9) || path AS line FROM (SELECT path, size_bytes FROM file_hashes WHERE hash IN (SELECT hash FROM file_hashes WHERE ext = 'webp') ORDER BY size_bytes DESC NULLS LAST, path LIMIT 20)")
def hit_lines(lib):
    return search.hit_lines(lib.search(exts=["webp"], sort="size", k=20), "size")


@query("s54_place_lines", "SELECT lpad(CAST(n AS VARCHAR), 6, ' ') || '  ' || city AS line FROM (SELECT CASE WHEN gps_lat > 52.2 THEN 'Berlin, DE' WHEN gps_lat > 50 THEN 'London, GB' WHEN gps_lat > 45 THEN 'Paris, FR' WHEN gps_lon > 10 THEN 'Istanbul, TR' ELSE 'Madrid, ES' END AS city, count(*) AS n FROM file_hashes WHERE gps_lat IS NOT NULL GROUP BY 1)")
def place_lines(lib):
    return places.summary_lines(places.location_clusters(lib.file_hashes, lib.gazetteer, 50.0)[0]).select("line")
