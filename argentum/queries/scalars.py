"""Scalar functions (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.storage import table

from .registry import query, raw_query


def _rows(lib, values, kind="s string"):
    return lib.spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], kind)


@query("x01_sql_functions", "SELECT path, lower(coalesce(nullif(ext, ''), '(none)')) AS low, CASE WHEN mime IS NULL THEN 'n' ELSE 'y' END AS typed FROM file_hashes")
def sql_functions(lib):
    return lib.file_hashes.select("path", C.ascii_lower(F.coalesce(F.nullif("ext", F.lit("")), F.lit("(none)"))).alias("low"), F.when(F.col("mime").isNull(), "n").otherwise("y").alias("typed"))


@query("x02_zero_date_prefix", "SELECT path FROM file_hashes WHERE exif_date LIKE '0000%'")
def zero_prefix(lib):
    return lib.file_hashes.where(F.col("exif_date").startswith("0000")).select("path")


@query("x03_rounded_coordinates", "SELECT path, CAST(round(gps_lat * 1000000) AS BIGINT) AS lat6 FROM file_hashes WHERE gps_lat IS NOT NULL")
def rounded(lib):
    return lib.file_hashes.where("gps_lat IS NOT NULL").select("path", F.round(F.round("gps_lat", 6) * 1000000).cast("bigint").alias("lat6"))


@query("x04_dimension", "SELECT model_id, max(2 * len(embedding)) // 2 AS dims FROM emb GROUP BY model_id")
def dimension(lib):
    from argentum.operators.vectors import to_f16

    blobs = lib.embeddings.select("model_id", to_f16("embedding").alias("b"))
    return blobs.groupBy("model_id").agg(F.floor(F.max(F.octet_length("b")) / 2).alias("dims"))


@query("x05_utc_now")
def utc_now(lib):
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return lib.spark.range(1).select(now.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$").alias("ok"))


@query("x06_concat", "SELECT hash || ':' || ext AS key FROM file_hashes")
def concat(lib):
    return lib.file_hashes.select(F.concat("hash", F.lit(":"), "ext").alias("key"))


_NAMES = [("Işıl Özyeğin", "isil_ozyegin"), ("  Erhan  ", "erhan"), ("!!!", None), ("Anne-Marie", "annemarie"), ("a _ b", "a_b"), ("Çağdaş", "cagdas"), ("_x_", "x"), ("Łukasz 2", "lukasz_2"), ("a - b", "a_b"), ("Ştefan!", "stefan")]


def _values(rows) -> str:
    lit = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@query("x07_normalize_name", f"SELECT * FROM (VALUES {_values(_NAMES)}) t(raw, name)")
def normalize(lib):
    return _rows(lib, [n for n, _ in _NAMES], "raw string").select("raw", C.normalize_name(F.col("raw")).alias("name"))


@query("x08_fold", "SELECT * FROM (VALUES ('ÀÉÎÕÜ', 'aeiou'), ('ğşçıİ', 'gscii'), ('plain', 'plain')) t(raw, folded)")
def fold(lib):
    return _rows(lib, ["ÀÉÎÕÜ", "ğşçıİ", "plain"], "raw string").select("raw", C.fold(F.col("raw")).alias("folded"))


_SHOWN = [("Ahmet   Ari", "Ahmet Ari"), (" x\ty ", "xy"), ("   ", None), ("a" * 70, "a" * 60)]


@query("x09_display_name", f"SELECT * FROM (VALUES {_values(_SHOWN)}) t(raw, shown)")
def display(lib):
    return _rows(lib, [r for r, _ in _SHOWN], "raw string").select("raw", C.display_name(F.col("raw")).alias("shown"))


@query("x10_sanitized_label", "SELECT name, nullif(trim(regexp_replace(full_name, '\\s+', ' ', 'g')), '') AS label FROM people")
def sanitized(lib):
    return lib.people.select("name", C.display_name(F.col("full_name")).alias("label"))


@query("x11_normalize_ext", "SELECT * FROM (VALUES (' .JPG', 'jpg'), ('..Heic', 'heic'), ('png', 'png')) t(raw, ext)")
def ext(lib):
    return _rows(lib, [" .JPG", "..Heic", "png"], "raw string").select("raw", C.normalise_ext(F.col("raw")).alias("ext"))


@raw_query("x12_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def rfc3339(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.rfc3339(F.col("ts")).alias("at"))


@query("x13_human_bytes", "SELECT * FROM (VALUES (0, '0 B'), (1023, '1023 B'), (1024, '1.0 KB'), (1536, '1.5 KB'), (5242880, '5.0 MB'), (1099511627776, '1.0 TB')) t(n, said)")
def human_bytes(lib):
    return _rows(lib, [0, 1023, 1024, 1536, 5242880, 1099511627776], "n bigint").select("n", C.human_bytes(F.col("n")).alias("said"))


@query("x14_human_duration", "SELECT * FROM (VALUES (132, '132ms'), (3200, '3.2s'), (41000, '41s'), (77000, '1m 17s'), (120000, '2m'), (7200000, '2h'), (7260000, '2h 1m')) t(ms, said)")
def human_duration(lib):
    return _rows(lib, [132, 3200, 41000, 77000, 120000, 7200000, 7260000], "ms bigint").select("ms", C.human_duration(F.col("ms")).alias("said"))


@query("x15_json_escape", "SELECT path, '{\"path\":\"' || path || '\"}' AS document FROM file_hashes")
def json_escape(lib):
    return lib.file_hashes.select("path", F.to_json(F.struct("path")).alias("document"))


@query("x16_bbox_corners", "SELECT id, CAST(id % 300 + 40 + id % 120 AS DOUBLE) AS x2, CAST(id % 200 + 40 + id % 90 AS DOUBLE) AS y2 FROM faces")
def corners(lib):
    box = C.bbox_corners(F.col("bbox"))
    return lib.faces.select("id", box[2].alias("x2"), box[3].alias("y2"))


@query("x17_path_kind", "SELECT path FROM file_hashes WHERE ext IN ('mov', 'mp4')")
def path_kind(lib):
    return lib.file_hashes.where(C.path_is_kind("video", F.col("path"))).select("path")


@query("x18_geocode_key", "SELECT * FROM (VALUES ('  Paris, France ', 'paris, france')) t(raw, key)")
def geocode_key(lib):
    return _rows(lib, ["  Paris, France "], "raw string").select("raw", C.geocode_key(F.col("raw")).alias("key"))


@query("x19_describe_query", "SELECT * FROM (VALUES (1, 'cats'), (2, 'bob'), (3, 'filter')) t(i, said)")
def describe(lib):
    from argentum.operators.search import describe_query
    from argentum.operators.selection import Selection

    rows = [(1, describe_query("cats", None, Selection(person="bob"))), (2, describe_query(None, None, Selection(person="bob"))), (3, describe_query(None, None, Selection(exts=["jpg"])))]
    return lib.spark.createDataFrame(rows, "i int, said string")


@query("x20_counters_and_edits", "SELECT * FROM (VALUES ('a(1).jpg', 'a.jpg', '1', NULL), ('a-edited.jpg', NULL, NULL, 'a.jpg'), ('Trip (Copenhagen).jpg', NULL, NULL, NULL), ('b (12)', 'b', '12', NULL)) t(name, base, n, unedited)")
def counters(lib):
    base, n = C.split_counter(F.col("name"))
    return _rows(lib, ["a(1).jpg", "a-edited.jpg", "Trip (Copenhagen).jpg", "b (12)"], "name string").select("name", base.alias("base"), n.alias("n"), C.strip_edited(F.col("name")).alias("unedited"))


@query("x21_half_decode", "SELECT * FROM (VALUES (1, 1.0::DOUBLE), (2, -2.0), (3, 65504.0), (4, 5.960464477539063e-08)) t(i, x)")
def half_decode(lib):
    from argentum.operators.vectors import from_f16

    rows = [(1, b"\x00\x3c"), (2, b"\x00\xc0"), (3, b"\xff\x7b"), (4, b"\x01\x00")]
    return lib.spark.createDataFrame(rows, "i int, b binary").select("i", from_f16("b")[0].cast("double").alias("x"))


@query("x22_rational", "SELECT * FROM (VALUES (1, 2, 0.5::DOUBLE), (1, 0, 0.0)) t(num, den, x)")
def rational(lib):
    return _rows(lib, [(1, 2), (1, 0)], "num int, den int").select("num", "den", C.rational(F.col("num"), F.col("den")).alias("x"))


@query("x23_cache_names", "SELECT hash || '_256.jpg' AS thumb, hash || '_original.jpg' AS original FROM file_hashes")
def cache_names(lib):
    return lib.file_hashes.select(F.concat("hash", F.lit("_256.jpg")).alias("thumb"), F.concat("hash", F.lit("_original.jpg")).alias("original"))


@query("x24_library_id")
def library_id(lib):
    return _rows(lib, ["/home/a/photos.db"], "path string").select(F.concat(F.regexp_extract("path", r"([^/]+)\.db$", 1), F.lit("-"), F.hex(F.xxhash64("path"))).alias("id"))
