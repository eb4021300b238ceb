"""Predicates, projections and the filter algebra (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.operators import search as S
from argentum.operators import selection as sel
from argentum.operators.pending import known_mime_paths, pending_images

from .registry import BEST, EFF, EFF_MIME, PHOTO, VIDEO, km_sql, query

PARIS = (48.8566, 2.3522)


@query("f01_date_range", f"SELECT DISTINCT hash FROM file_hashes WHERE {EFF} >= '2019-01-08T00:00:00' AND {EFF} < '2019-02-01T00:00:00'")
def date_range(lib):
    return sel.by_date(lib.file_hashes, "2019-01-08T00:00:00", "2019-02-01T00:00:00")


@query("f02_effective_date", f"SELECT path, {EFF} AS effective_date FROM file_hashes")
def effective_date(lib):
    return lib.file_hashes.select("path", C.effective_date(F.col("exif_date"), F.col("modified_at")).alias("effective_date"))


@query("f03_best_date", f"SELECT path, {BEST} AS best_date FROM file_hashes")
def best_date(lib):
    return lib.file_hashes.select("path", C.best_date(F.col("exif_date"), F.col("created_at"), F.col("modified_at")).alias("best_date"))


@query("f04_expand_date", "SELECT * FROM (VALUES ('2019','2019-01-01T00:00:00','2020-01-01T00:00:00'),('2019-12','2019-12-01T00:00:00','2020-01-01T00:00:00'),('2020-02-28','2020-02-28T00:00:00','2020-02-29T00:00:00')) t(spec, start_at, end_at)")
def expand(lib):
    return lib.spark.createDataFrame([(s, *sel.expand_date(s)) for s in ("2019", "2019-12", "2020-02-28")], "spec string, start_at string, end_at string")


@query("f05_normalise_bound", "SELECT * FROM (VALUES ('2019-05','2019-05-01T00:00:00'),('2019-05-01T10:00:00','2019-05-01T10:00:00')) t(spec, bound)")
def bound(lib):
    return lib.spark.createDataFrame([(s, sel.normalise_bound(s)) for s in ("2019-05", "2019-05-01T10:00:00")], "spec string, bound string")


@query("f06_person", "SELECT DISTINCT hash FROM faces WHERE confirmed = 1 AND person_label = 'person_5'")
def person(lib):
    return sel.by_person(lib.faces, lib.people, "person_5")


@query("f07_identities", "SELECT * FROM (VALUES ('bob', 'bob'), ('bob', 'person_8'), ('isil ozyegin', 'isil_ozyegin'), ('isil ozyegin', 'person_4'), ('LUKASZ', 'lukasz'), ('LUKASZ', 'person_7')) t(typed, name)")
def identities(lib):
    from functools import reduce

    got = [sel.resolve_identities(lib.people, t).select(F.lit(t).alias("typed"), "name") for t in ("bob", "isil ozyegin", "LUKASZ")]
    return reduce(lambda a, b: a.union(b), got)


@query("f08_category", "SELECT DISTINCT hash FROM classifications WHERE model_id = 'acme/base-224' AND category = 'document'")
def category(lib):
    return sel.by_category(lib.classifications, "acme/base-224", "document")


@query("f09_radius", f"SELECT hash, round(min({km_sql(*PARIS)}), 6) AS distance_km FROM file_hashes WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND {km_sql(*PARIS)} <= 3.0 GROUP BY hash")
def radius(lib):
    return sel.by_location(lib.file_hashes, *PARIS, 3.0).select("hash", F.round("distance_km", 6).alias("distance_km"))


@query("f10_kind", f"SELECT DISTINCT hash FROM file_hashes WHERE {EFF_MIME} IN {VIDEO}")
def kind(lib):
    return sel.by_kinds(lib.file_hashes, ["video"])


@query("f11_extension", "SELECT DISTINCT hash FROM file_hashes WHERE lower(ext) IN ('heic', 'png')")
def extension(lib):
    return sel.by_exts(lib.file_hashes, [" .HEIC", "png"])


@query("f12_mime", "SELECT DISTINCT hash FROM file_hashes WHERE lower(mime) = 'image/webp'")
def mime(lib):
    return sel.by_mimes(lib.file_hashes, ["IMAGE/webp"])


@query("f13_path_subtree", "SELECT DISTINCT hash FROM file_hashes WHERE path LIKE '/lib/src1/%'")
def subtree(lib):
    return sel.by_paths(lib.file_hashes, ["/lib/src1/"])


_AND = f"SELECT DISTINCT hash FROM file_hashes WHERE {EFF_MIME} IN {PHOTO} INTERSECT SELECT hash FROM file_hashes WHERE {EFF} >= '2019-01-01T00:00:00' AND {EFF} < '2020-01-01T00:00:00' INTERSECT SELECT hash FROM file_hashes WHERE path LIKE '/lib/src2/%'"


@query("f14_conjunction", _AND)
def conjunction(lib):
    return lib.selection(date="2019", kinds=["image"], paths=["/lib/src2"]).resolve(lib)[0].distinct()


@query("f15_none_is_everything", "SELECT 'none' AS selection, count(*) AS files FROM file_hashes UNION ALL SELECT 'empty', 0")
def none_or_empty(lib):
    def files(selection, name):
        hashes, _ = selection.resolve(lib)
        rows = lib.file_hashes if hashes is None else lib.file_hashes.join(hashes, "hash", "left_semi")
        return rows.agg(F.count("*").alias("files")).select(F.lit(name).alias("selection"), "files")

    return files(sel.Selection(), "none").union(files(sel.Selection(mimes=["no/such"]), "empty"))


@query("f16_path_selection", "SELECT path FROM file_hashes WHERE ext IN ('mov', 'mp4') AND path LIKE '/lib/src4/%'")
def path_selection(lib):
    return sel.PathSelection(kinds=["video"], exts=["mov", "mp4"], paths=["/lib/src4"]).apply(lib.file_hashes.select("path"))


@query("f17_describe", "SELECT 'person=bob after=2019-01-01T00:00:00 type=image' AS said")
def describe(lib):
    return lib.spark.createDataFrame([(sel.Selection(person="bob", after="2019-01-01T00:00:00", kinds=["image"]).describe(),)], "said string")


_PENDING = f"SELECT DISTINCT hash FROM file_hashes f WHERE (mime IN {PHOTO} OR mime IN {VIDEO} OR (mime IS NULL AND lower(ext) IN ('jpg','jpeg','png','gif','webp','bmp','tiff','heic','dng','mov','mp4'))) AND lower(coalesce(ext, '')) <> 'dng' AND NOT EXISTS (SELECT 1 FROM emb e WHERE e.hash = f.hash AND e.model_id = 'acme/large-384')"


@query("f18_narrow", f"WITH p AS ({_PENDING}), s AS (SELECT hash FROM p INTERSECT SELECT hash FROM file_hashes WHERE path LIKE '/lib/src3/%') SELECT (SELECT count(*) FROM p) AS eligible, (SELECT count(*) FROM s) AS chosen, CASE WHEN (SELECT count(*) FROM p) = 0 THEN 'all done' WHEN (SELECT count(*) FROM s) = 0 THEN 'selection matched nothing' ELSE 'work' END AS state")
def narrowing(lib):
    pending = pending_images(lib.file_hashes, lib.embeddings, "acme/large-384").select("hash")
    return sel.narrow_report(pending, sel.by_paths(lib.file_hashes, ["/lib/src3"]))


@query("f19_known_mime", "SELECT path FROM file_hashes WHERE mime IS NOT NULL")
def known_mime(lib):
    return known_mime_paths(lib.file_hashes)


@query("f20_effective_mime", f"SELECT path, {EFF_MIME} AS effective_mime FROM file_hashes")
def effective_mime(lib):
    return lib.file_hashes.select("path", C.effective_mime(F.col("mime"), F.col("ext")).alias("effective_mime"))


@query("f21_embeddable", f"SELECT path FROM file_hashes WHERE lower(ext) <> 'dng' AND {EFF_MIME} IS NOT NULL")
def embeddable(lib):
    return lib.file_hashes.where(C.is_embeddable(F.col("mime"), F.col("ext"))).select("path")


def _refused(f) -> str:
    try:
        f()
    except (ValueError, LookupError) as e:
        return type(e).__name__
    return "accepted"


@query("f22_bare_search", "SELECT 'ValueError' AS outcome")
def bare_search(lib):
    return lib.spark.createDataFrame([(_refused(lambda: S.search(lib)),)], "outcome string")


@query("f23_verbatim_bounds", f"SELECT DISTINCT hash FROM file_hashes WHERE {EFF} >= '2019-02'")
def verbatim_bounds(lib):
    return sel.by_date(lib.file_hashes, "2019-02", None)


@query("f24_files_by_hash", "SELECT path, f.hash, copies FROM file_hashes f JOIN (SELECT hash, count(*) AS copies FROM file_hashes GROUP BY hash) c USING (hash) WHERE f.hash IN (SELECT hash FROM file_hashes GROUP BY hash ORDER BY count(*) DESC, hash LIMIT 3)")
def by_hash(lib):
    top = lib.file_hashes.groupBy("hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hash").limit(3).collect()
    return S.files_by_hash(lib.file_hashes, ",".join([*(r.hash for r in top), "zz"])).select("path", "hash", "copies")


@query("f25_existing_files", "SELECT path FROM file_hashes WHERE ext <> 'mov'")
def existing(lib):
    listing = lib.file_hashes.where("ext <> 'mov'").select("path")
    return lib.file_hashes.join(listing, "path", "left_semi").select("path").orderBy("path")


@query("f26_canonical_roots", "SELECT DISTINCT hash FROM file_hashes WHERE path LIKE '/lib/src1/en/%' OR path LIKE '/lib/src1/fr/%'")
def canonical_roots(lib):
    return sel.by_paths(lib.file_hashes, ["/lib/src1/en", "/lib/src1/fr/"])


@query("f27_kinds_and_directions", "SELECT * FROM (VALUES ('image', 'accepted'), ('audio', 'ValueError')) t(kind, outcome)")
def kinds(lib):
    return lib.spark.createDataFrame([(k, _refused(lambda k=k: C.kind_mimes(k))) for k in ("image", "audio")], "kind string, outcome string")


@query("f28_flags_to_selection", f"SELECT DISTINCT hash FROM file_hashes WHERE lower(ext) = 'jpg' AND hash IN (SELECT hash FROM file_hashes WHERE {EFF} >= '2019-01-03T00:00:00')")
def flags(lib):
    return lib.selection(exts=["jpg"], after="2019-01-03").resolve(lib)[0].distinct()


@query("f29_work_guard", "SELECT 0 AS calls")
def work_guard(lib):
    none = pending_images(lib.file_hashes.limit(0), lib.embeddings, "acme/base-224")
    return lib.spark.createDataFrame([(0 if none.isEmpty() else 1,)], "calls int")
