"""Photo exports with JSON sidecars: matching, dates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions import columns as C

# A sidecar's usual ending, and JSON files that describe albums rather than media.
CANONICAL = ".supplemental-metadata.json"
BOOKKEEPING = ["metadata.json", "print-subscriptions.json", "shared_album_comments.json", "user-generated-memory-titles.json"]
_SIDECAR = "photoTakenTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double>"


def sidecar_index(listing: DataFrame) -> DataFrame:
    """(dir, sidecar) of a listing (dir, name)."""
    return listing.where(F.lower("name").endswith(".json") & ~F.lower("name").isin(BOOKKEEPING)).select("dir", F.col("name").alias("sidecar"))


def match_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(dir, name, status, sidecar): found, ambiguous or missing, by the first rule that hits anything.

    A sidecar's name is cut at each dot and after each counter; these cuts are what
    media names are joined on, so a folder is never paired with itself whole.  The
    rules, in order: the name's own forms (usual ending, ``.json``, any one sidecar
    that begins with the name and a dot); for ``a(1).jpg`` the counter's forms, then
    the forms of ``a.jpg`` and of its unedited name; last the unedited name's forms.
    """
    dots = F.transform(F.sequence(F.lit(1), F.size(F.split("sidecar", r"\.")) - 1), lambda n: F.struct(F.lit("dot").alias("cut"), F.array_join(F.slice(F.split("sidecar", r"\."), 1, n), ".").alias("key")))
    heads = F.regexp_extract_all("sidecar", F.lit(r"^(.*?\([0-9]+\))"), F.lit(1))
    keyed = sidecars.select("dir", "sidecar", F.explode(F.concat(dots, F.transform(heads, lambda h: F.struct(F.lit("count").alias("cut"), h.alias("key"))))).alias("k")).select("dir", "sidecar", "k.cut", "k.key")
    name = F.col("name")
    base, n = C.split_counter(name)
    edited, base_edited = C.strip_edited(name), C.strip_edited(base)
    want = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("dot").alias("cut"), name.alias("key"), F.lit(None).cast("string").alias("n")),
        F.struct(F.lit(1).alias("step"), F.lit("count").alias("cut"), F.concat(base, F.lit("("), n, F.lit(")")).alias("key"), n.alias("n")),
        F.struct(F.lit(1).alias("step"), F.lit("dot").alias("cut"), base.alias("key"), n.alias("n")),
        F.struct(F.lit(2).alias("step"), F.lit("dot").alias("cut"), base.alias("key"), F.lit(None).cast("string").alias("n")),
        F.struct(F.lit(3).alias("step"), F.lit("dot").alias("cut"), base_edited.alias("key"), F.lit(None).cast("string").alias("n")),
        F.struct(F.lit(4).alias("step"), F.lit("dot").alias("cut"), edited.alias("key"), F.lit(None).cast("string").alias("n")),
    )
    asked = media.select("dir", "name", F.explode(want).alias("w")).select("dir", "name", "w.*").where("key IS NOT NULL")
    hits = asked.join(keyed, ["dir", "cut", "key"])
    counter_end = F.concat(F.lit("("), F.col("n"), F.lit(").json"))
    hits = hits.where((F.col("step") != 1) | (F.col("cut") == "count") | F.col("sidecar").endswith(counter_end))
    form = (
        F.when((F.col("step") == 1) & (F.col("sidecar") == F.concat("key", F.lit(".json"))) & (F.col("cut") == "count"), 0)
        .when(F.col("step") == 1, 2)
        .when(F.col("sidecar") == F.concat("key", F.lit(CANONICAL)), 0)
        .when(F.col("sidecar") == F.concat("key", F.lit(".json")), 1)
        .otherwise(2)
    )
    ranked = hits.select("dir", "name", "sidecar", (F.col("step") * 3 + form).alias("rule"))
    best = ranked.groupBy("dir", "name", "rule").agg(F.countDistinct("sidecar").alias("k"), F.min("sidecar").alias("s"))
    best = best.groupBy("dir", "name").agg(F.min(F.struct("rule", "k", "s")).alias("b"))
    out = media.select("dir", "name").join(best, ["dir", "name"], "left")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.k") == 1, "found").otherwise("ambiguous")
    return out.select("dir", "name", status.alias("status"), F.when(F.col("b.k") == 1, F.col("b.s")).alias("sidecar"))


def parse_sidecars(rows: DataFrame, text: str = "value") -> DataFrame:
    """Adds taken (epoch seconds), lat, lon; a place of exactly 0, 0 is none."""
    j = F.from_json(F.col(text), _SIDECAR)
    lat, lon = j["geoData"]["latitude"], j["geoData"]["longitude"]
    real = (lat != 0) | (lon != 0)
    return rows.withColumns({"taken": j["photoTakenTime"]["timestamp"].try_cast("bigint"), "lat": F.when(real, lat), "lon": F.when(real, lon)})


def survey(matches: DataFrame) -> DataFrame:
    """One row: matched, unmatched and ambiguous media, and folders."""
    count = lambda s: F.count_if(F.col("status") == s)
    return matches.agg(count("found").alias("matched"), count("missing").alias("unmatched"), count("ambiguous").alias("ambiguous"), F.countDistinct("dir").alias("folders"))


def recover_dates(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, counts) of rows (path, taken, mtime, lat): what would change, and what is right already."""
    dated = matched.where("taken IS NOT NULL")
    pending = dated.where("mtime IS NULL OR taken <> mtime").select("path", "taken")
    counts = dated.agg(F.count_if(F.col("mtime").isNull() | (F.col("taken") != F.col("mtime"))).alias("pending"), F.count_if(F.col("taken") == F.col("mtime")).alias("already_correct"), F.count("lat").alias("with_location"))
    return pending, counts
