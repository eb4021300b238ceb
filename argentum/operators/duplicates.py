"""Exact and perceptual duplicate groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.storage import materialize

THRESHOLD = 10


def duplicate_files(files: DataFrame) -> DataFrame:
    """Files whose content occurs more than once, with date, rank in the group (1 is kept) and group size."""
    shared = files.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    when = C.best_date(F.col("exif_date"), F.col("created_at"), F.col("modified_at"))
    rows = files.join(shared, "hash").withColumn("best_date", when)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("hash").orderBy("best_date", "path")))


def losers(files: DataFrame) -> DataFrame:
    """Paths that could go: all but the first file by date and path of each repeated content, without ranking its files."""
    when = C.best_date(F.col("exif_date"), F.col("created_at"), F.col("modified_at"))
    kept = files.groupBy("hash").agg(F.count("*").alias("n"), F.min_by("path", F.struct(when, "path")).alias("kept")).where("n > 1")
    return files.join(kept, "hash").where("path <> kept").select("path")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(hash, keep, remove[], waste): one row per group."""
    rows = duplicate_files(files).groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("rn", "path", "size_bytes"))).alias("m"))
    waste = F.col("m")[0]["size_bytes"] * (F.size("m") - 1)
    return rows.select("hash", F.col("m")[0]["path"].alias("keep"), F.transform(F.slice("m", 2, F.size("m")), lambda x: x["path"]).alias("remove"), waste.alias("waste"))


def groups_by_waste(files: DataFrame) -> DataFrame:
    return duplicate_groups(files).orderBy(F.desc_nulls_last("waste"), "hash")


def sort_groups(files: DataFrame, by: str) -> DataFrame:
    """Groups by waste, or by the kept file's date with missing dates last going up."""
    first = duplicate_files(files).where("rn = 1").select("hash", F.nullif("best_date", F.lit("")).alias("date"))
    rows = duplicate_groups(files).join(first, "hash")
    order = {"waste": F.desc_nulls_last("waste"), "date:asc": F.asc_nulls_last("date"), "date:desc": F.desc_nulls_last("date")}[by]
    return rows.orderBy(order, "hash")


#: Bands of a fingerprint, and bits of a band.
BANDS, BAND_BITS = 4, 16


def _masks(flips: int) -> list[int]:
    """All changes of up to so many bits of a band."""
    return [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BAND_BITS), n)]


def probes(prints: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(asking, answering) rows by band and part, whose equi-join holds all pairs within the threshold.

    Of four bands one has at most a quarter of the flips, rounded down.  So one side
    asks for each band's part with every such change, the other answers with its
    parts alone: a pair of unrelated fingerprints meets with a chance under one in a
    hundred at ten flips.
    """
    parts = F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("phash", BAND_BITS * k).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).alias("part")) for k in range(BANDS)))
    rows = prints.select("phash").distinct().select("phash", F.explode(parts).alias("b")).select("b.band", "b.part", "phash")
    # a small table is one partition by now; every row of it becomes hundreds
    spark = prints.sparkSession
    wide = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")
    asking = wide.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("bigint") for m in _masks(threshold // BANDS)))))
    return asking.select("band", F.col("part").bitwiseXOR(F.col("mask")).alias("part"), F.col("phash").alias("p")), rows.select("band", "part", F.col("phash").alias("q"))


def band_pairs(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v, bits) of positions whose fingerprints are within the threshold, u first in order; each pair from the first band that brings it."""
    asking, answering = probes(prints, threshold)
    flips = F.col("p").bitwiseXOR(F.col("q"))
    in_band = lambda k: F.bit_count(F.shiftrightunsigned(flips, BAND_BITS * k).bitwiseAND(F.lit((1 << BAND_BITS) - 1)))
    first = F.coalesce(*(F.when(in_band(k) <= threshold // BANDS, F.lit(k)) for k in range(BANDS)))
    met = asking.join(answering, ["band", "part"]).where((F.col("p") < F.col("q")) & (F.bit_count(flips) <= threshold) & (F.col("band") == first))
    # fingerprints alone meet; only pairs within the threshold look up where they stand
    a, b = (prints.select(F.col("phash").alias(x), F.col("pos").alias(f"{x}_pos")) for x in "pq")
    placed = met.select("p", "q").join(a, "p").join(b, "q")
    apart = placed.select(F.least("p_pos", "q_pos").alias("u"), F.greatest("p_pos", "q_pos").alias("v"), C.hamming(F.col("p"), F.col("q")).alias("bits"))
    c, d = (prints.select("phash", F.col("pos").alias(x)) for x in "uv")
    return apart.union(c.join(d, "phash").where("u < v").select("u", "v", F.lit(0).alias("bits")))


def similar_groups(files: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(leader, path): groups of look-alikes by the greedy leader rule, in path order.

    Going through the files by path, each one not yet claimed leads a group and
    claims every later unclaimed file within the threshold of itself.  The leaders
    are the lexicographically first maximal independent set of the nearness graph:
    a file leads once it comes first among its undecided neighbours.  Files with
    one fingerprint share their first one's fate.  Groups of one are left out.
    """
    rows = files.where("phash IS NOT NULL").select("path", "phash")
    prints = materialize(rows.groupBy("phash").agg(F.min("path").alias("pos")), "prints")
    pairs = materialize(band_pairs(prints, threshold).select("u", "v"), "print-pairs")
    both = materialize(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "print-neighbours")
    undecided = materialize(both.select("u").distinct(), "undecided")
    leads: DataFrame | None = None
    while undecided.limit(1).count():
        open_ = both.join(undecided, "u", "left_semi").join(undecided.withColumnRenamed("u", "v"), "v", "left_semi")
        first = open_.groupBy("u").agg(F.min("v").alias("m"))
        new = materialize(undecided.join(first, "u", "left").where("m IS NULL OR u < m").select("u"), "new-leaders")
        claimed = both.join(new, "u", "left_semi").select(F.col("v").alias("u")).distinct()
        undecided = materialize(undecided.join(new, "u", "left_anti").join(claimed, "u", "left_anti"), "undecided")
        leads = new if leads is None else materialize(leads.union(new), "leaders")
    fate = prints.select("pos", F.col("pos").alias("leader"))
    if leads is not None:
        to = pairs.join(leads, "u", "left_semi").groupBy(F.col("v").alias("pos")).agg(F.min("u").alias("claimer"))
        to = to.join(leads.withColumnRenamed("u", "pos"), "pos", "left_anti")
        fate = prints.join(to, "pos", "left").select("pos", F.coalesce("claimer", "pos").alias("leader"))
    out = rows.join(prints.join(fate, "pos").select("phash", "leader"), "phash").select("leader", "path")
    return out.join(out.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader"), "leader", "left_semi")


def duplicates_json(files: DataFrame, include_similar: bool = False) -> DataFrame:
    """One row: the whole report as JSON."""
    groups = duplicate_groups(files).agg(F.sort_array(F.collect_list(F.struct("hash", "keep", "remove"))).alias("duplicate_groups"))
    out = files.agg(F.count("*").alias("total_files")).join(groups)
    parts = [F.lit(1).alias("schema_version"), "total_files", "duplicate_groups"]
    if include_similar:
        alike = similar_groups(files).groupBy("leader").agg(F.sort_array(F.collect_list("path")).alias("files"))
        out = out.join(alike.agg(F.sort_array(F.collect_list(F.struct("leader", "files"))).alias("similar_groups")))
        parts.append("similar_groups")
    return out.select(F.to_json(F.struct(*parts)).alias("document"))


def group_documents(files: DataFrame) -> DataFrame:
    """(document): each group of equal content as JSON, a row each, in order of content."""
    return duplicate_groups(files).orderBy("hash").select(F.to_json(F.struct("hash", "keep", "remove")).alias("document"))


def similar_documents(files: DataFrame) -> DataFrame:
    """(document): each group of look-alikes as JSON, a row each, in order of leaders."""
    groups = similar_groups(files).groupBy("leader").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return groups.orderBy("leader").select(F.to_json(F.struct("leader", "files")).alias("document"))


def group_json(files: DataFrame) -> DataFrame:
    """(hash, document): each group's waste, kept date and files as JSON."""
    rows = duplicate_files(files).groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("rn", "path", "size_bytes", "best_date"))).alias("m"))
    body = F.struct((F.col("m")[0]["size_bytes"] * (F.size("m") - 1)).alias("waste"), F.col("m")[0]["best_date"].alias("date"), F.transform("m", lambda x: F.struct(x["path"].alias("path"), x["size_bytes"].alias("size"))).alias("files"))
    return rows.select("hash", F.to_json(body).alias("document"))
