"""Faces and people: joins, views and labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.functions import columns as C

from .selection import resolve_identities

_CONFIRMED = "confirmed = 1"
_OPEN = "(confirmed = 0 OR person_label IS NULL)"


def search_by_person(files: DataFrame, faces: DataFrame, people: DataFrame, typed: str, limit: int | None = None) -> DataFrame:
    ids = resolve_identities(people, typed).withColumnRenamed("name", "person_label")
    hits = faces.where(_CONFIRMED).join(ids, "person_label", "left_semi").select("hash")
    rows = files.join(hits, "hash", "left_semi").select("path").distinct().orderBy("path")
    return rows if limit is None else rows.limit(limit)


def list_persons(faces: DataFrame, people: DataFrame) -> DataFrame:
    rows = faces.where(_CONFIRMED + " AND person_label IS NOT NULL").select("person_label").distinct()
    return rows.join(people, F.col("name") == F.col("person_label"), "left").select(F.coalesce("full_name", "person_label").alias("person")).distinct().orderBy("person")


def labeled_faces_by_hash(faces: DataFrame, people: DataFrame) -> DataFrame:
    """(hash, faces): labelled faces of each content, in id order."""
    rows = faces.where(_CONFIRMED + " AND person_label IS NOT NULL").join(people, F.col("name") == F.col("person_label"), "left")
    return rows.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("full_name", "person_label").alias("label"), "bbox"))).alias("faces"))


def cluster_detail(files: DataFrame, faces: DataFrame, cluster_id: int) -> DataFrame:
    return faces.where(F.col("cluster_id") == cluster_id).join(files.select("hash", "path"), "hash").select("id", "hash", "path", "bbox").orderBy("id", "path")


def person_detail(files: DataFrame, faces: DataFrame, people: DataFrame, name: str) -> DataFrame:
    rows = faces.where(F.expr(_CONFIRMED) & (F.col("person_label") == name)).join(files.select("hash", "path"), "hash")
    full = people.where(F.col("name") == name).agg(F.first("full_name").alias("full_name"))
    return rows.join(full).select("id", "hash", "path", "bbox", "is_primary", F.coalesce("full_name", F.lit(name)).alias("full_name")).orderBy(F.desc("is_primary"), "id", "path")


def face_lookup(files: DataFrame, faces: DataFrame, face_id: int) -> DataFrame:
    return faces.where(F.col("id") == face_id).join(files.select("hash", "path"), "hash").select("id", "hash", "path", "bbox").orderBy("path").limit(1)


def face_or_error(files: DataFrame, faces: DataFrame, face_id: int):
    row = face_lookup(files, faces, face_id).head()
    if row is None:
        raise LookupError(f"no face {face_id}")
    return row


def _members(rows: DataFrame, key: str, order: list[Column], names: list[Column] = []) -> DataFrame:  # noqa: B006
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    got = rows.withColumn("rn", rn).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rn", "id", "hash"))).alias("m"), *names)
    ids = F.transform("m", lambda x: x["id"])
    return got.withColumns({"face_ids": ids, "hashes": F.array_distinct(F.transform("m", lambda x: x["hash"]))}).drop("m")


def people_view(faces: DataFrame, people: DataFrame) -> DataFrame:
    """(label, full_name, face_ids, representative_id, hashes) by name."""
    rows = faces.where(_CONFIRMED + " AND person_label IS NOT NULL").join(people, F.col("name") == F.col("person_label"), "left")
    rows = rows.withColumn("full_name", F.coalesce("full_name", "person_label"))
    out = _members(rows, "person_label", [F.desc("is_primary"), F.asc("id")], [F.min("full_name").alias("full_name")])
    return out.select(F.col("person_label").alias("label"), "full_name", "face_ids", F.col("face_ids")[0].alias("representative_id"), "hashes").orderBy(F.lower("full_name"), "label")


def clusters_view(faces: DataFrame) -> DataFrame:
    """(cluster_id, face_ids, hashes), largest first."""
    out = _members(faces.where(f"cluster_id IS NOT NULL AND {_OPEN}"), "cluster_id", [F.asc("id")])
    return out.select("cluster_id", "face_ids", "hashes").orderBy(F.desc(F.size("face_ids")), "cluster_id")


def singletons_view(faces: DataFrame) -> DataFrame:
    return faces.where(f"cluster_id IS NULL AND {_OPEN}").select(F.col("id").alias("face_id"), "hash").orderBy("face_id")


def photos_per_person(faces: DataFrame) -> DataFrame:
    return faces.where("person_label IS NOT NULL").groupBy("person_label").agg(F.countDistinct("hash").alias("photos")).orderBy(F.desc("photos"), "person_label")


def migrate_labels(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, faces): one identity for all spellings of a name; the commonest spelling is shown."""
    counts = faces.where("person_label IS NOT NULL").groupBy("person_label").agg(F.count("*").alias("n"))
    counts = counts.withColumn("name", C.normalize_name(F.col("person_label"))).where("name IS NOT NULL")
    upper = (F.col("person_label") != F.lower("person_label")).cast("int")
    order = Window.partitionBy("name").orderBy(F.desc("n"), F.desc(upper), "person_label")
    ranked = counts.withColumn("rn", F.row_number().over(order))
    people = ranked.where("rn = 1").select("name", C.display_name(F.col("person_label")).alias("full_name"))
    label = F.coalesce(C.normalize_name(F.col("person_label")), F.col("person_label"))
    return people, faces.withColumn("person_label", label)


# --- labelling: each returns the changed table ------------------------------


def assign(faces: DataFrame, people: DataFrame, ids: list[int], person: str) -> tuple[DataFrame, DataFrame]:
    """Label faces with a person; a new person keeps the spelling first given."""
    spark = faces.sparkSession
    given = spark.createDataFrame([(person,)], "raw string").select(C.normalize_name(F.col("raw")).alias("name"), C.display_name(F.col("raw")).alias("full_name"))
    row = given.head()
    if row is None or row["name"] is None:
        raise ValueError(f"no usable name in {person!r}")
    hit = F.col("id").isin(ids)
    out = faces.withColumns({"person_label": F.when(hit, row["name"]).otherwise(F.col("person_label")), "confirmed": F.when(hit, 1).otherwise(F.col("confirmed"))})
    return out, people.unionByName(given.join(people, "name", "left_anti"))


def remove_face(faces: DataFrame, face_id: int) -> DataFrame:
    hit = F.col("id") == face_id
    none = {"cluster_id": F.lit(None).cast("bigint"), "person_label": F.lit(None).cast("string"), "confirmed": F.lit(0), "is_primary": F.lit(0)}
    return faces.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in none.items()})


def dissolve_cluster(faces: DataFrame, cluster_id: int) -> DataFrame:
    return faces.withColumn("cluster_id", F.when(F.col("cluster_id") == cluster_id, None).otherwise(F.col("cluster_id")))


def set_full_name(people: DataFrame, name: str, full_name: str) -> DataFrame:
    if not people.where(F.col("name") == name).limit(1).count():
        raise LookupError(f"no person {name!r}")
    return people.withColumn("full_name", F.when(F.col("name") == name, C.display_name(F.lit(full_name))).otherwise(F.col("full_name")))


def delete_person(faces: DataFrame, name: str) -> DataFrame:
    """Unlabels the person's faces; the people row stays."""
    hit = F.col("person_label") == name
    return faces.withColumns({
        "confirmed": F.when(hit, 0).otherwise(F.col("confirmed")), "is_primary": F.when(hit, 0).otherwise(F.col("is_primary")), "person_label": F.when(hit, None).otherwise(F.col("person_label")),
    })


def set_primary(faces: DataFrame, name: str, face_id: int) -> DataFrame:
    """One primary face of a person; nothing changes unless the face has that label."""
    if not faces.where((F.col("id") == face_id) & (F.col("person_label") == name)).limit(1).count():
        raise LookupError(f"face {face_id} is not one of {name!r}")
    return faces.withColumn("is_primary", F.when(F.col("person_label") == name, (F.col("id") == face_id).cast("int")).otherwise(F.col("is_primary")))


def update_cluster_assignments(faces: DataFrame, assigned: DataFrame) -> DataFrame:
    """Faces with the cluster ids of ``assigned`` (id, cluster_id); other faces keep theirs."""
    new = assigned.select("id", F.col("cluster_id").alias("_new"), F.lit(True).alias("_hit"))
    return faces.join(new, "id", "left").withColumn("cluster_id", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("cluster_id"))).select(*faces.columns)
