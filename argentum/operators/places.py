"""Places: near pairs on the sphere, clustering, centroids, names and assignment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.storage import materialize

from .clustering import agglomerate_places
from .components import components
from .numbering import numbered

#: A gazetteer of at most so many rows is sent to every executor.
MOST_CITIES = 1_000_000


def distinct_coordinates(files: DataFrame) -> DataFrame:
    rows = files.where("gps_lat IS NOT NULL AND gps_lon IS NOT NULL").select(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon")).distinct()
    return rows.select(F.xxhash64("lat", "lon").alias("id"), "lat", "lon")


def near_pairs(points: DataFrame, km: float) -> DataFrame:
    """(u, v, km) of points within the radius, u < v.

    Points lie in a cubic grid whose cells are as wide as the radius's chord, so
    near points are in the same or in touching cells, at the poles and across the
    date line as anywhere.
    """
    width = 2 * C.EARTH_KM * math.sin(min(math.pi / 2, km / (2 * C.EARTH_KM))) + 1e-6
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
    celled = points.select("id", "lat", "lon", *(F.floor(a * C.EARTH_KM / width).alias(n) for a, n in zip(axes, "xyz")))
    step = F.array(*map(F.lit, (-1, 0, 1)))
    wide = celled
    for n in "xyz":
        wide = wide.withColumn(f"{n}_step", F.explode(step)).withColumn(n, F.col(n) + F.col(f"{n}_step")).drop(f"{n}_step")
    a = wide.select(F.col("id").alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "x", "y", "z")
    b = celled.select(F.col("id").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "x", "y", "z")
    away = C.haversine_atan2(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["x", "y", "z"]).where("u < v").select("u", "v", away.alias("km")).where(F.col("km") <= km)


def cluster_by_distance(points: DataFrame, km: float) -> DataFrame:
    """(id, lat, lon, cluster): average linkage up to ``km``; every point is in some cluster."""
    points = materialize(points, "coordinates")
    labels = components(near_pairs(points, km).select("u", "v"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lat", "lon"]).reset_index(drop=True)
        owner = agglomerate_places(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), km)
        return pdf[["id", "lat", "lon"]].assign(cluster=pdf["id"].to_numpy()[owner])

    joined = points.join(labels, "id").groupBy("label").applyInPandas(cluster, "id bigint, lat double, lon double, cluster bigint")
    alone = points.join(labels, "id", "left_anti").select("id", "lat", "lon", F.col("id").alias("cluster"))
    return joined.union(alone)


def nearest_city(points: DataFrame, gazetteer: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds ``city``, the nearest gazetteer entry as ``name, cc``; null if its name is empty."""
    cities = gazetteer.where("lat IS NOT NULL AND lon IS NOT NULL").orderBy("lat", "lon", "name").limit(MOST_CITIES + 1).toPandas()
    if len(cities) > MOST_CITIES:
        raise ValueError(f"a gazetteer of more than {MOST_CITIES} rows")

    def unit(a, b):
        a, b = np.radians(a), np.radians(b)
        return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)

    sent = points.sparkSession.sparkContext.broadcast((unit(cities["lat"].to_numpy(float), cities["lon"].to_numpy(float)), [f"{n}, {c}" if n else None for n, c in zip(cities["name"], cities["cc"])]))
    at = points.columns.index(lat), points.columns.index(lon)

    def run(batches):
        where, names = sent.value
        for b in batches:
            x, y = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at)
            out: list = []
            for k in range(0, len(x), 512):
                ok = ~(np.isnan(x[k : k + 512]) | np.isnan(y[k : k + 512]))
                best = (unit(np.nan_to_num(x[k : k + 512]), np.nan_to_num(y[k : k + 512])) @ where.T).argmax(1) if len(names) else np.zeros(len(ok), int)
                out += [names[i] if names and o else None for i, o in zip(best.tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "city"])

    from pyspark.sql.types import StringType, StructField, StructType

    return points.mapInArrow(run, StructType([*points.schema.fields, StructField("city", StringType())]))


def location_clusters(files: DataFrame, gazetteer: DataFrame, km: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(clusters, assignments): places with centroid, name and photo count; hash-free rows (path, cluster id).

    Centroids are means of distinct coordinates, counts are files at exactly a
    member's coordinate.  Clusters are numbered from 1 by centroid.
    """
    members = materialize(cluster_by_distance(distinct_coordinates(files), km), "places")
    centres = members.groupBy("cluster").agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))
    at = files.where("gps_lat IS NOT NULL AND gps_lon IS NOT NULL").select("path", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    placed = at.join(members, ["lat", "lon"]).select("path", "cluster")
    counted = centres.join(placed.groupBy("cluster").agg(F.count("*").alias("photo_count")), "cluster")
    named = nearest_city(numbered(counted, ["centroid_lat", "centroid_lon"], "id", 1), gazetteer, "centroid_lat", "centroid_lon").withColumnRenamed("city", "name").withColumn("radius_km", F.lit(float(km)))
    clusters = materialize(named.select("id", "cluster", "centroid_lat", "centroid_lon", "name", "photo_count", "radius_km"), "location-clusters")
    return clusters.drop("cluster").orderBy(F.desc("photo_count"), "id"), placed.join(clusters.select("cluster", "id"), "cluster").select("path", F.col("id").alias("location_cluster_id"))


def summary_lines(clusters: DataFrame) -> DataFrame:
    """Places by number of photos, as lines."""
    name = F.coalesce("name", F.lit("(unnamed)"))
    return clusters.orderBy(F.desc("photo_count"), "id").select("id", F.concat_ws("  ", F.lpad(F.col("photo_count").cast("string"), 6, " "), name).alias("line"))


def backfill_names(files: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Files with ``location_name`` filled where it is missing, matched at six decimal places."""
    key = [F.round("gps_lat", 6).alias("lat"), F.round("gps_lon", 6).alias("lon")]
    todo = files.where("location_name IS NULL AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL").select(*key).distinct()
    named = materialize(nearest_city(todo, gazetteer), "named-coordinates")
    rows = files.withColumns({"lat": key[0], "lon": key[1]}).join(named, ["lat", "lon"], "left")
    return rows.withColumn("location_name", F.coalesce("location_name", "city")).select(*files.columns)
