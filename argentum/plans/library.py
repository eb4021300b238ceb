"""The library: its tables, and every operation on them as a method."""

from __future__ import annotations

import logging
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.operators import classify as classify_ops
from argentum.operators import clustering, duplicates, faces, pending, places, search, stats, vectors
from argentum.operators.selection import Selection, expand_date, normalise_bound
from argentum.plans.config import load_config, resolve_home, resolve_library
from argentum.schemas import SCHEMAS, empty, evolve
from argentum.storage import materialize
from argentum.streaming import ledger

log = logging.getLogger(__name__)

DEFAULT_MODEL = "google/siglip-base-patch16-224"


class QueryEmbedder(Protocol):
    """Turns a text or an image into a vector of a model."""

    def embed(self, text: str | None = None, image: str | None = None) -> list[float]: ...


def validate_model(model: str) -> str:
    owner, slash, name = model.partition("/")
    if not (owner and slash and name) or "/" in name:
        raise ValueError(f"a model is named owner/name, not {model!r}")
    return model


def resolve_model(explicit: str | None = None, configured: str | None = None) -> str:
    return validate_model(explicit or configured or DEFAULT_MODEL)


def image_size(model: str) -> int:
    """Pixels that a model takes: the number its name ends with, if plausible, else 384."""
    tail = model.rsplit("-", 1)[-1]
    return int(tail) if tail.isdigit() and 64 <= int(tail) <= 1024 else 384


class Library:
    """Tables by name, from a folder of Parquet datasets or given directly."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, home: str | None = None, model: str | None = None):
        self.spark, self._tables, self.home, self._model = spark, dict(tables or {}), home, model

    def table(self, name: str) -> DataFrame:
        """A table, empty if the library has none."""
        if name not in self._tables:
            path = self.home and self._table_paths(name)[0]
            if path:
                self._recover(name)
            there = path and self._exists(path)
            self._tables[name] = evolve(self.spark.read.parquet(path), name) if there else empty(self.spark, name)
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table: written beside the old one, which moves away, and is deleted once the new one stands."""
        to, old = self._table_paths(name)
        new = f"{to}.new-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy("model_id") if name in ("embeddings", "classifications") else df.write
        writer.parquet(new)
        self._recover(name)
        if self._exists(to):
            self._delete(old)
            self._move(to, old)
        self._move(new, to)
        self._delete(old)
        self._tables.pop(name, None)

    def _table_paths(self, name: str) -> tuple[str, str]:
        to = f"{self.home.rstrip('/')}/{name}"
        return to, f"{to}.old"

    def _recover(self, name: str) -> None:
        """Put back the table that a replacement moved away before it broke off."""
        to, old = self._table_paths(name)
        if not self._exists(to) and self._exists(old):
            self._move(old, to)

    def _move(self, a: str, b: str) -> None:
        p, fs = self._path(a)
        if not fs.rename(p, self._path(b)[0]):
            raise RuntimeError(f"could not move {a} to {b}")

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def upsert(self, name: str, new: DataFrame, keys: list[str], order: str | None = None) -> None:
        self.write(name, pending.upsert(self.table(name), new, keys, order))

    @property
    def configured_model(self) -> str | None:
        return self._model

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """An intermediate table, written so that later writes to the library don't change it."""
        return materialize(df, name)

    def views(self) -> None:
        """Every table as a temporary view, for SQL."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        self.views()
        return self.spark.sql(text)

    def models(self) -> DataFrame:
        return self.embeddings.select("model_id").distinct().orderBy("model_id")

    def model(self, name: str | None = None) -> str:
        """The model to use; one without vectors is an error that lists those there are."""
        name = resolve_model(name, self._model)
        if not self.embeddings.where(self.embeddings.model_id == name).limit(1).count():
            raise LookupError(f"no embeddings for {name!r}; available: {', '.join(r.model_id for r in self.models().collect()) or 'none'}")
        return name

    # --- queries ---------------------------------------------------------

    def selection(self, person=None, category=None, date=None, after=None, before=None, kinds=(), exts=(), mimes=(), paths=(), location=None, km=10.0, model=None) -> Selection:
        """Flags as a selection; a place is looked up in the cache of places."""
        if date is not None:
            after, before = expand_date(date)
        else:
            after, before = (normalise_bound(x) if x is not None else None for x in (after, before))
        place = (*self.geocode(location), float(km)) if location is not None else None
        return Selection(person, (resolve_model(model, self._model), category) if category else None, after, before, list(kinds), list(exts), list(mimes), list(paths), place)

    def geocode(self, query: str) -> tuple[float, float]:
        """Coordinates of a place from the cache; the engine asks no service."""
        key = query.strip().lower()
        row = self.geocode_cache.where(self.geocode_cache["query"] == key).head()
        if row is None:
            raise LookupError(f"no cached coordinates for {query!r}")
        return row.lat, row.lon

    def search(self, text: str | None = None, image: str | None = None, embedder: QueryEmbedder | None = None, sort: str | None = None, k: int = 20, model: str | None = None, **filters) -> DataFrame:
        if text is not None and image is not None:
            raise ValueError("a search takes a text or an image, not both")
        query = None
        if text is not None or image is not None:
            if embedder is None:
                raise ValueError("a ranked search needs an embedder")
            query = embedder.embed(text=text, image=image)
        return search.search(self, self.selection(model=model, **filters), query, model, sort, k)

    def stats(self) -> DataFrame:
        return stats.totals(self.file_hashes, self.faces, self.people)

    def report(self, types: int = 12) -> DataFrame:
        """(section, name, n): files, types, vectors by model, and every command's state."""
        name = lambda *cols: F.concat_ws(" ", *cols).alias("name")
        rows = self.file_hashes.agg(F.count("*").alias("n")).select(F.lit("files").alias("section"), F.lit("").alias("name"), "n")
        rows = rows.union(stats.by_type(self.file_hashes, types).select(F.lit("type"), name("ext", "mime"), "files"))
        rows = rows.union(stats.counts_by_model(self.embeddings).select(F.lit("model"), "model_id", "vectors"))
        return rows.union(ledger.status(self.pipeline_runs).select(F.lit("command"), name("command", "state"), F.lit(1).cast("bigint")))

    def find_duplicates(self, include_similar: bool = False) -> DataFrame:
        return duplicates.duplicates_json(self.file_hashes, include_similar)

    def faces_view(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return faces.people_view(self.faces, self.people), faces.clusters_view(self.faces), faces.singletons_view(self.faces)

    # --- jobs ------------------------------------------------------------

    def run_clustering(self, **options) -> DataFrame:
        assigned = self.keep(clustering.cluster_with_quality_gate(self.faces, **options), "assigned")
        self.write("faces", faces.update_cluster_assignments(self.faces, assigned))
        return clustering.clustering_result(assigned)

    def run_locations(self, km: float = 50.0) -> DataFrame:
        clusters, placed = places.location_clusters(self.file_hashes, self.gazetteer, km)
        self.write("location_clusters", clusters)
        self.write("file_hashes", self.file_hashes.drop("location_cluster_id").join(placed, "path", "left").select(*self.file_hashes.columns))
        return self.location_clusters

    def run_classify(self, prompts: dict[str, list[float]], margin: float = 0.05, reprocess: bool = False, model: str | None = None) -> DataFrame:
        new = self.keep(classify_ops.classify_job(self.file_hashes, self.embeddings, self.classifications, self.model(model), prompts, margin, reprocess), "classified")
        self.upsert("classifications", new, ["model_id", "hash"])
        return new

    def run_embed(self, embed, model: str | None = None, batch: int = 96) -> DataFrame:
        new = self.keep(classify_ops.embed_job(self.file_hashes, self.embeddings, resolve_model(model, self._model), embed, batch), "embedded")
        self.upsert("embeddings", new, ["model_id", "hash"])
        return new

    def similar(self, item: str, k: int = 24, model: str | None = None) -> DataFrame:
        return search.similar(self.embeddings, self.model(model), item, k)


def open_home(spark: SparkSession, explicit: str | None = None) -> Library:
    """The library at an explicit folder, else at the environment's home, the configured folder or the home, with the configured model."""
    home, passed_over = resolve_library(explicit)
    if passed_over:
        log.warning("the environment names %s; the configured library %s is not used", home, passed_over)
    return Library(spark, home=home, model=load_config(resolve_home()[0]).default_model)


__all__ = ["Library", "QueryEmbedder", "open_home", "resolve_model", "validate_model", "image_size", "vectors"]
