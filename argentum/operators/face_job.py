"""The face pipeline: load, detect, align and embed in Arrow batches, with injected models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions import imaging

from .numbering import numbered

_KIND = "hash string, path string, bbox string, score double, landmark string, embedding array<float>, error string"


def detect_faces(todo: DataFrame, load: Callable[[str], np.ndarray], detect: Callable[[np.ndarray], list[dict]], embed: Callable[[list[np.ndarray]], np.ndarray], workers: int = 8) -> DataFrame:
    """One row per face of (hash, path); one row without a box for an image without faces; one with an error.

    Rows are dealt out in turn over ``workers`` partitions.  ``load`` reads an
    image, ``detect`` gives boxes with corners, score and five landmarks, ``embed``
    takes aligned faces; a model is opened once in each Python worker.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                none = dict.fromkeys(("bbox", "score", "landmark", "embedding", "error"))
                row = {"hash": r.hash, "path": r.path} | none
                try:
                    image = load(r.path)
                    faces = detect(image)
                    vectors = embed([imaging.align_face(image, np.array(f["landmarks"])) for f in faces]) if faces else []
                except Exception as e:  # one unreadable image must not end the run
                    out.append(row | {"error": repr(e)})
                    continue
                for f, v in zip(faces, vectors):
                    x1, y1, x2, y2 = (int(round(c)) for c in f["bbox"])
                    marks = ",".join(f"{c:.1f}" for p in f["landmarks"] for c in p)
                    out.append(row | {"bbox": f"{x1},{y1},{x2 - x1},{y2 - y1}", "score": f["score"], "landmark": marks, "embedding": (v / (np.linalg.norm(v) or 1)).astype(np.float32).tolist()})
                if not faces:
                    out.append(row)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _KIND.split(", ")])

    return todo.select("hash", "path").repartition(workers).mapInPandas(run, _KIND)


def faces_of(detected: DataFrame, first_id: int = 1) -> DataFrame:
    """Rows for the faces table, numbered in order of content and box."""
    rows = detected.where("bbox IS NOT NULL").select("hash", "bbox", "landmark", "embedding")
    return numbered(rows, ["hash", "bbox", "landmark"], "id", first_id).select("id", "hash", "bbox", "landmark", "embedding")


def scanned_of(detected: DataFrame) -> DataFrame:
    """Contents that were scanned, faces or not; those with errors are to be tried again."""
    return detected.groupBy("hash").agg(F.count("error").alias("errors")).where("errors = 0").select("hash")


def counters(detected: DataFrame) -> DataFrame:
    return detected.agg(F.countDistinct("hash").alias("processed"), F.count("bbox").alias("faces"), F.count("error").alias("errors"))
