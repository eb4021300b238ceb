"""Vectors: half-float codec, means, near pairs in blocks, zero-shot classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.functions import columns as C

from .blocks import blocked, opened, spread


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_f16(blob: pd.Series) -> pd.Series:
    """Little-endian half floats as floats."""
    return blob.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f2").astype(np.float32))


@F.pandas_udf(T.BinaryType())
def to_f16(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f2").tobytes())


def normalized_mean(rows: DataFrame, vector: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """The mean direction of vectors, by element; empty if it is zero."""
    keys = by or []
    sums = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    total = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("v"))
    return total.select(*keys, F.when(C.norm(F.col("v")) > 1e-12, C.l2_normalize(F.col("v"))).otherwise(F.array().cast("array<double>")).alias("mean"))


#: Vectors in a block of the search for near pairs.
BLOCK = 2048


def cosine_edges(rows: DataFrame, eps: float, key: str = "id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(u, v, distance) of unit vectors within cosine distance eps, u < v.

    Every two blocks of vectors meet once, in one job over all pairs of blocks; a
    pair's distances stay in its task, near pairs alone leave it.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = blocked(rows.where(F.forall("v", lambda x: x.isNotNull())), block, "vector-blocks")
    left, right = (spread(blocks) if side == "a" else blocks for side in "ab")
    left, right = left.select(*(F.col(c).alias(f"a_{c}") for c in blocks.columns)), right.select(*(F.col(c).alias(f"b_{c}") for c in blocks.columns))
    # no equality of keys: that would send all blocks of a length to one task
    pairs = left.join(right, (F.col("a_block") <= F.col("b_block")) & (F.abs(F.col("a_dim") - F.col("b_dim")) < 1))

    def near(batches):
        last, held = None, None
        for b in batches:
            for x, y, one, other in zip(*(c.to_pylist() for c in b.columns)):
                if last != x:
                    last, held = x, opened(one)
                ids, m = held
                others, w = held if x == y else opened(other)
                for at in range(0, len(ids), 1024):
                    d = 1.0 - m[at : at + 1024] @ w.T
                    i, j = np.nonzero(d <= eps)
                    u, v, d = ids[at + i], others[j], d[i, j]
                    keep = u < v if x == y else u != v
                    u, v, d = u[keep], v[keep], d[keep]
                    yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d)], names=["u", "v", "distance"])

    return pairs.select("a_block", "b_block", "a_data", "b_data").mapInArrow(near, "u bigint, v bigint, distance double")


# The categories and what an image of each is said to be.
PROMPTS = {
    "photo": "a photo of a person, place, or thing",
    "screenshot": "a screenshot of a phone or computer screen",
    "document": "a photo of a document, receipt, or piece of paper",
    "meme": "a meme image with text captions overlaid on a picture",
}


def classify_scores(scores: Column, margin: float) -> Column:
    """Of (score, name) structs: best name if it leads the second by more than margin, else unknown."""
    ranked = F.sort_array(scores, asc=False)
    lead = F.when(F.size(ranked) > 1, ranked[0]["score"] - F.get(ranked, F.lit(1))["score"]).otherwise(F.lit(float("inf")))
    return F.struct(F.when(lead > margin, ranked[0]["name"]).otherwise(F.lit("unknown")).alias("category"), ranked[0]["score"].alias("confidence"))


def classify(vectors: DataFrame, prompts: dict[str, list[float]], margin: float = 0.05) -> DataFrame:
    """(hash, category, confidence) from the vectors' products with a few prompt vectors."""
    scores = F.array(*(F.struct(C.dot(F.col("embedding"), F.array(*map(F.lit, map(float, p)))).alias("score"), F.lit(name).alias("name")) for name, p in prompts.items()))
    return vectors.select("hash", classify_scores(scores, margin).alias("c")).select("hash", "c.category", "c.confidence")


def non_max_suppression(boxes: DataFrame, most: float = 0.4, by: str = "image") -> DataFrame:
    """Boxes (image, x1, y1, x2, y2, score) that no better box of their image covers too much.

    Groups are the detections of one image, whose number the detector bounds.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "x1", "y1"], ascending=[False, True, True], kind="stable")
        box = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        area = np.maximum(0, box[:, 2] - box[:, 0]) * np.maximum(0, box[:, 3] - box[:, 1])
        left = np.ones(len(pdf), bool)
        for i in range(len(pdf)):
            if left[i]:
                w = np.maximum(0, np.minimum(box[i, 2], box[:, 2]) - np.maximum(box[i, 0], box[:, 0]))
                h = np.maximum(0, np.minimum(box[i, 3], box[:, 3]) - np.maximum(box[i, 1], box[:, 1]))
                union = area[i] + area - w * h
                iou = np.divide(w * h, union, out=np.zeros_like(union), where=union > 0)
                left &= ~((iou > most) & (np.arange(len(pdf)) > i))
        return pdf[left]

    return boxes.groupBy(by).applyInPandas(keep, boxes.schema)
