"""Embedding and zero-shot classification jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.streaming.ledger import utc_text

from .pending import exclude_video_hashes, pending_hashes, pending_images
from .vectors import classify

#: Largest batch of a model, batch size from which its results are spot-checked, and the agreement asked.
MOST_BATCH, CHECKED_BATCH, AGREEMENT = 768, 48, 0.99


def clamp_batch(batch: int, most: int = MOST_BATCH) -> int:
    return min(most, max(1, batch))


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: unit vectors from digests of the inputs."""

    def embed(items: list[str]) -> np.ndarray:
        out = np.stack([np.frombuffer(hashlib.shake_128(x.encode()).digest(2 * dims), "<i2").astype(np.float64) for x in items])
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return embed


def stand_in(model: str, kind: str) -> Callable[[list[str]], np.ndarray]:
    """An embedder for the command line that needs no weights; images and texts share no meaning."""
    return hashing_embedder()


def verify_batch(embed, items: list[str], got: np.ndarray) -> None:
    """A large batch's first result must agree with the same input alone."""
    if len(items) >= CHECKED_BATCH:
        alone = embed(items[:1])[0]
        if float(alone @ got[0]) <= AGREEMENT * float(np.linalg.norm(alone) * np.linalg.norm(got[0])):
            raise RuntimeError("the model gives other results in a large batch")


def embed_job(files: DataFrame, embeddings: DataFrame, model: str, embed: Callable[[list[str]], np.ndarray], batch: int = 96) -> DataFrame:
    """(model_id, hash, embedding, embedded_at) of contents not embedded yet; inputs that fail are left out."""
    size, now = clamp_batch(batch), utc_text()

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                items = part["path"].tolist()
                try:
                    got = embed(items)
                    verify_batch(embed, items, got)
                    rows = list(zip(part["hash"], got))
                except (OSError, ValueError):
                    rows = []
                    for h, p in zip(part["hash"], items):
                        try:
                            rows.append((h, embed([p])[0]))
                        except (OSError, ValueError):
                            continue
                if rows:
                    unit = [(v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist() for _, v in rows]
                    yield pd.DataFrame({"model_id": model, "hash": [h for h, _ in rows], "embedding": unit, "embedded_at": now})

    return pending_images(files, embeddings, model).mapInPandas(run, "model_id string, hash string, embedding array<float>, embedded_at string")


def classify_job(files: DataFrame, embeddings: DataFrame, classifications: DataFrame, model: str, prompts: dict[str, list[float]], margin: float = 0.05, reprocess: bool = False) -> DataFrame:
    """(model_id, hash, category, confidence, classified_at) of unclassified contents, or of all but videos."""
    own = embeddings.where(F.col("model_id") == model)
    todo = exclude_video_hashes(files, own.select("hash").distinct()) if reprocess else pending_hashes(files, embeddings, classifications, model)
    got = classify(own.join(todo, "hash", "left_semi"), prompts, margin)
    return got.select(F.lit(model).alias("model_id"), "hash", "category", "confidence", F.lit(utc_text()).alias("classified_at"))
