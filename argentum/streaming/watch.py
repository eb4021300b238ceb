"""Watching a folder of records or media: a file stream whose batches run the stages in order.

A stage that fails doesn't stop the others, and its batch isn't lost: the batch is
kept for that stage beside the checkpoint and given to it again, oldest first, when
the watch starts and before every later batch, until the stage takes it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from argentum.schemas import SCHEMAS
from argentum.storage import drop_path, folders_in

log = logging.getLogger(__name__)

#: Seconds between two polls.
INTERVAL_S = 300
Stages = list[tuple[str, Callable[[DataFrame, int], None]]]


def record_stream(spark: SparkSession, path: str, schema: str = SCHEMAS["file_hashes"], fmt: str = "parquet") -> DataFrame:
    """Newly arriving record files; the checkpoint remembers which have been taken."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def media_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, modified) of newly arriving media files, for ``sources.scan.file_records``, which reads them from their paths."""
    rows = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def _attempt(name: str, stage: Callable[[DataFrame, int], None], batch: DataFrame, batch_id: int) -> str:
    try:
        stage(batch, batch_id)
        return "ok"
    except Exception as e:
        log.warning("stage %s failed on batch %s: %s", name, batch_id, e)
        return f"failed: {e}"


def retry_failed(spark: SparkSession, stages: Stages, kept: str) -> dict[str, list[int]]:
    """Give every kept batch to its stage again; {stage: batches that it took}."""
    taken: dict[str, list[int]] = {}
    for name, stage in stages:
        for batch_id in sorted(int(x) for x in folders_in(spark, f"{kept}/{name}") if x.isdigit()):
            path = f"{kept}/{name}/{batch_id}"
            if _attempt(name, stage, spark.read.parquet(path), batch_id) != "ok":
                break  # later ones wait, so that batches reach a stage in order
            drop_path(spark, path)
            taken.setdefault(name, []).append(batch_id)
    return taken


def run_cycle(batch: DataFrame, batch_id: int, stages: Stages, kept: str | None = None) -> dict[str, str]:
    """Run all stages over a batch, after the batches kept for them.

    One that fails is logged and doesn't stop the others; with a folder ``kept`` its
    batch is kept there (an error in doing so is raised, so that the stream replays
    the batch).  A stage that still has kept batches gets this one after them.
    """
    spark = batch.sparkSession
    if kept is not None:
        retry_failed(spark, stages, kept)
    outcome = {}
    for name, stage in stages:
        waits = kept is not None and folders_in(spark, f"{kept}/{name}")
        outcome[name] = "failed: earlier batches wait" if waits else _attempt(name, stage, batch, batch_id)
        if outcome[name] != "ok" and kept is not None:
            batch.write.mode("overwrite").parquet(f"{kept}/{name}/{batch_id}")
    return outcome


def watch(stream: DataFrame, stages: Stages, checkpoint: str, once: bool = False, interval_s: int = INTERVAL_S) -> StreamingQuery:
    """Start the loop; ``once`` takes what is there and ends.

    A batch that is run again must leave the same tables, so stages upsert by key.
    """
    kept = f"{checkpoint.rstrip('/')}-failed"
    retry_failed(stream.sparkSession, stages, kept)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: run_cycle(b, i, stages, kept) and None)
    trigger = {"availableNow": True} if once else {"processingTime": f"{interval_s} seconds"}
    return writer.trigger(**trigger).start()
