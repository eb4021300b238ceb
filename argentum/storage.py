"""Intermediate tables in the folder that the driver and all executors share.

A table that several later steps read, or whose lineage would otherwise be
replayed after the loss of an executor, is written as Parquet below
``spark.checkpoint.dir`` and read back.  Only where that setting is absent (a
plain local session, as in the tests) does this module set a folder of its own.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_OPENED: list = []


def scratch_dir(spark: SparkSession) -> str:
    """The session's shared folder for intermediate tables of this run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"{tempfile.gettempdir()}/argentum-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/argentum-{_RUN}"
    if path not in _OPENED:
        _OPENED.append(path)
        atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it lives in; quiet if the session is gone."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may have ended first, at exit
        return


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` below the shared folder; returns its path."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back with the same schema: lineage ends here."""
    path = write_table(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` made and that no later step reads."""
    drop_path(df.sparkSession, df.written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
