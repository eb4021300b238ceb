"""Numbers in a global order without bringing the rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.storage import materialize

_ROW_BITS = 33  # of monotonically_increasing_id: the partition is above, the row within it below


def numbered(rows: DataFrame, order: list[str] | list[Column], name: str = "number", start: int = 0) -> DataFrame:
    """Adds consecutive numbers in ``order``: ranges are sorted apart, then one number a range is added up.

    Rows that are equal in ``order`` are numbered in no fixed order among each other.
    """
    at = F.monotonically_increasing_id()
    sorted_ = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "sorted")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return sorted_.withColumn("_part", part).join(before, "_part").withColumn(name, (F.col("_before") + within + start).cast("bigint")).drop("_at", "_part", "_before")


def dealt(rows: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Adds ``worker``: rows are dealt out in turn, in order."""
    return numbered(rows, order, "worker").withColumn("worker", F.pmod("worker", F.lit(workers)).cast("int"))
