"""Connected components of an edge table, by root hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.storage import drop_table, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (u, v): label is the smallest id of its component.

    A round finds the smallest label next to each vertex, hands it to the vertex
    and to the vertex's own label (its root), and replaces every label by that
    label's label.  Since roots move along, trees are joined whole: chains of n
    vertices end after about log2(n) rounds, whatever their order.  Every round's
    labels are a written table; the rounds end when no vertex has a neighbour with
    a smaller label.  An empty edge table has no components.  Edges may repeat and
    may be loops.
    """
    both = materialize(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("m"))
        seen = labels.join(near, "id").select("id", "label", F.least("label", "m").alias("m"))
        proposed = seen.select("id", F.col("label").alias("old"), "m").union(seen.select(F.col("label").alias("id"), F.lit(None).cast(seen.schema["label"].dataType).alias("old"), "m"))
        low = materialize(proposed.groupBy("id").agg(F.max("old").alias("old"), F.min("m").alias("label")), "hooked")
        if not low.where("old <> label").limit(1).count():
            drop_table(low)
            return labels
        up = low.select(F.col("id").alias("label"), F.col("label").alias("up"))
        before, labels = labels, materialize(low.join(up, "label").select("id", F.col("up").alias("label")), "labels")
        drop_table(low)
        drop_table(before)
