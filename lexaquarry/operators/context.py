"""The surroundings of chunks: their parent, and neighbours of the same parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(chunks: DataFrame, hits: DataFrame, include_parent: bool = False, window: int = 0) -> DataFrame:
    """(hit_id, position, chunk_id, ref, ...): for each hit (chunk_id), its parent if asked for, then the chunks of the same
    record and parent whose chunk_index is at most ``window`` away, the hit itself among them. Hits that don't exist give
    nothing; a parent in another record counts as absent. One equi-join on the record serves all hits."""
    window = max(0, window)
    at = chunks.join(hits.select(F.col("chunk_id").alias("hit_id")).distinct(), F.col("chunk_id") == F.col("hit_id"))
    at = at.select("hit_id", F.col("ref").alias("hit_ref"), F.col("chunk_index").alias("hit_index"), F.col("parent_chunk_id").alias("hit_parent"))
    near = (F.col("chunk_index") - F.col("hit_index")).between(-window, window) & F.col("parent_chunk_id").eqNullSafe(F.col("hit_parent"))
    up = F.col("chunk_id") == F.col("hit_parent") if include_parent else F.lit(False)
    rows = chunks.join(at, (F.col("ref") == F.col("hit_ref")) & (near | up))
    first = F.coalesce(F.col("chunk_id") == F.col("hit_parent"), F.lit(False))
    from pyspark.sql.window import Window

    order = Window.partitionBy("hit_id").orderBy(F.desc(first), "chunk_index", "chunk_id")
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("int")).select("hit_id", "position", *chunks.columns)
