"""Which chunks already have a vector in an earlier index of the same embedder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SCHEMA_VERSIONS, ReuseStatus


def reuse_key(title: Column, heading: Column, content: Column, context: Column) -> Column:
    """Everything of a chunk that its vector depends on."""
    return F.sha2(F.concat_ws("\0", title, heading, content, context), 256)


def compatibility(manifest: dict | None, fingerprint: str, dimension: int, mode: str) -> tuple[ReuseStatus, str]:
    """(status, reason); never an error: an index that can't serve is embedded anew."""
    if manifest is None:
        return ReuseStatus.UNAVAILABLE, "no index to reuse"
    checks = (
        (manifest.get("schema_version") in SCHEMA_VERSIONS, "schema version"),
        (str(manifest.get("embedder_fingerprint", "")).strip() == fingerprint.strip(), "embedder"),
        (manifest.get("embedder_dimension") == dimension, "dimension"),
        (manifest.get("quantization") == mode, "quantization"),
    )
    bad = [name for ok, name in checks if not ok]
    return (ReuseStatus.INCOMPATIBLE, "another " + ", ".join(bad)) if bad else (ReuseStatus.ACTIVE, "")


def split(chunks: DataFrame, old: DataFrame | None) -> DataFrame:
    """Chunks with ``old_embedding``: the vector that the same record had for the same text, or null.

    ``chunks`` and ``old`` have (ref, title, heading, content, context_prefix), ``old`` also embedding. Reuse stays within a
    record, so both sides meet by ref."""
    if old is None:
        return chunks.withColumn("old_embedding", F.lit(None).cast("array<double>"))
    key = reuse_key(*[F.col(c) for c in ("title", "heading", "content", "context_prefix")])
    have = old.select(F.col("ref").alias("old_ref"), key.alias("old_key"), F.col("embedding").alias("v")).groupBy("old_ref", "old_key").agg(F.first("v").alias("old_embedding"))
    return chunks.withColumn("key", key).join(have, (F.col("ref") == F.col("old_ref")) & (F.col("key") == F.col("old_key")), "left").drop("old_ref", "old_key", "key")


@dataclass
class Plan:
    reused: int
    embedded: int
    unchanged_records: int


def summary(planned: DataFrame, records: DataFrame, old_records: DataFrame | None) -> Plan:
    """Counts of a plan from ``split`` over chunks that get a vector: a record is unchanged where its hash is the same and
    all its vectors are reused."""
    by = planned.groupBy("ref").agg(F.count("old_embedding").alias("reused"), F.count(F.lit(1)).alias("all"))
    rows = records.select("ref", "content_hash").join(by, "ref", "left")
    if old_records is None:
        rows = rows.withColumn("same", F.lit(False))
    else:
        rows = rows.join(old_records.select("ref", F.col("content_hash").alias("old_hash")), "ref", "left").withColumn("same", F.coalesce(F.col("old_hash") == F.col("content_hash"), F.lit(False)))
    unchanged = F.col("same") & (F.coalesce("reused", F.lit(0)) == F.coalesce("all", F.lit(0)))
    r = rows.agg(F.coalesce(F.sum("reused"), F.lit(0)), F.coalesce(F.sum(F.col("all") - F.col("reused")), F.lit(0)), F.coalesce(F.sum(unchanged.cast("int")), F.lit(0))).first()
    return Plan(int(r[0]), int(r[1]), int(r[2]))
