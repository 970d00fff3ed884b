"""Records: normalization, validation, hashes and fingerprints, filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_KIND, MARKDOWN, PLAINTEXT, UpdatePlanTooLarge, listed
from ..functions.text import or_else, quoted, trim_white

COLUMNS = ("ref", "kind", "title", "source_ref", "body_format", "body_text", "content_hash", "metadata")


def new_record(ref: Column, title: Column, body: Column) -> list[Column]:
    """Columns of a Markdown record."""
    return [ref.alias("ref"), title.alias("title"), F.lit(MARKDOWN).alias("body_format"), body.alias("body_text")]


def normal_metadata(m: Column) -> Column:
    """Keys and values trimmed, blank keys dropped; of keys that become equal the greatest raw one wins. Nothing left: null."""
    entries = F.filter(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(trim_white(e["key"]).alias("key"), trim_white(F.coalesce(e["value"], F.lit(""))).alias("value"))), lambda e: e["key"] != "")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.when(F.size(last) > 0, F.map_from_entries(last))


def content_hash() -> Column:
    """SHA-256 of the record's quoted fields; ref and source_ref don't count."""
    parts = [F.concat(quoted(F.lit(c)), F.lit("="), quoted(F.col(c))) for c in ("kind", "title", "body_format", "body_text")]
    meta = F.coalesce(F.transform(F.map_entries("metadata"), lambda e: F.concat(quoted(F.concat(F.lit("metadata."), e["key"])), F.lit("="), quoted(e["value"]))), F.array().cast("array<string>"))
    return F.sha2(F.array_join(F.array_sort(F.concat(F.array(*parts), meta)), "\n"), 256)


def in_order(records: DataFrame) -> DataFrame:
    """Raw records in range partitions of their refs as ``normalize`` gives them. Ranges are found by reading all rows once
    more, so this stands before what is costly."""
    ref = F.coalesce(F.col("ref").cast("string"), F.lit("")) if "ref" in records.columns else F.lit("")
    return records.repartitionByRange(trim_white(ref))


def normalize(records: DataFrame) -> DataFrame:
    """All columns of a record, trimmed and with defaults; columns that are missing count as empty, others are dropped.
    ``error`` has what is wrong with a record, or null."""
    have = set(records.columns)
    raw = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in have else F.lit("")
    meta = F.col("metadata") if "metadata" in have else F.lit(None).cast("map<string,string>")
    out = records.select(trim_white(raw("ref")).alias("ref"), *[raw(c).alias(c) for c in COLUMNS[1:-1]], normal_metadata(meta).alias("metadata"))
    out = out.select(
        "ref",
        or_else(F.col("kind"), F.lit(DEFAULT_KIND)).alias("kind"),
        or_else(F.col("title"), F.col("ref")).alias("title"),
        or_else(F.col("source_ref"), F.col("ref")).alias("source_ref"),
        or_else(F.col("body_format"), F.lit(MARKDOWN)).alias("body_format"),
        trim_white(F.col("body_text")).alias("body_text"),
        trim_white(F.col("content_hash")).alias("given"),
        "metadata",
    )
    out = out.withColumn("content_hash", F.when(F.col("given") != "", F.col("given")).otherwise(content_hash()))
    return out.select(*COLUMNS, problem().alias("error"))


def problem() -> Column:
    """The first thing that is wrong with a normalized record."""
    empty = [F.when(F.col(c) == "", F.lit(f"record {c} is required")) for c in ("ref", "kind", "title", "source_ref")]
    known = F.when(~F.col("body_format").isin(MARKDOWN, PLAINTEXT), F.concat(F.lit("unsupported body format "), quoted(F.col("body_format"))))
    return F.coalesce(*empty, known, F.when(F.col("content_hash") == "", F.lit("record content_hash is required")))


def validated(records: DataFrame) -> DataFrame:
    """Normalized records; the first that is wrong fails the job that reads it."""
    ok = normalize(records)
    return ok.select(*[F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("record "), quoted(F.col("ref")), F.lit(": "), F.col("error")))).otherwise(F.col("ref")).alias("ref") if c == "ref" else c for c in COLUMNS])


EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, between = hashlib.sha256(), b""
    for batch in batches:
        for line in batch.column(0).to_pylist():
            digest.update(between + line.encode())
            between = b"\n"
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["fingerprint"])


def fingerprint(pairs: DataFrame) -> DataFrame:
    """One row (fingerprint) of (ref, content_hash) pairs, whatever their order; an empty hash fails.

    The hash runs over all pairs' lines in order, so one task reads them, sorted on disk where they don't fit; it holds one
    batch at a time."""
    line = F.concat("ref", F.lit(":"), F.when(F.col("content_hash") == "", F.raise_error(F.lit("empty content_hash"))).otherwise(F.col("content_hash")))
    one = pairs.select(line.alias("line")).repartition(1).sortWithinPartitions("line").mapInArrow(_digest, "fingerprint string")
    return one.agg(F.coalesce(F.first("fingerprint"), F.lit(EMPTY)).alias("fingerprint"))


def pick(rows: DataFrame, refs=None, kinds=None) -> DataFrame:
    """Rows of the listed refs and kinds; a list of blanks alone filters nothing."""
    for column, values in (("ref", listed(refs)), ("kind", listed(kinds))):
        if values:
            rows = rows.filter(F.col(column).isin(values))
    return rows


def duplicates(records: DataFrame) -> DataFrame:
    """Refs of more than one record."""
    return records.groupBy("ref").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")


def require_distinct(records: DataFrame, label: str = "") -> None:
    twice = duplicates(records).select("ref").head()
    if twice:
        raise ValueError(f"duplicate {label} record ref {twice[0]!r}".replace("  ", " "))


def removed_refs(spark, refs) -> DataFrame:
    """Trimmed distinct refs in order, from a list or a DataFrame with a column ref."""
    rows = refs if isinstance(refs, DataFrame) else spark.createDataFrame([(x,) for x in refs or ()], "ref string")
    return rows.select(trim_white(F.col("ref")).alias("ref")).filter("ref <> ''").distinct().orderBy("ref")


def require_disjoint(added: DataFrame, removed: DataFrame) -> None:
    both = added.join(removed, "ref", "left_semi").select("ref").head()
    if both:
        raise ValueError(f"record ref {both[0]!r} is both added and removed")


def require_planned(records: DataFrame, most: int) -> None:
    """Removals don't count; 0 is no cap."""
    if most < 0:
        raise ValueError("the cap of planned records must not be negative")
    if most and records.limit(most + 1).count() > most:
        raise UpdatePlanTooLarge(f"more than {most} records to add")
