"""Records from tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MARKDOWN, PLAINTEXT


def from_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A plain-text record a document, its language as kind; labels become metadata."""
    out = documents.select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("ref"), F.col("lang").alias("kind"),
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("source_ref"),
        F.lit(PLAINTEXT).alias("body_format"), F.col("text").alias("body_text"),
    )
    if labels is None:
        return out.drop("doc_id")
    meta = labels.select("doc_id", F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array(F.col("quality").cast("string"), F.col("toxic").cast("string"))).alias("metadata"))
    return out.join(meta, "doc_id", "left").drop("doc_id")


def from_conversations(turns: DataFrame) -> DataFrame:
    """A Markdown record a conversation, a heading a turn."""
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("x")))), lambda t: t["x"]), "\n\n")
    ref = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    return turns.groupBy("conv_id").agg(body.alias("body_text")).select(
        ref.alias("ref"), F.lit("conversation").alias("kind"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
        F.lit("conversations").alias("source_ref"), F.lit(MARKDOWN).alias("body_format"), "body_text",
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """A plain-text record a page, its source as it is."""
    return pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("ref"), F.lit("page").alias("kind"), F.col("url").alias("title"), F.col("url").alias("source_ref"), F.lit(PLAINTEXT).alias("body_format"), F.col("html").alias("body_text"))
