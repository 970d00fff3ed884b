"""A training corpus from raw documents: five stages, each an operator of the llm package, in this order.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the encoded corpus. All
stages take a table with any further columns, of whatever name, and an empty table, of which they give an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaquarry.llm import decontamination, ngram_jaccard, sentencepiece_codec, substring_dedup, toxicity
from lexaquarry.llm._shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the machine trained on the labels rejects.

    Null and empty texts stay, as does a score that equals the threshold; texts of any length are scored whole. Rows that
    repeat a document stay or go together, and null doc_ids are judged by their text. Labels without both classes, or of
    no document here, reject nothing."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id, of each group of near duplicates.

    Null doc_ids, null texts and texts without a letter or digit stay. Rows that repeat the kept document stay. Of equal
    texts the smallest doc_id stays; a similarity that equals the threshold ties."""
    return ngram_jaccard.keep_one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that an earlier document has; n_chars, where there is such a column, follows the text.

    Null doc_ids and null texts stay as they are, texts of fewer words than a passage too. Rows that repeat a document are
    cut alike; what only repeats within one doc_id stays. A text of which nothing is left goes; of equal passages that of
    the smallest doc_id stays."""
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark questions, whatever their numbers and names.

    Each row is judged by its text alone, so null doc_ids go like others and rows of equal texts go together; null and empty
    texts stay. Null items and an empty benchmark reject nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of each document: a row a row, repeated ones and null doc_ids among them. A null text
    has null pieces, an empty one none; texts of any length are encoded whole."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: The first stage is a trained machine, which SQL can't state; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus of ``documents``; between stages, documents are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
