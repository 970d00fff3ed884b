"""Full-text search: postings, all-terms matching and BM25.

Index tables: ``postings`` (term, chunk_id, kind, tf, len), sorted by term so that a query reads a few row groups, and the
corpus-wide number of chunks and of tokens. Term counts and lengths run over title, heading and text together. A table
without an index is searched by ``scan``: one pass that splits each text once and keeps the query's terms alone.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.text import query_tokens, search_tokens
from ..sources import scratch
from .search import of_kinds

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
PART_ROWS, SAMPLE = 1_000_000, 4000  #: postings of a part that is sorted; chunks of which the bounds of parts are guessed


def _words() -> Column:
    """The tokens of title, heading and text; a blank between them is part of none."""
    return search_tokens(F.concat_ws(" ", "title", "heading", "text"))


def _count(batches: Iterator[pa.RecordBatch], names: list[str], bounds: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "w", rows=4096):
        size, words = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False), batch.column("w").flatten().dictionary_encode()
        if n := len(words.dictionary):
            key, tf = np.unique(np.repeat(np.arange(batch.num_rows), size) * n + words.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(key, n)
            out = [words.dictionary.take(pa.array(term)), *[batch.column(c).take(pa.array(row)) for c in ("chunk_id", "kind")], pa.array(tf, pa.int32()), pa.array(size[row], pa.int32())]
            if bounds is not None:
                own = words.dictionary.to_pylist()
                first, last = (np.array([f(bounds, x) for x in own]) for f in (bisect_left, bisect_right))
                out.append(pa.array(first[term] + out[1].to_numpy() % (last - first + 1)[term], pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names=names)


def postings(chunks: DataFrame, bounds: list[str] | None = None) -> DataFrame:
    """(term, chunk_id, kind, tf, len) of (chunk_id, kind, title, heading, text), a row of which is a whole chunk: its terms
    are counted where it is, and nothing is shuffled. With bounds of terms, also the ``part`` between two of them; a term
    that is several bounds has its chunks spread over all parts that touch these."""
    rows = chunks.select("chunk_id", "kind", _words().alias("w"))
    ids = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("chunk_id", "kind")]
    columns = ["term string", *ids, "tf int", "len int", *["part int"] * (bounds is not None)]
    return rows.mapInArrow(partial(_count, names=[x.split()[0] for x in columns], bounds=bounds), ", ".join(columns))


def sorted_postings(chunks: DataFrame, n: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``postings`` of n chunks in order of terms. Texts are split once: the bounds of the parts are guessed from a sample,
    which says how even the parts are and nothing else."""
    share = min(1.0, SAMPLE / max(1, n))
    some = (chunks.sample(share, 1) if share < 1 else chunks).select(F.explode(F.array_distinct(_words())).alias("term"))
    counts = sorted((r.term, r.n) for r in some.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = np.cumsum([x for _, x in counts]) if counts else np.zeros(1)
    parts = max(1, math.ceil(ends[-1] / share / part_rows))
    bounds = [counts[i][0] for i in np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)]
    return postings(chunks, bounds).repartitionById(parts, "part").sortWithinPartitions("term", "chunk_id").drop("part")


def merged_postings(chunks: DataFrame) -> DataFrame:
    """``postings`` of a table in which an id may come more than once: such rows of one kind and length count as one chunk."""
    own = postings(chunks)
    if chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return own
    return own.groupBy("chunk_id", "kind", "len", "term").agg(F.sum("tf").cast("int").alias("tf")).select("term", "chunk_id", "kind", "tf", "len")


def index_size(chunks: DataFrame) -> tuple[int, int]:
    """(chunks, tokens) of the whole index, whatever a query filters."""
    n, total = chunks.agg(F.count(F.lit(1)), F.sum(F.size(_words()))).first()
    return n, int(total or 0)


def scan(chunks: DataFrame, text: str, k: int | None, kinds=None) -> DataFrame:
    """What ``search`` finds in the postings of these chunks (chunk_id, kind, title, heading, text), without them; with k
    None all that match."""
    terms = query_tokens(text, chunks.sparkSession)
    distinct = sorted(set(terms))
    rows = chunks.select("chunk_id", "kind", _words().alias("w")).select("chunk_id", "kind", F.size("w").alias("len"), F.filter("w", lambda x: x.isin(distinct)).alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    counts = F.array(*[F.struct(F.lit(t).alias("term"), count(t).alias("tf")) for t in distinct]) if distinct else F.array().cast("array<struct<term:string,tf:int>>")
    rows = scratch.written(rows.select("chunk_id", "kind", "len", F.when(F.size("w") > 0, F.filter(counts, lambda x: x["tf"] > 0)).alias("found")), "scan")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("len")).first()
    hits = rows.filter("found is not null").select("chunk_id", "kind", "len", F.inline("found"))
    return match(hits, terms, (n, int(total or 0)), k, kinds)


def idf(n: Column, chunks: Column) -> Column:
    x = F.ln((chunks - n + 0.5) / (n + 0.5))
    return F.when(x > 0, x).otherwise(F.lit(LEAST_IDF))


def term_weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def match(index: DataFrame, terms: list[str], size: tuple[int, int], k: int | None, kinds=None) -> DataFrame:
    """(chunk_id, score) of the k best chunks that have all terms, or of all in no order where k is None; a term that a query repeats counts each time. The
    statistics are those of the whole index, the kinds only say which chunks may be found."""
    chunks, total = size
    distinct = sorted(set(terms))
    if not distinct or not total:
        return index.sparkSession.createDataFrame([], "chunk_id bigint, score double")
    hits = index.filter(F.col("term").isin(distinct))
    # a row a term: small whatever the index
    known = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).select("term", idf(F.col("n"), F.lit(float(chunks))).alias("idf")))
    times = F.create_map(*[x for t in distinct for x in (F.lit(t), F.lit(float(terms.count(t))))])
    parts = of_kinds(hits, kinds).join(known, "term").select("chunk_id", "term", (times[F.col("term")] * F.col("idf") * term_weight(F.col("tf"), F.col("len"), F.lit(total / chunks))).alias("w"))
    # summed in the order of the terms, so that equal chunks tie exactly
    sums = parts.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("x")).filter(F.size("x") == len(distinct))
    scores = sums.select("chunk_id", F.aggregate("x", F.lit(0.0).cast("double"), lambda s, x: s + x["w"]).alias("score"))
    return scores if k is None else scores.orderBy(F.desc("score"), "chunk_id").limit(k)


def search(index: DataFrame, text: str, size: tuple[int, int], k: int | None, kinds=None) -> DataFrame:
    """A query without a letter or digit finds nothing."""
    return match(index, query_tokens(text, index.sparkSession), size, k, kinds)
