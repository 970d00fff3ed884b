"""Vector search: exact top k in full, by a prefix of the vectors, or by their signs; one query or many.

Vectors are rows (chunk_id, ref, kind, chunk_index, embedding) and, in the binary mode, ``bits``. Filters stand below
every limit, ties go by chunk_id, and payload is joined behind the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import BINARY, FLOAT32, INT8, RESCORE_FACTOR, listed_kinds, search_dimension
from ..functions import vectors as V

QUERY_BYTES = 16 << 20  #: of queries, and as much of vectors, that a task holds
QUERY_BLOCK, VECTOR_BLOCK, PAIRS = 512, 4096, 1 << 14  #: rows of a matrix product, and pairs scored at once
LEAST_GROUP = 2048  #: queries or vectors below which groups aren't divided for the sake of more tasks


def of_kinds(rows: DataFrame, kinds) -> DataFrame:
    kinds = listed_kinds(kinds)
    return rows if kinds is None else rows.filter(F.col("kind").isin(kinds))


def _query(vector: list[float], mode: str) -> Column:
    """The query as the index keeps vectors: int8 searches compare int8 with int8."""
    q = V.as_array(vector)
    return V.to_int8(q) if mode == INT8 else q.cast("array<float>")


def _nearest(rows: DataFrame, distance: Column, k: int, keys: tuple[str, ...] = ("ref", "chunk_index", "chunk_id")) -> DataFrame:
    return rows.withColumn("distance", distance).orderBy(F.asc_nulls_last("distance"), *keys).limit(k)


def nearest(vectors: DataFrame, query: list[float], k: int, kinds=None, mode: str = FLOAT32, dimension: int = 0) -> DataFrame:
    """(chunk_id, ref, chunk_index, distance, score) of the k nearest. Vectors without length have distance 1.

    With a ``dimension`` below the stored one, RESCORE_FACTOR times k are picked by that prefix and scored again in full;
    in the binary mode the same number is picked by differing signs."""
    rows = of_kinds(vectors, kinds)
    prefix = search_dimension(dimension, len(query), mode)
    q = _query(query, mode)
    if mode == BINARY:
        rows = _nearest(rows, V.hamming(F.col("bits"), V.to_bits(q)), RESCORE_FACTOR * k, ("chunk_id",)).drop("distance")
    elif prefix:
        rows = _nearest(rows, V.cosine_distance(V.prefix(F.col("embedding"), prefix), V.prefix(q, prefix)), RESCORE_FACTOR * k, ("chunk_id",)).drop("distance")
    out = _nearest(rows, V.cosine_distance(F.col("embedding"), q), k)
    return out.select("chunk_id", "ref", "chunk_index", "distance", V.score(F.col("distance")).alias("score"))


FOUND = "query_id bigint, chunk_id bigint, ref string, chunk_index int, distance double"


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed from the first component on, as the single-query form does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _exact(q: np.ndarray, v: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, with the products n of their lengths, as the single-query form gives them."""
    dots = np.concatenate([np.empty(0), *(_in_order(q[i[x : x + PAIRS]].astype(np.float64), v[j[x : x + PAIRS]].astype(np.float64)) for x in range(0, len(i), PAIRS))])
    return np.where(n > 0, 1 - dots / np.where(n > 0, n, 1), 1.0)


def _matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
    lists = [x.column("embedding") for x in batches]
    sizes = np.unique(np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sizes[0]}, {sizes[-1]}")
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in lists])


def _cell(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query among the vectors of a cell. A matrix product in single precision finds them up to its greatest
    error; those near the cut are scored again in order of components, so equal vectors tie exactly. Both sides are taken in
    blocks, so what is held besides them doesn't depend on their number."""
    asked, stored = [], []
    for batch in batches:
        asked.append(batch.filter(batch.column("asks")))
        stored.append(batch.filter(pc.invert(batch.column("asks"))))
    asked, stored = ([x for x in y if x.num_rows] for y in (asked, stored))
    if not asked or not stored:
        return
    q, v = _matrix(asked), _matrix(stored)
    if v.shape[1] != q.shape[1]:
        raise ValueError(f"queries have dimension {q.shape[1]}, vectors {v.shape[1]}")
    ids = pa.Table.from_batches([x.select(["id"]) for x in asked]).combine_chunks().column(0)
    rows = pa.Table.from_batches([x.select(["ref", "chunk_index", "id"]) for x in stored])
    order = pc.sort_indices(rows, [(c, "ascending") for c in rows.column_names], null_placement="at_start")
    rows, v = rows.take(order), v[order.to_numpy()]  # ties go by place from here on

    def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.concatenate([np.sqrt(_in_order(y, y)) for y in (x[at : at + PAIRS].astype(np.float64) for at in range(0, len(x), PAIRS))])
        return n, (x / np.where(n > 0, n, 1)[:, None]).astype(np.float32)

    (q_length, q_unit), (v_length, v_unit) = unit(q), unit(v)
    margin = (q.shape[1] + 8) * 2**-23 * 1.1  # twice the rounding of a product of unit vectors
    for begin in range(0, len(q), QUERY_BLOCK):
        block = q_unit[begin : begin + QUERY_BLOCK]
        cut = np.full(len(block), -np.inf, np.float32)
        best_i, best_j, best_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(v), VECTOR_BLOCK):
            near = block @ v_unit[at : at + VECTOR_BLOCK].T
            if not at and near.shape[1] > k:
                cut = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            i, j = np.nonzero(near >= (cut - np.float32(margin))[:, None])
            if not len(i):
                continue
            j += at
            d = _exact(q, v, q_length[begin + i] * v_length[j], begin + i, j)
            best_i, best_j, best_d = np.r_[best_i, i], np.r_[best_j, j], np.r_[best_d, d]
            by = np.lexsort((best_j, best_d, best_i))
            by = by[np.arange(len(by)) - np.searchsorted(best_i[by], best_i[by]) < k]
            best_i, best_j, best_d = best_i[by], best_j[by], best_d[by]
            last = np.flatnonzero(np.arange(len(by)) - np.searchsorted(best_i, best_i) == k - 1)
            cut[best_i[last]] = np.maximum(cut[best_i[last]], (1 - best_d[last]).astype(np.float32))
        found = rows.take(pa.array(best_j))
        yield from pa.table([ids.take(pa.array(begin + best_i)), found["id"], found["ref"], found["chunk_index"], pa.array(best_d)], names=[x.split()[0] for x in FOUND.split(", ")]).combine_chunks().to_batches()


def _grid(queries: int, vectors: int, row_bytes: int, most: int, tasks: int) -> tuple[int, int]:
    """Numbers of groups of queries and of vectors: groups of so many bytes at most, and tasks enough unless they get small."""
    r, c = (max(1, -(-n * row_bytes // most)) for n in (queries, vectors))
    while r * c < tasks and max(queries / r, vectors / c) > LEAST_GROUP:
        r, c = (2 * r, c) if queries / r > vectors / c else (r, 2 * c)
    return r, c


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int, kinds=None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, chunk_id, ref, chunk_index, distance, score), rank from 0: the k nearest of every query (query_id,
    embedding), as ``nearest`` gives them. Queries and vectors are dealt into groups, every pair of groups is a task's, and
    only k rows a query and group of vectors are shuffled; nothing of either passes through the driver."""
    spark = vectors.sparkSession
    v = of_kinds(vectors, kinds).select(F.lit(False).alias("asks"), F.col("chunk_id").cast("bigint").alias("id"), "ref", F.col("chunk_index").cast("int").alias("chunk_index"), "embedding")
    q = queries.select(F.lit(True).alias("asks"), F.col("query_id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("chunk_index"), "embedding")
    single = all(x.schema["embedding"].dataType.elementType.typeName() in ("float", "byte") for x in (q, v))
    size = lambda x: x.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    (n_q, d_q), (n_v, d_v) = size(q), size(v)
    r, c = _grid(n_q, n_v, (4 if single else 8) * max(1, d_q, d_v), query_bytes, 3 * spark.sparkContext.defaultParallelism)
    own = lambda n: F.pmod(F.xxhash64("id", "embedding"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = q.withColumn("r", own(r)).withColumn("c", each(c)).unionByName(v.withColumn("c", own(c)).withColumn("r", each(r)))
    dealt = dealt.select((F.col("r") * c + F.col("c")).alias("cell"), "asks", "id", "ref", "chunk_index", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    found = dealt.repartitionById(r * c, "cell").drop("cell").mapInArrow(partial(_cell, k=k), FOUND)
    order = Window.partitionBy("query_id").orderBy("distance", "ref", "chunk_index", "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
    return ranked.select("query_id", "rank", "chunk_id", "ref", "chunk_index", "distance", V.score(F.col("distance")).alias("score"))
