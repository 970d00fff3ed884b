"""Retrieval arms and how they become one ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 60
FUSED = "chunk_id bigint, score double, provenance map<string,struct<rank:int,score:double>>"


@dataclass
class Arm:
    """Hits (chunk_id, rank, score) of one way to search, rank from 0; an arm that can't search is not available."""

    name: str
    hits: DataFrame | None = None
    available: bool = True
    error: Exception | None = None


def ranked(hits: DataFrame, *order) -> DataFrame:
    """(chunk_id, rank, score) of at most a few hundred hits."""
    return hits.select("chunk_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"), "score")


def check_arms(arms: list[Arm]) -> None:
    seen: set[str] = set()
    for i, a in enumerate(arms):
        if not a.name:
            raise ValueError(f"arm {i} has no name")
        if a.name in seen:
            raise ValueError(f"arm {a.name!r} stands twice")
        seen.add(a.name)
        if a.available and a.error:
            raise ValueError(f"arm {a.name!r} is available and has an error")
        if not a.available and a.hits is not None and not a.hits.isEmpty():
            raise ValueError(f"arm {a.name!r} isn't available and has hits")
        if a.error:
            raise RuntimeError(f"arm {a.name!r} failed") from a.error


def _named(a: Arm) -> DataFrame:
    return a.hits.select("chunk_id", F.lit(a.name).alias("arm"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))


def _evidence():
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", F.struct("rank", "score"))))).alias("provenance")


@dataclass
class ReciprocalRank:
    """Sum of 1 / (k + rank + 1) over the arms; ties go to more arms, then the better best rank, then the smaller id. With
    ``keep_single``, a search in which one arm alone has hits keeps that arm's order and scores."""

    k: int = K
    keep_single: bool = False

    def fuse(self, arms: list[Arm], limit: int) -> DataFrame:
        """(chunk_id, score, provenance), best first; provenance has rank and score in each arm that found the chunk."""
        check_arms(arms)
        there = [a for a in arms if a.available and a.hits is not None]
        if limit <= 0 or not there:
            spark = next((a.hits.sparkSession for a in arms if a.hits is not None), None)
            if spark is None:
                from pyspark.sql import SparkSession

                spark = SparkSession.getActiveSession()
            return spark.createDataFrame([], FUSED)
        rows = reduce(DataFrame.unionByName, map(_named, there))
        if self.keep_single:
            full = [r[0] for r in rows.select("arm").distinct().limit(2).collect()]
            if len(full) == 1:
                return rows.orderBy("rank").limit(limit).select("chunk_id", "score", F.create_map("arm", F.struct("rank", F.col("score").alias("score"))).alias("provenance"))
        k = self.k if self.k > 0 else K
        sums = rows.groupBy("chunk_id").agg(
            F.aggregate(F.array_sort(F.collect_list("rank")), F.lit(0.0).cast("double"), lambda s, r: s + 1.0 / (k + r + 1)).alias("rrf"), F.count(F.lit(1)).alias("arms"), F.min("rank").alias("best"), _evidence()
        )
        return sums.orderBy(F.desc("rrf"), F.desc("arms"), "best", "chunk_id").limit(limit).select("chunk_id", F.col("rrf").alias("score"), "provenance")


def default_fusion() -> ReciprocalRank:
    return ReciprocalRank(K, True)


#: A reranker takes the fused candidates with payload and provenance as a DataFrame and returns them in a new order,
#: with a column ``position``; it sees the whole pool before the limit.
Reranker = Callable[[DataFrame], DataFrame]


def rerank(hits: DataFrame, reranker: Reranker | None, limit: int) -> DataFrame:
    """``hits`` have ``position``; the first ``limit`` by it, after the reranker."""
    if reranker is not None:
        try:
            hits = reranker(hits)
        except Exception as e:
            raise RuntimeError("the reranker failed") from e
    return hits.orderBy("position").limit(limit)
