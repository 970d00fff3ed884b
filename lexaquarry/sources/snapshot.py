"""Immutable indexes in a folder: generations, each with a manifest, and a file that names the current one.

    CURRENT                       name of the generation that readers open
    gen-.../manifest.json         versions, embedder, counts, fingerprint, times, segments
    gen-.../records chunks vectors postings     Parquet: a segment
    gen-.../dead_refs dead_chunks               what the generation took out of the segments before it

A rebuild makes a generation of one segment. An update adds a segment of the new records alone, and names what it takes out
of older ones, so what it writes depends on the change and not on the index. The manifest lists the generations whose
segments make up the index. A reader opens one generation and keeps reading it while later ones are published.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import context, fulltext, fusion, search
from ..operators.records import pick
from . import files

TABLES = ("records", "chunks", "vectors", "postings")


@dataclass(frozen=True)
class Stats:
    records: int
    chunks: int
    kinds: dict[str, int]
    schema_version: int
    embedder_dimension: int
    embedder_fingerprint: str
    content_fingerprint: str
    created_at: str


def current(spark: SparkSession, path: str) -> str:
    if not files.exists(spark, path):
        raise C.MissingIndex(path)
    if not files.exists(spark, f"{path}/CURRENT"):
        raise C.MissingIndex(path) if files.is_dir(spark, path) else ValueError(f"{path} is no folder")
    return files.read(spark, f"{path}/CURRENT").strip()


class Snapshot:
    """One generation of an index. What is wrong with the vectors' description is told by searches, not by opening: records
    and sections of such an index can still be read."""

    def __init__(self, spark: SparkSession, path: str, generation: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.generation = generation or current(spark, self.path)
        self.base = f"{self.path}/{self.generation}"
        self.manifest = files.read_json(spark, f"{self.base}/manifest.json")
        if self.manifest.get("schema_version") not in C.SCHEMA_VERSIONS:
            raise C.UnsupportedSchemaVersion(f"schema version {self.manifest.get('schema_version')!r} of {path}")
        self.segments: list[dict] = self.manifest.get("segments") or [{"name": self.generation, "seq": 0, "chunks": self.manifest.get("chunks", 0)}]
        self.dead: list[str] = self.manifest.get("dead", [])
        self._tables: dict[str, DataFrame] = {}
        have = set(self.table("chunks").columns)
        for column, since in (("context_prefix", 3), ("parent_chunk_id", 5)):
            if (column in have) != (self.manifest["schema_version"] >= since):
                raise C.UnsupportedSchemaVersion(f"column {column} and schema version {self.manifest['schema_version']} don't agree")

    def __enter__(self) -> "Snapshot":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._tables.clear()

    def has(self, name: str) -> bool:
        return all(files.exists(self.spark, f"{self.path}/{x['name']}/{name}") for x in self.segments)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.live(name, self.segments)
        return self._tables[name]

    def dead_table(self, name: str) -> DataFrame:
        """``dead_refs`` (ref, seq: older segments' records of this ref are dead) or ``dead_chunks`` (chunk_id; ids are never
        given again)."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{x}/{name}") for x in self.dead])

    def live(self, name: str, segments: list[dict]) -> DataFrame:
        """The rows of some segments that no later generation took out."""
        one = lambda x: self.spark.read.parquet(f"{self.path}/{x['name']}/{name}")
        if not self.dead:
            return reduce(DataFrame.unionByName, map(one, segments))
        if name != "records":
            return reduce(DataFrame.unionByName, map(one, segments)).join(self.dead_table("dead_chunks"), "chunk_id", "left_anti")
        rows = reduce(DataFrame.unionByName, [one(x).withColumn("__seq", F.lit(x["seq"]).cast("bigint")) for x in segments])
        dead = self.dead_table("dead_refs").groupBy(F.col("ref").alias("__ref")).agg(F.max("seq").alias("__dead"))
        return rows.join(dead, (F.col("ref") == F.col("__ref")) & (F.col("__seq") < F.col("__dead")), "left_anti").drop("__seq")

    def chunks(self) -> DataFrame:
        """With the columns of the newest version, whatever the index has."""
        t = self.table("chunks")
        if "context_prefix" not in t.columns:
            t = t.withColumn("context_prefix", F.lit(""))
        if "parent_chunk_id" not in t.columns:
            t = t.withColumn("parent_chunk_id", F.lit(None).cast("bigint"))
        return t

    def vector_setup(self) -> tuple[str, int]:
        """(quantization, dimension), or the error that reading them gives."""
        dimension = self.manifest.get("embedder_dimension")
        if not isinstance(dimension, int) or dimension <= 0:
            raise ValueError(f"the index names no usable dimension: {dimension!r}")
        return C.quantization(self.manifest.get("quantization")), dimension

    def stats(self) -> Stats:
        records = self.table("records")
        kinds = {r[0]: r[1] for r in records.groupBy("kind").count().collect()}
        m = self.manifest
        return Stats(sum(kinds.values()), self.table("chunks").count(), kinds, m["schema_version"], m.get("embedder_dimension", 0), m.get("embedder_fingerprint", ""), m.get("content_fingerprint", ""), m.get("created_at", ""))

    def records(self, refs=None, kinds=None) -> DataFrame:
        return pick(self.table("records"), refs, kinds).orderBy("ref")

    def sections(self, refs=None, kinds=None, embeddings: bool = False) -> DataFrame:
        """Chunks with their record's fields in order of ref and place. With embeddings, only chunks that have one."""
        fields = pick(self.table("records"), refs, kinds).select("ref", "kind", "title", "source_ref", "metadata")
        rows = pick(self.chunks().drop("kind", "title"), refs).join(fields, "ref")
        columns = ["chunk_id", "ref", "kind", "title", "source_ref", "heading", "content", "context_prefix", "metadata", "chunk_index"]
        if embeddings:
            mode, _ = self.vector_setup()
            from ..functions.vectors import from_int8

            v = F.col("embedding") if mode != C.INT8 else from_int8(F.col("embedding"))
            rows = rows.join(self.table("vectors").select("chunk_id", v.cast("array<double>").alias("embedding")), "chunk_id")
            columns.append("embedding")
        return rows.select(*columns).orderBy("ref", "chunk_index", "chunk_id")

    def _payload(self, hits: DataFrame, keep: list[str]) -> DataFrame:
        """Payload of the hits of a search, 250 at most. Their ids, then their refs, become filters of the scans: both tables
        are sorted by them, so a few row groups are read, whatever the size of the index."""
        rows = hits.collect()
        few = self.spark.createDataFrame(rows, hits.schema)
        found = self.chunks().select("chunk_id", "ref", "heading", "content").filter(F.col("chunk_id").isin([r.chunk_id for r in rows]))
        refs = [r.ref for r in found.select("ref").distinct().collect()]
        records = self.table("records").select("ref", "kind", "title", "source_ref", "metadata").filter(F.col("ref").isin(refs))
        out = found.join(F.broadcast(few), "chunk_id").join(F.broadcast(records), "ref")  # at most the pool of a search
        return out.select("chunk_id", "ref", "kind", "title", "source_ref", "heading", "content", "metadata", *keep)

    def _vector_hits(self, vector: list[float], k: int, kinds, dimension: int = 0) -> DataFrame:
        mode, stored = self.vector_setup()
        if len(vector) != stored:
            raise ValueError(f"the query has dimension {len(vector)}, the index {stored}")
        return search.nearest(self.table("vectors"), vector, k, kinds, mode, dimension)

    def _text_hits(self, text: str, k: int, kinds) -> DataFrame:
        size = (self.manifest["indexed_chunks"], self.manifest["indexed_tokens"])
        return fusion.ranked(fulltext.search(self.table("postings"), text, size, k, kinds), F.desc("score"), "chunk_id")

    def _arm(self, name: str, hits: DataFrame) -> fusion.Arm:
        """An arm whose search has run: its errors show here, and later steps don't repeat it. Hits are a pool's, 250 at most."""
        return fusion.Arm(name, self.spark.createDataFrame(hits.collect(), hits.schema))

    def search_vector(self, vector: list[float], limit: int = 0, kinds=None, dimension: int = 0) -> DataFrame:
        """Hits by vector alone, best first, without provenance."""
        limit = C.search_limit(limit)
        pool = self._vector_hits(vector, C.pool_size(limit), kinds, dimension)
        hits = fusion.ranked(pool, "distance", "ref", "chunk_index", "chunk_id").filter(F.col("rank") < limit)
        return self._payload(hits, ["score", "rank"]).orderBy("rank").drop("rank")

    def search(self, text: str, embedder, limit: int = 0, kinds=None, fusion_strategy=None, reranker=None, dimension: int = 0) -> DataFrame:
        """Hits (chunk_id, ref, kind, title, source_ref, heading, content, metadata, score, provenance) by vector and text
        together, best first."""
        text = text.strip()
        if not text:
            raise ValueError("a search needs a text")
        if embedder is None:
            raise ValueError("a search needs an embedder")
        limit = C.search_limit(limit)
        if embedder.fingerprint.strip() != str(self.manifest.get("embedder_fingerprint", "")).strip():
            raise ValueError(f"the index was made by {self.manifest.get('embedder_fingerprint')!r}, not {embedder.fingerprint!r}")
        vectors = embedder.queries([text])
        if len(vectors) != 1:
            raise ValueError(f"the embedder gave {len(vectors)} vectors for one query")
        pool = C.pool_size(limit)
        # a vector arm that fails ends the search; a text arm that fails is for the strategy to judge
        arms = [self._arm(C.VECTOR_ARM, fusion.ranked(self._vector_hits(vectors[0], pool, kinds, dimension), "distance", "ref", "chunk_index", "chunk_id"))]
        try:
            arms.append(self._arm(C.TEXT_ARM, self._text_hits(text, pool, kinds)) if self.has("postings") else fusion.Arm(C.TEXT_ARM, available=False))
        except Exception as e:  # noqa: BLE001
            arms.append(fusion.Arm(C.TEXT_ARM, available=False, error=e))
        fused = (fusion_strategy or fusion.default_fusion()).fuse(arms, pool)
        placed = fused.coalesce(1).withColumn("position", F.monotonically_increasing_id())
        hits = self._payload(placed, ["score", "provenance", "position"])
        return fusion.rerank(hits, reranker, limit).drop("position")

    def expand_context(self, chunk_ids, include_parent: bool = False, window: int = 0) -> DataFrame:
        """Surroundings of one chunk, a list of them, or a DataFrame with column chunk_id (see ``context.expand``)."""
        chunks = self.chunks().drop("kind", "title")
        fields = self.table("records").select("ref", "kind", "title", "source_ref", "metadata")
        if not isinstance(chunk_ids, DataFrame):
            ids = [chunk_ids] if isinstance(chunk_ids, int) else list(chunk_ids)
            chunk_ids = self.spark.createDataFrame([(i,) for i in ids], "chunk_id bigint")
            near = F.col("ref").isin([r.ref for r in chunks.filter(F.col("chunk_id").isin(ids)).select("ref").distinct().collect()])
            chunks, fields = chunks.filter(near), fields.filter(near)
        rows = context.expand(chunks, chunk_ids, include_parent, window)
        return rows.join(fields, "ref").orderBy("hit_id", "position")


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    return Snapshot(spark, path)


def read_stats(spark: SparkSession, path: str) -> Stats:
    with Snapshot(spark, path) as s:
        return s.stats()


def search_index(spark: SparkSession, path: str, text: str, embedder, **options) -> DataFrame:
    return Snapshot(spark, path).search(text, embedder, **options)
