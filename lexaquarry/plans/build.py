"""Building, updating and migrating indexes.

Each step writes its table into the folder of a new generation, reads it back, and goes on from there, so a lost executor
costs the running step alone. Nothing is visible until all tables are written and checked: then CURRENT is replaced.
One writer at a time; an update whose base was replaced meanwhile stops with ``StaleUpdatePlan``.

An update writes a segment of the added records and lists what it takes out of older segments; the rest of the index stays
where it is. Segments of about one size are merged when FAN_IN of them have come together, so a chunk is written again only
log times; ``compact`` merges all. What an update reads of the whole index are refs and hashes, for the fingerprint.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import vectors as V
from ..operators import chunking, embedding, fulltext, records as R, reuse
from ..sources import files
from ..sources.snapshot import Snapshot, current


FAN_IN = 8  #: segments of one size that are merged
FEW = 1000  #: refs up to which a lookup is a filter that the scan prunes row groups by


@dataclass
class BuildOptions:
    embedder: embedding.Embedder | None = None
    reuse_from: str | None = None
    contextualizer: embedding.Contextualizer | None = None
    policy: chunking.Policy | None = None
    max_tokens: int = 0
    overlap: int = 0
    max_sections: int = 0
    quantization: str | None = None
    max_planned_records: int = 0  #: of updates


@dataclass
class BuildResult:
    path: str
    records: int
    chunks: int
    reused: int
    embedded: int
    unchanged_records: int
    reuse_status: C.ReuseStatus
    reuse_reason: str
    content_fingerprint: str


@dataclass
class UpdateResult:
    path: str
    added: int
    removed: int
    records: int
    chunks: int
    reused: int
    embedded: int
    content_fingerprint: str


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class _Generation:
    """A new generation's folder while it is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"gen-{uuid.uuid4().hex[:12]}"
        self.base = f"{self.path}/{self.name}"

    def write(self, name: str, df: DataFrame, *sort: str) -> DataFrame:
        if sort:
            df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def write_records(self, records: DataFrame) -> DataFrame:
        """Raw records, normalized and in order of ref; each is normalized and hashed once."""
        return self.write("records", R.validated(R.in_order(records)).sortWithinPartitions("ref"))

    def write_manifest(self, manifest: dict) -> None:
        files.replace(self.spark, f"{self.base}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
        files.remove(self.spark, f"{self.base}/steps")

    def publish(self, manifest: dict, over: str | None = None) -> None:
        """Make this the current generation; with ``over``, only if that still is."""
        self.write_manifest(manifest)
        if over is not None and current(self.spark, self.path) != over:
            raise C.StaleUpdatePlan(f"{self.path} was replaced while its next generation was made")
        files.replace(self.spark, f"{self.path}/CURRENT", self.name)

    def drop(self) -> None:
        files.remove(self.spark, self.base)


def assign_ids(write: Callable[[str, DataFrame], DataFrame], sections: DataFrame, base: int) -> tuple[DataFrame, int]:
    """Sections with chunk_id in order of (ref, chunk_index), from base + 1 on, and the last id.

    Only one row a record is sorted; its place follows from counts of its range partition and of those before."""
    counts = sections.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("ref").withColumn("part", F.spark_partition_id())
    counts = write("steps/counts", counts)
    starts, at = [], base
    for part, n in sorted(counts.groupBy("part").agg(F.sum("n")).collect()):
        starts.append((part, at))
        at += n
    offsets = sections.sparkSession.createDataFrame(starts, "part int, start bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("ref").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.join(F.broadcast(offsets), "part").select("ref", (F.col("start") + before + 1).alias("first"))
    return sections.join(places, "ref").withColumn("chunk_id", F.col("first") + F.col("chunk_index")).withColumn("parent_chunk_id", F.when(F.col("parent_index") >= 0, F.col("first") + F.col("parent_index"))).drop("first"), at


CHUNK_COLUMNS = ("chunk_id", "ref", "kind", "title", "chunk_index", "heading", "content", "context_prefix", "parent_chunk_id", "is_parent")


def _of_refs(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of the given refs. Few refs become a filter, by which scans of tables in order of refs skip what they can."""
    few = [r[0] for r in refs.select("ref").limit(FEW + 1).collect()]
    return rows.filter(F.col("ref").isin(few)) if len(few) <= FEW else rows.join(refs.select("ref"), "ref", "left_semi")


def _old_vectors(old: Snapshot, refs: DataFrame) -> DataFrame:
    mode, _ = old.vector_setup()
    v = V.from_int8(F.col("embedding")) if mode == C.INT8 else F.col("embedding").cast("array<double>")
    chunks = _of_refs(old.chunks().select("chunk_id", "ref", "title", "heading", "content", "context_prefix"), refs)
    return chunks.join(_of_refs(old.table("vectors"), refs).select("chunk_id", v.alias("embedding")), "chunk_id")


def _plan(gen: _Generation, records: DataFrame, options: BuildOptions, old: Snapshot | None, mode: str, base: int):
    """Writes the new records' chunks and vectors; gives (chunks, vectors, plan, last id)."""
    policy = chunking.policy_of(options.policy, options.max_tokens, options.overlap, options.max_sections)
    embedder = options.embedder
    sections = gen.write("steps/sections", embedding.with_context(chunking.chunk(records, policy), records, options.contextualizer))
    numbered, last = assign_ids(gen.write, sections, base)
    chunks = gen.write("chunks", numbered.select(*CHUNK_COLUMNS), "ref", "chunk_index")
    wanted = chunks.filter("not is_parent")
    planned = gen.write("steps/planned", reuse.split(wanted, _old_vectors(old, records))) if old else reuse.split(wanted, None)
    old_records = _of_refs(old.table("records"), records) if old else None
    plan = reuse.summary(planned, records, old_records)
    text = embedding.embedding_text(*[F.col(c) for c in ("title", "heading", "content", "context_prefix")])
    misses = planned.filter("old_embedding is null").select("chunk_id", "kind", "ref", "chunk_index", text.alias("text"))
    documents = records.select("ref", embedding.document_text(F.col("title"), F.col("body_text")).alias("document"))
    vectors = embedding.embed(misses, embedder, documents, ("chunk_id", "kind")).select("chunk_id", "kind", "ref", "chunk_index", "embedding")
    if old:
        vectors = vectors.unionByName(planned.filter("old_embedding is not null").select("chunk_id", "kind", "ref", "chunk_index", F.col("old_embedding").alias("embedding")))
    dimension = embedder.dimension()
    right = F.when(F.size("embedding") != dimension, F.raise_error(F.lit(f"a vector's dimension isn't {dimension}"))).otherwise(F.col("embedding"))
    vectors = vectors.withColumn("embedding", right)
    stored = vectors.withColumn("embedding", V.quantized(F.col("embedding"), mode))
    if mode == C.BINARY:
        stored = stored.withColumn("bits", V.to_bits(F.col("embedding")))
    return chunks, gen.write("steps/vectors", stored), plan, last


def _index_text(chunks: DataFrame) -> DataFrame:
    return chunks.filter("not is_parent").select("chunk_id", "kind", "title", "heading", embedding.search_text(F.col("content"), F.col("context_prefix")).alias("text"))


def integrity_problems(records: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(problem, chunk_id) of chunks without record, vectors without chunk, searchable chunks without vector, parents with
    one, and parents in another record."""
    c = chunks.select("chunk_id", "ref", "is_parent", "parent_chunk_id")
    v = vectors.select("chunk_id")
    say = lambda df, what: df.select(F.lit(what).alias("problem"), "chunk_id")
    parent = c.select(F.col("chunk_id").alias("p"), F.col("ref").alias("p_ref"))
    return (
        say(c.join(records, "ref", "left_anti"), "chunk without record")
        .union(say(v.join(c, "chunk_id", "left_anti"), "vector without chunk"))
        .union(say(c.filter("not is_parent").join(v, "chunk_id", "left_anti"), "chunk without vector"))
        .union(say(c.filter("is_parent").join(v, "chunk_id", "left_semi"), "parent with a vector"))
        .union(say(c.filter("parent_chunk_id is not null").join(parent, F.col("parent_chunk_id") == F.col("p"), "left").filter("p is null or ref <> p_ref"), "parent in another record"))
    )


def _segment(gen: _Generation, chunks: DataFrame, vectors: DataFrame, records: DataFrame) -> tuple[int, int, int]:
    """Writes vectors and postings of a segment whose records and chunks are written, and checks all: (chunks, indexed chunks,
    indexed tokens)."""
    vectors = gen.write("vectors", vectors, "ref")
    indexed = chunks.filter("not is_parent").count()
    postings = gen.write("postings", fulltext.sorted_postings(_index_text(chunks), indexed))
    bad = integrity_problems(records, chunks, vectors).head()
    if bad:
        raise C.IntegrityError(f"{bad[0]}: chunk {bad[1]}")
    return chunks.count(), indexed, int(postings.agg(F.sum("tf")).first()[0] or 0)


def _finish(gen: _Generation, records: DataFrame, chunks: DataFrame, vectors: DataFrame, manifest: dict) -> dict:
    """The manifest of a generation of one segment."""
    n, indexed, tokens = _segment(gen, chunks, vectors, records)
    manifest = {k: v for k, v in manifest.items() if k not in ("segments", "dead")}
    return manifest | {"records": records.count(), "chunks": n, "indexed_chunks": indexed, "indexed_tokens": tokens, "content_fingerprint": R.fingerprint(records).first()[0]}


def rebuild(spark: SparkSession, path: str, records: DataFrame, options: BuildOptions) -> BuildResult:
    """A new index of all the records. The old one at the path stays readable until the new one replaces it."""
    if not path.strip():
        raise ValueError("an index needs a path")
    if options.embedder is None:
        raise ValueError("an index needs an embedder")
    chunking.policy_of(options.policy, options.max_tokens, options.overlap, options.max_sections)
    mode, dimension = C.quantization(options.quantization), options.embedder.dimension()
    V.check_dimension(mode, dimension)
    old, status, reason = None, C.ReuseStatus.DISABLED, ""
    if options.reuse_from:
        try:
            old = Snapshot(spark, options.reuse_from)
            status, reason = reuse.compatibility(old.manifest, options.embedder.fingerprint, dimension, mode)
        except C.MissingIndex as e:
            status, reason = C.ReuseStatus.UNAVAILABLE, str(e)
        except Exception as e:  # noqa: BLE001 — reuse is an economy: what can't be read is embedded anew
            status, reason = C.ReuseStatus.ERROR, str(e)
        if status != C.ReuseStatus.ACTIVE:
            old = None
    gen = _Generation(spark, path)
    try:
        rows = gen.write_records(records)
        R.require_distinct(rows)
        chunks, vectors, plan, last = _plan(gen, rows, options, old, mode, 0)
        manifest = {"schema_version": C.SCHEMA_VERSION, "embedder_fingerprint": options.embedder.fingerprint, "embedder_dimension": dimension, "quantization": mode, "created_at": _now(), "last_chunk_id": last}
        manifest = _finish(gen, rows, chunks, vectors, manifest)
        gen.publish(manifest)
    except BaseException:
        gen.drop()
        raise
    return BuildResult(path, manifest["records"], manifest["chunks"], plan.reused, plan.embedded, plan.unchanged_records, status, reason, manifest["content_fingerprint"])


def update(spark: SparkSession, path: str, added: DataFrame | None, removed, options: BuildOptions) -> UpdateResult:
    """Adds or replaces records and removes others. Vectors of unchanged chunks are reused; ids of removed chunks are never
    given again. The result is that of a rebuild with the final records, but for ids and times."""
    chunking.policy_of(options.policy, options.max_tokens, options.overlap, options.max_sections)
    old = Snapshot(spark, path)
    mode, dimension = old.vector_setup()
    if options.quantization is not None and options.quantization.strip() and C.quantization(options.quantization) != mode:
        raise ValueError(f"the index keeps {mode} vectors, not {options.quantization}")
    if options.embedder is not None and (options.embedder.fingerprint.strip() != str(old.manifest["embedder_fingerprint"]).strip() or options.embedder.dimension() != dimension):
        raise ValueError("the index was made by another embedder")
    was = old.generation
    gen, newest = _Generation(spark, path), None
    try:
        gone = gen.write("steps/removed", R.removed_refs(spark, removed))
        new = None
        if added is not None and not added.isEmpty():
            if options.embedder is None:
                raise ValueError("adding records needs an embedder")
            new = gen.write_records(added)
            R.require_distinct(new, "added")
            R.require_disjoint(new, gone)
            R.require_planned(new, options.max_planned_records)
        if old.manifest["schema_version"] != C.SCHEMA_VERSION:
            newest = _newest(old)
            old = Snapshot(spark, path, newest.name)
        elif merge := _due(old):
            newest = _merged(old, merge)
            old = Snapshot(spark, path, newest.name)
        changed = gone if new is None else gone.union(new.select("ref"))
        seq = max(x["seq"] for x in old.segments) + 1
        lost = gen.write("dead_refs", _of_refs(old.table("records"), changed).select("ref", F.lit(seq).cast("bigint").alias("seq")))
        text = gen.write("steps/lost", _of_refs(_with_parent_mark(old.chunks()), changed))
        gen.write("dead_chunks", text.select("chunk_id"))
        lost_records, lost_chunks, removed_count = lost.count(), text.count(), lost.join(gone, "ref", "left_semi").count()
        lost_indexed, lost_tokens = fulltext.index_size(_index_text(text))
        m, last, plan, n = old.manifest, old.manifest["last_chunk_id"], reuse.Plan(0, 0, 0), 0
        size, indexed, tokens = 0, 0, 0
        if new is not None:
            more, vectors, plan, last = _plan(gen, new, options, old, mode, last)
            n, (size, indexed, tokens) = new.count(), _segment(gen, more, vectors, new)
        pairs = old.table("records").select("ref", "content_hash").join(lost.select("ref"), "ref", "left_anti")
        segments = old.segments + ([{"name": gen.name, "seq": seq, "chunks": size}] if new is not None else [])
        manifest = m | {
            "schema_version": C.SCHEMA_VERSION, "last_chunk_id": last, "updated_at": _now(), "segments": segments, "dead": old.dead + ([gen.name] if lost_records else []),
            "records": m["records"] - lost_records + n, "chunks": m["chunks"] - lost_chunks + size, "indexed_chunks": m["indexed_chunks"] - lost_indexed + indexed, "indexed_tokens": m["indexed_tokens"] - lost_tokens + tokens,
            "content_fingerprint": R.fingerprint(pairs if new is None else pairs.unionByName(new.select("ref", "content_hash"))).first()[0],
        }
        gen.publish(manifest, was)
    except BaseException:
        gen.drop()
        if newest is not None:
            newest.drop()
        raise
    return UpdateResult(path, n, removed_count, manifest["records"], manifest["chunks"], plan.reused, plan.embedded, manifest["content_fingerprint"])


def _with_parent_mark(chunks: DataFrame) -> DataFrame:
    return chunks if "is_parent" in chunks.columns else chunks.withColumn("is_parent", F.lit(False))


def _due(old: Snapshot) -> list[dict] | None:
    """Segments of one size, by powers of FAN_IN, that are to be merged."""
    tiers: dict[int, list[dict]] = {}
    for x in old.segments:
        tiers.setdefault(max(0, int(math.log(max(1, x["chunks"]), FAN_IN))), []).append(x)
    return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN_IN), None)


def _merged(old: Snapshot, segments: list[dict]) -> _Generation:
    """A generation, not yet published, in which one segment has the live rows of the given ones."""
    gen = _Generation(old.spark, old.path)
    try:
        gen.write("records", old.live("records", segments), "ref")
        chunks = gen.write("chunks", old.live("chunks", segments), "ref", "chunk_index")
        gen.write("vectors", old.live("vectors", segments), "ref")
        gen.write("postings", old.live("postings", segments), "term", "chunk_id")
        rest = [x for x in old.segments if x not in segments]
        dead = []
        if rest and old.dead:
            # what was taken out of the merged segments is gone for good
            inside = reduce(DataFrame.union, [old.spark.read.parquet(f"{old.path}/{x['name']}/chunks").select("chunk_id") for x in segments])
            gen.write("dead_chunks", old.dead_table("dead_chunks").join(inside, "chunk_id", "left_anti"))
            gen.write("dead_refs", old.dead_table("dead_refs").groupBy("ref").agg(F.max("seq").alias("seq")))
            dead = [gen.name]
        one = {"name": gen.name, "seq": max(x["seq"] for x in segments), "chunks": chunks.count()}
        gen.write_manifest(old.manifest | {"segments": [*rest, one], "dead": dead})
    except BaseException:
        gen.drop()
        raise
    return gen


def compact(spark: SparkSession, path: str) -> bool:
    """Merges all segments of an index into one, as a new generation; False where there is nothing to merge."""
    old = Snapshot(spark, path)
    if len(old.segments) == 1 and not old.dead:
        return False
    gen = _merged(old, old.segments)
    try:
        gen.publish(files.read_json(spark, f"{gen.base}/manifest.json"), old.generation)
    except BaseException:
        gen.drop()
        raise
    return True


def _newest(old: Snapshot) -> _Generation:
    """A generation, not yet published, of the newest version: columns that the old one lacks get their defaults and, before
    version 4, records their present hash."""
    gen = _Generation(old.spark, old.path)
    try:
        records = old.table("records")
        if old.manifest["schema_version"] < 4:
            records = records.withColumn("content_hash", R.content_hash())
        rows = gen.write("records", records, "ref")
        chunks = gen.write("chunks", _with_parent_mark(old.chunks()).select(*CHUNK_COLUMNS), "ref", "chunk_index")
        last = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
        gen.write_manifest(_finish(gen, rows, chunks, old.table("vectors"), {"last_chunk_id": last} | old.manifest | {"schema_version": C.SCHEMA_VERSION, "updated_at": _now()}))
    except BaseException:
        gen.drop()
        raise
    return gen


def migrate(spark: SparkSession, path: str) -> int:
    """Brings an index of an older version to the newest, as a new generation. Gives the version it had."""
    old = Snapshot(spark, path)
    version = old.manifest["schema_version"]
    if version == C.SCHEMA_VERSION:
        return version
    gen = _newest(old)
    try:
        gen.publish(files.read_json(spark, f"{gen.base}/manifest.json"), old.generation)
    except BaseException:
        gen.drop()
        raise
    return version


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes generations that the current one doesn't need; readers that still have one open lose it."""
    now = Snapshot(spark, path)
    needed = {now.generation, *(x["name"] for x in now.segments), *now.dead}
    gone = [x for x in files.names(spark, path) if x.startswith("gen-") and x not in needed]
    for x in gone:
        files.remove(spark, f"{path}/{x}")
    return gone
