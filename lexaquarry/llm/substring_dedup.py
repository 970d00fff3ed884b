"""Substring dedup with a log-structured fingerprint index.

A repeat is a run of at least PASSAGE words (white-space separated, compared as they are) that an earlier document has
too. Earlier is: in an earlier batch, or in the same batch under a smaller doc_id.

The index holds hashes of GRAM-word windows picked by winnowing: in every run of PASSAGE words the least hash of its
windows is picked, by content alone, so two copies of a passage always share a fingerprint (7 % of all windows are
kept). Each batch becomes one immutable run, bucketed and sorted by hash; new batches are merge-joined with the runs,
bucket by bucket, without shuffling the history. Hits are verified on the texts themselves: around each hit all
PASSAGE-word windows are compared by 96 further bits of hash, which gives exact spans and sources. When a level has
FAN_IN runs, they are compacted into one of the next level, so a fingerprint is rewritten only log times.

Windows travel as blocks of bytes by parts of their hash, as many parts as the number of hits asks for, and a task takes
its parts one after the other. Windows that contain a fingerprint of more than HOT documents travel as rows instead: their
first places are aggregated before the shuffle, and the join with them is one that adaptive execution splits where it is
skewed, so a passage that a third of all documents have is no task's burden.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import Words, flat, grams, runs_of, slices, white_words
from ._shared import drop_path, fresh, lean, materialize, new_path, partitions, release, table

PASSAGE = 50
GRAM = 25
FAN_IN = 4
FLUSH = 1 << 20
POSITION_BITS = 24
PART_WINDOWS = 1 << 19  #: windows of a part, all of them in memory of its task (25 bytes each)
PARTS_A_TASK = 8
HOT = 1 << 16  #: documents of a fingerprint above which its windows travel as rows
HOT_BITS = 20  #: bits of the bitmap of hot fingerprints, as a power of two; what it takes for hot besides is only slower
RUN_SCHEMA = "h bigint, doc_id bigint, pos int"


def picked(w: Words, gram: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the picked windows: of each run of passage words the least, of equals the last."""
    g = grams(w.hash, gram)
    row = w.rows()
    span = passage - gram + 1
    if len(row) < passage:
        return np.zeros(0, np.int64), g[:0]
    mask = np.uint64((1 << POSITION_BITS) - 1)
    index = np.arange(len(g), dtype=np.uint64)
    key = (g & ~mask) | (mask - (index & mask))
    size = 1
    while 2 * size <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if span > size:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    runs = np.flatnonzero(row[: len(key)] == row[passage - 1 : passage - 1 + len(key)])
    at = runs + ((mask - (key[runs] & mask) - runs.astype(np.uint64)) & mask).astype(np.int64)
    at = np.unique(at)
    return at, g[at]


def _fingerprints(batches: Iterator[pa.RecordBatch], gram: int, passage: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = white_words(part.column("text"))
            at, h = picked(w, gram, passage)
            row = w.rows()[at]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array((at - w.row[row]).astype(np.int32))], names=["h", "doc_id", "pos"])


def _blocks(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row a part, the columns as bytes."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [x[order] for x in columns]
    ids, first = np.unique(part, return_index=True)
    ends = [*first[1:], len(part)]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32))] + [pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in columns], names=["part", *names])


WINDOW_TYPES = (("h", np.uint64), ("g", np.uint32), ("doc", np.int64), ("pos", np.int32), ("new", np.uint8))
WINDOW_BLOCKS = "part int, h binary, g binary, doc binary, pos binary, new binary"
WINDOW_ROWS = "h bigint, g bigint, doc_id bigint, pos int, new int"


def hot_windows(w: Words, gram: int, passage: int, hot: np.ndarray) -> np.ndarray:
    """Whether the least fingerprint in each passage-word window is in the bitmap; a matter of the window's words alone."""
    g = grams(w.hash, gram) >> np.uint64(POSITION_BITS)
    size, span = 1, passage - gram + 1
    while 2 * size <= span:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    if span > size:
        g = np.minimum(g[: len(g) - (span - size)], g[span - size :])
    return hot[(g & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)]


def _windows(batches: Iterator[pa.RecordBatch], gram: int, passage: int, parts: int, hot, rows: bool = False) -> Iterator[pa.RecordBatch]:
    """All passage-word windows that contain a hit: those that aren't hot in blocks by hash or, with ``rows``, the hot ones
    as rows."""
    kept: list[list[np.ndarray]] = []
    held = 0
    marked = None
    if hot is not None:
        marked = np.zeros(1 << HOT_BITS, bool)
        marked[hot.value] = True

    def send() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*kept)]
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (columns[0].view(np.int64), columns[1].astype(np.int64), columns[2], columns[3], columns[4].astype(np.int32))], names=[x.split()[0] for x in WINDOW_ROWS.split(", ")])
        return _blocks((columns[0] % np.uint64(parts)).astype(np.int64), columns, [x for x, _ in WINDOW_TYPES])

    for batch in batches:
        for part in slices(batch, "text"):
            w = white_words(part.column("text"))
            h, g = grams(w.hash, passage, 0xC2B2AE3D27D4EB4F), grams(w.hash, passage, 0x165667B19E3779F9)
            near = np.zeros(len(w.hash) + 1, np.int64)
            hits = part.column("hits")
            count = np.diff(np.asarray(hits.offsets))
            where = w.row[np.repeat(np.arange(part.num_rows), count)] + np.asarray(hits.flatten()).astype(np.int64)
            row = w.rows()
            where = where[where < len(w.hash)]
            np.add.at(near, np.maximum(where - (passage - gram), w.row[row[where]] if len(where) else 0), 1)
            np.add.at(near, where + 1, -1)
            ok = np.cumsum(near)[: len(h)] > 0
            ok &= row[: len(h)] == row[passage - 1 :] if len(h) else ok
            if marked is not None and len(h):
                ok &= hot_windows(w, gram, passage, marked) == rows
            at = np.flatnonzero(ok)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            new = part.column("new").to_numpy(zero_copy_only=False)
            kept.append([h[at], (g[at] >> np.uint64(32)).astype(np.uint32), ids[row[at]], (at - w.row[row[at]]).astype(np.int32), new[row[at]].astype(np.uint8)])
            held += len(at)
            if held >= FLUSH:
                yield send()
                kept, held = [], 0
    if held:
        yield send()


REPEAT_TYPES = (("doc", np.int64), ("pos", np.int32), ("source", np.int64), ("source_pos", np.int32))
REPEAT_BLOCKS = "part int, doc binary, pos binary, source binary, source_pos binary"


def _repeats(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Windows of new documents that an earlier document has, with the earliest place, in blocks by document."""
    for run in runs_of(batches, "part"):
        h, g, doc, pos, new = flat(run, WINDOW_TYPES)
        order = np.lexsort((pos, doc, new, g, h))
        h, g, doc, pos, new = h[order], g[order], doc[order], pos[order], new[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        source = np.flatnonzero(first)[np.cumsum(first) - 1]
        at = np.flatnonzero((new == 1) & ((doc != doc[source]) | (new != new[source])))
        if len(at):
            src = source[at]
            by = np.lexsort((pos[at], doc[at]))
            at, src = at[by], src[by]
            yield _blocks(doc[at] % parts, [doc[at], pos[at], doc[src], pos[src]], [x for x, _ in REPEAT_TYPES])


def _repeat_blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, pos, source, source_pos) in blocks by document."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(x).to_numpy().astype(kind) for x, kind in REPEAT_TYPES]
            yield _blocks(columns[0] % parts, columns, [x for x, _ in REPEAT_TYPES])


SPANS = "doc_id bigint, start_word bigint, end_word bigint, source_doc_id bigint, source_word bigint"


def _spans(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, "part"):
        doc, pos, source, place = flat(run, REPEAT_TYPES)
        order = np.lexsort((place, source, pos, doc))
        doc, pos, source, place = doc[order], pos[order].astype(np.int64), source[order], place[order].astype(np.int64)
        new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1])]
        doc, pos, source, place = doc[new], pos[new], source[new], place[new]
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)])
        tail = np.r_[head[1:], len(doc)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[head], pos[head], pos[tail] + passage, source[head], place[head])], names=[x.split()[0] for x in SPANS.split(", ")])


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in one folder; ``path`` reopens an index that another session wrote.

    One writer at a time. A run appears under its final name only when its files are complete (the table's committer
    renames), so a lost executor or driver leaves no half run behind that a reader would take for one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, passage: int = PASSAGE, gram: int = GRAM, buckets: int | None = None, fan_in: int = FAN_IN, hot: int = HOT):
        if not 0 < gram <= passage:
            raise ValueError("gram must be in [1, passage]")
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark, self.path = spark, path or new_path(spark, "fingerprints")
        self.passage, self.gram, self.fan_in, self.hot = passage, gram, fan_in, hot
        self.buckets = buckets or partitions(spark)
        self.runs: list[tuple[int, str, str]] = []  # level, folder, table
        self.count = 0
        if path:
            self._reopen()

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _reopen(self) -> None:
        fs, p = self._fs()
        if not fs.exists(p):
            return
        found = []
        for x in fs.listStatus(p):
            name = x.getPath().getName()
            if name.startswith("run-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")):
                _, seq, level, buckets = name.split("-")
                found.append((int(seq), int(level), int(buckets), name))
        for seq, level, buckets, name in sorted(found):
            self.buckets = buckets
            self.count = max(self.count, seq + 1)
            t = self._table()
            self.spark.sql(f"CREATE TABLE {t} (h BIGINT, doc_id BIGINT, pos INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.runs.append((level, name, t))

    def _table(self) -> str:
        return f"fingerprints_{id(self):x}_{new_path(self.spark, 't').rsplit('-', 1)[1]}"

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
        return docs.mapInArrow(lean(_fingerprints, gram=self.gram, passage=self.passage), RUN_SCHEMA)

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str, str]:
        name, t = f"run-{self.count}-{level}-{self.buckets}", self._table()
        self.count += 1
        rows.repartition(self.buckets, "h").write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(t)
        return level, name, t

    def _drop(self, run: tuple[int, str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[2]}")
        drop_path(self.spark, f"{self.path}/{run[1]}")

    def _compact(self) -> None:
        level = 0
        while level <= max((x[0] for x in self.runs), default=-1):
            same = [x for x in self.runs if x[0] == level]
            if len(same) >= self.fan_in:
                merged = self._write(reduce(DataFrame.union, (self.spark.table(x[2]) for x in same)).distinct(), level + 1)
                self.runs = [x for x in self.runs if x[0] != level] + [merged]
                for x in same:
                    self._drop(x)
            level += 1

    def add(self, docs: DataFrame, history: DataFrame | None = None, keep: bool = True) -> DataFrame:
        """The batch's repeats of the history and of itself (see ``repeated_spans``); with keep, the batch joins the index.
        ``history`` has the texts of the documents added before, from which hits are verified."""
        pick = lambda d, new: d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(new).alias("new")).filter("doc_id is not null and text is not null")
        run = self._write(self.fingerprints(docs), 0)
        try:
            spans = self._repeats_of(run, pick(docs, 1), None if history is None or not self.runs else pick(history, 0), history is not None)
        except BaseException:
            self._drop(run)
            raise
        if keep:
            self.runs.append(run)
            self._compact()
        else:
            self._drop(run)
        return spans

    def _repeats_of(self, run: tuple[int, str, str], texts: DataFrame, earlier: DataFrame | None, verify: bool) -> DataFrame:
        fresh = self.spark.table(run[2])
        inside = fresh.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h")
        hits = [fresh.join(inside, "h", "left_semi").select("doc_id", "pos", F.lit(1).alias("new"))]
        for _, _, t in self.runs:
            old = self.spark.table(t)
            hits.append(fresh.join(old, "h", "left_semi").select("doc_id", "pos", F.lit(1)))
            if verify:
                hits.append(old.join(fresh, "h", "left_semi").select("doc_id", "pos", F.lit(0)))
        places = materialize(reduce(DataFrame.union, hits).groupBy("doc_id", "new").agg(F.collect_set("pos").alias("hits")), "hits")
        # a hit is in at most so many windows, and neighbours share half of them
        windows = (places.agg(F.sum(F.size("hits"))).first()[0] or 0) * (self.passage - self.gram + 1) // 2
        parts = max(partitions(self.spark), -(-int(windows) // PART_WINDOWS))
        tasks = max(partitions(self.spark), -(-parts // PARTS_A_TASK))
        # counts need no shuffle, as runs are bucketed by hash
        bit = F.shiftrightunsigned("h", POSITION_BITS).bitwiseAND(F.lit((1 << HOT_BITS) - 1)).alias("bit")
        counts = [self.spark.table(t).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.hot).select(bit) for t in (run[2], *(x[2] for x in self.runs))]
        bits = [r.bit for r in reduce(DataFrame.union, counts).distinct().collect()]  # 2 ** HOT_BITS at most
        hot = self.spark.sparkContext.broadcast(np.array(bits, np.int64)) if bits else None
        rows = (texts if earlier is None else texts.unionByName(earlier)).join(places, ["doc_id", "new"]).select("doc_id", "text", "new", "hits")
        options = {"gram": self.gram, "passage": self.passage, "parts": parts, "hot": hot}
        blocks = rows.mapInArrow(lean(_windows, **options), WINDOW_BLOCKS)
        repeats = blocks.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(lean(_repeats, parts=parts), REPEAT_BLOCKS)
        if hot is not None:
            many = rows.mapInArrow(lean(_windows, **options, rows=True), WINDOW_ROWS)
            first = many.groupBy("h", "g").agg(F.min(F.struct("new", "doc_id", "pos")).alias("first"))
            again = many.join(first, ["h", "g"]).filter("new = 1 and (doc_id <> first.doc_id or new <> first.new)")
            again = again.select(F.col("doc_id").alias("doc"), "pos", F.col("first.doc_id").alias("source"), F.col("first.pos").alias("source_pos"))
            repeats = repeats.unionByName(again.mapInArrow(lean(_repeat_blocks, parts=parts), REPEAT_BLOCKS))
        spans = materialize(repeats.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(lean(_spans, passage=self.passage), SPANS), "spans")
        release(places)
        return spans

    def close(self) -> None:
        """Remove the index and its tables."""
        for x in self.runs:
            self._drop(x)
        self.runs = []
        drop_path(self.spark, self.path)


def repeated_spans(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, batches: int = 2, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_word): words [start_word, end_word) of the document, at least
    ``passage`` of them, stand from source_word on in the document of the smallest doc_id that has them. Spans are as long
    as they can be with one source; spans of different sources may overlap.

    Documents enter the index in ``batches`` of ascending doc_id; their number changes the work, not the result. Rows
    with a null doc_id or text take no part; rows that repeat a document count once, and what only repeats within one
    doc_id is no repeat. If one doc_id has several texts, spans of all of them are reported. Texts of fewer than
    ``passage`` words have no spans. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return spark.createDataFrame([], SPANS)
    index = FingerprintIndex(spark, passage=passage, gram=gram, hot=hot)
    cuts = sorted({low + (high + 1 - low) * i // batches for i in range(1, batches)} - {low})
    found = []
    try:
        for a, b in zip([None, *cuts], [*cuts, None]):
            part = docs.filter(" and ".join([f"doc_id >= {a}"] * (a is not None) + [f"doc_id < {b}"] * (b is not None)) or "true")
            found.append(index.add(part, docs.filter(f"doc_id < {a}") if a is not None else None, keep=b is not None))
    finally:
        index.close()
    return reduce(DataFrame.union, found)


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], spans_name: str) -> Iterator[pa.RecordBatch]:
    """Texts without their spans: from the first repeated word up to the next kept one."""
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column(spans_name)
        gone = np.zeros(len(texts), bool)
        for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
            w = white_words(pa.array([texts[i]], pa.string()))
            starts = np.append(w.starts, len(w.data))
            raw, at, out = texts[i].encode(), 0, []
            for s in sorted(spans[i].as_py(), key=lambda x: (x["start_word"], x["end_word"])):
                a, b = (int(starts[min(s[c], len(w.starts))]) for c in ("start_word", "end_word"))
                if a > at:
                    out.append(raw[at:a])
                at = max(at, b)
            out.append(raw[at:])
            texts[i] = b"".join(out).decode()
            gone[i] = not texts[i].strip()
        columns = [pa.array(texts, batch.column("text").type) if c == "text" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~gone))


def remove_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """The documents without the passages that a document of a smaller doc_id has; a text of which nothing is left goes.
    Rows that repeat a document are all cut; if a doc_id has several texts, each loses the spans of all. Rows without
    repeats, null ones included, stay as they are, and so do all other columns."""
    own, spans_name = (fresh(docs, x) for x in ("id", "spans"))
    spans = repeated_spans(docs, passage, gram, batches).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(spans_name))
    joined = docs.join(spans, F.col("doc_id").cast("bigint") == F.col(own), "left").drop(own)
    return joined.mapInArrow(lean(_cut, names=docs.columns, spans_name=spans_name), docs.schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
