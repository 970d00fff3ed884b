"""Token counts of a byte-level BPE vocabulary, huge documents in overlapping chunks.

A document of more than HUGE characters is cut into chunks that overlap by OVERLAP characters. Each chunk is encoded on
its own, wherever the cluster has room, with the byte offset of every token. Two neighbours are spliced at a boundary
that both have in their overlap and that is proven stable: one where the pre-tokenizer splits whatever stands further
left or right. The pattern's alternatives only take white space at their start or as a run of it, so it always splits

* before a lone blank between a character that isn't white space and a letter,
* before and behind a lone line feed between characters that aren't white space,
* between a letter and a following character that is neither letter, digit, white space nor mark.

Tokens never cross a split, so the counts left and right of it add up to the count of the whole text. Where an overlap
has no common boundary of this kind, the document is encoded again with overlaps WIDEN times as wide, in the end in one
piece. Documents that aren't huge are encoded whole, without a shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import Kept
from ._shared import lean, materialize, partitions, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
WIDEN = 8
STABLE = r"(?<=\S)(?= \p{L})|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=\p{L})(?=[^\s\p{L}\p{N}\p{M}])"
_ENCODERS: dict = Kept()


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """(encoding, bytes of each token)."""
    import tiktoken

    key = hash((vocabulary, pattern))
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[key]


def _whole(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    encoding, _ = encoder(vocabulary.value)
    for batch in batches:
        counts = [len(encoding.encode_to_numpy(x, disallowed_special=())) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])


CHUNKS = "doc_id bigint, h bigint, i int, chunks int, own int, body string"


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    for batch in batches:
        for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text"))):
            size = max(chunk, 2 * overlap)
            n = max(1, -(-(len(text) - overlap) // size))
            for at in range(0, n, 64):
                rows = [(doc, h, i, n, size, text[i * size : (i + 1) * size + overlap if i < n - 1 else None]) for i in range(at, min(n, at + 64))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=names)


def stable_boundaries(zone: str) -> list[int]:
    """Byte offsets of proven boundaries strictly inside a piece of text."""
    import regex

    found = [m.start() for m in regex.finditer(STABLE, zone, overlapped=True)]
    out, at, size = [], 0, 0
    for p in found:
        size += len(zone[at:p].encode())
        at = p
        out.append(size)
    return out


ENCODED = "doc_id bigint, h bigint, i int, chunks int, tokens bigint, head array<bigint>, head_index array<bigint>, tail array<bigint>, tail_index array<bigint>"


def _encode(batches: Iterator[pa.RecordBatch], vocabulary, overlap: int) -> Iterator[pa.RecordBatch]:
    encoding, sizes = encoder(vocabulary.value)
    names = [x.split()[0] for x in ENCODED.split(", ")]
    for batch in batches:
        rows = []
        for doc, h, i, n, own, text in zip(*(c.to_pylist() for c in batch.columns)):
            ends = np.cumsum(sizes[encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)])
            cells = []
            for zone, base in ((text[:overlap] if i else "", 0), (text[own:] if i < n - 1 else "", len(text[:own].encode()))):
                offsets = np.array(stable_boundaries(zone), np.int64)
                index = np.searchsorted(ends, offsets + base)
                real = (index < len(ends)) & (ends[np.minimum(index, len(ends) - 1)] == offsets + base) if len(ends) else np.zeros(len(offsets), bool)
                cells += [offsets[real].tolist(), (index[real] + 1).tolist()]
            rows.append((doc, h, i, n, len(ends), *cells))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def splice(chunks: list[dict]) -> int | None:
    """Tokens of a document from its chunks in order, or None where two neighbours share no stable boundary."""
    total, begin = 0, 0
    for a, b in zip(chunks, chunks[1:]):
        there = dict(zip(b["head"], b["head_index"]))
        meet = next(((x, n) for x, n in zip(a["tail"], a["tail_index"]) if x in there), None)
        if meet is None:
            return None
        total += meet[1] - begin
        begin = there[meet[0]]
    return total + chunks[-1]["tokens"] - begin


SPLICED = "doc_id bigint, h bigint, n_tokens bigint, copies int"


def _splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            docs.setdefault((row["doc_id"], row["h"]), []).append(row)
    if not docs:
        return
    rows = []
    for (doc, h), parts in docs.items():
        parts.sort(key=lambda x: x["i"])
        copies = len(parts) // parts[0]["chunks"]
        rows.append((doc, h, splice(parts[::copies]), copies))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=[x.split()[0] for x in SPLICED.split(", ")])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens) of each row, exactly the length of the whole text's encoding.

    A null text has null tokens, an empty one 0. A null doc_id and repeated rows are kept. Special tokens' strings are
    ordinary text. Other columns are ignored; an empty table gives no rows.
    """
    if min(chunk, overlap) < 1:
        raise ValueError("chunk and overlap must be positive")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        vocab = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.length("text")
    out = docs.filter(size <= huge).mapInArrow(lean(_whole, vocabulary=vocab), "doc_id bigint, n_tokens bigint")
    out = out.unionByName(docs.filter("text is null").select("doc_id", F.lit(None).cast("bigint").alias("n_tokens")))
    left = docs.filter(size > huge).withColumn("h", F.xxhash64("text"))
    parts = partitions(spark)
    while True:
        chunks = left.mapInArrow(lean(_cut, chunk=chunk, overlap=overlap), CHUNKS).repartition(parts, "h", "i")
        encoded = chunks.mapInArrow(lean(_encode, vocabulary=vocab, overlap=overlap), ENCODED)
        spliced = materialize(encoded.repartition(parts, "h").mapInArrow(lean(_splice), SPLICED), "spliced")
        out = out.unionByName(spliced.filter("n_tokens is not null").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "n_tokens"))
        failed = spliced.filter("n_tokens is null").select(F.col("doc_id").alias("d"), F.col("h").alias("k"))
        if failed.isEmpty():
            return out
        left = left.join(failed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left_semi")
        overlap *= WIDEN


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
