"""Texts to embed, embedders, and the plan that runs them beside the data.

An embedder has ``fingerprint``, ``dimension()``, ``documents(texts)`` and ``queries(texts)``, the last two giving one
list of numbers a text. One that also has ``chunks(document, texts)`` sees each chunk with its whole document. One with
``matrix(texts)`` takes an Arrow array and gives a matrix of numbers, without a Python object a text. One with
``column(text)`` states its vectors as a Catalyst expression, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.text import WHITE, bucket, let, tokens, trim_white
from ..functions.vectors import norm


class Embedder(Protocol):
    fingerprint: str

    def dimension(self) -> int: ...
    def documents(self, texts: list[str]) -> list[list[float]]: ...
    def queries(self, texts: list[str]) -> list[list[float]]: ...


def _fnv(x: bytes) -> int:
    h = 2166136261
    for b in x:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


class Fixture:
    """A deterministic embedder without a model: words and pairs of words are counted in buckets by hash."""

    PAIR = 1.5

    def __init__(self, model: str = "fixture", dimension: int = 64):
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        self.model, self._dimension = model.strip() or "fixture", dimension
        self.fingerprint = f"fixture|{self.model}|hash-bigram-v1|{dimension}"

    def dimension(self) -> int:
        return self._dimension

    def column(self, text: Column) -> Column:
        """The same vectors inside Catalyst; sums run in the order of the words."""
        hit = lambda x, w: F.struct(bucket(x, self._dimension).alias("b"), F.lit(w).alias("w"))
        pair = lambda t, x, i: F.concat(F.get(t, i - 1), F.lit("_"), x)
        hits = let(tokens(text), lambda t: F.flatten(F.transform(t, lambda x, i: F.when(i == 0, F.array(hit(x, 1.0))).otherwise(F.array(hit(x, 1.0), hit(pair(t, x, i), self.PAIR))))))
        places = F.sequence(F.lit(0), F.lit(self._dimension - 1))
        sums = let(hits, lambda h: F.transform(places, lambda d: F.aggregate(F.filter(h, lambda y: y["b"] == d), F.lit(0.0).cast("double"), lambda s, y: s + y["w"])))
        return let(sums, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))

    def matrix(self, texts: pa.Array) -> np.ndarray:
        """The same vectors of an Arrow array, a row a text. Tokens are hashed by length, a byte of all at a time; counts are
        multiples of a half, so no order of sums matters."""
        x = pc.utf8_lower(pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), "İ", "i"), "Σ", "σ"))
        lists = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(x, r"[^\p{L}\p{Nd}]+", " "), " "), " ")
        words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        full = pc.not_equal(words, "")
        words, row = words.filter(full), row[full.to_numpy(zero_copy_only=False)]
        own = words.dictionary_encode()
        raw = [x.encode() for x in own.dictionary.to_pylist()]
        size = np.array([len(x) for x in raw], np.int64)
        data, start = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        which = own.indices.to_numpy()

        def hashed(begin: np.ndarray, at: np.ndarray) -> np.ndarray:
            """FNV-1a of words, each from a state on."""
            h, n = begin.copy(), size[at]
            for i in range(int(n.max(initial=0))):
                more = np.flatnonzero(n > i)
                h[more] = (h[more] ^ data[start[at[more]] + i]) * np.uint32(16777619)
            return h

        first = hashed(np.full(len(raw), 2166136261, np.uint32), np.arange(len(raw)))[which]
        pair = np.flatnonzero(row[1:] == row[:-1]) + 1
        second = hashed((first[pair - 1] ^ np.uint32(ord("_"))) * np.uint32(16777619), which[pair])
        d = self._dimension
        place = np.concatenate([row * d + first % np.uint32(d), row[pair] * d + second % np.uint32(d)])
        out = np.bincount(place.astype(np.int64), np.r_[np.ones(len(row)), np.full(len(pair), self.PAIR)], len(texts) * d).reshape(-1, d)
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(n > 0, n, 1)

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(x) for x in texts]

    queries = documents

    def _vector(self, text: str) -> list[float]:
        import regex

        words = regex.findall(r"[\p{L}\p{Nd}]+", text.replace("İ", "i").replace("Σ", "σ").lower())
        out = [0.0] * self._dimension
        for i, x in enumerate(words):
            out[_fnv(x.encode()) % self._dimension] += 1.0
            if i:
                out[_fnv(f"{words[i - 1]}_{x}".encode()) % self._dimension] += self.PAIR
        n = sum(x * x for x in out) ** 0.5
        return [x / n for x in out] if n else out


def _joined(*parts: Column) -> Column:
    texts = F.filter(F.array(*[trim_white(p) for p in parts]), lambda x: x != "")
    return F.array_join(texts, "\n\n")


def embedding_text(title: Column, heading: Column, content: Column, context: Column) -> Column:
    """What is embedded of a chunk: its context, title, heading (unless it is the title) and text."""
    body = _joined(title, F.when(trim_white(heading) == trim_white(title), F.lit("")).otherwise(heading), content)
    return F.when(context == "", body).otherwise(F.concat(context, F.lit("\n\n"), body))


def document_text(title: Column, body: Column) -> Column:
    return _joined(title, body)


def search_text(content: Column, context: Column) -> Column:
    return F.when(context == "", content).otherwise(F.concat(context, F.lit("\n\n"), content))


Contextualizer = Callable[[dict, list[tuple[str, str]]], list[str]]


def _contexts(hook: Contextualizer) -> Callable:
    def of_record(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk_index"])
        record = {c: rows[0][c] for c in ("ref", "kind", "title", "body_text")}
        prefixes = hook(record, [(r["heading"], r["content"]) for r in rows])
        if len(prefixes) != len(rows):
            raise ValueError(f"record {record['ref']!r}: {len(prefixes)} contexts for {len(rows)} sections")
        clean = ["" if not x.strip(WHITE) else x for x in prefixes]
        return pa.table({"ref": [r["ref"] for r in rows], "chunk_index": pa.array([r["chunk_index"] for r in rows], pa.int32()), "context_prefix": clean})

    return of_record


def with_context(chunks: DataFrame, records: DataFrame, hook: Contextualizer | None) -> DataFrame:
    """Chunks with ``context_prefix``: what the hook gives for the sections of each record, or nothing."""
    if hook is None:
        return chunks.withColumn("context_prefix", F.lit(""))
    rows = chunks.select("ref", "chunk_index", "heading", "content").join(records.select("ref", "kind", "title", "body_text"), "ref")
    found = rows.groupBy("ref").applyInArrow(_contexts(hook), "ref string, chunk_index int, context_prefix string")
    return chunks.join(found, ["ref", "chunk_index"])


def _check(vectors: list, texts: list, dimension: int) -> list:
    if len(vectors) != len(texts):
        raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(texts)} texts")
    for v in vectors:
        if len(v) != dimension:
            raise ValueError(f"the embedder gave a vector of dimension {len(v)} instead of {dimension}")
    return vectors


def _with(batch, keys: list[str], embedding: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], embedding], names=[*keys, "embedding"])


def _embed(batches: Iterator[pa.RecordBatch], embedder: Embedder, dimension: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = batch.column("text").to_pylist()
        vectors = _check(embedder.documents(texts), texts, dimension)
        yield _with(batch, keys, pa.array(vectors, pa.list_(pa.float64())))


def _embed_matrix(batches: Iterator[pa.RecordBatch], embedder, dimension: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", rows=4096):
        m = embedder.matrix(batch.column("text"))
        _check([m[0]] * len(m) if len(m) else [], range(batch.num_rows), dimension)
        offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * dimension)
        yield _with(batch, keys, pa.ListArray.from_arrays(offsets, pa.array(m.ravel())))


def _embed_whole(embedder, dimension: int, keys: list[str]) -> Callable:
    def of_record(key, table):
        table = table.sort_by("chunk_index")
        texts = table.column("text").to_pylist()
        vectors = _check(embedder.chunks(table.column("document")[0].as_py(), texts), texts, dimension)
        return table.select(keys).append_column("embedding", pa.array(vectors, pa.list_(pa.float64())))

    return of_record


def embed(texts: DataFrame, embedder: Embedder, documents: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ref, chunk_index, embedding) of (ref, chunk_index, text), with the columns to keep between; ``documents`` (ref,
    document) serves embedders that look at whole documents."""
    keys = ["ref", "chunk_index", *keep]
    schema = ", ".join([*[f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys], "embedding array<double>"])
    rows, settings = texts.select(*keys, "text"), {"embedder": embedder, "dimension": embedder.dimension(), "keys": keys}
    if hasattr(embedder, "chunks") and documents is not None:
        return rows.join(documents.select("ref", "document"), "ref").groupBy("ref").applyInArrow(_embed_whole(**settings), schema)
    if hasattr(embedder, "matrix"):
        return rows.mapInArrow(partial(_embed_matrix, **settings), schema)
    if hasattr(embedder, "column"):
        return rows.select(*keys, embedder.column(F.col("text")).alias("embedding"))
    return rows.mapInArrow(partial(_embed, **settings), schema)
