"""Vectorised words of Arrow string batches: boundaries and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 1 << 20


class Kept(dict):
    """A cache of one process; it travels to executors empty."""

    def __reduce__(self):
        return Kept, ()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = Kept()
_TABLES: dict[str, np.ndarray] = Kept()


def powers(n: int, base: int = int(BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (an odd base has an inverse)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about max_bytes of text; one row is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        floor = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, floor + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array without nulls."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a string array: byte starts and ends, hashes, and first word of each row (``row``, one longer)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        self.data, self.off = bytes_of(texts)
        word = self.data != 32
        if not len(word):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.row = np.zeros(len(self.off), np.int64)
            return
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        heads = self.off[:-1]
        before[heads[heads < len(word)]] = False
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        tails = self.off[1:] - 1
        after[tails[tails >= 0]] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.row = np.searchsorted(self.starts, self.off)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            a = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.starts, a + SEGMENT)))
            b = int(self.ends[to - 1])
            up, down = powers(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((self.data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
            s = self.starts[at:to] - a
            out[at:to] = (sums[self.ends[at:to] - a] - sums[s]) * down[s]
            at = to
        return mix(out)

    @classmethod
    def at(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> "Words":
        """Given runs of bytes as words."""
        w = cls.__new__(cls)
        w.data, w.starts, w.ends, w.row = data, starts, ends, row
        w.hash = w._hash()
        return w

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


class Letters:
    """Characters of a string array without nulls: code points, byte starts (one longer), and first character of each row
    (``row``, one longer)."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = bytes_of(texts)
        self.code = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        size = np.ones(len(self.code), np.int64)
        for least in (0x80, 0x800, 0x10000):
            size += self.code >= least
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.row = np.searchsorted(self.start, self.off)


def char_table(name: str, of) -> np.ndarray:
    """A small number for every code point, computed once a process."""
    if name not in _TABLES:
        _TABLES[name] = np.array([of(chr(i)) for i in range(0x110000)], np.uint8)
    return _TABLES[name]


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with the same value of a column, of a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        value = batch.column(column).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(value[1:] != value[:-1]) + 1, len(value)] if len(value) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and value[a] != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = value[a]
    if held:
        yield held


def flat(batches: list[pa.RecordBatch], columns) -> list[np.ndarray]:
    """Columns of bytes, each with the kind of number that they hold, as one array each."""
    return [np.concatenate([np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(name)]) for name, kind in columns]


def grams(hashes: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the n words from each word on (the last n - 1 entries are missing); windows over row ends are the caller's."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(hashes) - n + 1, np.uint64)
    for at in range(0, len(out), SEGMENT):
        part = hashes[at : at + SEGMENT + n - 1]
        up, down = powers(len(part) + 1, base)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - n + 1
        out[at : at + m] = (sums[n:] - sums[:m]) * down[:m]
    return mix(out)


def normal_words(texts: pa.Array) -> Words:
    """Lower-cased runs of letters and digits."""
    return Words(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " "))


def white_words(texts: pa.Array) -> Words:
    """Runs of characters that are no white space."""
    return Words(blanked(texts))


def blanked(texts: pa.Array) -> pa.Array:
    """White space of one byte as blanks, so offsets stay those of the text; wider white space belongs to words."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\t\n\x0b\f\r]", " ")
