"""Benchmark decontamination by templates: typed placeholders, hash-joined template windows, slot consistency.

Texts become template words. Numbers, units behind a number, and capitalised words (names) inside a sentence are typed
slots; the first word of a sentence, of which the case tells nothing, is a slot of its own type; the rest are
lower-cased literals. Windows of WINDOW template words with at least LITERALS literals are hash-joined against the
windows of the benchmark items. A window that meets grows to the longest run of equal template words; the run is a leak
when it has min(RUN, words of the item) words and its slots agree: one value of the item always stands for one value of
the document, and different names for different names. Of a run whose slots disagree, the longest part whose slots agree
is taken, if it has as many words and a window of its own. Items of at most RUN words must match in all of them; as their
first word may stand behind a colon, a list mark or a line break, there it agrees with any name and with its own letters in
small, too.

All this is done twice: with a slot for each capitalised word, and with one slot for each name, which is a run of
capitalised words with nothing but a blank or a hyphen between them (behind the first word of a sentence it is part of that
slot). The second finds items whose names have another number of words, the first counts each word of what stands verbatim.
So a question with other numbers and names is caught, and a
sentence that only has the same shape is not.

The benchmark's windows are broadcast up to BROADCAST_WINDOWS of them: documents are then read once and nothing is
shuffled. A larger benchmark is joined window by window through a shuffle: its items send the same windows that the
broadcast index has, and of the documents' windows only those go that pass a bitmap of the items' (16 MB, whatever the
benchmark). Pairs of a text and an item that share a window are verified one by one. Both ways give the same leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import Words, grams, mix, slices
from ._shared import fresh, lean, materialize, release, Shared, table

WINDOW = 8
LITERALS = 5
RUN = 13
BROADCAST_WINDOWS = 4_000_000
NUMBER, HEAD, NAME, UNIT = 1, 2, 3, 4
JOINED = 6
FILTER_BITS = 27  #: bits of the bitmap of the items' windows, as a power of two
KEPT_ITEMS = 4096  #: items that a task keeps in parsed form between pairs
UNITS = "km|m|cm|mm|miles?|feet|foot|ft|inch(?:es)?|yards?|kg|g|mg|grams?|kilograms?|pounds?|lbs?|ounces?|oz|tons?|l|ml|lit(?:er|re)s?|gallons?|cups?|seconds?|secs?|minutes?|mins?|hours?|hrs?|h|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|degrees?|mph|kmh|kph|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|kwh|v|volts?|watts?|points?"
_STEPS = (
    (r"[\x00-\x06\t ]+", " "),
    (r" ?[\n\r\f][\n\r\f ]*", "  "),  # two blanks: no name goes on behind a line break
    (r"((?:^|[.!?]+[\"')\]»”]*) *[^\p{L}\p{N} ]* *)(\p{L}[\p{L}\p{M}'’]*)", "\\1 \x02\\2"),
    (r"(^|[^\p{L}\x02'’])(\p{Lu}[\p{L}\p{M}'’]*)", "\\1\x03\\2"),
    (r"([\p{L}\p{M}'’])[ \x{a0}\x{2010}\x{2011}-]\x03", "\\1 \x06"),
    ("  ", " "),
    (r"(\d)[.,:/](\d)", "\\1\x05\\2"),
    (r"(\d)[.,:/](\d)", "\\1\x05\\2"),
    (r"(\d[\d\x05]*) ?%", "\\1 percent "),
    (r"([$€£]) ?(\d[\d\x05]*)", " \\2 dollars "),
)


def canonical(texts: pa.Array) -> Words:
    """Template words; a slot's word starts with the byte of its type and keeps its value. ``joined`` tells of each whether it
    is a name's word right behind another word."""
    x = pc.fill_null(texts, "")
    for pattern, to in _STEPS:
        x = pc.replace_substring_regex(x, pattern, to)
    x = pc.utf8_lower(x)
    x = pc.replace_substring_regex(x, r"([^\p{L}\p{N}\x05]|^)(\d[\d\x05]*)", "\\1\x01\\2 ")
    x = pc.replace_substring_regex(x, rf"(\x01[\d\x05]+) +({UNITS})\b", "\\1 \x04\\2")
    x = pc.replace_substring_regex(x, r"['’]", "")
    x = pc.replace_substring_regex(x, r"[^\p{L}\p{N}\p{M}\x01-\x06]+", " ")
    w = Words(x)
    w.joined = w.data[w.starts] == JOINED if len(w.starts) else np.zeros(0, bool)
    w.data = np.where(w.data == JOINED, np.uint8(NAME), w.data)
    w.kind = np.where(w.data[w.starts] < 5, w.data[w.starts], 0) if len(w.starts) else np.zeros(0, np.uint8)
    slot = w.kind > 0
    w.hash[slot] = w.kind[slot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return w


def folded(w: Words) -> Words:
    """Template words with one slot for each name; ``first`` is the first word of each in w, and one more."""
    name = (w.kind == NAME) | (w.kind == HEAD)
    keep = np.ones(len(w.hash), bool)
    keep[1:] = ~(w.joined[1:] & name[:-1])
    out = Words.__new__(Words)
    first = np.flatnonzero(keep)
    out.first = np.append(first, len(w.hash))
    out.data, out.off, out.starts, out.ends = w.data, w.off, w.starts[first], w.ends[out.first[1:] - 1]
    out.hash, out.kind, out.row = w.hash[first], w.kind[first], np.searchsorted(first, w.row)
    return out


def windows(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows within one row that have enough literals."""
    g = grams(w.hash, length)
    if not len(g):
        return np.zeros(0, np.int64), g
    row = w.rows()
    literal = np.concatenate([[0], np.cumsum(w.kind == 0)])
    ok = (row[: len(g)] == row[length - 1 :]) & (literal[length:] - literal[:-length] >= min(LITERALS, max(1, length - 2)))
    at = np.flatnonzero(ok)
    return at, g[at]


class Benchmark:
    """Items as template words, and their windows sorted by hash. An item shorter than WINDOW is one window."""

    def __init__(self, ids: list, texts: list, w: Words | None = None):
        self.ids = ids
        self.texts = texts
        self.folded = None
        if w is None:
            w = canonical(pa.array(texts, pa.string()))
            self.folded = Benchmark(ids, texts, folded(w))
            self.folded.first = [self.folded.first[a : b + 1] - self.folded.first[a] for a, b in zip(self.folded.row, self.folded.row[1:])]
        else:
            self.first, self.row = w.first, w.row
        self.words = [w.hash[a:b] for a, b in zip(w.row, w.row[1:])]
        self.kinds = [w.kind[a:b] for a, b in zip(w.row, w.row[1:])]
        self.values = [[w.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.row, w.row[1:])]
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        row, length = w.rows(), np.diff(w.row)
        for n in sorted({min(WINDOW, int(x)) for x in length if x}):
            at, h = windows(w, n)
            fits = (length[row[at]] == n) | (n == WINDOW)
            self._enter(n, h[fits], row[at[fits]], at[fits] - w.row[row[at[fits]]])
            if 1 < n <= WINDOW:
                # items of one window are also met without their first word
                whole = np.flatnonzero(fits & (length[row[at]] == n) & (w.kind[at] == HEAD))
                rest = grams(w.hash, n - 1)
                self._enter(n - 1, rest[at[whole] + 1], row[at[whole]], np.ones(len(whole), np.int64))

    def _enter(self, n: int, h: np.ndarray, items: np.ndarray, places: np.ndarray) -> None:
        """Add windows of n words to the index."""
        if n in self.index:
            h, items, places = (np.concatenate(x) for x in zip(self.index[n], (h, items, places)))
        order = np.argsort(h, kind="stable")
        if len(order):
            self.index[n] = (h[order], items[order], places[order])

    def meets(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(word, item, word of the item) of each equal window."""
        for n, (have, items, places) in self.index.items():
            at, h = windows(w, n)
            seen = np.zeros(1 << 20, bool)
            seen[(have >> np.uint64(44)).astype(np.int64)] = True
            some = seen[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[some], h[some]
            first, last = np.searchsorted(have, h), np.searchsorted(have, h, side="right")
            for i in np.flatnonzero(last > first):
                for j in range(first[i], last[i]):
                    yield int(at[i]), int(items[j]), int(places[j])

    def find(self, w: Words) -> list[tuple]:
        """The longest leak by words of each row and item; where there is none, the longest by names, in words of the item."""
        best = {x[:2]: x for x in self.leaks(w, self.meets(w))}
        f = folded(w)
        for r, item, start, a, n, verbatim, changed in self.folded.leaks(f, self.folded.meets(f)):
            first, base = self.folded.first[item], int(f.row[r])
            x = (r, item, int(f.first[base + start] - w.row[r]), int(first[a]), int(first[a + n] - first[a]), verbatim, changed)
            best.setdefault((r, item), x)
        return [best[k] for k in sorted(best)]

    def leaks(self, w: Words, meets) -> list[tuple]:
        """(row, item, first word in the document, first word in the item, words, verbatim, changed slots): the longest leak
        of each row and item, of equals the first."""
        row, best, done = w.rows(), {}, {}
        for at, item, place in meets:
            r = int(row[at])
            base, delta = int(w.row[r]), at - place
            if place < done.get((r, item, delta), -1):
                continue
            words = self.words[item]
            low, high = max(0, base - delta), min(len(words), int(w.row[r + 1]) - delta)
            here = w.hash[delta + low : delta + high] == words[low:high]
            if low == 0 and len(words) <= RUN and not here[0]:
                here[0] = self._opens(w, item, delta)
            left = np.flatnonzero(~here[: place - low])
            right = np.flatnonzero(~here[place - low :])
            a = low + (int(left[-1]) + 1 if len(left) else 0)
            b = place + int(right[0]) if len(right) else high
            done[(r, item, delta)] = b
            if b - a < min(RUN, len(words)):
                continue
            ok, changed = self._slots(w, item, a, b, delta)
            if not ok:
                a, b = self._part(w, item, a, b, delta)
                ok, changed = self._slots(w, item, a, b, delta) if b > a else (False, 0)
            if ok:
                x = (-(b - a), delta + a - base, a, changed)
                if (r, item) not in best or x < best[(r, item)]:
                    best[(r, item)] = x
        return [(r, item, start, a, -n, changed == 0, changed) for (r, item), (n, start, a, changed) in sorted(best.items())]

    def _opens(self, w: Words, item: int, at: int) -> bool:
        """Whether a document's word can be the item's first, typed otherwise as no sentence ends in front of it."""
        if self.kinds[item][0] != HEAD:
            return False
        return w.kind[at] == NAME or (w.kind[at] == 0 and w.data[w.starts[at] : w.ends[at]].tobytes() == self.values[item][0][1:])

    def _pair(self, w: Words, item: int, p: int, delta: int) -> tuple[int, bytes, bytes]:
        """Type and values of a slot. Of the first word of a sentence it is the name behind it that counts, if both have one; else
        the values tell whether one has."""
        kind = int(self.kinds[item][p])
        if not kind:
            return 0, b"", b""
        x, y = self.values[item][p], w.data[w.starts[delta + p] : w.ends[delta + p]].tobytes()
        if kind == HEAD:
            x, y = x.partition(b" ")[2], y.partition(b" ")[2]
            kind = NAME if x and y else HEAD
        return kind, x, y

    def _part(self, w: Words, item: int, a: int, b: int, delta: int) -> tuple[int, int]:
        """The longest part of a run, of equals the first, that is long enough, has a window of enough literals, and whose
        slots agree; an empty one where there is none."""
        kinds = self.kinds[item]
        n, least = min(WINDOW, len(kinds)), min(RUN, len(kinds))
        literal = np.concatenate([[0], np.cumsum(kinds == 0)])
        seeds = np.flatnonzero(literal[n:] - literal[:-n] >= min(LITERALS, max(1, n - 2)))
        there: dict = {}
        back: dict = {}
        best = (a, a)

        def count(p: int, by: int) -> bool:
            """Take the slot in or out; whether it agrees with those that are in."""
            kind, x, y = self._pair(w, item, p, delta)
            if kind in (0, HEAD):
                return True
            ok = True
            for names, one, other in ((there, x, y), (back, y, x))[: 2 if kind == NAME else 1]:
                have = names.setdefault(one, {})
                have[other] = have.get(other, 0) + by
                if not have[other]:
                    del have[other]
                ok &= len(have) < 2
            return ok

        low = a
        for p in range(a, b):
            ok = count(p, 1)
            while not ok:
                # only the pairs of p can disagree: take slots out until p, taken anew, agrees
                count(low, -1)
                low += 1
                count(p, -1)
                ok = count(p, 1)
            if p + 1 - low > best[1] - best[0] and p + 1 - low >= least:
                i = int(np.searchsorted(seeds, low))
                if i < len(seeds) and seeds[i] + n <= p + 1:
                    best = (low, p + 1)
        return best

    def _slots(self, w: Words, item: int, a: int, b: int, delta: int) -> tuple[bool, int]:
        there: dict = {}
        back: dict = {}
        changed = 0
        for p in range(a, b):
            kind, x, y = self._pair(w, item, p, delta)
            if kind in (0, HEAD):
                changed += kind == HEAD and x != y
                continue
            if there.setdefault(x, y) != y or (kind == NAME and back.setdefault(y, x) != x):
                return False, 0
            changed += x != y
        return True, changed


LEAKS = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, words bigint, verbatim boolean, changed_slots bigint"


def _find(batches: Iterator[pa.RecordBatch], bench) -> Iterator[pa.RecordBatch]:
    bench = bench.value
    for batch in batches:
        for part in slices(batch, "text"):
            w = canonical(part.column("text"))
            found = bench.find(w)
            if found:
                ids = part.column("doc_id").to_pylist()
                cols = list(zip(*((ids[r], bench.ids[item], *rest) for r, item, *rest in found)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in LEAKS.split(", ")])


def _clean(batches: Iterator[pa.RecordBatch], bench, column: str) -> Iterator[pa.RecordBatch]:
    bench = bench.value
    for batch in batches:
        for part in slices(batch, column):
            w = canonical(part.column(column))
            bad = np.zeros(part.num_rows, bool)
            for r, *_ in bench.find(w):
                bad[r] = True
            yield part.filter(pa.array(~bad))


ITEM_WINDOWS = "h bigint, n int, key bigint"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each item's index."""
    for batch in batches:
        h, n, key = [], [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("item_text").to_pylist()):
            one = Benchmark([0], [text])
            for index in (one.index, one.folded.index):
                for length, (have, _, _) in index.items():
                    h.append(have)
                    n.append(np.full(len(have), length, np.int32))
                    key.append(np.full(len(have), k, np.int64))
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([y.view(np.int64) for y in h], n, key)], names=[x.split()[0] for x in ITEM_WINDOWS.split(", ")])


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The bitmap's blocks that have a bit of this partition's windows."""
    have: dict[int, np.ndarray] = {}
    size = min(1 << 16, 1 << bits)
    for batch in batches:
        at = np.unique(_bit(batch.column("h").to_numpy().view(np.uint64), bits))
        for block in np.unique(at // size).tolist():
            have.setdefault(block, np.zeros(size, bool))[at[at // size == block] % size] = True
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([np.packbits(x).tobytes() for x in have.values()], pa.binary())], names=["block", "bits"])


def _or_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(bits, np.uint8)
            have[block] = have[block] | x if block in have else x
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], names=["block", "bits"])


def _text_windows(batches: Iterator[pa.RecordBatch], lengths: list[int], bitmap, bits: int) -> Iterator[pa.RecordBatch]:
    """(h, n, t) of the windows that pass the bitmap; of a text each once."""
    some = np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        for part in slices(batch, "text"):
            words = canonical(part.column("text"))
            ids = part.column("t").to_numpy()
            found = []
            for w in (words, folded(words)):
                row = w.rows()
                for n in lengths:
                    at, h = windows(w, n)
                    bit = _bit(h, bits)
                    ok = (some[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
                    found.append((h[ok], np.full(int(ok.sum()), n, np.int32), row[at[ok]]))
            h, n, row = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((n, h, row))
            h, n, row = h[order], n[order], row[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(n[new]), pa.array(ids[row[new]])], names=["h", "n", "t"])


def _against(text: str | None, item: int | None, item_text: str | None, kept: dict) -> list[tuple]:
    """The leak of one item in one text, as ``Benchmark.find`` tells it."""
    if text is None or item_text is None:
        return []
    if item_text not in kept:
        if len(kept) >= KEPT_ITEMS:
            kept.clear()
        kept[item_text] = Benchmark([None], [item_text])
    return kept[item_text].find(canonical(pa.array([text], pa.string())))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaks of each (doc_id, text, item_id, item_text)."""
    kept: dict = {}
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for doc, text, item, item_text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item_text"))):
                rows += [(doc, item, *rest) for _, _, *rest in _against(text, item, item_text, kept)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows))], names=[x.split()[0] for x in LEAKS.split(", ")])


def _leaking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (t, text, item_id, item_text) that leak."""
    kept: dict = {}
    for batch in batches:
        ok = [bool(_against(*x, kept)) for x in zip(*(batch.column(c).to_pylist() for c in ("text", "item_id", "item_text")))]
        yield batch.filter(pa.array(ok, pa.bool_()))


def _clean_pairs(batches: Iterator[pa.RecordBatch], names: tuple[str, str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    kept: dict = {}
    for batch in batches:
        for part in slices(batch, "text"):
            ok = [not _against(text, *item, kept) for text, *item in zip(*(part.column(c).to_pylist() for c in ("text", *names)))]
            yield part.select(columns).filter(pa.array(ok, pa.bool_()))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(t, item_id, item_text), distinct: items that share a window with a text, which goes by its 64-bit hash t, so a text
    that many documents have is looked at once for each task. Hashes only choose candidates."""
    spark = docs.sparkSession
    items = items.withColumn("key", F.xxhash64("item_id", "item_text"))
    ours = materialize(items.mapInArrow(lean(_item_windows), ITEM_WINDOWS).distinct(), "item-windows")
    lengths = sorted(r[0] for r in ours.select("n").distinct().collect())  # WINDOW of them at most
    bitmap = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for block, bits in ours.select("h").mapInArrow(lean(_bitmap, bits=FILTER_BITS), "block int, bits binary").repartition("block").mapInArrow(lean(_or_blocks), "block int, bits binary").toLocalIterator():
        bitmap[block * len(bits) : (block + 1) * len(bits)] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").select(F.xxhash64("text").alias("t"), "text")
    theirs = texts.mapInArrow(lean(_text_windows, lengths=lengths, bitmap=shared, bits=FILTER_BITS), "h bigint, n int, t bigint").distinct()
    meets = materialize(theirs.join(ours, ["h", "n"]).select("t", "key").distinct().join(items, "key").select("t", "item_id", "item_text"), "meets")
    release(ours)
    return meets


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("item_text")).filter("item_text is not null").distinct()


def _small(items: DataFrame, limit: int):
    """The broadcast benchmark, or None where its windows (at most its words) would be more than the limit."""
    words = items.agg(F.coalesce(F.sum(F.size(F.split("item_text", r"\s+"))), F.lit(0))).first()[0]
    if words > limit:
        return None
    rows = items.orderBy("item_id", "item_text").collect()
    return Shared(items.sparkSession, Benchmark([r[0] for r in rows], [r[1] for r in rows]))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, words, verbatim, changed_slots): the longest leak of each document and item,
    in template words; of equally long ones the first.

    Null and empty texts leak nothing, very long ones are searched whole; documents with a null doc_id are reported under
    null, null item_ids likewise. A doc_id with several texts leaks by each of them. Repeated rows of a document give
    repeated rows here, repeated items give one. Items without a window of enough literals can't be found. Other columns, of
    whatever name, are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    bench = _small(items, broadcast_windows)
    if bench is not None:
        return docs.mapInArrow(lean(_find, bench=bench), LEAKS)
    pairs = docs.withColumn("t", F.xxhash64("text")).join(candidates(docs, items), "t").select("doc_id", "text", "item_id", "item_text")
    return pairs.mapInArrow(lean(_verify), LEAKS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents without those that leak a benchmark item; all columns and row multiplicities are kept. Each row is
    judged by its text, whatever its doc_id; null texts stay."""
    bench = _small(_items(benchmark), broadcast_windows)
    if bench is not None:
        return docs.mapInArrow(lean(_clean, bench=bench, column="text"), docs.schema)
    # one verified leak of each text is enough; the rows that have the text's hash are then judged by their own text
    own = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    meets = candidates(own, _items(benchmark))
    texts = own.select(F.xxhash64("text").alias("t"), "text").join(meets.select("t").distinct(), "t").distinct()
    pairs = texts.join(meets, "t").select("t", "text", "item_id", "item_text")
    t, item, body = (fresh(docs, x) for x in ("t", "leaked_item", "leaked_text"))
    found = pairs.mapInArrow(lean(_leaking), pairs.schema).groupBy(F.col("t").alias(t)).agg(F.min(F.struct("item_id", "item_text")).alias("x")).select(t, F.col("x.item_id").alias(item), F.col("x.item_text").alias(body))
    judged = docs.join(found, F.xxhash64(F.col("text").cast("string")) == F.col(t), "left").drop(t)
    return judged.mapInArrow(lean(_clean_pairs, names=(item, body), columns=docs.columns), docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
