"""SentencePiece encoding and decoding with a given model, by a relational lattice.

A text becomes units that no piece crosses: a run of blanks with the run of letters, or of other characters, behind it
(checked against the model's pieces; a model whose pieces do cross falls back to units between blanks). The lattice of
the corpus's units is relational: every unit explodes into its substrings of bounded length, an equi-join with the piece
table keeps those that are pieces, and the edges are grouped by unit. A fold with ``aggregate`` then finds the pieces:

* unigram models: Viterbi, the best sum of scores up to each position;
* BPE models: Viterbi over scores gives wrong pieces, as BPE takes the best merge first instead of the best sum, so the
  fold merges: the state is the set of bounds as a bit mask, and each step removes the bound inside the best edge that
  joins two neighbours. Same lattice, same join, another fold.

Encoding then is a look-up. The dictionary of encoded units is broadcast as arrays, the most frequent units first, up to
DICTIONARY_BYTES; units that occur once, that don't fit, or are longer than LONGEST are encoded in place by the same
rule, so the result doesn't depend on the dictionary. Documents are read twice and never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import Letters, Words, bytes_of, char_table, slices
from ._shared import lean, materialize, Shared, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
LEAST_COUNT = 2
LONGEST = 60
DICTIONARY_BYTES = 64 << 20
LETTERS = f"{BLANK}*\\p{{L}}+|{BLANK}*[^\\p{{L}}{BLANK}]+|{BLANK}+"
BLANKS = f"{BLANK}*[^{BLANK}]+|{BLANK}+"


class Pieces:
    """A model's pieces: ids and scores by text, bytes by id, the id of each byte or of the unknown piece."""

    def __init__(self, pieces: list[tuple[str, float, str]], bpe: bool):
        """pieces: (text, score, kind) by id, kind one of piece, byte, control, unknown."""
        self.bpe = bpe
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == "piece"}
        self.scores = {p: s for p, s, k in pieces if k == "piece"}
        self.bytes = [bytes([int(p[3:5], 16)]) if k == "byte" else p.encode() if k == "piece" else b"" for p, _, k in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b == BLANK != a for a, b in pairs):
            raise ValueError("pieces with a blank behind another character aren't supported")
        self.unit = LETTERS if all(a.isalpha() == b.isalpha() for a, b in pairs if a != BLANK) else BLANKS
        floor = min(self.scores.values(), default=0.0)
        self.unknown_score = floor - 10

    @staticmethod
    def load(path: str) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(m.serialized_model_proto())
        n, t = proto.normalizer_spec, proto.trainer_spec
        if n.name != "identity" or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalization, with a blank in front, are supported")
        kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "piece"
        return Pieces([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())], t.model_type == t.BPE)

    def _spell(self, text: str) -> list[int]:
        """Ids of a piece of text, or of its bytes where it is none."""
        if text in self.ids:
            return [self.ids[text]]
        return [self.byte_ids[b] for b in text.encode()] if self.byte_ids else [self.unknown]

    def encode_unit(self, unit: str) -> list[int]:
        return self._merge(unit) if self.bpe else self._viterbi(unit)

    def _merge(self, unit: str) -> list[int]:
        n = len(unit)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins here
        alive = [True] * n
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = ends[a]
            if b < n:
                x = unit[a : ends[b]]
                if len(x) <= self.longest and x in self.scores:
                    heapq.heappush(heap, (-self.scores[x], a, ends[a], ends[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not alive[a] or ends[a] != b or b >= n or not alive[b] or ends[b] != c:
                continue
            alive[b], ends[a] = False, c
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        a = 0
        while a < n:
            out += self._spell(unit[a : ends[a]])
            a = ends[a]
        return out

    def _viterbi(self, unit: str) -> list[int]:
        best: list[tuple[float, int]] = [(0.0, -1)]
        for e in range(1, len(unit) + 1):
            options = [(best[s][0] + self.scores[x], s) for s in range(max(0, e - self.longest), e) if (x := unit[s:e]) in self.scores]
            if unit[e - 1] not in self.scores:
                options.append((best[e - 1][0] + self.unknown_score, e - 1))
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        out: list[list[int]] = []
        e = len(unit)
        while e:
            s = best[e][1]
            out.append(self._spell(unit[s:e]))
            e = s
        return [i for x in reversed(out) for i in x]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace").replace(BLANK, " ")
        return text.removeprefix(" ")


def prepared(text: Column) -> Column:
    """The text as the model sees it: blanks marked, one in front."""
    return F.when(text == "", "").otherwise(F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK))))


def units(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, count) of the documents."""
    return docs.select(F.explode(F.regexp_extract_all(prepared(F.col("text")), F.lit(pieces.unit), F.lit(0))).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("count"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(p, i, float(pieces.scores[p])) for p, i in pieces.ids.items()], "piece string, id int, score double")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, edges): all pieces in each unit of column ``unit`` by start, as structs (s, e, id, score). The piece table
    has the size of the model, whatever the corpus, so it is broadcast; the edges stay in the partition of their unit."""
    n = F.length("unit")
    # merges start from single characters, so edges of one character only matter where sums are compared
    least = 2 if pieces.bpe else 1
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - least), lambda s: F.transform(F.sequence(F.lit(least), F.least(F.lit(pieces.longest), n - s)), lambda k: F.struct(s.alias("s"), (s + k).alias("e"), F.substring(F.col("unit"), s + 1, k).alias("piece")))))
    edges = words.filter(n >= least).select("unit", F.explode(spans).alias("x")).select("unit", "x.s", "x.e", "x.piece").join(F.broadcast(piece_table(words.sparkSession, pieces)), "piece")
    return edges.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("s", "e", "id", "score"))).alias("edges")).withColumn("n", F.length("unit"))


def merge_fold(n: Column, edges: Column) -> Column:
    """Bounds of a unit's pieces by best merges, as a bit mask (bit p: a piece begins or the unit ends at p).

    Best edges first, of equals the leftmost: an edge between two bounds with one bound inside joins two neighbours. As a
    rule a merge only makes room for worse edges, so one pass suffices; an edge that was passed with several bounds inside
    could still be joined later, and units with such an edge are folded by searching the best edge again each time."""
    one = F.lit(1).cast("bigint")
    bit = lambda p: F.call_function("shiftleft", one, p)
    masks = F.transform(F.filter(edges, lambda x: x["e"] - x["s"] > 1), lambda x: F.struct(x["score"].alias("score"), (-x["s"]).alias("left"), (bit(x["s"]) + bit(x["e"])).alias("ends"), (bit(x["e"]) - bit(x["s"] + 1)).alias("inner")))
    ordered = F.reverse(F.array_sort(masks))
    odd = F.lit(1 << 62).cast("bigint")
    whole = bit(n + 1) - 1

    def once(bounds: Column, x: Column) -> Column:
        inside = bounds.bitwiseAND(x["inner"])
        return F.when(bounds.bitwiseAND(x["ends"]) != x["ends"], bounds).when(F.bit_count(inside) == 1, bounds.bitwiseXOR(inside)).when(inside != 0, bounds.bitwiseOR(odd)).otherwise(bounds)

    def best(masks: Column, bounds: Column) -> Column:
        inner = F.aggregate(masks, F.lit(0).cast("bigint"), lambda got, x: F.when((got == 0) & (bounds.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(bounds.bitwiseAND(x["inner"])) == 1), x["inner"]).otherwise(got))
        return bounds.bitwiseAND(F.bitwise_not(inner))

    def fold(masks: Column) -> Column:
        passed = F.aggregate(masks, whole, once)
        again = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), whole, lambda bounds, _: best(masks, bounds))
        return let(passed, lambda b: F.when(b < odd, b).otherwise(again))

    return let(ordered, fold)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def viterbi_fold(n: Column, edges: Column, unknown_score: float) -> Column:
    """Bounds of a unit's pieces by the best sum of scores, as a bit mask; of equal sums the longest last piece."""
    one = F.lit(1).cast("bigint")
    start = F.array(F.struct(F.lit(0.0).cast("double").alias("score"), one.alias("bounds")))

    def grow(best: Column, e: Column) -> Column:
        into = F.filter(edges, lambda x: x["e"] == e)
        options = F.transform(into, lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("left"), x["s"].alias("s")))
        unknown = F.struct((F.get(best, e - 1)["score"] + unknown_score).alias("score"), (1 - e).alias("left"), (e - 1).alias("s"))
        top = F.array_max(F.when(F.exists(into, lambda x: x["s"] == e - 1), options).otherwise(F.array_append(options, unknown)))
        return F.array_append(best, F.struct(top["score"].alias("score"), F.get(best, top["s"])["bounds"].bitwiseOR(F.call_function("shiftleft", one, e)).alias("bounds")))

    return F.get(F.aggregate(F.sequence(F.lit(1), n), start, grow), n)["bounds"]


def encoded_units(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of the units of column ``unit`` (distinct, of 1 to LONGEST characters)."""
    found = words.select("unit").distinct() if words.columns != ["unit"] else words
    rows = lattice(found, pieces)
    if pieces.bpe:
        bounds = rows.withColumn("bounds", merge_fold(F.col("n"), F.col("edges")))
    else:
        bounds = rows.withColumn("bounds", viterbi_fold(F.col("n"), F.col("edges"), pieces.unknown_score))
    one = F.lit(1).cast("bigint")
    bit = lambda p: F.call_function("shiftleft", one, p)
    ends = lambda x: bit(x["s"]) + bit(x["e"])
    used = F.filter("edges", lambda x: (F.col("bounds").bitwiseAND(ends(x)) == ends(x)) & (F.col("bounds").bitwiseAND(bit(x["e"]) - bit(x["s"] + 1)) == 0))
    return bounds.select("unit", F.transform(used, lambda x: F.struct(x["s"], x["e"], x["id"])).alias("path"))


class Dictionary:
    """Encoded units as arrays: sorted hashes, where the ids of each begin (one longer), the ids one after the other."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        starts = np.cumsum(sizes) - sizes
        sizes = sizes[order]
        self.hashes, self.ids = hashes[order], ids[_lay(starts[order], sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def arrays(self) -> tuple:
        return self.hashes, self.starts, self.ids

    @classmethod
    def of(cls, arrays: tuple) -> "Dictionary":
        d = cls.__new__(cls)
        d.hashes, d.starts, d.ids = arrays
        return d


def _compact(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    """Encoded units with hashes, their gaps (characters that are no piece) filled by bytes."""
    pieces = pieces.value
    for batch in batches:
        words = batch.column("unit")
        data, off = bytes_of(words)
        hashes, ids = Words.at(data, off[:-1], off[1:], off[:1]).hash, []
        for unit, path in zip(words.to_pylist(), batch.column("path").to_pylist()):
            out, at = [], 0
            for x in path:
                for c in unit[at : x["s"]]:
                    out += pieces._spell(c)
                out.append(x["id"])
                at = x["e"]
            for c in unit[at:]:
                out += pieces._spell(c)
            ids.append(np.array(out, np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids, pa.binary()), batch.column("count")], names=["h", "ids", "count"])


def build_dictionary(docs: DataFrame, pieces: Pieces, broadcast, limit: int = DICTIONARY_BYTES, least: int = LEAST_COUNT) -> Dictionary:
    """The dictionary of the documents' units that occur at least ``least`` times; of more than ``limit`` bytes the most
    frequent units."""
    words = materialize(units(docs, pieces).filter((F.col("count") >= least) & (F.length("unit") <= LONGEST) & ~F.col("unit").contains(" ")), "units")
    known = encoded_units(words.select("unit"), pieces).join(words, "unit", "right").withColumn("path", F.coalesce("path", F.expr("array()").cast("array<struct<s:int,e:int,id:int>>")))
    rows = materialize(known.select("unit", "path", "count").mapInArrow(lean(_compact, pieces=broadcast), "h bigint, ids binary, count bigint"), "dictionary")
    size = F.octet_length("ids") + 20
    if (rows.agg(F.sum(size)).first()[0] or 0) > limit:
        # the count from which on units fit: counts are few, so their histogram is small
        sums, fits = 0, None
        for count, bytes_ in rows.groupBy(F.floor(F.log2("count") * 8).alias("c")).agg(F.sum(size)).orderBy(F.desc("c")).collect():
            if sums + bytes_ > limit:
                break
            sums, fits = sums + bytes_, count
        rows = rows.filter(F.lit(False) if fits is None else F.floor(F.log2("count") * 8) >= fits)
    got = rows.select("h", "ids").toArrow()
    h = got.column("h").to_numpy().view(np.uint64) if got.num_rows else np.zeros(0, np.uint64)
    flat = [bytes_of_binary(c) for c in got.column("ids").chunks]
    sizes = np.concatenate([np.diff(o) // 4 for _, o in flat]) if flat else np.zeros(0, np.int64)
    ids = np.concatenate([np.frombuffer(d.tobytes(), np.uint32) for d, _ in flat]) if flat else np.zeros(0, np.uint32)
    return Dictionary(h.copy(), sizes, ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids)


def bytes_of_binary(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return bytes_of(x.cast(pa.large_binary()).view(pa.large_string()))


def _lay(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs (start, size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def cut_units(x: pa.Array, pieces: Pieces) -> Words:
    """The units of prepared texts: as the pattern ``pieces.unit`` finds them, but in whole arrays."""
    t = Letters(x)
    kind = char_table("letters", lambda c: 2 if c == BLANK else c.isalpha())[t.code]
    head = np.zeros(len(kind) + 1, bool)
    if pieces.unit == LETTERS:
        head[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
    else:
        head[1:-1] = (kind[1:] == 2) & (kind[:-1] != 2)
    head[t.row] = True
    head = np.flatnonzero(head[:-1])
    starts = t.start[head]
    return Words.at(t.data, starts, np.append(starts[1:], len(t.data)), np.searchsorted(head, t.row))


def encode_texts(texts: pa.Array, pieces: Pieces, words: Dictionary, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts, as one flat array."""
    texts = pc.fill_null(texts, "")
    empty = pc.equal(texts, "")
    x = pc.if_else(empty, "", pc.binary_join_element_wise(BLANK, pc.replace_substring(texts, " ", BLANK), ""))
    w = cut_units(x, pieces)
    names, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    at = np.searchsorted(words.hashes, names)
    at[at == len(words)] = 0
    known = words.hashes[at] == names if len(words) else np.zeros(len(names), bool)
    extra, sizes, starts = [], np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    starts[known] = words.starts[at[known]]
    sizes[known] = words.starts[at[known] + 1] - starts[known]
    base = len(words.ids)
    for i in np.flatnonzero(~known):
        out = pieces.encode_unit(w.data[w.starts[first[i]] : w.ends[first[i]]].tobytes().decode())
        starts[i], sizes[i] = base, len(out)
        base += len(out)
        extra += out
    every = np.concatenate([words.ids, np.array(extra, words.ids.dtype)]) if extra else words.ids
    ids = every[_lay(starts[back], sizes[back])].astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes[back])])[w.row]
    return ids, offsets


class Speller:
    """Bytes of the pieces as one array."""

    def __init__(self, pieces: Pieces):
        raw = [x.replace(BLANK.encode(), b" ") for x in pieces.bytes]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)


def decode_ids(ids: np.ndarray, offsets: np.ndarray, speller: Speller) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of flat ids, without the blank in front."""
    sizes = speller.sizes[ids]
    data = speller.data[_lay(speller.starts[ids], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    heads = ends[:-1][ends[1:] > ends[:-1]]
    drop = heads[data[heads] == 32]
    keep = np.ones(len(data), bool)
    keep[drop] = False
    gone = np.searchsorted(drop, ends)
    return data[keep], ends - gone


def _encode(batches: Iterator[pa.RecordBatch], pieces, words) -> Iterator[pa.RecordBatch]:
    pieces, words = pieces.value, Dictionary.of(words.value)
    speller = Speller(pieces)
    for batch in batches:
        for part in slices(batch, "text", 512 << 10):  # two tasks share an executor's memory with the JVM
            texts = part.column("text")
            ids, offsets = encode_texts(texts, pieces, words)
            data, ends = decode_ids(ids, offsets, speller)
            raw, off = bytes_of(pc.fill_null(texts, ""))
            same = np.diff(ends) == np.diff(off)
            if len(raw) == len(data) and same.all():
                wrong = np.concatenate([[0], np.cumsum(raw != data)])[off]
                same = np.diff(wrong) == 0
            else:
                same = np.array([raw[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(off, off[1:], ends, ends[1:])], bool)
            null = texts.is_null()
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            none = lambda x, t: pc.if_else(null, pa.scalar(None, t), x)
            if texts.null_count:
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=null)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), none(pa.array(np.diff(offsets)), pa.int64()), lists, none(pa.array(same), pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])


def _decode(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    speller = Speller(pieces.value)
    for batch in batches:
        lists = batch.column("ids")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        data, ends = decode_ids(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0], speller)
        texts = [None if not ok else data[a:b].tobytes().decode("utf-8", "replace") for ok, a, b in zip(lists.is_valid().to_pylist(), ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, model: str | Pieces = MODEL, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): the model's ids of each text, and whether they decode to the same text (texts
    that hold the blank's mark itself don't).

    A null text has nulls, an empty one no ids. A null doc_id and repeated rows are kept, other columns ignored; an empty
    table gives no rows.
    """
    pieces = Pieces.load(model) if isinstance(model, str) else model
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = Shared(docs.sparkSession, pieces)
    words = docs.sparkSession.sparkContext.broadcast(build_dictionary(docs, pieces, shared, dictionary_bytes).arrays())
    return docs.mapInArrow(lean(_encode, pieces=shared, words=words), "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str | Pieces = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids give a null text; ids of control pieces stand for nothing, bytes that are
    no UTF-8 become replacement characters; an id outside the model is an error."""
    pieces = Pieces.load(model) if isinstance(model, str) else model
    shared = Shared(encoded.sparkSession, pieces)
    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lean(_decode, pieces=shared), "doc_id bigint, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
