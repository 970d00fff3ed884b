"""Chunks of records: sections by Markdown headings, token windows, and policies that choose between them.

The sectioning of one text is plain Python; ``chunk`` runs it in Arrow batches beside the data. A policy is any object
with ``sections(record) -> list[Section]``; it travels to the executors by value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import islice
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NO_PARENT, PLAINTEXT, TooManySections, section_cap
from ..functions.batches import PIECE_BYTES, pieces
from ..functions.text import WHITE, let, words

_IS_WHITE = np.isin(np.arange(max(map(ord, WHITE)) + 2), [ord(x) for x in WHITE])  #: its last stands for all letters beyond
_HEADING = re.compile(f"(#{{1,6}}) [{WHITE}]*([^{WHITE}].*)", re.S)


class Section(NamedTuple):
    heading: str
    body: str
    parent: int = NO_PARENT


class Record(NamedTuple):
    ref: str
    kind: str
    title: str
    body_format: str
    body_text: str


def heading_of(line: str) -> tuple[int, str] | None:
    """(level, text) of a heading line: one to six # and a blank, after any indentation, in code blocks too."""
    m = _HEADING.fullmatch(line.strip(WHITE))
    return (len(m[1]), m[2]) if m else None


def markdown_sections(title: str, body: str) -> Iterator[Section]:
    """Sections named by their path of headings; text before the first heading stands under the title, blank sections are
    left out, and a body of headings alone is one section."""
    body = body.replace("\r\n", "\n")
    path: list[tuple[int, str]] = []
    found = False
    lines = body.split("\n")
    heads = [(i, h) for i, x in enumerate(lines) if "#" in x and (h := heading_of(x))]
    starts = [(-1, None), *heads, (len(lines), None)]
    for (at, head), (end, _) in zip(starts, starts[1:]):
        if head:
            while path and path[-1][0] >= head[0]:
                path.pop()
            path.append(head)
        text = "\n".join(lines[at + 1 : end]).strip(WHITE)
        if text:
            found = True
            yield Section(" / ".join(x for _, x in path).strip(WHITE) or title.strip(WHITE), text)
    if not found and (text := body.strip(WHITE)):
        yield Section(title.strip(WHITE), text)


def split_section(section: Section, most: int, overlap: int = 0) -> list[Section]:
    """Windows of ``most`` words, each ``overlap`` words into the one before. A window starts at the start of its line
    unless a word of an earlier window stands there, so list marks and indentation stay. A section that fits, or an
    overlap that leaves no step, gives the section as it is."""
    overlap = max(0, overlap)
    if most <= 0 or overlap >= most:
        return [section]
    text = section.body
    if len(text) < 2 * most:  # at least a letter and a blank a word
        return [section]
    white = _IS_WHITE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_IS_WHITE) - 1)]
    edges = np.flatnonzero(np.diff(white, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) <= most:
        return [section]
    out = []
    for at in range(0, len(starts), most - overlap):
        last = min(at + most, len(starts)) - 1
        floor = int(ends[at - 1]) if at else 0
        begin = max(floor, text.rfind("\n", floor, int(starts[at])) + 1)
        part = text[begin : int(ends[last])].rstrip(WHITE)
        out.append(Section(section.heading, part.lstrip(WHITE) if at and begin == floor else part, section.parent))
        if last == len(starts) - 1:
            break
    return out


def _capped(sections: Iterator[Section], cap: int | None, ref: str) -> list[Section]:
    """The cap is met while sections are made, so a hostile text can't fill memory."""
    if cap is None:
        return list(sections)
    out = list(islice(sections, cap + 1))
    if len(out) > cap:
        raise TooManySections(f"record {ref!r} has more than {cap} sections")
    return out


class Policy(Protocol):
    def sections(self, record: Record) -> list[Section]: ...


@dataclass(frozen=True)
class Flat:
    """Sections without parents: by headings for Markdown, the whole text otherwise; long ones in windows of words."""

    max_tokens: int = 0
    overlap: int = 0
    max_sections: int = -1

    def sections(self, record: Record) -> list[Section]:
        cap = section_cap(self.max_sections)
        if record.body_format == PLAINTEXT:
            text = record.body_text.strip(WHITE)
            first = iter([Section(record.title, text)] if text else [])
        else:
            first = iter(_capped(markdown_sections(record.title, record.body_text), cap, record.ref))
        return _capped((y for x in first for y in split_section(x, self.max_tokens, self.overlap)), cap, record.ref)


@dataclass(frozen=True)
class Late:
    """Each section is a parent, kept for context only, and its windows are children that get embedded. A section of one
    window has no children and is embedded itself."""

    child_tokens: int
    parent_tokens: int = 0
    child_overlap: int = 0
    max_sections: int = -1

    def sections(self, record: Record) -> list[Section]:
        if self.child_tokens <= 0:
            raise ValueError("late chunking needs child_tokens above 0")
        parents = Flat(self.parent_tokens, 0, self.max_sections).sections(record)

        def every() -> Iterator[Section]:
            at = 0
            for p in parents:
                yield p
                children = split_section(p, self.child_tokens, self.child_overlap)
                if len(children) > 1:
                    yield from (c._replace(parent=at) for c in children)
                    at += len(children)
                at += 1

        return _capped(every(), section_cap(self.max_sections), record.ref)


@dataclass(frozen=True)
class ByKind:
    """Another policy for each kind of record."""

    kinds: dict[str, Policy] = field(default_factory=dict)
    default: Policy | None = None

    def sections(self, record: Record) -> list[Section]:
        policy = self.kinds.get(record.kind) or self.default
        if policy is None:
            raise ValueError(f"no policy for kind {record.kind!r}")
        return policy.sections(record)


def policy_of(policy: Policy | None, max_tokens: int = 0, overlap: int = 0, max_sections: int = 0) -> Policy:
    """The given policy, or the flat one of these settings; both together are an error."""
    if policy is None:
        return Flat(max_tokens, overlap, max_sections)
    given = [n for n, x in (("max_tokens", max_tokens), ("overlap", overlap), ("max_sections", max_sections)) if x]
    if given:
        raise ValueError("a policy was given together with " + ", ".join(given))
    return policy


_BATCH = 4096


def check_lineage(sections: list[Section], ref: str) -> None:
    """Parents stand before their children."""
    for i, x in enumerate(sections):
        if not (x.parent == NO_PARENT or 0 <= x.parent < i):
            raise ValueError(f"record {ref!r}: section {i} has parent {x.parent}")


CHUNKS = "ref string, kind string, title string, chunk_index int, heading string, content string, parent_index int, is_parent boolean"


def _chunk(batches: Iterator[pa.RecordBatch], policy: Policy) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_())
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    send = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    rows: list[tuple] = []
    held = 0
    for batch in pieces(batches, "body_text"):
        for x in zip(*(batch.column(c).to_pylist() for c in Record._fields)):
            record = Record(*x)
            sections = policy.sections(record)
            check_lineage(sections, record.ref)
            parents = {s.parent for s in sections}
            for i, s in enumerate(sections):
                rows.append((record.ref, record.kind, record.title, i, s.heading, s.body, s.parent, i in parents))
                held += len(s.body)
                if len(rows) >= _BATCH or held >= PIECE_BYTES:
                    yield send(rows)
                    rows, held = [], 0
    if rows:
        yield send(rows)


def chunk(records: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(ref, kind, title, chunk_index, heading, content, parent_index, is_parent) of normalized records; parent_index is -1
    for roots. A record's sections are made in one task, so nothing is shuffled to find the parents."""
    return records.select(*Record._fields).mapInArrow(partial(_chunk, policy=policy_of(policy)), CHUNKS)


def mark_parents(chunks: DataFrame) -> DataFrame:
    """With ``is_parent``, for chunks from elsewhere: another chunk of the record names this one. Such chunks are neither
    embedded nor searched."""
    from pyspark.sql.window import Window

    parents = F.collect_set("parent_index").over(Window.partitionBy("ref"))
    return chunks.withColumn("is_parent", F.array_contains(parents, F.col("chunk_index")))


def lineage_violations(chunks: DataFrame) -> DataFrame:
    """Chunks whose parent isn't an earlier chunk of the same record."""
    p = chunks.select(F.col("ref").alias("r"), F.col("chunk_index").alias("p"))
    lost = chunks.filter(f"parent_index <> {NO_PARENT}").join(p, (F.col("ref") == F.col("r")) & (F.col("parent_index") == F.col("p")), "left")
    return lost.filter("p is null or parent_index >= chunk_index").select("ref", "chunk_index", "parent_index")


def word_windows(text: Column, most: int, overlap: int = 0) -> Column:
    """Windows of words as arrays, for counts and statistics that need no exact white space."""
    step = most - max(0, overlap)
    if most <= 0 or step <= 0:
        return F.array(words(text))

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - most) / step)).cast("int")
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * step + 1, most))).otherwise(F.array().cast("array<array<string>>"))

    return let(words(text), cut)
