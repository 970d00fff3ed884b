"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs (lines), inner nodes sections, the root the document. A section ends behind each paragraph whose
hash starts with one of two hexadecimal digits (one in eight), so an edit moves at most the bounds of its own sections and
other sections keep their hashes. Leaf, section and root hashes are SHA-256 with a mark of their level in front, so a
node of one level can't pass for one of another. Equal roots mean equal texts; where roots differ, only sections that
differ have to be opened to find the paragraphs that do.

All hashing is built-in functions within the scan's own stage; what is shuffled and compared are 128 bits of each hash.
Where roots differ, the nodes of a document that its base lacks are found by look-ups in a set, in time proportional to
both documents; the built-in functions on arrays would compare each node with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, materialize, table

LEAF, SECTION, ROOT = "p", "s", "d"
ENDS = ("0", "1")  #: first digits of a paragraph's hash that end a section
WEIGHT = 1 << 32  #: of a node that one row holds


def _ends(h: Column) -> Column:
    return F.substring(h, 1, 1).isin(*ENDS)


def merkle_trees(docs: DataFrame) -> DataFrame:
    """(doc_id, root, leaves, bounds, sections) of each document: hashes of the paragraphs, index behind each section's
    last paragraph, hashes of the sections.

    A null text has no row; an empty text is one empty paragraph. Null doc_ids and repeated rows are kept. Other columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    leaves = docs.select("doc_id", F.transform(F.split("text", "\n", -1), lambda p: F.sha2(F.concat(F.lit(LEAF), p), 256)).alias("leaves"))
    last = F.size("leaves")
    bounds = leaves.withColumn("bounds", F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | _ends(F.element_at("leaves", i))))
    sections = bounds.withColumn(
        "sections",
        F.transform("bounds", lambda b, i: F.sha2(F.concat(F.lit(SECTION), F.array_join(F.slice("leaves", F.when(i == 0, 1).otherwise(F.get("bounds", i - 1) + 1), b - F.when(i == 0, 0).otherwise(F.get("bounds", i - 1))), "")), 256)),
    )
    return sections.select("doc_id", F.sha2(F.concat(F.lit(ROOT), F.array_join("sections", "")), 256).alias("root"), "leaves", "bounds", "sections")


COMPARED = "doc_id bigint, root string, paragraphs bigint, sections bigint, base_id bigint, equal boolean, changed_sections string, changed_paragraphs string"
_SAME = ["doc_id", "root", "paragraphs", "sections", "base_id", "equal"]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows in a row, and where each row's begin (one longer). A null row has none."""
    return np.array(column.flatten().to_pylist(), object), np.r_[0, np.cumsum(np.diff(np.asarray(column.offsets)) * np.asarray(column.is_valid()))]


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 1-based places of the sections, and of the paragraphs inside those, that the base lacks. Rows that need no
    comparison come without the base's nodes."""
    for batch in batches:
        nodes = {c: _lists(batch.column(c)) for c in ("own", "leaves", "bounds", "theirs", "their_leaves")}
        part = lambda c, i: nodes[c][0][nodes[c][1][i] : nodes[c][1][i + 1]]  # noqa: E731, B023
        changed: list[list[str]] = [[], []]
        for i in range(batch.num_rows):
            cs, cp = [], []
            have = set(part("theirs", i))
            if have:
                lines, bounds, known = part("leaves", i), part("bounds", i), set(part("their_leaves", i))
                for j, h in enumerate(part("own", i)):
                    if h not in have:
                        cs.append(j + 1)
                        cp += [k + 1 for k in range(bounds[j - 1] if j else 0, bounds[j]) if lines[k] not in known]
            changed[0].append(",".join(map(str, cs)))
            changed[1].append(",".join(map(str, cp)))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in _SAME] + [pa.array(x, pa.string()) for x in changed], names=[x.split()[0] for x in COMPARED.split(", ")])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, root, paragraphs, sections, base_id, equal, changed_sections, changed_paragraphs) of each document.

    base_id is the smallest doc_id that shares the section which most ties the two: of the document's sections of at
    least two paragraphs (or its only section), the one whose first holder is smallest. It is the document itself where no
    earlier one shares a section. equal tells whether the roots agree; the changed columns are the 1-based places of
    sections, and of paragraphs inside those sections, that the base lacks, joined by commas.

    Null texts give no row, empty ones are one empty paragraph, very long ones are compared whole. A null doc_id has itself
    as base (null) and is no other's. Repeated rows are repeated; if one doc_id has several texts, its base is sought for
    each, and as a base it stands with its smallest root. Other columns, of whatever name, are ignored. Empty tables give no
    rows.
    """
    trees = _short_trees(docs)
    places = trees.select("doc_id", "root", F.posexplode("sections").alias("i", "h"), F.size("sections").alias("n"), "bounds").withColumn("long", F.get("bounds", F.col("i")) - F.when(F.col("i") == 0, 0).otherwise(F.get("bounds", F.col("i") - 1)))
    places = places.filter("long > 1 or n = 1").select("doc_id", "root", "h")
    first = places.groupBy("h").agg(F.min("doc_id").alias("base_id"))
    base = places.join(first, "h").groupBy("doc_id", "root").agg(F.min("base_id").alias("base_id"))
    return _compared(trees, base)


def document_bases(docs: DataFrame) -> DataFrame:
    """The columns of ``document_fingerprints``, with bases sought on all levels of the tree: root, sections, paragraphs.

    base_id is the smallest doc_id of an equal text where that is an earlier document. Else, of the earlier documents that
    are the first to hold one of the document's sections or paragraphs, it is the one whose shared nodes weigh most, a node
    that n rows hold weighing 1 / n; of equals the smallest. So lines that many documents have come last, but where nothing
    else ties a document they do. It is the document itself where no earlier one shares a paragraph.

    Nulls, repeated rows, several texts of one doc_id and empty tables are taken as there.
    """
    trees = _short_trees(docs)
    first = trees.groupBy("root").agg(F.min("doc_id").alias("equal_id"))
    equal = trees.filter("doc_id is not null").select("doc_id", "root").distinct().join(first.filter("equal_id is not null"), "root").filter("equal_id < doc_id")
    # a node stands once a document; the mark of its level is part of its hash
    nodes = trees.filter("doc_id is not null").select("doc_id", "root", F.explode(F.array_distinct(F.concat("sections", "leaves"))).alias("h"))
    holders = nodes.groupBy("h").agg(F.min("doc_id").alias("base_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = nodes.join(holders, "h").filter("base_id < doc_id")
    # whole numbers, as sums of fractions depend on their order
    weights = shared.groupBy("doc_id", "root", "base_id").agg(F.sum(F.expr(f"greatest(1L, {WEIGHT}L div n)")).alias("weight"))
    near = weights.groupBy("doc_id", "root").agg(F.max(F.struct("weight", F.bitwise_not("base_id").alias("turned"))).alias("x")).select("doc_id", "root", F.bitwise_not("x.turned").alias("near_id"))  # of equals the smallest
    return _compared(trees, near.join(equal, ["doc_id", "root"], "full").select("doc_id", "root", F.coalesce("equal_id", "near_id").alias("base_id")))


def _short_trees(docs: DataFrame) -> DataFrame:
    """The trees; what is compared travels as 128 bits of each hash."""
    short = lambda h: F.unhex(F.substring(h, 1, 32))
    return materialize(merkle_trees(docs).withColumns({"root": F.unhex("root"), "leaves": F.transform("leaves", short), "sections": F.transform("sections", short)}), "trees")


def _compared(trees: DataFrame, base: DataFrame) -> DataFrame:
    """Each tree against that of its base; a document that ``base`` lacks is its own."""
    base = base.filter("doc_id is not null")
    bases = base.filter("base_id <> doc_id").select(F.col("base_id").alias("doc_id")).distinct()
    head = trees.join(bases, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("base_id")).agg(F.min(F.struct("root", "sections", "leaves")).alias("b"))
    # a null doc_id meets no row of base and so keeps itself
    found = trees.join(base, ["doc_id", "root"], "left").withColumn("base_id", F.coalesce("base_id", "doc_id"))
    out = found.join(head, "base_id", "left").withColumn("equal", F.coalesce("b.root", "root") == F.col("root"))
    only = lambda c: F.when(~F.col("equal"), F.col(c))
    rows = out.select(
        "doc_id", F.lower(F.hex("root")).alias("root"), F.size("leaves").cast("bigint").alias("paragraphs"), F.size("sections").cast("bigint").alias("sections"), "base_id", "equal",
        only("sections").alias("own"), only("leaves").alias("leaves"), only("bounds").alias("bounds"), only("b.sections").alias("theirs"), only("b.leaves").alias("their_leaves"),
    )
    return rows.mapInArrow(lean(_changes), COMPARED)


def op2_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_bases(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, i, sha256('p' || p) AS h FROM p
), e AS (
  SELECT *, coalesce(sum(CASE WHEN h[1] IN ('0', '1') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l
), n AS (
  SELECT doc_id, s, sha256('s' || string_agg(h, '' ORDER BY i)) AS h, count(*) AS long FROM e GROUP BY ALL
), d AS (
  SELECT doc_id, sha256('d' || string_agg(h, '' ORDER BY s)) AS root, count(*) AS sections, sum(long)::BIGINT AS paragraphs FROM n GROUP BY ALL
), u AS (
  SELECT n.doc_id, n.h FROM n JOIN d USING (doc_id) WHERE long > 1 OR sections = 1
), f AS (
  SELECT h, min(doc_id) AS base_id FROM u GROUP BY h
), b AS (
  SELECT d.doc_id, coalesce(min(f.base_id), d.doc_id) AS base_id FROM d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN f ON f.h = u.h GROUP BY d.doc_id
), cs AS (
  SELECT n.doc_id, n.s FROM n JOIN b USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.doc_id = b.base_id AND m.h = n.h)
), cp AS (
  SELECT e.doc_id, e.i FROM e JOIN cs USING (doc_id, s) JOIN b USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.doc_id = b.base_id AND m.h = e.h)
)
SELECT d.doc_id, d.root, d.paragraphs, d.sections, b.base_id, d.root = r.root AS equal,
  coalesce((SELECT string_agg((s + 1)::BIGINT::VARCHAR, ',' ORDER BY s) FROM cs WHERE cs.doc_id = d.doc_id), '') AS changed_sections,
  coalesce((SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM cp WHERE cp.doc_id = d.doc_id), '') AS changed_paragraphs
FROM d JOIN b USING (doc_id) JOIN d r ON r.doc_id = b.base_id
"""
