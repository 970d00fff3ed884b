"""What must not grow with the tables: memory of a task, and work done twice."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lexaquarry.functions.batches import pieces
from lexaquarry.operators import chunking, embedding, fulltext, records


def test_batches_come_in_pieces():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 3, 30, 1, 1)] + [None], "i": list(range(7))})
    got = [p.column("i").to_pylist() for p in pieces([batch, batch.slice(3)], "text", 8, 3)]
    assert got == [[0, 1, 2], [3], [4, 5, 6], [3], [4, 5, 6]]


def test_python_objects_are_made_of_few_rows():
    """Sectioning and embedding see a piece of a batch at a time."""
    seen = []

    class Plain:
        fingerprint = "plain"
        dimension = lambda self: 1

        def documents(self, texts):
            seen.append(sum(map(len, texts)))
            return [[1.0] for _ in texts]

    text = "word " * 2000
    batch = pa.RecordBatch.from_pydict({"ref": [str(i) for i in range(3000)], "chunk_index": pa.array([0] * 3000, pa.int32()), "text": [text] * 3000})
    assert sum(b.num_rows for b in embedding._embed(iter([batch]), Plain(), 1, ["ref", "chunk_index"])) == 3000
    assert max(seen) <= 2 << 20
    rows = pa.RecordBatch.from_pydict({"ref": ["r"] * 600, "kind": ["k"] * 600, "title": ["t"] * 600, "body_format": ["plaintext"] * 600, "body_text": [text] * 600})
    sent = list(chunking._chunk(iter([rows]), chunking.Flat()))
    assert sum(b.num_rows for b in sent) == 600 and max(b.nbytes for b in sent) <= 5 << 20


def test_postings_in_order_of_terms(spark, tmp_path):
    """Parts follow the terms, a term of all chunks stands in several, and terms are counted without a shuffle."""
    rows = [(i, "k", "every", "", f"t{i % 50:02} t{i % 50:02} ü{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "chunk_id bigint, kind string, title string, heading string, text string")
    assert "Exchange" not in fulltext.postings(df)._jdf.queryExecution().executedPlan().toString()
    got = fulltext.sorted_postings(df, 400, part_rows=150).withColumn("part", F.spark_partition_id()).collect()
    want = Counter((w, r[0]) for r in rows for w in ("every", *r[4].replace("ü", "u").split()))
    assert {(r.term, r.chunk_id): r.tf for r in got} == want and len(got) == len(want) and {r.len for r in got} == {4}
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append((r.term, r.chunk_id))
    assert all(p == sorted(p) for p in parts.values()) and max(map(len, parts.values())) < 400
    assert sum(any(t == "every" for t, _ in p) for p in parts.values()) > 1
    ends = [(p[0][0], p[-1][0]) for _, p in sorted(parts.items())]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_rows_of_one_id_are_one_chunk(spark):
    df = spark.createDataFrame([(1, "k", "a", "", "b"), (1, "k", "a", "", "c"), (2, "k", "", "", "b b")], "chunk_id bigint, kind string, title string, heading string, text string")
    got = sorted((r.chunk_id, r.term, r.tf, r.len) for r in fulltext.merged_postings(df).collect())
    assert got == [(1, "a", 2, 2), (1, "b", 1, 2), (1, "c", 1, 2), (2, "b", 2, 2)]


def test_records_are_put_in_order_before_they_are_hashed(spark):
    df = spark.createDataFrame([(f" r{i % 9}{i} ", "text") for i in range(50)], "ref string, body_text string")
    plan = records.validated(records.in_order(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and plan.index("sha2") < plan.index("RepartitionByExpression")
    assert records.validated(records.in_order(df)).count() == 50
