"""Many queries at once: what a task holds, and ties."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexaquarry.operators import search


def test_pairs_are_scored_in_blocks(spark, monkeypatch):
    """Many queries against many vectors, ties of equal vectors included, without a matrix of all of both."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(1500, 8)), 1).astype(np.float32)
    x[700:720], x[5] = x[3], 0
    rows = [(i, f"r{i % 7}", i % 3, x[i].tolist()) for i in range(len(x))]
    batch = pa.RecordBatch.from_pylist([{"asks": a, "id": i, "ref": r, "chunk_index": p, "embedding": e} for a in (True, False) for i, r, p, e in rows], pa.schema([("asks", pa.bool_()), ("id", pa.int64()), ("ref", pa.string()), ("chunk_index", pa.int32()), ("embedding", pa.list_(pa.float32()))]))
    most = []
    product = np.nonzero
    monkeypatch.setattr(search.np, "nonzero", lambda m: (most.append(m.shape), product(m))[1])
    got = [tuple(r.values()) for b in search._cell(iter([batch]), 4) for r in b.to_pylist()]
    y = x.astype(float)
    n = np.sqrt(search._in_order(y, y))
    want = []
    for i in range(len(y)):
        s = n[i] * n
        d = np.where(s > 0, 1 - search._in_order(np.broadcast_to(y[i], y.shape), y) / np.where(s > 0, s, 1), 1.0)
        want += [(i, c, r, p, z) for z, r, p, c in sorted((float(z), r, p, c) for z, (c, r, p, _) in zip(d, rows))[:4]]
    assert got == want
    most = [m for m in most if len(m) == 2]
    assert max(a for a, _ in most) <= search.QUERY_BLOCK and max(b for _, b in most) <= search.VECTOR_BLOCK
    df = spark.createDataFrame(rows, "chunk_id bigint, ref string, chunk_index int, embedding array<float>")
    monkeypatch.setattr(search, "LEAST_GROUP", 400)
    monkeypatch.setattr(search.np, "nonzero", product)
    many = search.nearest_of_many(df, df.select(F.col("chunk_id").alias("query_id"), "embedding"), 4)
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.distance) for r in many.collect()) == [(q, i % 4, c, d) for i, (q, c, _, _, d) in enumerate(want)]


def test_groups_of_pairs_are_bounded():
    r, c = search._grid(615_000, 615_000, 256, search.QUERY_BYTES, 36)
    assert 615_000 * 256 / min(r, c) <= search.QUERY_BYTES and r * c >= 36
    assert search._grid(10, 10, 256, search.QUERY_BYTES, 36) == (1, 1) and search._grid(0, 5, 256, 1000, 9) == (1, 2)
