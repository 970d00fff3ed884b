import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaquarry.constants import BINARY, FLOAT32, INT8
from lexaquarry.functions import vectors as V
from lexaquarry.operators import search


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, f"r{i % 50:03d}", rng.choice("xyz"), i, [float(np.float32(rng.gauss(0, 1))) for _ in range(16)]) for i in range(300)]
    rows += [(1000, "r000", "x", 0, rows[5][4]), (1001, "r000", "x", 0, rows[5][4]), (1002, "z", "x", 0, [0.0] * 16), (1003, "z", "y", 0, [-v for v in rows[5][4]])]
    df = spark.createDataFrame(rows, "chunk_id bigint, ref string, kind string, chunk_index int, embedding array<float>")
    return df, rows


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 1 - sum(x * y for x, y in zip(a, b)) / n if n else 1.0


def brute(rows, q, k, kinds=None, rough=None):
    rows = [r for r in rows if kinds is None or r[2] in kinds]
    if rough:
        rows = sorted(rows, key=lambda r: (rough(r[4]), r[0]))[: 3 * k]
    return [r[0] for r in sorted(rows, key=lambda r: (round(cosine(q, r[4]), 12), r[1], r[3], r[0]))[:k]]


def ids(df):
    return [r.chunk_id for r in df.collect()]


def test_full_and_kinds(table):
    df, rows = table
    q = rows[5][4]
    assert ids(search.nearest(df, q, 12)) == brute(rows, q, 12)
    assert ids(search.nearest(df, q, 12, kinds=[" y"])) == brute(rows, q, 12, {"y"})
    assert ids(search.nearest(df, q, 12, kinds=[""])) == []
    last = search.nearest(df, q, 1000).collect()
    assert len(last) == len(rows) and last[-1].chunk_id == 1003 and last[-1].score == 0.0 and {r.chunk_id: r.score for r in last}[1002] == 0.0
    assert last[0].score == pytest.approx(1.0)


def test_two_stages(table):
    df, rows = table
    q = rows[9][4]
    assert ids(search.nearest(df, q, 7, dimension=4)) == brute(rows, q, 7, rough=lambda v: round(cosine(q[:4], v[:4]), 12))
    signed = df.withColumn("bits", V.to_bits(F.col("embedding")))
    sign = lambda v: sum((x >= 0) != (y >= 0) for x, y in zip(q, v))
    assert ids(search.nearest(signed, q, 7, mode=BINARY)) == brute(rows, q, 7, rough=sign)
    assert ids(search.nearest(signed, q, 7, ["z"], BINARY)) == brute(rows, q, 7, {"z"}, sign)


def test_few_of_a_kind_are_found(spark):
    """A kind filter stands below the limit: one target among many nearer others."""
    rows = [(i, f"n{i}", "noise", 0, [1.0, 0.001 * i] * 4) for i in range(50)] + [(99, "t", "note", 0, [-1.0, 1.0] * 4)]
    df = spark.createDataFrame(rows, "chunk_id bigint, ref string, kind string, chunk_index int, embedding array<float>")
    q = [1.0, 0.0] * 4
    bits = df.withColumn("bits", V.to_bits(F.col("embedding")))
    small = df.withColumn("embedding", V.to_int8(F.col("embedding")))
    for d, mode, dim in ((df, FLOAT32, 0), (df, FLOAT32, 2), (bits, BINARY, 0), (small, INT8, 0)):
        assert ids(search.nearest(d, q, 1, ["note"], mode, dim)) == [99]


def test_many_queries(spark, table):
    df, rows = table
    queries = spark.createDataFrame([(r[0], r[4]) for r in rows[:40]] + [(1002, [0.0] * 16)], "query_id bigint, embedding array<float>")
    for limit in (search.QUERY_BYTES, 1000):
        got = {}
        for r in search.nearest_of_many(df, queries, 9, query_bytes=limit).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
        for r in rows[:40]:
            assert [c for _, c in sorted(got[r[0]])] == brute(rows, r[4], 9)
            assert [n for n, _ in sorted(got[r[0]])] == list(range(9))
        assert len(got[1002]) == 9
    none = spark.createDataFrame([], "query_id bigint, embedding array<float>")
    assert search.nearest_of_many(df, none, 3).collect() == []


def test_codecs(spark):
    v = [0.5, -0.25, 0.0, 1.0, -1.0, 2.5, -0.0, 3.0]
    assert V.unpack(V.pack(v)) == v and len(V.pack(v)) == 32
    assert V.unpack(V.pack(v, BINARY), BINARY) == [1.0, -1.0, 1.0, 1.0, -1.0, 1.0, 1.0, 1.0] and len(V.pack(v, BINARY)) == 1
    n = math.sqrt(sum(x * x for x in v))
    assert V.unpack(V.pack(v, INT8), INT8) == [math.copysign(math.floor(abs(x) / n * 127 + 0.5), x) / 127 + 0.0 for x in v]
    for bad in (lambda: V.unpack(b"123"), lambda: V.pack([1.0] * 7, BINARY), lambda: V.check_dimension(FLOAT32, 0)):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([(v,), ([0.0] * 8,)], "v array<double>")
    a, z = df.select(V.to_int8(F.col("v")).alias("i"), V.from_bits(V.to_bits(F.col("v")), 8).alias("b")).collect()
    assert [x / 127 for x in a.i] == V.unpack(V.pack(v, INT8), INT8) and a.b == V.unpack(V.pack(v, BINARY), BINARY)
    assert z.i == [0] * 8 and z.b == [1.0] * 8
