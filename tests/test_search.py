import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexaquarry.operators import context, fulltext, fusion

WORDS = "alpha beta gamma delta naïve über 42 error_code time out the".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(i + 1, rng.choice("xy"), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3))), rng.choice(WORDS), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id bigint, kind string, title string, heading string, text string")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, heading, text)")
    con.executemany("INSERT INTO t(rowid, title, heading, text) VALUES (?, ?, ?, ?)", [(r[0], *r[2:]) for r in rows])
    return fulltext.postings(df), fulltext.index_size(df), con, rows


@pytest.mark.parametrize("text", ["alpha", "alpha beta", "Naive UBER", "the the alpha", "error_code 42", "missing alpha", "gamma, delta! (out)"])
def test_ranks_like_fts5(corpus, text):
    index, size, con, rows = corpus
    terms = " AND ".join(f'"{t}"' for t in re.findall(r"[^\W_]+", text.lower()))
    want = [(r, -s) for r, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid LIMIT 20", (terms,))]
    got = [(r.chunk_id, r.score) for r in fulltext.search(index, text, size, 20).collect()]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9)
    assert {g[0] for g in got} == {w[0] for w in want} or math.isclose(got[-1][1], want[-1][1])
    kinds = {r[0]: r[1] for r in rows}
    few = fulltext.search(index, text, size, 300, ["x"]).collect()
    assert [r.chunk_id for r in few] == [r.chunk_id for r in fulltext.search(index, text, size, 300).collect() if kinds[r.chunk_id] == "x"]


def test_nothing_to_search(corpus):
    index, size, *_ = corpus
    assert fulltext.search(index, " .,! ", size, 5).collect() == []
    assert fulltext.search(index, "alpha", (0, 0), 5).collect() == []


def arm(spark, name, ids):
    return fusion.Arm(name, spark.createDataFrame([(c, i, 1.0 - i / 100) for i, c in enumerate(ids)], "chunk_id bigint, rank int, score double"))


def test_reciprocal_rank(spark):
    arms = [arm(spark, "v", [1, 2, 3, 4]), arm(spark, "f", [3, 9, 1])]
    got = fusion.ReciprocalRank().fuse(arms, 10).collect()
    want = {1: 1 / 61 + 1 / 63, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 4: 1 / 64, 9: 1 / 62}
    assert [r.chunk_id for r in got] == [1, 3, 2, 9, 4]  # ties: arms, best rank, id
    assert all(r.score == pytest.approx(want[r.chunk_id]) for r in got)
    assert {k: tuple(v) for k, v in got[1].provenance.items()} == {"v": (2, 0.98), "f": (0, 1.0)}
    assert len(fusion.ReciprocalRank(0).fuse(arms, 2).collect()) == 2 and fusion.ReciprocalRank().fuse(arms, 0).collect() == []


def test_one_arm_alone(spark):
    arms = [arm(spark, "v", [5, 6]), arm(spark, "f", [])]
    got = fusion.default_fusion().fuse(arms, 5).collect()
    assert [(r.chunk_id, r.score) for r in got] == [(5, 1.0), (6, 0.99)] and tuple(got[1].provenance["v"]) == (1, 0.99)
    assert fusion.ReciprocalRank().fuse(arms, 5).collect()[0].score == pytest.approx(1 / 61)
    assert [r.chunk_id for r in fusion.default_fusion().fuse([arms[0], fusion.Arm("f", available=False)], 5).collect()] == [5, 6]


def test_bad_arms(spark):
    ok = arm(spark, "v", [1])
    for bad in ([fusion.Arm("", ok.hits)], [ok, ok], [fusion.Arm("x", ok.hits, True, ValueError())], [fusion.Arm("x", ok.hits, False)]):
        with pytest.raises(ValueError):
            fusion.ReciprocalRank().fuse(bad, 5)
    with pytest.raises(RuntimeError):
        fusion.ReciprocalRank().fuse([ok, fusion.Arm("f", None, False, OSError("down"))], 5)


def test_rerank(spark):
    hits = spark.createDataFrame([(i, i) for i in range(10)], "chunk_id bigint, position bigint")
    assert [r.chunk_id for r in fusion.rerank(hits, lambda h: h.withColumn("position", -F.col("position")), 3).collect()] == [9, 8, 7]
    with pytest.raises(RuntimeError, match="reranker"):
        fusion.rerank(hits, lambda h: 1 / 0, 3)


def test_expand(spark):
    """A parent with three leaves, the next root behind them: windows go by chunk_index, within one parent."""
    chunks = spark.createDataFrame([(1, "r", 0, None), (2, "r", 1, 1), (3, "r", 2, 1), (4, "r", 3, 1), (5, "r", 4, None), (6, "s", 0, None), (7, "s", 1, 1)], "chunk_id bigint, ref string, chunk_index int, parent_chunk_id bigint")
    get = lambda hit, **o: [r.chunk_id for r in context.expand(chunks, spark.createDataFrame([(hit,)], "chunk_id bigint"), **o).orderBy("hit_id", "position").collect()]
    assert get(1, window=1) == [1] and get(1, window=4) == [1, 5]
    assert get(3, window=1, include_parent=True) == [1, 2, 3, 4] and get(2, window=1) == [2, 3]
    assert get(3, window=-5) == [3] and get(99, window=3) == []
    assert get(7, include_parent=True) == [7]  # a parent in another record is none
