import re

import pyarrow as pa
import sentencepiece

import corpus_pipeline
from lexaquarry.llm import decontamination, ngram_jaccard, sentencepiece_codec, substring_dedup, toxicity
from lexaquarry.llm._shared import materialize, release

from . import cases
from .test_decontamination import ITEMS
from .test_decontamination import brute as leaks
from .test_ngram_jaccard import brute as pairs
from .test_substring_dedup import brute as repeats
from .test_substring_dedup import words


def groups(rows):
    """The documents that stay: the smallest id of each component."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs(rows, ngram_jaccard.N, ngram_jaccard.THRESHOLD):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [(i, t) for i, t in rows if i is None or find(i) == i]


def cut(rows):
    spans = repeats(rows, substring_dedup.PASSAGE)
    out = []
    for i, t in rows:
        gone = {p for d, a, b, *_ in spans if d == i for p in range(a, b)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(words(t)):
            out.append((i, gone))
    return out


def test_stages_as_by_brute_force(spark, data):
    model = toxicity.fit(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))).value
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, ("toxic", "near", "cut", "leaks", "ids")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, data)
        if want != "ids":
            assert out.columns == names, name
        got = sorted((r.doc_id, r.ids if want == "ids" else r.text) for r in out.collect())
        if want == "toxic":
            scores = toxicity.score_texts(pa.array([t for _, t in rows]), model)
            assert got == sorted(r for r, s in zip(rows, scores) if s <= model[2])
        elif want == "near":
            assert got == sorted(groups(rows))
        elif want == "cut":
            expected = {i: t for i, t in cut(rows)}
            assert {i for i, _ in got} == set(expected)
            for i, t in got:
                whole = words(dict(rows)[i])
                assert t == expected[i] if isinstance(expected[i], str) else words(t) == [w for p, w in enumerate(whole) if p not in expected[i]]
            assert out.filter("n_chars <> length(text)").count() == 0
        elif want == "leaks":
            bad = {x[0] for x in leaks(rows, items)}
            assert got == sorted(r for r in rows if r[0] not in bad)
        else:
            m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
            assert got == sorted((i, m.encode(t)) for i, t in rows)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run_is_the_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, data).collect()))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeats and clashing columns, an empty table."""
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (cases.rough(1), []):
        docs = cases.documents(spark, rows)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert i == 4 or docs.columns == columns, name
        n = docs.count()
        assert n > 20 if rows else n == 0


def test_decontamination_catches_what_the_stage_keeps(spark, data):
    """After the stage no document leaks."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = corpus_pipeline.drop_benchmark(spark, docs, data)
    assert clean.count() < docs.count()
    assert decontamination.benchmark_leaks(clean, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(" ")))
    before = files()
    written = materialize(spark.range(1000).selectExpr("id % 7 AS x").groupBy("x").count(), "counts")
    assert written.count() == 7 and sum(r["count"] for r in written.collect()) == 1000
    assert len(files() - before) <= 1  # of counting the rows of the written table
    release(written)
