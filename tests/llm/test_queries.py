"""The registered queries against SQL or brute force on the smallest tables."""

import hashlib

import duckdb
import pyarrow as pa
import pytest
import sentencepiece
import zstandard

from lexaquarry.llm import queries, sentencepiece_codec, substring_dedup, token_counts, toxicity

from .test_decontamination import brute as leaks
from .test_sharding import brute as places
from .test_substring_dedup import brute as repeats
from .test_toxicity import score_by_hand


@pytest.fixture(scope="module")
def texts(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        from pathlib import Path

        p = Path(f"{data}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    rows = lambda d: sorted(repr([x.tolist() if hasattr(x, "tolist") else x for x in r]) for r in d[columns].itertuples(index=False))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_op3(spark, data, texts):
    m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert sorted((r.doc_id, r.ids) for r in queries.QUERIES["op3_sentencepiece"](spark, data).collect()) == sorted((i, m.encode(t)) for i, t in texts)


def test_op4(spark, data, texts):
    model = toxicity.fit(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))).value
    got = {r.doc_id: r.score for r in queries.QUERIES["op4_toxicity"](spark, data).collect()}
    # every text of moderate length is scored again by the definition
    for i, t in ((i, t) for i, t in texts if len(t) < 1500):
        s = score_by_hand(t, model) - model[2]
        if abs(s) > 1e-3:
            assert (i in got) == (s > 0), i
            assert i not in got or got[i] == pytest.approx(s, abs=2e-3)
    s = toxicity.score_texts(pa.array([t for _, t in texts]), model)
    assert sorted(got) == sorted(i for (i, _), x in zip(texts, s) if x > model[2])


def test_op5(spark, data, texts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = queries.QUERIES["op5_sharding"](spark, data)
    assert sorted(map(tuple, got.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert {str(r.doc_id): (r.shard, r.hops) for r in got.collect()} == places([str(i) for i, _ in texts], [f"shard-{i:03d}" for i in range(64)], 128, 0.05)


def test_op6(spark, data, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = {tuple(r) for r in queries.QUERIES["op6_decontamination"](spark, data).collect()}
    assert got == leaks(texts, items)


def test_op7(spark, data, texts):
    assert {tuple(r) for r in queries.QUERIES["op7_substring_dedup"](spark, data).collect()} == repeats(texts, substring_dedup.PASSAGE)


def test_op9(spark, data, texts):
    e = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())[0]
    assert sorted(map(tuple, queries.QUERIES["op9_token_counts"](spark, data).collect())) == sorted((i, len(e.encode_ordinary(t))) for i, t in texts)


def test_op10(spark, data):
    """Files are decoded frame by frame and parsed here, with nothing of the module."""
    files = {}
    for r in sorted(queries.QUERIES["op10_warc"](spark, data).collect(), key=lambda r: (r.file, r.seq)):
        files.setdefault(r.file, []).append((r.page_id, bytes(r.frame)))
    got = []
    for name, frames in files.items():
        press = zstandard.ZstdDecompressor()
        if frames[0][1][:4] == b"\x5d\x2a\x4d\x18":
            raw = frames.pop(0)[1]
            assert int.from_bytes(raw[4:8], "little") == len(raw) - 8
            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:])))
        info = press.decompress(frames.pop(0)[1]).decode()
        assert info.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f"\r\nWARC-Filename: {name}\r\n" in info
        for page, frame in frames:
            head, _, body = press.decompress(frame).partition(b"\r\n\r\n")
            version, *fields = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in fields)
            assert version == "WARC/1.1" and fields["WARC-Type"] == "resource" and fields["WARC-Date"].endswith("Z") and fields["WARC-Record-ID"].startswith("<urn:uuid:")
            assert body[-4:] == b"\r\n\r\n" and len(body) - 4 == int(fields["Content-Length"])
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body[:-4]).hexdigest()
            got.append((page, fields["WARC-Target-URI"], body[:-4].decode()))
    assert sorted(got) == sorted((p.page_id, p.url, p.html) for p in spark.read.parquet(f"{data}/pages.parquet").collect())
