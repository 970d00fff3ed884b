import struct

import zstandard
from pyspark.sql import functions as F

from lexaquarry.llm import warc as A

from . import cases


def pages(spark, n=200):
    import random

    rng = random.Random(6)
    rows = [(i, f"http://h.org/{i}", "<html><body>" + cases.prose(rng, 60) + "</body></html>", "clash", 1) for i in range(n)]
    rows += [(None, None, None, None, None), (500, "", "", "x", 2), (501, "http://a\r\nb", "<p>" + "z" * 300_000, "x", 2), rows[3], rows[3]]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, file string, offset int"), rows


def pages_in(data):
    """The records of a file without the warcinfo record, which stands first."""
    info, *rest = A.read_records(bytes(data))
    assert b"WARC-Type: warcinfo" in info
    return rest


def test_frames_read_back(spark):
    df, rows = pages(spark)
    frames = A.archive_frames(df).collect()
    files = {}
    for r in sorted(frames, key=lambda r: (r.file, r.seq)):
        assert r.offset == len(files.setdefault(r.file, bytearray())) and r.length == len(r.frame)
        files[r.file] += r.frame
    records = sorted(x for data in files.values() for x in pages_in(data))
    assert records == sorted(A.record(*r[:3])[1] for r in rows)
    assert any(struct.unpack_from("<I", data)[0] == A.MAGIC for data in files.values())
    for data in files.values():
        for x in A.read_records(bytes(data)):
            head, _, body = x.partition(b"\r\n\r\n")
            length = next(int(h.split(b": ")[1]) for h in head.split(b"\r\n") if h.startswith(b"Content-Length"))
            assert body == body[:length] + b"\r\n\r\n"


def test_a_record_by_two_seeks(spark):
    df, _ = pages(spark)
    rows = A.archive_frames(df.coalesce(1)).collect()
    head, one = rows[0], next(r for r in rows if r.page_id == 77)
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(head.frame[8:]))
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(one.frame).startswith(b"WARC/1.1\r\n")


def test_the_dictionary_pays(spark):
    df, _ = pages(spark, 1500)
    small = df.filter("length(html) < 1000").coalesce(1)
    size = lambda d: sum(r.length for r in A.archive_frames(small, dictionary_bytes=d).collect() if r.seq > 1)
    assert size(A.DICTIONARY_BYTES) < 0.9 * sum(len(zstandard.ZstdCompressor(A.LEVEL).compress(A.record(*r[:3])[1])) for r in small.collect())


def test_the_same_bytes_again(spark):
    df, _ = pages(spark)
    a, b = (sorted(map(tuple, A.archive_frames(df, file_bytes=20_000).collect()), key=str) for _ in range(2))
    assert a == b and len({r[0] for r in a}) > 3


def test_ties_and_a_long_body(spark):
    rows = [(1, "http://a", "same")] * 20 + [(2, "http://a", "same"), (3, "http://b", "y" * 5_000_000)]
    got = A.archive_frames(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), file_bytes=1 << 20).collect()
    ids = [r.record_id for r in got if r.page_id == 1]
    assert len(ids) == 20 and len(set(ids)) == 1 and len({r.record_id for r in got if r.page_id is not None}) == 3
    assert sum(r.page_id == 3 for r in got) == 1


def test_files(spark, tmp_path):
    df, rows = pages(spark)
    index = A.write_warc(df, f"file://{tmp_path}", file_bytes=50_000).collect()
    names = sorted(p.name for p in tmp_path.iterdir())
    assert names == sorted({r.file for r in index}) and not any(n.startswith(".") for n in names)
    assert sorted(x for n in names for x in pages_in((tmp_path / n).read_bytes())) == sorted(A.record(*r[:3])[1] for r in rows)


def test_nothing(spark):
    df, _ = pages(spark)
    assert A.archive_frames(df.filter(F.lit(False))).collect() == []
    assert A.read_records(b"") == []
