import random

import pytest
from pyspark.sql import functions as F

from lexaquarry.llm import url_filter as L

SAME = ["http://www.Example.com/a/b.html", "https://example.com:8080/a/b", "example.com/a/b/", "HTTPS://user@m.example.com/a/b/index.html?utm=1#top", "  http://example.com/a/b#x"]


def test_spellings_of_one_address(spark):
    rows = spark.createDataFrame([(u,) for u in SAME], "url string")
    assert {r[0] for r in rows.select(L.canonical_url(F.col("url"))).collect()} == {"example.com/a/b"}


@pytest.mark.parametrize("size", [L.BROADCAST_BYTES, 0])
def test_as_by_sets(spark, size):
    rng = random.Random(1)
    urls = [f"http://h{rng.randint(0, 50)}.org/p{rng.randint(0, 60)}" + rng.choice(["", "/", "?q=1", ".html"]) for _ in range(3000)] + [None, "", "  ", "http://", "/path"]
    pages = spark.createDataFrame([(i if i % 97 else None, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id bigint, url string, canonical string, html string, block int")
    listed = spark.createDataFrame([(u, 3) for u in rng.sample(urls, 300) + ["https://nowhere.net", None, ""]], "url string, w0 int")
    canon = {r.url: r.c for r in pages.select("url", L.canonical_url(F.col("url")).alias("c")).collect()}
    bad = {c for (c,) in listed.select(L.canonical_url(F.col("url"))).collect() if c}
    want = sorted(repr((i if i % 97 else None, u)) for i, u in enumerate(urls) if canon.get(u) in bad)
    out = L.listed_pages(pages, listed, size)
    assert sorted(repr((r.page_id, r.url)) for r in out.collect()) == want and len(want) > 100


def test_the_filter_lets_few_others_pass(spark):
    listed = spark.range(2000).select(F.concat(F.lit("in.org/"), F.col("id").cast("string")).alias("canonical"))
    blocks = L.bloom_blocks(listed, 125)
    others = spark.range(20_000).select(F.concat(F.lit("out.org/"), F.col("id").cast("string")).alias("canonical"))

    def passes(rows):
        words = L._words("canonical")
        probed = rows.withColumns({"block": L._block("canonical", 125), **{f"p{i}": w for i, w in enumerate(words)}}).join(blocks, "block")
        for i in range(len(words)):
            probed = probed.filter(F.col(f"w{i}").bitwiseAND(F.col(f"p{i}")) == F.col(f"p{i}"))
        return probed.count()

    assert passes(listed) == 2000 and passes(others) < 200


def test_long_urls(spark):
    long = "http://h.org/" + "p/" * 100_000
    rows = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + "a?q=" + "z" * 100_000)], "page_id bigint, url string")
    assert sorted(r.page_id for r in L.listed_pages(rows, rows.filter("page_id = 1")).collect()) == [1, 3]


def test_nothing(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    some = spark.createDataFrame([(1, "a.org/x"), (1, "a.org/x")], "page_id bigint, url string")
    assert L.listed_pages(none, some).collect() == [] and L.listed_pages(some, none).collect() == []
    assert L.listed_pages(some, some).count() == 2
