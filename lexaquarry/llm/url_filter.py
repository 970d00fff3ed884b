"""URL filters: a blocked Bloom filter of the listed canonical URLs in front of an exact hash join.

The filter is a table of blocks: BLOCK_BITS bits each, PROBES of them set by each listed URL, all in the one block that
the URL's hash names. Blocks are built by a grouped bitwise or on the executors, and probing is a join on the block's
number, so nothing depends on one machine's memory: below BROADCAST_BYTES (13 million listed URLs) the blocks are broadcast
and only pages that pass are shuffled. Above it pages are shuffled twice, first with their probes by the block's number, then
those that pass by their canonical URL; the filter then saves the second shuffle and the comparison of texts. What passes
goes to an exact join on the canonical URL, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, table

BLOCK_BITS = 256
PROBES = 8
LOAD = 16  #: listed URLs a block: 16 bits each, about 0.1 % false positives
BROADCAST_BYTES = 32 << 20


def canonical_url(url: Column) -> Column:
    """Host and path, lower-cased host: without scheme, user, port, leading www. or m., query, fragment, index page,
    .html and trailing slashes. Null and blank URLs, and those without a host, are null."""
    x = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    x = F.regexp_replace(x, r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(x, r"^([^/]*)", 1)), r"^.*@", ""), r":[0-9]*$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"^[^/]*(.*)$", 1), r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), url), F.lit(blocks))


def _words(url: str) -> list[Column]:
    """The bits of a URL inside its block, as 64-bit words."""
    h = F.xxhash64(F.lit(2), url)
    bits = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]
    words = []
    for w in range(BLOCK_BITS // 64):
        x = F.lit(0).cast("bigint")
        for b in bits:
            # one bit of 64 without a shift by a column: a power of two, the sign bit apart
            x = x.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.expr("array(" + ",".join(f"{1 << i}L" if i < 63 else "(-9223372036854775807L - 1L)" for i in range(64)) + ")").getItem(b.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("bigint")))
        words.append(x)
    return words


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, w1, ...) of the filter's blocks that have a bit, from distinct canonical URLs in column ``canonical``."""
    words = _words("canonical")
    marks = listed.select(_block("canonical", blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(words))])


def listed_pages(pages: DataFrame, listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, canonical) of the pages whose canonical URL is listed (column ``url`` of ``listed``).

    Null and blank URLs, listed or not, match nothing; URLs of any length count whole. Repeated pages are repeated, repeated
    listings count once; a null page_id is kept. Other columns, of whatever name, are ignored; an empty page table or list
    gives no rows.
    """
    listed = materialize(listed.select(canonical_url(F.col("url").cast("string")).alias("canonical")).filter("canonical is not null").distinct(), "listed")
    count = listed.count()
    blocks = max(1, -(-count // LOAD))
    filter_ = bloom_blocks(listed, blocks)
    if blocks * (BLOCK_BITS // 8 + 8) <= broadcast_bytes:
        filter_ = F.broadcast(filter_)
    ours = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("canonical", canonical_url(F.col("url"))).filter("canonical is not null")
    words = _words("canonical")
    probed = ours.withColumns({"block": _block("canonical", blocks), **{f"p{i}": w for i, w in enumerate(words)}}).join(filter_, "block")
    for i in range(len(words)):
        probed = probed.filter(F.col(f"w{i}").bitwiseAND(F.col(f"p{i}")) == F.col(f"p{i}"))
    return probed.select("page_id", "url", "canonical").join(listed, "canonical").select("page_id", "url", "canonical")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under a URL that is listed; listed are the addresses of the pages that carry an advertisement's query
    (utm_source or ref), in any spelling."""
    pages = table(spark, sf_dir, "pages")
    return listed_pages(pages, pages.filter(F.col("url").rlike("[?&](utm_source|ref)=")).select("url"))


_CANONICAL = r"""(
  SELECT *, CASE WHEN host <> '' THEN host || path END AS canonical FROM (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(x, '^([^/]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^(www|m)\.', '') AS host,
      regexp_replace(regexp_replace(regexp_extract(x, '^[^/]*(.*)$', 1), '(/index)?\.html?$', ''), '/+$', '') AS path
    FROM (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS x FROM pages)
  )
)"""
ORACLE_SQL = f"""
SELECT page_id, url, canonical FROM {_CANONICAL} WHERE canonical IN (
  SELECT canonical FROM {_CANONICAL} WHERE regexp_matches(url, '[?&](utm_source|ref)=')
)
"""
