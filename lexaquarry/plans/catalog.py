"""Every query of the library by name, and the SQL that states the same.

The queries read whole tables; documents, conversations and embeddings stand for records, Markdown and vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, context, embedding, fulltext, fusion, records, reuse, search
from ..provider import chat, failures
from ..sources import adapters, scratch
from ..sources.snapshot import Snapshot
from . import build

QUERIES: dict = {}
ORACLES: dict = {}

WINDOW, OVERLAP = 64, 8
TEXT = "thes Thha, thed thes"
K = 10


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    return adapters.from_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels") if labelled else None)


def normal(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    return records.validated(documents(spark, sf_dir, labelled))


# SQL that the oracles share

_W = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _quote(x: str) -> str:
    for a, b in (("chr(92)", "chr(92) || chr(92)"), ("'\"'", "chr(92) || '\"'"), ("chr(7)", "chr(92) || 'a'"), ("chr(8)", "chr(92) || 'b'"), ("chr(12)", "chr(92) || 'f'"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'"), ("chr(11)", "chr(92) || 'v'")):
        x = f"replace({x}, {a}, {b})"
    return f"'\"' || {x} || '\"'"


_RECORDS = f"""
SELECT 'doc-' || d.doc_id AS ref, CASE WHEN {_trim("lang")} = '' THEN 'artifact' ELSE {_trim("lang")} END AS kind, {_trim("source || ' ' || d.doc_id")} AS title,
  {_trim("source")} AS source_ref, 'plaintext' AS body_format, {_trim("text")} AS body_text, quality, toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
"""
_LINES = ", ".join(f"""'"{c}"=' || {_quote(c)}""" for c in ("kind", "title", "body_format", "body_text"))
_HASHED = f"""
SELECT *, sha256(array_to_string(list_sort([{_LINES}] || CASE WHEN quality IS NULL THEN [] ELSE ['"metadata.quality"="' || quality || '"', '"metadata.toxic"="' || toxic || '"'] END), chr(10))) AS content_hash
FROM ({_RECORDS})
"""


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_W}+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '')"


def _fnv(x: str) -> str:
    byte = f"(instr('0123456789ABCDEF', hex(encode({x}))[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', hex(encode({x}))[2 * i]) - 1"
    return f"list_reduce([{byte} FOR i IN range(1, octet_length(encode({x})) + 1)], lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)"


_COSINE = "CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) > 0 THEN 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) ELSE 1 END"


def _cosine(a: str, b: str) -> str:
    n = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {n} > 0 THEN 1 - list_dot_product({a}, {b}) / {n} ELSE 1 END"


_SCORE = "round(greatest(0, least(1, 1 - distance)), 6)"

_INDEXES: dict[tuple, str] = {}
DIMENSION = 32


def _built(spark, sf_dir, name: str, make) -> Snapshot:
    """The index of that name, built once a session for each folder of tables by ``make(path)``."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _INDEXES:
        path = f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        make(path)
        _INDEXES[at] = path
    return Snapshot(spark, _INDEXES[at])


def _index(spark, sf_dir) -> Snapshot:
    """All documents in windows of words."""
    options = build.BuildOptions(embedding.Fixture(dimension=DIMENSION), policy=chunking.Flat(WINDOW, OVERLAP))
    return _built(spark, sf_dir, "documents", lambda path: build.rebuild(spark, path, documents(spark, sf_dir, False), options))


# records


@query(f"SELECT ref, kind, title, source_ref, body_format, body_text, CASE WHEN quality IS NULL THEN '' ELSE 'quality=' || quality || ',toxic=' || toxic END AS metadata FROM ({_RECORDS})")
def normalize_records(spark, sf_dir):
    """Trimmed records with defaults and metadata."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map()))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return normal(spark, sf_dir).withColumn("metadata", meta).drop("content_hash")


@query(f"SELECT ref, content_hash FROM ({_HASHED})")
def content_hash(spark, sf_dir):
    """Hash of each record's quoted fields."""
    return normal(spark, sf_dir).select("ref", "content_hash")


@query(f"SELECT sha256(string_agg(ref || ':' || content_hash, chr(10) ORDER BY ref || ':' || content_hash)) AS fingerprint FROM ({_HASHED})")
def corpus_fingerprint(spark, sf_dir):
    """One hash of all records, whatever their order."""
    return records.fingerprint(normal(spark, sf_dir).select("ref", "content_hash"))


@query(f"SELECT kind, count(*) AS records FROM ({_RECORDS}) GROUP BY kind")
def stats_by_kind(spark, sf_dir):
    """What an opened index says of itself."""
    stats = _index(spark, sf_dir).stats()
    return spark.createDataFrame(sorted(stats.kinds.items()), "kind string, records bigint")


@query(f"SELECT ref, kind, title FROM ({_RECORDS}) WHERE kind IN ('de', 'fr')")
def records_filter(spark, sf_dir):
    """Listed kinds of an index, blank ones ignored."""
    return _index(spark, sf_dir).records(kinds=[" de ", "fr", " "]).select("ref", "kind", "title")


@query("SELECT text AS ref, count(*) AS records FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_refs(spark, sf_dir):
    """F7, with texts as refs."""
    return records.duplicates(table(spark, sf_dir, "documents").select(F.col("text").alias("ref")))


@query("SELECT ref, CASE WHEN ref = '' THEN 'record ref is required' WHEN body_format <> 'plaintext' THEN 'unsupported body format \"' || body_format || '\"' END AS error FROM (SELECT lang AS ref, CASE WHEN quality = 1 THEN 'plaintext' ELSE 'html' END AS body_format FROM documents LEFT JOIN labels USING (doc_id))")
def validate_records(spark, sf_dir):
    """what is wrong with a record."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select(F.col("lang").alias("ref"), F.when(F.col("quality") == 1, "plaintext").otherwise("html").alias("body_format"), F.col("text").alias("body_text"))
    return records.normalize(rows).select("ref", "error")


# chunks


@query(f"SELECT doc_id, len({_words('text')}) AS words FROM documents")
def word_count(spark, sf_dir):
    """Words between Unicode white space."""
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).alias("words"))


@query(f"""
WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents), i AS (
  SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - {WINDOW}) / {WINDOW - OVERLAP}.0))::BIGINT)) AS i FROM w WHERE len(w) > 0
) SELECT doc_id, i AS window_index, len(w[i * {WINDOW - OVERLAP} + 1 : i * {WINDOW - OVERLAP} + {WINDOW}]) AS words, array_to_string(w[i * {WINDOW - OVERLAP} + 1 : i * {WINDOW - OVERLAP} + {WINDOW}], ' ') AS text FROM i
""")
def token_windows(spark, sf_dir):
    """C4: windows of words with overlap."""
    w = F.posexplode(chunking.word_windows(F.col("text"), WINDOW, OVERLAP)).alias("window_index", "w")
    return table(spark, sf_dir, "documents").select("doc_id", w).select("doc_id", F.col("window_index").cast("bigint").alias("window_index"), F.size("w").cast("bigint").alias("words"), F.array_join("w", " ").alias("text"))


def _split(spark, sf_dir) -> DataFrame:
    return chunking.chunk(normal(spark, sf_dir, False), chunking.Flat(WINDOW, OVERLAP))


@query(f"""
WITH w AS (SELECT 'doc-' || doc_id AS ref, {_words('text')} AS w FROM documents), i AS (
  SELECT ref, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - {WINDOW}) / {WINDOW - OVERLAP}.0))::BIGINT)) AS i FROM w WHERE len(w) > 0
) SELECT ref, i AS chunk_index, array_to_string(w[i * {WINDOW - OVERLAP} + 1 : i * {WINDOW - OVERLAP} + {WINDOW}], ' ') AS words FROM i
""")
def split_section(spark, sf_dir):
    """Exact slices of plain texts; their words are compared, white space inside is the text's own."""
    return _split(spark, sf_dir).select("ref", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.array_join(T.words(F.col("content")), " ").alias("words"))


@query(f"""
SELECT 'conv-' || conv_id AS ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, role AS heading, {_trim("replace(text, chr(13) || chr(10), chr(10))")} AS content
FROM conversations WHERE {_trim("text")} <> ''
""")
def markdown_sections(spark, sf_dir):
    """Sections by heading."""
    rows = records.validated(adapters.from_conversations(table(spark, sf_dir, "conversations")))
    return chunking.chunk(rows, chunking.Flat()).select("ref", F.col("chunk_index").cast("bigint").alias("chunk_index"), "heading", "content")


def _late(spark, sf_dir) -> DataFrame:
    rows = normal(spark, sf_dir, False).unionByName(records.validated(adapters.from_conversations(table(spark, sf_dir, "conversations"))))
    return chunking.chunk(rows, chunking.ByKind({"conversation": chunking.Late(WINDOW, 0, OVERLAP)}, chunking.Late(WINDOW, 4 * WINDOW)))


#: Parents of four windows of a document's words, or a turn each, and their windows where there is more than one.
_LATE = f"""
WITH t AS (
  SELECT 'doc-' || doc_id AS ref, {_words('text')} AS w, true AS whole FROM documents
), p AS (
  SELECT ref, i AS place, w[i * {4 * WINDOW} + 1 : (i + 1) * {4 * WINDOW}] AS w, {WINDOW} AS step FROM (SELECT ref, w, unnest(range(0, ceil(len(w) / {4 * WINDOW}.0)::BIGINT)) AS i FROM t)
  UNION ALL SELECT 'conv-' || conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn), {_words("text")}, {WINDOW - OVERLAP} FROM conversations WHERE {_trim("text")} <> ''
), n AS (
  SELECT *, CASE WHEN len(w) > {WINDOW} THEN 1 + ceil((len(w) - {WINDOW}) / step::DOUBLE)::BIGINT ELSE 0 END AS children FROM p
), f AS (
  SELECT *, coalesce(sum(1 + children) OVER (PARTITION BY ref ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n
), late AS (
  SELECT ref, first AS chunk_index, -1::BIGINT AS parent_index, children > 0 AS is_parent, w FROM f
  UNION ALL SELECT ref, first + 1 + i, first, false, w[i * step + 1 : i * step + {WINDOW}] FROM (SELECT *, unnest(range(0, children)) AS i FROM f)
)
"""


@query(_LATE + "SELECT ref, chunk_index, parent_index, is_parent, array_to_string(w, ' ') AS words FROM late")
def late_chunk(spark, sf_dir):
    """Parents with children, by kind."""
    rows = _late(spark, sf_dir)
    return rows.select("ref", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_index", "parent_index")], "is_parent", F.array_join(T.words(F.col("content")), " ").alias("words"))


@query(_LATE + """, v AS (SELECT ref, chunk_index, CASE chunk_index % 7 WHEN 3 THEN chunk_index + 1 WHEN 5 THEN 1000000 ELSE parent_index END AS parent_index FROM late)
SELECT ref, chunk_index, parent_index FROM v WHERE parent_index <> -1 AND (parent_index >= chunk_index OR (ref, parent_index) NOT IN (SELECT ref, chunk_index FROM late))""")
def lineage_violations(spark, sf_dir):
    """some chunks get a later chunk, or none that there is, as parent."""
    at = F.col("chunk_index") % 7
    rows = _late(spark, sf_dir).withColumn("parent_index", F.when(at == 3, F.col("chunk_index") + 1).when(at == 5, 1_000_000).otherwise(F.col("parent_index")))
    return chunking.lineage_violations(rows).withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "parent_index")})


@query(_LATE + ", i AS (SELECT *, row_number() OVER (ORDER BY ref, chunk_index) AS chunk_id FROM late) SELECT i.ref, i.chunk_index, i.chunk_id, coalesce(p.chunk_id, 0) AS parent_chunk_id FROM i LEFT JOIN i p ON p.ref = i.ref AND p.chunk_index = i.parent_index")
def id_assign(spark, sf_dir):
    """Ids in order of (ref, chunk_index) without a global sort of chunks, and ids of parents."""
    sections = scratch.written(_late(spark, sf_dir), "sections")
    rows, _ = build.assign_ids(lambda name, df: scratch.written(df, name), sections, 0)
    return rows.select("ref", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("chunk_index", "chunk_id", "parent_chunk_id")])


# text


@query(f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, md5(array_to_string(t, ' ')) AS joined FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    """E8, T1."""
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("distinct_tokens"), F.md5(F.array_join("t", " ")).alias("joined"))


@query(f"SELECT token, {_fnv('token')} AS hash, {_fnv('token')} % 64 AS bucket FROM (SELECT DISTINCT unnest({_tokens('text')}) AS token FROM documents)")
def fnv_bucket(spark, sf_dir):
    """E9."""
    t = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", T.fnv1a(F.col("token")).alias("hash"), T.bucket(F.col("token"), 64).cast("bigint").alias("bucket"))


def _fixture_sql(source: str, key: str, text: str, d: int) -> str:
    """{key}, place, value of the hashed words and pairs of words of each text; each distinct word is hashed once."""
    return f"""
t AS (SELECT {key}, {_tokens(text)} AS t FROM {source}),
h AS (SELECT {key}, unnest(t) AS x, 1.0 AS w FROM t UNION ALL SELECT {key}, unnest([t[i] || '_' || t[i + 1] FOR i IN range(1, len(t))]), 1.5 FROM t),
u AS MATERIALIZED (SELECT x, {_fnv('x')} % {d} AS place FROM (SELECT DISTINCT x FROM h)),
s AS (SELECT {key}, place, sum(w)::DOUBLE AS w FROM h JOIN u USING (x) GROUP BY ALL), n AS (SELECT {key}, sqrt(sum(w * w)) AS n FROM s GROUP BY ALL),
fixture AS (SELECT {key}, place, w / n AS value FROM s JOIN n USING ({key}))
"""


@query(f"WITH {_fixture_sql('documents', 'doc_id', 'text', DIMENSION)} SELECT doc_id, place, round(value, 6) AS value FROM fixture")
def fixture_embed(spark, sf_dir):
    """Hashed words and pairs of words, unit length; places without a word are left out."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ref"), F.lit(0).alias("chunk_index"), "text")
    v = embedding.embed(rows, embedding.Fixture(dimension=DIMENSION)).select(F.col("ref").cast("bigint").alias("doc_id"), F.posexplode("embedding").alias("place", "value")).filter("value <> 0")
    return v.select("doc_id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))


_CHUNKS = f"""c AS (
  SELECT ref, kind, title, source_ref, i AS chunk_index, array_to_string(w[i * {WINDOW - OVERLAP} + 1 : i * {WINDOW - OVERLAP} + {WINDOW}], ' ') AS words
  FROM (SELECT *, unnest(range(0, 1 + greatest(0, ceil((len(w) - {WINDOW}) / {WINDOW - OVERLAP}.0))::BIGINT)) AS i FROM (SELECT *, {_words('body_text')} AS w FROM ({_RECORDS}) WHERE kind = 'fr') WHERE len(w) > 0)
)"""


@query(f"""
WITH {_CHUNKS}, k AS (SELECT ref || ':' || chunk_index AS id, title || ' ' || words AS body FROM c),
{_fixture_sql('k', 'id', 'body', DIMENSION)},
e AS (SELECT id, array_to_string(list(place || '=' || round(value, 4)::DECIMAL(9, 4)::VARCHAR ORDER BY place), ',') AS embedding FROM fixture GROUP BY id)
SELECT ref, kind, title, source_ref, title AS heading, chunk_index, words, embedding FROM c JOIN e ON e.id = ref || ':' || chunk_index
""")
def sections_scan(spark, sf_dir):
    """An index's chunks of the listed kinds with their record's fields, texts and vectors."""
    rows = _index(spark, sf_dir).sections(kinds=["fr"], embeddings=True)
    value = F.transform(F.col("embedding"), lambda x, i: F.when(F.abs(x) > 1e-9, F.concat(i.cast("string"), F.lit("="), F.round(x, 4).cast("decimal(9,4)").cast("string"))))
    words = F.array_join(T.words(F.col("content")), " ")
    return rows.select("ref", "kind", "title", "source_ref", "heading", F.col("chunk_index").cast("bigint").alias("chunk_index"), words.alias("words"), F.array_join(F.array_compact(value), ",").alias("embedding"))


@query(f"SELECT doc_id, array_to_string(list_filter([{_trim('source')}, {_trim('lang')}, {_trim('text')}], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM documents")
def embedding_text(spark, sf_dir):
    """Title, heading and text of what is embedded."""
    return table(spark, sf_dir, "documents").select("doc_id", embedding.embedding_text(F.col("source"), F.col("lang"), F.col("text"), F.lit("")).alias("text"))


# reuse, updates, integrity


@query("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || text || chr(0)) AS reuse_key FROM documents")
def reuse_key(spark, sf_dir):
    """R1."""
    return table(spark, sf_dir, "documents").select("doc_id", reuse.reuse_key(F.col("source"), F.col("lang"), F.col("text"), F.lit("")).alias("reuse_key"))


@query("SELECT 'doc-' || doc_id AS ref, coalesce(quality = 1, false) AS reused FROM documents LEFT JOIN labels USING (doc_id)")
def reuse_join(spark, sf_dir):
    """The labelled documents were indexed before, those of low quality with another text."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ref = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("ref")
    columns = (F.col("source").alias("title"), F.col("lang").alias("heading"))
    new = rows.select(ref, *columns, F.col("text").alias("content"), F.lit("").alias("context_prefix"))
    old = rows.filter("quality is not null").select(ref, *columns, F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("."))).alias("content"), F.lit("").alias("context_prefix"), F.array(F.lit(1.0)).alias("embedding"))
    return reuse.split(new, old).select("ref", F.col("old_embedding").isNotNull().alias("reused"))


def _updated(spark, sf_dir) -> Snapshot:
    """An index of the documents, to which labelled documents are added over their unlabelled versions, and of which German
    ones without labels are removed."""
    options = build.BuildOptions(embedding.Fixture(dimension=DIMENSION), policy=chunking.Flat(WINDOW, OVERLAP))

    def make(path: str) -> None:
        build.rebuild(spark, path, documents(spark, sf_dir, False), options)
        rows = documents(spark, sf_dir)
        build.update(spark, path, rows.filter("metadata is not null"), rows.filter("kind = 'de' and metadata is null").select("ref"), options)

    return _built(spark, sf_dir, "updated", make)


_UPDATED = f"(SELECT * FROM ({_HASHED}) WHERE quality IS NOT NULL OR kind <> 'de')"


@query(f"SELECT ref, source_ref, content_hash, CASE WHEN quality IS NULL THEN '' ELSE 'quality=' || quality || ',toxic=' || toxic END AS metadata FROM {_UPDATED}")
def update_apply(spark, sf_dir):
    """The records of an index after an update."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map()))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _updated(spark, sf_dir).records().select("ref", "source_ref", "content_hash", meta.alias("metadata"))


@query(f"""
WITH u AS (SELECT *, len({_words('body_text')}) AS n FROM {_UPDATED})
SELECT kind, count(*) AS records, sum(CASE WHEN n > 0 THEN 1 + greatest(0, ceil((n - {WINDOW}) / {WINDOW - OVERLAP}.0))::BIGINT ELSE 0 END)::BIGINT AS chunks,
  (SELECT sha256(string_agg(ref || ':' || content_hash, chr(10) ORDER BY ref || ':' || content_hash)) FROM u) AS fingerprint
FROM u GROUP BY kind
""")
def update_counts(spark, sf_dir):
    """Chunks, vectors and fingerprint of an index after an update."""
    s = _updated(spark, sf_dir)
    by = s.chunks().join(s.table("vectors").select("chunk_id"), "chunk_id").select("ref", "chunk_id").join(s.table("records").select("ref", "kind"), "ref", "right")
    return by.groupBy("kind").agg(F.countDistinct("ref").alias("records"), F.count("chunk_id").alias("chunks"), F.lit(s.manifest["content_fingerprint"]).alias("fingerprint"))


@query(f"""
WITH u AS (SELECT quality, toxic, len(w) AS n, CASE WHEN len(w) > 0 THEN 1 + greatest(0, ceil((len(w) - {WINDOW}) / {WINDOW - OVERLAP}.0))::BIGINT ELSE 0 END AS chunks FROM (SELECT quality, toxic, {_words('body_text')} AS w FROM ({_RECORDS})))
SELECT sum(chunks - CASE WHEN quality = 1 AND n > 0 THEN 1 ELSE 0 END)::BIGINT AS reused, sum(CASE WHEN quality = 1 AND n > 0 THEN 1 ELSE 0 END)::BIGINT AS embedded, sum(CASE WHEN quality = 1 AND n > 0 THEN 0 ELSE 1 END)::BIGINT AS unchanged_records, 'active' AS status FROM u
""")
def reuse_plan(spark, sf_dir):
    """A rebuild that reuses the vectors of an index whose documents of good quality ended otherwise."""
    rows = documents(spark, sf_dir)
    body = F.when((F.col("metadata")["quality"] == "1") & (F.size(T.words(F.col("body_text"))) > 0), F.concat(T.trim_white(F.col("body_text")), F.lit("X"))).otherwise(F.col("body_text"))
    options = build.BuildOptions(embedding.Fixture(dimension=DIMENSION), policy=chunking.Flat(WINDOW, OVERLAP), reuse_from=_index(spark, sf_dir).path)
    done = build.rebuild(spark, f"{scratch.folder(spark)}/reuse-{uuid.uuid4().hex[:12]}", rows.withColumn("body_text", body).drop("metadata"), options)
    return spark.createDataFrame([(done.reused, done.embedded, done.unchanged_records, str(done.reuse_status.value))], "reused bigint, embedded bigint, unchanged_records bigint, status string")


@query("""
SELECT 'chunk without record' AS problem, count(*) AS chunks FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'chunk without vector', count(*) FROM documents WHERE lang <> 'en'
""")
def integrity_orphans(spark, sf_dir):
    """Labelled documents as records, all documents as chunks, English ones with vectors."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("ref"), "lang", F.lit(False).alias("is_parent"), F.lit(None).cast("bigint").alias("parent_chunk_id"))
    have = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("ref"))
    return build.integrity_problems(have, docs, docs.filter("lang = 'en'")).groupBy("problem").agg(F.count(F.lit(1)).alias("chunks"))


# vectors


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").cast("string").alias("ref"), F.col("label").cast("string").alias("kind"), F.lit(0).alias("chunk_index"), F.col("embedding").cast("array<float>").alias("embedding")
    )


def _first_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def _found(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", F.round("score", 6).alias("score"))


_E = "(SELECT vec_id AS chunk_id, vec_id::VARCHAR AS ref, label::VARCHAR AS kind, embedding::DOUBLE[] AS b, (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1) AS a FROM embeddings)"


@query(f"SELECT chunk_id, {_SCORE} AS score FROM (SELECT chunk_id, ref, {_COSINE} AS distance FROM {_E} ORDER BY distance, ref LIMIT {K})")
def vec_cosine_topk(spark, sf_dir):
    """V1, Q7, Q10."""
    return _found(search.nearest(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), K))


@query(f"SELECT chunk_id, {_SCORE} AS score FROM (SELECT chunk_id, ref, {_COSINE} AS distance FROM {_E} WHERE kind IN ('3', '7') ORDER BY distance, ref LIMIT {K})")
def vec_kind_topk(spark, sf_dir):
    """V2: kinds filter before the limit."""
    return _found(search.nearest(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), K, kinds=["3", "7 "]))


@query(f"SELECT chunk_id, {_SCORE} AS score FROM (SELECT chunk_id, ref, {_COSINE} AS distance FROM (SELECT *, {_cosine('a[1:16]', 'b[1:16]')} AS rough FROM {_E} ORDER BY rough, chunk_id LIMIT {3 * K}) ORDER BY distance, ref LIMIT {K})")
def vec_matryoshka(spark, sf_dir):
    """V3, Q12: a prefix picks, full vectors order."""
    return _found(search.nearest(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), K, dimension=16))


def _int8(x: str) -> str:
    return f"[round(v / sqrt(list_dot_product({x}, {x})) * 127) FOR v IN {x}]"


@query(f"SELECT chunk_id, {_SCORE} AS score FROM (SELECT chunk_id, ref, {_COSINE} AS distance FROM (SELECT chunk_id, ref, {_int8('a')} AS a, {_int8('b')} AS b FROM {_E}) ORDER BY distance, ref LIMIT {K})")
def vec_int8_topk(spark, sf_dir):
    """V1, Q3: int8 against int8."""
    rows = _vectors(spark, sf_dir).withColumn("embedding", V.to_int8(F.col("embedding")))
    return _found(search.nearest(rows, _first_vector(spark, sf_dir), K, mode=C.INT8))


@query(f"SELECT chunk_id, {_SCORE} AS score FROM (SELECT chunk_id, ref, {_COSINE} AS distance FROM (SELECT *, list_sum([((a[i] >= 0) <> (b[i] >= 0))::INT FOR i IN range(1, len(a) + 1)]) AS rough FROM {_E} ORDER BY rough, chunk_id LIMIT {3 * K}) ORDER BY distance, ref LIMIT {K})")
def vec_binary_topk(spark, sf_dir):
    """V4, Q5, Q11: signs pick, full vectors order."""
    rows = _vectors(spark, sf_dir).withColumn("bits", V.to_bits(F.col("embedding")))
    return _found(search.nearest(rows, _first_vector(spark, sf_dir), K, mode=C.BINARY))


class Numbers:
    """An embedder of texts that are vectors, written out."""

    fingerprint = "numbers"

    def __init__(self, dimension: int):
        self._dimension = dimension

    def dimension(self) -> int:
        return self._dimension

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [[float(x) for x in t.rpartition("\n\n")[2].split(",")] for t in texts]

    queries = documents


def _stored(spark, sf_dir, mode: str) -> Snapshot:
    """An index of the embeddings, kept in a mode."""

    def make(path: str) -> None:
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("ref"), F.col("label").cast("string").alias("kind"), F.lit(C.PLAINTEXT).alias("body_format"), F.array_join(F.col("embedding").cast("array<string>"), ",").alias("body_text"))
        build.rebuild(spark, path, rows, build.BuildOptions(Numbers(len(_first_vector(spark, sf_dir))), quantization=mode))

    return _built(spark, sf_dir, f"vectors-{mode}", make)


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ref").cast("bigint").alias("vec_id"), "kind", F.round("score", 6).alias("score"))


@query(f"SELECT ref::BIGINT AS vec_id, kind, {_SCORE} AS score FROM (SELECT ref, kind, {_COSINE} AS distance FROM {_E} WHERE kind IN ('3', '7') ORDER BY distance, ref LIMIT {K})")
def search_vector(spark, sf_dir):
    """V6, Q1, Q2: an index searched by vector, kinds before the limit."""
    return _hits(_stored(spark, sf_dir, C.FLOAT32).search_vector(_first_vector(spark, sf_dir), K, kinds=["3", "7"]))


@query(f"SELECT ref::BIGINT AS vec_id, kind, {_SCORE} AS score FROM (SELECT ref, kind, {_COSINE} AS distance FROM (SELECT ref, kind, a, b, {_cosine('a[1:16]', 'b[1:16]')} AS rough FROM {_E} ORDER BY rough, ref LIMIT {3 * 5 * K}) ORDER BY distance, ref LIMIT {K})")
def search_vector_prefix(spark, sf_dir):
    """V3, V5, V6: of an index a prefix picks three times the pool."""
    return _hits(_stored(spark, sf_dir, C.FLOAT32).search_vector(_first_vector(spark, sf_dir), K, dimension=16))


@query(f"SELECT ref::BIGINT AS vec_id, kind, {_SCORE} AS score FROM (SELECT ref, kind, {_COSINE} AS distance FROM (SELECT ref, kind, {_int8('a')} AS a, {_int8('b')} AS b FROM {_E}) ORDER BY distance, ref LIMIT {K})")
def search_vector_int8(spark, sf_dir):
    """V6, Q3: the same of int8 vectors."""
    return _hits(_stored(spark, sf_dir, C.INT8).search_vector(_first_vector(spark, sf_dir), K))


@query("SELECT vec_id, i - 1 AS place, round(round(v / n * 127)::BIGINT / 127, 6) AS value FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def stored_int8(spark, sf_dir):
    """Q4, Q8, F16: int8 vectors of an index, read back as numbers."""
    rows = _stored(spark, sf_dir, C.INT8).sections(embeddings=True)
    return rows.select(F.col("ref").cast("bigint").alias("vec_id"), F.posexplode("embedding").alias("place", "value")).select("vec_id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))


@query(f"""
WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.vec_id::VARCHAR AS ref, {_cosine('q.embedding::DOUBLE[]', 'v.embedding::DOUBLE[]')} AS distance FROM embeddings q, embeddings v)
SELECT query_id, rank - 1 AS rank, abs(round(distance, 6)) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref) AS rank FROM d) WHERE rank <= 5
""")
def vec_batch_topk(spark, sf_dir):
    """Every vector as a query: the five nearest of each in one scan."""
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.nearest_of_many(_vectors(spark, sf_dir), queries, 5).select("query_id", F.col("rank").cast("bigint").alias("rank"), F.abs(F.round("distance", 6)).alias("distance"))


@query("SELECT vec_id, i - 1 AS place, round(v / n * 127)::BIGINT AS value FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def quantize_int8(spark, sf_dir):
    """Q3."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.to_int8(F.col("embedding"))).alias("place", "value")).select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("value").cast("bigint").alias("value"))


@query("SELECT vec_id, i - 1 AS place, CASE WHEN v >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def quantize_binary(spark, sf_dir):
    """Q5, Q6: signs, and back."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.from_bits(V.to_bits(F.col("embedding")), 64)).alias("place", "value")).select("vec_id", F.col("place").cast("bigint").alias("place"), "value")


# full text and fusion

_FTS = """
WITH t AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(strip_accents(lower(source || ' ' || lang || ' ' || text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
z AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
p AS (SELECT chunk_id, len, w, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS w FROM t) WHERE w IN ('thes', 'thha', 'thed') GROUP BY ALL),
f AS (SELECT w, CASE WHEN w = 'thes' THEN 2 ELSE 1 END * CASE WHEN count(*) < (SELECT n FROM z) / 2 THEN ln(((SELECT n FROM z) - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM p GROUP BY w),
s AS (SELECT chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT mean FROM z)))) AS score FROM p JOIN f USING (w) GROUP BY chunk_id HAVING count(*) = 3)
"""


def _fts_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("kind"), F.col("source").alias("title"), F.col("lang").alias("heading"), "text")


@query("SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(source || ' ' || lang || ' ' || text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents)) GROUP BY ALL")
def fts_postings(spark, sf_dir):
    """The terms of each text with their counts, accents folded."""
    return fulltext.merged_postings(_fts_rows(spark, sf_dir)).select(F.col("chunk_id").alias("doc_id"), F.col("len").cast("bigint").alias("len"), "term", F.col("tf").cast("bigint").alias("tf"))


@query(_FTS + f"SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT {K}")
def fts_bm25(spark, sf_dir):
    """All terms, best first."""
    return _found(fulltext.scan(_fts_rows(spark, sf_dir), TEXT, K))


@query(_FTS + "SELECT chunk_id FROM s")
def fts_and_match(spark, sf_dir):
    """Every chunk that has all terms, by postings."""
    rows = _fts_rows(spark, sf_dir)
    index = scratch.written(fulltext.merged_postings(rows), "postings")
    size = rows.count(), int(index.agg(F.sum("tf")).first()[0] or 0)
    return fulltext.search(index, TEXT, size, None).select("chunk_id")


@query(_FTS + f"SELECT chunk_id, round(s.score, 6) AS score FROM s JOIN documents ON doc_id = chunk_id WHERE lang = 'en' ORDER BY s.score DESC, chunk_id LIMIT {K}")
def fts_kind_match(spark, sf_dir):
    """T4: kinds filter the hits, not the statistics."""
    return _found(fulltext.scan(_fts_rows(spark, sf_dir), TEXT, K, ["en"]))


POOL = 50
_ARMS = f"""
WITH d AS (SELECT chunk_id, ref, {_COSINE} AS distance, list_sum([((a[i] >= 0) <> (b[i] >= 0))::INT FOR i IN range(1, len(a) + 1)]) AS signs FROM {_E}),
arms AS (
  SELECT 'vector' AS arm, chunk_id, rank - 1 AS rank, greatest(0, least(1, 1 - distance)) AS score FROM (SELECT *, row_number() OVER (ORDER BY distance, ref) AS rank FROM d) WHERE rank <= {POOL}
  UNION ALL SELECT 'signs', chunk_id, rank - 1, -signs FROM (SELECT *, row_number() OVER (ORDER BY signs, chunk_id) AS rank FROM d) WHERE rank <= {POOL}
), fused AS (
  SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank + 1) ORDER BY rank) AS score, count(*) AS arms, min(rank) AS best FROM arms GROUP BY chunk_id ORDER BY score DESC, arms DESC, best, chunk_id LIMIT {K}
)
"""


def _arms(spark, sf_dir) -> list[fusion.Arm]:
    q = _first_vector(spark, sf_dir)
    rows = _vectors(spark, sf_dir)
    near = fusion.ranked(search.nearest(rows, q, POOL), "distance", "ref", "chunk_index", "chunk_id")
    signs = rows.withColumn("score", -V.hamming(V.to_bits(F.col("embedding")), V.to_bits(V.as_array(q)))).orderBy(F.desc("score"), "chunk_id").limit(POOL)
    return [fusion.Arm("vector", near), fusion.Arm("signs", fusion.ranked(signs, F.desc("score"), "chunk_id"))]


@query(_ARMS + "SELECT chunk_id, round(score, 6) AS score FROM fused")
def rrf_fuse(spark, sf_dir):
    """H3: two arms by reciprocal rank."""
    return _found(fusion.ReciprocalRank().fuse(_arms(spark, sf_dir), K))


@query(_ARMS + f"SELECT chunk_id, round(score, 6) AS score FROM arms WHERE arm = 'vector' AND rank < {K}")
def rrf_single_arm(spark, sf_dir):
    """H4: one arm with hits keeps its order and scores."""
    vector, signs = _arms(spark, sf_dir)
    signs.hits = signs.hits.limit(0)
    return _found(fusion.default_fusion().fuse([vector, signs], K))


@query(_ARMS + "SELECT chunk_id, arm, rank, round(arms.score, 6) AS score FROM fused JOIN arms USING (chunk_id)")
def hit_provenance(spark, sf_dir):
    """H8: rank and score in each arm."""
    hits = fusion.ReciprocalRank().fuse(_arms(spark, sf_dir), K).select("chunk_id", F.explode("provenance").alias("arm", "e"))
    return hits.select("chunk_id", "arm", F.col("e.rank").cast("bigint").alias("rank"), F.round("e.score", 6).alias("score"))


# context


def _turns(spark, sf_dir) -> DataFrame:
    """Turns as chunks; each answer hangs below the turn before it."""
    t = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    return t.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").cast("string").alias("ref"), F.col("turn").cast("int").alias("chunk_index"), F.when(F.col("role") == "assistant", F.col("conv_id") * 100_000 + F.col("turn") - 1).alias("parent_chunk_id"))


_TURNS = "(SELECT conv_id * 100000 + turn AS chunk_id, conv_id AS ref, turn AS chunk_index, CASE WHEN role = 'assistant' THEN conv_id * 100000 + turn - 1 END AS parent_chunk_id FROM conversations)"


@query(f"SELECT h.chunk_id AS hit_id, c.chunk_id FROM {_TURNS} h JOIN {_TURNS} c ON c.ref = h.ref AND abs(c.chunk_index - h.chunk_index) <= 2 AND c.parent_chunk_id IS NOT DISTINCT FROM h.parent_chunk_id")
def expand_window(spark, sf_dir):
    """Neighbours of every turn, by place in the record and of the same parent."""
    turns = _turns(spark, sf_dir)
    return context.expand(turns, turns.select("chunk_id"), window=2).select("hit_id", "chunk_id")


@query(f"SELECT h.chunk_id AS hit_id, c.chunk_id FROM {_TURNS} h JOIN {_TURNS} c ON c.ref = h.ref AND (c.chunk_id = h.chunk_id OR c.chunk_id = h.parent_chunk_id)")
def expand_parent(spark, sf_dir):
    """Parents first."""
    turns = _turns(spark, sf_dir)
    return context.expand(turns, turns.select("chunk_id"), include_parent=True).filter("chunk_id = hit_id or position = 0").select("hit_id", "chunk_id").distinct()


# services


@query("""
SELECT event_id, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'rate_limit' WHEN s IN (408, 504) THEN 'timeout' WHEN s >= 500 THEN 'server'
  WHEN contains(m, 'auth') THEN 'auth' WHEN contains(m, 'rate limit') THEN 'rate_limit' WHEN contains(m, 'timed out') THEN 'timeout' WHEN contains(m, 'connection reset') OR m = 'eof' THEN 'transport' ELSE 'dependency_unavailable' END AS failure_class
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 401 + user_id % 110 ELSE 0 END AS s, lower(CASE user_id % 6 WHEN 0 THEN 'Auth failed' WHEN 1 THEN 'Rate limit hit' WHEN 2 THEN 'it timed out' WHEN 3 THEN 'Connection reset' WHEN 4 THEN 'EOF' ELSE event_type END) AS m FROM events)
""")
def classify_failure(spark, sf_dir):
    """Failures by status and message."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    status = F.when(F.col("event_type") == "error", 401 + u % 110).otherwise(0)
    message = F.when(u % 6 == 0, "Auth failed").when(u % 6 == 1, "Rate limit hit").when(u % 6 == 2, "it timed out").when(u % 6 == 3, "Connection reset").when(u % 6 == 4, " EOF ").otherwise(F.col("event_type"))
    return e.select("event_id", failures.classified(status, message).alias("failure_class"))


@query("SELECT event_id, props AS object FROM events")
def extract_json_object(spark, sf_dir):
    """The object inside an answer with prose around it."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Here {it} is: "), "props", F.lit(" as asked.")).alias("answer"))
    return chat.json_objects(rows, "answer").select("event_id", "object")


@query("SELECT event_id, trim(event_type) || chr(10) || json_extract_string(props, '$.k') AS text FROM events")
def extract_message_text(spark, sf_dir):
    """Texts of a message's parts."""
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit(" "), "event_type").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(" ").alias("text")), F.struct(F.lit("text").alias("type"), F.get_json_object("props", "$.k").alias("text"))))
    return table(spark, sf_dir, "events").select("event_id", chat.content_texts(parts).alias("text"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN event_type ELSE 'inner ' || event_type END AS message FROM events")
def extract_error_message(spark, sf_dir):
    """The message in an error body."""
    body = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.col("event_type").alias("message"), F.lit("other").alias("error")))).otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("inner "), "event_type").alias("message")).alias("error"))))
    return table(spark, sf_dir, "events").select("event_id", failures.logged_message(body).alias("message"))


# end to end


@query()
def snapshot_search(spark, sf_dir):
    """An index of all conversations and documents is built, opened and searched."""
    rows = documents(spark, sf_dir).unionByName(adapters.from_conversations(table(spark, sf_dir, "conversations")), allowMissingColumns=True)
    path = f"{scratch.folder(spark)}/index-{uuid.uuid4().hex[:12]}"
    build.rebuild(spark, path, rows, build.BuildOptions(embedding.Fixture(dimension=32), policy=chunking.Late(4 * WINDOW, 0, OVERLAP)))
    hits = Snapshot(spark, path).search(TEXT, embedding.Fixture(dimension=32), K)
    return hits.select("chunk_id", "ref", "kind", "heading", F.round("score", 6).alias("score"), F.array_join(F.array_sort(F.map_keys("provenance")), ",").alias("arms"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search over all documents."""
    hits = fulltext.scan(_fts_rows(spark, sf_dir), TEXT, K)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source", "text")
    return docs.join(F.broadcast(hits), "chunk_id").orderBy(F.desc("score"), "chunk_id")  # K hits at most
