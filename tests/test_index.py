import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexaquarry import constants as C
from lexaquarry.functions.text import query_tokens
from lexaquarry.operators import chunking, embedding, fusion
from lexaquarry.plans import build
from lexaquarry.sources import files
from lexaquarry.sources.snapshot import Snapshot, open_snapshot, read_stats, search_index

EMB = embedding.Fixture(dimension=16)
DOCS = [
    ("guide", "note", "Sync guide", "# Burst\nbackground workers send batches of updates\n# Retry\nwait and try again when the server is busy"),
    ("codes", "reference", "Error codes", "# Codes\nERR_TIMEOUT_42 means that the upload took too long"),
    ("plan", "note", "Plan", "nothing of note " * 12),
    ("empty", "note", "Empty", "  "),
]


def records(spark, rows=DOCS):
    return spark.createDataFrame([(*r, {"lang": "en"}) for r in rows], "ref string, kind string, title string, body_text string, metadata map<string,string>")


def options(**more):
    return build.BuildOptions(embedder=EMB, **more)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = f"file://{tmp_path_factory.mktemp('index')}/a"
    build.rebuild(spark, p, records(spark), options())
    return p


def content(spark, path):
    """What an index says, without ids and times."""
    s = Snapshot(spark, path)
    rows = s.sections(embeddings=True).drop("chunk_id").collect()
    return [(r.ref, r.heading, r.content, [round(x, 5) for x in r.embedding]) for r in rows], s.manifest["content_fingerprint"], sorted(tuple(r) for r in s.table("postings").groupBy("term").agg(F.sum("tf")).collect())


def test_stats_and_scans(spark, path):
    stats = read_stats(spark, path)
    assert (stats.records, stats.chunks, stats.kinds) == (4, 4, {"note": 3, "reference": 1}) and stats.embedder_dimension == 16 and stats.schema_version == 5
    s = open_snapshot(spark, path)
    assert [r.ref for r in s.records().collect()] == ["codes", "empty", "guide", "plan"] and s.records(kinds=[" reference "]).count() == 1
    rows = s.sections(refs=["guide"]).collect()
    assert [(r.heading, r.chunk_index, r.metadata) for r in rows] == [("Burst", 0, {"lang": "en"}), ("Retry", 1, {"lang": "en"})]
    assert [r.chunk_id for r in s.sections().collect()] == [1, 2, 3, 4]


def test_search(spark, path):
    s = Snapshot(spark, path)
    top = s.search("ERR_TIMEOUT_42", EMB).collect()
    assert top[0].ref == "codes" and set(top[0].provenance) == {"vector", "fts"} and top[0].provenance["fts"]["rank"] == 0
    assert [r.ref for r in s.search("background workers batches", EMB, limit=1).collect()] == ["guide"]
    assert {r.kind for r in s.search("ERR_TIMEOUT_42", EMB, kinds=["note"]).collect()} == {"note"}
    assert search_index(spark, path, "workers", EMB, limit=2).count() == 2
    flipped = s.search("workers", EMB, reranker=lambda h: h.withColumn("position", -F.col("position"))).collect()
    assert [r.chunk_id for r in flipped] == [r.chunk_id for r in s.search("workers", EMB).collect()][::-1]
    for bad, why in ((lambda: s.search("  ", EMB), "text"), (lambda: s.search("x", None), "embedder"), (lambda: s.search("x", embedding.Fixture(dimension=8)), "made by"), (lambda: s.search("x", EMB, limit=251), "limit"), (lambda: s.search_vector([1.0]), "dimension")):
        with pytest.raises(ValueError, match=why):
            bad()


def test_vector_search_agrees_over_quantizations(spark, tmp_path):
    q = EMB.queries(["background workers batches"])[0]
    for mode in C.QUANTIZATIONS:
        p = f"file://{tmp_path}/{mode}"
        build.rebuild(spark, p, records(spark), options(quantization=mode))
        hits = Snapshot(spark, p).search_vector(q, limit=2).collect()
        assert hits[0].heading == "Burst" and 0 <= hits[1].score <= hits[0].score <= 1
    with pytest.raises(ValueError):
        Snapshot(spark, p).search("workers", EMB, dimension=8)


def test_parents_are_kept_but_not_searched(spark, tmp_path):
    p = f"file://{tmp_path}/late"
    build.rebuild(spark, p, records(spark), options(policy=chunking.Late(6, 0, 1)))
    s = Snapshot(spark, p)
    parents = [r.chunk_id for r in s.table("chunks").filter("is_parent").collect()]
    assert parents and s.table("vectors").filter(F.col("chunk_id").isin(parents)).count() == 0 and s.table("postings").filter(F.col("chunk_id").isin(parents)).count() == 0
    leaf = s.table("chunks").filter(f"parent_chunk_id = {parents[0]}").orderBy("chunk_index").first()
    around = s.expand_context(leaf.chunk_id, include_parent=True, window=1).collect()
    assert [r.chunk_id for r in around][:2] == [parents[0], leaf.chunk_id] and around[0].metadata == {"lang": "en"}
    assert s.expand_context([10_000]).collect() == []


def test_update_is_a_rebuild(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    build.rebuild(spark, a, records(spark), options())
    old = Snapshot(spark, a)
    before = {r.chunk_id for r in old.chunks().collect()}
    changed = [("guide", "note", "Sync guide", DOCS[0][3] + "\n# New\nmore"), ("fresh", "note", "Fresh", "# One\nbrand new words")]
    done = build.update(spark, a, records(spark, changed), ["plan", " nowhere "], options())
    assert (done.added, done.removed, done.records, done.reused, done.embedded) == (2, 1, 4, 2, 2)
    build.rebuild(spark, b, records(spark, [DOCS[1], DOCS[3], *changed]), options())
    assert content(spark, a) == content(spark, b)
    assert old.chunks().count() == 4  # an open snapshot stays
    now = Snapshot(spark, a)
    assert min(r.chunk_id for r in now.chunks().filter("ref = 'fresh'").collect()) > max(before)
    assert now.manifest["created_at"] == old.manifest["created_at"] and "updated_at" in now.manifest
    build.update(spark, a, None, ["fresh"], build.BuildOptions())
    assert Snapshot(spark, a).records(refs=["fresh"]).count() == 0
    # the segments of older generations are still part of the index, until they are merged
    final = content(spark, a)
    assert build.vacuum(spark, a) == [] and len(Snapshot(spark, a).segments) == 2 and read_stats(spark, a).records == 3
    assert build.compact(spark, a) and len(build.vacuum(spark, a)) == 3 and not build.compact(spark, a)
    assert content(spark, a) == final and len(Snapshot(spark, a).segments) == 1 and Snapshot(spark, a).dead == []


def test_many_updates_are_merged(spark, tmp_path, monkeypatch):
    """Removed and given again, replaced, merged on the way: always a rebuild of what is there."""
    monkeypatch.setattr(build, "FAN_IN", 2)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    build.rebuild(spark, a, records(spark), options())
    rows = {r[0]: r for r in DOCS}
    steps = [([("one", "note", "One", "first words")], []), ([], ["one", "guide"]), ([("one", "note", "One", "other words"), ("guide", "note", "G", "back again")], ["codes"]), ([("one", "note", "One", "third words")], ["plan"]), ([("two", "note", "Two", "the last")], [])]
    for new, gone in steps:
        done = build.update(spark, a, records(spark, new) if new else None, gone, options())
        for ref in gone:
            rows.pop(ref, None)
        rows |= {r[0]: r for r in new}
        assert done.records == len(rows)
    s = Snapshot(spark, a)
    build.rebuild(spark, b, records(spark, list(rows.values())), options())
    new = Snapshot(spark, b)
    assert content(spark, a) == content(spark, b) and len(s.segments) < 5  # of six
    assert [s.manifest[c] for c in ("records", "chunks", "indexed_chunks", "indexed_tokens")] == [new.manifest[c] for c in ("records", "chunks", "indexed_chunks", "indexed_tokens")]
    hits = lambda x: [(r.ref, round(r.score, 9)) for r in x.search("third words", EMB).collect()]
    assert hits(s) == hits(new) and hits(s)[0][0] == "one"


def test_an_update_writes_what_changed(spark, tmp_path):
    """The bytes that one changed record costs don't depend on the index."""
    from pathlib import Path

    sizes = []
    for n in (20, 2000):
        p = tmp_path / str(n)
        many = [(f"r{i:05d}", "note", f"Title {i}", f"# Head\nwords of record {i} and of others") for i in range(n)]
        build.rebuild(spark, f"file://{p}", records(spark, many), options())
        before = {f for f in p.rglob("*") if f.is_file()}
        build.update(spark, f"file://{p}", records(spark, [("r00007", "note", "Title 7", "# Head\nother words")]), ["r00003"], options())
        sizes.append(sum(f.stat().st_size for f in p.rglob("*") if f.is_file() and f not in before))
        s = Snapshot(spark, f"file://{p}")
        assert s.table("records").count() == n - 1 and s.manifest["chunks"] == n - 1
    assert sizes[1] < 1.3 * sizes[0]


def test_a_text_arm_that_fails(spark, tmp_path):
    """It reaches a strategy of one's own as an arm with its error; the default gives none of the others' hits."""
    from pathlib import Path

    p = f"file://{tmp_path}/t"
    build.rebuild(spark, p, records(spark), options())
    s = Snapshot(spark, p)
    for f in Path(s.base.removeprefix("file://"), "postings").iterdir():
        f.write_bytes(b"no parquet")
    seen = {}

    class Vectors:
        def fuse(self, arms, limit):
            seen.update({a.name: a for a in arms})
            return fusion.ReciprocalRank().fuse([a for a in arms if a.available], limit)

    broken = Snapshot(spark, p)
    assert broken.search("background workers batches", EMB, fusion_strategy=Vectors()).first().ref == "guide"
    arm = seen[C.TEXT_ARM]
    assert not arm.available and arm.hits is None and isinstance(arm.error, Exception) and seen[C.VECTOR_ARM].available
    with pytest.raises(RuntimeError, match="fts"):
        broken.search("workers", EMB)
    files.remove(spark, f"{s.base}/postings")
    without = Snapshot(spark, p)
    assert without.search("workers", EMB, fusion_strategy=Vectors()).count() > 0 and seen[C.TEXT_ARM].error is None and not seen[C.TEXT_ARM].available
    files.remove(spark, f"{s.base}/vectors")
    with pytest.raises(Exception) as e:
        Snapshot(spark, p).search("workers", EMB, fusion_strategy=Vectors())
    assert not isinstance(e.value, RuntimeError)


def test_update_guards(spark, path, monkeypatch):
    one = records(spark, DOCS[:1])
    for kw, why in (({"added": None, "removed": ["x"], "options": build.BuildOptions(quantization="int8")}, "float32"), ({"added": one, "removed": None, "options": build.BuildOptions()}, "embedder"), ({"added": one, "removed": ["guide"], "options": options()}, "both"), ({"added": one.union(one), "removed": [], "options": options()}, "duplicate"), ({"added": one, "removed": [], "options": options(policy=chunking.Flat(), max_tokens=3)}, "max_tokens"), ({"added": None, "removed": [], "options": build.BuildOptions(embedder=embedding.Fixture(dimension=4))}, "another embedder")):
        with pytest.raises(ValueError, match=why):
            build.update(spark, path, **kw)
    with pytest.raises(C.UpdatePlanTooLarge):
        build.update(spark, path, records(spark), [], options(max_planned_records=2))
    generation = Snapshot(spark, path).generation
    monkeypatch.setattr(build, "current", lambda *_: "gen-other")
    with pytest.raises(C.StaleUpdatePlan):
        build.update(spark, path, one, [], options())
    assert files.read(spark, f"{path}/CURRENT") == generation
    assert [x for x in files.names(spark, path) if x.startswith("gen-")] == [generation]  # nothing half-made stays


def test_a_failed_build_leaves_the_old_index(spark, tmp_path, monkeypatch):
    p = f"file://{tmp_path}/x"
    build.rebuild(spark, p, records(spark), options())
    was = Snapshot(spark, p).generation
    monkeypatch.setattr(build.fulltext, "postings", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        build.rebuild(spark, p, records(spark, DOCS[:1]), options())
    assert Snapshot(spark, p).generation == was and read_stats(spark, p).records == 4


class Counting:
    """An embedder in plain Python that says how it was called."""

    fingerprint = "counting"

    def dimension(self):
        return 4

    def documents(self, texts):
        return [[float(len(t)), 1.0, 0.0, 0.0] for t in texts]

    queries = documents

    def chunks(self, document, texts):
        return [[float(len(document)), float(len(t)), 1.0, 0.0] for t in texts]


def test_reuse(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    first = build.rebuild(spark, a, records(spark), options())
    assert (first.reuse_status, first.embedded) == (C.ReuseStatus.DISABLED, 4 - 0)
    moved = [DOCS[0], ("codes2", *DOCS[1][1:]), (DOCS[2][0], "note", "Other title", DOCS[2][3])]
    second = build.rebuild(spark, b, records(spark, moved), options(reuse_from=a))
    # the same record's chunks alone: another ref or another title is embedded anew
    assert (second.reuse_status, second.reused, second.embedded, second.unchanged_records) == (C.ReuseStatus.ACTIVE, 2, 2, 1)
    assert build.rebuild(spark, b, records(spark), options(reuse_from=f"file://{tmp_path}/none")).reuse_status == C.ReuseStatus.UNAVAILABLE
    other = build.rebuild(spark, b, records(spark), build.BuildOptions(Counting(), reuse_from=a))
    assert other.reuse_status == C.ReuseStatus.INCOMPATIBLE and "embedder" in other.reuse_reason
    whole = Snapshot(spark, b).sections(refs=["guide"], embeddings=True).collect()
    assert {r.embedding[0] for r in whole} == {float(len("Sync guide\n\n" + DOCS[0][3]))}  # it saw the whole document


def test_context(spark, tmp_path):
    p = f"file://{tmp_path}/c"
    hook = lambda record, sections: [f"about {record['title']}" if h == "Burst" else " " for h, _ in sections]
    build.rebuild(spark, p, records(spark), options(contextualizer=hook))
    s = Snapshot(spark, p)
    assert {r.heading: r.context_prefix for r in s.sections(refs=["guide"]).collect()} == {"Burst": "about Sync guide", "Retry": ""}
    assert s.table("postings").filter("term = 'about'").count() == 1
    with pytest.raises(Exception, match="contexts"):
        build.rebuild(spark, p, records(spark), options(contextualizer=lambda r, s: []))


def test_bad_indexes(spark, tmp_path):
    with pytest.raises(C.MissingIndex):
        Snapshot(spark, f"file://{tmp_path}/nothing")
    p = f"file://{tmp_path}/v"
    build.rebuild(spark, p, records(spark), options())
    s = Snapshot(spark, p)
    files.replace(spark, f"{s.base}/manifest.json", json.dumps(s.manifest | {"quantization": "odd"}))
    broken = Snapshot(spark, p)
    assert broken.records().count() == 4
    with pytest.raises(ValueError, match="quantization"):
        broken.search_vector([0.0] * 16)
    files.replace(spark, f"{s.base}/manifest.json", json.dumps(s.manifest | {"schema_version": 9}))
    with pytest.raises(C.UnsupportedSchemaVersion):
        Snapshot(spark, p)


@pytest.mark.parametrize("version", [2, 3, 4])
def test_migration(spark, tmp_path, version):
    p = f"file://{tmp_path}/m{version}"
    build.rebuild(spark, p, records(spark), options())
    new = content(spark, p)
    s = Snapshot(spark, p)
    lost = ["parent_chunk_id"] + ["context_prefix"] * (version < 3)
    old = s.table("chunks").drop(*lost, "is_parent").collect()
    spark.createDataFrame(old, s.table("chunks").drop(*lost, "is_parent").schema).write.mode("overwrite").parquet(f"{s.base}/chunks")
    files.replace(spark, f"{s.base}/manifest.json", json.dumps(s.manifest | {"schema_version": version}))
    assert Snapshot(spark, p).sections(embeddings=True).count() == 4  # read as it is
    assert build.migrate(spark, p) == version and content(spark, p) == new and build.migrate(spark, p) == 5


def test_fixture_embedder_in_catalyst_and_python(spark):
    texts = ["", "one", "Naïve naïve ÜBER 42", "a_b c-d a_b", "İ Σ", "word " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", EMB.column(F.col("t"))).collect())]
    for a, b, c in zip(got, EMB.documents(texts), EMB.matrix(pa.array(texts)).tolist()):
        assert a == pytest.approx(b, abs=1e-12) and c == pytest.approx(b, abs=1e-12)
    assert EMB.matrix(pa.array([], pa.string())).shape == (0, 16) and EMB.matrix(pa.array([None, ""])).sum() == 0
    assert query_tokens("Naïve İx ½ a-b", spark) == ["naive", "ix", "a", "b"]


def test_stream(spark, tmp_path):
    from lexaquarry.streaming.updates import follow

    p, inbox = f"file://{tmp_path}/s", tmp_path / "inbox"
    build.rebuild(spark, p, records(spark, DOCS[:2]), options())
    schema = "ref string, kind string, title string, body_text string, deleted boolean, seq int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(inbox))
    put([("guide", "note", "G", "old text", False, 1), ("guide", "note", "G", "latest text", False, 2), ("codes", None, None, None, True, 1)])
    run = lambda: follow(spark.readStream.schema(schema).json(str(inbox)), p, options(), f"file://{tmp_path}/check", "deleted", {"availableNow": True}).awaitTermination()
    run()
    s = Snapshot(spark, p)
    assert [(r.ref, r.body_text) for r in s.records().collect()] == [("guide", "latest text")]
    put([("new", "note", "N", "another", False, 1)])
    run()
    assert [r.ref for r in Snapshot(spark, p).records().collect()] == ["guide", "new"]
