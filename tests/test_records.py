import hashlib

import pytest
from pyspark.errors import PySparkException

from lexaquarry.constants import UpdatePlanTooLarge
from lexaquarry.operators import records as R


def rows(spark, *items):
    names = "ref kind title source_ref body_format body_text content_hash".split()
    return spark.createDataFrame([tuple(i.get(n) for n in names) + (i.get("metadata"),) for i in items], ", ".join(f"{n} string" for n in names) + ", metadata map<string,string>")


def one(spark, **item):
    return R.normalize(rows(spark, item)).first()


def test_defaults(spark):
    r = one(spark, ref=" a ", body_text=" text\n", metadata={" k ": " v ", " ": "x"})
    assert (r.ref, r.kind, r.title, r.source_ref, r.body_format, r.body_text, r.metadata, r.error) == ("a", "artifact", "a", "a", "markdown", "text", {"k": "v"}, None)
    assert one(spark, ref="a", metadata={"": "x"}).metadata is None
    assert one(spark, ref="a", metadata={"k": "1", " k": "2", "k ": "3"}).metadata == {"k": "3"}
    assert one(spark, ref="a", content_hash=" given ").content_hash == "given"


def test_hash(spark):
    r = one(spark, ref="a", kind="note", title="T", body_format="plaintext", body_text='say "x"\n1', metadata={"b": "2", "a": "1"})
    parts = sorted(['"kind"="note"', '"title"="T"', '"body_format"="plaintext"', '"body_text"="say \\"x\\"\\n1"', '"metadata.a"="1"', '"metadata.b"="2"'])
    assert r.content_hash == hashlib.sha256("\n".join(parts).encode()).hexdigest()
    assert one(spark, ref="b", title="T").content_hash == one(spark, ref="c", title="T").content_hash  # refs don't count
    a, b = one(spark, ref="x", title="real", metadata={"k": ""}), one(spark, ref="x", title="t", metadata={"k": "\ntitle=real"})
    assert a.content_hash != b.content_hash


def test_errors(spark):
    assert one(spark, ref=" ").error == "record ref is required"
    assert one(spark, ref="a", body_format="html").error == 'unsupported body format "html"'
    with pytest.raises(PySparkException, match="unsupported body format"):
        R.validated(rows(spark, {"ref": "a", "body_format": "html"})).collect()


def test_fingerprint(spark):
    pairs = [(f"r{i}", f"h{i % 7}") for i in range(500)]
    want = hashlib.sha256("\n".join(sorted(f"{a}:{b}" for a, b in pairs)).encode()).hexdigest()
    for some in (pairs, pairs[::-1]):
        assert R.fingerprint(spark.createDataFrame(some, "ref string, content_hash string")).first()[0] == want
    none = spark.createDataFrame([], "ref string, content_hash string")
    assert R.fingerprint(none).collect() == [(hashlib.sha256(b"").hexdigest(),)]
    with pytest.raises(PySparkException):
        R.fingerprint(spark.createDataFrame([("a", "")], "ref string, content_hash string")).collect()


def test_filters_and_guards(spark):
    some = rows(spark, {"ref": "a", "kind": "x"}, {"ref": "b", "kind": "y"}, {"ref": "b", "kind": "z"})
    assert R.pick(some, refs=["", " "]).count() == 3 and R.pick(some, refs=[" b "], kinds=["y"]).count() == 1
    with pytest.raises(ValueError, match="duplicate added record ref 'b'"):
        R.require_distinct(some, "added")
    gone = R.removed_refs(spark, [" c", "", "c", "a "])
    assert [r.ref for r in gone.collect()] == ["a", "c"]
    with pytest.raises(ValueError, match="both added and removed"):
        R.require_disjoint(some, gone)
    with pytest.raises(UpdatePlanTooLarge):
        R.require_planned(some, 2)
    R.require_planned(some, 3)
    with pytest.raises(ValueError):
        R.require_planned(some, -1)
