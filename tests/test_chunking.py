import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaquarry.constants import TooManySections
from lexaquarry.functions.text import WHITE
from lexaquarry.operators import chunking as K


def record(body, kind="note", fmt="markdown", title="Spec"):
    return K.Record("r", kind, title, fmt, body)


def pairs(sections):
    return [(s.heading, s.body) for s in sections]


def test_headings():
    body = "intro\r\n\r\n## Needs\nfast\n### Burst\n- a\n# Roll out\nlater\n####### seven\n#\tTab"
    assert pairs(K.markdown_sections("Spec", body)) == [("Spec", "intro"), ("Needs", "fast"), ("Needs / Burst", "- a"), ("Roll out", "later\n####### seven\n#\tTab")]
    assert pairs(K.markdown_sections(" Spec ", "# A\n## B")) == [("Spec", "# A\n## B")]
    assert pairs(K.markdown_sections("Spec", " \n ")) == []
    assert pairs(K.markdown_sections("Spec", "```\n  # code\nx\n```")) == [("Spec", "```"), ("code", "x\n```")]
    assert pairs(K.markdown_sections("Spec", "# A\n\n### C\nc\n## B\nb")) == [("A / C", "c"), ("A / B", "b")]


@pytest.mark.parametrize("line,want", [("# a", (1, "a")), ("  ###### a b ", (6, "a b")), ("#a", None), ("# ", None), ("####### a", None), ("#  # a #", (1, "# a #")), ("", None)])
def test_heading_lines(line, want):
    assert K.heading_of(line) == want


def test_windows():
    split = lambda body, most, overlap=0: [s.body for s in K.split_section(K.Section("h", body), most, overlap)]
    assert split("a b c d e f g h i j", 5, 2) == ["a b c d e", "d e f g h", "g h i j"]
    assert split("one two\n\n    indented code line", 2) == ["one two", "    indented code", "line"]
    assert split("- a b\n- c d", 3) == ["- a b", "- c d"]
    assert split("a b c d", 2) == ["a b", "c d"]
    for same in ((0, 0), (2, 2), (9, 0), (-1, 0)):
        assert split("a b c", *same) == ["a b c"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t-# ", max_size=80), st.integers(1, 6), st.integers(-1, 5))
def test_windows_cover_the_text(body, most, overlap):
    words = lambda t: [w for w in re.split(f"[{WHITE}]+", t) if w]
    out = K.split_section(K.Section("h", body), most, overlap)
    if overlap >= most or len(words(body)) <= most:
        assert out == [K.Section("h", body)]
        return
    step = most - max(0, overlap)
    for i, s in enumerate(out):
        assert words(s.body) == words(body)[i * step : i * step + most]
    assert sum(len(words(s.body)) for s in out) == len(words(body)) + max(0, overlap) * (len(out) - 1)


def test_caps():
    body = "".join(f"# {i}\nx\n" for i in range(20))
    assert len(K.Flat(max_sections=20).sections(record(body))) == 20
    for p in (K.Flat(max_sections=19), K.Late(2, max_sections=19), K.Flat(1, max_sections=3)):
        with pytest.raises(TooManySections):
            p.sections(record(body + "y z"))
    assert len(K.Flat(max_sections=-1).sections(record("".join(f"# {i}\nx\n" for i in range(10_050))))) == 10_050
    with pytest.raises(TooManySections):
        K.Flat(max_sections=0).sections(record("".join(f"# {i}\nx\n" for i in range(10_050))))


def test_late():
    out = K.Late(6, child_overlap=1).sections(record("# Head\n" + "alpha bravo charlie delta " * 8 + "\n# Small\none two"))
    assert out[0].parent == -1 and [s.parent for s in out[1:-1]] == [0] * 7 and out[-1] == K.Section("Small", "one two", -1)
    with pytest.raises(ValueError):
        K.Late(0).sections(record("x"))
    plain = K.Late(2).sections(record("a b c", fmt="plaintext"))
    assert plain == [K.Section("Spec", "a b c", -1), K.Section("Spec", "a b", 0), K.Section("Spec", "c", 0)]


def test_policies():
    by = K.ByKind({"code": K.Flat(1)}, K.Flat())
    assert len(by.sections(record("a b", "code"))) == 2 and len(by.sections(record("a b"))) == 1
    with pytest.raises(ValueError):
        K.ByKind({}).sections(record("a"))
    with pytest.raises(ValueError, match="max_tokens"):
        K.policy_of(K.Flat(), max_tokens=3)
    with pytest.raises(ValueError):
        K.check_lineage([K.Section("h", "b", 0)], "r")


def test_over_records(spark):
    rows = spark.createDataFrame([("a", "note", "A", "markdown", "# X\n" + "w " * 10), ("b", "note", "B", "plaintext", "# no heading"), ("c", "note", "C", "plaintext", "  ")], "ref string, kind string, title string, body_format string, body_text string")
    marked = K.mark_parents(K.chunk(rows, K.Late(4)))
    got = [tuple(r) for r in marked.orderBy("ref", "chunk_index").select("ref", "chunk_index", "heading", "parent_index", "is_parent").collect()]
    assert got == [("a", 0, "X", -1, True), ("a", 1, "X", 0, False), ("a", 2, "X", 0, False), ("a", 3, "X", 0, False), ("b", 0, "B", -1, False)]
    assert K.lineage_violations(marked).count() == 0
    assert K.lineage_violations(marked.withColumn("parent_index", F.lit(2))).count() == 5 - 2 + 1
    windows = rows.select(K.word_windows(F.col("body_text"), 4, 1).alias("w")).collect()
    assert [len(r.w) for r in windows] == [4, 1, 0]
