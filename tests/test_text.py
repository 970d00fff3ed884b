import re
import sqlite3
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaquarry import constants as C
from lexaquarry.functions import text as T

ODD = ["", " ", "\t a \n", "   x　\x85", "a  b", "İstanbul ΣΟΦΟΣ", "x² ½ Ⅷ", "日本語 text", "naïve Ünïcode ộ", "don't stop", "\x1fkept\x1f", "🙂 a_b-c"]


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column(F.col("t"))).collect())]


def test_trim(spark):
    white = T.WHITE
    assert values(spark, ODD, T.trim_white) == [t.strip(white) for t in ODD]


def test_quoted_text_never_joins_to_the_same(spark):
    texts = ['a"b', "a\\b", "tab\tline\nbell\a", "\x01\x7f", "\u0085", "\u00a0", "é日🙂", "\u200b", "\U000e0001"]
    assert values(spark, texts, T.quoted) == ['"a\\"b"', '"a\\\\b"', '"tab\\tline\\nbell\\a"', '"\\x01\\x7f"', '"\\u0085"', '"\\u00a0"', '"é日🙂"', '"\\u200b"', '"\\U000e0001"']


def tokens(t):
    low = t.replace("İ", "i").replace("Σ", "σ").lower()
    return "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in low).split()


def test_tokens_and_words(spark):
    assert values(spark, ODD, T.tokens) == [tokens(t) for t in ODD]
    assert values(spark, ODD, T.count_words) == [len([w for w in re.split(f"[{T.WHITE}]+", t) if w]) for t in ODD]


def fnv(t):
    h = 2166136261
    for b in t.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv(spark):
    assert values(spark, ["", "a", "foobar", "é", "日本"], T.fnv1a) == [fnv(t) for t in ["", "a", "foobar", "é", "日本"]]
    assert fnv("foobar") == 0xBF9CF968


def test_search_tokens_are_those_of_fts5(spark):
    """The same terms as SQLite's own tokenizer."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    letters = [chr(i) for i in [*range(0xAA, 0x250), *range(0x370, 0x520), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(i))[0] == "L"]
    texts = [t for t in ODD if "İ" not in t and "🙂" not in t] + ["".join(f"q{c}z " for c in letters[i : i + 50]) for i in range(0, len(letters), 50)] + ["étude", "äb"]
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    want = {i: [] for i in range(len(texts))}
    for term, doc, _, place in sorted(con.execute("SELECT term, doc, col, offset FROM v"), key=lambda r: (r[1], r[3])):
        want[doc].append(term)
    got = values(spark, texts, T.search_tokens)
    # letters younger than SQLite's tables: its lower case doesn't know them
    wrong = [(a, b) for i in want for a, b in zip(got[i], want[i]) if a != b]
    assert all(len(got[i]) == len(want[i]) for i in want) and len(wrong) <= 8, wrong


@settings(max_examples=50, deadline=None)
@given(st.integers(-5, 400))
def test_limits(limit):
    if limit > 250:
        with pytest.raises(ValueError):
            C.search_limit(limit)
    else:
        assert C.search_limit(limit) == (limit if limit > 0 else 10)
        assert 25 <= C.pool_size(C.search_limit(limit)) <= 250


def test_settings():
    assert C.quantization(" INT8 ") == C.INT8 and C.quantization(None) == C.FLOAT32
    with pytest.raises(ValueError):
        C.quantization("float16")
    assert C.section_cap(-1) is None and C.section_cap(0) == 10_000 and C.section_cap(7) == 7
    assert C.search_dimension(0, 64, C.INT8) is None and C.search_dimension(64, 64, C.FLOAT32) is None and C.search_dimension(16, 64, C.FLOAT32) == 16
    for bad in ((16, 64, C.INT8), (65, 64, C.FLOAT32)):
        with pytest.raises(ValueError):
            C.search_dimension(*bad)
    assert C.listed([" a ", "", "a"]) == ["a"] and C.listed_kinds([" a", ""]) == ["a", ""] and C.listed_kinds([]) is None
