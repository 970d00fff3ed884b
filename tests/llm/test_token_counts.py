import random

import pytest

from lexaquarry.llm import token_counts as K

from . import cases

ENCODING = K.encoder(open(K.VOCABULARY, "rb").read())[0]


def want(rows):
    return sorted(repr((i, None if t is None else len(ENCODING.encode_ordinary(t)))) for i, t in rows)


def got(df):
    return sorted(repr((r.doc_id, r.n_tokens)) for r in df.collect())


def long_texts():
    rng = random.Random(3)
    prose = cases.prose(rng, 3000)
    return [prose, "a" * 9000, " " * 5000 + "x", "\n\n\n" * 900 + prose[:3000], "日本語" * 2000, "é " * 3000, "1234567890" * 500, "don't " * 1500, "🙂" * 2500, "ab" * 700 + " " + "cd" * 2000, "x́" * 3000, " \t\n" * 1500]


@pytest.mark.parametrize("chunk,overlap", [(400, 40), (97, 9), (50, 1)])
def test_spliced_counts_are_exact(spark, chunk, overlap):
    rows = list(enumerate(long_texts())) + [(3, long_texts()[0])]
    assert got(K.token_counts(cases.documents(spark, rows), huge=300, chunk=chunk, overlap=overlap)) == want(rows)


def test_production_parameters(spark):
    rows = cases.rough(5) + [(1, "<|endoftext|> is text"), (2, "word " * 30_000), (2, "word " * 30_000), (None, "y" * 40_000)]
    assert got(K.token_counts(cases.documents(spark, rows))) == want(rows)


def test_nothing(spark):
    assert K.token_counts(cases.documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        K.token_counts(cases.documents(spark, []), chunk=0)


def test_boundaries_are_where_whole_texts_split():
    """No token crosses a boundary that is called stable, whatever stands around it."""
    rng = random.Random(8)
    alphabet = "ab é1'.\n\t 🙂s日́"
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(30))
        ends, at = {0}, 0
        for t in ENCODING.encode_ordinary(text):
            at += len(ENCODING.decode_single_token_bytes(t))
            ends.add(at)
        assert set(K.stable_boundaries(text)) <= ends
