import random

import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lexaquarry.llm import sentencepiece_codec as S

from . import cases

MODEL = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
PIECES = S.Pieces.load(S.MODEL)
ODD = ["hello world", "  two  blanks ", "tab\tand\nline", "日本語 text", "emoji 🙂🙂 end", "<s> </s> <unk>", "a" * 300, "ééé", "x\u0000y", "▁ marks ▁", "1234 567.89", "İstanbul", " ", "don't", "...!?", "a b", "supercalifragilistic" * 8]


def test_ids_are_the_libraries(spark):
    rows = cases.rough(4) + [(7000 + i, t) for i, t in enumerate(ODD)]
    out = S.encode(cases.documents(spark, rows))
    want = sorted(repr((i, None if t is None else MODEL.encode(t))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.ids)) for r in out.collect()) == want
    assert all(r.n_pieces == (None if r.ids is None else len(r.ids)) for r in out.collect())


def test_the_dictionary_changes_nothing(spark):
    docs = cases.documents(spark, cases.rough(6))
    small = sorted(repr((r.doc_id, r.ids)) for r in S.encode(docs, dictionary_bytes=2000).collect())
    none = sorted(repr((r.doc_id, r.ids)) for r in S.encode(docs, dictionary_bytes=0).collect())
    assert small == none == sorted(repr((r.doc_id, r.ids)) for r in S.encode(docs).collect())


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "")]
    out = S.encode(cases.documents(spark, rows))
    back = {r.doc_id: r.text for r in S.decode(out).collect()}
    same = {r.doc_id: r.round_trip for r in out.collect()}
    for i, t in rows:
        assert same[i] == (None if t is None else "▁" not in t)
        if same[i] is not False:
            assert back[i] == t


def test_nothing(spark):
    out = S.encode(cases.documents(spark, []))
    assert out.collect() == [] and S.decode(out).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_units_in_place(text):
    import pyarrow as pa

    ids, _ = S.encode_texts(pa.array([text]), PIECES, S.Dictionary(*[S.np.zeros(0, t) for t in (S.np.uint64, S.np.int64, S.np.uint32)]))
    assert ids.tolist() == MODEL.encode(text)


TOY = S.Pieces([("<unk>", 0.0, "unknown"), *[(p, s, "piece") for p, s in [("▁", -4.0), ("a", -3.0), ("b", -3.1), ("ab", -4.5), ("aba", -5.0), ("▁a", -3.5), ("bab", -5.5), ("ba", -4.6), ("▁ab", -6.0)]]], bpe=False)


def best_path(unit):
    """The best sum by trying every split."""
    best = None
    for mask in range(1 << (len(unit) - 1)):
        cuts = [0, *[i + 1 for i in range(len(unit) - 1) if mask >> i & 1], len(unit)]
        parts = [unit[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in TOY.scores or (len(p) == 1) for p in parts):
            s = sum(TOY.scores.get(p, TOY.unknown_score) for p in parts)
            best = s if best is None or s > best + 1e-9 else best
    return best


def test_unigram_lattice_is_viterbi(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    units = sorted({u for t in texts for u in regex.findall(TOY.unit, "▁" + t.replace(" ", "▁"))})
    words = spark.createDataFrame([(u,) for u in units], "unit string")
    paths = {r.unit: r.path for r in S.encoded_units(words, TOY).collect()}
    for u in units:
        covered, total = 0, 0.0
        for x in paths.get(u) or []:
            covered += x.e - x.s
            total += TOY.scores[u[x.s : x.e]]
        total += TOY.unknown_score * (len(u) - covered)
        assert total == pytest.approx(best_path(u))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in S.encode(docs, TOY).collect():
        s = sum(TOY.scores.get(p, TOY.unknown_score) for p in (next((k for k, v in TOY.ids.items() if v == i), None) for i in r.ids))
        want = sum(best_path(u) for u in regex.findall(TOY.unit, "▁" + texts[r.doc_id].replace(" ", "▁")))
        assert s == pytest.approx(want)
