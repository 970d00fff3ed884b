import random
import unicodedata
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pytest

from lexaquarry.llm import toxicity as X

from . import cases


def spell(word):
    codes = [X.START, *[int(X._CODES[b]) for b in word.encode()], X.END]
    out = {}
    for places in combinations(range(len(codes)), X.P):
        span = places[-1] - places[0]
        if span < X.SPAN + 0 and span <= X.SPAN:
            key = tuple(codes[p] for p in places)
            out[key] = out.get(key, 0.0) + X.DECAY ** (span + 1)
    return out


def test_kernel_is_the_subsequence_kernel():
    words = ["idiot", "idi0t", "ixdiot", "stone", "id"]
    marks = X.Landmarks(words)
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    got = X.kernel(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends, marks)
    longest = max(p[-1] for p in X.PATTERNS)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = ({k: v for k, v in spell(w).items()} for w in (a, b))
            want = sum(x[k] * y.get(k, 0.0) for k in x) / (X.weights(len(a) + 2) * X.weights(len(b) + 2))
            assert longest <= X.SPAN and got[i, j] == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert got[0, 2] > 3 * got[0, 3]


def words_by_hand(text):
    """Words of a text, and runs of letters that stand alone, without the module's own splitting."""
    x = unicodedata.normalize("NFKD", text.lower())
    w = "".join(c for c in x if c.isspace() or unicodedata.category(c)[0] in "LN").split()
    runs = ["".join(g) for one, g in groupby(w, lambda v: len(v.encode()) == 1) if one]
    return w + [r for r in runs if len(r) > 2]


def score_by_hand(text, model):
    """The worst word's score by the definition: weighted subsequences over the word's norm."""
    best = -np.inf
    for w in set(words_by_hand(text)):
        if len(w.encode()) <= X.LONGEST:
            total = sum(v * model[0][sum(c << X.BITS * (X.P - 1 - i) for i, c in enumerate(k))] for k, v in spell(w).items())
            best = max(best, total / X.weights(len(w.encode()) + 2) + model[1])
    return best


INSULTS = ["blorghead", "snivelwart", "grubfaced", "muckbrain"]


def sentences(rng, n, toxic):
    out = []
    for _ in range(n):
        w = [rng.choice(cases.WORDS + [f"word{rng.randint(0, 40)}"]) for _ in range(30)]
        if toxic:
            w[rng.randint(0, 29)] = rng.choice(INSULTS)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return X.train(sentences(rng, 60, True) + sentences(rng, 140, False), [1] * 60 + [0] * 140)


def toxic(model, *texts):
    return (X.score_texts(pa.array(texts, pa.string()), model) > model[2]).tolist()


def test_held_out_sentences(model):
    rng = random.Random(77)
    assert np.mean(toxic(model, *sentences(rng, 100, True))) > 0.95
    assert np.mean(toxic(model, *sentences(rng, 200, False))) < 0.02


def test_gaps_and_inserted_characters(model):
    assert toxic(model, "you blorxghead you", "a snivel-wart", "BLORGHEAD", "b l o r g h e a d", "sn1velwart", "grubfacedd") == [True] * 6
    assert toxic(model, "a blog about heads", "the wart", "", " ", None) == [False] * 5


def test_scores_as_by_hand(model):
    texts = ["You BLORGHEAD, étude n0 1!", "b l o r g h e a d", "sni-vel.wart x", "a", "naïve ünïcode wörds", "The end. Of all"]
    assert X.score_texts(pa.array(texts), model) == pytest.approx([score_by_hand(t, model) for t in texts], rel=1e-3, abs=1e-4)


def test_the_table_is_the_kernel_machine():
    """Look-ups of a table made from landmarks give the sum over the landmarks of weight times kernel."""
    rng = np.random.default_rng(3)
    words = ["idiot", "worthless", "clown", "stone"]
    marks, alpha = X.Landmarks(words), rng.normal(size=4).astype(np.float32)
    table = np.zeros(1 << (X.BITS * X.P), np.float32)
    table[marks.tuples] = marks.table[1:] @ alpha
    for w in ["idiots", "w0rth less", "clowning", "nothing"]:
        by = [sum(v * spell(m).get(k, 0.0) for k, v in spell(w.replace(" ", "")).items()) / (X.weights(len(w.replace(" ", "")) + 2) * X.weights(len(m) + 2)) for m in words]
        raw = w.replace(" ", "").encode()
        got = X.score_words(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), table, 0.25)
        assert got[0] == pytest.approx(float(np.dot(alpha, by)) + 0.25, rel=1e-3, abs=1e-4)


def test_the_machine_is_at_its_minimum():
    rng = np.random.default_rng(4)
    x, y, cost = rng.normal(size=(80, 5)), np.where(rng.random(80) < 0.3, 1.0, -1.0), rng.random(80) + 0.5
    w = X.fit_machine(x, y, cost)
    full = np.hstack([x, np.ones((80, 1))])
    loss = lambda v: X.RIDGE * v @ v + cost @ np.maximum(0, 1 - y * (full @ v)) ** 2
    assert all(loss(w) <= loss(w + 1e-3 * d) + 1e-9 for d in rng.normal(size=(200, 6)))


def test_sentences_and_ties():
    each, of = X.sentences(pa.array(["One two. Three i.d.iot four!\nFive", "", "six..."]))
    assert [(int(t), s) for s, t in zip(each.to_pylist(), of) if s.strip()] == [(0, "One two"), (0, "Three i.d.iot four"), (0, "Five"), (2, "six")]
    # the same texts in both classes: nothing to learn, but a model or none, and no error
    same = ["a word here", "a word here", "", "..."]
    model = X.train(same, [0, 1, 0, 1])
    assert model is None or len(set(X.score_texts(pa.array(same[:2]), model).tolist())) == 1
    assert X.train(["", "..."], [0, 1]) is None and X.train(["x"], [1]) is None


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted(docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect())
    model = X.train([r.text for r in rows if r.doc_id % 2], [r.toxic for r in rows if r.doc_id % 2])
    test = [r for r in rows if not r.doc_id % 2]
    said = toxic(model, *[r.text for r in test])
    right = [s == bool(r.toxic) for s, r in zip(said, test)]
    # some labels are noise: documents labelled toxic whose text was replaced by repetitions
    assert np.mean(right) > 0.95
    assert np.mean([s for s, r in zip(said, test) if r.toxic]) > 0.75
    assert np.mean([s for s, r in zip(said, test) if not r.toxic]) < 0.02


def test_nulls_repeats_and_nothing(spark, model):
    shared = spark.sparkContext.broadcast(model)
    rows = cases.rough(8) + [(8000, "what a blorghead"), (8000, "what a blorghead"), (None, "a muckbrain"), (8001, "word " * 50_000 + "muckbrain"), (8002, "x" * 5000)]
    docs = cases.documents(spark, rows)
    scores = X.toxicity_scores(docs, shared)
    assert scores.count() == len(rows)
    bad = sorted(str(r.doc_id) for r in scores.collect() if r.score > 0)
    assert bad == sorted(["8000", "8000", "None", "8001"])
    kept = X.drop_toxic(docs, shared)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert X.toxicity_scores(cases.documents(spark, []), shared).collect() == []
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert X.fit(docs, none) is None and X.drop_toxic(docs, None).count() == len(rows)
    assert {r.score for r in X.toxicity_scores(docs, None).collect()} == {float("-inf")}
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (10, 1, 0), (10, 1, 0), (20, 0, 7)], "doc_id bigint, quality int, toxic int")
    assert X.fit(docs, labels) is None
