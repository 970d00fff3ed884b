import random

import pytest

from lexaquarry.llm import substring_dedup as U

from . import cases


def words(text):
    import re

    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]


def brute(rows, passage):
    """Maximal spans whose windows stand in the least earlier document."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda x: x[0])
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - passage + 1):
            first.setdefault(tuple(w[p : p + passage]), (i, p))
    out = set()
    for i, t in docs:
        w = words(t)
        hits = [(p, *first[tuple(w[p : p + passage])]) for p in range(len(w) - passage + 1)]
        hits = [h for h in hits if h[1] != i]
        k = 0
        while k < len(hits):
            j = k
            while j + 1 < len(hits) and hits[j + 1] == (hits[j][0] + 1, hits[j][1], hits[j][2] + 1):
                j += 1
            out.add((i, hits[k][0], hits[j][0] + passage, hits[k][1], hits[k][2]))
            k = j + 1
    return out


def sample(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [cases.prose(rng, n, vocabulary) for n in (9, 10, 15, 40)]
    rows = []
    for i in range(40):
        parts = [cases.prose(rng, rng.randint(0, 30), vocabulary)]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), cases.prose(rng, rng.randint(0, 8), vocabulary)]
        rows.append((i * 3, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "a b " * 30), (203, "x " + "a b " * 30), (204, "same " * 40)]
    return rows


@pytest.mark.parametrize("batches,gram", [(1, 5), (2, 5), (5, 10), (9, 3)])
def test_spans_as_by_brute_force(spark, batches, gram):
    rows = sample() + [r for r in cases.rough(2) if r[0] is None or r[0] > 300]
    got = {tuple(r) for r in U.repeated_spans(cases.documents(spark, rows), 10, gram, batches).collect()}
    assert got == brute(rows, 10)
    assert len(got) > 20


@pytest.mark.parametrize("batches,hot", [(1, 1), (3, 2), (2, 0)])
def test_hot_windows_and_small_parts(spark, monkeypatch, batches, hot):
    """Passages of many documents travel as rows, and parts are small: the same spans."""
    monkeypatch.setattr(U, "PART_WINDOWS", 50)
    monkeypatch.setattr(U, "FLUSH", 40)
    rng = random.Random(12)
    house = cases.prose(rng, 30, [f"h{i}" for i in range(50)])
    rows = sample(4) + [(300 + i, cases.prose(rng, 12) + " " + house + " " + cases.prose(rng, 12)) for i in range(25)]
    got = {tuple(r) for r in U.repeated_spans(cases.documents(spark, rows), 10, 5, batches, hot).collect()}
    assert got == brute(rows, 10) and sum(r[3] == 300 for r in got) >= 24


def test_no_table_is_left_behind(spark, monkeypatch):
    docs = cases.documents(spark, sample())
    before = {t.name for t in spark.catalog.listTables()}
    U.repeated_spans(docs, 10, 5)
    monkeypatch.setattr(U.FingerprintIndex, "_repeats_of", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        U.repeated_spans(docs, 10, 5)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_production_parameters(spark):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(900)]
    passage = cases.prose(rng, 51, vocabulary)
    rows = [(i, cases.prose(rng, 80, vocabulary) + " " + passage + " " + cases.prose(rng, 80, vocabulary)) for i in range(5)]
    docs = cases.documents(spark, rows)
    got = {tuple(r) for r in U.repeated_spans(docs).collect()}
    assert got == brute(rows, U.PASSAGE) and {r[0] for r in got} == {1, 2, 3, 4}
    kept = {r.doc_id: r.text for r in U.remove_repeats(docs).collect()}
    head = passage.split()[1:-1]
    assert " ".join(head) in " ".join(kept[0].split()) and all(" ".join(head) not in " ".join(kept[i].split()) for i in range(1, 5))


def test_an_index_grows_and_reopens(spark):
    rows = sorted(sample(3))
    docs = cases.documents(spark, rows)
    index = U.FingerprintIndex(spark, passage=10, gram=5, fan_in=2)
    found, cuts = set(), [0, 30, 60, 90, 250]
    for a, b in zip(cuts, cuts[1:]):
        if a == 60:  # another session goes on
            index = U.FingerprintIndex(spark, index.path, passage=10, gram=5, fan_in=2)
        batch = docs.filter(f"doc_id >= {a} and doc_id < {b}")
        found |= {tuple(r) for r in index.add(batch, docs.filter(f"doc_id < {a}") if a else None).collect()}
    assert found == brute(rows, 10)
    assert len({x[0] for x in index.runs}) == len(index.runs)  # compacted: a run a level
    index.close()


def test_cut_texts(spark):
    rows = sample(7)
    docs = cases.documents(spark, rows + [(None, rows[0][1]), (999, None)])
    out = U.remove_repeats(docs, 10, 5)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    spans = brute(rows, 10)
    for i, t in rows:
        w = words(t)
        gone = {p for d, a, b, *_ in spans if d == i for p in range(a, b)}
        want = [x for p, x in enumerate(w) if p not in gone]
        assert words(got.get(i) or "") == want
        if not gone:
            assert got[i] == t
    assert got[None] == rows[0][1] and got[999] is None
    assert 200 not in got  # nothing of a copy is left


def test_nothing(spark):
    assert U.repeated_spans(cases.documents(spark, [])).collect() == []
    assert U.remove_repeats(cases.documents(spark, [])).collect() == []
    nulls = cases.documents(spark, [(None, "a"), (3, None)])
    assert U.repeated_spans(nulls).collect() == [] and U.remove_repeats(nulls).count() == 2
    with pytest.raises(ValueError):
        U.FingerprintIndex(spark, passage=5, gram=6)
