import random

import pyarrow as pa
import pytest

from lexaquarry.llm import decontamination as D

from . import cases

ITEMS = [
    (1, "Maria buys 12 apples and 7 pears at the market, then gives 3 apples to her brother. How many apples does Maria have left after that?"),
    (2, "A train leaves the old station at 9:30 and travels 240 km at a constant speed of 80 km per hour. When does it reach the coast?"),
    (3, "In the year 1999 the town of Elmhurst had 4,500 people and since then lost 2% of them each year on average until today."),
    (4, "Short one of words."),
    (5, None),
    (None, "what the committee of seven members did not know about the plan was that nobody had ever read it at all"),
]


def brute(rows, items):
    """Every alignment of every text with every item, word by word. Only alignments at which some word that is no slot
    agrees can hold a window of enough literals, so the others are left out."""
    out = set()
    bench = D.Benchmark([i for i, t in items if t is not None], [t for i, t in items if t is not None])
    for doc, text in rows:
        if text is None:
            continue
        w = D.canonical(pa.array([text]))
        for item in range(len(bench.ids)):
            have = bench.words[item]
            best = None
            literal: dict = {}
            for p in range(len(have)):
                if bench.kinds[item][p] == 0:
                    literal.setdefault(int(have[p]), []).append(p)
            deltas = {d - p for d, h in enumerate(w.hash.tolist()) for p in literal.get(h, ())}
            for delta in sorted(deltas):
                same = [0 <= delta + p < len(w.hash) and w.hash[delta + p] == have[p] for p in range(len(have))]
                a = 0
                while a < len(have):
                    if not same[a]:
                        a += 1
                        continue
                    b = a
                    while b < len(have) and same[b]:
                        b += 1
                    n = min(D.WINDOW, len(have))
                    kinds = bench.kinds[item]
                    seeded = any(sum(k == 0 for k in kinds[p : p + n]) >= min(D.LITERALS, max(1, n - 2)) for p in range(a, b - n + 1))
                    if b - a >= min(D.RUN, len(have)) and seeded:
                        ok, changed = bench._slots(w, item, a, b, delta)
                        if ok and (best is None or (a - b, delta + a, a) < best[:3]):
                            best = (a - b, delta + a, a, changed)
                    a = b
            if best:
                out.add((doc, bench.ids[item], best[1], best[2], -best[0], best[3] == 0, best[3]))
    return out


def planted():
    rng = random.Random(4)
    pad = lambda: cases.prose(rng, 40)
    return [
        (1, pad() + " " + ITEMS[0][1] + " " + pad()),
        (2, pad() + " Peter buys 31 apples and 9 pears at the market, then gives 5 apples to her brother. How many apples does Peter have left after that? " + pad()),
        (3, "Peter buys 31 apples and 9 pears at the market, then gives 5 apples to her brother. How many apples does Paula have left after that?"),
        (4, "A train leaves the old station at 10:45 and travels 120 miles at a constant speed of 60 miles per hour. When does it reach the coast?"),
        (5, "A train leaves the old station and nobody knows when."),
        (6, "Short one of words."),
        (7, "the plan was that nobody had ever read it at all, and what the committee of seven members did not know about the plan was that nobody had ever read it at all"),
        *[(100 + i, pad()) for i in range(20)],
    ]


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_as_by_brute_force(spark, limit):
    rows = planted() + [(i, t) for i, t in cases.rough(3) if i is not None]
    items = spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS if i is not None or limit], "item_id bigint, text string, doc_id string, h int")
    got = {tuple(r) for r in D.benchmark_leaks(cases.documents(spark, rows), items, limit).collect()}
    want = brute(rows, [x for x in ITEMS if x[0] is not None or limit])
    assert got == want
    found = {(d, i) for d, i, *_ in want}
    assert {(1, 1), (2, 1), (4, 2)} <= found and not any(d >= 100 for d, _ in found) and (5, 2) not in found
    changed = {(x[0], x[1]): x[5:] for x in want}
    assert changed[(1, 1)] == (True, 0) and changed[(2, 1)][0] is False


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_clean_documents_stay(spark, limit):
    rows = planted() + cases.rough(3)
    docs = cases.documents(spark, rows)
    items = spark.createDataFrame(ITEMS[:5], "item_id bigint, text string")
    kept = D.decontaminate(docs, items, limit)
    leaked = {t for t in {t for _, t in rows} if t is not None and brute([(0, t)], ITEMS[:5])}
    assert kept.columns == docs.columns and len(leaked) > 3
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(r) for r in rows if r[1] not in leaked)


def test_candidates_are_few(spark, data):
    """Only documents that share a window of the items' own lengths are verified: about those that leak."""
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    leaks = D.benchmark_leaks(docs, items)
    pairs = D.candidates(docs.select("text"), D._items(items))
    assert sorted(map(tuple, D.benchmark_leaks(docs, items, 0).collect())) == sorted(map(tuple, leaks.collect()))
    assert pairs.count() <= 2 * docs.join(leaks.select("doc_id").distinct(), "doc_id").select("text").distinct().count()


def test_nothing(spark):
    items, docs = spark.createDataFrame(ITEMS, "item_id bigint, text string"), cases.documents(spark, planted())
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.benchmark_leaks(cases.documents(spark, []), items).collect() == []
    assert D.benchmark_leaks(docs, none).collect() == []
    assert D.decontaminate(docs, none).count() == docs.count()


def spans(spark, texts, items, limit=D.BROADCAST_WINDOWS):
    """{(doc_id, item_id): (item_word, words, changed_slots)}; a document that leaks is dropped, another stays."""
    docs = cases.documents(spark, list(enumerate(texts)))
    items = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    out = {(r.doc_id, r.item_id): (r.item_word, r.words, r.changed_slots) for r in D.benchmark_leaks(docs, items, limit).collect()}
    assert {r.doc_id for r in D.decontaminate(docs, items, limit).collect()} == set(range(len(texts))) - {d for d, _ in out}
    return out


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_the_part_whose_slots_agree(spark, limit):
    """A run in which one slot disagrees leaks by the longest part without it."""
    train = ITEMS[1][1]
    texts = [
        train.replace("80 km", "80 miles"),
        train.replace("240 km", "240 miles"),
        "A train leaves the old station at 9:30 and travels 240 km and nobody knows when.",
    ]
    found = spans(spark, texts, [train], limit)
    n = len(D.canonical(pa.array([train])).hash)
    assert n == 27 and found == {(0, 0): (0, 18, 0), (1, 0): (0, 18, 1)}


def test_parts_as_by_brute_force():
    """Every part of a run is tried."""
    rng = random.Random(6)
    some = 0
    for _ in range(400):
        words = [rng.choice(["aa", "bb", "cc", "dd", "1", "2", "3", "Xa", "Xb"]) for _ in range(rng.randint(16, 40))]
        other = [rng.choice(["1", "2", "3"]) if x.isdigit() and rng.random() < 0.2 else rng.choice(["Xa", "Xb"]) if x[0] == "X" and rng.random() < 0.2 else x for x in words]
        bench, w = D.Benchmark([0], ["so " + " ".join(words)]), D.canonical(pa.array(["so " + " ".join(other)]))
        n, kinds = len(bench.words[0]), bench.kinds[0]
        seeds = [p for p in range(n - D.WINDOW + 1) if sum(kinds[p : p + D.WINDOW] == 0) >= D.LITERALS]
        parts = [(a - b, a) for a in range(n) for b in range(a + D.RUN, n + 1) if any(a <= p and p + D.WINDOW <= b for p in seeds) and bench._slots(w, 0, a, b, 0)[0]]
        want = min(parts, default=None)
        a, b = bench._part(w, 0, 0, n, 0)
        assert (a - b, a) == want if want else a == b
        some += want is not None and -want[0] < n
    assert some > 50


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_short_items_behind_other_marks(spark, limit):
    """The first word of a short item agrees wherever the item stands."""
    capital, short, two = "What is the capital of the large country in the south?", "Who wrote the long letter?", "Anna sings"
    texts = [
        "Question: " + capital,
        "Read on\n" + capital + "\nAnswer below",
        "- one thing\n- " + capital,
        "(a) " + capital,
        "q: " + capital.lower(),
        "Question: " + short,
        "1) " + short,
        "they ask who wrote the long letter",
        "they say that wrote the long letter",  # another first word
        "the capital of the large country in the south",
        "Song: Maria sings",
    ]
    found = spans(spark, texts, [capital, short, two], limit)
    assert found == {**{(i, 0): (0, 11, 0) for i in range(5)}, **{(i, 1): (0, 5, 0) for i in (5, 6, 7)}, (10, 2): (0, 2, 0)}


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_names_of_other_lengths(spark, limit):
    """A name is one slot, however many words it has."""
    item = "On most days the old baker meets Anna near New York and then gives Anna five small loaves of bread."
    head = "Maria Lopez sells old books near the small harbour and then Maria Lopez walks home."
    sold = "sells old books near the small harbour and then"
    texts = [
        item.replace("Anna", "Mary Ann"),
        item.replace("New York", "Paris"),
        item.replace("Anna", "Mary Ann Smith").replace("New York", "Paris"),
        item.replace("Anna", "Jean-Luc"),
        item.replace("Anna", "Mary Ann", 1),  # another name the second time: no more than parts
        f"Anna {sold} Anna walks home.",
        f"Mary Ann Smith {sold} Mary Ann Smith walks home.",
        f"Mary Ann Smith {sold} Paul walks home.",
        "Nothing of the kind stands in here, says Mary Ann Smith of New York.",
    ]
    found = spans(spark, texts, [item, head], limit)
    assert found == {(0, 0): (0, 20, 2), (1, 0): (0, 20, 1), (2, 0): (0, 20, 3), (3, 0): (0, 20, 2), (4, 0): (0, 14, 1), (5, 1): (0, 15, 2), (6, 1): (0, 15, 2), (7, 1): (0, 15, 2)}


def test_what_stands_verbatim_counts_by_words(spark):
    """Long names take no words from a run."""
    item = "the members of the old River Valley Club met in the large hall and spoke of nothing but rain"
    assert spans(spark, ["we saw. The members of the old River Valley Club met in the large hall. Nobody came."], [item]) == {(0, 0): (0, 13, 0)}


def test_names_end_with_their_line(spark):
    """A title above a verbatim item is no part of its first name."""
    item = "Maria sells old books near the small harbour and then walks home with nothing."
    assert spans(spark, ["Old Title\n" + item], [item]) == {(0, 0): (1, 13, 0)}
