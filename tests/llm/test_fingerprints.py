import hashlib
import random
import time

from lexaquarry.llm import fingerprints as P

from . import cases


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text):
    leaves = [sha("p" + p) for p in text.split("\n")]
    sections, at = [], []
    for i, h in enumerate(leaves):
        at.append(i)
        if h[0] in "01" or i == len(leaves) - 1:
            sections.append((at, sha("s" + "".join(leaves[j] for j in at))))
            at = []
    return leaves, sections, sha("d" + "".join(h for _, h in sections))


def brute(rows):
    docs = {i: tree(t) for i, t in rows if i is not None and t is not None}
    keys = lambda i: [h for at, h in docs[i][1] if len(at) > 1 or len(docs[i][1]) == 1]
    first = {}
    for i in sorted(docs):
        for h in keys(i):
            first.setdefault(h, i)
    out = {}
    for i, (leaves, sections, root) in docs.items():
        base = min([first[h] for h in keys(i)], default=i)
        have, have_leaves = {h for _, h in docs[base][1]}, set(docs[base][0])
        changed = [(s + 1, at) for s, (at, h) in enumerate(sections) if h not in have]
        paragraphs = [j + 1 for _, at in changed for j in at if leaves[j] not in have_leaves]
        out[i] = (root, len(leaves), len(sections), base, docs[base][2] == root, ",".join(str(s) for s, _ in changed), ",".join(map(str, paragraphs)))
    return out


def got(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect() if r.doc_id is not None}


def test_as_by_brute_force(spark):
    rng = random.Random(3)
    rows = cases.rough(3)
    base = "\n".join(cases.prose(rng, 8) for _ in range(60))
    lines = base.split("\n")
    rows += [(9000, base), (9001, base), (9002, "\n".join(lines[:20] + ["an edit"] + lines[21:])), (9003, "\n".join(lines[:5] + lines[9:])), (9004, "\n" + base + "\n")]
    out = P.document_fingerprints(cases.documents(spark, rows))
    want = brute(rows)
    found = got(out)
    assert found == want
    assert want[9001][3:] == (9000, True, "", "") and want[9002][3] == 9000 and "21" in want[9002][6].split(",")
    assert out.count() == sum(t is not None for _, t in rows)


def test_nulls_and_nothing(spark):
    assert P.document_fingerprints(cases.documents(spark, [])).collect() == []
    r = P.document_fingerprints(cases.documents(spark, [(None, "a\nb"), (4, None), (5, "")])).orderBy("doc_id").collect()
    assert [(x.doc_id, x.base_id, x.paragraphs) for x in r] == [(None, None, 2), (5, 5, 1)]


def test_null_and_the_smallest_id(spark):
    """Rows with a null doc_id and rows with the smallest bigint are kept apart."""
    low = -(2**63)
    rows = [(None, "a\nb"), (low, "a\nb"), (low, "a\nb"), (None, "c"), (7, "a\nb")]
    for f in (P.document_fingerprints, P.document_bases):
        out = sorted(((r.doc_id, r.base_id) for r in f(cases.documents(spark, rows)).collect()), key=repr)
        assert out == sorted([(None, None), (None, None), (low, low), (low, low), (7, low if f is P.document_bases or len(tree("a\nb")[1]) == 1 else 7)], key=repr)


def test_many_paragraphs_in_linear_time(spark):
    """Two texts of 200,000 lines that share one section alone."""
    rng = random.Random(8)
    shared = [f"shared {i}" for i in range(40)]
    a, b = ([f"{x} {rng.random()}" for _ in range(200_000)] for x in "ab")
    docs = spark.createDataFrame([(1, "\n".join(shared + a)), (2, "\n".join(b + shared))], "doc_id bigint, text string")
    began = time.time()
    r = {x.doc_id: x for x in P.document_fingerprints(docs).collect()}
    assert time.time() - began < 60
    changed = r[2].changed_paragraphs.split(",")
    assert r[2].base_id == 1 and not r[2].equal and len(changed) >= 200_000 and not set(map(int, changed)) & set(range(200_002, 200_030))


def test_levels_dont_mix(spark):
    """A text that spells the hash of another's section has another root."""
    a = tree("x")
    assert tree(a[1][0][1])[2] != a[2]


def brute_bases(rows):
    docs = {i: tree(t) for i, t in rows if i is not None and t is not None}
    nodes = {i: {*leaves, *(h for _, h in sections)} for i, (leaves, sections, _) in docs.items()}
    holders = {}
    for i in sorted(docs):
        for h in nodes[i]:
            holders.setdefault(h, []).append(i)
    out = {}
    for i, (_, _, root) in docs.items():
        equal = min(j for j in docs if docs[j][2] == root)
        weight = {}
        for h in nodes[i]:
            if holders[h][0] < i:
                weight[holders[h][0]] = weight.get(holders[h][0], 0) + P.WEIGHT // len(holders[h])
        out[i] = equal if equal < i else min(weight, key=lambda j: (-weight[j], j), default=i)
    return out


def test_bases_of_short_and_near_copies(spark):
    """Equal texts are tied, and so is each document that shares a paragraph with an earlier one."""
    rng = random.Random(5)
    rows = [(i, t) for i, t in cases.rough(3) if i is not None]
    single = next(t for t in (f"head {k}\ntail {k}" for k in range(1000)) if len(tree(t)[1]) == 2)  # two sections of one paragraph
    rows += [(9000, single), (9001, single)]
    line = lambda n: cases.prose(rng, n).replace("\n", " ")
    mine, other = line(30), line(30)
    rows += [(9100, f"{mine}\nfirst end"), (9101, f"{mine}\nsecond end"), (9102, other)]
    rows += [(9200 + i, f"a line of the house\n{line(12)}") for i in range(5)]
    rows += [(9300, f"a line of the house\nthird end\n{mine}")]  # the hot line's first holder is 9200
    want = brute_bases(rows)
    found = {r.doc_id: r for r in P.document_bases(cases.documents(spark, rows)).collect()}
    assert {i: r.base_id for i, r in found.items()} == want
    texts = {}
    for i, t in sorted((i, t) for i, t in rows if t is not None):
        assert texts.setdefault(t, i) == i or (found[i].base_id, found[i].equal, found[i].changed_paragraphs) == (texts[t], True, "")
    lines = {i: set(t.split("\n")) for i, t in rows if t is not None}
    for i in lines:
        assert (found[i].base_id == i) == all(not lines[i] & lines[j] for j in lines if j < i)
    assert found[9001].base_id == 9000
    assert (found[9101].base_id, found[9101].changed_paragraphs) == (9100, "2") and found[9102].base_id == 9102
    assert (found[9300].base_id, found[9300].changed_paragraphs) == (9100, "1,2")


def test_bases_of_nulls_and_nothing(spark):
    assert P.document_bases(cases.documents(spark, [])).collect() == []
    rows = [(None, "a\nb"), (3, "a\nb"), (3, "a\nb"), (4, None), (5, ""), (6, "")]
    r = P.document_bases(cases.documents(spark, rows)).collect()
    assert sorted(((x.doc_id, x.base_id) for x in r), key=repr) == sorted([(None, None), (3, 3), (3, 3), (5, 5), (6, 5)], key=repr)
