"""Documents that an operator must stand: nulls, empty and long texts, ties, repeats, clashing column names."""

import random

CLASHES = "key bigint, size int, n int, h bigint, i int, part int, rank int, ids string, score double, shard string, hops int, hits string, new string, pos int, base_id string, root string, text_ string, row string, k string, arc int, slot int, block int, canonical string, item_id string, n_tokens string, spans string, __spans string, __id string, group_id string, tile string, a string, b string, file string, seq string"
WORDS = ["red", "green", "blue", "ocean", "über", "naïve", "x1", "42", "tree", "stone", "light", "wind", "été", "Fish", "cloud"]


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(n)).strip()


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def documents(spark, rows, extra: bool = True):
    """(doc_id, text, lang, source, n_chars), with the clashing columns."""
    names = [tuple(x.split()) for x in CLASHES.split(", ")] if extra else []
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {n} {t}" for n, t in names)
    fill = [None if t != "string" else "clash" for _, t in names]
    return spark.createDataFrame([(i, t, None if i is None else "en", "src", None if t is None else len(t), *fill) for i, t in rows], schema)


def rough(seed: int = 1, n: int = 30):
    """Rows of ids and texts: copies, near copies, nulls, repeats, one long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 2, 3, 10, 60, 120]))
        rows.append((10 * i, text))
        if i % 4 == 0:
            rows.append((10 * i + 1, text))
        if i % 3 == 0:
            rows.append((10 * i + 2, edited(rng, text, 0.1)))
    long = prose(rng, 20_000, [f"w{j}" for j in range(3000)])
    rows += [(5000, long), (5001, long + " the end"), (5002, ""), (5003, ""), (5004, " \n\t "), (5005, "..."), (None, "a text without a number"), (None, None), (5006, None), rows[0], rows[0]]
    return rows
