"""Toxicity by a subsequence-kernel support vector machine with Nystrom landmarks, trained on labelled sentences.

The kernel counts common subsequences of P characters, with gaps: a subsequence that spans n characters weighs
DECAY**n, and spans over SPAN don't count, so insults with inserted or dropped characters stay close to the plain ones.
A sentence is a bag of strings: its words between word marks, without accents, punctuation inside ("i.d.i.o.t") and digits
for letters ("1d10t"); letters that stand alone in a row ("i d i o t") are one word too. Two sentences are compared by
their nearest words, as the share of an insult in a sum over all words would shrink with the sentence.

Labels are of documents, so training is multiple-instance: every sentence of a clean document is a clean example, and of a
toxic document the sentence that looks worst is the toxic one, with all others that score as toxic; which they are is
decided anew in every round. First looks are naive log odds of the kernel's own features. A Nystrom map of the kernel
makes the machine linear; its landmarks are picked by pivoted Cholesky steps, so each stands for words that none before
it does. A linear machine on this kernel is one table of weights over character P-tuples: scoring a word is a sum of
look-ups. The table is of fixed size. A sentence scores as its worst word, a document as its worst sentence, which is its
worst word, so scoring needs no bounds of sentences.

At most SAMPLE labelled documents of each class train it; scoring covers every document, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import Words, slices
from ._shared import lean, table

P = 4
SPAN = 7
DECAY = 0.6
LANDMARKS = 256
SAMPLE = 2500  #: labelled documents of each class that train the machine
LONGEST = 40  #: letters of a word scored at once; longer words score as the worst of overlapping parts
ROUNDS = 3
LIFT = 4  #: times as frequent in toxic documents as in clean ones, at least, is a word that makes a sentence toxic
PRIOR = 10.0  #: occurrences that pull the log odds of a rare feature to none
CANDIDATES = 512  #: strings among which landmarks are picked, those of most toxic documents first
FREQUENT = 1000  #: words of most clean documents that are examples in any case
WORST = 3  #: sentences of each clean document that are examples in every round; in later rounds all within the margin are
CLEAN = 3.0  #: times the weight of an error on the clean side
END_OF_SENTENCE = r"[.!?…。！？]+(\s+|$)|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]+"
RIDGE = 1e-2
FLOOR = 1e-4  #: of the largest eigenvalue; smaller ones are noise
BITS = 5
PATTERNS = [(0, *x) for n in range(P - 1, SPAN) for x in combinations(range(1, n + 1), P - 1) if x[-1] == n]
_CODES = np.full(256, 28, np.uint8)
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODES[ord("0") : ord("9") + 1] = [ord(x) - 96 for x in "oizeasgtbg"]
START, END = 30, 31


def words_of(texts: pa.Array) -> Words:
    x = pc.utf8_lower(pc.utf8_normalize(pc.fill_null(texts, ""), form="NFKD"))
    x = pc.replace_substring_regex(x, r"[^\p{L}\p{N}\s]+", "")
    return Words(pc.replace_substring_regex(x, r"\s+", " "))


def weights(length: int) -> float:
    """Length of a word's feature vector, as if its subsequences differed (a function of its marked length alone)."""
    return float(np.sqrt(sum(max(0, length - p[-1]) * DECAY ** (2 * (p[-1] + 1)) for p in PATTERNS))) or 1.0


def code_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their marked codes as a matrix) for each length."""
    size = ends - starts
    who, begin, stop = np.arange(len(starts)), starts, ends
    if (size > LONGEST).any():
        cut = [(i, a, min(a + LONGEST, ends[i])) for i in np.flatnonzero(size > LONGEST) for a in range(starts[i], max(starts[i] + 1, ends[i] - SPAN), LONGEST - SPAN)]
        ok = size <= LONGEST
        who, begin, stop = (np.concatenate([x[ok], y]) for x, y in zip((who, begin, stop), np.array(cut).T))
    size = stop - begin
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        m = np.empty((len(at), n + 2), np.int32)
        m[:, 1:-1] = _CODES[data[begin[at][:, None] + np.arange(n)]]
        m[:, 0], m[:, -1] = START, END
        m[begin[at] > starts[who[at]], 0] = 29
        m[stop[at] < ends[who[at]], -1] = 29
        yield who[at], m


def tuples(m: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Tuple numbers and weight of each pattern over the columns of coded words."""
    for p in PATTERNS:
        n = m.shape[1] - p[-1]
        if n > 0:
            index = m[:, :n]
            for o in p[1:]:
                index = (index << BITS) | m[:, o : o + n]
            yield index, DECAY ** (p[-1] + 1)


def kernel(data, starts, ends, landmarks: "Landmarks") -> np.ndarray:
    out = np.zeros((len(starts), landmarks.table.shape[1]), np.float32)
    for who, m in code_words(data, starts, ends):
        k = np.zeros((len(who), out.shape[1]), np.float32)
        for index, weight in tuples(m):
            for c in range(index.shape[1]):
                k += np.float32(weight) * landmarks.table[landmarks.number[index[:, c]]]
        np.maximum.at(out, who, k / weights(m.shape[1]))
    return out


class Landmarks:
    """Feature vectors of the landmark words, over the tuples that occur in any."""

    def __init__(self, words: list[str | bytes]):
        raw = [x.encode() if isinstance(x, str) else x for x in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        starts = ends - [len(x) for x in raw]
        rows, cols, vals = [], [], []
        for who, m in code_words(data, starts, ends):
            for index, weight in tuples(m):
                rows.append(np.repeat(who, index.shape[1]))
                cols.append(index.ravel())
                vals.append(np.full(index.size, weight / weights(m.shape[1])))
        rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
        self.tuples, at = np.unique(cols, return_inverse=True)
        self.number = np.zeros(1 << (BITS * P), np.int32)
        self.number[self.tuples] = np.arange(1, len(self.tuples) + 1)
        self.table = np.zeros((len(self.tuples) + 1, len(words)), np.float32)
        np.add.at(self.table, (at + 1, rows), vals)


def score_words(data, starts, ends, table: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(starts), -np.inf, np.float32)
    for who, m in code_words(data, starts, ends):
        s = np.zeros(len(who), np.float32)
        for index, weight in tuples(m):
            s += np.float32(weight) * table[index].sum(axis=1)
        np.maximum.at(out, who, s / np.float32(weights(m.shape[1])) + np.float32(bias))
    return out


def spelled(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of three or more one-letter words as words of their own: rows, bytes, starts, ends."""
    one = np.r_[False, (w.ends - w.starts) == 1, False]
    row = w.rows()
    edge = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    rows, parts = [], []
    i = 0
    at = np.flatnonzero(one[1:-1])
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1 and not edge[at[j + 1]]:
            j += 1
        if j - i >= 2:
            rows.append(row[at[i]])
            parts.append(w.data[w.starts[at[i] : at[j] + 1]].tobytes())
        i = j + 1
    ends = np.cumsum([len(x) for x in parts]).astype(np.int64)
    return np.array(rows, np.int64), np.frombuffer(b"".join(parts), np.uint8), ends - np.array([len(x) for x in parts], np.int64), ends


def score_texts(texts: pa.Array, model: tuple) -> np.ndarray:
    """The worst word's score of each text; minus infinity without words."""
    weight, bias, _ = model
    w = words_of(texts)
    out = np.full(len(texts), -np.inf, np.float32)
    if not len(w.hash):
        return out
    _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    scores = score_words(w.data, w.starts[first], w.ends[first], weight, bias)[back]
    full = np.flatnonzero(np.diff(w.row))
    out[full] = np.maximum.reduceat(scores, w.row[full])
    rows, data, starts, ends = spelled(w)
    if len(rows):
        np.maximum.at(out, rows, score_words(data, starts, ends, weight, bias))
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    loss = lambda w: RIDGE * w @ w + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2
    best = loss(w)
    for _ in range(30):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        step = np.linalg.solve(a.T @ (c[:, None] * a) + RIDGE * np.eye(len(w)), a.T @ (c * y[active])) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) >= best:
            size /= 2
        if size <= 1e-4:
            break
        w = w + size * step
        now = loss(w)
        if best - now < 1e-6 * best:
            break
        best = now
    return w


def sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The sentences of all texts in a row, and the text of each. A dot within a word ends none."""
    parts = pc.split_pattern(pc.replace_substring_regex(texts, END_OF_SENTENCE, "\n"), "\n")
    return parts.flatten(), pc.list_parent_indices(parts).to_numpy()


def vocabulary(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Distinct words in order of their hashes (bytes, starts, ends), the pairs (sentence, word) that occur, and the text of
    each sentence; a slice of the texts at a time."""
    rows, hashes, spell, of, at, text = [], [], {}, [], 0, 0
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text"):
        each, parent = sentences(part.column("text"))
        w = words_of(each)
        own, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        pair = np.unique(w.rows() * np.int64(max(1, len(own))) + back)
        rows.append(at + pair // max(1, len(own)))
        hashes.append(own[pair % max(1, len(own))])
        of.append(text + parent)
        for h, i in zip(own.tolist(), first):
            if h not in spell:
                spell[h] = w.data[w.starts[i] : w.ends[i]].tobytes()
        at, text = at + len(each), text + part.num_rows
    known = np.array(sorted(spell), np.uint64)
    raw = [spell[h] for h in known.tolist()]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(x) for x in raw], np.int64), ends, np.concatenate(rows), np.searchsorted(known, np.concatenate(hashes)), np.concatenate(of)


def log_odds(data, starts, ends, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Naive evidence of each feature: how much more often toxic documents have it than clean ones."""
    n = 1 << (BITS * P)
    b, g = np.zeros(n), np.zeros(n)
    for who, m in code_words(data, starts, ends):
        for index, _ in tuples(m):
            row = np.repeat(who, index.shape[1])
            b += np.bincount(index.ravel(), bad[row], n)
            g += np.bincount(index.ravel(), good[row], n)
    share = b.sum() / max(1.0, b.sum() + g.sum())
    return np.log((b + PRIOR * share) / (g + PRIOR * (1 - share)) * (1 - share) / share).astype(np.float32)


def pick(data, starts, ends, among: np.ndarray, weight: np.ndarray, k: int) -> list[int]:
    """Up to k of the words ``among``: each the one for which weight times what those before leave of it is largest."""
    if not len(among):
        return []
    gram = kernel(data, starts[among], ends[among], Landmarks([data[starts[i] : ends[i]].tobytes() for i in among]))
    gram = (gram + gram.T) / 2
    left = np.diag(gram).copy()
    least = 0.02 * left
    root = np.zeros((len(among), k), np.float32)
    out: list[int] = []
    for j in range(min(k, len(among))):
        i = int(np.argmax(left * weight))
        if left[i] <= least[i]:
            break
        out.append(int(among[i]))
        root[:, j] = (gram[:, i] - root[:, :j] @ root[i, :j]) / np.sqrt(left[i])
        left = np.maximum(0, left - root[:, j] ** 2)
        left[i] = 0
    return out


def _first_of(group: np.ndarray) -> np.ndarray:
    return np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)


def train(texts: list[str], toxic: list[int]) -> tuple[np.ndarray, float, float] | None:
    """(table of tuple weights, bias, threshold), or None where a class has no text or no text has a word. Texts of the
    same words count each; equal scores are decided by the order of the words' hashes."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    data, starts, ends, row, word, of = vocabulary(texts)
    if not len(starts):
        return None
    pair = np.unique(of[row] * np.int64(len(starts)) + word)
    text, has = pair // len(starts), pair % len(starts)
    nb, ng = y.sum(), (~y).sum()
    bad, good = (np.bincount(has[m], minlength=len(starts)).astype(float) for m in (y[text], ~y[text]))
    full = ends - starts >= P - 1  # shorter words have no feature
    may = full & (bad / nb > LIFT * good / ng)
    often = [i for i in np.argsort(-good, kind="stable")[:FREQUENT] if good[i] and full[i]]
    negative = np.zeros(len(starts), bool)
    negative[often] = True
    table, bias = log_odds(data, starts, ends, bad, good), 0.0
    for turn in range(ROUNDS):
        score = score_words(data, starts, ends, table, bias)
        # the worst word of each sentence; the sentences of each text, the worst first
        order = np.lexsort((word, -score[word], row))
        order = order[_first_of(row[order])]
        order = order[np.lexsort((-score[word[order]], of[row[order]]))]
        worst, own = word[order], of[row[order]]
        place = np.arange(len(order))
        place -= np.maximum.accumulate(np.where(_first_of(own), place, 0))
        clean = ~y[own]
        negative[worst[clean & ((place < WORST) | ((turn > 0) & (score[worst] > -0.5)))]] = True
        positive = np.unique(worst[~clean & ((place == 0) | ((turn > 0) & (score[worst] > 0)))])
        positive = positive[may[positive]]
        if not len(positive):
            positive = worst[~clean & full[worst]][:1] if turn == 0 else positive
            if not len(positive):
                break
        others = negative & full
        others[positive] = False
        others = np.flatnonzero(others)
        among = positive[np.argsort(-bad[positive], kind="stable")][:CANDIDATES]
        marks = pick(data, starts, ends, among, bad[among], LANDMARKS * 3 // 4)
        among = others[np.argsort(-score[others], kind="stable")][:CANDIDATES]
        marks += pick(data, starts, ends, among, np.sqrt(good[among]), (LANDMARKS - len(marks)) * 3 // 4)
        marks = list(dict.fromkeys(marks + often))[:LANDMARKS]
        landmarks = Landmarks([data[starts[i] : ends[i]].tobytes() for i in marks])
        values, vectors = np.linalg.eigh(landmarks.table.T.astype(np.float64) @ landmarks.table.astype(np.float64))
        ok = values > FLOOR * values[-1]
        root = vectors[:, ok] / np.sqrt(values[ok])
        both = np.r_[positive, others]
        x = kernel(data, starts[both], ends[both], landmarks) @ root
        # words that clean documents have, too, are examples of both classes, by their documents
        p = len(positive)
        mark = np.r_[np.ones(p), -np.ones(p + len(others))]
        cost = np.r_[bad[positive] / nb, CLEAN * good[positive] / ng, np.maximum(1, good[others]) / ng]
        cost[:p] /= cost[:p].sum()
        cost[p:] /= max(cost[p:].sum(), 1e-9)
        weight = fit_machine(x[np.r_[:p, : len(both)]], mark, cost * max(1, len(others)))
        bias = float(weight[-1])
        table = np.zeros(1 << (BITS * P), np.float32)
        table[landmarks.tuples] = landmarks.table[1:] @ (root @ weight[:-1])
    score = score_words(data, starts, ends, table, bias)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, score[has])
    return table, bias, float(_threshold(best[y], best[~y]))


def _threshold(bad: np.ndarray, good: np.ndarray) -> float:
    """The score that errs least (a clean document lost counts as much as ten toxic ones kept, by share of class);
    between equals the middle of the widest gap."""
    cuts = np.unique(np.concatenate([bad, good]))
    cuts = cuts[np.isfinite(cuts)]
    middle = np.r_[(cuts[:-1] + cuts[1:]) / 2] if len(cuts) > 1 else cuts
    bad, good = np.sort(bad), np.sort(good)
    loss = np.searchsorted(bad, middle) / len(bad) + 10 * (len(good) - np.searchsorted(good, middle)) / len(good)
    ties = np.flatnonzero(loss == loss.min())
    return middle[ties[np.argmax(np.diff(cuts)[ties])]] if len(cuts) > 1 else float(middle[0])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) that train: of each class the ``sample`` documents that come first by a hash of their id.

    Rows with a null doc_id, or a label that is neither 0 nor 1, don't count; of several labels of one document the worst
    holds. Null texts don't train, empty ones do, and a doc_id with several texts trains with each. Other columns, of
    whatever name, are ignored. Empty tables give no rows, of which ``fit`` makes no machine.
    """
    rows = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picks = [rows.filter(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = F.broadcast(picks[0].unionByName(picks[1]))  # at most twice the sample, whatever the input
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(ids, "doc_id").select("doc_id", "text", "toxic")


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted({row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))})
    model = train([r[1] for r in rows], [r[2] for r in rows])
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model[0].tobytes()], pa.binary()), pa.array([model[1]]), pa.array([model[2]])], names=["weights", "bias", "threshold"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The trained machine as a broadcast, or None where the labels lack a class. It is trained in one task on the sample;
    the driver only sees the table of weights, of fixed size."""
    row = labelled(docs, labels, sample).repartition(1).mapInArrow(lean(_train), "weights binary, bias double, threshold double").first()
    if row is None:
        return None
    return docs.sparkSession.sparkContext.broadcast((np.frombuffer(row.weights, np.float32), row.bias, row.threshold))


SCORES = "doc_id bigint, score double"


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for part in slices(batch, "text"):
            s = score_texts(part.column("text"), model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.astype(np.float64) - model[2])], names=["doc_id", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for part in slices(batch, "text"):
            yield part.filter(pa.array(score_texts(part.column("text"), model) <= model[2]))


def toxicity_scores(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score): above 0 is toxic. A null or empty text scores minus infinity; every row gets a score, repeated
    rows the same, and a null doc_id stays null. Without a model all score minus infinity. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit(float("-inf")).alias("score"))
    return docs.mapInArrow(lean(_score, model=model), SCORES)


def drop_toxic(docs: DataFrame, model) -> DataFrame:
    """The documents that aren't toxic, all columns (of whatever name) and repeated rows kept; null and empty texts stay, very
    long ones are scored whole, and a score that equals the threshold isn't toxic. An empty table stays empty; without a
    model all documents stay."""
    return docs if model is None else docs.mapInArrow(lean(_keep, model=model), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their scores."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels"))).filter("score > 0").withColumn("score", F.round("score", 4))
