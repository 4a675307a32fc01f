"""Toxicity: a counterfactual-regularised classifier.

Logistic regression over the presence of words and word beginnings (once, or more often: stems carry many endings), fitted
from a bounded sample of labelled rows. Labelled texts that name a group get a counterfactual copy in which each group term
is swapped for another one of its kind; the squared score change between both is penalised, so that a group's mere mention
moves no score. An L1 term keeps only words that tell the classes apart. Executors count and rate features and score whole
texts with the few weights that remain (their number is a parameter); the driver solves for these weights alone.

Defined results: a null or empty text has the score of no words at all; without labelled rows of both classes (an empty
table among others) the score is 0 everywhere; conflicting labels of one id count as toxic; of rows with one id the
smallest text is fitted; repeated rows are scored each for itself; features of equal rating enter by their bytes; very long
texts are fitted and scored whole; null ids are scored, never fitted; further columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, held_out, read_table, stored

FOLDS = 4
THRESHOLD = 0.3
#: At most so many labelled rows of each class, clean and toxic, are fitted, taken by hash order of their ids.
SAMPLE_ROWS = (5_000, 2_500)
#: Features that enter the fit, by their chi-square with the label, besides the group terms.
MAX_FEATURES = 800
MIN_ROWS = 3
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6, 7)
ROOT = min(STEMS)
#: Share of the fit's weight that toxic rows have together.
TOXIC_SHARE = 0.25

#: Terms that name groups, each row of one kind and form; a swap takes the next term of the row.
GROUP_TERMS = [
    "women men",
    "woman man",
    "girls boys",
    "girl boy",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "immigrants refugees foreigners natives",
    "immigrant refugee foreigner native",
    "gay lesbian bisexual straight transgender",
    "black white asian latino arab",
    "africans europeans asians americans",
    "african european american",
    "disabled blind deaf",
    "old young elderly",
]

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII signs, with A-Z lowered."""
    return (text or "").encode().translate(_PLAIN).split()


def features_of(words: list[bytes]) -> set[bytes]:
    """Features of a text's words: ``=word``, ``n:stem`` for a beginning of n bytes, ``n+stem`` if two or more words have it."""
    out = {b"=" + w for w in words}
    for n in STEMS:
        for stem, k in Counter(w[:n] for w in words if len(w) >= n).items():
            out.add(b"%d:%s" % (n, stem))
            if k > 1:
                out.add(b"%d+%s" % (n, stem))
    return out


def swaps(rows: list[str] | None = None) -> dict[bytes, bytes]:
    """The word that takes a group term's place."""
    out = {}
    for row in rows or GROUP_TERMS:
        terms = row.encode().split()
        out |= dict(zip(terms, [*terms[1:], terms[0]], strict=True))
    return out


@dataclass
class Classifier:
    weights: dict[bytes, float]
    bias: float
    trained: bool

    def __post_init__(self):
        self.roots = {w[1 if w[:1] == b"=" else 2 :][:ROOT] for w in self.weights}

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        # only words with the root of a weighted feature can have one
        words = [w for w in words_of(text) if w[:ROOT] in self.roots]
        z = self.bias + sum(sorted(map(self.weights.__getitem__, self.weights.keys() & features_of(words)))) if words else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _rating(c0, c1, n: int, n1: int):
    """Chi-square of a feature's presence and the label, over numbers or columns: rows that have it, clean and toxic."""
    expected = (c0 + c1) * float(n1) / float(n)
    return (c1 - expected) * (c1 - expected) / expected / (1.0 - (c0 + c1) / float(n + 1))


def _enters(c0, c1, n: int, n1: int):
    """Whether a feature may enter the fit: MIN_ROWS rows have it, and it is more frequent in toxic ones."""
    return (c0 + c1 >= MIN_ROWS) & (c1 * n > (c0 + c1) * n1)


def _vocabulary(rated: list[bytes], known: set[bytes]) -> list[bytes]:
    """The rated features, then the group terms that occur and those that a swap makes of them."""
    swap = swaps()
    return rated + sorted(known | {b"=" + swap[w[1:]] for w in known})


def _places(text: str | None, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray | None]:
    """A text's features by their places in the vocabulary, and those of its counterfactual if it names a group. The words
    are swapped, so stems and their counts follow."""
    swap, words = swaps(), words_of(text)
    mine = np.array(sorted(place[w] for w in features_of(words) & place.keys()), np.int32)
    if swap.keys().isdisjoint(words):
        return mine, None
    return mine, np.array(sorted(place[w] for w in features_of([swap.get(w, w) for w in words]) & place.keys()), np.int32)


def _solve(rows: list[tuple[np.ndarray, np.ndarray | None]], labels: np.ndarray, vocabulary: list[bytes], strength: float = 2.0, l1: float = 4e-4, steps: int = 300) -> Classifier:
    """Proximal gradient descent on log loss + strength * mean squared score change under swaps + l1."""
    y = labels.astype(np.float32)
    n, n1 = len(y), float(y.sum())

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(vocabulary) + 1), np.float32)
        out[:, -1] = 1
        for i, s in enumerate(sets):
            out[i, s] = 1
        return out

    x = matrix([s for s, _ in rows])
    named = [i for i, (_, t) in enumerate(rows) if t is not None]
    change = x[named] - matrix([rows[i][1] for i in named])
    weight = np.where(y == 1, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / (n - n1)).astype(np.float32)
    start = np.random.default_rng(1).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(30):
        start = x.T @ (weight * (x @ start)) * 0.25 + (change.T @ (change @ start)) * (2 * strength / max(1, len(named)))
        size = float(np.linalg.norm(start))
        start /= max(size, 1e-12)
    rate = 1 / max(size * 1.05, 1e-6)
    w = np.zeros(x.shape[1], np.float32)
    seen, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ seen)))
        gradient = x.T @ (weight * (p - y))
        if len(named):
            gradient += change.T @ (change @ seen) * (2 * strength / len(named))
        moved = seen - rate * gradient
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate * l1, 0)
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        seen = moved + (momentum - 1) / faster * (moved - w)
        w, momentum = moved, faster
    return Classifier({v: float(w[i]) for i, v in enumerate(vocabulary) if w[i]}, float(w[-1]), True)


def fit(texts: list[str | None], labels: list[int], strength: float = 2.0, l1: float = 4e-4, steps: int = 300, features: int = MAX_FEATURES) -> Classifier:
    """The classifier of texts at hand; ``train`` does the same to a sample that stays on the executors."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Classifier({}, 0.0, False)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for t, label in zip(texts, labels, strict=True):
        counts[label].update(features_of(words_of(t)))
    terms = {b"=" + w for w in swaps()}
    n, n1 = len(y), int(y.sum())
    # ties by the word
    rated = sorted((-_rating(counts[0][w], c1, n, n1), w) for w, c1 in counts[1].items() if w not in terms and _enters(counts[0][w], c1, n, n1))
    vocabulary = _vocabulary([w for _, w in rated[:features]], {w for w in terms if w in counts[0] or w in counts[1]})
    place = {w: i for i, w in enumerate(vocabulary)}
    return _solve([_places(t, place) for t in texts], y, vocabulary, strength, l1, steps)


def _count_features(batches):
    """(feature, c0, c1): rows of the batch that have it, clean and toxic."""
    import pyarrow as pa

    for b in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[label].update(features_of(words_of(t)))
        every = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *(pa.array([c[w] for w in every], pa.int64()) for c in counts)], ["feature", "c0", "c1"])


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = SAMPLE_ROWS) -> Classifier:
    """Fits on at most ``rows`` clean and toxic rows of the training folds. Texts stay on the executors, which count and
    rate the features; the driver gets MAX_FEATURES of them and each sample row's places among these, so what it holds is
    bounded in bytes, however long the texts are."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), FOLDS))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("doc_id"))
    # bounded by the sum of rows, so it may be broadcast
    picked = [known.where(F.col("toxic") == k).orderBy("place", "doc_id").limit(rows[k]).select("doc_id", "toxic") for k in (0, 1)]
    joined = documents_of(docs).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = stored(joined.select("doc_id", "text", "toxic"))
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n1 < n:
        return Classifier({}, 0.0, False)
    counts = sample.select("text", "toxic").mapInArrow(_count_features, "feature binary, c0 long, c1 long").groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    terms = [b"=" + w for w in sorted(swaps())]
    named, c0, c1 = F.col("feature").isin(terms), F.col("c0"), F.col("c1")
    kept = stored(counts.where(named | _enters(c0, c1, n, n1)))
    best = kept.where(~named).select("feature", _rating(c0, c1, n, n1).alias("rating")).orderBy(F.desc("rating"), "feature").limit(MAX_FEATURES).collect()
    vocabulary = _vocabulary([bytes(r["feature"]) for r in best], {bytes(r["feature"]) for r in kept.where(named).select("feature").collect()})
    place = {w: i for i, w in enumerate(vocabulary)}

    def placed(batches):
        import pyarrow as pa

        for b in batches:
            found = [_places(t, place) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([None if x is None else x.tobytes() for _, x in found], pa.binary())], ["doc_id", "toxic", "mine", "swapped"])

    got = sample.mapInArrow(placed, "doc_id long, toxic int, mine binary, swapped binary").orderBy("doc_id").collect()
    unpacked = lambda x: None if x is None else np.frombuffer(x, np.int32)
    return _solve([(unpacked(r["mine"]), unpacked(r["swapped"])) for r in got], np.array([r["toxic"] for r in got]), vocabulary)


def score_texts(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            score = np.array([model.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents_of(docs).select("doc_id", "text", held_out(F.col("doc_id"), FOLDS).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose texts the model rejects; all columns stay. A null text is judged like an empty one."""
    reject = F.pandas_udf(lambda s: s.map(lambda t: model.score(t) >= threshold).astype(bool), "boolean")
    return docs.where(~reject(F.col("text").cast("string")))


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, read_table(spark, sf_dir, "labels")))
