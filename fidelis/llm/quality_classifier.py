"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are split into a stem (letters and digits in lower case) and a shape (classes of characters,
runs collapsed: ``Word***`` is ``Aa*``). Each falls in a bucket with a fixed sparse random vector;
its context vector sums the random vectors of its neighbours over the labelled sample. A document
is the mean of its words' context vectors and shapes' random vectors, the length of its mean random
vector, the share of words equal to the one before, and its length. A network of two layers in
numpy gives a logit; a temperature fitted on held-back labels makes it a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, crc32, crc_bucket, give_back, let_go, map_texts, prepare, sample_by_class, strings, text_groups

STEMS, SHAPES, SIZE, NONZERO, REACH, HIDDEN = 1 << 14, 1 << 11, 32, 6, 2, 24
#: Words that are pooled at once, which bounds the memory of long texts.
AT_ONCE = 1 << 16
SHAPE_RUNS = re.compile(r"(.)\1+")


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary random vectors, one for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, SIZE), np.float32)
    at = np.argsort(rng.random((n, SIZE)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (n, NONZERO)), axis=1)
    return out / np.sqrt(NONZERO)


def shape(word: str) -> str:
    marks = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return SHAPE_RUNS.sub(r"\1", marks)


def buckets(word: str) -> int:
    """Stem and shape buckets of a word in one number."""
    stem = "".join(c for c in word.lower() if c.isalnum())
    return crc32(stem.encode("utf-8", "replace")) % STEMS * SHAPES + crc32(b"shape " + shape(word).encode("utf-8", "replace")) % SHAPES


class Pool:
    """Vectors of documents. ``context`` is learned by ``learn`` from a sample."""

    def __init__(self, seed: int = 7):
        self.seed = seed
        self.context = np.zeros((STEMS, SIZE), np.float32)
        self.restore()

    def restore(self) -> None:
        self.stems, self.shapes = index_vectors(STEMS, self.seed), index_vectors(SHAPES, self.seed + 1)
        self.memo = Memo(lambda words: [buckets(w) for w in words], 100_000)

    def __getstate__(self):
        return self.seed, self.context

    def __setstate__(self, state):
        self.seed, self.context = state
        self.restore()

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [t.split() for t in texts]
        known = self.memo.need(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((known[w] for x in words for w in x), np.int64, int(sizes.sum()))
        return flat // SHAPES, flat % SHAPES, np.repeat(np.arange(len(texts)), sizes)

    def learn(self, texts: list[str], at_once: int = 50) -> None:
        for a in range(0, len(texts), at_once):  # a few texts at once bound the driver's memory
            stem, form, doc = self.codes(texts[a : a + at_once])
            own = self.stems[stem] + self.shapes[form]
            for step in range(1, REACH + 1):
                same = np.flatnonzero(doc[step:] == doc[:-step])
                np.add.at(self.context, stem[same], own[same + step])
                np.add.at(self.context, stem[same + step], own[same])
        self.context /= np.maximum(np.linalg.norm(self.context, axis=1, keepdims=True), 1e-6)

    def vectors(self, texts: list[str]) -> np.ndarray:
        stem, form, doc = self.codes(texts)
        n = np.bincount(doc, minlength=len(texts))
        size = np.maximum(n, 1)[:, None]
        out = np.zeros((len(texts), 2 * SIZE + 3))
        plain = np.zeros((len(texts), SIZE))
        for a in range(0, len(doc), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            begins = np.flatnonzero(np.concatenate([[True], doc[part][1:] != doc[part][:-1]]))
            at = doc[part][begins]
            for table, code, target in ((self.context, stem, out[:, :SIZE]), (self.shapes, form, out[:, SIZE : 2 * SIZE]), (self.stems, stem, plain)):
                target[at] += np.add.reduceat(table[code[part]], begins, axis=0, dtype=np.float64)
        out[:, : 2 * SIZE] /= size
        again = (doc[1:] == doc[:-1]) & (stem[1:] == stem[:-1])
        out[:, -3] = np.linalg.norm(plain / size, axis=1)
        out[:, -2] = np.bincount(doc[1:][again], minlength=len(texts)) / size[:, 0]
        out[:, -1] = np.log1p(n)
        return out


class Network:
    """Two layers, trained with Adam on all rows at once; ``temperature`` divides the logits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 250, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-3, 1.0
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        self.weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, steps + 1):
            w1, b1, w2, _ = self.weights
            hidden = np.tanh(x @ w1 + b1)
            error = (sigmoid(hidden @ w2 + self.weights[3]) - y) / len(y)
            back = np.outer(error, w2) * (1 - hidden**2)
            slopes = [x.T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, np.array([error.sum()])]
            for k, g in enumerate(slopes):
                m, v = moments[k] = (0.9 * moments[k][0] + 0.1 * g, 0.999 * moments[k][1] + 0.001 * g * g)
                self.weights[k] = self.weights[k] - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logits(x)
        choices = np.geomspace(0.25, 10, 40)
        loss = [-(np.where(y > 0, np.log(np.maximum(sigmoid(z / t), 1e-12)), np.log(np.maximum(1 - sigmoid(z / t), 1e-12)))).mean() for t in choices]
        self.temperature = float(choices[int(np.argmin(loss))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Classifier:
    """Pooled vectors and network. With one class only it answers that class's share."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, np.float64)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.pool, self.network = Pool(), None
        if len(y) and 0 < self.prior < 1:
            held = np.arange(len(y)) % 5 == 4
            self.pool.learn([t for t, h in zip(texts, held.tolist(), strict=True) if not h])
            x = np.concatenate([self.pool.vectors(texts[a : a + 50]) for a in range(0, len(texts), 50)])
            fit = ~held if 0 < y[~held].mean() < 1 else held | True
            self.network = Network(x[fit], y[fit])
            if held.any():
                self.network.calibrate(x[held], y[held])

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.network:
            return np.full(len(texts), self.prior)
        return sigmoid(self.network.logits(self.pool.vectors(texts)) / self.network.temperature)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1000, longest: int = 50_000) -> Classifier:
    """Fits on at most ``per_class`` labelled rows of each class whose crc32(doc_id) mod 5 isn't 0.

    Rows with null ids, labels or texts, and texts of more than ``longest`` characters, are not
    learned from; repeated or contradicting labels of one id count once each, with the least of its texts.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", 5) != 0)).select("doc_id", F.col(label).cast("int").alias("_label")).distinct()
    picked = sample_by_class(rows, "_label", per_class, [])
    texts = docs.filter(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # two classes of per_class rows
    texts = texts.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))  # one text for an id, however often it repeats
    sample = sorted(((r["doc_id"], r["_label"], r["text"]) for r in texts.collect()), key=lambda r: (crc32(str(r[0]).encode()), r))
    return Classifier([r[2] for r in sample], [r[1] for r in sample])


def quality_scores(docs: DataFrame, classifier: Classifier, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= threshold) of every row of ``docs``.

    Only the text is read; null counts as empty, and empty texts get a score, too. Equal texts get
    equal scores; an empty table stays empty; a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # fixed size: buckets and network

    def start():
        own = shared.value
        let_go()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b in text_groups(batch.column(1), 2_000_000):
                score = own.score(strings(batch.column(1).slice(a, b - a)))
                yield {"doc_id": batch.column(0).slice(a, b - a), "score": score, "predicted": (score >= threshold).astype(np.int32)}

        return work

    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), ["doc_id", "text"], "doc_id bigint, score double, predicted int", start)


def accepted(docs: DataFrame, classifier: Classifier, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``threshold`` or more.

    The verdict falls where the text is read, row by row, so nothing is shuffled and null or repeated
    ids don't matter. ``docs`` must have a column text; null counts as empty; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # fixed size
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        let_go()
        for batch in batches:
            for a, b in text_groups(batch.column(at), 2_000_000):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(own.score(strings(part.column(at))) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 5 is 0), score, predicted."""
    out = quality_scores(docs, fit(docs, labels), threshold)
    return out.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
