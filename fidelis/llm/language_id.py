"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

For each order the n-grams of all languages share one sorted array of 64-bit hashes; beside it lies
a row of log probabilities, one per language, already interpolated with the lower orders. A text is
scored by searching its n-grams in the arrays; what no language has seen falls back by the weights
of its context. The language with the lowest cross-entropy per symbol wins. A temperature turns the
differences into a probability, and texts whose cross-entropy is beyond what the language's own
held-back texts show, or whose probability is low, are marked as rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_texts, sample_by_class, strings, text_groups

ORDER, ALPHABET, BITS = 4, 65_000, 16
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd: the hash of a packed n-gram is unique
SHIFT = np.uint64(BITS)  # ORDER symbols fill 64 bits
#: Log probabilities that are looked up at once (symbols times languages).
AT_ONCE = 1 << 22


class Symbols:
    """Turns texts into symbols: 0 for a run of other characters, known letters, and one for other letters."""

    def __init__(self, letters: list[str]):
        self.letters = letters
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return self.letters

    def __setstate__(self, letters):
        self.__init__(letters)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each between zeros, and the text of each symbol."""
        if self.table is None:
            self.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000).astype(np.uint16) * (len(self.letters) + 1)
            self.table[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        lower = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lower), np.int64, len(lower))
        codes = self.table[np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        doc = np.repeat(np.arange(len(lower)), sizes + 1)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        return codes[keep], doc[keep]


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each symbol; zeros stand before the first."""
    padded = np.concatenate([np.zeros(order - 1, np.uint64), symbols.astype(np.uint64)])
    out = np.zeros(len(symbols), np.uint64)
    for k in range(order):
        out = (out << SHIFT) | padded[k : k + len(symbols)]
    return out


class Model:
    """Kneser-Ney models of several languages. Fitted on the driver from a bounded sample."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        count = Counter(c for t in texts.values() for x in t for c in x.lower() if c.isalpha())
        self.symbols = Symbols(sorted(c for c, _ in count.most_common(ALPHABET)))
        raw = []
        for lang in self.langs:
            symbols, doc = self.symbols.encode(texts[lang])
            start = np.concatenate([[True], doc[1:] != doc[:-1]])
            at = np.arange(len(symbols)) - np.maximum.accumulate(np.where(start, np.arange(len(symbols)), 0))
            raw.append((symbols, at))
        self.base = 1.0 / (len(self.symbols.letters) + 2)
        self.hashes, self.logs, self.contexts, self.weights = [], [], [], []
        lower: list[dict | None] = [None] * len(self.langs)
        for order in range(1, ORDER + 1):
            tables = []
            for n, (symbols, at) in enumerate(raw):
                if order == ORDER:
                    keys, counts = np.unique(grams(symbols, ORDER), return_counts=True)
                else:  # continuation counts: distinct symbols before
                    longer = np.unique(grams(symbols, order + 1))
                    keys, counts = np.unique(longer & np.uint64((1 << (BITS * order)) - 1), return_counts=True)
                tables.append((keys, counts.astype(np.float64)))
            union = np.unique(np.concatenate([k for k, _ in tables]))
            contexts = np.unique(union >> SHIFT)
            where = np.searchsorted(contexts, union >> SHIFT)
            logs, weights = np.zeros((len(union), len(self.langs))), np.ones((len(contexts), len(self.langs)))
            below = self.lower(union, order)
            for n, (keys, counts) in enumerate(tables):
                c = np.zeros(len(union))
                c[np.searchsorted(union, keys)] = counts
                n1, n2 = (counts == 1).sum(), (counts == 2).sum()
                discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                total = np.bincount(where, c, len(contexts))
                kinds = np.bincount(where, c > 0, len(contexts))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
                weights[:, n] = weight
                logs[:, n] = np.log(np.where(total[where] > 0, np.maximum(c - discount, 0) / np.maximum(total[where], 1e-300), 0) + weight[where] * below[:, n])
            for name, keys, values in ((("hashes", "logs"), union, logs), (("contexts", "weights"), contexts, np.log(weights))):
                hashed = keys * MIX
                by = np.argsort(hashed)
                getattr(self, name[0]).append(hashed[by])
                getattr(self, name[1]).append(values[by].astype(np.float32))
        del lower
        self.temperature, self.limits = 1.0, np.full(len(self.langs), np.inf)

    def lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Probabilities by the next lower order."""
        if order == 1:
            return np.full((len(keys), len(self.langs)), self.base)
        return np.exp(self.log_probability(keys & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1))

    def log_probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities, by language, of the last symbol of each n-gram after those before."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), np.log(self.base), np.float32)
        hashed, table = keys * MIX, self.hashes[order - 1]
        at = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
        out = self.logs[order - 1][at]
        missed = np.flatnonzero(table[at] != hashed)
        if len(missed):
            rest = self.log_probability(keys[missed] & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1)
            context, names = (keys[missed] >> SHIFT) * MIX, self.contexts[order - 1]
            c = np.minimum(np.searchsorted(names, context), len(names) - 1)
            out[missed] = rest + np.where((names[c] == context)[:, None], self.weights[order - 1][c], 0)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol, by text and language, and the letters of each text."""
        symbols, doc = self.symbols.encode(texts)
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, AT_ONCE // len(self.langs))
        for a in range(0, len(symbols), step):  # n-grams of a part also see the symbols before it
            b, first = min(len(symbols), a + step), max(0, a - ORDER + 1)
            part = self.log_probability(grams(symbols[first:b], ORDER)[a - first :], ORDER)
            begins = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
            total[doc[a:b][begins]] += np.add.reduceat(part, begins, axis=0, dtype=np.float64)
        n = np.bincount(doc, minlength=len(texts))
        return -total / np.maximum(n, 1)[:, None], np.bincount(doc[symbols > 0], minlength=len(texts))

    def calibrate(self, texts: dict[str, list[str]], quantile: float = 0.99, slack: float = 1.25) -> None:
        """Temperature with the lowest loss on held-back texts, and each language's limit of cross-entropy."""
        loss_of, rows = [], []
        for n, lang in enumerate(self.langs):
            if texts.get(lang):
                h, letters = self.cross_entropy(texts[lang])
                rows.append((h[letters > 0], n))
                if (letters > 0).any():
                    self.limits[n] = slack * np.quantile(h[letters > 0][:, n], quantile)
        choices = np.geomspace(0.02, 2, 25)
        for t in choices:
            loss_of.append(sum(-np.log(np.maximum(softmax(-h / t)[:, n], 1e-9)).sum() for h, n in rows))
        self.temperature = float(choices[int(np.argmin(loss_of))]) if rows else 1.0

    def predict(self, texts: list[str]) -> dict:
        if not self.langs:
            letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            return {"lang": pa.array(["und"] * len(texts)), "score": np.zeros(len(texts)), "cross_entropy": np.zeros(len(texts)), "known": letters & False}
        h, letters = self.cross_entropy(texts)
        best = h.argmin(axis=1)
        none = letters == 0
        score = np.where(none, 0.0, softmax(-h / self.temperature)[np.arange(len(h)), best])
        value = np.where(none, 0.0, h[np.arange(len(h)), best])
        return {"lang": pa.array(["und" if e else self.langs[i] for i, e in zip(best.tolist(), none.tolist(), strict=True)], pa.string()), "score": score, "cross_entropy": value, "known": ~none & (value <= self.limits[best]) & (score >= 0.5)}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, learnable, per_lang: int = 200, longest: int = 50_000, most_langs: int = 500) -> Model:
    """Fits on at most ``per_lang`` rows of each language among the ``learnable`` ones, chosen by a hash of doc_id.

    Texts of more than ``longest`` characters are not chosen, so that the sample has a bound; every
    fifth chosen text is held back for calibration. An id that repeats gives one text, the least. The
    model has a column for each language; of more than ``most_langs``, those with the most rows are
    learned, ties by name. Other columns of ``docs`` don't matter, whatever their names.
    """
    rows = docs.filter(learnable).select("doc_id", "lang", "text")
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("text") <= longest) & F.col("doc_id").isNotNull())
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs + 1).collect()
    if len(langs) > most_langs:
        rows = rows.filter(F.col("lang").isin([r["lang"] for r in langs[:most_langs]]))
    picked = sample_by_class(rows, "lang", per_lang, [])
    picked = picked.groupBy("doc_id").agg(F.min("lang").alias("_lang"))  # at most most_langs * per_lang rows
    texts = rows.join(F.broadcast(picked), "doc_id").filter(F.col("lang") == F.col("_lang"))
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one text for an id, however often it repeats
    sample = sorted((r["doc_id"], r["lang"], r["text"]) for r in texts.collect())
    train: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    seen: Counter = Counter()
    for _, lang, text in sample:
        seen[lang] += 1
        (held if seen[lang] % 5 == 0 else train).setdefault(lang, []).append(text)
    train = {k: v for k, v in train.items() if any(map(str.isalpha, "".join(v)))}
    model = Model(train) if train else Model.__new__(Model)
    if not train:
        model.langs = []
        return model
    model.calibrate(held)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang (und for texts without letters), score, cross_entropy and known of every row.

    ``known`` is false for rejected texts: without letters, unlike all languages, or between several.
    Null texts have no letters. Only the text is read. Equal texts get equal answers; ties go to
    the first language by name; empty tables stay empty; a model without languages answers und.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def start():
        own = shared.value

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b in text_groups(batch.column(1), 2_000_000):
                yield {"doc_id": batch.column(0).slice(a, b - a)} | own.predict(strings(batch.column(1).slice(a, b - a)))

        return work

    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), ["doc_id", "text"], "doc_id bigint, lang string, score double, cross_entropy double, known boolean", start)


def language_id(docs: DataFrame, per_lang: int = 200) -> DataFrame:
    """Fits on rows whose crc32(doc_id) mod 4 isn't 2 and predicts all: doc_id, held_out, lang_pred, score, known, cross_entropy."""
    model = fit(docs, crc_bucket("doc_id", 4) != 2, per_lang)
    out = identify(docs, model)
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "known", "cross_entropy")
