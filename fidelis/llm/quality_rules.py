"""Quality rules: counts that fail junk outright, and tokeniser fertility with bands per language or script.

A public vocabulary is a yardstick for text: where it needs many tokens for few characters, falls
back to bytes, or repeats few tokens, the text is unlike its language. For every document the
operator measures characters per token, the share of byte pieces and the entropy of its tokens
(relative to the most it could be). Bands come from the median and spread of each measure in four
nested groups: documents of the same language and script, of the language, of the script, and all.
The fewer documents a group has, the more its band is that of the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Memo, kept, map_texts, ragged, strings, text_groups, written

#: Groups of language and script whose bands are broadcast, at most.
MOST_BANDS = 10_000
SPACES, SYMBOLS, WINDOW = " \t\n\v\f\r", "#*$%&|<>", 5
#: Scripts by ranges of code points (fixed values).
SCRIPTS = {
    "Latin": (0x41, 0x24F), "Greek": (0x370, 0x3FF), "Cyrillic": (0x400, 0x52F), "Hebrew": (0x590, 0x5FF), "Arabic": (0x600, 0x6FF),
    "Indic": (0x900, 0xDFF), "Thai": (0xE00, 0xE7F), "Kana": (0x3040, 0x30FF), "Han": (0x3400, 0x9FFF), "Hangul": (0xAC00, 0xD7AF),
}
METRICS = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, script string"


def script_of(word: str) -> int:
    """Index of the script of a word's first letter; the number of scripts if it has none."""
    first = next((ord(c) for c in word if c.isalpha()), -1)
    return next((i for i, (a, b) in enumerate(SCRIPTS.values()) if a <= first <= b), len(SCRIPTS))


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen.update(lines)
    return len(lines) - len(seen)


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the words in windows of five that occur twice or more in it. ``words``: ids, by document."""
    if len(words) < WINDOW:
        return np.zeros(n_docs, np.int64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    n = len(words) - WINDOW + 1
    inside = doc[:n] == doc[WINDOW - 1 :]
    code = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(WINDOW):
        code = code * np.uint64(0x100000001B3) + mixed[k : k + n]
        code ^= code >> np.uint64(31)
    at = np.flatnonzero(inside)
    order = at[np.argsort(code[at])]
    in_order = code[order]
    same = in_order[1:] == in_order[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


class Fertility:
    """Measures of whole texts; a word's pieces are kept in a bounded dictionary."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.library.is_byte(i) for i in range(self.library.get_piece_size())])
        self.memo = Memo(self.learn, 300_000)

    def learn(self, words: list[bytes]) -> list[tuple[bytes, int]]:
        text = [w.decode() for w in words]
        return [(np.array(ids, np.int32).tobytes(), script_of(w)) for ids, w in zip(self.library.encode(text, num_threads=1), text, strict=True)]

    def measure(self, texts: list[str]) -> dict:
        words = [t.encode().split() for t in texts]
        known = self.memo.need(words)
        n_docs, n_words = len(texts), np.fromiter(map(len, words), np.int64, len(texts))
        flat = [w for x in words for w in x]
        number = {w: i for i, w in enumerate(set(flat))}
        doc = np.repeat(np.arange(n_docs), n_words)
        repeat = repeated_words(np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), doc, n_docs)
        found = [known[w] for w in flat]
        ids, offsets = ragged([np.frombuffer(b"".join([p for p, _ in found[a:b]]), np.int32) for a, b in zip(np.cumsum(n_words) - n_words, np.cumsum(n_words), strict=True)])
        tokens = np.diff(offsets)
        owner = np.repeat(np.arange(n_docs), tokens)
        keys, counts = np.unique(owner * (1 << 20) + ids, return_counts=True)
        of = keys >> 20
        share = counts / np.maximum(tokens, 1)[of]
        bits = np.bincount(of, -share * np.log2(share), n_docs)
        scripts = np.bincount(doc * (len(SCRIPTS) + 1) + np.fromiter((s for _, s in found), np.int64, len(found)), minlength=n_docs * (len(SCRIPTS) + 1)).reshape(n_docs, -1)
        chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
        names = np.array([*SCRIPTS, "other"])
        return {
            "n_words": n_words,
            "word_chars": chars,
            "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
            "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
            "n_repeat_words": repeat.astype(np.int64),
            "n_tokens": tokens,
            "chars_per_token": chars / np.maximum(tokens, 1),
            "byte_share": np.bincount(owner, self.byte[ids], n_docs) / np.maximum(tokens, 1),
            "token_entropy": bits / np.log2(np.maximum(np.minimum(tokens, len(self.byte)), 2)),
            "script": pa.array(names[np.where(scripts[:, :-1].any(axis=1), scripts[:, :-1].argmax(axis=1), len(SCRIPTS))].tolist(), pa.string()),
        }


def text_metrics(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", carry: bool = False) -> DataFrame:
    """Counts and fertility measures of every row, with the columns METRICS; the row itself as struct ``row`` where ``carry``."""
    path = public_tokenizers.path(vocabulary)

    def start():
        fertility = kept(Fertility, path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = batch.column(2).field("text") if carry else batch.column(2)
            for a, b in text_groups(texts):
                part = batch.slice(a, b - a)
                own = {"row": part.column(2)} if carry else {}
                yield {"doc_id": part.column(0), "lang": part.column(1)} | fertility.measure(strings(texts.slice(a, b - a))) | own

        return work

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", whole if carry else F.col("text"))
    schema = StructType.fromDDL(METRICS)
    return map_texts(rows, rows.columns, schema.add("row", docs.schema) if carry else schema, start)


def quality_rules(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", width: float = 6.0, least_spread: float = 0.03, least_tokens: int = 50, least_docs: int = 200) -> DataFrame:
    """Counts, base_failed and kept of every row of ``docs``, with the measures and the document's script.

    A document stays if it passes the base rules and lies in its group's bands: characters per token
    within ``width`` spreads of the median on both sides, entropy not more than that below, byte
    pieces not more than that above (and 5 % are always allowed). A spread is the quartile range /
    1.349, but ``least_spread`` of the median at least, so that a large group of copies can't narrow
    a band to nothing. Documents of n < ``least_tokens`` tokens don't shape bands, as their measures
    scatter; their own bands are wider by sqrt(least_tokens / n), and as many byte pieces are always
    allowed as to a document of ``least_tokens``.

    A group of n documents has the median and spread of a mixture of itself and the next group, with
    weight n / (n + k). k is ``least_docs`` for a language within its script and a script within all,
    and the language's documents (``least_docs`` at least) for a script within a language: a script
    that is rare in its language is measured by the language. Every document has a band; where the
    table has short documents only, those give it.

    Null texts are without words and fail the base rules. Null languages go by script. Equal texts in
    the same language get equal verdicts. Empty tables give empty results; other columns are ignored.
    """
    return _judged(written(text_metrics(docs, vocabulary), "fertility"), width, least_spread, least_tokens, least_docs).drop("row")


def accepted(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", width: float = 6.0, least_spread: float = 0.03, least_tokens: int = 50, least_docs: int = 200) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``quality_rules`` keeps.

    Each row is written beside its measures, and its verdict falls when it is read again with the bands
    at hand: texts are not shuffled, and null or repeated ids don't matter. Cases as in ``quality_rules``.
    """
    metrics = written(text_metrics(docs, vocabulary, carry=True), "fertility-rows")
    return _judged(metrics, width, least_spread, least_tokens, least_docs).filter("kept").select("row.*")


def _judged(metrics: DataFrame, width: float, least_spread: float, least_tokens: int, least_docs: int) -> DataFrame:
    """Verdicts of measured documents, with their struct ``row`` (null if they carry none)."""
    if "row" not in metrics.columns:
        metrics = metrics.withColumn("row", F.lit(None).cast("string"))
    long = metrics.filter(F.col("n_tokens") >= least_tokens)
    measures = ("chars_per_token", "byte_share", "token_entropy")

    def group(keys: list[str], name: str) -> DataFrame:
        """Documents, medians and spreads of the groups by ``keys``, in the struct ``name``."""
        quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in measures]
        out = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *quartiles)
        return out.select(*keys, F.struct("n", *_centres(measures)).alias(name))

    def mixed(name: str, parent: str, k: Column) -> Column:
        """Medians and spreads of ``name`` mixed with those of ``parent``: the moments of a mixture."""
        w = F.col(f"{name}.n") / (F.col(f"{name}.n") + k)
        parts = []
        for c in measures:
            a, b = F.col(f"{name}.{c}"), F.col(f"{parent}.{c}")
            far = a["mid"] - b["mid"]
            spread = F.sqrt(w * a["spread"] * a["spread"] + (1 - w) * b["spread"] * b["spread"] + w * (1 - w) * far * far)
            parts.append(F.struct((w * a["mid"] + (1 - w) * b["mid"]).alias("mid"), spread.alias("spread")).alias(c))
        return F.when(F.col(f"{name}.n").isNotNull(), F.struct(*parts)).otherwise(F.struct(*[F.col(f"{parent}.{c}").alias(c) for c in measures]))

    any_length = lambda c: F.coalesce(F.percentile_approx(F.when(F.col("n_tokens") >= least_tokens, F.col(c)), [0.25, 0.5, 0.75], 1000), F.percentile_approx(F.when(F.col("n_tokens") > 0, F.col(c)), [0.25, 0.5, 0.75], 1000))
    whole = metrics.agg(*[any_length(c).alias(c) for c in measures]).select(F.struct(*_centres(measures)).alias("whole"))  # one row
    by_script = metrics.select("script").distinct().join(group(["script"], "own"), "script", "left").join(F.broadcast(whole))
    by_script = by_script.select("script", mixed("own", "whole", F.lit(least_docs)).alias("general"))  # as many rows as there are scripts, at most
    by_lang = group(["lang", "script"], "both").filter(F.col("lang").isNotNull())
    langs = group(["lang"], "own")
    pairs = metrics.filter(F.col("lang").isNotNull()).select("lang", "script").distinct()
    by_lang = pairs.join(langs, "lang").join(by_lang, ["lang", "script"], "left").join(F.broadcast(by_script), "script")
    by_lang = by_lang.withColumn("tongue", mixed("own", "general", F.lit(least_docs)))
    by_lang = by_lang.select("lang", "script", mixed("both", "tongue", F.greatest("own.n", F.lit(least_docs))).alias("special"))
    if pairs.limit(MOST_BANDS + 1).count() <= MOST_BANDS:  # languages are few; a column of anything else takes the shuffle
        by_lang = F.broadcast(by_lang)
    rows = metrics.join(by_lang, ["lang", "script"], "left").join(F.broadcast(by_script), "script", "left")
    band, wider = F.coalesce("special", "general"), F.sqrt(F.greatest(least_tokens / F.greatest("n_tokens", F.lit(1)), F.lit(1.0)))
    mid = lambda c: band[c]["mid"]
    far = lambda c: wider * width * F.greatest(band[c]["spread"], least_spread * mid(c))
    cpt, byte, entropy = measures
    inside = F.col(cpt).between(mid(cpt) - far(cpt), mid(cpt) + far(cpt)) & (F.col(byte) <= F.greatest(mid(byte) + far(byte), 0.05 * wider * wider)) & (F.col(entropy) >= mid(entropy) - far(entropy))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"),
        "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script", "row",
    )


def _centres(measures: tuple[str, ...]) -> list[Column]:
    """Median and spread from arrays of quartiles."""
    return [F.struct(F.col(c)[1].alias("mid"), ((F.col(c)[2] - F.col(c)[0]) / 1.349).alias("spread")).alias(c) for c in measures]
