"""Periodic runs of words by comparing a text's word ids with themselves at every lag.

A run of period q and length m is a stretch of m - q words that equal the word q places on. For each
lag q up to n / 4 the whole id array is compared with its shift, and the true stretches are measured
by their lengths. A stretch of at least three times its lag whose root repeats a shorter word has a
smaller period (by Fine and Wilf a divisor of q) and is found there instead.

Spark deals out documents; of a long one, ranges of its lags go to different tasks, and the runs of
all ranges meet with the text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, give_back, let_go, map_texts, prepare, text_groups, written

#: A run has at least so many words, and so many times its period.
LEAST, EXPONENT = 6, 4
#: Text bytes whose words are compared at once; their ids fit in a processor's cache.
AT_ONCE = 500_000
#: Texts of more bytes have their lags cut into ranges, one for each so many bytes.
RANGE_BYTES = 1 << 19

RESULT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def source_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document's ``n`` words; None if they stay as they are."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def words_of(doc_id: int | None, text: str | None, rewritten: bool) -> list[bytes]:
    """A text's words; those that the document's rule repeats in place of others, if ``rewritten``."""
    own = (text or "").encode().split()  # bytes are split at ASCII white space only
    at = source_words(doc_id, len(own)) if rewritten else None
    return own if at is None else [own[i] for i in at.tolist()]


def ids_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one text after the other, and the texts' offsets; no two texts share an id."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not offsets[-1]:
        return np.zeros(0, np.int32), offsets
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(texts)), sizes) * len(words.dictionary)
    return (ids.astype(np.int32) if ids.max() < 1 << 31 else ids), offsets


def _primes(n: int) -> list[int]:
    """The different prime factors of ``n``."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def scan(ids: np.ndarray, offsets: np.ndarray, first: int = 1, last: int | None = None) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs with periods ``first`` to ``last``.

    ``ids`` holds the texts' words, the longest text first; only texts of at least four times a lag
    are compared at it, and those are the front of the array.
    """
    sizes = np.diff(offsets)
    most = int(sizes[0]) // EXPONENT if len(sizes) else 0
    found = []
    for q in range(first, min(most, last or most) + 1):
        long_enough = int(np.searchsorted(-sizes, -max(LEAST, EXPONENT * q), side="right"))
        own, least = ids[: offsets[long_enough]], max(LEAST, EXPONENT * q) - q
        same = own[:-q] == own[q:]
        if np.count_nonzero(same) < least:
            continue
        # Stretches by their places: much shorter than ``same`` where few words repeat at this lag.
        at = np.flatnonzero(same)
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        begins, ends = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts - 1, [len(at) - 1]])] + 1
        wide = np.flatnonzero(ends - begins >= least)
        if not len(wide):
            continue
        factors = _primes(q)
        for a, b in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
            root = own[a : a + q]
            if not any(np.array_equal(root[q // p :], root[: q - q // p]) for p in factors):
                text = int(np.searchsorted(offsets, a, side="right")) - 1
                found.append((text, a - int(offsets[text]), b - a + q, q))
    return found


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result's columns after doc_id from a document's words and its runs (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    left = words if not runs else [words[i] for i in np.flatnonzero(keep).tolist()]
    listed = hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
    milli = 1000 * top[1] // top[2] if top else None
    return (len(runs), *(top or (None, None, None)), milli, listed, hashlib.sha256(b" ".join(left)).hexdigest())


def _table(ids: list, results: list[tuple]) -> dict:
    columns = list(zip(*results, strict=True)) if results else [[] for _ in range(7)]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    return dict(zip(names, [pa.array(ids, pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], strict=True))


def _whole(docs: DataFrame, rewritten: bool) -> DataFrame:
    """Results of texts that one task scans at all their lags."""

    def start():
        let_go()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b in text_groups(batch.column(1), AT_ONCE):
                keys = batch.column(0).slice(a, b - a).to_pylist()
                words = [words_of(i, t, rewritten) for i, t in zip(keys, batch.column(1).slice(a, b - a).to_pylist(), strict=True)]
                order = sorted(range(len(words)), key=lambda i: -len(words[i]))
                runs: list[list] = [[] for _ in words]
                for text, *run in scan(*ids_of([words[i] for i in order])):
                    runs[order[text]].append(tuple(run))
                yield _table(keys, [summary(w, r) for w, r in zip(words, runs, strict=True)])

        return work

    return map_texts(docs, ["doc_id", "text"], RESULT, start)


def _of_ranges(ranged: DataFrame, rewritten: bool) -> DataFrame:
    """Runs (doc_id, digest, start, length, period) from rows (doc_id, digest, text, part, parts): a range of lags each."""
    schema = "doc_id bigint, digest string, start bigint, length bigint, period bigint"

    def start():
        let_go()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for row in batch.to_pylist():
                ids, offsets = ids_of([words_of(row["doc_id"], row["text"], rewritten)])
                most = len(ids) // EXPONENT
                first, last = (row["part"] * most // row["parts"], (row["part"] + 1) * most // row["parts"])
                runs = scan(ids, offsets, first + 1, last) if last > first else []
                columns = list(zip(*runs, strict=True))[1:] if runs else [[], [], []]
                yield {"doc_id": pa.array([row["doc_id"]] * len(runs), pa.int64()), "digest": pa.array([row["digest"]] * len(runs), pa.string())} | {n: pa.array(list(c), pa.int64()) for n, c in zip(("start", "length", "period"), columns, strict=True)}

        return work

    return map_texts(ranged, ["doc_id", "digest", "text", "part", "parts"], schema, start)


def _summed(runs: DataFrame, rewritten: bool) -> DataFrame:
    """Results of rows (doc_id, text, runs)."""

    def start():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for row in batch.to_pylist():
                found = [(r["start"], r["length"], r["period"]) for r in row["runs"] or []]
                yield _table([row["doc_id"]], [summary(words_of(row["doc_id"], row["text"], rewritten), found)])

        return work

    return map_texts(runs, ["doc_id", "text", "runs"], RESULT, start)


def periodic_runs(docs: DataFrame, range_bytes: int = RANGE_BYTES, rewritten: bool = True) -> DataFrame:
    """Runs of each row of ``docs``: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Words are runs of characters other than ASCII white space, numbered from 0. With ``rewritten``, a
    tenth of the documents, by the crc32 of their ids, first have words from some place on replaced by
    copies of those before, so that they have runs. A run is a stretch with smallest period q of at
    least max(6, 4 q) words that can't be extended. start, length, period and exponent_milli
    (floor(1000 length / period)) are those of the run with the greatest exact exponent, ties by the
    smallest start, then period; nulls if there is none. runs_sha256 is of all runs'
    ``start,length,period`` lines by start and period, collapsed_sha256 of the words left, joined by a
    space, if of each run only the first period stays.

    A null or blank text has no words and no runs. A row with a null id is never rewritten. Repeated
    rows come back as often. Texts of more than ``range_bytes`` bytes have their lags scanned in ranges
    by several tasks; the result is the same. An empty table gives no rows. Other columns of ``docs``
    are ignored.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = _whole(own.filter(size <= range_bytes), rewritten)
    long_ = own.filter(size > range_bytes).withColumn("digest", F.sha2("text", 256))
    if long_.select("doc_id").isEmpty():
        return short
    long_ = written(long_, "long-texts")
    once = long_.dropDuplicates(["doc_id", "digest"])  # results follow from id and text
    parts = F.ceil(F.octet_length("text") / range_bytes).cast("bigint")
    ranged = once.select("doc_id", "digest", "text", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepare(docs.sparkSession)
    runs = _of_ranges(ranged.repartition(n, "doc_id", "digest", "part"), rewritten)
    # A document has fewer runs than words.
    runs = runs.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    same = [long_["doc_id"].eqNullSafe(runs["doc_id"]), long_["digest"] == runs["digest"]]
    met = long_.join(runs, same, "left").select(long_["doc_id"], "text", "runs")
    return short.unionByName(_summed(met, rewritten))
