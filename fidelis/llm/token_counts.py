"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

All new pre-tokens of a batch lie in one flat array of symbols. In each round every sequence
finds the lowest rank among its pairs and merges all occurrences of that pair at once; sequences
without a known pair leave. The symbols that survive are the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from . import byte_bpe
from .common import Memo, kept, map_texts, strings, text_groups

NONE = np.int64(1) << 60


class RankMerger:
    """Counts BPE symbols of many short byte strings at once."""

    def __init__(self, spec: dict):
        self.byte_ids = np.array([spec["bytes"][b] for b in range(256)], np.int64)
        keys = np.array([(a << 32) | b for a, b in spec["merges"]], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        values = np.array(list(spec["merges"].values()), np.int64).reshape(-1, 2)[order]
        self.ranks, self.merged = values[:, 0].copy(), values[:, 1].copy()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positions in the merge table, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            pair = np.full(len(symbols), -1, np.int64)  # the pair of a symbol with the next one
            same = owner[1:] == owner[:-1]
            pair[:-1][same] = self.rank_of(symbols[:-1][same], symbols[1:][same])
            rank = np.where(pair >= 0, self.ranks[pair], NONE)
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            lengths = np.diff(np.append(begins, len(owner)))
            lowest = np.minimum.reduceat(rank, begins)
            done = lowest == NONE
            out[owner[begins[done]]] = lengths[done]
            best = np.repeat(lowest, lengths)
            hit = (rank == best) & (best != NONE)
            # Of overlapping occurrences (aaa) the first, third ... of each run are merged.
            run = np.flatnonzero(hit)
            if len(run):
                fresh = np.concatenate([[True], np.diff(run) != 1])
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - begin) % 2 == 0]
            symbols[run] = self.merged[pair[run]]
            keep = best != NONE
            keep[run + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class Counter:
    """Tokens of whole texts; counts of words seen before are kept in a bounded dictionary."""

    def __init__(self, path: str):
        spec = byte_bpe.load(path)
        self.merger, self.ids = RankMerger(spec), spec["special"]
        self.special = byte_bpe.special_pattern(self.ids)
        self.memo = Memo(self.learn)

    def learn(self, chunks: list[str]) -> list[int]:
        pre = [byte_bpe.PRETOKEN.findall(byte_bpe.spelled(c)) for c in chunks]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(x for y in pre for x in y))}
        counts = self.merger.count([p.encode("utf-8", "surrogatepass") for p in distinct]).tolist()
        return [sum(counts[distinct[p]] for p in y) for y in pre]

    def count(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            sections = self.special.split(text) if any(x in text for x in self.ids) else [text]
            extra.append(len(sections) - 1)
            parts.append([c for s in sections for c in byte_bpe.chunks(s)] if len(sections) > 1 else byte_bpe.chunks(text))
        known = self.memo.need(parts)
        return [n + sum(map(known.__getitem__, p)) for n, p in zip(extra, parts, strict=True)]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    ``vocabulary`` is a .json file of the tokenizers library, by name among the public ones.
    Null texts count as empty (0 tokens); special strings in a text are one token each; equal
    rows give equal rows; a null doc_id stays null; an empty table gives an empty table.
    """
    path = public_tokenizers.path(vocabulary)

    def start():
        counter = kept(Counter, path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b in text_groups(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = strings(part.column(1))
                tokens = np.array(counter.count(texts), np.int64)
                yield {"doc_id": part.column(0), "n_bytes": np.array([len(t.encode()) for t in texts], np.int64), "n_tokens": tokens, "over_limit": tokens > limit}

        return work

    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), ["doc_id", "text"], "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", start)
