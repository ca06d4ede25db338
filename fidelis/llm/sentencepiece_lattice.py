"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array, ordered on as many
characters as the longest piece has. Every piece is binary-searched for its range of occurrences;
each occurrence is an edge from its first to behind its last character. The edges are sorted by
position, and the lattice is then relaxed: in each round every word applies its best edge that
joins exactly two current symbols (highest score, then leftmost), until no word has one. That is
the order in which a BPE model merges, so the result is the model's own. Words too long for
rounds over all of them go through the same edges with a heap. Characters that no piece covers
become byte pieces.

Pieces are read from the public .model file; its protocol buffer is parsed by the library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import Memo, crc32, kept, map_texts, ragged, strings, text_groups

SPACE = "▁"
#: Longer words are relaxed one by one with a heap.
LONG = 96
#: Text bytes that are encoded at once; their arrays take about a hundred times as much.
AT_ONCE = 1_000_000


class Pieces:
    """The vocabulary: pieces as rows of character codes, scores as ranks, byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are supported")
        self.prefix, self.library = spec.add_dummy_prefix, SentencePieceProcessor(model_file=path)
        self.text = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        if any(p.type in (4, 5) for p in model.pieces) or any(SPACE in self.text[i].lstrip(SPACE) for i in normal):
            raise ValueError("user-defined, unused or space-crossing pieces are not supported")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        scores = np.array([model.pieces[i].score for i in normal])
        level = np.unique(-scores, return_inverse=True)[1]  # 0 is best; equal scores share a level
        self.single = np.full(0x110000, -1, np.int32)
        one = [i for i in normal if len(self.text[i]) == 1]
        self.single[[ord(self.text[i]) for i in one]] = one
        many = [(k, i) for k, i in enumerate(normal) if len(self.text[i]) > 1]
        alphabet = sorted({c for i in normal for c in self.text[i]})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)  # 0: a word's end, 1: no piece has it
        self.code[self.code == 0] = 1
        self.width = max((len(self.text[i]) for _, i in many), default=1)
        self.ids = np.array([i for _, i in many], np.int64)
        self.level = np.array([level[k] for k, _ in many], np.int64)
        self.length = np.array([len(self.text[i]) for _, i in many], np.int64)
        self.rows = np.zeros((len(many), self.width), np.uint16)
        for r, (_, i) in enumerate(many):
            self.rows[r, : len(self.text[i])] = self.code[[ord(c) for c in self.text[i]]]

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Positions ordered by the ``width`` codes from there (0 beyond the end), by prefix doubling from four codes on."""
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)]).astype(np.uint64)
    n, span = len(codes), 4
    key = (padded[:n] << 48) | (padded[1 : n + 1] << 32) | (padded[2 : n + 2] << 16) | padded[3 : n + 3]
    order = np.argsort(key)
    while span < width:
        in_order = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], in_order[1:] != in_order[:-1]]))
        key = rank << 32
        if span < n:
            key[:-span] |= rank[span:]
        order = np.argsort(key)
        span *= 2
    return order


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the range of the suffix array whose suffixes begin with it."""
    padded = np.concatenate([codes, np.zeros(rows.shape[1], codes.dtype)])

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            at = order[mid]
            for k in range(rows.shape[1]):  # compares one character of all pieces at a time
                used = equal & (k < length[open_])
                if not used.any():
                    break
                a, b = padded[at + k], rows[open_, k]
                less |= used & (a < b)
                equal &= ~used | (a == b)
            right = less | equal if upper else less
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)

    return bound(False), bound(True)


class Encoder:
    """Encodes words (as the model cuts texts at spaces) and keeps their ids in a bounded dictionary."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.memo = Memo(self.learn, 400_000, 64 << 20)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self.cut.findall(SPACE + text if self.pieces.prefix else text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.words(t) for t in texts]
        known = self.memo.need(parts)
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and piece row of all occurrences, sorted by begin and end."""
        order = suffix_array(codes, self.pieces.width)
        low, high = occurrence_ranges(codes, order, self.pieces.rows, self.pieces.length)
        n = high - low
        row = np.repeat(np.arange(len(n)), n)
        begin = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        by = np.argsort(begin * (self.pieces.width + 1) + self.pieces.length[row])
        return begin[by], row[by]

    def learn(self, words: list[str]) -> list[bytes]:
        p = self.pieces
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 behind each word
        points = np.zeros(offsets[-1], np.uint32)
        points[np.delete(np.arange(offsets[-1]), offsets[1:] - 1)] = codepoints("".join(words))
        codes = p.code[points]
        codes[offsets[1:] - 1] = 0
        begin, row = self.edges(codes)
        end = begin + p.length[row]
        inner = np.zeros(len(codes) + 1, bool)  # a current symbol begins here
        inner[:-1] = True
        word = np.searchsorted(offsets, begin, side="right") - 1
        short = sizes[word] <= LONG
        self.relax(begin[short], end[short], row[short], word[short], inner)
        for w in np.flatnonzero(sizes > LONG).tolist():
            a, b = np.searchsorted(begin, [offsets[w], offsets[w + 1]])
            self.relax_long(begin[a:b], end[a:b], row[a:b], inner, int(offsets[w]), int(offsets[w + 1]) - 1)
        # What spans several characters is a piece's edge; sorted keys find it again.
        key = begin * (p.width + 1) + p.length[row]
        starts = np.flatnonzero(inner[:-1])
        stops = np.append(starts[1:], len(codes))
        want = starts * (p.width + 1) + np.minimum(stops - starts, p.width)
        many = stops - starts > 1
        ids = np.full(len(starts), -1, np.int64)
        ids[many] = p.ids[row[np.searchsorted(key, want[many])]]
        ids[~many] = p.single[points[starts[~many]]]
        first = np.searchsorted(starts, offsets)
        data, ends = ids.astype(np.int32).tobytes(), (4 * first).tolist()
        out = [data[a : b - 4] for a, b in zip(ends, ends[1:], strict=False)]  # without the 0 behind the word
        for w in np.unique(np.searchsorted(offsets, starts[(ids < 0) & (codes[starts] > 0)], side="right") - 1).tolist():
            own, at = ids[first[w] : first[w + 1] - 1].tolist(), starts[first[w] : first[w + 1] - 1] - offsets[w]
            own = [x for i, k in zip(own, at.tolist(), strict=True) for x in ([i] if i >= 0 else p.fallback(words[w][k]))]
            out[w] = np.asarray(own, np.int32).tobytes()
        return out

    def relax(self, begin, end, row, word, inner) -> None:
        """Rounds over all words: each applies its best edge over exactly two symbols."""
        p = self.pieces
        level = p.level[row] if len(row) else np.zeros(0, np.int64)
        while len(begin):
            bounds = np.flatnonzero(inner)
            count = np.cumsum(inner[:-1], dtype=np.int32)
            # An edge is alive while both ends are bounds of symbols; it can be applied when two symbols lie in it.
            whole = inner[begin] & inner[end]
            symbols = count[end - 1] - count[begin] + 1
            live = whole & (symbols > 1)
            begin, end, level, word, symbols = begin[live], end[live], level[live], word[live], symbols[live]
            ready = np.flatnonzero(symbols == 2)
            if not len(ready):
                return
            own = word[ready]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(level[ready] * (1 << 32) + np.arange(len(ready)), heads) & 0xFFFFFFFF
            chosen = ready[best]
            # The bound between the two symbols goes.
            inner[bounds[count[begin[chosen]]]] = False

    def relax_long(self, begin, end, row, inner, first: int, last: int) -> None:
        """The same order of merges for one long word, with a heap of the edges over two symbols."""
        p = self.pieces
        level = {(b, e): lv for b, e, lv in zip(begin.tolist(), end.tolist(), p.level[row].tolist(), strict=True)}
        after = {i: i + 1 for i in range(first, last)}
        before = {i + 1: i for i in range(first, last)}
        heap = [(lv, b, b + 1, e) for (b, e), lv in level.items() if e == b + 2]
        heapq.heapify(heap)
        while heap:
            _, b, m, e = heapq.heappop(heap)
            if after.get(b) != m or after.get(m) != e:
                continue
            inner[m] = False
            del after[m]
            after[b], before[e] = e, b
            for x, y, z in ((before.get(b), b, e), (b, e, after.get(e))):
                if x is not None and z is not None and (lv := level.get((x, z))) is not None:
                    heapq.heappush(heap, (lv, x, y, z))


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids: pieces joined, bytes collected and read as UTF-8, the leading space removed."""
    data = b"".join([bytes([pieces.byte_of[i]]) if i in pieces.byte_of else pieces.text[i].encode() for i in ids.tolist()])
    text = data.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if pieces.prefix and text.startswith(" ") else text


def sentencepiece(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Encodes and decodes every row: doc_id, ids, decoded.

    Null and empty texts have no ids and decode to the empty text. Texts decode to themselves,
    but for U+2581, which the model writes for a space and which comes back as a space. Equal texts give
    equal ids; a null doc_id stays; an empty table stays empty; other columns of ``docs`` are not used.
    """
    return _encoded(docs, vocabulary, "doc_id bigint, ids array<int>, decoded string", lambda pieces, texts, ids: {"ids": _list(ids), "decoded": pa.array([decode(pieces, x) for x in ids], pa.string())})


def sentencepiece_summary(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """What the query returns: doc_id, n_pieces, n_byte_pieces, ids_crc32 (ids as little-endian
    unsigned 32-bit integers), round_trip (the ids decode to the text with U+2581 as space)."""

    def columns(pieces, texts, ids):
        low, high = (min(pieces.byte_of), max(pieces.byte_of)) if pieces.byte_of else (0, -1)
        return {
            "n_pieces": np.array([len(x) for x in ids], np.int64),
            "n_byte_pieces": np.array([int(((x >= low) & (x <= high)).sum()) for x in ids], np.int64),
            "ids_crc32": np.array([crc32(x.astype("<u4").tobytes()) for x in ids], np.int64),
            "round_trip": np.array([decode(pieces, x) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)], bool),
        }

    return _encoded(docs, vocabulary, "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean", columns)


def sentencepiece_encoded(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", keep: list[str] | None = None) -> DataFrame:
    """What a training job reads: doc_id, ids, n_pieces, round_trip, and the bigint columns ``keep`` of ``docs``."""

    def columns(pieces, texts, ids):
        return {"ids": _list(ids), "n_pieces": np.array([len(x) for x in ids], np.int64), "round_trip": np.array([decode(pieces, x) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)], bool)}

    return _encoded(docs, vocabulary, "doc_id bigint, ids array<int>, n_pieces bigint, round_trip boolean", columns, keep or [])


def _list(ids: list[np.ndarray]) -> pa.Array:
    flat, offsets = ragged(ids)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def _encoded(docs: DataFrame, vocabulary: str, schema: str, columns, keep: list[str] = []) -> DataFrame:  # noqa: B006
    path = public_tokenizers.path(vocabulary)

    def start():
        encoder = kept(Encoder, path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b in text_groups(batch.column(1), AT_ONCE):
                texts = strings(batch.column(1).slice(a, b - a))
                own = {c: batch.column(i).slice(a, b - a) for i, c in enumerate(["doc_id", "text", *keep]) if c != "text"}
                yield own | columns(encoder.pieces, texts, encoder.encode(texts))

        return work

    schema = ", ".join([schema, *[f"{c} bigint" for c in keep]])
    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text", *keep), ["doc_id", "text", *keep], schema, start)
