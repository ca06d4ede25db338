"""Token ids in binary shards: independent zstandard frames, a trailing seek table, checksums.

A shard holds the ids of consecutive documents (ascending doc_id) as little-endian unsigned
32-bit integers. Each frame holds whole documents, carries its own zstandard checksum and is
also listed, with a checksum of its content, in the seek table at the end: a skippable frame
(magic 0x184D2A5E) as in zstandard's public seekable format. A reader takes the footer, finds
the frame of a document and decompresses only that. Which documents lie where is in a skippable
frame before the seek table.
"""

from __future__ import annotations

import struct
import sys
import uuid
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import Memo, crc32, file_system, kept, map_texts, prepare, shared_dir, text_groups, written

#: Fixed values of the seekable format.
SKIPPABLE, INDEX_FRAME, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80
FRAME_BYTES, SHARD_BYTES = 1 << 20, 256 << 20
#: A shard ends after so many documents, too: its index is held in memory.
SHARD_DOCS = 250_000
#: Bytes and rows of texts whose words are looked up together: the more, the fewer words are looked up again.
LOOKED_UP, LOOKED_UP_ROWS = 12 << 20, 20_000
#: Words of a text whose ids are gathered at once.
STEP = 1 << 20
#: Marks that form one pre-token behind letters. The apostrophe isn't one: contractions begin with it.
MARKS = ".,;:!?*#$%&|<>=+-_/()[]{}@~"
#: Documents of a shard, in order: id, 1 if the id is null, frame, bytes before it in the frame, tokens.
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("frame", "<u4"), ("at", "<u8"), ("tokens", "<u8")])


class ShardWriter:
    """Writes one shard; ``close`` gives it its final name, so that a reader never sees a torn file."""

    def __init__(self, folder: str, level: int = 1):
        self.fs, top = file_system(folder)
        self.fs.create_dir(top, recursive=True)
        self.name = f"{uuid.uuid4().hex}.ids.zst"
        self.path = f"{top}/{self.name}"
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple] = []
        self.open: list[bytes] = []
        self.open_bytes = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.open and self.open_bytes + len(ids) > FRAME_BYTES:
            self.flush()
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.open_bytes, len(ids) // 4))
        self.open.append(ids)
        self.open_bytes += len(ids)
        self.total += len(ids)

    def flush(self) -> None:
        data = b"".join(self.open)
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.frames.append((len(frame), len(data), crc32(data)))
        self.open, self.open_bytes = [], 0

    def close(self) -> tuple[str, int, int]:
        """Name, documents and ids of the shard."""
        if self.open:
            self.flush()
        index = zstandard.ZstdCompressor(level=3).compress(np.array(self.docs, INDEX).tobytes())
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return self.name, len(self.docs), self.total // 4


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums")
        table = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.frames = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        head = size - 9 - 12 * n - 8
        magic, length = struct.unpack("<II", self.file.read_at(8, int(self.begins[-1])))
        if magic != INDEX_FRAME or self.begins[-1] + 8 + length != head:
            raise ValueError(f"{path}: the index of documents is damaged")
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, int(self.begins[-1]) + 8)), INDEX)
        self.unpack, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            packed, size, check = self.frames[k].tolist()
            data = self.unpack.decompress(self.file.read_at(packed, int(self.begins[k])), max_output_size=size)
            if len(data) != size or crc32(data) != check:
                raise ValueError(f"frame {k}: wrong checksum")
            self.held = (k, data)
        return self.held[1]

    def ids(self, row: np.void) -> bytes:
        data = self.frame(int(row["frame"]))
        return data[int(row["at"]) : int(row["at"] + 4 * row["tokens"])]


class Encoder:
    """Ids of whole texts by the tokenizers library; ids of words seen before are kept in a bounded dictionary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.tokenizer = Tokenizer.from_file(path)
        special = byte_bpe.load(path)["special"]
        self.special, self.ids = byte_bpe.special_pattern(special), {k: struct.pack("<I", v) for k, v in special.items()}
        self.memo = Memo(self.learn, 1_100_000, 192 << 20)
        symbols = {b: c for c, b in byte_bpe.byte_symbols().items()}
        self.symbols, self.space = {b: symbols[b] for b in range(256)}, symbols[0x20]

    def pieces(self, words: list[str]) -> Iterator[bytes]:
        """Ids of pre-tokens in the model's byte symbols, by the library's model."""
        for a in range(0, len(words), 2000):
            found = list(map(self.tokenizer.model.tokenize, words[a : a + 2000]))
            ends = [0, *accumulate(map(len, found))]
            ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), "<u4", ends[-1]).tobytes()
            yield from (ids[4 * x : 4 * y] for x, y in pairwise(ends))

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. Letters behind a space are one pre-token: these go straight to the library's model in that
        model's byte symbols. Other chunks take the whole way through the library."""
        out = [b""] * len(chunks)
        plain = [c.isalpha() and not isinstance(c, byte_bpe.Inner) for c in chunks]
        at, others = [i for i, x in enumerate(plain) if x], [i for i, x in enumerate(plain) if not x]
        words = [self.space + (c if c.isascii() else c.encode().decode("latin-1").translate(self.symbols)) for c in map(chunks.__getitem__, at)]
        for i, ids in zip(at, self.pieces(words), strict=True):
            out[i] = ids
        found = self.tokenizer.encode_batch_fast([byte_bpe.spelled(chunks[i]) for i in others], add_special_tokens=False)
        for i, e in zip(others, found, strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of texts. Where single spaces end pre-tokens, each different word of all these texts is looked up once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        del split, coded
        keys = [w.rstrip(MARKS) for w in words]
        others = [i for i, k in enumerate(keys) if not k.isalpha()]
        for i in others:
            keys[i] = words[i]
        uneven = self.uneven(words, others, codes, counts)
        for m in self.ids:
            uneven |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        if uneven.any():
            used, codes = np.unique(codes[~np.repeat(uneven, counts)], return_inverse=True)
            words, keys, counts = [words[i] for i in used.tolist()], [keys[i] for i in used.tolist()], counts[~uneven]
        even = iter(self.joined(words, keys, codes, counts))
        rest = iter(self.sections(texts.filter(pa.array(uneven)).to_pylist()))
        return [next(rest if u else even) for u in uneven.tolist()]

    def uneven(self, words: list[str], others: list[int], codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether a text has white space beside a space or of a wide kind. Only the words numbered ``others`` may have some."""
        flags = np.zeros(len(words), np.uint8)  # 1: unless it is the first of its text, 2: unless the last, 4: anywhere
        for i in others:
            w = words[i]
            flags[i] = 4 * (not w or not w.isascii() and byte_bpe.OTHER_WIDE.search(w) is not None) + 2 * (w[-1:] in byte_bpe.OTHER_ASCII) + (w[:1] in byte_bpe.OTHER_ASCII)
        if not flags.any():
            return np.zeros(len(counts), bool)
        seen, ends = flags[codes], np.cumsum(counts)
        seen[ends - counts] &= 6
        seen[ends - 1] &= 5
        return np.logical_or.reduceat(seen != 0, ends - counts)

    def joined(self, words: list[str], keys: list[str], codes: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """Ids of texts of ``counts`` words each, given by their numbers in ``words``. ``keys`` are the words without
        the marks behind their letters: those are a pre-token of their own. No space stands before a text's first word."""
        tails = [w[len(k) :] if w is not k else "" for w, k in zip(words, keys, strict=True)]
        ends = np.cumsum(counts)
        first, place = np.unique(codes[ends - counts], return_inverse=True)
        heads, marks = [byte_bpe.Inner(words[i]) for i in first.tolist()], {t: byte_bpe.Inner(t) for t in set(tails) if t}
        known = self.memo.need([keys, heads, list(marks.values())])
        marks = {t: known[x] for t, x in marks.items()}
        ids = [known[k] + marks[t] if t else known[k] for k, t in zip(keys, tails, strict=True)] + [known[h] for h in heads]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        codes = codes.copy()
        codes[ends - counts] = len(words) + place
        del words, keys, tails, ids
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            yield b"".join(self.gathered(flat, begins, sizes, codes[x : min(x + STEP, b)]) for x in range(a, b, STEP))

    @staticmethod
    def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> bytes:
        """The pieces of ``flat`` that ``codes`` name, one after the other."""
        n = sizes[codes]
        ends = np.cumsum(n)
        return flat[np.repeat(begins[codes] - ends + n, n) + np.arange(ends[-1])].tobytes()

    def sections(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts, cut at special strings and then at pre-tokens."""
        found = [self.special.findall(t) if any(m in t for m in self.ids) else [] for t in texts]
        parts = [[byte_bpe.chunks(s) for s in self.special.split(t)] if f else byte_bpe.chunks(t) for t, f in zip(texts, found, strict=True)]
        known = self.memo.need([c for p, f in zip(parts, found, strict=True) for c in (p if f else [p])])
        get = known.__getitem__
        return [b"".join([b"".join(map(get, c)) + m for c, m in zip(p, [self.ids[x] for x in f] + [b""], strict=True)]) if f else b"".join(map(get, p)) for p, f in zip(parts, found, strict=True)]


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, within ``LOOKED_UP`` and ``LOOKED_UP_ROWS`` unless one of the given ones has more."""
    held: list[pa.RecordBatch] = []
    n_bytes = n_rows = 0
    for batch in batches:
        n_bytes, n_rows = n_bytes + batch.nbytes, n_rows + batch.num_rows
        if held and (n_bytes > LOOKED_UP or n_rows > LOOKED_UP_ROWS):
            yield pa.concat_batches(held)
            held, n_bytes, n_rows = [], batch.nbytes, batch.num_rows
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Writes shards of ``docs`` in ascending doc_id order (nulls first) to ``folder``.

    Returns the written table of shards: shard, part, seq (their order), n_docs, n_ids. Only the
    files in this table count: a task that ran twice may leave others.
    """
    path = public_tokenizers.path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, writer, seq, end = kept(Encoder, path), None, 0, struct.pack("<I", end_id)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            name, n_docs, n_ids = writer.close()
            return pa.RecordBatch.from_pydict({"shard": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

        for batch in larger(batches):
            for a, b in text_groups(batch.column(1), LOOKED_UP):
                ids = encoder.encode(pc.fill_null(batch.column(1).slice(a, b - a), ""))
                for doc_id, x in zip(batch.column(0).slice(a, b - a).to_pylist(), ids, strict=True):
                    writer = writer or ShardWriter(folder)
                    writer.add(doc_id, x + end)
                    if writer.total >= SHARD_BYTES or len(writer.docs) >= SHARD_DOCS:
                        yield closed()
                        writer, seq = None, seq + 1
        if writer:
            yield closed()

    spark = docs.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(rows.mapInArrow(run, "shard string, part int, seq int, n_docs bigint, n_ids bigint"), "shards")


def read_shards(shards: DataFrame, folder: str, schema: str, per_doc) -> DataFrame:
    """One row for each document of the listed shards; ``shards`` has ``shard`` and ``start``.

    ``per_doc(doc_ids, starts, ids)`` turns lists of a few documents into the columns of ``schema``.
    """

    def start():
        fs, top = file_system(folder)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(fs, f"{top}/{shard}")
                counts = reader.docs["tokens"].astype(np.int64)
                starts = first + np.cumsum(counts) - counts
                for a in range(0, len(reader.docs), 2000):
                    rows = reader.docs[a : a + 2000]
                    doc_ids = [None if x["null"] else int(x["doc_id"]) for x in rows]
                    yield per_doc(doc_ids, starts[a : a + 2000], [reader.ids(x) for x in rows])

        return work

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_texts(shards.repartition(n, "shard"), ["shard", "start"], schema, start)


def token_output(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` to shards below ``folder`` and reads them back.

    Returns doc_id, start (ids of all documents before), n_tokens (with the end id) and ids_crc32.
    Null texts are empty: their only id is ``end_id``. A null doc_id sorts first. Rows with equal
    doc_id stand next to each other, ordered by a hash of their text. An empty table gives no shards and no rows.
    """
    folder = folder or shared_dir(docs.sparkSession, "token-ids")
    shards = write_shards(docs, folder, vocabulary, end_id)
    # One small row for each shard; their running sum gives the first id of each.
    from pyspark.sql import Window

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("bigint"))

    def per_doc(doc_ids, starts, ids):
        return {"doc_id": pa.array(doc_ids, pa.int64()), "start": starts, "n_tokens": np.array([len(x) // 4 for x in ids], np.int64), "ids_crc32": np.array([crc32(x) for x in ids], np.int64)}

    return read_shards(shards.select("shard", "start"), folder, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", per_doc)
