"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as a grey-scale image of 64 columns with 8-bit samples (PNG, filter 0).
Tar members are named by the payload's SHA-256; rows carry digest, shard, offset and length, so a
range read gets one member without the rest of its shard. Each writing task stores a payload once;
where several tasks stored the same one, the smallest (shard, offset) is the address of all rows.
Metadata columns (width, height, bit depth) come from range reads of the first 33 bytes only.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, file_system, map_texts, prepare, shared_dir, strings, text_groups, written

WIDTH, SHARD_BYTES, HEADER = 64, 128 << 20, 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    """UTF-8 bytes and zeros up to a positive multiple of 64."""
    data = text.encode("utf-8", "replace")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc32(kind + data))


def image_of(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row behind its filter byte 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def header_of(first: bytes) -> dict:
    """Width, height and bit depth from the first bytes of an image."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or struct.unpack(">I", first[29:33])[0] != crc32(first[12:29]):
        raise ValueError("no image header")
    width, height, depth = struct.unpack(">IIB", first[16:25])
    return {"width": width, "height": height, "depth": depth}


def samples_of(image: bytes) -> np.ndarray:
    """Decodes an image that ``image_of`` made; wrong checksums are errors."""
    info, at, data = header_of(image[:HEADER]), 8, b""
    while at < len(image):
        size = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != crc32(kind + body):
            raise ValueError("wrong checksum in an image")
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(info["height"], info["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0 is read")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples and mean difference of neighbours, all from stored bytes."""
    flat = samples.reshape(-1)
    count = np.bincount(flat, minlength=256)
    share = count[count > 0] / len(flat)
    mean = float((count * np.arange(256)).sum() / len(flat))
    dev = float(np.sqrt((count * (np.arange(256) - mean) ** 2).sum() / len(flat)))
    step = float(np.abs(np.diff(flat.astype(np.int16))).mean()) if len(flat) > 1 else 0.0
    return f"mean={mean:.3f} dev={dev:.3f} bits={-(share * np.log2(share)).sum() + 0.0:.3f} step={step:.3f}"


class TarShard:
    """Appends members to one tar file in the shared folder and knows where each begins."""

    def __init__(self, folder: str):
        self.fs, top = file_system(folder)
        self.fs.create_dir(top, recursive=True)
        self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
        self.path = f"{top}/{self.name}"
        self.out = self.fs.open_output_stream(f"{self.path}.part")

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        begin = self.at + len(head)
        self.at = begin + len(data) + -len(data) % 512
        return begin

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes payloads to tar shards: doc_id, n_bytes, digest, shard, offset, length of every row, as a written table.

    Only shards in this table count; a task that ran twice may leave others.
    """

    def start():
        state: dict = {"shard": None, "known": {}}

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            rows: list[tuple] = []
            for a, b in text_groups(batch.column(1)):
                for text in strings(batch.column(1).slice(a, b - a)):
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in state["known"]:
                        shard = state["shard"] = state["shard"] or TarShard(folder)
                        image = image_of(payload)
                        state["known"][digest] = (shard.name, shard.add(f"{digest}.png", image), len(image))
                    rows.append((len(text.encode("utf-8", "replace")), digest, *state["known"][digest]))
                    if state["shard"] and state["shard"].at >= SHARD_BYTES:
                        state["shard"].close()
                        state["shard"] = None
                        state["known"].clear()
            names = ("n_bytes", "digest", "shard", "offset", "length")
            yield {"doc_id": batch.column(0)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True) if rows else ((n, []) for n in names))

        return work, lambda: state["shard"] and state["shard"].close()

    prepare(docs.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, close = start()
        for batch in batches:
            for out in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if isinstance(out[f.name], list) else out[f.name] for f in types], schema=types)
        close()

    return written(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema), "media-rows")


def addresses(rows: DataFrame) -> DataFrame:
    """One address for each digest: shard, offset, length."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def read_headers(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, depth by range reads of each member's first bytes."""
    return _ranges(places, folder, "digest string, width bigint, height bigint, depth bigint", HEADER, lambda digests, heads: {"digest": digests} | {k: np.array([header_of(h)[k] for h in heads], np.int64) for k in ("width", "height", "depth")})


def read_payloads(places: DataFrame, folder: str) -> DataFrame:
    """digest, payload of every address, by range reads."""
    return _ranges(places, folder, "digest string, payload binary", None, lambda digests, images: {"digest": digests, "payload": pa.array([samples_of(x).tobytes() for x in images], pa.binary())})


#: Bytes and members that a task reads and holds at once; one longer member is read by itself.
READ_BYTES, READ_ROWS = 8 << 20, 200


def groups_of(sizes: np.ndarray, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have ``most_bytes`` together at most, or are one row."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (total + n > most_bytes or i - begin >= most_rows):
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _ranges(places: DataFrame, folder: str, schema: str, first: int | None, columns) -> DataFrame:
    def start():
        fs, top = file_system(folder)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            held: tuple = ("", None)
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            sizes = np.array([min(first or r[3], r[3]) for r in rows], np.int64)
            for a, b in groups_of(sizes, READ_BYTES, READ_ROWS):
                data = []
                for (_, shard, offset, _), size in zip(rows[a:b], sizes[a:b].tolist(), strict=True):
                    if held[0] != shard:
                        held = (shard, fs.open_input_file(f"{top}/{shard}"))
                    data.append(held[1].read_at(size, offset))
                yield columns(pa.array([r[0] for r in rows[a:b]], pa.string()), data)

        return work

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = places.repartition(n, "shard", F.expr("offset div 8388608")).sortWithinPartitions("shard", "offset")
    return map_texts(spread, ["digest", "shard", "offset", "length"], schema, start)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the texts of ``docs`` as media and describes what is read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, and the columns of a media table: digest, shard, offset, length (the address), width,
    height, depth (from header-only range reads). Digests and features come from reads of whole
    members. Null and empty texts are 64 zero bytes. Equal texts share one payload and have equal
    values; every row comes back once, null doc_ids included; an empty table gives no rows.
    """
    folder = folder or shared_dir(docs.sparkSession, "media")
    rows = store(docs, folder)
    places = written(addresses(rows), "media-places")

    def columns(digests, images):
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for image in images:
            samples = samples_of(image)
            payload = samples.tobytes()
            for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples)), strict=True):
                out[k].append(v)
        kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
        return {"digest": digests} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}

    read = _ranges(places, folder, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", None, columns)
    media = read.join(read_headers(places, folder), "digest").join(places, "digest")
    media = media.withColumn("feature", F.format_string("%dx%d@%d %s", "width", "height", "depth", "feature"))
    found = rows.select("doc_id", "n_bytes", "digest").join(media, "digest")  # a frequent digest is a skewed join, which Spark splits
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "depth")
