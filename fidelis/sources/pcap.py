"""Classic pcap files: a Spark data source whose tasks read file by file, and a sink.

A reader is a stream over records, so a task holds few packets at a time. A file can't be split, as
records have no marks; the sink can cut a capture into a folder of parts, each a capture of its own,
which the reader takes for one file again.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "file string, packet bigint, time_us bigint, captured int, length int, src_mac string, dst_mac string, src_ip string, dst_ip string, protocol string, src_port int, dst_port int, "
    "version int, ihl int, tos int, total_length int, ip_id int, flag int, frag_offset int, ttl int, checksum int, seq bigint, ack bigint, data_offset int, tcp_flags int, window int, header binary, payload binary"
)
#: Byte order and time unit by the first four bytes (fixed values of the format).
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
FIELDS = [x.strip().split()[0] for x in SCHEMA.split(",")]


def decode(data: bytes, link: int) -> dict | None:
    """Fields of an IPv4 packet in an Ethernet (perhaps with one VLAN tag) or raw frame; None for anything else."""
    out: dict = {}
    if link == 1:
        if len(data) < 14:
            return None
        out["dst_mac"], out["src_mac"] = data[0:6].hex(":"), data[6:12].hex(":")
        kind, at = struct.unpack("!H", data[12:14])[0], 14
        if kind == 0x8100 and len(data) >= 18:
            kind, at = struct.unpack("!H", data[16:18])[0], 18
        if kind != 0x0800:
            return None
    elif link in (12, 101):
        at = 0
    else:
        return None
    if len(data) < at + 20 or data[at] >> 4 != 4:
        return None
    first, tos, total, ip_id, off, ttl, proto, check = struct.unpack("!BBHHHBBH", data[at : at + 12])
    ihl = first & 15
    out |= {"version": 4, "ihl": ihl, "tos": tos, "total_length": total, "ip_id": ip_id, "flag": off >> 13, "frag_offset": off & 0x1FFF, "ttl": ttl, "checksum": check}
    out |= {"src_ip": ".".join(map(str, data[at + 12 : at + 16])), "dst_ip": ".".join(map(str, data[at + 16 : at + 20]))}
    up = at + 4 * ihl
    out["protocol"] = {1: "ICMP", 6: "TCP", 17: "UDP"}.get(proto, str(proto))
    end = up
    if proto == 6 and len(data) >= up + 20:
        sport, dport, seq, ack, offset, flags, window = struct.unpack("!HHIIBBH", data[up : up + 16])
        out |= {"src_port": sport, "dst_port": dport, "seq": seq, "ack": ack, "data_offset": offset >> 4, "tcp_flags": flags | (offset & 1) << 8, "window": window}
        end = up + 4 * (offset >> 4)
    elif proto == 17 and len(data) >= up + 8:
        out["src_port"], out["dst_port"] = struct.unpack("!HH", data[up : up + 4])
        end = up + 8
    out["header"], out["payload"] = bytes(data[:end]), bytes(data[end:])
    return out


def records(stream) -> Iterator[tuple[int, int, bytes, int]]:
    """(time in microseconds, original length, data, link type) of each record; a record that is cut off ends it."""
    head = stream.read(24)
    if len(head) < 24 or head[:4] not in MAGICS:
        return
    order, unit = MAGICS[head[:4]]
    link = struct.unpack(f"{order}I", head[20:24])[0] & 0xFFFF
    while len(own := stream.read(16)) == 16:
        seconds, part, captured, length = struct.unpack(f"{order}IIII", own)
        data = stream.read(captured)
        if len(data) < captured:
            return
        yield seconds * 1_000_000 + part // unit, length, data, link


#: Rows in one batch of the reader.
BATCH = 2000


class _Part(InputPartition):
    def __init__(self, path: str, file: str, first: int):
        self.path, self.file, self.first = path, file, first


def _parts(paths: list[str]) -> list[_Part]:
    """Paths with the capture that they belong to and the number of their first packet, which the parts' names tell: <part>-<packets>.pcap in a folder <name>.pcap."""
    out, seen = [], {}
    for path in sorted(paths):
        folder, _, name = path.rpartition("/")
        if folder.endswith(".pcap") and (found := re.fullmatch(r"\d{8}-(\d+)\.pcap", name)):
            out.append(_Part(path, folder, seen.get(folder, 0)))
            seen[folder] = seen.get(folder, 0) + int(found[1])
        else:
            out.append(_Part(path, path, 0))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")

    def _selector(self):
        from pyarrow import fs

        at, _, pattern = self.path.partition("*")
        system, top = fs.FileSystem.from_uri(at if "://" in at else f"file://{at}")
        return fs, system, top.rstrip("/") if not pattern else top.rsplit("/", 1)[0]

    def partitions(self):
        import fnmatch

        fs, system, top = self._selector()
        info = system.get_file_info(top)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
        name = self.path.split("://", 1)[-1].rsplit("/", 1)[-1]
        wanted = name if "*" in name else "*.pcap"
        parts = _parts([f.path for f in files if f.type == fs.FileType.File and (f.size or 0) > 24])
        return [p for p in parts if info.type == fs.FileType.File or fnmatch.fnmatch(p.file.rsplit("/", 1)[-1], wanted)]

    def read(self, partition):
        import pyarrow as pa

        _, system, _ = self._selector()
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        schema, rows = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(","))]), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        with system.open_input_stream(partition.path) as stream:
            for n, (time, length, data, link) in enumerate(records(stream), partition.first):
                if (row := decode(data, link)) is not None:
                    row |= {"file": partition.file, "packet": n, "time_us": time, "captured": len(data), "length": length}
                    rows.append([row.get(f) for f in FIELDS])
                    if len(rows) == BATCH:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()


class PcapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    """IPv4 packets of a file, of a folder (recursively) or of a pattern; other frames are left out."""
    spark.dataSource.register(PcapDataSource)
    return spark.read.format("pcap").load(path)


def flows(packets: DataFrame) -> DataFrame:
    """Directional five-tuple flows of TCP and UDP with their packets and bytes."""
    return packets.where(F.col("protocol").isin("TCP", "UDP")).groupBy("file", "src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(F.count(F.lit(1)).alias("total_packets"), F.sum("length").cast("bigint").alias("total_bytes"))


def identifiers(packets: DataFrame) -> DataFrame:
    """Addresses of TCP and UDP packets; a missing MAC is N/A."""
    return packets.where(F.col("protocol").isin("TCP", "UDP")).select("src_ip", "dst_ip", *[F.coalesce(c, F.lit("N/A")).alias(c) for c in ("src_mac", "dst_mac")])


def byte_tokens(packets: DataFrame, width: int = 128) -> DataFrame:
    """file, text: each file's packets as ``width`` decimal bytes each, joined by the packet mark. Files with one packet or none are left out.

    A file is one sequence in one row, as the format asks for; ``byte_parts`` gives those of large files in pieces.
    """
    packed = byte_parts(packets, width).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p"), F.sum("packets").alias("n")).where("n > 1")
    return packed.select("file", F.array_join(F.transform("p", lambda x: x["text"]), " <|pkt|> ").alias("text"))


def byte_parts(packets: DataFrame, width: int = 128, size: int = 4096) -> DataFrame:
    """file, part, packets, text: the pieces of each file's sequence, which the packet mark joins in the order of ``part``.

    TCP packets give their headers, UDP ones their headers and 12 bytes of payload (the payload but its
    last byte if it is shorter). A piece has the packets of ``size`` places in its file, so no file's
    packets meet in one task.
    """
    from ..functions.packets import bytes_to_tokens

    tail = F.when(F.length("payload") >= 12, F.substring("payload", 1, 12)).when(F.length("payload") > 0, F.expr("substring(payload, 1, length(payload) - 1)")).otherwise(F.lit(b""))
    kept = F.when(F.col("protocol") == "UDP", F.concat("header", tail)).otherwise(F.col("header"))
    padded = F.substring(F.concat(kept, F.lit(bytes(width))), 1, width)
    rows = packets.where(F.col("protocol").isin("TCP", "UDP")).select("file", "packet", bytes_to_tokens(padded).alias("tokens"))
    packed = rows.groupBy("file", F.expr(f"packet div {size}").alias("part")).agg(F.sort_array(F.collect_list(F.struct("packet", "tokens"))).alias("p"))
    return packed.select("file", "part", F.size("p").cast("bigint").alias("packets"), F.array_join(F.transform("p", lambda x: x["tokens"]), " <|pkt|> ").alias("text"))


def flow_hex(packets: DataFrame, n: int = 10, digits: int = 256) -> DataFrame:
    """file, text: the first packets of each file in hexadecimal, cut to ``digits``, joined by <pck>."""
    from ..operators.flows import head_per_flow

    first = head_per_flow(packets, ["file"], ["packet"], n)
    text = F.substring(F.lower(F.hex(F.concat("header", "payload"))), 1, digits)
    return first.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("packet", text.alias("x")))).alias("p")).select("file", F.array_join(F.transform("p", lambda x: x["x"]), "<pck>").alias("text"))


def write(packets: DataFrame, folder: str, file: str, order: list[str], data: str, time_us: str, link: int = 1, cut: bool = False) -> DataFrame:
    """Writes one pcap per value of ``file`` to a shared folder; returns (path, packets) as the tasks report them.

    Rows are grouped by file through a shuffle and sorted in it; a task streams them to disk. With
    ``cut`` rows are dealt by ranges of file and order, so that many tasks write a large capture, each
    a part in a folder with the capture's name.
    """
    rows = packets.select(F.col(file).alias("file"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(time_us).alias("t"), F.col(data).alias("d"))
    keys = ["file", *[f"o{i}" for i in range(len(order))]]
    rows = (rows.repartitionByRange(*keys) if cut else rows.repartition("file")).sortWithinPartitions(*keys)

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(top, recursive=True)
        state: dict = {}

        def close():
            state["out"].close()
            system.move(state["temp"], f"{state['path']}/{TaskContext.get().partitionId():08d}-{state['n']}.pcap" if cut else state["path"])
            return pa.RecordBatch.from_pydict({"path": [state["path"]], "packets": pa.array([state["n"]], pa.int64())})

        for batch in batches:
            for name, t, d in zip(batch.column("file").to_pylist(), batch.column("t").to_pylist(), batch.column("d").to_pylist(), strict=True):
                if state.get("name") != name:
                    if state:
                        yield close()
                    path = f"{top}/{str(name).replace('/', '_')}.pcap"
                    if cut:
                        system.create_dir(path, recursive=True)
                    state = {"name": name, "path": path, "temp": f"{path}/{uuid.uuid4().hex}" if cut else f"{path}.{uuid.uuid4().hex}", "n": 0}
                    state["out"] = system.open_output_stream(state["temp"])
                    state["out"].write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link))
                if d is not None:
                    state["out"].write(struct.pack("<IIII", (t or 0) // 1_000_000, (t or 0) % 1_000_000, len(d), len(d)) + bytes(d))
                    state["n"] += 1
        if state:
            yield close()

    out = rows.mapInArrow(run, "path string, packets bigint")
    return out.groupBy("path").agg(F.sum("packets").alias("packets")) if cut else out
