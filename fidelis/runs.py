"""Whole evaluations from files to a report: each reads both sides by glob and returns one DataFrame.

They are compositions of the sources and operators, one for each evaluation that a user runs as a
command; nothing is printed. File schemas are those of ``sources.files``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import addresses as A
from .functions import bits as B
from .operators import distances as D
from .operators import flows as FL
from .operators import learned as L
from .operators import mitigation as MI
from .operators import sets as S
from .operators import topology as G
from .operators.tagged import tagged
from .sources import files, pcap

#: Names of address, port and protocol columns in flow files and in packet files (fixed values).
FLOW_COLUMNS = ["srcip", "dstip", "srcport", "dstport", "proto"]
PACKET_COLUMNS = ["Src IP", "Dst IP", "Src Port", "Dst Port", "Protocol"]
#: Packet fields whose distributions are compared (fixed values).
PROPERTIES = ["TTL", "IP ID", "IP Type of Service", "TCP Window Size", "TCP Data Offset", "Packet Size", "TCP Flags"]


def _sides(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Both sides' columns under plain names."""
    return tagged(real, synthetic, [f"`{c}`" for c in columns])


# --- fidelity and use ---------------------------------------------------------------------------


def fidelity(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """field, jsd, emd of each column and the row Overall with means."""
    both = _sides(real, synthetic, columns)
    by = D.jsd(both, columns).join(D.categorical_emd(both, columns), "field")
    return by.unionByName(by.agg(F.avg("jsd").alias("jsd"), F.avg("emd").alias("emd")).select(F.lit("Overall").alias("field"), "jsd", "emd"))


def fidelity_of_flows(spark: SparkSession, real: str, synthetic: str, columns: list[str] | None = None) -> DataFrame:
    return fidelity(files.csv(spark, real), files.csv(spark, synthetic), columns or FLOW_COLUMNS)


def fidelity_of_packets(spark: SparkSession, real: str, synthetic: str, columns: list[str] | None = None, n: int = 200) -> DataFrame:
    """The same of the first ``n`` packets of each file, by time."""
    first = lambda glob: files.head_per_file(files.csv(spark, glob, files.PACKETS), ["Timestamp", *map(lambda c: f"`{c}`", PACKET_COLUMNS)], n)
    return fidelity(first(real), first(synthetic), columns or PACKET_COLUMNS)


def downstream_of_flow_statistics(spark: SparkSession, train: str, synthetic: str, test: str, labels: DataFrame, model: str = "random_forest") -> DataFrame:
    """Accuracy of models trained on real and on synthetic flow statistics: one row a file, labelled by its name."""
    tables = [files.labelled(files.csv(spark, glob), labels) for glob in (train, synthetic, test)]
    names = [c for c in files.shared_columns(tables[0], tables[1]) if c in tables[2].columns and c not in ("file", "label")]
    plain = [t.select("label", *[F.col(f"`{c}`").cast("double").alias(c.replace(" ", "_").lower()) for c in names]) for t in tables]
    numbers = [c for c in plain[0].columns if c != "label"]
    return L.downstream(*plain, numbers, [], "label", model)


# --- identifiers --------------------------------------------------------------------------------


def identifiers_of_flows(spark: SparkSession, real: str, synthetic: str, numbers: bool = True) -> DataFrame:
    """Overlap of source and destination addresses, which files give as numbers or as text."""
    text = lambda c: A.int_to_ip(F.col(c).cast("bigint")) if numbers else F.col(c).cast("string")
    read = lambda glob: files.csv(spark, glob).select(*[text(c).alias(c) for c in FLOW_COLUMNS[:2]])
    return S.identifier_overlap(tagged(read(real), read(synthetic), FLOW_COLUMNS[:2]), FLOW_COLUMNS[:2])


def identifiers_of_packets(spark: SparkSession, real: str, synthetic: str, real_flows: str | None = None, synthetic_flows: str | None = None) -> DataFrame:
    """Overlap of IP addresses in packet files and, if both sides have flow files, of their MAC addresses."""
    out = S.identifier_overlap(_sides(files.csv(spark, real, files.PACKETS), files.csv(spark, synthetic, files.PACKETS), PACKET_COLUMNS[:2]), PACKET_COLUMNS[:2])
    if real_flows and synthetic_flows:
        macs = ["MAC Src", "MAC Dst"]
        out = out.unionByName(S.identifier_overlap(_sides(files.csv(spark, real_flows), files.csv(spark, synthetic_flows), macs), macs))
    return out


def identifiers_of_texts(spark: SparkSession, real: str, synthetic: str) -> DataFrame:
    """Overlap of IP and MAC addresses in generated packet texts with those of instruction files."""
    parts = []
    for field, of in [("src", files.header_values), ("dst", files.header_values), ("src", files.mac_values), ("dst", files.mac_values)]:
        name = f"{'ip' if of is files.header_values else 'mac'}_{field}"
        sides = [of(rows, field).withColumnRenamed("value", name) for rows in (files.instruction_outputs(spark, real), files.generated_lines(spark, synthetic))]
        parts.append(S.identifier_overlap(tagged(*sides, [name]), [name]))
    return reduce(DataFrame.unionByName, parts)


# --- topology -----------------------------------------------------------------------------------


def topology(real: DataFrame, synthetic: DataFrame, keys: list[str], weight: str, top_n: int = 100, top_k: int = 10) -> DataFrame:
    """``topology.compare`` of the graphs of both sides' ``top_n`` heaviest flows; the first two keys are the ends."""
    plain = lambda df: df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], F.col(f"`{weight}`").alias("w"))
    edges = [G.edges_of(G.top_flows(plain(df), [f"k{i}" for i in range(len(keys))], "w", top_n), "k0", "k1") for df in (real, synthetic)]
    return G.compare(*edges, top_k)


def topology_of_packets(spark: SparkSession, real: str, synthetic: str, top_n: int = 100, top_k: int = 10) -> DataFrame:
    return topology(files.csv(spark, real), files.csv(spark, synthetic), FLOW_COLUMNS, "pkt_len", top_n, top_k)


def topology_of_flows(spark: SparkSession, real: str, synthetic: str, top_n: int = 100, top_k: int = 10) -> DataFrame:
    return topology(files.csv(spark, real, files.FLOWS), files.csv(spark, synthetic, files.FLOWS), ["Src IP", "Dst IP"], "Total Bytes", top_n, top_k)


# --- sensitive properties -----------------------------------------------------------------------


def properties(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """field, emd_of_range of numerical columns; a field that a side lacks has no row."""
    rows = D.wasserstein(_sides(real, synthetic, columns), columns).where("emd_of_range is not null")
    return rows.select("field", "emd_of_range")


def property_of_flows(spark: SparkSession, real: str, synthetic: str, column: str) -> DataFrame:
    return properties(files.csv(spark, real), files.csv(spark, synthetic), [column])


def properties_of_packets(spark: SparkSession, real: str, synthetic: str, real_flows: str | None = None, synthetic_flows: str | None = None) -> DataFrame:
    """Packet fields, TCP flags as masks, and the bytes of flows where both sides have flow files."""
    from .functions.packets import tcp_flags_mask

    read = lambda glob: files.csv(spark, glob, files.PACKETS).withColumn("TCP Flags", tcp_flags_mask(F.col("TCP Flags")))
    out = properties(read(real), read(synthetic), PROPERTIES)
    if real_flows and synthetic_flows:
        out = out.unionByName(properties(files.csv(spark, real_flows, files.FLOWS), files.csv(spark, synthetic_flows, files.FLOWS), ["Total Bytes"]))
    return out


def property_of_bits(spark: SparkSession, real: str, synthetic: str, prefix: str) -> DataFrame:
    """A header field of bit files as a number."""
    read = lambda glob: files.bit_rows(spark, glob, [prefix]).select(B.bits_to_int(F.col(prefix)).alias(prefix))
    return properties(read(real), read(synthetic), [prefix])


def features_of_captures(spark: SparkSession, folder: str, out: str, overwrite: bool = False) -> None:
    """Packets and flows of captures as Parquet below ``out``; existing results stay unless ``overwrite``."""
    packets = pcap.read(spark, folder)
    files.write_report(packets.drop("header", "payload"), f"{out}/packets", overwrite)
    files.write_report(pcap.flows(packets), f"{out}/flows", overwrite)


# --- extraction ---------------------------------------------------------------------------------


def _extraction(real: DataFrame, synthetic: DataFrame, name: str) -> DataFrame:
    sides = [df.withColumnRenamed("value", name) for df in (real, synthetic)]
    return S.extraction_scores(tagged(*sides, [name]), [name])


def extraction_of_bytes(spark: SparkSession, real: str, synthetic: str, first: int, last: int) -> DataFrame:
    """Precision and recall of byte ranges of packets in generated byte sequences."""
    values = lambda rows: files.byte_values(rows, first, last)
    return _extraction(values(files.byte_sequences(spark, real)), values(files.generated_lines(spark, synthetic)), f"bytes_{first}_{last}")


def extraction_of_addresses(spark: SparkSession, real: str, synthetic: str, field: str = "src") -> DataFrame:
    values = lambda rows: files.ip_values(rows, field)
    return _extraction(values(files.instruction_outputs(spark, real)), values(files.generated_lines(spark, synthetic)), f"{field}_ip")


def extraction_of_fingerprints(spark: SparkSession, real: str, synthetic: str, prefix: str) -> DataFrame:
    """The same of the fingerprints of a header field's bits, rows whose bits are all missing left out."""
    read = lambda glob: files.bit_rows(spark, glob, [prefix]).where(F.exists(prefix, lambda b: b >= 0)).select(B.fingerprint(F.col(prefix)).alias("value"))
    return _extraction(read(real), read(synthetic), prefix)


# --- mitigation ---------------------------------------------------------------------------------


def one_identity(packets: DataFrame, ip: str = "0.0.0.0", mac: str = "00:00:00:00:00:00") -> DataFrame:
    return MI.one_identity(packets, {"src_ip": ip, "dst_ip": ip, "src_mac": mac, "dst_mac": mac})


def coarse_identities(packets: DataFrame) -> DataFrame:
    return MI.coarsen(packets, ["src_ip", "dst_ip"], ["src_mac", "dst_mac"])


def masked_identities(packets: DataFrame, key: str) -> DataFrame:
    return MI.pseudonymize(packets, ["src_ip", "dst_ip"], ["src_mac", "dst_mac"], key)


def frequencies_of_captures(spark: SparkSession, folder: str) -> DataFrame:
    """kind (ip or mac), address, frequency of all packets."""
    packets = pcap.read(spark, folder)
    each = [G.address_frequency(packets, f"src_{k}", f"dst_{k}").select(F.lit(k).alias("kind"), "*") for k in ("ip", "mac")]
    return each[0].unionByName(each[1])


# --- membership ---------------------------------------------------------------------------------


def membership_features(spark: SparkSession, glob: str) -> DataFrame:
    """Statistical features of each synthetic flow file with its label, the start of its folder's name. Rows with a null are left out."""
    rows = files.csv(spark, glob).dropna()
    out = FL.flow_features(rows, ["file"], "time", ["time"], FLOW_COLUMNS[:4], ["pkt_len", "tos", "ttl"], "proto", ["TCP", "UDP", "ICMP"])
    folder = F.element_at(F.split("file", "/"), -2)
    return out.withColumn("Label", F.substring_index(folder, "_", 1))

