"""Expressions over packet text: hexadecimal payloads, header dictionaries, byte tokens, TCP flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import let

PACKET = "<|pkt|>"
#: Bit of each TCP flag letter (fixed values).
FLAGS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "E": 64, "C": 128, "N": 256}
#: Byte offsets and lengths behind an Ethernet and IPv4 header (fixed values).
ETHERNET_IPV4 = {"dst_mac": (0, 6), "src_mac": (6, 6), "tos": (15, 1), "total_length": (16, 2), "ip_id": (18, 2), "ttl": (22, 1), "protocol": (23, 1), "src_ip": (26, 4), "dst_ip": (30, 4)}
#: The same behind the start of the TCP header.
TCP = {"src_port": (0, 2), "dst_port": (2, 2), "seq": (4, 4), "ack": (8, 4), "flags": (13, 1), "window": (14, 2)}


def tcp_flags_mask(letters: Column) -> Column:
    """Bit mask of flag letters; null and "0" are 0, unknown letters count nothing, repeated ones add up."""
    known = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    return F.coalesce(F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: a + F.coalesce(known[c], F.lit(0))), F.lit(0))


def clean_hex(text: Column) -> Column:
    """Only the hexadecimal digits, lower case, without an odd one at the end."""
    digits = F.lower(F.regexp_replace(text, "[^0-9a-fA-F]", ""))
    return F.substring(digits, F.lit(1), F.length(digits) - F.length(digits) % 2)


def hex_bytes(text: Column) -> Column:
    return F.unhex(clean_hex(text))


def hex_number(digits: Column, first: Column | int, length: int) -> Column:
    """Number in ``length`` bytes from byte ``first`` on; null where the string ends before."""
    begin = (F.lit(first) if isinstance(first, int) else first) * 2
    return F.when(F.length(digits) >= begin + 2 * length, F.conv(F.substring(digits, begin + 1, F.lit(2 * length)), 16, 10).cast("bigint"))


def header_field(packet_hex: Column, field: str) -> Column:
    """A header field of a packet given as hexadecimal text: Ethernet and IPv4 fields, or TCP ones.

    MAC addresses come in Ethernet's order, destination first.
    """
    digits = clean_hex(packet_hex)
    if field in ETHERNET_IPV4:
        return hex_number(digits, *ETHERNET_IPV4[field])
    if field not in TCP:
        raise ValueError(f"unknown header field {field!r}")
    start = 14 + 4 * hex_number(digits, 14, 1).bitwiseAND(15)
    return hex_number(digits, start + TCP[field][0], TCP[field][1])


def mac_from_payload(text: Column, which: str) -> Column:
    """MAC address "src" or "dst" of the payload behind the first closing brace; null below 12 bytes."""
    brace = F.locate("}", text)
    digits = clean_hex(F.when(brace > 0, F.substring(text, brace + 1, F.length(text))).otherwise(text))
    first = {"dst": 0, "src": 6}[which]
    parts = [F.substring(digits, 1 + 2 * (first + k), 2) for k in range(6)]
    return F.when(F.length(digits) >= 24, F.concat_ws(":", *parts))


def header_text(text: Column) -> Column:
    """From the first opening to the first closing brace; null without them."""
    found = F.regexp_extract(text, r"(\{[^}]*\})", 1)
    return F.when(found != "", found)


def header_value(text: Column, field: str) -> Column:
    """A value of the header dictionary that is written with single quotes; null where it can't be read."""
    return F.get_json_object(F.regexp_replace(header_text(text), "'", '"'), f"$.{field}")


def ip_value(text: Column, field: str) -> Column:
    """What stands in quotes behind the last occurrence of ``'field': ``."""
    parts = F.split(text, f"'{field}': ")
    return F.when(F.size(parts) > 1, F.get(F.split(F.element_at(parts, -1), "'"), F.lit(1)))


def packets_of(sequence: Column) -> Column:
    """Packets of a delimited sequence, trimmed."""
    return F.transform(F.split(sequence, r"<\|pkt\|>"), lambda x: F.trim(x))


def byte_slice(packet: Column, first: int, last: int, labelled: bool = False) -> Column:
    """Bytes first to last - 1 of space-separated ones; a labelled packet has its label before them."""
    return F.array_join(F.slice(F.split(packet, " "), first + labelled + 1, last - first), " ")


def packet_prefix(sequence: Column, packets: int) -> Column:
    """The first packets of a sequence; shorter sequences stay as they are."""
    return F.substring_index(sequence, PACKET, packets)


def truncate_tokens(text: Column, tokens: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, tokens), " ")


def bytes_to_tokens(data: Column) -> Column:
    """Bytes as space-separated decimal numbers."""
    at = lambda digits: F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2))
    numbers = let(F.hex(data), lambda digits: F.array_join(F.transform(at(digits), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10)), " "))
    return F.when(F.length(data) > 0, numbers).otherwise("")


def fit_length(values: Column, length: int) -> Column:
    """Cut or padded with zeros to ``length``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), length)), 1, length)


def tag_sequence(sequence: Column, label: Column) -> Column:
    return F.concat(F.lit("<|"), label, F.lit("|> "), sequence)


def checksum(words: Column) -> Column:
    """One's-complement checksum of 16-bit words (the checksum word itself as 0)."""
    folded = lambda x: x.bitwiseAND(65535) + F.shiftright(x, 16)
    total = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + w)
    return F.lit(65535) - let(let(total, folded), folded)


def ipv4_checksum(header_hex: Column) -> Column:
    """Checksum of an IPv4 header of 20 bytes or more given as hexadecimal text."""
    return let(clean_hex(header_hex), _checksum_of_digits)


def _checksum_of_digits(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(digits) - 3, F.lit(1)), F.lit(4))
    return checksum(F.transform(at, lambda i: F.when(i == 21, F.lit(0)).otherwise(F.conv(F.substring(digits, i, F.lit(4)), 16, 10)).cast("bigint")))


def number_bytes(number: Column, length: int) -> Column:
    """A number as hexadecimal digits of ``length`` bytes."""
    return F.lower(F.lpad(F.hex(number.cast("bigint")), 2 * length, "0"))


def ip_bytes(ip: Column) -> Column:
    return F.array_join(F.transform(F.split(ip, r"\."), lambda o: number_bytes(o, 1)), "")


def header_bytes(src: Column, dst: Column, proto: Column, sport: Column, dport: Column, payload_bytes: Column) -> Column:
    """Hexadecimal Ethernet, IPv4 and TCP or UDP header for a generated packet.

    Addresses of the link are zero; the IP length is 16 more than the payload, its checksum right, that
    of TCP and UDP zero. Anything but TCP and UDP ends behind the IP header.
    """
    number = F.when(F.upper(proto) == "TCP", 6).when(F.upper(proto) == "UDP", 17).otherwise(0)
    blank = F.concat(F.lit("4500"), number_bytes(payload_bytes + 16, 2), F.lit("0001000040"), number_bytes(number, 1), F.lit("0000"), ip_bytes(src), ip_bytes(dst))
    checked = let(blank, lambda h: F.concat(F.substring(h, 1, 20), number_bytes(_checksum_of_digits(h), 2), F.substring(h, 25, 16)))
    ports = F.concat(number_bytes(sport, 2), number_bytes(dport, 2))
    up = F.when(number == 6, F.concat(ports, F.lit("0" * 16 + "5002200000000000"))).when(number == 17, F.concat(ports, number_bytes(payload_bytes + 8, 2), F.lit("0000"))).otherwise("")
    return F.concat(F.lit("0" * 24 + "0800"), checked, up)


def flow_key_text(src: Column, dst: Column, sport: Column, dport: Column, proto: Column) -> Column:
    """A packet's five-tuple as text, the header part of generated packets."""
    part = lambda name, c: F.concat(F.lit(f"'{name}': '"), F.coalesce(c.cast("string"), F.lit("")), F.lit("'"))
    return F.concat(F.lit("{"), F.concat_ws(", ", part("src", src), part("dst", dst), part("proto", proto), part("sport", sport), part("dport", dport)), F.lit("}"))


def packet_text(mode: str, tuple_text: Column, packet: Column) -> Column:
    """A packet for a text model: its five-tuple ("tuple"), its bytes in hexadecimal ("hex"), or both ("tuple_hex")."""
    digits = F.lower(F.hex(packet))
    if mode not in ("tuple", "hex", "tuple_hex"):
        raise ValueError(f"unknown mode {mode!r}")
    return {"tuple": tuple_text, "hex": digits, "tuple_hex": F.concat_ws(" ", tuple_text, digits)}[mode]
