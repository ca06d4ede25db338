"""Expressions over IPv4 and MAC addresses, protocols and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IP protocol numbers (fixed values).
PROTOCOLS = {"ICMP": 1, "TCP": 6, "UDP": 17}


def int_to_ip(number: Column) -> Column:
    """Unsigned 32-bit number as a dotted quad; null and numbers outside the range give null."""
    octets = [F.shiftrightunsigned(number.cast("bigint"), s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.when(number.between(0, 4294967295), F.concat_ws(".", *octets))


def _octets(ip: Column) -> Column:
    return F.split(ip, r"\.")


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")


def ip_to_int(ip: Column) -> Column:
    """Dotted quad as a number; anything else gives null."""
    return F.when(is_ipv4(ip), F.aggregate(_octets(ip), F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.cast("bigint")))


def ip_to_bits(ip: Column) -> Column:
    """Dotted quad as 32 characters 0 and 1."""
    return F.when(is_ipv4(ip), F.array_join(F.transform(_octets(ip), lambda o: F.lpad(F.conv(o, 10, 2), 8, "0")), ""))


def bits_to_ip(bits: Column) -> Column:
    """Inverse of ``ip_to_bits``; strings that aren't 32 bits give null."""
    return F.when(bits.rlike("^[01]{32}$"), F.concat_ws(".", *[F.conv(F.substring(bits, 1 + 8 * k, 8), 2, 10) for k in range(4)]))


def mask_subnet(ip: Column) -> Column:
    """Keeps the first two of four parts and zeroes the rest; other strings stay as they are."""
    parts = _octets(ip)
    return F.when(F.size(parts) == 4, F.concat(parts[0], F.lit("."), parts[1], F.lit(".0.0"))).otherwise(ip)


def mask_oui(mac: Column) -> Column:
    """Keeps a MAC's vendor half and zeroes the rest; strings without six parts stay as they are."""
    return F.when(F.size(F.split(mac, ":")) == 6, F.concat(F.substring_index(mac, ":", 3), F.lit(":00:00:00"))).otherwise(mac)


def protocol_number(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])[F.upper(name)]


def protocol_name(number: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in PROTOCOLS.items() for x in (v, k)])[number.cast("int")]


def random_ip(seed: int) -> Column:
    """Each octet is drawn on its own."""
    return F.concat_ws(".", *[F.floor(F.rand(seed + k) * 256).cast("string") for k in range(4)])


def random_mac(seed: int) -> Column:
    return F.concat_ws(":", *[F.lower(F.lpad(F.hex(F.floor(F.rand(seed + k) * 256)), 2, "0")) for k in range(6)])


def label_of_file(path: Column) -> Column:
    """Label of a flow file: its base name up to the first underscore."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), "_", 1)


def label_of_folder(path: Column) -> Column:
    """Label of a sample: the suffix of its folder behind the last underscore."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -2), "_"), -1)


def path_hash(path: Column) -> Column:
    """SHA-256 of a file's path, as the name of its sample."""
    return F.sha2(path, 256)
