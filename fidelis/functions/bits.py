"""Expressions over arrays of header bits (-1 missing, 0, 1), their fingerprints and colours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: lambdas inside ``body`` would compute a plain column again for each element."""
    return F.transform(F.array(value), body)[0]


def bits_to_int(bits: Column) -> Column:
    """First bit is the most significant; missing bits count as 0."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a * 2 + F.when(b > 0, 1).otherwise(0))


def int_to_bits(number: Column, width: int) -> Column:
    """``width`` bits of a number, the most significant first."""
    return F.array(*[F.shiftright(number.cast("bigint"), k).bitwiseAND(1).cast("int") for k in range(width - 1, -1, -1)])


def text_to_bits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def add_to_bits(text: Column, increment: Column | int = 1, fixed: bool = True) -> Column:
    """A bit string plus a number. With ``fixed`` it's padded to its old width; it grows where the sum does."""
    total = F.bin(F.conv(text, 2, 10).cast("bigint") + increment)
    return F.when(F.length(total) >= F.length(text), total).otherwise(F.lpad(total, F.length(text), F.lit("0"))) if fixed else total


def fingerprint(bits: Column) -> Column:
    """Missing bits as *, others as they are."""
    return F.array_join(F.transform(bits, lambda b: F.when(b < 0, F.lit("*")).otherwise(b.cast("string"))), "")


def bit_to_rgba(value: Column) -> Column:
    """1 red, 0 green, -1 blue; larger numbers are red and smaller ones blue with the amount as alpha."""
    pixel = lambda r, g, b, a: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), a.cast("int").alias("a"))
    full = F.lit(255)
    return (
        F.when(value == 1, pixel(255, 0, 0, full)).when(value == 0, pixel(0, 255, 0, full)).when(value == -1, pixel(0, 0, 255, full))
        .when(value > 1, pixel(255, 0, 0, value)).when(value < -1, pixel(0, 0, 255, F.abs(value)))
    )


def rgba_to_bit(pixel: Column) -> Column:
    """Inverse of ``bit_to_rgba``."""
    full = pixel["a"] == 255
    return F.when(pixel["r"] == 255, F.when(full, F.lit(1)).otherwise(pixel["a"])).when(pixel["g"] == 255, F.lit(0)).when(pixel["b"] == 255, F.when(full, F.lit(-1)).otherwise(-pixel["a"]))


def rgba_to_ip(pixel: Column) -> Column:
    return F.concat_ws(".", *[pixel[c].cast("string") for c in "rgba"])


def snap_colour(r: Column, g: Column, b: Column, high: int = 160, low: int = 100) -> Column:
    """A pixel snapped to pure red, green or blue: one channel clearly above the others, else the largest."""
    clear = lambda x, y, z: (x > high) & (y < low) & (z < low)
    largest = F.when((r >= g) & (r >= b), "red").when(g >= b, "green").otherwise("blue")
    return F.when(clear(r, g, b), "red").when(clear(g, r, b), "green").when(clear(b, r, g), "blue").otherwise(largest)


def tcp_segment_length(total_length: Column, header_words: Column, offset_words: Column) -> Column:
    """Bytes of payload: total length without the IP and TCP headers."""
    return total_length - 4 * header_words - 4 * offset_words
