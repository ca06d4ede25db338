"""Field codecs. A fit is one aggregate on the whole column; encoding and decoding are projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import int_to_bits, let


@dataclass(frozen=True)
class MinMax:
    """Numbers scaled to [0, 1], or to [-1, 1] where ``centred``; optionally their log1p."""

    low: float
    high: float
    centred: bool = False
    log: bool = False

    @classmethod
    def fit(cls, df: DataFrame, column: str, centred: bool = False, log: bool = False) -> MinMax:
        x = F.log1p(F.col(column)) if log else F.col(column)
        row = df.agg(F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high")).first()
        return cls(row["low"] or 0.0, row["high"] or 0.0, centred, log)

    def encode(self, x: Column) -> Column:
        """A column that is constant becomes 0 (the middle of the range where centred)."""
        x = F.log1p(x) if self.log else x
        unit = (x - F.lit(self.low)) / F.lit(self.high - self.low) if self.high > self.low else F.when(x.isNotNull(), F.lit(0.5 if self.centred else 0.0))
        return 2 * unit - 1 if self.centred else unit

    def decode(self, y: Column) -> Column:
        unit = (y + 1) / 2 if self.centred else y
        x = unit * F.lit(self.high - self.low) + F.lit(self.low)
        return F.expm1(x) if self.log else x


@dataclass(frozen=True)
class OneHot:
    """Categories as arrays of 0 and 1; unknown ones are all 0."""

    choices: tuple

    @classmethod
    def fit(cls, df: DataFrame, column: str, most: int = 10_000) -> OneHot:
        """Distinct values in order. More than ``most`` are an error: they must fit in an array."""
        rows = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{column} has more than {most} categories")
        return cls(tuple(r[0] for r in rows))

    def encode(self, x: Column) -> Column:
        return F.array(*[F.coalesce((x == F.lit(c)).cast("int"), F.lit(0)) for c in self.choices])

    def decode(self, y: Column) -> Column:
        """The category with the largest value, the first of several."""
        at = F.array_position(y, F.array_max(y)).cast("int")
        return F.element_at(F.array(*[F.lit(c) for c in self.choices]), at)


@dataclass(frozen=True)
class Bits:
    """Numbers as pairs for each bit, most significant first: [1, 0] for 0 and [0, 1] for 1."""

    width: int

    def encode(self, x: Column) -> Column:
        return F.flatten(F.transform(int_to_bits(x, self.width), lambda b: F.array(1 - b, b)))

    def decode(self, y: Column) -> Column:
        at = F.sequence(F.lit(0), F.lit(self.width - 1))
        return let(y, lambda pairs: F.aggregate(at, F.lit(0).cast("bigint"), lambda a, k: a * 2 + F.when(F.get(pairs, 2 * k + 1) > F.get(pairs, 2 * k), 1).otherwise(0)))


def encode_fields(df: DataFrame, codecs: dict[str, object], keep: list[str] | None = None) -> DataFrame:
    """One projection with every field's encoding under its own name."""
    return df.select(*(keep or []), *[codec.encode(F.col(c)).alias(c) for c, codec in codecs.items()])


def pack_fields(df: DataFrame, codecs: dict[str, object], name: str = "vector") -> DataFrame:
    """All encodings of a row in one array, in the order of ``codecs``."""
    parts = [c.encode(F.col(f)) if not isinstance(c, MinMax) else F.array(c.encode(F.col(f))) for f, c in codecs.items()]
    return df.withColumn(name, F.concat(*[F.transform(p, lambda x: x.cast("double")) for p in parts]))


def unpack_fields(df: DataFrame, codecs: dict[str, object], name: str = "vector") -> DataFrame:
    """Decodes arrays of ``pack_fields``, slice by slice."""
    out, at = [], 1
    for field, codec in codecs.items():
        width = 1 if isinstance(codec, MinMax) else len(codec.choices) if isinstance(codec, OneHot) else 2 * codec.width
        part = F.slice(name, at, width)
        out.append((codec.decode(part[0]) if isinstance(codec, MinMax) else codec.decode(part)).alias(field))
        at += width
    return df.select(*[c for c in df.columns if c != name and c not in codecs], *out)


def fill_missing(df: DataFrame, numeric: list[str], categorical: list[str], placeholder: str = "?") -> DataFrame:
    """Numbers by their mean, categories by a placeholder."""
    means = df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    return df.fillna({k: v for k, v in means.items() if v is not None}).fillna({c: placeholder for c in categorical})


def fill_array(values: Column, placeholder: str = "?") -> Column:
    """Nulls in an array of texts as a placeholder."""
    return F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit(placeholder)))


def share_equal(df: DataFrame, column: str, target) -> DataFrame:
    """share: of the rows whose value is ``target`` (nulls are other values; null for an empty table)."""
    return df.agg(F.avg(F.coalesce((F.col(column) == F.lit(target)).cast("double"), F.lit(0.0))).alias("share"))
