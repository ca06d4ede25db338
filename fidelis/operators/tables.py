"""Scores over several tables: children per parent, denormalised rows, and metadata helpers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ks_complement, statistic_similarity
from .tagged import tagged

KINDS = {"numerical": (T.NumericType,), "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType), "boolean": (T.BooleanType,), "categorical": (T.StringType,)}


@dataclass(frozen=True)
class TableMetadata:
    """Kinds of a table's columns and its keys. Both dialects of dictionaries can be read."""

    kinds: dict[str, str]
    primary_key: str | None = None
    alternate_keys: tuple[str, ...] = ()
    personal: tuple[str, ...] = ()
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> TableMetadata:
        fields = d.get("columns") or d.get("fields") or {}
        flat = []
        for k in d.get("alternate_keys", ()):
            flat += k if isinstance(k, list | tuple) else [k]
        return cls(
            {c: x.get("sdtype") or x.get("type") for c, x in fields.items()}, d.get("primary_key"), tuple(flat),
            tuple(c for c, x in fields.items() if x.get("pii")), {c: (x["ref"]["table"], x["ref"]["field"]) for c, x in fields.items() if x.get("ref")},
        )

    @classmethod
    def infer(cls, df: DataFrame) -> TableMetadata:
        kind = lambda t: next((k for k, types in KINDS.items() if isinstance(t, types)), "other")
        return cls({f.name: kind(f.dataType) for f in df.schema})

    def select(self, *kinds: str) -> list[str]:
        """Columns of these kinds that are neither keys nor personal."""
        out = {self.primary_key, *self.alternate_keys, *self.personal, *self.foreign_keys}
        return [c for c, k in self.kinds.items() if k in kinds and c not in out]


def validate(real: DataFrame, synthetic: DataFrame, metadata: TableMetadata) -> None:
    """Both tables must have the same columns, and the metadata must name columns that exist."""
    if set(real.columns) != set(synthetic.columns):
        raise ValueError("real and synthetic data must have the same columns")
    if missing := set(metadata.kinds) - set(real.columns):
        raise ValueError(f"the metadata names columns that don't exist: {sorted(missing)}")


def cardinality(parent: DataFrame, child: DataFrame, key: str, foreign_key: str) -> DataFrame:
    """Children of each parent, 0 included. Children are counted before the join."""
    counts = child.groupBy(F.col(foreign_key).alias("_fk")).agg(F.count(F.lit(1)).alias("children"))
    return parent.join(counts, F.col(key) == F.col("_fk"), "left").select(F.col(key), F.coalesce("children", F.lit(0)).cast("bigint").alias("children"))


def cardinality_shape(real: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], key: str, foreign_key: str) -> DataFrame:
    return ks_complement(tagged(cardinality(*real, key, foreign_key), cardinality(*synthetic, key, foreign_key), ["children"]), ["children"])


def cardinality_statistic(real: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], key: str, foreign_key: str, statistic: str = "mean") -> DataFrame:
    return statistic_similarity(tagged(cardinality(*real, key, foreign_key), cardinality(*synthetic, key, foreign_key), ["children"]), ["children"], statistic)


def denormalize(parent: DataFrame, child: DataFrame, key: str, foreign_key: str) -> DataFrame:
    """Full outer join of parents and children without the keys."""
    return parent.join(child, F.col(key) == F.col(foreign_key), "full_outer").drop(key, foreign_key)
