"""Mitigation: coarser or replaced identities, and Laplace noise on header fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import int_to_ip, mask_oui, mask_subnet


@dataclass(frozen=True)
class NoisyField:
    """A field with its fallback sensitivity and, for whole-number fields, its bounds."""

    name: str
    sensitivity: float
    low: float | None = None
    high: float | None = None


#: Bounds and fallback sensitivities of the header fields that get noise (fixed values).
HEADER_FIELDS = (
    NoisyField("time", 1.0), NoisyField("ttl", 254.0, 1, 255), NoisyField("ip_id", 65535.0, 0, 65535), NoisyField("tos", 255.0, 0, 255), NoisyField("window", 65535.0, 0, 65535),
)
#: The budget is divided by this many shares, one of which stays unused.
SHARES = 6


def sensitivities(packets: DataFrame, file: str, fields: tuple[NoisyField, ...]) -> DataFrame:
    """Per file the range of each field, or its fallback where that is 0 or missing. A noise level, not a guarantee."""
    spread = lambda f: F.max(f.name) - F.min(f.name)
    return packets.groupBy(file).agg(*[F.coalesce(F.when(spread(f) > 0, spread(f).cast("double")), F.lit(f.sensitivity)).alias(f"sens_{f.name}") for f in fields])


def laplace(scale: Column, seed: int) -> Column:
    """Noise by the inverse distribution function of a seeded uniform number."""
    u = F.rand(seed) - 0.5
    return -scale * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def add_noise(packets: DataFrame, file: str, fields: tuple[NoisyField, ...] = HEADER_FIELDS, epsilon: float = 0.1, seed: int = 0, data_driven: bool = True) -> DataFrame:
    """Adds Laplace noise to each field, an equal share of ``epsilon`` each; bounded fields are clipped and cut to whole numbers."""
    rows = packets.join(sensitivities(packets, file, fields), file) if data_driven else packets.select("*", *[F.lit(f.sensitivity).alias(f"sens_{f.name}") for f in fields])
    out = {}
    for k, f in enumerate(fields):
        x = F.col(f.name) + laplace(F.col(f"sens_{f.name}") * SHARES / epsilon, seed + k)
        out[f.name] = F.least(F.greatest(x, F.lit(f.low)), F.lit(f.high)).cast("int") if f.low is not None else x
    return rows.withColumns(out).drop(*[f"sens_{f.name}" for f in fields])


def coarsen(packets: DataFrame, ips: list[str], macs: list[str]) -> DataFrame:
    """Keeps networks and vendors, zeroes hosts."""
    return packets.withColumns({c: mask_subnet(F.col(c)) for c in ips} | {c: mask_oui(F.col(c)) for c in macs})


def one_identity(packets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The same given identity in all rows."""
    return packets.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(v)) for c, v in columns.items()})


def pseudonym_ip(ip: Column, key: str) -> Column:
    """A keyed hash as address: the same for the same address in any column, without a dictionary or a join."""
    return F.when(ip.isNotNull(), int_to_ip(F.conv(F.substring(F.sha2(F.concat(F.lit(key), ip), 256), 1, 8), 16, 10).cast("bigint")))


def pseudonym_mac(mac: Column, key: str) -> Column:
    digits = F.sha2(F.concat(F.lit(key), mac), 256)
    return F.when(mac.isNotNull(), F.concat_ws(":", *[F.substring(digits, 1 + 2 * k, 2) for k in range(6)]))


def pseudonymize(packets: DataFrame, ips: list[str], macs: list[str], key: str) -> DataFrame:
    """Consistent pseudonyms for all listed columns; without the key they can't be recomputed."""
    return packets.withColumns({c: pseudonym_ip(F.col(c), key) for c in ips} | {c: pseudonym_mac(F.col(c), key) for c in macs})


def write_noisy(packets: DataFrame, path: str, file: str, overwrite: bool = False, **options) -> None:
    """Writes packets with noise (``add_noise``) as Parquet. Existing results stay unless ``overwrite``."""
    add_noise(packets, file, **options).write.mode("overwrite" if overwrite else "ignore").parquet(path)
