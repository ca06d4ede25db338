"""Packet streams to flow sessions and to windowed counts, with watermarks for late packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flow_sessions(packets: DataFrame, time: str, key: list[str], size: str, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """One row a session: a flow without a pause of ``gap``, with its packets and bytes. Works on streams and tables."""
    spaced = packets.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *key)
    return spaced.agg(F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes")).select(*key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "packets", "bytes")


def windowed_counts(packets: DataFrame, time: str, key: list[str], width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Packets of each key in windows of fixed width."""
    return packets.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *key).agg(F.count(F.lit(1)).alias("packets")).select(*key, F.col("w.start").alias("started"), "packets")
