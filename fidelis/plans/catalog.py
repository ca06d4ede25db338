"""The registry of queries and the roles that the given tables play: packets, flows, real and synthetic sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tagged import tagged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; minus zero becomes zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: seconds, source number, protocol, size and a port from the properties."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"),
        (F.col("user_id") * 2654435761 % 4294967296).alias("address"), F.get_json_object("props", "$.k").cast("int").alias("port"),
    )


#: The same as a common table expression.
PACKETS = """packets AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS time,
  user_id * 2654435761 % 4294967296 AS address, CAST(json_extract_string(props, '$.k') AS INTEGER) AS port FROM events)"""


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Even keys are the real rows, odd ones the synthetic."""
    return df.where(F.col(key) % 2 == 0), df.where(F.col(key) % 2 == 1)


def sides(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return tagged(*halves(df, key), columns)


def long_sql(source: str, key: str, fields: dict[str, str], kind: str) -> str:
    """CTE l(side, field, value)."""
    rows = [f"SELECT CASE WHEN {key} % 2 = 0 THEN 'real' ELSE 'synthetic' END AS side, '{f}' AS field, CAST({x} AS {kind}) AS value FROM {source}" for f, x in fields.items()]
    return "l AS (" + " UNION ALL ".join(rows) + ")"


#: Shares p and q by (field, value) of l, with a floor for the real count.
def shares_sql(floor: float = 0) -> str:
    r = f"CASE WHEN r = 0 THEN CAST({floor} AS DOUBLE) ELSE r END"
    return f"""c AS (SELECT field, value, CAST(COUNT(*) FILTER (side = 'real') AS DOUBLE) AS r, CAST(COUNT(*) FILTER (side = 'synthetic') AS DOUBLE) AS s FROM l WHERE value IS NOT NULL GROUP BY ALL),
 d AS (SELECT field, value, {r} AS r, s FROM c),
 sh AS (SELECT field, value, r / SUM(r) OVER (PARTITION BY field) AS p, s / SUM(s) OVER (PARTITION BY field) AS q FROM d)"""


#: Signed cumulated shares by field of l (numeric).
SIGNED = """n AS (SELECT field, side, COUNT(*) AS t FROM l WHERE value IS NOT NULL GROUP BY ALL),
 g AS (SELECT l.field, value, SUM(CASE WHEN l.side = 'real' THEN CAST(1 AS DOUBLE) / t ELSE -CAST(1 AS DOUBLE) / t END) AS d FROM l JOIN n ON l.field = n.field AND l.side = n.side WHERE value IS NOT NULL GROUP BY ALL),
 w AS (SELECT field, value, SUM(d) OVER (PARTITION BY field ORDER BY value ROWS UNBOUNDED PRECEDING) AS cd, LEAD(value) OVER (PARTITION BY field ORDER BY value) - value AS dx FROM g)"""
JSD = "0.5 * SUM(CASE WHEN p > 0 THEN p * LN(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * LN(2 * q / (p + q)) ELSE 0 END)"
