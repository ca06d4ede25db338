"""Distances between the real and the synthetic distribution of columns: one row for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tagged import REAL, category_shares, long_form, running, safe_log_term


def jsd(both: DataFrame, columns: list[str], squared: bool = False) -> DataFrame:
    """field, jsd: Jensen-Shannon distance (natural log); the divergence, its square, where ``squared``."""
    mid = (F.col("p") + F.col("q")) / 2
    total = F.sum(safe_log_term(F.col("p"), mid) + safe_log_term(F.col("q"), mid)) / 2
    value = F.greatest(total, F.lit(0.0))
    return category_shares(both, columns).groupBy("field").agg((value if squared else F.sqrt(value)).alias("jsd"))


def tuple_jsd(both: DataFrame, columns: list[str]) -> DataFrame:
    """Jensen-Shannon distance of the joint distribution of several columns."""
    return jsd(both.withColumn("joint", F.to_json(F.struct(*columns))), ["joint"])


def categorical_emd(both: DataFrame, columns: list[str]) -> DataFrame:
    """field, emd: sum of |P - Q| of the cumulated shares in the categories' order, over their number less one.

    It works on distinct categories, of which a field with an order has few; for numbers use ``wasserstein``.
    """
    shares = category_shares(both, columns).withColumn("d", F.col("p") - F.col("q"))
    summed = shares.withColumn("cum", F.sum("d").over(Window.partitionBy("field").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count(F.lit(1))
    return summed.groupBy("field").agg(F.when(n > 1, F.sum(F.abs("cum")) / (n - 1)).otherwise(F.lit(0.0)).alias("emd"))


def _signed(both: DataFrame, columns: list[str]) -> DataFrame:
    """Share of the real rows less that of the synthetic ones, by (field, value)."""
    values = long_form(both, columns, "double").where(F.col("value").isNotNull())
    counts = values.groupBy("field", "value").agg(F.sum(F.when(F.col("side") == REAL, 1.0).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("side") != REAL, 1.0).otherwise(0.0)).alias("s"))
    totals = counts.groupBy("field").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    return counts.join(F.broadcast(totals), "field").select("field", "value", (F.try_divide("r", "tr") - F.try_divide("s", "ts")).alias("d"))  # totals: a row for each column


def wasserstein(both: DataFrame, columns: list[str]) -> DataFrame:
    """field, emd (first Wasserstein distance), emd_of_range (over the combined range, 0 if constant), ks.

    Nulls are left out; a side without values gives nulls. Works on distinct values, cut into ranges.
    """
    summed = running(_signed(both, columns), ["field"], "value", "d")
    step = F.sum(F.abs("cum") * (F.col("after") - F.col("value")))
    span = F.max("value") - F.min("value")
    emd = F.when(F.count("cum") > 0, F.coalesce(step, F.lit(0.0)))
    return summed.groupBy("field").agg(emd.alias("emd"), F.when(span > 0, emd / span).when(emd.isNotNull(), 0.0).alias("emd_of_range"), F.max(F.abs("cum")).alias("ks"))


def conditional_distance(both: DataFrame, attribute: str, feature: str) -> DataFrame:
    """Distance of a feature's distribution under each value of an attribute that both sides have, and their mean."""
    part = both.select("side", F.col(attribute).cast("string").alias("field"), F.col(feature).cast("double").alias("value")).where("field is not null and value is not null")
    counts = part.groupBy("field", "value").agg(F.sum(F.when(F.col("side") == REAL, 1.0).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("side") != REAL, 1.0).otherwise(0.0)).alias("s"))
    totals = counts.groupBy("field").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts")).where("tr > 0 and ts > 0")
    signed = counts.join(totals, "field").select("field", "value", (F.col("r") / F.col("tr") - F.col("s") / F.col("ts")).alias("d"))
    return running(signed, ["field"], "value", "d").groupBy("field").agg(F.coalesce(F.sum(F.abs("cum") * (F.col("after") - F.col("value"))), F.lit(0.0)).alias("emd"))


def rank_distance(both: DataFrame, column: str) -> DataFrame:
    """jsd and emd after replacing values by the rank of their frequency on their own side (ties by value).

    For identifiers whose values are not comparable, such as addresses of different networks.
    """
    counts = both.where(F.col(column).isNotNull()).groupBy("side", F.col(column).alias("value")).count()
    ranked = frequency_rank(counts)
    shares = ranked.groupBy("rank").agg(F.sum(F.when(F.col("side") == REAL, F.col("share")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("side") != REAL, F.col("share")).otherwise(0.0)).alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    summed = running(shares.withColumn("d", F.col("p") - F.col("q")), [], "rank", "d")
    total = F.greatest(F.sum(safe_log_term(F.col("p"), mid) + safe_log_term(F.col("q"), mid)) / 2, F.lit(0.0))
    return summed.agg(total.alias("jsd"), F.sum(F.abs("cum")).alias("emd")).select(F.lit(column).alias("field"), "jsd", "emd")


def frequency_rank(counts: DataFrame, slices: int = 64) -> DataFrame:
    """Adds rank (1 for the most frequent of a side) and share to (side, value, count).

    Most values of a long tail share a frequency, so equal ones are numbered in slices of a hash, and
    ranks are those numbers behind the running sum over distinct (frequency, slice).
    """
    cut = counts.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(slices)))
    before = Window.partitionBy("side").orderBy(F.desc("count"), "slice").rowsBetween(Window.unboundedPreceding, -1)
    levels = cut.groupBy("side", "count", "slice").agg(F.count(F.lit(1)).alias("n")).select("side", "count", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = counts.groupBy("side").agg(F.sum("count").alias("total"))  # two rows
    numbered = cut.withColumn("i", F.row_number().over(Window.partitionBy("side", "count", "slice").orderBy("value")))
    return numbered.join(levels, ["side", "count", "slice"]).join(F.broadcast(totals), "side").select("side", "value", "count", (F.col("before") + F.col("i")).alias("rank"), (F.col("count") / F.col("total")).alias("share"))


def clamped_tv(both: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Total variation and Jensen-Shannon divergence over whole numbers clamped to a dense domain."""
    clamped = both.withColumn(column, F.least(F.greatest(F.col(column).cast("bigint"), F.lit(low)), F.lit(high)))
    mid = (F.col("p") + F.col("q")) / 2
    return category_shares(clamped, [column]).groupBy("field").agg(
        (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), F.greatest(F.sum(safe_log_term(F.col("p"), mid) + safe_log_term(F.col("q"), mid)) / 2, F.lit(0.0)).alias("jsd")
    )


def cumulative_shares(df: DataFrame, column: str) -> DataFrame:
    """value, share of rows up to it: the empirical distribution function."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    return running(counts, [], "value", "n").join(F.broadcast(total)).select("value", (F.col("cum") / F.col("total")).alias("share"))  # one row of totals
