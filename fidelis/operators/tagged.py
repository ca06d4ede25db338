"""Two tables compared as one: the real and the synthetic rows under a tag, in a long form by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REAL, SYNTHETIC = "real", "synthetic"


def tagged(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables' ``columns`` with the tag ``side``: one scan of each, one shuffle for what follows."""
    pick = lambda df, side: df.select(F.lit(side).alias("side"), *columns)
    return pick(real, REAL).unionByName(pick(synthetic, SYNTHETIC))


def long_form(both: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(side, field, value) with ``value`` cast to ``kind``; nulls stay."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast(kind).alias("value")) for c in columns])
    return both.select("side", F.inline(fields))


def category_shares(both: DataFrame, columns: list[str], epsilon: float = 0.0) -> DataFrame:
    """Shares p (real) and q (synthetic) by (field, value), nulls left out.

    ``epsilon`` replaces a real count of zero, as regularised tests do; real shares then include it.
    One aggregation counts both sides; the totals are sums over its small result.
    """
    counts = long_form(both, columns, "string").where(F.col("value").isNotNull()).groupBy("field", "value").agg(
        F.sum(F.when(F.col("side") == REAL, 1.0).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("side") == SYNTHETIC, 1.0).otherwise(0.0)).alias("s")
    )
    if epsilon:
        counts = counts.withColumn("r", F.when(F.col("r") == 0, F.lit(epsilon)).otherwise(F.col("r")))
    totals = counts.groupBy("field").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    return counts.join(F.broadcast(totals), "field").select(  # as many rows as compared columns
        "field", "value", F.coalesce(F.try_divide("r", "tr"), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("s", "ts"), F.lit(0.0)).alias("q")
    )


#: Rows of a key that one task sums without cutting them into ranges.
WHOLE = 100_000


def running(df: DataFrame, keys: list[str], order: str, add: str, cuts: int = 64, whole: int = WHOLE) -> DataFrame:
    """Running sum ``cum`` of ``add`` by ``order`` within ``keys``, and the next row's ``order`` as ``after``.

    Rows of one key don't meet in one task: approximate quantiles cut the order of a key with more
    than ``whole`` rows into ranges, each range is summed on its own, and the ranges' totals (``cuts``
    rows a key) are summed up before them. Bounds of such keys, one row for ``whole`` rows at most,
    reach all tasks, so that the rows go straight to their ranges. ``order`` must be unique within a key.
    """
    share = [k / cuts for k in range(1, cuts)]
    bounds = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(order, share, 1000).alias("_bounds")).where(F.col("_rows") > whole).drop("_rows")
    ranged = df.join(F.broadcast(bounds), keys, "left") if keys else df.join(F.broadcast(bounds), how="left")
    ranged = ranged.withColumn("_range", F.coalesce(F.when(F.col("_bounds").isNotNull(), F.size(F.filter("_bounds", lambda b: b < F.col(order)))), F.lit(0))).drop("_bounds")
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    summed = ranged.withColumn("_in", F.sum(add).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead(order).over(inside))
    across = Window.partitionBy(*keys).orderBy("_range")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(add).alias("_total"), F.min(order).alias("_first"))
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_total").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.lead("_first").over(across).alias("_first_after"))
    totals = totals if keys else F.broadcast(totals)  # then ``cuts`` rows
    return summed.join(totals, [*keys, "_range"]).select(*df.columns, (F.col("_before") + F.col("_in")).alias("cum"), F.coalesce("_next", "_first_after").alias("after"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_log_term(a: Column, b: Column) -> Column:
    """a ln(a / b), 0 where a is 0."""
    return F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0))
