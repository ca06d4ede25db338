"""Distances of continuous columns over bins that follow from the real side's data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagged import REAL, long_form, running, safe_log_term


def exact_quantiles(values: DataFrame, shares: list[float]) -> DataFrame:
    """field, n, low, high and q, an array of the linearly interpolated quantiles, from rows (field, value).

    Equal values are counted, counts are summed up by ranges of the order, and two rows on both sides of
    a quantile's place give it: exact, and no field's values meet in one task.
    """
    counts = values.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("field", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    placed = running(counts.select("field", "value", F.col("n").alias("each")), ["field"], "value", "each").join(totals, "field")
    parts = []
    for k, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("n") - 1)
        parts += [F.min(F.when(F.col("cum") > F.floor(place), F.col("value"))).alias(f"a{k}"), F.min(F.when(F.col("cum") > F.ceil(place), F.col("value"))).alias(f"b{k}"), F.first(place - F.floor(place)).alias(f"t{k}")]
    found = placed.groupBy("field", "n", "low", "high").agg(*parts)
    return found.select("field", "n", "low", "high", F.array(*[F.col(f"a{k}") + F.col(f"t{k}") * (F.col(f"b{k}") - F.col(f"a{k}")) for k in range(len(shares))]).alias("q"))


def automatic_bins(values: DataFrame, whole: list[str] | None = None) -> DataFrame:
    """field, low, high, bins from rows (field, value): the finer of the rules of Freedman and Diaconis and of Sturges.

    The width is 2 (q75 - q25) / n^(1/3) or (high - low) / (log2(n) + 1), the smaller one; without a
    spread of quartiles the latter. Fields in ``whole`` have widths of 1 at least. One value gives one
    bin of width 1 around it.
    """
    q = exact_quantiles(values, [0.25, 0.75])
    span, n = F.col("high") - F.col("low"), F.col("n")
    iqr = F.col("q")[1] - F.col("q")[0]
    even = span / (F.log2(n) + 1)
    width = F.when(iqr > 0, F.least(2 * iqr * F.pow(n, F.lit(-1.0 / 3)), even)).otherwise(even)
    if whole:
        width = F.when(F.col("field").isin(whole), F.greatest(width, F.lit(1.0))).otherwise(width)
    one = F.col("low") == F.col("high")
    return q.select("field", F.when(one, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(one, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"), F.when(one, 1).otherwise(F.ceil(span / width)).cast("bigint").alias("bins"))


def bin_of(value: str = "value"):
    """Number of the bin (from 0) that a value within the bounds is in; the last one holds its upper bound."""
    v, low, high, bins = (F.col(c) for c in (value, "low", "high", "bins"))
    edge = lambda k: low + k * (high - low) / bins
    first = F.least(F.floor((v - low) / (high - low) * bins), bins - 1)
    return F.when(v < edge(first), first - 1).when((first < bins - 1) & (v >= edge(first + 1)), first + 1).otherwise(first)


def continuous_jsd(both: DataFrame, columns: list[str], whole: list[str] | None = None) -> DataFrame:
    """field, bins, score: Jensen-Shannon divergence (natural logarithm) of the real and synthetic histograms over the real side's automatic bins.

    Synthetic values beyond the real bounds are left out. A field without values on one side, or without
    synthetic values within the bounds, has a null score or no row (no real values).
    """
    values = long_form(both, columns, "double").where(F.col("value").isNotNull() & ~F.isnan("value"))
    bounds = automatic_bins(values.where(F.col("side") == REAL).select("field", "value"), whole)
    met = values.join(F.broadcast(bounds), "field").where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))  # a row for each column
    is_real = F.col("side") == REAL
    counts = met.groupBy("field", "bins", bin_of().alias("bin")).agg(F.count_if(is_real).cast("double").alias("r"), F.count_if(~is_real).cast("double").alias("s"))
    totals = counts.groupBy("field").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    p, q = F.try_divide(F.col("r"), F.col("tr")), F.try_divide(F.col("s"), F.col("ts"))
    half = counts.join(F.broadcast(totals), "field").select("field", "bins", p.alias("p"), q.alias("q"))  # a row for each column
    m = (F.col("p") + F.col("q")) / 2
    score = F.sum(safe_log_term(F.col("p"), m) + safe_log_term(F.col("q"), m)) / 2
    # Without synthetic values q is null: so is the score.
    return half.groupBy("field", "bins").agg(F.when(F.count("q") > 0, score).alias("score"))
