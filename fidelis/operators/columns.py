"""Scores of single columns and of pairs of columns, by field; 1 is best. Constant or empty inputs give null."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distances import wasserstein
from .tagged import REAL, SYNTHETIC, category_shares, long_form, running

UNSEEN = 1e-6


def _side(side: str, x: str | Column = "value") -> Column:
    return F.when(F.col("side") == side, F.col(x) if isinstance(x, str) else x)


def ks_complement(both: DataFrame, columns: list[str]) -> DataFrame:
    return wasserstein(both, columns).select("field", (1 - F.col("ks")).alias("score"))


def tv_complement(both: DataFrame, columns: list[str]) -> DataFrame:
    """1 less half the sum of differences of shares; categories only in the synthetic data count 1e-6 real rows."""
    shares = category_shares(both, columns, UNSEEN)
    return shares.groupBy("field").agg(F.when(F.sum("q") > 0, 1 - F.sum(F.abs(F.col("p") - F.col("q"))) / 2).otherwise(0.0).alias("score"))


def chi_square(both: DataFrame, columns: list[str]) -> DataFrame:
    """field, statistic (of shares, not counts), freedom: categories less one. The p-value is ``chi_square_score``."""
    shares = category_shares(both, columns, UNSEEN)
    return shares.groupBy("field").agg(F.sum((F.col("q") - F.col("p")) ** 2 / F.col("p")).alias("statistic"), (F.count(F.lit(1)) - 1).alias("freedom"))


def chi_square_score(both: DataFrame, columns: list[str]) -> DataFrame:
    """p-value of ``chi_square``: the regularised upper incomplete gamma function of freedom / 2 and statistic / 2.

    One row for each column; 1 less the lower function's series where that converges fast (x < a + 1),
    a continued fraction elsewhere, both as folds in SQL. A single category scores 1.
    """
    a, x = F.col("freedom") / 2, F.col("statistic") / 2
    stat = chi_square(both, columns)
    # Steps until what is left is below a double's precision: both converge in some sqrt(a) steps at x = a + 1, faster away from it.
    steps = (F.ceil(10 * F.sqrt(a)) + 100).cast("int")
    series = F.aggregate(
        F.sequence(F.lit(1), steps), F.struct((1 / a).alias("term"), (1 / a).alias("total")),
        lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["total"] + s["term"] * x / (a + n)).alias("total")),
        lambda s: s["total"],
    )
    # x + 1 - a + 1 (a - 1) / (x + 3 - a + 2 (a - 2) / (x + 5 - a + ...)), from the inside; no part is below its step's number.
    fraction = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), x + 2 * steps + 1 - a, lambda t, n: x + 2 * n - 1 - a + n * (a - n) / t)
    # ln gamma(k / 2) by recurrence from gamma(1/2) or gamma(1).
    half = F.col("freedom") % 2 == 1
    below = F.when(F.col("freedom") > 2, F.sequence(F.when(half, F.lit(1)).otherwise(F.lit(2)).cast("bigint"), F.greatest(F.col("freedom") - 2, F.lit(1)).cast("bigint"), F.lit(2).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    log_gamma = F.aggregate(below, F.when(half, F.lit(0.5723649429247001)).otherwise(F.lit(0.0)), lambda s, k: s + F.ln(k / 2))
    density = F.exp(a * F.ln(x) - x - log_gamma)  # 0 where it underflows, and so is the score
    score = F.when((F.col("freedom") == 0) | (F.col("statistic") == 0), 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - density * series)).otherwise(density / fraction)
    return stat.select("field", score.alias("score"))


def category_coverage(both: DataFrame, columns: list[str]) -> DataFrame:
    """Share of the real categories that the synthetic data has."""
    shares = category_shares(both, columns)
    return shares.where("p > 0").groupBy("field").agg(F.avg((F.col("q") > 0).cast("double")).alias("score"))


def _ranges(both: DataFrame, columns: list[str]) -> DataFrame:
    values = long_form(both, columns, "double")
    return values.groupBy("field").agg(*[f(_side(side)).alias(f"{f.__name__}_{side}") for side in (REAL, SYNTHETIC) for f in (F.min, F.max)])


def range_coverage(both: DataFrame, columns: list[str]) -> DataFrame:
    """How much of the real range the synthetic values reach."""
    span = F.col("max_real") - F.col("min_real")
    missed = F.greatest((F.col("min_synthetic") - F.col("min_real")) / span, F.lit(0.0)) + F.greatest((F.col("max_real") - F.col("max_synthetic")) / span, F.lit(0.0))
    known = (span > 0) & F.col("min_synthetic").isNotNull()  # greatest and least pass over nulls
    return _ranges(both, columns).select("field", F.when(known, F.greatest(1 - missed, F.lit(0.0))).alias("score"))


def interval_overlap(both: DataFrame, columns: list[str]) -> DataFrame:
    """Overlap of both value ranges over their hull; 0 where they are apart."""
    inner = F.least("max_real", "max_synthetic") - F.greatest("min_real", "min_synthetic")
    hull = F.greatest("max_real", "max_synthetic") - F.least("min_real", "min_synthetic")
    known = F.col("min_real").isNotNull() & F.col("min_synthetic").isNotNull()
    return _ranges(both, columns).select("field", F.when(known, F.when(inner < 0, 0.0).when(hull > 0, inner / hull)).alias("score"))


def boundary_adherence(both: DataFrame, columns: list[str]) -> DataFrame:
    """Share of synthetic values, nulls left out, within the real range (bounds included)."""
    values = long_form(both, columns, "double").where(F.col("value").isNotNull())
    limits = values.where(F.col("side") == REAL).groupBy("field").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    inside = values.where(F.col("side") == SYNTHETIC).join(F.broadcast(limits), "field")  # a row for each column
    return inside.groupBy("field").agg(F.avg(F.col("value").between(F.col("low"), F.col("high")).cast("double")).alias("score"))


def missing_value_similarity(both: DataFrame, columns: list[str]) -> DataFrame:
    share = lambda side: F.avg(_side(side, F.col("value").isNull().cast("double")))
    return long_form(both, columns, "string").groupBy("field").agg((1 - F.abs(share(REAL) - share(SYNTHETIC))).alias("score"))


def statistic_similarity(both: DataFrame, columns: list[str], statistic: str = "mean") -> DataFrame:
    """1 less the difference of the means, medians or deviations over the real range, 0 at least."""
    values = long_form(both, columns, "double")
    if statistic == "median":
        values, of = _middles(values), F.avg
    else:
        of = {"mean": F.avg, "std": F.stddev_samp}[statistic]
    ends = (F.col("low"), F.col("high")) if statistic == "median" else (F.col("value"), F.col("value"))
    row = values.groupBy("field").agg(of(_side(REAL)).alias("r"), of(_side(SYNTHETIC)).alias("s"), (F.max(_side(REAL, ends[1])) - F.min(_side(REAL, ends[0]))).alias("span"))
    return row.select("field", F.when((F.col("span") > 0) & F.col("r").isNotNull() & F.col("s").isNotNull(), F.greatest(1 - F.abs(F.col("r") - F.col("s")) / F.col("span"), F.lit(0.0))).alias("score"))


def _middles(values: DataFrame) -> DataFrame:
    """(side, field, value, low, high): the one or two middle values, whose mean is the median, and the range, by running counts of distinct values."""
    counts = values.where(F.col("value").isNotNull()).groupBy("side", "field", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = counts.groupBy("side", "field").agg(F.sum("n").alias("all"), F.min("value").alias("low"), F.max("value").alias("high"))
    placed = running(counts, ["side", "field"], "value", "n").join(F.broadcast(totals), ["side", "field"])  # a row for each side and column
    before = F.col("cum") - F.col("n")
    places = F.array(F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2))  # from 0
    hits = F.filter(places, lambda k: (before <= k) & (k < F.col("cum")))
    return placed.select("side", "field", "value", "low", "high", F.explode(hits).alias("_k")).drop("_k")


# --- pairs -----------------------------------------------------------------------------------


def pair_names(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def _pairs(both: DataFrame, pairs: list[tuple[str, str]], kind: str) -> DataFrame:
    """(side, pair, a, b) of all pairs in one pass."""
    rows = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")) for a, b in pairs])
    return both.select("side", F.inline(rows))


def _correlation(side: str) -> Column:
    """Pearson correlation of one side's a and b; null where one of them is constant."""
    a, b = _side(side, "a"), _side(side, "b")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_similarity(both: DataFrame, pairs: list[tuple[str, str]], method: str = "pearson") -> DataFrame:
    """1 less half the difference of the correlations; rows with a null in the pair are left out, constant columns give null."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    values = None
    if method == "spearman":
        gaps = both.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
        if not any(gaps):  # then a column's ranks are the same in all its pairs
            values = _pairs(_ranked(both, names), pairs, "double")
    if values is None:
        values = _pairs(both, pairs, "double").where("a is not null and b is not null")
        if method == "spearman":
            for c in "ab":
                values = mid_ranks(values, ["side", "pair"], c)
    row = values.groupBy("pair").agg(_correlation(REAL).alias("r"), _correlation(SYNTHETIC).alias("s"))
    return row.select("pair", (1 - F.abs(F.col("r") - F.col("s")) / 2).alias("score"))


#: Ranks of a column with at most so many distinct values go to all tasks instead of through a shuffle.
FEW = 50_000


def _ranked(both: DataFrame, names: list[str]) -> DataFrame:
    """``both`` with each column replaced by its ranks within the side: distinct values are ranked once for all pairs."""
    long = long_form(both, names, "double").groupBy("side", "field", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    summed = running(long, ["side", "field"], "value", "n")
    ranks = summed.select("side", "field", "value", (F.col("cum") - (F.col("n") - 1) / 2).alias("rank")).persist()
    distinct = {r["field"]: r["count"] for r in ranks.groupBy("field").count().collect()}  # a row for each column
    out = both.select("side", *[F.col(c).cast("double").alias(c) for c in names])
    for c in names:
        own = ranks.where(F.col("field") == c).select("side", F.col("value").alias(c), F.col("rank").alias(f"_{c}"))
        out = out.join(F.broadcast(own) if distinct.get(c, 0) <= FEW else own, ["side", c])
    return out.select("side", *[F.col(f"_{c}").alias(c) for c in names])


def mid_ranks(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Replaces a column by its rank within ``keys``, ties by their mean: a running sum over distinct values."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    ranks = running(counts, keys, column, "_n").select(*keys, column, (F.col("cum") - (F.col("_n") - 1) / 2).alias("_rank"))
    return df.join(ranks, [*keys, column]).drop(column).withColumnRenamed("_rank", column)


def contingency_similarity(both: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """1 less half the sum of differences of joint shares; nulls are a category."""
    shares = _joint(both, pairs)
    return shares.groupBy("pair").agg((1 - F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("score"))


def _joint(both: DataFrame, pairs: list[tuple[str, str]], epsilon: float = 0.0) -> DataFrame:
    values = _pairs(both, pairs, "string")
    counts = values.groupBy("pair", "a", "b").agg(F.sum(F.when(F.col("side") == REAL, 1.0).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("side") != REAL, 1.0).otherwise(0.0)).alias("s"))
    if epsilon:
        counts = counts.withColumn("r", F.when(F.col("r") == 0, F.lit(epsilon)).otherwise(F.col("r")))
    totals = counts.groupBy("pair").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))  # a row for each pair
    return counts.join(F.broadcast(totals), "pair").select("pair", "a", "b", F.try_divide("r", "tr").alias("p"), F.try_divide("s", "ts").alias("q"))


def discrete_kl(both: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """1 / (1 + divergence of the synthetic joint shares from the real ones), as x ln(x / y) - x + y."""
    shares = _joint(both, pairs, UNSEEN)
    term = F.when(F.col("q") > 0, F.col("q") * F.ln(F.col("q") / F.col("p")) - F.col("q") + F.col("p")).otherwise(F.col("p"))
    return shares.groupBy("pair").agg((1 / (1 + F.sum(term))).alias("score"))


def continuous_kl(both: DataFrame, pairs: list[tuple[str, str]], bins: int = 10) -> DataFrame:
    """The same over a grid with the real ranges' edges; synthetic values outside are left out, cells get 1e-5."""
    values = _pairs(both, pairs, "double").where("a is not null and b is not null")
    limits = values.where(F.col("side") == REAL).groupBy("pair").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    cell = lambda x, lo, hi: F.least(F.floor((F.col(x) - F.col(lo)) * bins / (F.col(hi) - F.col(lo))), F.lit(bins - 1))
    inside = values.join(F.broadcast(limits), "pair").where("a between a0 and a1 and b between b0 and b1 and a1 > a0 and b1 > b0")
    counts = inside.groupBy("pair", cell("a", "a0", "a1").alias("x"), cell("b", "b0", "b1").alias("y")).agg(F.sum(F.when(F.col("side") == REAL, 1.0).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("side") != REAL, 1.0).otherwise(0.0)).alias("s"))
    totals = counts.groupBy("pair").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"), F.count(F.lit(1)).alias("cells"))
    small, whole = 1e-5, bins * bins
    # Each side's density has small added to all cells and sums to 1 again, as a relative entropy needs.
    p, q = [(F.try_divide(c, t) + small) / (1 + small * whole) for c, t in ((F.col("r"), F.col("tr")), (F.col("s"), F.col("ts")))]
    # Cells that neither side fills have equal densities and add nothing.
    row = counts.join(F.broadcast(totals), "pair").groupBy("pair").agg(F.sum(q * F.ln(q / p)).alias("kl"))
    return row.select("pair", (1 / (1 + F.col("kl"))).alias("score"))


def discretized(both: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Numeric columns as bins with edges from the real range: 0 below, bins + 1 at its maximum and above, and for nulls."""
    real = both.where(F.col("side") == REAL).agg(*[f(F.col(c).cast("double")).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    spread = both.join(F.broadcast(real))  # one row
    out = []
    for c in columns:
        x, low, high = F.col(c).cast("double"), F.col(f"_min_{c}"), F.col(f"_max_{c}")
        out.append(F.when(x.isNull() | (x >= high), bins + 1).when(x < low, 0).otherwise(F.floor((x - low) * bins / (high - low)) + 1).cast("int").alias(c))
    return spread.select("side", *[c for c in both.columns if c not in ("side", *columns)], *out)

