"""Gaussian mixtures by expectation maximisation, each step one aggregate of sufficient statistics.

Rows are standardised by their columns' moments and counted by distinct values. The responsibilities
are column expressions of the model's few parameters, so a step is a single aggregation with partial
sums, and only weights, means and covariances reach the driver. They are kept to ten digits, so neither
the number of cores nor the order of a sum shows in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least variance of a component, as a share of its column's.
FLOOR = 1e-6


@dataclass(frozen=True)
class Scale:
    """Means and spreads of columns, and how many rows there are."""

    columns: list[str]
    mean: np.ndarray
    spread: np.ndarray
    rows: int


@dataclass
class Mixture:
    """Components in standardised coordinates; ``log_likelihood`` is the mean over the rows it was fitted on."""

    scale: Scale
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    full: bool
    log_likelihood: float | None = None

    @property
    def free(self) -> int:
        """Number of free parameters."""
        k, d = self.means.shape
        return k - 1 + k * d + k * (d * (d + 1) // 2 if self.full else d)

    @property
    def bic(self) -> float:
        """Bayesian information criterion; smaller is better."""
        return float(-2 * self.log_likelihood * self.scale.rows + self.free * np.log(self.scale.rows))


def _digits(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: float(f"{v:.10g}"), otypes=[float])(x)


def scale_of(df: DataFrame, numeric: list[str]) -> Scale | None:
    """None if a column has no numbers at all. A constant column has the spread 1."""
    x = [_number(c) for c in numeric]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(x)], *[F.count(v).alias(f"k{i}") for i, v in enumerate(x)]).first()
    if not row["n"] or any(row[f"m{i}"] is None for i in range(len(x))):
        return None
    # Gaps are filled by the mean, which takes its part of the spread away.
    spread = np.sqrt([row[f"v{i}"] * row[f"k{i}"] / row["n"] for i in range(len(x))])
    mean = np.array([row[f"m{i}"] for i in range(len(x))])
    return Scale(list(numeric), _digits(mean), _digits(np.where(spread > 1e-12 * np.maximum(np.abs(mean), 1e-300), spread, 1.0)), row["n"])


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def points(df: DataFrame, scale: Scale, gaps: np.ndarray | None = None) -> DataFrame:
    """x0, x1, ... in standard coordinates and n, the number of rows with these values; gaps count as the means of the column (``gaps``, else the scale's)."""
    fill = scale.mean if gaps is None else gaps
    x = [((F.coalesce(_number(c), F.lit(float(g))) - float(m)) / float(s)).alias(f"x{i}") for i, (c, g, m, s) in enumerate(zip(scale.columns, fill, scale.mean, scale.spread, strict=True))]
    return df.select(*x).groupBy(*[f"x{i}" for i in range(len(x))]).agg(F.count(F.lit(1)).alias("n"))


def _log_parts(model: Mixture) -> list[Column]:
    """Log of each component's weighted density at x0, x1, ... of the standard coordinates, for a density in the given ones."""
    out, d = [], model.means.shape[1]
    for w, mean, cov in zip(model.weights, model.means, model.covariances, strict=True):
        values, vectors = np.linalg.eigh(cov)
        values = np.maximum(values, FLOOR)
        inverse = (vectors / values) @ vectors.T
        base = np.log(max(w, 1e-300)) - (d * np.log(2 * np.pi) + np.log(values).sum()) / 2 - np.log(model.scale.spread).sum()
        far = [F.col(f"x{i}") - F.lit(float(m)) for i, m in enumerate(mean)]
        square = sum((F.lit(float(inverse[i, j] * (1 if i == j else 2))) * far[i] * far[j] for i in range(d) for j in range(i, d) if model.full or i == j), F.lit(0.0))
        out.append(F.lit(float(base)) - square / 2)
    return out


def with_density(rows: DataFrame, model: Mixture) -> DataFrame:
    """``rows`` of ``points`` with _l0, _l1, ... (log of each component's part) and _z (log of the density)."""
    parts = _log_parts(model)
    rows = rows.select("*", *[p.alias(f"_l{c}") for c, p in enumerate(parts)])
    each = [F.col(f"_l{c}") for c in range(len(parts))]
    rows = rows.withColumn("_m", F.greatest(*each) if len(each) > 1 else each[0])
    return rows.withColumn("_z", F.col("_m") + F.ln(sum((F.exp(x - F.col("_m")) for x in each), F.lit(0.0)))).drop("_m")


def step(rows: DataFrame, model: Mixture) -> Mixture:
    """The model after one step, and the log-likelihood of the one before."""
    k, d = model.means.shape
    part = [F.col("n") * F.exp(F.col(f"_l{c}") - F.col("_z")) for c in range(k)]
    pairs = [(i, j) for i in range(d) for j in range(i, d) if model.full or i == j]
    sums = [F.sum(F.col("n") * F.col("_z")).alias("all")]
    for c in range(k):
        sums += [F.sum(part[c]).alias(f"n{c}"), *[F.sum(part[c] * F.col(f"x{i}")).alias(f"s{c}_{i}") for i in range(d)], *[F.sum(part[c] * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{c}_{i}_{j}") for i, j in pairs]]
    row = with_density(rows, model).agg(*sums).first()
    weights, means, covariances = model.weights.copy(), model.means.copy(), model.covariances.copy()
    for c in range(k):
        n = row[f"n{c}"]
        weights[c] = n / model.scale.rows
        if n < 1e-8:  # a component that no row is near stays where it is
            continue
        means[c] = [row[f"s{c}_{i}"] / n for i in range(d)]
        for i, j in pairs:
            covariances[c, i, j] = covariances[c, j, i] = row[f"q{c}_{i}_{j}"] / n - means[c, i] * means[c, j]
        covariances[c][np.diag_indices(d)] = np.maximum(covariances[c].diagonal(), FLOOR)
    return Mixture(model.scale, _digits(weights), _digits(means), _digits(covariances), model.full, row["all"] / model.scale.rows)


def spread_starts(rows: DataFrame, scale: Scale, components: int, full: bool = False) -> Mixture:
    """Means at even steps between the columns' bounds, unit variances, equal weights."""
    d = len(scale.columns)
    row = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("a", F.min), ("b", F.max))]).first()
    low, high = (np.array([row[f"{n}{i}"] for i in range(d)]) for n in "ab")
    means = np.array([low + (c + 0.5) / components * (high - low) for c in range(components)])
    return Mixture(scale, np.full(components, 1 / components), _digits(means), np.stack([np.eye(d)] * components), full)


def plus_starts(rows: DataFrame, scale: Scale, components: int, seed: int = 0, full: bool = False, tries: int = 4) -> Mixture:
    """Means by seeded greedy k-means++, moved to the means of their nearest rows.

    Each next centre is the best of ``tries`` rows drawn in proportion to their squared distance from the
    centres before, by what distance it leaves. A draw is a race of exponential times by a hash of the
    row's values, so it is one aggregate, and the same on any cluster. Fewer different rows than
    components give as many components.
    """
    x = [f"x{i}" for i in range(len(scale.columns))]
    means: list[list[float]] = []

    def away(centres: list[list[float]]) -> Column:
        each = [sum(((F.col(v) - F.lit(m)) ** 2 for v, m in zip(x, mean, strict=True)), F.lit(0.0)) for mean in centres]
        return F.least(*each) if len(each) > 1 else each[0]

    for c in range(components):
        weighed = rows.select("*", (F.col("n") * (away(means) if means else F.lit(1.0))).alias("w")).where("w > 0")
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.lit(k), *x), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in range(tries)]
        drawn = weighed.agg(*[F.min(F.struct((-F.ln(v) / F.col("w")).alias("t"), *x)).alias(f"d{k}") for k, v in enumerate(u)]).first()
        if drawn["d0"] is None:
            break
        found = [[drawn[f"d{k}"][v] for v in x] for k in range(tries)]
        left = rows.agg(*[F.sum(F.col("n") * away([*means, f])).alias(f"s{k}") for k, f in enumerate(found)]).first()
        means.append(min(zip(found, left, strict=True), key=lambda y: float(f"{y[1]:.10g}"))[0])
    return _by_nearest(rows, scale, np.array(means), full)


def _by_nearest(rows: DataFrame, scale: Scale, means: np.ndarray, full: bool, rounds: int = 5) -> Mixture:
    """A start from centres moved to the means of their nearest rows ``rounds`` times: shares and moments of these rows."""
    k, d = means.shape
    pairs = [(i, j) for i in range(d) for j in range(i, d) if full or i == j]
    weights, covariances = np.full(k, 1 / k), np.stack([np.eye(d)] * k)
    for _ in range(rounds):
        away = [sum(((F.col(f"x{i}") - F.lit(float(m))) ** 2 for i, m in enumerate(mean)), F.lit(0.0)) for mean in means]
        near = F.array_position(F.array(*away), F.array_min(F.array(*away))) - 1
        sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"x{i}")).alias(f"s{i}") for i in range(d)], *[F.sum(F.col("n") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs]]
        means = means.copy()
        for r in rows.groupBy(near.alias("c")).agg(*sums).collect():  # a row for each centre
            weights[r["c"]] = r["n"] / scale.rows
            means[r["c"]] = [r[f"s{i}"] / r["n"] for i in range(d)]
            for i, j in pairs:
                covariances[r["c"], i, j] = covariances[r["c"], j, i] = r[f"q{i}_{j}"] / r["n"] - means[r["c"], i] * means[r["c"], j]
        means = _digits(means)
    for c in range(k):
        covariances[c][np.diag_indices(d)] = np.maximum(covariances[c].diagonal(), FLOOR)
    return Mixture(scale, _digits(weights), means, _digits(covariances), full)


def run(rows: DataFrame, start: Mixture, steps: int = 60, tolerance: float = 1e-4) -> Mixture:
    """Steps until the mean log-likelihood gains less than ``tolerance`` (0: all steps); the last model with its own log-likelihood."""
    model, before = start, None
    for _ in range(steps):
        after = step(rows, model)
        if tolerance and before is not None and after.log_likelihood - before < tolerance:
            model.log_likelihood = after.log_likelihood
            return model
        model, before = after, after.log_likelihood
    row = with_density(rows, model).agg((F.sum(F.col("n") * F.col("_z")) / F.sum("n")).alias("l")).first()
    model.log_likelihood = row["l"]
    return model


def fit(real: DataFrame, numeric: list[str], components: int | tuple[int, int] = (1, 6), full: bool = False, seed: int = 0, steps: int = 60, tolerance: float = 1e-4, starts: str = "plus") -> list[Mixture]:
    """One model for each number of ``components`` (from and to, or one), in that order; none if ``real`` has no numbers.

    ``full``: covariances of pairs, too, else variances. ``starts``: plus (seeded k-means++) or spread.
    """
    scale = scale_of(real, numeric)
    if scale is None:
        return []
    low, high = (components, components) if isinstance(components, int) else components
    rows = points(real, scale).persist()
    try:
        begin = (lambda k: spread_starts(rows, scale, k, full)) if starts == "spread" else lambda k: plus_starts(rows, scale, k, seed, full)
        return [run(rows, begin(k), steps, tolerance) for k in range(low, high + 1)]
    finally:
        rows.unpersist()


def best_of(models: list[Mixture]) -> Mixture | None:
    """The one with the least information criterion, ties to the fewest components."""
    return min(models, key=lambda m: (round(m.bic, 6), len(m.weights)), default=None)


def score(model: Mixture, rows: DataFrame) -> DataFrame:
    """score: mean log-likelihood of ``rows`` under the model; their gaps count as their own columns' means. Null without rows."""
    own = scale_of(rows, model.scale.columns)
    if own is None:
        return rows.sparkSession.sql("select cast(null as double) score")
    dense = with_density(points(rows, model.scale, own.mean), model)
    return dense.agg((F.sum(F.col("n") * F.col("_z")) / F.sum("n")).alias("score"))


def mixture_log_likelihood(real: DataFrame, synthetic: DataFrame, numeric: list[str], components: int | tuple[int, int] = (1, 6), full: bool = False, seed: int = 0, iterations: int = 3, **how) -> DataFrame:
    """score: mean log-likelihood of synthetic rows under Gaussian mixtures fitted on real rows.

    Of a range of numbers of components, the one with the least information criterion is taken; then
    ``iterations`` models from different seeds are scored and averaged. Gaps are filled by means, each
    side by its own. A side without rows, or a column without numbers, gives null.
    """
    if not isinstance(components, int):
        chosen = best_of(fit(real, numeric, components, full, seed, **how))
        components = len(chosen.weights) if chosen else 1
    fits = [fit(real, numeric, components, full, seed + 1 + i, **how) for i in range(1 if components == 1 else iterations)]
    scores = [score(m, synthetic) for f in fits for m in f]
    if not scores:
        return real.sparkSession.sql("select cast(null as double) score")
    every = scores[0]
    for s in scores[1:]:
        every = every.unionByName(s)
    return every.agg(F.avg("score").alias("score"))


def selection(models: list[Mixture], spark) -> DataFrame:
    """components, log_likelihood, bic, chosen of fitted models."""
    best = best_of(models)
    rows = [(len(m.weights), float(m.log_likelihood), m.bic, m is best) for m in models]
    return spark.createDataFrame(rows, "components int, log_likelihood double, bic double, chosen boolean")
