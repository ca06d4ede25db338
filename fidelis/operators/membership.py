"""Membership and inference attacks on tables of scores and keys, and scores of predicted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tagged import running


def _levels(scores: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with members (pos), others (neg) and running sums of both from the lowest score up."""
    levels = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("double")).alias("pos"), F.sum((F.col(label) != 1).cast("double")).alias("neg")
    )
    return running(levels, [], "score", "neg").withColumnRenamed("cum", "neg_below").drop("after")


def membership_auc(scores: DataFrame, label: str, score: str) -> DataFrame:
    """One row, auc: chance that a member scores above another row, ties half; null if either kind is missing."""
    levels = _levels(scores, label, score)
    wins = F.sum(F.col("pos") * (F.col("neg_below") - F.col("neg") / 2))
    return levels.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def counted_auc(scores: DataFrame, label: str, score: str, weight: str, cuts: int = 64) -> float | None:
    """The same for rows that stand for ``weight`` rows each: ranges of scores are summed on their own, then their sums on the driver.

    Bounds of ranges are quantiles of one in 64 different scores. They share the work among tasks; any bounds give the same chance.
    """
    rows = scores.select(F.col(label).alias("_one"), F.col(weight).cast("double").alias("_w"), F.col(score).cast("double").alias("score")).where("score IS NOT NULL AND _one IS NOT NULL")
    found = rows.where(F.pmod(F.xxhash64("score"), F.lit(64)) == 0).agg(F.percentile_approx("score", [k / cuts for k in range(1, cuts)], 1000)).first()[0]
    bounds = sorted(set(found or []))

    def cut(low: int, high: int) -> str:
        """Number of bounds below the score, known to be in low to high."""
        half = (low + high) // 2
        return f"{low}" if low == high else f"IF(score > DOUBLE('{bounds[half]!r}'), {cut(half + 1, high)}, {cut(low, half)})"

    levels = rows.withColumn("_range", F.expr(cut(0, len(bounds)))).groupBy("_range", "score").agg(F.sum(F.when(F.col("_one") == 1, F.col("_w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("_one") != 1, F.col("_w")).otherwise(0.0)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("_range").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    sums = levels.withColumn("_below", below).groupBy("_range").agg(F.sum(F.col("pos") * (F.col("_below") - F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    wins = pos = neg = 0.0
    for r in sorted(sums.collect(), key=lambda r: r["_range"]):
        wins, pos, neg = wins + r["wins"] + r["pos"] * neg, pos + r["pos"], neg + r["neg"]
    return wins / (pos * neg) if pos and neg else None


def membership_ks(scores: DataFrame, label: str, score: str) -> DataFrame:
    """One row, ks: largest difference of the two kinds' distribution functions."""
    levels = running(_levels(scores, label, score), [], "score", "pos").withColumnRenamed("cum", "pos_below").drop("after")
    totals = levels.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return levels.join(F.broadcast(totals)).agg(F.max(F.abs(F.try_divide("pos_below", "p") - F.try_divide("neg_below", "n"))).alias("ks"))  # one row of totals


def membership_tpr(scores: DataFrame, label: str, score: str, fpr: float = 0.01) -> DataFrame:
    """One row, tpr: the largest share of members at or above a threshold that at most ``fpr`` of the others reach."""
    levels = running(_levels(scores, label, score), [], "score", "pos").withColumnRenamed("cum", "pos_below").drop("after")
    totals = levels.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = lambda kind, total: (F.col(total) - F.col(f"{kind}_below") + F.col(kind)) / F.col(total)
    return levels.join(F.broadcast(totals)).agg(F.coalesce(F.max(F.when(above("neg", "n") <= fpr, above("pos", "p"))), F.lit(0.0)).alias("tpr"))


def perplexity(tokens: DataFrame, keys: list[str], loss: str) -> DataFrame:
    """exp of the mean loss of each sample's tokens."""
    return tokens.groupBy(*keys).agg(F.exp(F.avg(loss)).alias("perplexity"))


def gradient_norm(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("grad_norm"))


def reconstruction_mse(pixels: DataFrame, keys: list[str], a: str, b: str, wrapped: bool = False) -> DataFrame:
    """Mean squared difference; ``wrapped`` computes with bytes that overflow."""
    d = F.col(a).cast("int") - F.col(b).cast("int")
    square = F.pmod(F.pmod(d, F.lit(256)) * F.pmod(d, F.lit(256)), F.lit(256)) if wrapped else d * d
    return pixels.groupBy(*keys).agg(F.avg(square.cast("double")).alias("loss"))


def scores_from_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """sample, loss, grad_norm from lines ``sample=..., loss=..., grad_norm=...``; other lines are left out."""
    pick = lambda k: F.regexp_extract(column, rf"{k}=([^,\s]+)", 1)
    return lines.where(F.col(column).rlike(r"sample=.*loss=.*grad_norm=")).select(pick("sample").alias("sample"), pick("loss").cast("double").alias("loss"), pick("grad_norm").cast("double").alias("grad_norm"))


# --- attribute inference ----------------------------------------------------------------------


def _key(columns: list[str]):
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in columns]))


def cap(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str], zero: bool = False) -> DataFrame:
    """score: 1 less the mean chance of guessing a real row's sensitive values from synthetic rows with its key.

    Rows whose key the synthetic data lacks are left out, or count as safe where ``zero``. If no row
    can be scored the score is 0. Both sides are counted by distinct values before they are joined, so
    a frequent key moves one row.
    """
    s = synthetic.groupBy(_key(keys).alias("k"), _key(sensitive).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = real.groupBy(_key(keys).alias("k"), _key(sensitive).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    totals = s.groupBy("k").agg(F.sum("n").alias("t"))
    both = r.join(totals, "k", "left" if zero else "inner").join(s, ["k", "v"], "left")
    chance = F.coalesce(F.col("n") / F.col("t"), F.lit(0.0))
    return both.agg(F.coalesce(1 - F.sum(F.col("m") * chance) / F.sum("m"), F.lit(0.0)).alias("score"))


def generalized_cap(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """The same with all synthetic keys at the least Hamming distance from the real key.

    Distinct real keys are matched on ever smaller subsets of their fields: a key at distance d equals the
    real one in some subset of the others. Synthetic rows are counted by those fields and the sensitive
    values before they meet the keys, so a frequent value joins one row for each of them; no pairs of keys.
    """
    from itertools import combinations

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c)
    s = synthetic.groupBy(*[text(c) for c in keys], _key(sensitive).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = real.groupBy(*[text(c) for c in keys], _key(sensitive).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    open_, scored = r.select(*keys).distinct(), None
    for d in range(len(keys)):
        # An open key has no closer match, so what is equal in these fields differs in all others.
        hits = None
        for same in combinations(keys, len(keys) - d):
            found = open_.join(s.groupBy(*same, "v").agg(F.sum("n").alias("n")), list(same)).select(*keys, "v", "n")
            hits = found if hits is None else hits.unionByName(found)
        hits = hits.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
        scored = hits if scored is None else scored.unionByName(hits)
        open_ = open_.join(hits.select(*keys).distinct(), keys, "left_anti")
    totals = scored.groupBy(*keys).agg(F.sum("n").alias("t"))
    # Nothing equal: all synthetic rows, of which only the real row's own values count.
    totals = totals.unionByName(open_.join(F.broadcast(s.agg(F.sum("n").alias("t")).where("t is not null"))))  # one row
    scored = scored.unionByName(r.select(*keys, "v").join(open_, keys).join(s.groupBy("v").agg(F.sum("n").alias("n")), "v").select(*keys, "v", "n"))
    both = r.join(totals, keys).join(scored, [*keys, "v"], "left")
    return both.agg(F.coalesce(1 - F.sum(F.col("m") * F.coalesce(F.col("n") / F.col("t"), F.lit(0.0))) / F.sum("m"), F.lit(0.0)).alias("score"))


# --- predicted labels -------------------------------------------------------------------------


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).cast("string").alias("actual"), F.coalesce(F.col(predicted).cast("string"), F.lit("unknown")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def label_scores(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support of each actual label (0 where undefined)."""
    cells = confusion(rows, actual, predicted).where("actual is not null")
    by_actual = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    by_predicted = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"))
    p, r = F.coalesce(F.try_divide("hit", "named"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return by_actual.join(by_predicted, "label", "left").select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def label_summary(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, weighted precision, recall and f1, macro_f1."""
    by = label_scores(rows, actual, predicted)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return by.agg(mean("recall").alias("accuracy"), mean("precision").alias("weighted_precision"), mean("recall").alias("weighted_recall"), mean("f1").alias("weighted_f1"), F.avg("f1").alias("macro_f1"))


def nearest_rows(points: DataFrame, model: DataFrame, features: list[str], k: int = 5, fill: bool = False) -> DataFrame:
    """For each point (id) the ``k`` model rows with the most equal features (ties by id): id, model_id, equal, rank.

    Rows that share no feature value are not compared, unless ``fill``: then they are equal in 0 features
    and follow behind, so that each point has ``k`` rows if the model has them. Null equals nothing. For each set of features
    the model keeps its ``k`` smallest ids by value, which is all that can matter: a row behind them
    has ``k`` rows before it that are equal in as many features. So a frequent value never meets more
    than ``k`` rows, and no pairs of all points and rows arise. 2^features joins: for a few features.
    """
    from itertools import combinations

    pick = lambda df, name: df.select(F.col("id").alias(name), *[F.col(c).cast("string").alias(c) for c in features])
    p, m, hits = pick(points, "id"), pick(model, "model_id"), None
    for n in range(1, len(features) + 1):
        for same in map(list, combinations(features, n)):
            order = Window.partitionBy(*same).orderBy("model_id")
            first = m.dropna(subset=same).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k).select(*same, "model_id")
            part = p.join(first, same).select("id", "model_id", F.lit(n).alias("equal"))
            hits = part if hits is None else hits.unionAll(part)
    if fill:  # of rows that are equal in nothing only the k smallest ids can matter
        least = [r[0] for r in m.select("model_id").orderBy("model_id").limit(k).collect()]
        if least:
            hits = hits.unionAll(p.select("id", F.explode(F.array(*map(F.lit, least))).alias("model_id"), F.lit(0).alias("equal")))
    equal = hits.groupBy("id", "model_id").agg(F.max("equal").cast("bigint").alias("equal"))
    order = Window.partitionBy("id").orderBy(F.desc("equal"), "model_id")
    return equal.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def majority(rows: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The most frequent vote of each group, nulls left out, ties to the smallest."""
    counts = rows.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(vote).alias("v"))).alias("_best")).select(*keys, F.col("_best.v").alias(vote))
