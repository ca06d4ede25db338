"""Inference attacks with fitted models: what synthetic rows tell about the sensitive values of real ones."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .learners import FourierFeatures
from .membership import majority, nearest_rows
from .tagged import running

# --- numbers ----------------------------------------------------------------------------------


def shares_below(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(value, share) of each distinct ``value`` of ``asked``: the share of the values of ``known`` at or below it.

    The empirical distribution function, exactly: equal values are counted first, then summed up by
    ranges of the order. Nulls are left out on both sides; without known values the share is null.
    """
    kept = lambda df, n: df.where(F.col("value").isNotNull()).select(F.col("value").cast("double").alias("value"), n.alias("n"))
    counts = kept(known, F.lit(1.0)).groupBy("value").agg(F.sum("n").alias("n"))
    steps = counts.unionByName(kept(asked, F.lit(0.0)).distinct()).groupBy("value").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return running(steps, [], "value", "n").join(F.broadcast(total)).select("value", (F.col("cum") / F.col("total")).alias("share"))  # one row


def cdf_distance(real: DataFrame, pairs: DataFrame, p: float = 2) -> DataFrame:
    """rows, total: over ``pairs`` (predicted, actual) the sum of |F(predicted) - F(actual)| ** p with F of the ``value`` column of ``real``.

    Equal pairs are counted once, so a frequent value meets its share in few rows.
    """
    # A guess is looked up by its value, which a second run of a sum might not hit to the last bit.
    each = stored(pairs.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n")), "pairs")
    shares = shares_below(real, each.select(F.col("predicted").alias("value")).union(each.select("actual")))
    of = lambda c: shares.select(F.col("value").alias(c), F.col("share").alias(f"of_{c}"))
    met = each.join(of("predicted"), "predicted").join(of("actual"), "actual")
    return met.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.pow(F.abs(F.col("of_predicted") - F.col("of_actual")), F.lit(float(p)))).alias("total"))


def _mean_distance(real: DataFrame, rows: DataFrame, sensitive: list[str], p: float) -> DataFrame:
    """score: mean over ``rows`` (each sensitive column and its guess _of_) of the columns' distances summed up."""
    each = [cdf_distance(real.select(F.col(c).alias("value")), rows.select(F.col(f"_of_{c}").alias("predicted"), F.col(c).alias("actual")), p) for c in sensitive]
    return reduce(DataFrame.unionByName, each).agg((F.sum("total") / F.max("rows")).alias("score"))


def regression_attack(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str], p: float = 2) -> DataFrame:
    """score: mean distance of the real rows' sensitive numbers from those that linear regressions on synthetic rows predict.

    The distance of a row is the sum over sensitive columns of |F(predicted) - F(actual)| ** p, F being
    the distribution function of the real column. Rows with a null in ``keys`` or ``sensitive`` are left
    out; 0 is a perfect attack.
    """
    rows = _numbers(real, keys, sensitive)
    assemble = VectorAssembler(inputCols=keys, outputCol="_features")
    train = assemble.transform(_numbers(synthetic, keys, sensitive))
    rows = assemble.transform(rows)
    for c in sensitive:
        rows = LinearRegression(featuresCol="_features", labelCol=c, predictionCol=f"_of_{c}").fit(train).transform(rows)
    return _mean_distance(real, rows, sensitive, p)


def _numbers(df: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in (*keys, *sensitive)]).dropna()


def near_sums(places: DataFrame, points: DataFrame, axes: list[str], sums: list[str], radius: float, p: float = 2, depth: int | None = None) -> DataFrame:
    """For each row of ``places`` (axes, between 0 and 1) the totals of ``sums`` over the ``points`` near it; places near nothing have no row.

    Near: the p-th powers of the differences on all axes add up to less than ``radius``. A tree of cells,
    halved on each axis from level to level, meets itself: pairs of cells that are near as a whole take
    the cell's totals, pairs that are far drop out, and only pairs on the rim go on to their halves. At
    the last level the rows of rim cells are compared one by one. ``depth`` follows from the number of
    points, so that cells have few of them.
    """
    k = len(axes)
    points = stored(points, "near-points")
    if depth is None:
        depth = max(1, min(62 // k, -(-max(1, points.count()).bit_length() // k)))

    def code(level: int) -> Column:
        side = 1 << level
        at = [F.least(F.floor(F.col(a) * side), F.lit(side - 1)) for a in axes]
        return reduce(lambda x, y: x + y, [F.shiftleft(v.cast("bigint"), level * i) for i, v in enumerate(at)])

    def bound(level: int, more: int) -> Column:
        """Least (-1) or greatest (1) distance of two cells' rows."""
        mask, parts = (1 << level) - 1, []
        for i in range(k):
            place = [F.shiftright(F.col(c), level * i).bitwiseAND(F.lit(mask)) for c in ("cell", "other")]
            steps = F.abs(place[0] - place[1]) + more
            parts.append(F.pow(F.greatest(steps, F.lit(0)) / float(1 << level), F.lit(float(p))))
        return reduce(lambda x, y: x + y, parts)

    levels = range(depth + 1)
    # All levels read these tables, and the next level the pairs of the one before: they are stored, not worked out again.
    own = stored(places.select(*axes).distinct().select("*", *[code(n).alias(f"_q{n}") for n in levels]), "places")
    data = stored(points.select(*axes, *sums, *[code(n).alias(f"_d{n}") for n in levels]), "points")
    rim, given = places.limit(1).select(F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("other")), []
    for n in levels:
        totals = data.groupBy(F.col(f"_d{n}").alias("other")).agg(*[F.sum(c).alias(c) for c in sums])
        if n:
            down = own.select(F.col(f"_q{n - 1}").alias("cell"), F.col(f"_q{n}").alias("cell_")).distinct()
            across = data.select(F.col(f"_d{n - 1}").alias("other"), F.col(f"_d{n}").alias("other_")).distinct()
            rim = rim.join(down, "cell").join(across, "other").select(F.col("cell_").alias("cell"), F.col("other_").alias("other"))
        pairs = stored(rim.where(bound(n, -1) < radius).withColumn("whole", bound(n, 1) < radius), "cell-pairs")
        met = pairs.where("whole").join(totals, "other").groupBy("cell").agg(*[F.sum(c).alias(c) for c in sums])
        given.append(own.join(met, own[f"_q{n}"] == met["cell"]).select(*axes, *sums))
        rim = pairs.where("not whole").select("cell", "other")
    leaf = own.select(F.col(f"_q{depth}").alias("cell"), *axes).join(rim, "cell")
    far = data.select(F.col(f"_d{depth}").alias("other"), *[F.col(a).alias(f"_{a}") for a in axes], *sums)
    apart = reduce(lambda x, y: x + y, [F.pow(F.abs(F.col(a) - F.col(f"_{a}")), F.lit(float(p))) for a in axes])
    given.append(leaf.join(far, "other").where(apart < radius).select(*axes, *sums))
    return reduce(DataFrame.unionByName, given).groupBy(*axes).agg(*[F.sum(c).alias(c) for c in sums])


def radius_attack(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str], p: float = 2, cutoff: float = 0.1, depth: int | None = None) -> DataFrame:
    """score: mean distance when a real row's sensitive numbers are guessed by the mean of the synthetic rows near its keys.

    Near means that the p-th powers of the differences of the keys' distribution functions (of the real
    columns) sum up to less than len(keys) * cutoff ** p; nothing near gives a guess of 0. (The numerator
    takes near rows only, as a mean should.) The distance is that of ``regression_attack``. Rows are
    counted by distinct keys before they meet, and ``near_sums`` finds what is near.
    """
    rows, fake = _numbers(real, keys, sensitive), _numbers(synthetic, keys, sensitive)
    places = rows.select(*keys).distinct()
    data = fake.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sensitive])
    for c in keys:
        value = lambda df, c=c: df.select(F.col(c).cast("double").alias("value"))
        shares = shares_below(value(real), value(places).union(value(data))).select(F.col("value").alias(c), F.col("share").alias(f"_at_{c}"))
        places, data = places.join(shares, c), data.join(shares, c)
    axes, sums = [f"_at_{c}" for c in keys], ["_n", *[f"_sum_{c}" for c in sensitive]]
    places = stored(places, "key-places")
    near = near_sums(places, data, axes, sums, len(keys) * cutoff**p, p, depth)
    guess = places.join(near, axes, "left").select(*keys, *[F.coalesce(F.col(f"_sum_{c}") / F.col("_n"), F.lit(0.0)).alias(f"_of_{c}") for c in sensitive])
    return _mean_distance(real, rows.join(guess, keys), sensitive, p)


# --- categories -------------------------------------------------------------------------------

MODELS = {
    "naive_bayes": lambda: NaiveBayes(featuresCol="_features", labelCol="_label", predictionCol="_found", smoothing=1.0),
    "forest": lambda: RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="_found", numTrees=100, maxDepth=8, seed=0),
    "linear": lambda: OneVsRest(classifier=LinearSVC(maxIter=30), featuresCol="_features", labelCol="_label", predictionCol="_found"),
    "svm": lambda: Pipeline(stages=[FourierFeatures("_features", "_fourier"), OneVsRest(classifier=LinearSVC(maxIter=30), featuresCol="_fourier", labelCol="_label", predictionCol="_found")]),
}


def guesses(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str, model: str = "naive_bayes", neighbours: int = 5) -> DataFrame:
    """The distinct keys of real rows, their rows by actual value, and what a model fitted on synthetic rows guesses.

    keys, actual, rows, guess. ``model`` is naive_bayes, forest, svm (a machine with a radial kernel for each
    value), linear (one without) or knn (votes of the synthetic rows with the most equal keys). Keys with a category that no synthetic row
    has have a null guess; nulls are the category "?".
    """
    text = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in (*keys, sensitive)])
    r, s = text(real).groupBy(*keys, sensitive).agg(F.count(F.lit(1)).alias("rows")), text(synthetic)
    if model == "knn":
        # Equal synthetic rows are neighbours of equal rank: each value gives as many rows as can matter.
        counted = s.groupBy(*keys, sensitive).agg(F.count(F.lit(1)).alias("_n"))
        rows = counted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("_n", F.lit(neighbours))))).withColumn("id", F.xxhash64(*keys, sensitive, "_i"))
        points = r.select(*keys).distinct().withColumn("id", F.xxhash64(*keys))
        near = nearest_rows(points, rows, keys, neighbours, fill=True).join(rows.select(F.col("id").alias("model_id"), F.col(sensitive).alias("vote")), "model_id")
        found = points.join(majority(near, ["id"], "vote"), "id", "left").select(*keys, F.col("vote").alias("guess"))
    else:
        stages = [
            StringIndexer(inputCol=sensitive, outputCol="_label", handleInvalid="keep", stringOrderType="frequencyDesc"),
            StringIndexer(inputCols=keys, outputCols=[f"_i_{c}" for c in keys], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"_i_{c}" for c in keys], outputCols=[f"_h_{c}" for c in keys], dropLast=False),
            VectorAssembler(inputCols=[f"_h_{c}" for c in keys], outputCol="_features"),
            MODELS[model](),
        ]
        fitted = Pipeline(stages=stages).fit(s)
        labels, known = fitted.stages[0].labels, fitted.stages[1].labelsArray
        name = F.get(F.array(*map(F.lit, labels)), F.col("_found").cast("int"))
        # An unseen category has the index behind all known ones.
        seen = reduce(lambda a, b: a & b, [F.col(f"_i_{c}") < len(k) for c, k in zip(keys, known, strict=True)])
        points = r.select(*keys).distinct().withColumn(sensitive, F.lit(labels[0]))
        found = fitted.transform(points).select(*keys, F.when(seen, name).alias("guess"))
    return r.join(found, keys).select(*keys, F.col(sensitive).alias("actual"), "rows", "guess")


def guess_score(rows: DataFrame) -> DataFrame:
    """score: 1 less the share of rows whose actual value was guessed; rows without a guess are left out, 0 if none is left."""
    right = F.sum(F.when(F.col("guess") == F.col("actual"), F.col("rows")).otherwise(0))
    return rows.where("guess is not null").agg(F.coalesce(1 - F.try_divide(right, F.sum("rows")), F.lit(0.0)).alias("score"))


def model_attack(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str, model: str = "naive_bayes") -> DataFrame:
    return guess_score(guesses(real, synthetic, keys, sensitive, model))


def ensemble_attack(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str, models: list[str]) -> DataFrame:
    """The same with the majority of several models' guesses, ties to the smallest value."""
    each = [guesses(real, synthetic, keys, sensitive, m) for m in models]
    votes = majority(reduce(DataFrame.unionByName, [g.select(*keys, "guess").distinct() for g in each]).select(*keys, F.col("guess").alias("vote")), keys, "vote")
    return guess_score(each[0].drop("guess").join(votes, keys, "left").withColumnRenamed("vote", "guess"))


# --- likelihood under a tree of categories -----------------------------------------------------


def mutual_information(real: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, bits: mutual information (natural log) of each pair of columns; nulls are a category. One pass counts all pairs."""
    from itertools import combinations

    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _text(a).alias("x"), _text(b).alias("y")) for a, b in combinations(columns, 2)])
    counts = real.select(F.inline(pairs)).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Joint counts sum up to those of one column; no pass over the rows again.
    left, right = counts.groupBy("a", "b", "x").agg(F.sum("n").alias("nx")), counts.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    total = counts.groupBy("a", "b").agg(F.sum("n").alias("t"))
    rows = counts.join(left, ["a", "b", "x"]).join(right, ["a", "b", "y"]).join(F.broadcast(total), ["a", "b"])  # a row for each pair of columns
    return rows.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("bits"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("?"))


def dependence_tree(real: DataFrame, columns: list[str]) -> list[tuple[str | None, str]]:
    """(parent, child) of the spanning tree with the most mutual information; the first column is the root. Only names and weights of pairs reach the driver."""
    weight = {}
    for r in mutual_information(real, columns).collect() if len(columns) > 1 else []:
        weight[r["a"], r["b"]] = weight[r["b"], r["a"]] = round(r["bits"], 12)
    tree, inside = [(None, columns[0])], [columns[0]]
    while len(inside) < len(columns):
        parent, child = max(((a, b) for a in inside for b in columns if b not in inside), key=lambda x: (weight.get(x, 0.0), -columns.index(x[1]), -columns.index(x[0])))
        tree.append((parent, child))
        inside.append(child)
    return tree


def tree_likelihood(real: DataFrame, synthetic: DataFrame, columns: list[str], log: bool = False, tree: list[tuple[str | None, str]] | None = None) -> DataFrame:
    """score: mean probability of synthetic rows under a tree of categorical columns fitted on real rows.

    With ``log`` it is the mean logarithm, a probability of 0 counting 1e-8. Distinct rows are looked up
    once. A value that no real row has under its parent's value has probability 0.
    """
    tree = tree or dependence_tree(real, columns)
    edges = lambda: F.array(*[F.struct(F.lit(f"{a}>{b}").alias("edge"), (_text(a) if a else F.lit("")).alias("x"), _text(b).alias("y")) for a, b in tree])
    counts = real.select(F.inline(edges())).groupBy("edge", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.join(counts.groupBy("edge", "x").agg(F.sum("n").alias("t")), ["edge", "x"]).select("edge", "x", "y", (F.col("n") / F.col("t")).alias("p"))
    rows = synthetic.groupBy(*[_text(c).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("rows")).withColumn("row", F.to_json(F.struct(*columns)))
    each = rows.select("row", "rows", F.inline(edges())).join(shares, ["edge", "x", "y"], "left")
    logs = each.groupBy("row", "rows").agg(F.sum(F.ln("p")).alias("l"), F.count_if(F.col("p").isNull()).alias("unseen"))
    p = F.when(F.col("unseen") > 0, 0.0).otherwise(F.exp("l"))
    value = F.ln(F.greatest(p, F.lit(1e-8))) if log else p
    return logs.agg((F.sum(value * F.col("rows")) / F.sum("rows")).alias("score"))
