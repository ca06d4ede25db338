"""Learned audits with pyspark.ml: real-versus-synthetic detection, train on synthetic and test on real."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, RobustScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import AdaBoost, FourierFeatures, logistic_by_steps
from .membership import counted_auc, label_summary
from .mixture import mixture_log_likelihood  # noqa: F401  (it belongs to the learned audits)
from .tables import denormalize


def features(numeric: list[str], categorical: list[str]) -> list:
    """Stages that fill gaps by means, encode categories, assemble and scale robustly."""
    stages: list = [Imputer(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric])] if numeric else []
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=[*[f"{c}_filled" for c in numeric], *[f"{c}_hot" for c in categorical]], outputCol="raw_features", handleInvalid="keep"), RobustScaler(inputCol="raw_features", outputCol="features")]


#: Rows in a task of ``detection``: a table may come in one file with large row groups, which few tasks read.
PART_ROWS = 75_000

#: Different rows in a task of a pass over them; fewer where each becomes a vector of 200 waves.
TASK_ROWS, WAVE_ROWS = 500_000, 100_000

#: Columns up to which ``detection`` fits its logistic regression by sums of their products.
NARROW = 16


def detection(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str], model: str = "logistic", folds: int = 3, seed: int = 0) -> DataFrame:
    """score: 1 - mean over folds of (max(0.5, AUC) * 2 - 1). Folds are fixed by a hash, stratified by side.

    ``model`` is logistic, svc (a machine with a radial kernel, by random Fourier features) or linear (one without).
    Rows are spread over tasks by their number. Equal rows are in one fold, so they are kept once with their
    number while folds are fitted. The AUC is exact.
    """
    pick = lambda df, y: df.select(F.lit(float(y)).alias("label"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    rows = pick(real, 1).unionByName(pick(synthetic, 0))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(folds)).cast("int"))
    rows = rows.select("fold", F.col("label").cast("tinyint").alias("label"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in numeric], *categorical)
    rows = rows.repartition(max(1, -(-rows.count() // PART_ROWS)), *rows.columns)
    kept = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_rows")).persist()
    aucs = []
    try:
        rows = kept.coalesce(max(real.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // (WAVE_ROWS if model == "svc" else TASK_ROWS))))
        for k, (both, columns) in enumerate(_prepared(rows, numeric, categorical, folds, scaled=model != "logistic")):
            used = [x for x in columns if x is not None]
            train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
            if not both:
                scored = test.withColumn("score", F.lit(0.0))  # nothing to learn from one side
            elif model == "logistic" and len(used) <= NARROW:
                named = lambda df: df.select("label", "_rows", *[x.alias(f"_x{i}") for i, x in enumerate(used)])  # noqa: B023, E731
                first, *slopes = logistic_by_steps(named(train), [f"_x{i}" for i in range(len(used))], "label", "_rows")
                scored = named(test).withColumn("score", sum((F.col(f"_x{i}") * b for i, b in enumerate(slopes)), F.lit(first)))
            else:
                at = columns if model == "svc" else used  # the kernel's width depends on their number
                vector = lambda df: df.select("label", "_rows", array_to_vector(F.array(*[F.lit(0.0) if x is None else x for x in at])).alias("features"))  # noqa: B023, E731
                learners = {"logistic": [LogisticRegression(maxIter=50, weightCol="_rows")], "svc": [FourierFeatures(seed=seed, weight="_rows"), LinearSVC(featuresCol="fourier", maxIter=50, weightCol="_rows")], "linear": [LinearSVC(maxIter=50, weightCol="_rows")]}[model]
                fitted = Pipeline(stages=learners).fit(vector(train))
                scored = fitted.transform(vector(test)).select("label", "_rows", vector_to_array("rawPrediction")[1].alias("score")).persist()  # as scores are read more than once
            try:
                aucs.append(counted_auc(scored, "label", "score", "_rows"))
            finally:
                scored.unpersist()
    finally:
        kept.unpersist()
    score = 1 - sum(max(0.5, a or 0.0) * 2 - 1 for a in aucs) / folds
    return real.sparkSession.range(1).select(F.lit(round(float(score), 6)).alias("score"))


def _prepared(rows: DataFrame, numeric: list[str], categorical: list[str], folds: int, scaled: bool) -> list[tuple[bool, list]]:
    """For each fold: whether its training rows have both labels, and the columns that ``features`` would fit on them.

    ``rows`` (fold, label, _rows, columns) are counted ``_rows`` times. As there, a column whose quartiles are equal
    counts for nothing; it is None. Without ``scaled``, for a learner to which no scale matters, numbers are less their
    mean only, and quartiles are sought where half of the rows may be equal.
    """
    weigh = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("_rows")))
    facts = rows.groupBy("fold", "label").agg(F.sum("_rows").alias("n"), F.max("_rows").alias("most"), *[weigh(c).alias(f"n{i}") for i, c in enumerate(numeric)], *[F.sum(F.col(c) * F.col("_rows")).alias(f"s{i}") for i, c in enumerate(numeric)]).collect()
    others = [[r for r in facts if r["fold"] != k] for k in range(folds)]
    total = [sum(r["n"] for r in told) for told in others]
    known = [[sum(r[f"n{i}"] or 0 for r in told) for i in range(len(numeric))] for told in others]
    means = [[sum(r[f"s{i}"] or 0.0 for r in told) / max(1, known[k][i]) for i in range(len(numeric))] for k, told in enumerate(others)]
    filled = lambda k, i: F.coalesce(F.col(numeric[i]), F.lit(means[k][i]))
    spread = {(k, i): 1.0 for k in range(folds) for i in range(len(numeric))}
    wanted = list(spread) if scaled else [(k, i) for i, c in enumerate(numeric) for k, n in enumerate(_fullest(rows, c, folds)) if 2 * (n + total[k] - known[k][i]) >= total[k] - 4]
    if wanted:
        each = _repeated(rows.select("fold", "_rows", *numeric)) if max((r["most"] for r in facts), default=1) > 1 else rows
        found = each.agg(*[F.percentile_approx(F.when(F.col("fold") != k, filled(k, i)), [0.25, 0.75], 10_000) for k, i in wanted]).first()
        spread |= {at: q[1] - q[0] if q else 0.0 for at, q in zip(wanted, found, strict=True)}
    number = lambda k, i: filled(k, i) / spread[k, i] if scaled else filled(k, i) - means[k][i]
    out = [(len({r["label"] for r in told}) == 2, [number(k, i) if spread[k, i] else None for i in range(len(numeric))]) for k, told in enumerate(others)]
    for c in categorical:
        counts = rows.groupBy("fold", F.col(c).alias("value")).agg(F.sum("_rows").alias("n")).collect()
        for k, (_, columns) in enumerate(out):
            seen = Counter()
            for r in counts:
                seen[r["value"]] += r["n"] if r["fold"] != k else 0
            labels = sorted((v for v, n in seen.items() if n and v is not None), key=lambda v: (-seen[v], v))
            uneven = lambda n: -(-total[k] // 4) <= total[k] - n < -(-3 * total[k] // 4)  # noqa: B023, E731
            columns += [F.coalesce(F.col(c) == v, F.lit(False)).cast("double") if uneven(seen[v]) else None for v in labels]
            columns.append((~F.coalesce(F.col(c).isin(labels), F.lit(False))).cast("double") if uneven(seen[None]) else None)  # gaps, and what only other rows have
    return out


def _fullest(rows: DataFrame, column: str, folds: int, buckets: int = 64) -> list[int]:
    """Without each fold: no value of the column has more rows than this, the fullest bucket's of their hashes."""
    counts = rows.where(F.col(column).isNotNull()).groupBy("fold", F.pmod(F.xxhash64(column), F.lit(buckets)).alias("bucket")).agg(F.sum("_rows").alias("n")).collect()
    held = [Counter() for _ in range(folds)]
    for r in counts:
        for k in set(range(folds)) - {r["fold"]}:
            held[k][r["bucket"]] += r["n"]
    return [max(h.values(), default=0) for h in held]


def _repeated(rows: DataFrame, block: int = 65_536) -> DataFrame:
    """Each row ``_rows`` times, by blocks, so that no array grows with a row's number."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_rows") - 1) / block).cast("bigint"))))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(block).cast("bigint"), F.col("_rows") - F.col("_block") * block)))).drop("_block", "_copy")


LEARNERS = {
    "random_forest": lambda seed: RandomForestClassifier(numTrees=200, maxDepth=10, seed=seed), "decision_tree": lambda seed: DecisionTreeClassifier(maxDepth=15, seed=seed),
    "logistic": lambda seed: LogisticRegression(maxIter=50), "boosted": lambda seed: GBTClassifier(maxIter=20, seed=seed),
    "adaboost": lambda seed: AdaBoost(seed=seed),
}


def train_and_test(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], target: str, model: str | Estimator = "random_forest", seed: int = 42) -> DataFrame:
    """accuracy and macro_f1 of a model trained on one table and tested on another; labels that the test lacks are left out.

    ``model`` is a name of LEARNERS, perceptron, or an estimator of features, label and prediction.
    """
    cast = lambda df: df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("target"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    index = StringIndexer(inputCol="target", outputCol="label", handleInvalid="keep").fit(cast(test))
    rows = index.transform(cast(train)).where(F.col("label") < len(index.labels))  # by the indexer's labels: a join by label would bring all rows of one to one task
    prepared = Pipeline(stages=features(numeric, categorical)).fit(rows)
    if model == "perceptron":
        learner = perceptron([prepared.transform(rows.limit(1)).first()["features"].size, 20, len(index.labels) + 1], seed)
    else:
        learner = LEARNERS[model](seed) if isinstance(model, str) else model
    fitted = Pipeline(stages=[prepared, learner]).fit(rows)
    return label_summary(fitted.transform(index.transform(cast(test))), "label", "prediction").select("accuracy", "macro_f1")


def downstream(train: DataFrame, synthetic: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], target: str, model: str = "random_forest") -> DataFrame:
    """Rows trained_on (real, synthetic), accuracy, macro_f1 and the gap to real training."""
    both = [train_and_test(df, test, numeric, categorical, target, model).select(F.lit(name).alias("trained_on"), "*") for name, df in (("real", train), ("synthetic", synthetic))]
    rows = reduce(DataFrame.unionByName, both)
    best = both[0].select(F.col("accuracy").alias("_real"))
    return rows.join(F.broadcast(best)).select("trained_on", "accuracy", "macro_f1", (F.col("_real") - F.col("accuracy")).alias("gap"))  # one row


def ml_efficacy(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], target: str, kind: str) -> DataFrame:
    """score: mean score of all models that suit the target.

    A target with two values takes the binary classifiers (macro F1), a numerical one the linear
    regression (r2), a categorical one the classifiers of several classes.
    """
    two = test.where(F.col(target).isNotNull()).select(target).distinct().limit(3).count() == 2
    if kind == "numerical" and not two:
        return regression_efficacy(train, test, numeric, target).select(F.col("r2").alias("score"))
    if kind not in ("categorical", "boolean", "numerical"):
        raise ValueError(f"unsupported kind of target {kind!r}")
    models = ["decision_tree", "logistic", "adaboost", "perceptron"] if two else ["decision_tree", "perceptron"]
    each = [train_and_test(train, test, numeric, categorical, target, m).select(F.col("macro_f1").alias("score")) for m in models]
    return reduce(DataFrame.unionByName, each).agg(F.avg("score").alias("score"))


def parent_child_detection(real: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], key: str, foreign_key: str, numeric: list[str], categorical: list[str], model: str = "logistic") -> DataFrame:
    """``detection`` on the denormalised rows of a parent and a child table; model is logistic or svc."""
    return detection(*[denormalize(*pair, key, foreign_key) for pair in (real, synthetic)], numeric, categorical, model)


def regression_efficacy(train: DataFrame, test: DataFrame, numeric: list[str], target: str) -> DataFrame:
    """r2 of a linear regression trained on one table and tested on another."""
    model = Pipeline(stages=[*features(numeric, []), LinearRegression(labelCol=target)]).fit(train.where(F.col(target).isNotNull()))
    rows = model.transform(test.where(F.col(target).isNotNull()))
    mean = rows.agg(F.avg(target).alias("_m"))
    return rows.join(F.broadcast(mean)).agg((1 - F.try_divide(F.sum((F.col(target) - F.col("prediction")) ** 2), F.sum((F.col(target) - F.col("_m")) ** 2))).alias("r2"))


def perceptron(layers: list[int], seed: int = 0) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=layers, maxIter=50, seed=seed)
