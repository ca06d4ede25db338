"""Learners that ``pyspark.ml`` lacks: kernel machines by random features, boosted stumps, logistic regression by aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Fourier(Transformer):
    """Adds ``to``: sqrt(2 / D) cos(w x + b) for each of D rows of ``waves`` and ``shifts``, a vector."""

    def __init__(self, at: str, to: str, waves: np.ndarray, shifts: np.ndarray):
        super().__init__()
        self.at, self.to, self.waves, self.shifts = at, to, waves, shifts

    def _transform(self, df: DataFrame) -> DataFrame:
        number = lambda v: f"{float(v)!r}D"
        waves = F.expr("array(" + ", ".join(f"named_struct('w', array({', '.join(map(number, w))}), 'b', {number(b)})" for w, b in zip(self.waves, self.shifts, strict=True)) + ")")
        dot = lambda w, x: F.aggregate(F.zip_with(w, x, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
        scale = F.lit(math.sqrt(2 / max(1, len(self.shifts))))
        # The inner lambda holds the row's array, so it is unpacked once.
        wide = F.transform(F.array(vector_to_array(self.at)), lambda x: F.transform(waves, lambda k: scale * F.cos(dot(k["w"], x) + k["b"])))[0]
        return df.withColumn(self.to, array_to_vector(wide))


class FourierFeatures(Estimator):
    """Random Fourier features of a radial kernel exp(-gamma |x - y|^2): inner products of them approximate the kernel.

    ``gamma`` None is 1 / (number of features * variance of all their values), as kernel machines
    commonly have it. Equal seeds give equal features. ``weight`` names a column that says how many rows a row stands for.
    """

    def __init__(self, at: str = "features", to: str = "fourier", size: int = 200, gamma: float | None = None, seed: int = 0, weight: str | None = None):
        super().__init__()
        self.at, self.to, self.size, self.gamma, self.seed, self.weight = at, to, size, gamma, seed, weight

    def _fit(self, df: DataFrame) -> _Fourier:
        x = vector_to_array(self.at)
        times = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        total = lambda f: F.sum(times * F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v)))
        row = df.agg(F.sum(times).alias("n"), F.max(F.size(x)).alias("d"), total(lambda v: v).alias("one"), total(lambda v: v * v).alias("two")).first()
        d = row["d"] or 1
        spread = (row["two"] or 0) / max(1, (row["n"] or 0) * d) - ((row["one"] or 0) / max(1, (row["n"] or 0) * d)) ** 2
        gamma = self.gamma if self.gamma is not None else 1 / (d * (spread if spread > 1e-12 else 1.0))
        rng = np.random.default_rng(self.seed)
        return _Fourier(self.at, self.to, rng.normal(0, math.sqrt(2 * gamma), (self.size, d)), rng.uniform(0, 2 * math.pi, self.size))


def kernel_machine(at: str = "features", to: str = "fourier", size: int = 200, seed: int = 0, **how) -> Pipeline:
    """A support vector machine with a radial kernel: random Fourier features, then a linear machine."""
    return Pipeline(stages=[FourierFeatures(at, to, size, seed=seed), LinearSVC(featuresCol=to, maxIter=50, **how)])


def logistic_by_steps(df: DataFrame, at: list[str], label: str, weight: str, steps: int = 50, tolerance: float = 1e-8) -> list[float]:
    """Intercept and slopes of the logistic regression of ``label`` (0 or 1) on the columns ``at``, without a penalty, by Newton's steps.

    A step is one aggregate of rows * rows of ``at``, so no pass keeps vectors. Steps end when the next
    one would lower the loss of a row by less than ``tolerance``; of columns that depend on each other
    the shortest slopes are taken. Labels that a plane parts have no finite slopes: the steps end as the loss vanishes.
    """
    size = len(at) + 1
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    rows = df.select(F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(at, 1)])
    times = lambda i: f" * _x{i}" if i else ""

    def sums(slopes: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Rows, loss, its falling gradient and its curvature."""
        local = df.sparkSession.sql("SELECT * FROM VALUES (" + ", ".join(f"DOUBLE('{float(b)!r}')" for b in slopes) + ") AS s(" + ", ".join(f"_s{i}" for i in range(size)) + ")")
        # Slopes are columns of one row, not literals, so that the same code runs at each step.
        told = rows.join(F.broadcast(local)).selectExpr("*", " + ".join(["_s0", *[f"_s{i} * _x{i}" for i in range(1, size)]]) + " AS _at")
        told = told.selectExpr("*", "EXP(-ABS(_at)) AS _far").selectExpr("*", "1 / (1 + _far) AS _q")
        told = told.selectExpr("*", "_w * (_y - IF(_at >= 0, _q, _far * _q)) AS _g", "_w * _far * _q * _q AS _h")
        row = told.selectExpr("SUM(_w)", "SUM(_w * (LN(1 + _far) + GREATEST(_at, 0) - _y * _at))", *[f"SUM(_g{times(i)})" for i in range(size)], *[f"SUM(_h{times(i)}{times(j)})" for i, j in pairs]).first()
        row = [float(v or 0) for v in row]
        curve = np.zeros((size, size))
        for (i, j), v in zip(pairs, row[2 + size :], strict=True):
            curve[i, j] = curve[j, i] = v
        return row[0], row[1], np.array(row[2 : 2 + size]), curve

    slopes, step, best = np.zeros(size), np.zeros(size), math.inf
    for _ in range(steps):
        n, loss, down, curve = sums(slopes)
        if not (math.isfinite(loss) and np.isfinite(down).all() and np.isfinite(curve).all()):  # endless numbers teach nothing
            break
        if loss > best * (1 + 1e-9):  # too far: half of the step
            step = step / 2
            slopes = slopes - step
            continue
        best = loss
        scale = np.sqrt(np.diag(curve))
        scale = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
        step = scale * np.linalg.lstsq(curve * np.outer(scale, scale), down * scale, rcond=1e-10)[0]
        slopes = slopes + step
        if down @ step <= tolerance * max(n, 1):
            break
    return [float(b) for b in slopes]


class _Stumps(Model):
    """Votes of stumps: (feature, threshold, label at or below it, label above it, vote)."""

    def __init__(self, stumps: list[tuple[int, float, float, float, float]], labels: list[float], at: str, to: str):
        super().__init__()
        self.stumps, self.labels, self.at, self.to = stumps, labels, at, to

    def said(self, x: Column, stump: tuple) -> Column:
        feature, threshold, low, high, _ = stump
        return F.lit(low) if feature < 0 else F.when(F.get(x, F.lit(feature)) <= threshold, low).otherwise(high)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(self.at)
        votes = [sum((F.when(self.said(x, s) == label, s[4]).otherwise(0.0) for s in self.stumps), F.lit(0.0)) for label in self.labels]
        best = F.greatest(*votes) if len(votes) > 1 else votes[0]
        out = F.coalesce(*[F.when(v == best, label) for v, label in zip(votes, self.labels, strict=True)])
        return df.withColumn(self.to, out if self.labels else F.lit(None).cast("double"))


class AdaBoost(Estimator):
    """Boosted stumps (the multi-class form with one vote a stump): each round fits a stump to weighted rows.

    A round's vote is ln((1 - e) / e) + ln(K - 1) for its weighted error e of K labels, and rows that it
    missed gain exp(vote) in weight. A stump without error ends the rounds, as does one that is no
    better than chance. Weights are a column expression of the stumps so far, not a growing plan.
    """

    def __init__(self, rounds: int = 50, at: str = "features", label: str = "label", to: str = "prediction", seed: int = 0):
        super().__init__()
        self.rounds, self.at, self.label, self.to, self.seed = rounds, at, label, to, seed

    def _fit(self, df: DataFrame) -> _Stumps:
        rows = df.select(self.at, F.col(self.label).cast("double").alias(self.label)).persist()
        try:
            labels = sorted(r[0] for r in rows.select(self.label).distinct().collect())  # a label for each class
            model, k = _Stumps([], labels, self.at, self.to), len(labels)
            x, missed = vector_to_array(self.at), F.lit(0.0)
            for _ in range(self.rounds if k > 1 else 0):
                weighed = rows.withColumn("_w", F.exp(missed))
                tree = DecisionTreeClassifier(maxDepth=1, featuresCol=self.at, labelCol=self.label, weightCol="_w", seed=self.seed).fit(weighed)
                stump = _root(tree)
                wrong = F.sum(F.when(model.said(x, (*stump, 0.0)) != F.col(self.label), F.col("_w")).otherwise(0.0)) / F.sum("_w")
                error = weighed.agg(wrong.alias("e")).first()["e"]
                if error >= 1 - 1 / k - 1e-12:
                    if not model.stumps:
                        model.stumps.append((*stump, 1.0))
                    break
                if error <= 1e-12:
                    model.stumps.append((*stump, 1.0))
                    break
                vote = float(f"{math.log((1 - error) / error) + math.log(k - 1):.12g}")
                model.stumps.append((*stump, vote))
                missed = missed + F.when(model.said(x, model.stumps[-1]) != F.col(self.label), vote).otherwise(0.0)
            if k == 1:
                model.stumps.append((-1, 0.0, labels[0], labels[0], 1.0))
            return model
        finally:
            rows.unpersist()


def _root(tree) -> tuple[int, float, float, float]:
    """Feature, threshold and the labels on both sides of a fitted tree of depth one; -1 without a split."""
    node = tree._java_obj.rootNode()
    if tree.numNodes == 1:
        return -1, 0.0, node.prediction(), node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), node.leftChild().prediction(), node.rightChild().prediction()
