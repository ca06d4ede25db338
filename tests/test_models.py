"""Fitted models and long series against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.functions import vectors as V
from fidelis.operators import flows as FL
from fidelis.operators import histograms as H
from fidelis.operators import learned as L
from fidelis.operators import membership as M
from fidelis.operators import mixture as MX
from fidelis.operators.learners import AdaBoost
from fidelis.operators.tagged import tagged
from fidelis.operators.transformer import HyperTransformer


def plain_steps(x, means, variances, weights, steps):
    """Diagonal expectation maximisation with numpy on standardised rows."""
    for t in range(steps + 1):
        logs = np.log(weights) - 0.5 * (np.log(2 * np.pi * variances).sum(1) + ((x[:, None] - means) ** 2 / variances).sum(2))
        z = np.logaddexp.reduce(logs, axis=1)
        if t == steps:
            return means, variances, weights, z.mean()
        r = np.exp(logs - z[:, None])
        n = r.sum(0)
        means = r.T @ x / n[:, None]
        variances = np.maximum(r.T @ x**2 / n[:, None] - means**2, MX.FLOOR)
        weights = n / len(x)


def blobs(seed, n=240, gaps=False):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal((0, 0), (1, 2), (n // 3, 2)), rng.normal((9, 5), 0.5, (n // 3, 2)), rng.normal((-7, 30), (2, 0.3), (n // 3, 2))])
    return [(float(a), None if gaps and i % 11 == 0 else float(b)) for i, (a, b) in enumerate(x)]


def test_mixture_steps_are_plain_ones(spark):
    rows = blobs(1, gaps=True)
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    (model,) = MX.fit(df, ["x", "y"], 3, starts="spread", steps=6, tolerance=0)
    x = np.array([[a, np.nan if b is None else b] for a, b in rows])
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    s = (x - x.mean(0)) / x.std(0)
    k = np.arange(3)[:, None]
    start = s.min(0) + (k + 0.5) / 3 * (s.max(0) - s.min(0))
    means, variances, weights, ll = plain_steps(s, start, np.ones((3, 2)), np.full(3, 1 / 3), 6)
    assert np.allclose(model.means, means, atol=1e-7) and np.allclose(model.weights, weights, atol=1e-7)
    assert np.allclose([c.diagonal() for c in model.covariances], variances, atol=1e-7)
    assert math.isclose(model.log_likelihood, ll - np.log(x.std(0)).sum(), abs_tol=1e-7)
    assert math.isclose(model.bic, -2 * model.log_likelihood * len(x) + (2 + 12) * np.log(len(x)), rel_tol=1e-12)


def test_mixture_does_not_depend_on_parts_and_never_fails(spark):
    scores = set()
    for parts in (1, 7, 40):
        df = spark.createDataFrame(blobs(2), "x double, y double").repartition(parts).coalesce(parts)
        scores.add(round(MX.mixture_log_likelihood(df, df, ["x", "y"], 3, seed=4, iterations=1).first()["score"], 9))
    assert len(scores) == 1
    rng = random.Random(8)
    for seed in range(6):  # rows that repeat, constant columns, fewer rows than components
        rows = [(float(rng.randint(0, 2)), 5.0 if seed % 2 else rng.gauss(0, 1)) for _ in range([1, 2, 5, 60][seed % 4])]
        df = spark.createDataFrame(rows, "x double, y double").coalesce(1)
        for full in (False, True):
            models = MX.fit(df, ["x", "y"], 3, full=full, seed=seed, steps=8)
            assert models and all(math.isfinite(m.log_likelihood) for m in models)


def test_mixture_finds_the_number_of_components(spark):
    df = spark.createDataFrame(blobs(3), "x double, y double").coalesce(2)
    models = MX.fit(df, ["x", "y"], (1, 4), steps=30)
    assert len(MX.best_of(models).weights) == 3
    rows = MX.selection(models, spark).collect()
    assert [r["components"] for r in rows if r["chosen"]] == [3]
    far = df.select(F.col("x") + 50, "y").toDF("x", "y")
    score = MX.score(MX.best_of(models), df).first()["score"]
    assert math.isclose(score, MX.best_of(models).log_likelihood, abs_tol=1e-6) and score > 5 + MX.score(MX.best_of(models), far).first()["score"]
    empty = df.where("false")
    assert MX.mixture_log_likelihood(empty, df, ["x", "y"], 2).first()["score"] is None
    assert MX.mixture_log_likelihood(df, empty, ["x", "y"], 2, steps=2, iterations=1).first()["score"] is None


def test_full_covariances_follow_a_tilted_cloud(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(x + e)) for x, e in zip(a, rng.normal(size=300) / 10, strict=True)], "x double, y double").coalesce(2)
    (thin,), (full,) = (MX.fit(df, ["x", "y"], 1, full=f) for f in (False, True))
    assert full.log_likelihood > thin.log_likelihood + 1
    assert abs(full.covariances[0, 0, 1]) > 0.9


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_lag_products_are_brute_force(spark, block):
    rng = np.random.default_rng(block)
    series = {"a": rng.normal(size=200), "b": rng.normal(size=33), None: np.ones(6), "c": np.zeros(1), "d": rng.normal(size=64)}
    rows = spark.createDataFrame([((k,), i + 1, float(v)) for k, x in series.items() for i, v in enumerate(x)], "flow struct<k: string>, i int, x double").repartition(3)
    for most in (None, 1, 10, 90):
        got = {(r["flow"]["k"], r["lag"]): r["ab"] for r in FL.lag_products(rows, most, block).collect()}
        want = {(k, lag): float(x[:-lag] @ x[lag:]) for k, x in series.items() for lag in range(1, len(x)) if most is None or lag <= most}
        assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], abs_tol=1e-9) for g in want)


def test_products_of_long_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=5000)
    rows = spark.createDataFrame([("f", i + 1, float(v)) for i, v in enumerate(x)], "flow string, i int, x double")
    for block in (2000, 8192):
        got = {r["lag"]: r["ab"] for r in FL.lag_products(rows, block=block).collect()}
        assert sorted(got) == list(range(1, 5000))
        assert all(math.isclose(got[k], float(x[:-k] @ x[k:]), abs_tol=1e-8) for k in (1, 2, 1999, 2000, 2001, 4096, 4999))


def test_nearest_rows_are_filled(spark):
    rng = random.Random(5)
    make = lambda n: [(i, rng.choice(["a", "b", "c", None]), rng.choice(["u", None])) for i in range(n)]
    points, model = make(30), make(12)
    ddl = "id bigint, x string, y string"
    got: dict = {}
    for r in M.nearest_rows(spark.createDataFrame(points, ddl), spark.createDataFrame(model, ddl), ["x", "y"], 8, fill=True).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["model_id"], r["equal"]))
    for i, *p in points:
        equal = [(j, sum(a == b and a is not None for a, b in zip(p, q, strict=True))) for j, *q in model]
        assert got[i] == sorted(equal, key=lambda x: (-x[1], x[0]))[:8]


def test_automatic_bins_are_numpys(spark):
    rng = np.random.default_rng(7)
    columns = {"even": rng.uniform(0, 5, 400), "skewed": rng.lognormal(0, 2, 333), "flat": np.concatenate([np.zeros(90), [1.0, 5.0]]), "one": np.full(5, 2.5), "few": np.array([1.0, 9.0])}
    rows = [(k, float(x)) for k, xs in columns.items() for x in xs] + [("even", None), ("none", None)]
    got = {r["field"]: r for r in H.automatic_bins(spark.createDataFrame(rows, "field string, value double").repartition(3)).collect()}
    assert got.keys() == columns.keys()
    for k, x in columns.items():
        edges = max((np.histogram_bin_edges(x, bins=rule) for rule in ("fd", "sturges")), key=len)
        assert (got[k]["bins"], got[k]["low"], got[k]["high"]) == (len(edges) - 1, edges[0], edges[-1]), k
    whole = spark.createDataFrame([("w", float(v)) for v in rng.integers(0, 4, 500)], "field string, value double")
    assert H.automatic_bins(whole, ["w"]).first()["bins"] == 3


def test_continuous_divergence_is_plain(spark):
    rng = np.random.default_rng(8)
    p, q = rng.normal(0, 1, 300), rng.normal(0.5, 2, 280)
    real, fake = (spark.createDataFrame([(float(v), 1.0) for v in x], "a double, b double") for x in (p, q))
    got = {r["field"]: r["score"] for r in H.continuous_jsd(tagged(real, fake, ["a", "b"]), ["a", "b"]).collect()}
    edges = max((np.histogram_bin_edges(p, bins=rule) for rule in ("fd", "sturges")), key=len)
    a, b = (np.histogram(x, edges)[0].astype(float) for x in (p, q))
    a, b = a / a.sum(), b / b.sum()
    m = (a + b) / 2
    kl = lambda x: sum(v * math.log(v / w) for v, w in zip(x, m, strict=True) if v)
    assert math.isclose(got["a"], (kl(a) + kl(b)) / 2, rel_tol=1e-9) and got["b"] == 0
    beyond = H.continuous_jsd(tagged(real, fake.withColumn("a", F.lit(99.0)), ["a"]), ["a"]).first()
    assert beyond["score"] is None
    assert H.continuous_jsd(tagged(real.where("false"), fake, ["a"]), ["a"]).collect() == []


def test_transformer_by_kinds(spark):
    df = spark.sql("select * from values (1, 2.0d, true, 'x', timestamp'2020-01-01 00:00:01', null), (3, null, true, null, null, date'2020-01-02'), (null, 4.0d, false, 'y', timestamp'2020-01-01 00:00:03', date'2020-01-04'), (null, 4.0d, null, 'x', null, null) as t(i, f, b, c, t, d)")
    fitted = HyperTransformer().fit(df)
    again = HyperTransformer(fitted.table(spark))
    out = again.transform(df)
    assert out.columns == ["i", "f", "b", "c=x", "c=y", "c", "t", "d"]
    rows = [tuple(r) for r in out.collect()]
    day = 86_400 * 10**9
    new_year = 1577836800 * 10**9
    assert [r[0] for r in rows] == [1, 3, 2, 2] and rows[1][1] == 10 / 3 and [r[2] for r in rows] == [1, 1, 0, 1]
    assert [r[3:6] for r in rows] == [(1, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)]
    assert [r[6] - new_year for r in rows] == [1e9, 2e9, 3e9, 2e9] and [r[7] - new_year for r in rows] == [2 * day, day, 3 * day, 2 * day]
    other = df.withColumn("c", F.lit("new"))
    assert {tuple(r)[3:6] for r in again.transform(other, "ignore").collect()} == {(0, 0, 0)}
    with pytest.raises(Exception, match="without the value new"):
        again.transform(other).collect()
    empty = HyperTransformer().fit(df.where("false"))
    assert empty.transform(df, "ignore").columns == ["i", "f", "b", "t", "d"] and empty.table(spark).count() == 6
    with pytest.raises(ValueError, match="more than"):
        HyperTransformer().fit(df, most_values=2)


def test_two_rounds_of_stumps_by_hand(spark):
    from pyspark.ml.feature import VectorAssembler

    xs, ys = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [1, 1, 1, 0, 0, 0, 1, 1, 1, 0]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(float(x), float(y)) for x, y in zip(xs, ys, strict=True)], "x double, label double").coalesce(1))
    model = AdaBoost(rounds=2).fit(df)
    w = np.ones(10)
    for feature, threshold, low, high, vote in model.stumps:
        assert feature == 0
        said = np.array([low if x <= threshold else high for x in xs])
        wrong = said != ys
        error = w[wrong].sum() / w.sum()
        assert math.isclose(vote, math.log((1 - error) / error), rel_tol=1e-9)
        w = w * np.exp(vote * wrong)
    assert len(model.stumps) == 2 and model.stumps[0] != model.stumps[1]
    more = AdaBoost(rounds=30).fit(df).transform(df).where("label <> prediction").count()
    assert more < model.transform(df).where("label <> prediction").count()
    assert AdaBoost().fit(df.where("label = 1")).transform(df).where("prediction = 1").count() == 10


def test_kernels_tell_rings_apart(spark):
    rng = np.random.default_rng(3)
    ring = lambda r, n: [(float(r * math.cos(a)), float(r * math.sin(a))) for a in rng.uniform(0, 2 * math.pi, n)]
    inner, outer = (spark.createDataFrame(ring(r, 250), "x double, y double").coalesce(1) for r in (1.0, 3.0))
    score = {m: L.detection(inner, outer, ["x", "y"], [], m, folds=2).first()["score"] for m in ("svc", "linear")}
    assert score["svc"] < 0.2 < 0.6 < score["linear"]


def test_forest_finds_nearest_words(spark):
    rng = np.random.default_rng(6)
    words = rng.normal(size=(1500, 8))
    rows = words[::5] + rng.normal(0, 0.6, (300, 8))
    w = spark.createDataFrame([(f"w{i:04}", [float(x) for x in v]) for i, v in enumerate(words)] + [("none", [0.0] * 8)], "word string, vector array<double>")
    r = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(999, None), (1000, [0.0] * 8)], "id bigint, vector array<double>")
    got = {x["id"]: (x["word"], x["cosine"]) for x in V.nearest_words(r, w).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit(rows) @ unit(words).T
    assert set(got) <= set(range(300)) and all(math.isclose(c, cos[i, int(word[1:])], abs_tol=1e-9) for i, (word, c) in got.items())
    assert np.mean([got.get(i, ("", 0))[0] == f"w{cos[i].argmax():04}" for i in range(300)]) >= 0.9
    few = V.nearest_words(r, w.limit(3)).collect()  # one leaf: exact
    assert len(few) == 300
    assert V.nearest_words(r, w.where("false")).collect() == [] == V.nearest_words(r.where("false"), w).collect()
