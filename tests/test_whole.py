"""Operators whose work was cut before: their whole job against closed forms and brute force."""

import math

import numpy as np
import pytest

from fidelis.operators import columns as C
from fidelis.operators import flows as FL
from fidelis.operators import membership as M
from fidelis.operators import quality as Q
from fidelis.operators import tables as T
from fidelis.operators.tagged import tagged


def counted(spark, real, synthetic):
    frame = lambda counts: spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], "x string")
    return tagged(frame(real), frame(synthetic), ["x"]), ["x"]


@pytest.mark.parametrize("q", [1, 10, 40, 500])
def test_a_synthetic_only_category_scores_0(spark, q):
    """Its share of the real rows is 1e-6 of one row: no match, however large the statistic."""
    both = counted(spark, {"a": 500, "b": 500}, {"a": 500, "b": 500 - q, "c": q})
    assert C.chi_square(*both).first()["statistic"] > 800
    assert C.chi_square_score(*both).first()["score"] < 1e-100


@pytest.mark.parametrize("freedom", [1, 2, 3, 4, 7, 40, 41])
@pytest.mark.parametrize("statistic", [0.3, 2.0, 9.0, 45.0, 120.0, 700.0])
def test_chi_square_scores_are_the_closed_sums(spark, monkeypatch, freedom, statistic):
    x = statistic / 2
    if freedom % 2:
        want = math.erfc(math.sqrt(x)) + sum(math.exp((k + 0.5) * math.log(x) - x - math.lgamma(k + 1.5)) for k in range(freedom // 2))
    else:
        want = sum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(freedom // 2))
    monkeypatch.setattr(C, "chi_square", lambda *_: spark.createDataFrame([("x", statistic, freedom)], "field string, statistic double, freedom bigint"))
    assert math.isclose(C.chi_square_score(None, ["x"]).first()["score"], want, rel_tol=1e-9, abs_tol=1e-12)


def test_chi_square_scores_of_many_categories(spark, monkeypatch):
    """Near its mean a statistic of many degrees of freedom is near normal (Wilson and Hilferty)."""
    rows = [(str(z), 20_000 * (1 - 2 / 180_000 + z * math.sqrt(2 / 180_000)) ** 3, 20_000) for z in (-2, -0.2, 0.0, 0.02, 0.2, 2)]
    monkeypatch.setattr(C, "chi_square", lambda *_: spark.createDataFrame(rows, "field string, statistic double, freedom bigint"))
    for r in C.chi_square_score(None, ["x"]).collect():
        assert math.isclose(r["score"], math.erfc(float(r["field"]) / math.sqrt(2)) / 2, abs_tol=1e-4)


def test_autocorrelation_of_whole_flows(spark):
    """All lags up to the longest flow's length less two, against numpy on padded series."""
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(5, 2, 40), "b": rng.normal(size=31), None: rng.normal(size=12), "c": np.ones(40), "d": np.ones(3), "e": np.zeros(1)}
    packets = spark.createDataFrame([(k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)], "flow string, i int, x double").repartition(3)
    got = {r["lag"]: r["r"] for r in FL.autocorrelation(packets, ["flow"], ["i"], "x").collect()}
    assert sorted(got) == list(range(1, 39))
    for lag, r in got.items():
        each = []
        for xs in series.values():
            x = np.pad(xs, (0, 40 - len(xs)))
            a, b = x[: 40 - lag], x[lag:]
            each.append(np.corrcoef(a, b)[0, 1] if np.ptp(a) and np.ptp(b) else 1e-8)
        assert math.isclose(r, np.mean(each), abs_tol=1e-9), lag


def test_diagnostic_report_takes_all_synthetic_rows(spark):
    real = spark.range(10).selectExpr("cast(id as double) x", "'a' c")
    fake = spark.range(12_000).selectExpr("cast(id % 10 as double) x", "if(id < 1, 'new', 'a') c")
    meta = T.TableMetadata({"x": "numerical", "c": "categorical"})
    score = lambda **k: {r["property"]: r["score"] for r in Q.diagnostic_report(real, fake, meta, **k).collect()}["Synthesis"]
    assert score() == 1 / 12_000 and score(sample=100) in (0, 0.01)


def test_generalized_cap_is_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = lambda n, high: [tuple(map(str, (*rng.integers(0, high, 3), rng.integers(0, 3)))) for _ in range(n)]
    real, fake = rows(60, 9) + [("x", "y", "z", "1"), ("x", "y", "z", "8")], rows(50, 7)
    chance = []
    for *k, v in real:
        far = [sum(a != b for a, b in zip(k, f, strict=False)) for f in fake]
        near = [f[3] for f, d in zip(fake, far, strict=True) if d == min(far)]
        chance.append(near.count(v) / len(near))
    frame = lambda x: spark.createDataFrame(x, "a string, b string, c string, v string")
    got = M.generalized_cap(frame(real), frame(fake), ["a", "b", "c"], ["v"])
    assert math.isclose(got.first()["score"], 1 - np.mean(chance), rel_tol=1e-9)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
