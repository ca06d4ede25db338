"""Operators that were wrong or cut short before, against brute force."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from fidelis.operators import bit_repair as R
from fidelis.operators import columns as C
from fidelis.operators import membership as M
from fidelis.operators import sets as S
from fidelis.operators.tagged import tagged

SIZES = {32: (2, 4), 24: (3, 3), 16: (4, 2), 40: (5, 10), 80: (8, 10)}


def options(bits, fill):
    """What the walk over option bits gives, byte by byte."""
    bits, left, at = list(bits), [0, 8, 32, 24, 16, 40, 80], 0
    byte = lambda n: [int(c) for c in f"{n:08b}"]
    while at < 320:
        run = next((i for i in range(at, 320) if bits[i] == -1), 320) - at
        near = min(left, key=lambda x: abs(x - run))
        if near in SIZES:
            data = [fill[i] if bits[i] == -1 else bits[i] for i in range(at + 16, min(at + near, 320))]
            bits[at : min(at + near, 320)] = (byte(SIZES[near][0]) + byte(SIZES[near][1]) + data)[: 320 - at]
            left.remove(near)
            at += near
        elif near == 8 and bits[at] == 1:
            bits[at : at + 8] = byte(1)
            at += 8
        elif near == 8:
            left.remove(8)
            bits[at : at + 8] = [-1] * 8 if at == 0 else byte(0)
            if at:
                bits[at + 8 :] = [-1] * (320 - at - 8)
                break
            at += 8
        else:
            bits[at : at + 8] = [-1] * 8
            at += 8
    return bits


def test_tcp_options(spark):
    rng = random.Random(4)
    rows = [[-1] * 320, [0] * 320, [1] * 320]
    for _ in range(60):
        row = []
        while len(row) < 320:
            row += [rng.choice([0, 1]) for _ in range(rng.choice([4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 60, 80, 7]))] + [-1] * rng.choice([0, 0, 1, 8])
        rows.append(row[:320])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(99, None)], "i int, b array<int>")
    got = {r["i"]: (r["o"], r["f"]) for r in df.select("i", R.tcp_options(F.col("b"), 3).alias("o"), R.fill_missing_bits(F.col("b"), 3).alias("f")).collect()}
    assert got[99][0] is None
    for i, row in enumerate(rows):
        assert got[i][0] == options(row, got[i][1]), i


def test_ports_and_shares(spark):
    rows = spark.createDataFrame([("f", True, "a"), ("f", False, "b"), ("g", True, None), ("g", True, "a")], "flow string, forward boolean, src_ip string")
    ports = R.flow_ports(rows, 1).where("flow = 'f'").collect()
    assert (ports[0]["src_port"], ports[0]["dst_port"]) == (ports[1]["dst_port"], ports[1]["src_port"])
    assert {r["address"]: round(r["share"], 6) for r in R.address_shares(rows).collect()} == {"a": 0.666667, "b": 0.333333}


def test_nearest_rows_is_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(i, *[rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(3)]) for i in range(n)]
    points, model = make(40), make(90)
    ddl = "id bigint, x string, y string, z string"
    got: dict = {}
    for r in M.nearest_rows(spark.createDataFrame(points, ddl), spark.createDataFrame(model, ddl), ["x", "y", "z"], 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["model_id"], r["equal"]))
    for i, *p in points:
        equal = [(j, sum(a == b and a is not None for a, b in zip(p, q, strict=True))) for j, *q in model]
        assert got.get(i, []) == sorted([x for x in equal if x[1]], key=lambda x: (-x[1], x[0]))[:4]


@pytest.mark.parametrize("gaps", [False, True])
def test_spearman_is_brute_force(spark, gaps):
    rng = random.Random(3)
    rows = [(i % 2, float(rng.randint(0, 9)), None if gaps and i % 7 == 0 else rng.gauss(0, 1), float(rng.randint(0, 3))) for i in range(200)]
    frame = spark.createDataFrame(rows, "s int, a double, b double, c double")
    both = tagged(frame.where("s = 0"), frame.where("s = 1"), ["a", "b", "c"])
    got = {r["pair"]: r["score"] for r in C.correlation_similarity(both, [("a", "b"), ("a", "c"), ("b", "c")], "spearman").collect()}
    import pandas as pd

    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        r = [pd.DataFrame([q[1:] for q in rows if q[0] == side], columns=["a", "b", "c"])[[x, y]].dropna().rank().corr().iloc[0, 1] for side in (0, 1)]
        assert abs(got[f"{x}|{y}"] - (1 - abs(r[0] - r[1]) / 2)) < 1e-9


def test_new_rows_is_brute_force(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 0.0, -3.0, 3.0, 1.0, 1.0099, 0.99, rng.uniform(0.9, 1.1), rng.uniform(-3.1, -2.9)])
    make = lambda n: [(rng.choice(["p", None]), value(), value()) for _ in range(n)]
    real, synthetic = make(150), make(150)
    near = lambda r, s: r is None and s is None or r is not None and s is not None and abs(r - s) <= 0.01 * abs(s)
    want = [s for s in synthetic if not any(r[0] == s[0] and near(r[1], s[1]) and near(r[2], s[2]) for r in real)]
    ddl = "k string, x double, y double"
    got = S.new_rows(spark.createDataFrame(real, ddl), spark.createDataFrame(synthetic, ddl), ["k"], ["x", "y"]).collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got) == order(want)


def test_score_of_constant_and_empty_sides(spark):
    for real, synthetic in product(([1.0, 2.0], [], [None]), ([], [None])):
        make = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
        both = tagged(make(real), make(synthetic), ["x"])
        for f in (C.range_coverage, C.interval_overlap, C.statistic_similarity):
            assert all(r["score"] is None for r in f(both, ["x"]).collect())
