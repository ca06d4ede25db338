"""Edge cases of operators that the queries over the given tables don't reach."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from fidelis.operators import bit_repair as R
from fidelis.operators import columns as C
from fidelis.operators import distances as D
from fidelis.operators import flows as FL
from fidelis.operators import learned as L
from fidelis.operators import membership as M
from fidelis.operators import mitigation as MI
from fidelis.operators import quality as Q
from fidelis.operators import sets as S
from fidelis.operators import tables as T
from fidelis.operators import text_sets as X
from fidelis.operators import topology as G
from fidelis.operators.tagged import tagged
from fidelis.streaming import sessions


def both(spark, real, synthetic, ddl="x double"):
    name = ddl.split()[0]
    make = lambda v: spark.createDataFrame([(x,) for x in v], ddl)
    return tagged(make(real), make(synthetic), [name]), [name]


def brute_emd(a, b):
    grid = sorted({*a, *b})
    cdf = lambda v, x: sum(y <= x for y in v) / len(v)
    return sum(abs(cdf(a, x) - cdf(b, x)) * (y - x) for x, y in zip(grid, grid[1:], strict=False))


def test_wasserstein_is_brute_force(spark):
    rng = random.Random(2)
    a, b = [rng.gauss(0, 1) for _ in range(300)], [round(rng.gauss(0.3, 2), 1) for _ in range(200)]
    row = D.wasserstein(*both(spark, a, b)).first()
    assert math.isclose(row["emd"], brute_emd(a, b), rel_tol=1e-9)
    assert math.isclose(row["ks"], max(abs(sum(y <= x for y in a) / 300 - sum(y <= x for y in b) / 200) for x in a + b), rel_tol=1e-9)


@pytest.mark.parametrize(("real", "synthetic", "want"), [([1.0], [1.0], 0.0), ([1.0, None], [3.0], 2.0), ([2.0, 2.0], [2.0], 0.0)])
def test_wasserstein_edges(spark, real, synthetic, want):
    assert D.wasserstein(*both(spark, real, synthetic)).first()["emd"] == want


def test_empty_sides_give_null_or_nothing(spark):
    frame, names = both(spark, [1.0, 2.0], [])
    assert D.wasserstein(frame, names).first()["emd"] is None
    assert C.statistic_similarity(frame, names).first()["score"] is None
    assert C.boundary_adherence(frame, names).collect() == []
    none, names = both(spark, [], [])
    assert D.wasserstein(none, names).collect() == [] and D.jsd(none, names).collect() == []


def test_constant_columns_give_null(spark):
    frame, names = both(spark, [3.0, 3.0], [3.0])
    for f in (C.range_coverage, C.statistic_similarity):
        assert f(frame, names).first()["score"] is None
    pairs = tagged(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double"), spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double"), ["a", "b"])
    assert C.correlation_similarity(pairs, [("a", "b")]).first()["score"] is None


def test_shares(spark):
    frame, names = both(spark, ["a", "a", "b"], ["c"], "x string")
    assert math.isclose(D.jsd(frame, names).first()["jsd"], math.sqrt(math.log(2)))
    assert math.isclose(C.tv_complement(frame, names).first()["score"], 0, abs_tol=1e-5)
    assert C.category_coverage(frame, names).first()["score"] == 0
    assert D.categorical_emd(both(spark, ["a"], ["a"], "x string")[0], ["x"]).first()["emd"] == 0


def test_chi_square_score(spark):
    # One degree of freedom: p = erfc(sqrt(statistic / 2)); two: exp(-statistic / 2).
    for real, synthetic, k in ((["a"] * 6 + ["b"] * 4, ["a"] * 3 + ["b"] * 7, 1), (["a", "b", "c"], ["a", "a", "b"], 2)):
        frame, names = both(spark, real, synthetic, "x string")
        stat, got = C.chi_square(frame, names).first()["statistic"], C.chi_square_score(frame, names).first()["score"]
        assert math.isclose(got, math.erfc(math.sqrt(stat / 2)) if k == 1 else math.exp(-stat / 2), rel_tol=1e-6)
    assert C.chi_square_score(*both(spark, ["a"], ["a"], "x string")).first()["score"] == 1


def test_discretized(spark):
    frame, _ = both(spark, [0.0, 10.0], [-1.0, 0.0, 0.99, 5.0, 9.99, 10.0, 11.0, None])
    got = [r["x"] for r in C.discretized(frame, ["x"]).where("side = 'synthetic'").collect()]
    assert got == [0, 1, 1, 6, 10, 11, 11, 11]


def test_new_rows_is_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.choice("ab"), rng.choice([0.0, -5.0, None, rng.uniform(-300, 300), rng.uniform(100, 103)]), rng.choice([1.0, 2.0, None])) for _ in range(n)]
    real, fake = make(150), make(200)
    near = lambda r, s: (r is None and s is None) or (r is not None and s is not None and abs(r - s) <= 0.01 * abs(s))
    want = sum(not any(r[0] == s[0] and near(r[1], s[1]) and near(r[2], s[2]) for r in real) for s in fake)
    ddl = "k string, x double, y double"
    assert S.new_rows(spark.createDataFrame(real, ddl), spark.createDataFrame(fake, ddl), ["k"], ["x", "y"]).count() == want
    assert S.new_row_synthesis(spark.createDataFrame(real, ddl), spark.createDataFrame([], ddl), ["k"], ["x"]).first()["score"] is None


def test_extraction_counts_occurrences(spark):
    frame, names = both(spark, ["a", "b", "b", None], ["a", "a", "z"], "x string")
    row = S.extraction_scores(frame, names).first()
    assert (round(row["precision"], 6), row["recall"]) == (0.666667, 0.5)


def test_topology_of_loops_and_duplicates(spark):
    flows = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("c", "c"), (None, "a")], "s string, d string")
    e = G.edges_of(flows, "s", "d")
    assert {r["node"]: r["degree"] for r in G.node_degrees(e).collect()} == {"a": 3, "b": 3}
    assert [tuple(r) for r in G.undirected_edges(e).collect()] == [("a", "b", 3)]
    row = G.compare(e, e.where("false")).first()
    assert (row["common_nodes"], row["nodes_rate"], row["degree_emd"]) == (0, 0.0, None)
    assert [r["d"] for r in G.rank_top(flows.where("s is not null"), ["s"], "d", 1).orderBy("s").collect()] == ["b", "a", "c"]


def test_chunks_with_a_hot_instant(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 5.0, id / 100) t")
    got = [r["position"] for r in FL.global_positions(rows, "t", "id", 16).orderBy("t", "id").collect()]
    assert got == list(range(3000))
    gap = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 10.0)], "id bigint, t double")
    assert [r["chunk"] for r in FL.fixed_time_chunks(gap, "t", 5).orderBy("id").collect()] == [0, 0, 1]
    assert FL.fixed_size_chunks(gap.where("false"), "t", "id", 3).collect() == []


def test_flow_tags_and_series(spark):
    flows = spark.createDataFrame([("f", 0, [1, 0, 1]), ("g", 1, [0, 1, 0])], "flow string, chunk int, flags array<int>")
    got = sorted((r["flow"], r["chunk"], r["starts"]) for r in FL.propagate_flow_tags(flows, "chunk", "flags").collect())
    assert got == [("f", 0, True), ("f", 2, False), ("g", 1, True)]
    packets = spark.createDataFrame([("f", 0, 1.5), ("f", 1, 2.5), ("g", 0, 3.0)], "flow string, i int, x double")
    series = FL.padded_series(packets, ["flow"], ["i"], ["x"], 3)
    assert {r["flow"]: (r["x"], r["present"]) for r in series.collect()} == {"f": ([1.5, 2.5, 0.0], [1.0, 1.0, 0.0]), "g": ([3.0, 0.0, 0.0], [1.0, 0.0, 0.0])}
    assert sorted(tuple(r) for r in FL.denormalize_series(series, ["flow"], ["x"]).collect()) == [("f", 0, 1.5), ("f", 1, 2.5), ("g", 0, 3.0)]
    r = FL.autocorrelation(packets, ["flow"], ["i"], "x", 3)
    assert FL.autocorrelation_distance(r, r).first()["score"] == 0


def test_membership_scores(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert M.membership_auc(df, "y", "s").first()["auc"] == 0.875
    assert M.membership_ks(df, "y", "s").first()["ks"] == 0.5
    assert M.membership_tpr(df, "y", "s", 0.0).first()["tpr"] == 0.5
    assert M.membership_auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_cap_without_common_keys(spark):
    real, fake = spark.createDataFrame([("a", "x", 1)], "k string, j string, v int"), spark.createDataFrame([("b", "x", 1), ("c", "y", 2)], "k string, j string, v int")
    assert M.cap(real, fake, ["k"], ["v"]).first()["score"] == 0
    assert M.cap(real, fake, ["k"], ["v"], zero=True).first()["score"] == 1
    assert M.generalized_cap(real, fake, ["k", "j"], ["v"]).first()["score"] == 0  # (b, x) is the nearest key
    assert M.generalized_cap(real, fake, ["k"], ["v"]).first()["score"] == 0.5


def test_votes_and_logs(spark):
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, "b"), (2, "d"), (2, "c")], "id int, v string")
    assert {r["id"]: r["v"] for r in M.majority(votes, ["id"], "v").collect()} == {1: "a", 2: "c"}
    lines = spark.createDataFrame([("sample=a.png, loss=0.5, grad_norm=2",), ("junk",)], "value string")
    assert [tuple(r) for r in M.scores_from_log(lines).collect()] == [("a.png", 0.5, 2.0)]
    pixels = spark.createDataFrame([(1, 1, 3), (1, 200, 10)], "id int, a int, b int")
    assert M.reconstruction_mse(pixels, ["id"], "a", "b", wrapped=True).first()["loss"] == 4.0
    assert M.reconstruction_mse(pixels, ["id"], "a", "b").first()["loss"] == (4 + 190**2) / 2


def test_noise(spark):
    df = spark.range(4000).selectExpr("id % 3 f", "cast(64 as int) ttl", "cast(id as double) time", "cast(id % 7 as int) tos", "cast(id as int) ip_id", "cast(0 as int) window")
    out = MI.add_noise(df, "f", epsilon=60.0, seed=5)
    assert out.where("ttl < 1 or ttl > 255 or tos < 0").count() == 0
    assert out.collect() == MI.add_noise(df, "f", epsilon=60.0, seed=5).collect()
    wide = spark.range(20_000).select(MI.laplace(F.lit(1.0), 3).alias("x")).agg(F.stddev_samp("x").alias("s"), F.avg("x").alias("m")).first()
    assert abs(wide["s"] - math.sqrt(2)) < 0.05 and abs(wide["m"]) < 0.05
    sens = {r["f"]: r["sens_ttl"] for r in MI.sensitivities(df, "f", MI.HEADER_FIELDS).collect()}
    assert set(sens.values()) == {254.0}


def test_pseudonyms_are_consistent(spark):
    df = spark.createDataFrame([("1.1.1.1", "2.2.2.2", "aa:bb:cc:dd:ee:ff"), ("2.2.2.2", "1.1.1.1", None)], "s string, d string, m string")
    a, b = MI.pseudonymize(df, ["s", "d"], ["m"], "key").collect()
    assert a["s"] == b["d"] and a["d"] == b["s"] and a["s"] != a["d"] and b["m"] is None
    assert MI.pseudonymize(df, ["s", "d"], ["m"], "other").first()["s"] != a["s"]
    assert MI.coarsen(df, ["s"], ["m"]).first()[:3] == ("1.1.0.0", "2.2.2.2", "aa:bb:cc:00:00:00")


def test_bit_repair(spark):
    rows = [("f", i, i % 2 == 0, [0, -1] * 8, [-1] * 16, [0] * 8, 100 + i, 10) for i in range(4)]
    df = spark.createDataFrame(rows, "flow string, idx int, forward boolean, ip_id array<int>, tl array<int>, ttl array<int>, seq bigint, segment bigint")
    fixed = R.repair(df, 3).orderBy("idx").collect()
    assert all(set(r["ip_id"]) <= {0, 1} and set(r["tl"]) <= {0, 1} and r["ttl"] == [0] * 7 + [1] and r["dfbit"] == [1] for r in fixed)
    number = lambda bits: int("".join(map(str, bits)), 2)
    assert all(40 <= number(r["tl"]) <= 1500 for r in fixed) and number(fixed[2]["ip_id"]) == number(fixed[0]["ip_id"]) + 1
    seq = [(r["seq"], r["ack"]) for r in R.sequence_numbers(df).orderBy("idx").collect()]
    assert seq == [(100, 0), (101, 110), (110, 111), (111, 120)]
    flags = [(r["syn"], r["ackf"]) for r in R.handshake_flags(df).orderBy("idx").collect()]
    assert flags == [(1, 0), (1, 1), (0, 1), (0, 1)]
    walk = R.sample_directions(spark.createDataFrame([("a",), ("b",)], "flow string"), 0.5, 0.5, 40, 1)
    assert walk.count() == 80 and walk.collect() == R.sample_directions(spark.createDataFrame([("a",), ("b",)], "flow string"), 0.5, 0.5, 40, 1).collect()
    turns = R.transition_matrix(spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 2, "a"), ("f", 3, "a")], "flow string, idx int, src_ip string"))
    assert {(r["from"], r["to"]): r["p"] for r in turns.collect()} == {("a", "b"): 0.5, ("a", "a"): 0.5, ("b", "a"): 1.0}
    kinds = spark.createDataFrame([("f", [1, 0], [-1, -1])], "flow string, tcp array<int>, udp array<int>")
    assert R.dominant_protocol(kinds, {"TCP": "tcp", "UDP": "udp"}).first()["protocol"] == "TCP"


def test_metadata_and_reports(spark):
    old = T.TableMetadata.from_dict({"fields": {"id": {"type": "id"}, "x": {"type": "numerical"}, "name": {"type": "categorical", "pii": True}, "p": {"type": "id", "ref": {"table": "t", "field": "id"}}}, "primary_key": "id", "alternate_keys": [["x2"], "x3"]})
    assert old.select("numerical", "categorical") == ["x"] and old.foreign_keys == {"p": ("t", "id")} and old.alternate_keys == ("x2", "x3")
    df = spark.createDataFrame([(1.0, "a", datetime.date(2024, 1, 1)), (2.0, "b", None)], "x double, c string, d date")
    assert T.TableMetadata.infer(df).kinds == {"x": "numerical", "c": "categorical", "d": "datetime"}
    with pytest.raises(ValueError, match="same columns"):
        T.validate(df, df.drop("x"), T.TableMetadata.infer(df))
    meta = T.TableMetadata({"x": "numerical", "c": "categorical"})
    report = Q.quality_report(df.drop("d"), df.drop("d"), meta)
    assert {r["score"] for r in report.collect()} == {1.0}
    verdicts = {r["property"]: r["verdict"] for r in Q.diagnostic_report(df.drop("d"), df.drop("d"), meta).collect()}
    assert verdicts == {"Coverage": "SUCCESS", "Boundaries": "SUCCESS", "Synthesis": "DANGER"}
    x = lambda v, lo, hi, goal: spark.range(1).select(Q.normalize(F.lit(v), lo, hi, goal).alias("n")).first()["n"]
    inf = math.inf
    assert x(3.0, 1.0, 5.0, Q.Goal.MAXIMIZE) == 0.5 and x(1.0, 1.0, 5.0, Q.Goal.MINIMIZE) == 1.0
    assert math.isclose(x(0.0, -inf, inf, Q.Goal.MAXIMIZE), 0.5) and x(0.0, 0.0, inf, Q.Goal.MAXIMIZE) == 0.0 and x(0.0, -inf, 0.0, Q.Goal.MAXIMIZE) == 1.0


def test_learned(spark):
    real = spark.range(300).selectExpr("cast(id % 10 as double) x", "if(id % 2 = 0, 'a', 'b') c", "cast(id % 2 as string) y")
    same = L.detection(real, real, ["x"], ["c"], folds=2).first()["score"]
    far = L.detection(real, real.withColumn("x", F.col("x") + 100), ["x"], ["c"], folds=2).first()["score"]
    assert same > 0.7 and far < 0.1
    rows = {r["trained_on"]: r for r in L.downstream(real, real, real, ["x"], ["c"], "y", "decision_tree").collect()}
    assert rows["synthetic"]["accuracy"] == 1.0 and rows["synthetic"]["gap"] == 0
    line = spark.range(50).selectExpr("cast(id as double) x", "cast(2 * id + 1 as double) y")
    assert L.regression_efficacy(line, line, ["x"], "y").first()["r2"] > 0.999
    points = spark.createDataFrame([(random.Random(i).gauss(0, 1), random.Random(1000 + i).gauss(0, 1)) for i in range(200)], "x double, y double")
    assert L.mixture_log_likelihood(points, points, ["x", "y"], 2).first()["score"] > L.mixture_log_likelihood(points, points.selectExpr("x + 9 as x", "y"), ["x", "y"], 2).first()["score"]


def test_text_sets(spark):
    rows = spark.range(300).selectExpr("id", "concat('l', id % 2) label")
    split = X.split_by_class(rows, "label", 100, 0.95, 1).groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in split} == {("l0", "train"): 95, ("l0", "test"): 5, ("l1", "train"): 95, ("l1", "test"): 5}
    texts = spark.createDataFrame([("1 255 <|pkt|> 300 x",)], "t string")
    assert X.encode_bytes(texts, "t", 7).first()["ids"] == [1, 255, 256, -1, -1, 257, 257]
    prompts = spark.createDataFrame([("make web packet", "r1"), ("make web packet", "r0")], "p string, r string")
    assert X.responses_by_label(prompts, "p", "r").first()[:] == ("web", ["r0", "r1"])
    assert X.instructions(prompts, "Do: ", "p", "r").first()["instruction"] == "Do: make web packet"
    assert X.field_questions(prompts, {"ttl": "What is the TTL?"}, 1).first()[:] == ("What is the TTL?", "<ttl>")


def test_sessions_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0, s), "f", 10) for s in (0, 5, 50)], "at timestamp, flow string, size int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sessions.windowed_counts(stream, "at", ["flow"], "10 seconds").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["packets"] for r in spark.table("counts").collect()) == [1, 2]
    assert sorted(r["packets"] for r in sessions.flow_sessions(rows, "at", ["flow"], "size").collect()) == [1, 2]
