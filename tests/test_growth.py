"""Steps whose work or memory in one task once grew faster than the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.functions import codecs as K
from fidelis.functions import packets as P
from fidelis.functions import vectors as V
from fidelis.operators import bit_repair as R
from fidelis.operators import columns as C
from fidelis.operators import learned as L
from fidelis.operators import membership as M
from fidelis.operators import topology as G
from fidelis.operators.tagged import running, tagged
from fidelis.sources import pcap


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_headers_compute_their_digits_once(spark):
    rows = spark.createDataFrame([("10.0.0.9", "1.2.3.255", "TCP", 7, 80, 24)], "s string, d string, p string, sp int, dp int, n int")
    df = rows.select(P.header_bytes(*map(F.col, rows.columns)).alias("h"))
    assert plan(df).count("split(") == 2  # one for each address
    digits = df.first()["h"][28:68]
    assert sum(int(digits[i : i + 4], 16) for i in range(0, 40, 4)) % 65535 == 0
    tokens = rows.select(P.bytes_to_tokens(F.unhex(F.lit("00ff0a"))).alias("t"))
    assert tokens.first()["t"] == "0 255 10" and plan(tokens).count("hex(unhex") == 1


def test_bits_are_encoded_once_for_all_places(spark):
    codec = K.Bits(32)
    df = spark.range(3).select(codec.decode(codec.encode(F.col("id") * 1431655765)).alias("v"))
    assert plan(df).count("flatten(") == 1
    assert [r["v"] for r in df.collect()] == [0, 1431655765, 2863311530]


def test_options_are_found_in_texts(spark):
    df = spark.createDataFrame([([1] * 80 + [-1] * 240,)], "b array<int>").select(R.tcp_options(F.col("b"), 2).alias("o"))
    assert "array_position(" not in plan(df)
    got = df.first()["o"]
    assert got[:16] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0] and got[16:80] == [1] * 64 and got[80:] == [-1] * 240


@pytest.fixture(scope="module")
def packets(spark):
    head = P.header_bytes(F.lit("10.0.0.9"), F.lit("10.0.0.1"), F.when(F.col("id") % 3 == 0, "UDP").otherwise("TCP"), F.col("id"), F.lit(80), F.lit(24))
    return spark.range(500).select(F.when(F.col("id") == 499, "one").otherwise("big").alias("file"), (F.lit(1000) - F.col("id")).alias("t"), F.concat(F.unhex(head), F.lit(bytes(20))).alias("data"))


def test_a_large_capture_is_written_and_read_by_many_tasks(spark, packets, tmp_path):
    folder = f"{tmp_path}/caps"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # as few rows would be one range
    told = {r["path"].rsplit("/", 1)[-1]: r["packets"] for r in pcap.write(packets, folder, "file", ["t"], "data", "t", cut=True).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert told == {"big.pcap": 499, "one.pcap": 1} and len(list((tmp_path / "caps" / "big.pcap").iterdir())) > 1
    back = pcap.read(spark, folder)
    assert back.rdd.getNumPartitions() > 2
    rows = sorted((r["packet"], r["time_us"]) for r in back.where("file like '%/big.pcap'").collect())
    assert rows == [(i, 502 + i) for i in range(499)]
    assert pcap.read(spark, f"{folder}/one*.pcap").count() == 1


def test_pieces_of_a_capture_join_to_its_text(spark, packets, tmp_path):
    pcap.write(packets, f"{tmp_path}/caps", "file", ["t"], "data", "t", cut=True).collect()
    back = pcap.read(spark, f"{tmp_path}/caps")
    pieces = sorted((r["part"], r["packets"], r["text"]) for r in pcap.byte_parts(back, size=100).where("file like '%/big.pcap'").collect())
    assert [n for _, n, _ in pieces] == [100, 100, 100, 100, 99]
    assert [" <|pkt|> ".join(t for *_, t in pieces)] == [r["text"] for r in pcap.byte_tokens(back).collect()]


def test_rows_of_one_key_go_straight_to_their_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("k"), (F.col("id") * 7 % 1000).alias("v"), F.lit(1.0).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = running(df, ["k"], "v", "n", cuts=8)
        assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1  # the ranges' totals
        rows = {(r["k"], r["v"]): (r["cum"], r["after"]) for r in running(df, ["k"], "v", "n", cuts=8, whole=200).collect()}
        assert rows == {(r["k"], r["v"]): (r["cum"], r["after"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k in "ab":
        own = sorted(v for key, v in rows if key == k)
        assert [rows[k, v] for v in own] == [(i + 1.0, nxt) for i, nxt in enumerate([*own[1:], None])]


def test_medians_come_from_running_counts(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 9.0), (0, 2.0), (0, 2.0), (0, None), (1, 5.0), (1, 1.0), (1, 4.0), (1, 8.0)], "s int, x double")
    out = C.statistic_similarity(tagged(df.where("s = 0"), df.where("s = 1"), ["x"]), ["x"], "median")
    assert "percentile(" not in plan(out)
    assert abs(out.first()["score"] - (1 - 2.5 / 8)) < 1e-12


def test_training_rows_are_not_joined_by_their_label(spark, monkeypatch):
    rows = spark.range(60).selectExpr("cast(id as double) x", "if(id % 2 = 0, 'p', 'q') c", "if(id > 50, 'odd', if(id > 25, 'up', 'down')) y")
    joined, real = [], type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda self, other, on=None, how=None: joined.append(how) or real(self, other, on, how))
    score = L.train_and_test(rows, rows.where("y <> 'odd'"), ["x"], ["c"], "y", "decision_tree").first()
    assert "left_semi" not in joined and score["accuracy"] == 1.0


def test_leaves_hand_on_no_pairs(spark):
    vector = F.array(*[F.sin(F.col("id") * k) for k in (1, 7, 29)]).alias("vector")
    words = spark.range(400).select(F.concat(F.lit("w"), F.format_string("%03d", "id")).alias("word"), vector)
    copies = spark.range(400, 700).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.array(*map(F.lit, (1.0, 0.0, 0.0))).alias("vector"))
    rows = spark.range(350, 420).select(F.col("id"), vector)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = V.nearest_words(rows, words.union(copies))
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    told = {r["id"]: (r["word"], r["cosine"]) for r in got.collect()}
    assert all(told[i] == (f"w{i}", 1.0) for i in range(350, 400)) and set(told) == set(range(350, 420))
    cut = V.nearest_words(rows, words.union(copies), most=20)  # most leaves in chunks
    assert {r["id"]: (r["word"], r["cosine"]) for r in cut.collect()} == told
    assert V.nearest_words(copies.selectExpr("word id", "vector"), copies, most=20).groupBy("word", "cosine").count().collect() == [("w400", 1.0, 300)]


def test_more_edges_are_counted_by_more_tasks(spark, monkeypatch):
    edges = spark.range(2000).selectExpr("if(id % 2 = 0, 'hub', concat('n', id % 50)) src", "concat('m', id % 300) dst")
    parts, real = [], type(edges).repartition
    monkeypatch.setattr(type(edges), "repartition", lambda self, n, *keys: parts.append(n) or real(self, n, *keys))
    rows = [[tuple(r) for r in G.compare(edges, edges.where("dst <> 'm8'"), 3).collect()]]
    monkeypatch.setattr(G, "PART_ROWS", 100, raising=False)
    rows.append([tuple(r) for r in G.compare(edges, edges.where("dst <> 'm8'"), 3).collect()])
    assert min(parts) == 4 and max(parts) == 40
    nodes, pairs = 1 + 25 + 300, 150 + 150
    assert rows[0] == rows[1] and rows[0][0][:4] == (nodes - 1, (nodes - 1) / nodes, pairs - 1, (pairs - 1) / pairs)


def test_more_rows_are_detected_by_more_tasks(spark, monkeypatch):
    rows = spark.range(800).selectExpr("id", "cast(id * 37 % 101 + if(id % 2 = 0, 9, 0) as double) x", "if(id % 3 = 0, 'p', 'q') c").coalesce(1)
    parts, real = [], type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, n, *keys: parts.append(n) or real(self, n, *keys))
    score = lambda: L.detection(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["x"], ["c"], folds=2).first()["score"]
    few = score()
    monkeypatch.setattr(L, "PART_ROWS", 50, raising=False)
    assert abs(score() - few) < 1e-6 and 0 < few < 1 and parts == [1, 16]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@pytest.fixture(scope="module")
def mixed(spark):
    """4,000 rows in two copies: a number with gaps and ties, a number mostly equal, frequent and rare categories with gaps."""
    one = spark.range(4000).selectExpr(
        "id", "if(id % 11 = 0, null, cast(id * 7919 % 1009 as double) + if(id % 2 = 0, 90, 0)) x", "cast(if(id % 5 = 0, id % 2 + 1, 0) as double) y", "if(id % 7 = 0, null, element_at(array('p', 'q', 'r'), cast(1 + id * 31 % 3 as int))) c"
    )
    return one.unionAll(one)


def test_detection_counts_equal_rows_once_and_is_exact(spark, mixed, monkeypatch):
    kept, real = [], type(mixed).persist
    monkeypatch.setattr(type(mixed), "persist", lambda self, *how: kept.append(self) or real(self, *how))
    score = L.detection(mixed.where("id % 2 = 0"), mixed.where("id % 2 = 1"), ["x", "y"], ["c"], folds=2).first()["score"]
    assert kept[0].count() <= 4000 and kept[0].agg(F.sum("_rows")).first()[0] == 8000
    label = F.lit(1.0) - F.col("id") % 2
    rows = mixed.select(label.alias("label"), "x", "y", "c").withColumn("fold", F.pmod(F.xxhash64(F.lit(0), "label", "x", "y", "c"), F.lit(2))).collect()
    aucs = []
    for k in (0, 1):
        train, test = [r for r in rows if r["fold"] != k], [r for r in rows if r["fold"] == k]
        mean = np.mean([r["x"] for r in train if r["x"] is not None])
        at = lambda told: np.array([[1.0, ((r["x"] if r["x"] is not None else mean) - mean) / 300, *[float(r["c"] == v) for v in "pqr"]] for r in told])  # noqa: B023, E731
        x, y, b = at(train), np.array([r["label"] for r in train]), np.zeros(5)
        for _ in range(12):
            p = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p), rcond=1e-10)[0]
        said, y = np.round(at(test) @ b, 12), np.array([r["label"] for r in test])
        wins = (said[y == 1][:, None] > said[y == 0]).mean() + (said[y == 1][:, None] == said[y == 0]).mean() / 2
        aucs.append(max(0.5, wins))
    assert abs(score - (1 - np.mean([2 * a - 1 for a in aucs]))) < 2e-6 and score < 0.95


@pytest.mark.parametrize("scaled", [True, False])
def test_counted_rows_give_the_columns_of_the_pipeline(mixed, scaled):
    rows = mixed.select((F.col("id") % 2 == 0).cast("tinyint").alias("label"), F.pmod("id", F.lit(3)).cast("int").alias("fold"), "x", "y", "c")
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_rows"))
    for k, (both, columns) in enumerate(L._prepared(counted, ["x", "y"], ["c"], 3, scaled)):
        train = rows.where(F.col("fold") != k)
        fitted = L.Pipeline(stages=L.features(["x", "y"], ["c"])).fit(train)
        told = fitted.transform(counted).select(L.vector_to_array("features").alias("v"), F.array(*[F.lit(0.0) if c is None else c for c in columns]).alias("w")).collect()
        v, w = np.array([r["v"] for r in told]), np.array([r["w"] for r in told])
        if scaled:
            assert v.shape == w.shape and np.allclose(v, w, rtol=5e-3)  # quartiles of the pipeline are approximate
        else:
            used = [i for i in range(v.shape[1]) if v[:, i].any()]
            assert used == [i for i, c in enumerate(columns) if c is not None]
            assert all(np.ptp(w[:, i]) > 0 and abs(np.corrcoef(v[:, i], w[:, i])[0, 1] - 1) < 1e-9 for i in used)
        assert both and columns[1] is None  # most of y is 0


def test_the_auc_of_counted_rows_is_that_of_all_rows(spark):
    rows = spark.range(3000).selectExpr("id % 2 label", "cast(id * 37 % 211 + id % 2 as double) score", "1 + id % 4 n")
    each = rows.selectExpr("label", "score", "explode(sequence(1, n)) i")
    exact = M.membership_auc(each, "label", "score").first()["auc"]
    assert abs(M.counted_auc(rows, "label", "score", "n") - exact) < 1e-12 and abs(M.counted_auc(rows, "label", "score", "n", 5) - exact) < 1e-12
    assert M.counted_auc(rows.where("label = 1"), "label", "score", "n") is None and M.counted_auc(rows.where("false"), "label", "score", "n") is None
    assert L._repeated(rows.withColumnRenamed("n", "_rows"), 3).count() == each.count()


def test_a_kernel_machine_sees_equal_rows_once(spark, monkeypatch):
    one = spark.range(240).selectExpr("id", "cos(id) * if(id % 2 = 0, 1, 3) x", "sin(id) * if(id % 2 = 0, 1, 3) y")
    rows = one.unionAll(one).unionAll(one).coalesce(1)
    kept, real = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, *how: kept.append(self) or real(self, *how))
    assert L.detection(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["x", "y"], [], "svc", folds=2).first()["score"] < 0.2
    scored = [k for k in kept if "score" in k.columns]
    assert len(scored) == 2 and sum(k.count() for k in scored) == 240  # the waves of a row are computed once for both passes over its score
    assert not spark.sparkContext._jsc.getPersistentRDDs()
