"""Composed runs over files, time-series and multi-table reports, attacks with models, word vectors."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fidelis import runs
from fidelis.functions import packets as P
from fidelis.functions import vectors as V
from fidelis.operators import attacks as AT
from fidelis.operators import flows as FL
from fidelis.operators import learned as L
from fidelis.operators import quality as Q
from fidelis.operators import series as SR
from fidelis.operators import tables as T
from fidelis.operators import text_sets as X
from fidelis.sources import pcap


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Flow and packet files, bit files, instructions and generated lines of two sides."""
    top = tmp_path_factory.mktemp("files")
    for side, shift in (("real", 0), ("fake", 1)):
        (top / side / "web_1").mkdir(parents=True)
        rows = [f"{16909060 + (i + shift) % 5},{84281096 + i % 3},{1000 + i % 4 + shift},443,TCP,{i},{40 + i + shift},0,{60 + i % 3}" for i in range(20)]
        (top / side / "web_1" / "flows.csv").write_text("srcip,dstip,srcport,dstport,proto,time,pkt_len,tos,ttl\n" + "\n".join(rows) + "\n")
        head = "Timestamp,Src IP,Dst IP,Src Port,Dst Port,Protocol,Packet Size,pkt_len,TTL,IP ID,IP Type of Service,TCP Window Size,TCP Data Offset,TCP Flags"
        (top / side / "packets.csv").write_text(head + "\n" + "\n".join(f"{i}.5,1.1.1.{(i + shift) % 4},2.2.2.{i % 2},{1000 + i},80,TCP,{60 + i},{60 + i},{64 - shift},{i},0,500,5,{'SA' if i % 2 else 'A'}" for i in range(12)) + "\n")
        (top / side / "agg.csv").write_text("Src IP,Dst IP,Src Port,Dst Port,Protocol,Total Packets,Total Bytes,MAC Src,MAC Dst\n" + "\n".join(f"1.1.1.{i + shift},2.2.2.{i % 2},1,2,TCP,{i},{100 * i},aa:{i + shift},bb:{i}" for i in range(5)) + "\n")
        (top / side / "bits.csv").write_text("src_ip,ipv4_ttl_1,ipv4_ttl_0\n1.1.1.1,0,1\n1.1.1.1,1," + str(shift) + "\n1.1.1.1,-1,-1\n")
    (top / "real" / "rows.json").write_text('{"instruction": "x", "output": "{\'src\': \'1.1.1.1\', \'dst\': \'2.2.2.2\'} aabbccddeeff112233445566"}\n')
    (top / "fake" / "lines.txt").write_text("{'src': '1.1.1.1', 'dst': '9.9.9.9'} aabbccddeeff112233445566\n\n")
    (top / "real" / "bytes.json").write_text('{"Data": "<|web|> 1 2 3 4 <|pkt|> 5 6 7 8", "Hash": "h", "Filename": "f", "OrigLen": 4}\n')
    (top / "fake" / "bytes.txt").write_text("<|web|> 1 2 9 9 <|pkt|> 7 7 7 7\n")
    return top


def test_fidelity_runs(spark, folder):
    got = {r["field"]: r for r in runs.fidelity_of_flows(spark, f"{folder}/real/web_1/*.csv", f"{folder}/fake/web_1/*.csv").collect()}
    assert got["proto"]["jsd"] == 0 and got["srcport"]["jsd"] > 0 and math.isclose(got["Overall"]["emd"], sum(got[c]["emd"] for c in runs.FLOW_COLUMNS) / 5)
    got = {r["field"]: r for r in runs.fidelity_of_packets(spark, f"{folder}/real/packets.csv", f"{folder}/fake/packets.csv", n=4).collect()}
    assert set(got) == {*runs.PACKET_COLUMNS, "Overall"} and got["Dst IP"]["jsd"] == 0


def test_identifier_runs(spark, folder):
    got = {r["field"]: r for r in runs.identifiers_of_flows(spark, f"{folder}/real/web_1/*.csv", f"{folder}/fake/web_1/*.csv").collect()}
    assert got["srcip"]["common"] == 5
    pair = [f"{folder}/{s}/packets.csv" for s in ("real", "fake")] + [f"{folder}/{s}/agg.csv" for s in ("real", "fake")]
    got = {r["field"]: r["common"] for r in runs.identifiers_of_packets(spark, *pair).collect()}
    assert got == {"Src IP": 4, "Dst IP": 2, "MAC Src": 4, "MAC Dst": 5}
    got = {r["field"]: r["common"] for r in runs.identifiers_of_texts(spark, f"{folder}/real/rows.json", f"{folder}/fake/lines.txt").collect()}
    assert got == {"ip_src": 1, "ip_dst": 0, "mac_src": 1, "mac_dst": 1}


def test_topology_and_property_runs(spark, folder):
    flow, agg, packets, bits = ([f"{folder}/{s}/{n}" for s in ("real", "fake")] for n in ("web_1/*.csv", "agg.csv", "packets.csv", "bits.csv"))
    assert runs.topology_of_packets(spark, *flow).first()["common_nodes"] == 8
    assert runs.topology_of_flows(spark, *agg, top_k=2).first()["common_edges"] == 0
    assert runs.property_of_flows(spark, *flow, "pkt_len").first()["emd_of_range"] == pytest.approx(1 / 20)
    got = {r["field"]: r["emd_of_range"] for r in runs.properties_of_packets(spark, *packets, *agg).collect()}
    assert set(got) == {*runs.PROPERTIES, "Total Bytes"} and got["TTL"] == 1 and got["IP ID"] == 0
    assert runs.property_of_bits(spark, *bits, "ipv4_ttl").first()["field"] == "ipv4_ttl"


def test_extraction_runs(spark, folder):
    row = runs.extraction_of_bytes(spark, f"{folder}/real/bytes.json", f"{folder}/fake/bytes.txt", 0, 2).first()
    assert (row["precision"], row["recall"]) == (0.5, 0.5)
    row = runs.extraction_of_addresses(spark, f"{folder}/real/rows.json", f"{folder}/fake/lines.txt").first()
    assert (row["precision"], row["recall"]) == (1, 1)
    row = runs.extraction_of_fingerprints(spark, *[f"{folder}/{s}/bits.csv" for s in ("real", "fake")], "ipv4_ttl").first()
    assert (row["precision"], row["recall"]) == (0.5, 0.5)


def test_capture_runs(spark, folder, tmp_path):
    header = P.header_bytes(F.lit("10.0.0.1"), F.col("dst"), F.lit("TCP"), F.lit(1000), F.lit(80), F.lit(24))
    rows = spark.range(6).selectExpr("id", "concat('10.0.0.', id % 3) dst").select("id", F.unhex(header).alias("data"), F.lit("one").alias("file"), (F.col("id") * 1000).alias("t"))
    assert pcap.write(rows, f"{tmp_path}/caps", "file", ["id"], "data", "t").collect()[0]["packets"] == 6
    got = pcap.read(spark, f"{tmp_path}/caps").orderBy("packet").collect()
    assert [(r["src_ip"], r["dst_ip"], r["dst_port"], r["ttl"], r["total_length"]) for r in got][:2] == [("10.0.0.1", "10.0.0.0", 80, 64, 40), ("10.0.0.1", "10.0.0.1", 80, 64, 40)]
    zeroed = F.concat(F.substring(F.hex("header"), 29, 20), F.lit("0000"), F.substring(F.hex("header"), 53, 16))
    assert pcap.read(spark, f"{tmp_path}/caps").where(P.ipv4_checksum(zeroed) != F.col("checksum")).count() == 0
    freq = {(r["kind"], r["address"]): r["frequency"] for r in runs.frequencies_of_captures(spark, f"{tmp_path}/caps").collect()}
    assert freq["ip", "10.0.0.1"] == 8 and freq["mac", "00:00:00:00:00:00"] == 12
    runs.features_of_captures(spark, f"{tmp_path}/caps", f"{tmp_path}/out")
    runs.features_of_captures(spark, f"{tmp_path}/caps", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/flows").count() == 3
    packets = pcap.read(spark, f"{tmp_path}/caps")
    assert {r["src_ip"] for r in runs.one_identity(packets).collect()} == {"0.0.0.0"}
    assert {r["src_ip"] for r in runs.coarse_identities(packets).collect()} == {"10.0.0.0"}.union({"10.0.0.0"})
    assert len({r["dst_ip"] for r in runs.masked_identities(packets, "k").collect()}) == 3
    feats = runs.membership_features(spark, f"{folder}/real/web_1/*.csv").first()
    assert feats["Label"] == "web" and feats["packet_count"] == 20 and feats["proto_TCP"] == 1


def flows_of(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 9), "TCP" if rng.random() < 0.7 else "UDP", float(i), rng.gauss(10, 3), i) for i in range(n)]
    return spark.createDataFrame(rows, "flow int, proto string, time double, size double, id int")


def test_series_report(spark):
    real, fake = flows_of(spark, 1), flows_of(spark, 2)
    lines = [SR.SeriesMetric("attribute", ("proto",)), SR.SeriesMetric("feature", ("size",)), SR.SeriesMetric("session_length"), SR.SeriesMetric("interarrival"), SR.SeriesMetric("attribute_feature", ("proto", "size")), SR.SeriesMetric("coverage", ("proto",)), SR.SeriesMetric("range", ("size",)), SR.SeriesMetric("autocorrelation", ("size",))]
    kinds = {"proto": "categorical", "size": "numerical"}
    same = SR.series_report(real, real, ["flow"], "time", ["time", "id"], kinds, lines).collect()
    assert all(math.isclose(r["score"], r["best"], abs_tol=1e-9) for r in same) and [r["metric"] for r in same] == [m.kind for m in lines]
    other = {r["metric"]: r["score"] for r in SR.series_report(real, fake, ["flow"], "time", ["time", "id"], kinds, lines[:4]).collect()}
    assert all(v > 0 for v in other.values())
    with pytest.raises(ValueError, match="all categorical"):
        SR.distribution_similarity(real, ["proto", "size"], kinds)


def test_candidates(spark):
    real = spark.createDataFrame([(c, float(t), float(t)) for c in (0, 1) for t in range(10 * c, 10 * c + 10)], "chunk int, time double, x double")
    rows = [(c, n, float(t), float(t) + (5 if (n == "a") == (c == 0) else 0)) for c in (0, 1) for n in "ab" for t in range(10 * c - 3, 10 * c + 13)]
    best = SR.best_candidates(spark.createDataFrame(rows, "chunk int, name string, time double, x double"), real, "chunk", "name", ["x"], "time")
    assert {(r["chunk"], r["name"], r["n"]) for r in best.groupBy("chunk", "name").agg(F.count("*").alias("n")).collect()} == {(0, "b", 10), (1, "a", 10)}
    assert SR.in_time_range(best, real.where("chunk = 0"), "time").count() == 10


def test_multi_table_reports(spark):
    parent = spark.range(30).selectExpr("id", "if(id % 3 = 0, 'a', 'b') kind")
    child = spark.range(90).selectExpr("id", "id % 30 parent", "cast(id % 7 as double) x")
    meta = {"p": T.TableMetadata({"id": "id", "kind": "categorical"}, "id"), "c": T.TableMetadata({"id": "id", "parent": "numerical", "x": "numerical"}, "id")}
    relation = Q.Relation("p", "id", "c", "parent")
    tables = {"p": parent, "c": child}
    assert Q.without_references(meta, [relation])["c"].select("numerical") == ["x"]
    got = {(r["property"], r["table"]): r["score"] for r in Q.multi_table_quality(tables, tables, meta, [relation]).collect()}
    assert got["Parent Child Relationships", "c"] == 1 and got["Column Shapes", "p"] == pytest.approx(1)
    verdicts = {r["property"]: (r["score"], r["verdict"]) for r in Q.multi_table_diagnostic(tables, tables, meta, [relation]).collect()}
    assert verdicts["Synthesis"] == (0, "DANGER") and verdicts["Coverage"] == (1, "SUCCESS")
    assert Q.multi_table_metric(tables, tables, meta, "ks_complement").first()["score"] == 1
    config = Q.metric_config([{"column": "a", "type": "integer", "encoding": "bit"}, {"columns": ["b", "c"], "type": "float"}])
    assert config["attribute"] == ["a"] and config["feature"] == ["b", "c"]
    assert Q.flattened_scores({"fidelity": {"x": (0.5, 0, 1), "y": {"z": 2}}}) == {"fidelity.x": 0.5, "fidelity.y.z": 2}


def test_chunks_and_flat_bits(spark):
    rows = spark.range(11).selectExpr("cast(id as double) t", "id")
    assert [r["n"] for r in FL.near_equal_chunks(rows, "t", "id", 4).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()] == [3, 3, 3, 2]
    assert [r["n"] for r in FL.slices(rows, "t", "id", 4).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()] == [4, 4, 3]
    bits = spark.createDataFrame([("f", 0, [1, 0], [1, 1]), ("f", 1, [0, 0], [0, 1])], "file string, i int, ttl array<int>, tcp_sprt array<int>")
    assert FL.flattened_bits(bits, "file", "i", ["ttl", "tcp_sprt"]).first()["bits"] == [1, 0, 0, 0, -1, -1]


def test_number_attacks(spark):
    rng = random.Random(1)
    rows = [(float(i), 2.0 * i + rng.gauss(0, 1), rng.random()) for i in range(400)]
    real, fake = spark.createDataFrame(rows[::2], "x double, y double, z double"), spark.createDataFrame(rows[1::2], "x double, y double, z double")
    assert AT.regression_attack(real, fake, ["x"], ["y"]).first()["score"] < 0.001 < AT.regression_attack(real, fake, ["x"], ["z"]).first()["score"]
    # Brute force with exact shares, whatever the depth of the tree.
    share = lambda v, k: sum(r[k] <= v for r in rows[::2]) / 200
    total = 0
    for a in rows[::2]:
        near = [b for b in rows[1::2] if (share(a[0], 0) - share(b[0], 0)) ** 2 + (share(a[2], 2) - share(b[2], 2)) ** 2 < 2 * 0.2**2]
        guess = sum(b[1] for b in near) / len(near) if near else 0.0
        total += (share(guess, 1) - share(a[1], 1)) ** 2
    for depth in (1, None):
        score = AT.radius_attack(real, fake, ["x", "z"], ["y"], cutoff=0.2, depth=depth).first()["score"]
        assert math.isclose(score, total / 200, rel_tol=1e-6), depth
    assert AT.radius_attack(real.where("false"), fake, ["x"], ["y"], depth=1).first()["score"] is None


def test_category_attacks(spark):
    rng = random.Random(2)
    make = lambda n: [(k := rng.choice("abc"), rng.choice("uv"), {"a": "x", "b": "y", "c": "z"}[k] if rng.random() < 0.9 else "x") for _ in range(n)]
    real, fake = spark.createDataFrame(make(300) + [("q", "u", "x")], "k string, l string, s string"), spark.createDataFrame(make(300), "k string, l string, s string")
    real, fake = real.coalesce(1).cache(), fake.coalesce(1).cache()
    for model in ("naive_bayes", "svm", "knn"):
        rows = AT.guesses(real, fake, ["k", "l"], "s", model)
        assert AT.guess_score(rows).first()["score"] < (0.4 if model == "knn" else 0.15), model
        assert {r["guess"] for r in rows.where("k = 'q'").collect()} == ({"x"} if model == "knn" else {None}) or model == "knn"
    assert AT.ensemble_attack(real, fake, ["k", "l"], "s", ["naive_bayes", "forest"]).first()["score"] < 0.15
    assert AT.guess_score(AT.guesses(real.where("false"), fake, ["k", "l"], "s")).first()["score"] == 0


def test_tree_likelihood_is_brute_force(spark):
    rng = random.Random(3)
    rows = [(a := rng.choice("xy"), b := (a if rng.random() < 0.9 else "z"), rng.choice("pq"), b + "!") for _ in range(200)]
    names = ["a", "b", "c", "d"]
    real = spark.createDataFrame(rows, "a string, b string, c string, d string")
    fake_rows = [*rows[:50], ("x", "nowhere", "p", "x!"), ("x", None, "p", "x!")]
    fake = spark.createDataFrame(fake_rows, "a string, b string, c string, d string")
    tree = AT.dependence_tree(real, names)
    bits = {}
    for i, j in combinations(range(4), 2):
        count = lambda *k: {v: sum(tuple(r[x] for x in k) == v for r in rows) for v in {tuple(r[x] for x in k) for r in rows}}
        bits[names[i], names[j]] = sum(n / 200 * math.log(n * 200 / (count(i)[v[:1]] * count(j)[v[1:]])) for v, n in count(i, j).items())
    got = {(r["a"], r["b"]): r["bits"] for r in AT.mutual_information(real, names).collect()}
    assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in bits.items())
    assert ("a", "b") in tree and ("b", "d") in tree

    def p(row):
        out = 1.0
        for parent, child in tree:
            j = names.index(child)
            same = [r for r in rows if parent is None or r[names.index(parent)] == row[names.index(parent)]]
            out *= sum(r[j] == row[j] for r in same) / len(same) if same else 0
        return out

    want = [p(r) for r in fake_rows]
    assert math.isclose(AT.tree_likelihood(real, fake, names).first()["score"], sum(want) / len(want), rel_tol=1e-9)
    assert math.isclose(AT.tree_likelihood(real, fake, names, log=True).first()["score"], sum(math.log(max(x, 1e-8)) for x in want) / len(want), rel_tol=1e-9)


def test_efficacy_and_related_tables(spark):
    rows = spark.range(0, 200, 1, 1).selectExpr("cast(id % 20 as double) x", "if(id % 2 = 0, 'a', 'b') two", "cast(3 * (id % 20) as double) y")
    assert L.ml_efficacy(rows, rows, ["x"], [], "two", "categorical").first()["score"] > 0.6
    assert L.ml_efficacy(rows, rows, ["x"], [], "y", "numerical").first()["score"] > 0.999
    parent, child = spark.range(0, 60, 1, 1).selectExpr("id pk", "cast(id % 5 as double) u"), spark.range(0, 200, 1, 1).selectExpr("id % 60 fk", "cast(id % 9 as double) x")
    assert L.parent_child_detection((parent, child), (parent, child), "pk", "fk", ["u", "x"], []).first()["score"] > 0.6
    far = child.withColumn("x", F.col("x") + 100)
    assert L.parent_child_detection((parent, child), (parent, far), "pk", "fk", ["u", "x"], [], "svc").first()["score"] < 0.1


def test_word_vectors(spark):
    rows = spark.createDataFrame([(80 if i % 2 else 443, "TCP" if i % 2 else "UDP") for i in range(60)], "port bigint, proto string")
    table = V.train(rows, ["port", "proto"], 4)
    assert {(r["kind"], r["word"]) for r in table.collect()} == {("port", "80"), ("port", "443"), ("proto", "TCP"), ("proto", "UDP")}
    odd = spark.createDataFrame([(80,), (81,), (400,), (None,)], "port bigint")
    coded = V.encode(odd, "port", table).withColumn("v", F.udf(lambda v: v.toArray().tolist() if v is not None else None, "array<double>")("vector")).select("port", "v")
    got = {r["port"]: r["word"] for r in V.decode(coded, "v", table, "port").collect()}
    assert got == {80: "80", 81: "80", 400: "443", None: None}


def test_sets_for_all_labels(spark):
    rows = spark.range(40).selectExpr("concat('hex', id) t", "concat('l', id % 2) l")
    one = X.detection_set(rows, "t", "l", "Which? ", train_share=0.5).groupBy("output", "split").count().collect()
    assert {(r["output"], r["split"]): r["count"] for r in one} == {(f"l{k}", s): 10 for k in (0, 1) for s in ("train", "test")}
    assert X.generation_set(rows, "t", "l", "Make {label}.").where("instruction in ('Make l0.', 'Make l1.')").count() == 40
