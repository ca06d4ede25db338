"""Files and pcap."""

import struct

from pyspark.sql import functions as F

from fidelis.sources import files, pcap

TCP = bytes.fromhex("aabbccddeeff1122334455660800" + "45100030abcd40004006b1e6c0a80001c0a800c7" + "01bbc0010000000100000002501820000000" + "0000") + b"payload!"
UDP = bytes.fromhex("aabbccddeeff112233445566" + "81000001" + "0800" + "4500002cabcd00003f11b1e6c0a80001c0a800c7" + "003500351d0a0000") + b"abcdefghijklmnop"
ARP = bytes.fromhex("ffffffffffff1122334455660806") + bytes(28)


def capture(path, packets, order="<"):
    out = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, p in enumerate(packets):
        out += struct.pack(f"{order}IIII", 100 + i, 7, len(p), len(p)) + p
    path.write_bytes(out)


def test_pcap(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    capture(tmp_path / "a" / "x.pcap", [TCP, ARP, UDP, TCP[:20]])
    capture(tmp_path / "a" / "b" / "y.pcap", [UDP], ">")
    (tmp_path / "a" / "empty.pcap").write_bytes(b"")
    (tmp_path / "a" / "other.txt").write_bytes(b"x" * 100)
    rows = pcap.read(spark, str(tmp_path / "a")).orderBy("file", "packet").cache()
    got = [(r["packet"], r["protocol"], r["src_ip"], r["src_port"], r["ttl"], r["flag"], r["time_us"], bytes(r["payload"])) for r in rows.collect()]
    assert got == [(0, "UDP", "192.168.0.1", 53, 63, 0, 100_000_007, b"abcdefghijklmnop"), (0, "TCP", "192.168.0.1", 443, 64, 2, 100_000_007, b"payload!"), (2, "UDP", "192.168.0.1", 53, 63, 0, 102_000_007, b"abcdefghijklmnop")]
    tcp = rows.where("protocol = 'TCP'").first()
    assert (tcp["src_mac"], tcp["dst_mac"], tcp["seq"], tcp["window"], tcp["data_offset"], tcp["tcp_flags"]) == ("11:22:33:44:55:66", "aa:bb:cc:dd:ee:ff", 1, 0x2000, 5, 0x18)
    assert {(r["protocol"], r["total_packets"]) for r in pcap.flows(rows).collect()} == {("TCP", 1), ("UDP", 1)}
    assert pcap.identifiers(rows).count() == 3
    text = pcap.byte_tokens(rows).collect()
    assert len(text) == 1 and [len(p.split()) for p in text[0]["text"].split("<|pkt|>")] == [128, 128]
    assert pcap.flow_hex(rows).where("text like '%<pck>%'").count() == 1
    written = pcap.write(rows.withColumn("data", F.concat("header", "payload")), f"file://{tmp_path}/out", "protocol", ["time_us"], "data", "time_us").collect()
    assert sorted(r["packets"] for r in written) == [1, 2]
    again = pcap.read(spark, f"{tmp_path}/out").orderBy("protocol", "time_us")
    assert [bytes(r["payload"]) for r in again.collect()] == [b"payload!", b"abcdefghijklmnop", b"abcdefghijklmnop"]


def test_files(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "http_1.csv").write_text("i,x,ip_b_1,ip_b_0,src_ip\n1,5,0,1,a\n0,6,-1,1,b\n2,,1,1,c\n")
    (tmp_path / "web" / "dns_2.csv").write_text("")
    rows = files.csv(spark, f"{tmp_path}/web/*.csv")
    assert rows.count() == 3
    assert [r["x"] for r in files.head_per_file(rows, ["i"], 2).orderBy("i").collect()] == [6, 5]
    assert files.column(rows, "x").count() == 2 and files.column(rows, "none").count() == 0
    assert {r["label"] for r in files.labelled_by_path(rows, "file").collect()} == {"http"}
    bits = files.bit_rows(spark, f"{tmp_path}/web/http_1.csv", ["ip_b"])
    assert sorted(tuple(r["ip_b"]) for r in bits.collect()) == [(1, -1), (1, 0), (1, 1)]
    labels = spark.createDataFrame([("http_1.csv", "web")], "File string, Label string")
    assert files.labelled(rows, labels).where("label = 'web'").count() == 3
    assert files.shared_columns(rows, rows.drop("x")) == [c for c in rows.columns if c != "x"]
    (tmp_path / "t.txt").write_text("{'src': '1.1.1.1'} aabbccddeeff112233445566\n\n<|w|> 1 2 3 <|pkt|> 4 5 6\n")
    lines = files.generated_lines(spark, f"{tmp_path}/t.txt")
    assert lines.count() == 2 and [r[0] for r in files.header_values(lines, "src").collect()] == ["1.1.1.1"]
    assert [r[0] for r in files.mac_values(lines, "dst").where("value like 'aa%'").collect()] == ["aa:bb:cc:dd:ee:ff"]
    assert [r[0] for r in files.byte_values(lines.where("text like '<|w%'"), 0, 2).collect()] == ["1 2", "4 5"]
    (tmp_path / "o.jsonl").write_text('{"instruction": "i", "output": "{\'src\': \'2.2.2.2\'} 00"}\n')
    assert [r[0] for r in files.ip_values(files.instruction_outputs(spark, f"{tmp_path}/o.jsonl"), "src").collect()] == ["2.2.2.2"]
    report = spark.range(3)
    files.write_report(report, f"{tmp_path}/r")
    files.write_report(spark.range(9), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 3
