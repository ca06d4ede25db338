"""Expressions: addresses, bits, packets, codecs."""

import pytest
from pyspark.sql import functions as F

from fidelis.functions import addresses as A
from fidelis.functions import bits as B
from fidelis.functions import codecs as K
from fidelis.functions import packets as P


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_addresses(spark):
    rows = [(0,), (4294967295,), (3232235777,), (-1,), (4294967296,), (None,)]
    assert [x for x, in values(spark, rows, "n bigint", A.int_to_ip(F.col("n")))] == ["0.0.0.0", "255.255.255.255", "192.168.1.1", None, None, None]
    texts = [("192.168.1.1",), ("1.2.3",), ("300.1.1.1",), ("fe80::1",), (None,)]
    assert [x for x, in values(spark, texts, "t string", A.ip_to_int(F.col("t")))] == [3232235777, None, None, None, None]
    assert [x for x, in values(spark, texts, "t string", A.bits_to_ip(A.ip_to_bits(F.col("t"))))] == ["192.168.1.1", None, None, None, None]
    assert [x for x, in values(spark, texts, "t string", A.mask_subnet(F.col("t")))] == ["192.168.0.0", "1.2.3", "300.1.0.0", "fe80::1", None]
    assert values(spark, [("aa:bb:cc:dd:ee:ff", "TCP")], "m string, p string", A.mask_oui(F.col("m")), A.protocol_number(F.col("p")), A.protocol_name(F.lit(17))) == [("aa:bb:cc:00:00:00", 6, "UDP")]
    paths = [("/x/web_browsing/http_001_flow.csv",)]
    assert values(spark, paths, "p string", A.label_of_file(F.col("p")), A.label_of_folder(F.col("p"))) == [("http", "browsing")]


def test_random_addresses_are_seeded(spark):
    df = spark.range(50).select(A.random_ip(1).alias("a"), A.random_mac(1).alias("m"))
    assert df.collect() == df.collect() and df.where(A.is_ipv4(F.col("a")) & F.col("m").rlike("^([0-9a-f]{2}:){5}[0-9a-f]{2}$")).count() == 50


def test_bits(spark):
    rows = [([1, 0, -1, 1],), ([],), (None,)]
    assert values(spark, rows, "b array<int>", B.bits_to_int(F.col("b")), B.fingerprint(F.col("b"))) == [(9, "10*1"), (0, ""), (None, None)]
    assert values(spark, [("0111",), ("1111",)], "t string", B.add_to_bits(F.col("t")), B.add_to_bits(F.col("t"), 2, False)) == [("1000", "1001"), ("10000", "10001")]
    for v in (1, 0, -1, 40, -40):
        assert values(spark, [(v,)], "v int", B.rgba_to_bit(B.bit_to_rgba(F.col("v")))) == [(v,)]
    assert values(spark, [(200, 10, 10), (10, 200, 10), (120, 90, 130)], "r int, g int, b int", B.snap_colour(F.col("r"), F.col("g"), F.col("b"))) == [("red",), ("green",), ("blue",)]


def test_flags(spark):
    rows = [("SA",), ("0",), (None,), ("",), ("SS",), ("x",), ("FSRPAUECN",)]
    assert [x for x, in values(spark, rows, "s string", P.tcp_flags_mask(F.col("s")))] == [18, 0, 0, 0, 4, 0, 511]


PACKET = "aabbccddeeff112233445566" + "0800" + "45100030abcd40004006b1e6c0a80001c0a800c7" + "01bbc0010000000100000002501820000000"


def test_header_fields(spark):
    get = lambda f: P.header_field(F.col("x"), f)
    rows = [(PACKET,), (PACKET[:40],), ("",), (None,), ("zz" + PACKET + "f",)]
    got = values(spark, rows, "x string", get("ttl"), get("src_port"), get("seq"), get("window"), get("dst_mac"))
    assert got[0] == (64, 443, 1, 0x2000, 0xAABBCCDDEEFF) == got[4]
    assert got[1][:4] == (None, None, None, None) and got[2] == got[3] == (None,) * 5
    with pytest.raises(ValueError, match="unknown"):
        P.header_field(F.col("x"), "colour")
    header = "45000030abcd40004006" + "0000" + "c0a80001c0a800c7"
    assert values(spark, [(header,)], "x string", P.ipv4_checksum(F.col("x")))[0][0] == checksum(bytes.fromhex(header))


def checksum(data):
    total = sum(int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return 0xFFFF - total


def test_header_text(spark):
    rows = [("x {'src': '1.2.3.4', 'proto': 'TCP'} aabbccddeeff112233445566",), ("no braces aa",), ("{'src': '9.9.9.9'} aabb",), (None,)]
    got = values(spark, rows, "t string", P.header_value(F.col("t"), "src"), P.ip_value(F.col("t"), "src"), P.mac_from_payload(F.col("t"), "src"))
    assert got == [("1.2.3.4", "1.2.3.4", "11:22:33:44:55:66"), (None, None, None), ("9.9.9.9", "9.9.9.9", None), (None, None, None)]


def test_sequences(spark):
    text = "<|web|> 1 2 3 4 <|pkt|> 5 6 7 8 <|pkt|> 9"
    row = values(spark, [(text,)], "t string", P.packets_of(F.col("t")), P.packet_prefix(F.col("t"), 2), P.packet_prefix(F.col("t"), 9), P.byte_slice(F.lit("5 6 7 8"), 1, 3), P.byte_slice(F.lit("<|web|> 1 2 3 4"), 1, 3, True), P.truncate_tokens(F.lit(" a  b c "), 2))[0]
    assert row == (["<|web|> 1 2 3 4", "5 6 7 8", "9"], "<|web|> 1 2 3 4 <|pkt|> 5 6 7 8 ", text, "6 7", "2 3", "a b")
    assert values(spark, [(b"\x00\xff\x10",), (b"",), (None,)], "d binary", P.bytes_to_tokens(F.col("d")))[0] == ("0 255 16",)
    assert values(spark, [([1, 2, 3],)], "a array<int>", P.fit_length(F.col("a"), 5), P.fit_length(F.col("a"), 2)) == [([1, 2, 3, 0, 0], [1, 2])]


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 15.0, "b"), (3, 10.0, None)], "id bigint, x double, c string")
    for codec in (K.MinMax.fit(df, "x"), K.MinMax.fit(df, "x", centred=True), K.MinMax.fit(df, "x", log=True)):
        assert [round(r[0], 6) for r in df.select(codec.decode(codec.encode(F.col("x")))).collect()] == [5.0, 15.0, 10.0]
    one = K.OneHot.fit(df, "c")
    assert [r[0] for r in df.select(one.encode(F.col("c"))).collect()] == [[1, 0], [0, 1], [0, 0]]
    codecs = {"x": K.MinMax.fit(df, "x"), "c": one, "id": K.Bits(4)}
    packed = K.pack_fields(df, codecs).select("vector")
    back = K.unpack_fields(packed, codecs).collect()
    assert [(r["id"], round(r["x"], 6), r["c"]) for r in back][:2] == [(1, 5.0, "a"), (2, 15.0, "b")]
    constant = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r[0] for r in constant.select(K.MinMax.fit(constant, "x").encode(F.col("x"))).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="categories"):
        K.OneHot.fit(spark.range(20), "id", most=5)
    filled = K.fill_missing(df, ["x"], ["c"]).collect()
    assert filled[2]["c"] == "?"
