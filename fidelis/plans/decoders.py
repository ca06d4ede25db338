"""Queries over bits, bytes, header texts, repairs and instruction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import bits as B
from ..functions import codecs as K
from ..functions import packets as P
from ..operators import bit_repair as R
from ..operators import flows as FL
from ..operators import membership as M
from ..operators import mitigation as MI
from ..operators import text_sets as X
from .catalog import PACKETS, packets, query, table
from .traffic import HEX, IP_SQL, hex_packets, hex_sql, with_ip

# --- addresses and protocols -----------------------------------------------------------------

NAMES = "CASE event_type WHEN 'view' THEN 'tcp' WHEN 'click' THEN 'UDP' WHEN 'error' THEN 'Icmp' ELSE 'other' END"


@query(f"SELECT event_id, CASE upper(n) WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 END AS number, CASE WHEN upper(n) <> 'OTHER' THEN upper(n) END AS name FROM (SELECT event_id, {NAMES} AS n FROM events)")
def protocol_numbers(spark, d) -> DataFrame:
    rows = packets(spark, d).select("event_id", A.protocol_number(F.expr(NAMES)).alias("number"))
    return rows.withColumn("name", A.protocol_name(F.col("number")))


@query("SELECT doc_id, regexp_replace(substr(md5(text), 1, 12), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:00:00:00') AS mac FROM documents")
def mask_oui(spark, d) -> DataFrame:
    digits = F.md5("text")
    mac = F.concat_ws(":", *[F.substring(digits, 1 + 2 * k, 2) for k in range(6)])
    return table(spark, d, "documents").select("doc_id", A.mask_oui(mac).alias("mac"))


@query("SELECT COUNT(*) AS n, COUNT(*) AS ips, COUNT(*) AS macs FROM events")
def random_identities(spark, d) -> DataFrame:
    rows = packets(spark, d).select(A.random_ip(3).alias("ip"), A.random_mac(9).alias("mac"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(A.is_ipv4(F.col("ip"))).alias("ips"), F.count_if(F.col("mac").rlike("^([0-9a-f]{2}:){5}[0-9a-f]{2}$")).alias("macs"))


@query("SELECT event_id, event_type AS by_file, 'u' || user_id AS by_folder, sha256('/data/x_u' || user_id || '/' || event_type || '_' || event_id || '.csv') AS hash FROM events")
def labels_of_paths(spark, d) -> DataFrame:
    path = F.concat(F.lit("/data/x_u"), "user_id", F.lit("/"), "event_type", F.lit("_"), "event_id", F.lit(".csv"))
    rows = packets(spark, d).withColumn("path", path)
    return rows.select("event_id", A.label_of_file(F.col("path")).alias("by_file"), A.label_of_folder(F.col("path")).alias("by_folder"), A.path_hash(F.col("path")).alias("hash"))


# --- bits ------------------------------------------------------------------------------------

VALUE = "CAST(FLOOR(value) AS BIGINT)"


@query(f"SELECT event_id, CASE WHEN v % 256 + 5 > 255 THEN BIN(v % 256 + 5) ELSE LPAD(BIN(v % 256 + 5), 8, '0') END AS padded, BIN(v % 256 + 5) AS plain FROM (SELECT event_id, {VALUE} AS v FROM events)")
def add_to_bits(spark, d) -> DataFrame:
    text = F.lpad(F.bin(F.floor("value") % 256), 8, "0")
    return packets(spark, d).select("event_id", B.add_to_bits(text, 5).alias("padded"), B.add_to_bits(text, 5, fixed=False).alias("plain"))


@query(f"SELECT event_id, CAST((v >> 7) & 1 AS INTEGER) AS first, CAST(v AS BIGINT) AS number FROM (SELECT event_id, {VALUE} % 256 AS v FROM events)")
def text_to_bits(spark, d) -> DataFrame:
    bits = B.text_to_bits(F.lpad(F.bin(F.floor("value") % 256), 8, "0"))
    return packets(spark, d).select("event_id", bits[0].alias("first"), B.bits_to_int(bits).alias("number"))


@query(
    f"SELECT event_id, CASE WHEN v >= 1 THEN 255 ELSE 0 END AS r, CASE WHEN v = 0 THEN 255 ELSE 0 END AS g, CASE WHEN v <= -1 THEN 255 ELSE 0 END AS b, CASE WHEN abs(v) > 1 THEN abs(v) ELSE 255 END AS a, v AS back, "
    f"(CASE WHEN v >= 1 THEN '255.0.0.' WHEN v = 0 THEN '0.255.0.' ELSE '0.0.255.' END) || (CASE WHEN abs(v) > 1 THEN abs(v) ELSE 255 END) AS ip FROM (SELECT event_id, CAST({VALUE} % 9 - 4 AS INTEGER) AS v FROM events)"
)
def bit_colours(spark, d) -> DataFrame:
    rows = packets(spark, d).select("event_id", (F.floor("value") % 9 - 4).cast("int").alias("v")).withColumn("p", B.bit_to_rgba(F.col("v")))
    return rows.select("event_id", *[F.col(f"p.{c}").alias(c) for c in "rgba"], B.rgba_to_bit(F.col("p")).alias("back"), B.rgba_to_ip(F.col("p")).alias("ip"))


@query(
    f"SELECT event_id, CASE WHEN r > 160 AND g < 100 AND b < 100 THEN 'red' WHEN g > 160 AND r < 100 AND b < 100 THEN 'green' WHEN b > 160 AND r < 100 AND g < 100 THEN 'blue' WHEN r >= g AND r >= b THEN 'red' WHEN g >= b THEN 'green' ELSE 'blue' END AS colour "
    f"FROM (SELECT event_id, {VALUE} * 7 % 256 AS r, {VALUE} * 13 % 256 AS g, user_id * 31 % 256 AS b FROM events)"
)
def snap_colours(spark, d) -> DataFrame:
    v = F.floor("value")
    return packets(spark, d).select("event_id", B.snap_colour(v * 7 % 256, v * 13 % 256, F.col("user_id") * 31 % 256).alias("colour"))


@query("SELECT event_id, 1500 - 4 * (5 + user_id % 3) - 4 * (5 + port % 4) AS bytes FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS port FROM events)")
def segment_length(spark, d) -> DataFrame:
    return packets(spark, d).select("event_id", B.tcp_segment_length(F.lit(1500), 5 + F.col("user_id") % 3, 5 + F.col("port") % 4).alias("bytes"))


# --- packet texts ----------------------------------------------------------------------------


@query("SELECT doc_id, substr(md5(text), 1, 16) AS clean, CAST(8 AS INTEGER) AS bytes FROM documents")
def clean_hex(spark, d) -> DataFrame:
    digits = F.md5("text")
    messy = F.concat(F.lit(" x"), F.upper(F.substring(digits, 1, 8)), F.lit("--: "), F.substring(digits, 9, 8), F.lit(" z1"))
    return table(spark, d, "documents").select("doc_id", P.clean_hex(messy).alias("clean"), F.length(P.hex_bytes(messy)).alias("bytes"))


SEQUENCE = "'<|' || event_type || '|> ' || user_id || ' 1 2 <|pkt|> ' || port || ' 3 <|pkt|> 4 5'"


def sequences(spark, d) -> DataFrame:
    body = F.concat(F.col("user_id").cast("string"), F.lit(" 1 2 <|pkt|> "), "port", F.lit(" 3 <|pkt|> 4 5"))
    return packets(spark, d).select("event_id", P.tag_sequence(body, F.col("event_type")).alias("s"))


@query(f"WITH {PACKETS} SELECT event_id, {SEQUENCE} AS tagged, '<|' || event_type || '|> ' || user_id || ' 1 2 <|pkt|> ' || port || ' 3 ' AS prefix, '<|' || event_type || '|> ' || user_id || ' 1' AS short FROM packets")
def byte_sequences(spark, d) -> DataFrame:
    return sequences(spark, d).select("event_id", F.col("s").alias("tagged"), P.packet_prefix(F.col("s"), 2).alias("prefix"), P.truncate_tokens(F.col("s"), 3).alias("short"))


@query(f"WITH {PACKETS} SELECT value, COUNT(*) AS n FROM (SELECT user_id || ' 1' AS value FROM packets UNION ALL SELECT port || ' 3' FROM packets UNION ALL SELECT '4 5' FROM packets) GROUP BY value")
def byte_values(spark, d) -> DataFrame:
    from ..sources.files import byte_values as values

    return values(sequences(spark, d).withColumnRenamed("s", "text"), 0, 2).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) AS VARCHAR) || ' ' || CAST(CAST('0x' || substr(md5(text), 3, 2) AS INTEGER) AS VARCHAR) AS tokens FROM documents")
def bytes_to_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.bytes_to_tokens(F.unhex(F.substring(F.md5("text"), 1, 4))).alias("tokens"))


PORTS = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(
    f"SELECT user_id, array_to_string(list_transform(range(6), lambda i: COALESCE(l[i + 1], 0)), ' ') AS fixed "
    f"FROM (SELECT user_id, list_slice(list(DISTINCT {PORTS} ORDER BY {PORTS}), 1, 6) AS l FROM events GROUP BY user_id)"
)
def fit_length(spark, d) -> DataFrame:
    rows = packets(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_set("port")).alias("l"))
    return rows.select("user_id", F.array_join(F.transform(P.fit_length(F.col("l"), 6), lambda x: x.cast("string")), " ").alias("fixed"))


WORDS = ["'4500'", *[f"substr(md5(text), {1 + 4 * k}, 4)" for k in range(4)], "'0000'", *[f"substr(md5(text || 'y'), {1 + 4 * k}, 4)" for k in range(4)]]
TOTAL = " + ".join(f"CAST('0x' || {w} AS BIGINT)" for w in WORDS)


@query(f"SELECT doc_id, 65535 - (((t & 65535) + (t >> 16)) & 65535) - (((t & 65535) + (t >> 16)) >> 16) AS checksum FROM (SELECT doc_id, {TOTAL} AS t FROM documents)")
def ipv4_checksum(spark, d) -> DataFrame:
    header = F.concat(F.lit("4500"), F.substring(F.md5("text"), 1, 16), F.lit("ffff"), F.substring(F.md5(F.concat("text", F.lit("y"))), 1, 16))
    return table(spark, d, "documents").select("doc_id", P.ipv4_checksum(header).alias("checksum"))


HEX_OF = "list_aggregate(list_transform(string_split(ip, '.'), lambda o: lower(printf('%02x', CAST(o AS INTEGER)))), 'string_agg', '')"


@query(f"WITH {PACKETS}, i AS (SELECT event_id, port, {IP_SQL.replace('a ', 'address ')} AS ip FROM packets) SELECT event_id, lower(printf('%04x', 16 + port)) AS total, {HEX_OF} AS src, lower(printf('%04x', 1000 + port)) AS sport, '0050' AS dport, CAST(108 AS INTEGER) AS digits FROM i")
def header_bytes(spark, d) -> DataFrame:
    h = P.header_bytes(F.col("ip"), F.lit("10.0.0.1"), F.lit("TCP"), 1000 + F.col("port"), F.lit(80), F.col("port"))
    rows = with_ip(spark, d).select("event_id", h.alias("h"))
    part = lambda first, n: F.substring("h", 1 + 2 * first, 2 * n)
    return rows.select("event_id", part(16, 2).alias("total"), part(26, 4).alias("src"), part(34, 2).alias("sport"), part(36, 2).alias("dport"), F.length("h").alias("digits"))


@query(f"WITH {PACKETS} SELECT event_id, '{{''src'': ''' || address || ''', ''dst'': '''', ''proto'': ''' || event_type || ''', ''sport'': ''' || port || ''', ''dport'': ''80''}} 01ff' AS text FROM packets")
def packet_texts(spark, d) -> DataFrame:
    key = P.flow_key_text(F.col("address"), F.lit(None).cast("string"), F.col("port"), F.lit(80), F.col("event_type"))
    return packets(spark, d).select("event_id", P.packet_text("tuple_hex", key, F.unhex(F.lit("01ff"))).alias("text"))


# --- codecs ----------------------------------------------------------------------------------


@query("SELECT event_id, ROUND(value, 4) AS value, event_type FROM events")
def packed_fields(spark, d) -> DataFrame:
    rows = packets(spark, d).select("event_id", "value", "event_type")
    codecs = {"value": K.MinMax.fit(rows, "value", centred=True), "event_type": K.OneHot.fit(rows, "event_type")}
    return K.unpack_fields(K.pack_fields(rows, codecs).select("event_id", "vector"), codecs).withColumn("value", F.round("value", 4))


GAPPY = "SELECT event_id, NULLIF(CAST(user_id % 5 AS DOUBLE), 0) AS v, NULLIF(event_type, 'view') AS t FROM events"


@query(f"WITH g AS ({GAPPY}) SELECT event_id, ROUND(COALESCE(v, (SELECT AVG(v) FROM g)), 6) AS v, COALESCE(t, '?') AS t FROM g")
def filled_gaps(spark, d) -> DataFrame:
    rows = packets(spark, d).select("event_id", F.expr("nullif(cast(user_id % 5 as double), 0)").alias("v"), F.expr("nullif(event_type, 'view')").alias("t"))
    return K.fill_missing(rows, ["v"], ["t"]).withColumn("v", F.round("v", 6))


@query("SELECT event_id, COALESCE(NULLIF(event_type, 'view'), '?') || ',' || user_id AS joined FROM events")
def filled_arrays(spark, d) -> DataFrame:
    both = F.array(F.expr("nullif(event_type, 'view')"), F.col("user_id").cast("string"))
    return packets(spark, d).select("event_id", F.array_join(K.fill_array(both), ",").alias("joined"))


@query("SELECT ROUND(AVG(CASE WHEN event_type = 'view' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share FROM events")
def share_equal(spark, d) -> DataFrame:
    return K.share_equal(packets(spark, d), "event_type", "view").withColumn("share", F.round("share", 6))


# --- repairs of generated packets --------------------------------------------------------------
# Packets of a user are a flow; its odd packets go back. Bits that are missing come from the value.


def bit_packets(spark, d) -> DataFrame:
    v = F.floor("value").cast("bigint")
    gaps = lambda width, m: F.transform(B.int_to_bits(v, width), lambda b, i: F.when((v + i) % m == 0, -1).otherwise(b))
    rows = packets(spark, d).select(F.col("user_id").alias("flow"), F.col("event_id").alias("idx"), (F.col("event_id") % 2 == 0).alias("forward"), v.alias("v"), gaps(16, 3).alias("gappy"), B.int_to_bits(v % 65536, 16).alias("ip_id"))
    return rows.withColumns({"seq": F.col("v") * 1000, "segment": F.col("v") % 50, "ttl": B.int_to_bits(F.col("v") % 2, 8), "tl": B.int_to_bits(F.col("v") * 7 % 3000, 16)})


V = "SELECT user_id AS flow, event_id AS idx, event_id % 2 = 0 AS forward, CAST(FLOOR(value) AS BIGINT) AS v FROM events"


@query("SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS changed FROM events")
def filled_bits(spark, d) -> DataFrame:
    rows = bit_packets(spark, d).withColumn("full", R.fill_missing_bits(F.col("gappy"), 5))
    odd = F.size(F.filter(F.zip_with("gappy", "full", lambda a, b: F.when((a != -1) & (a != b), 1).otherwise(0)), lambda x: x == 1))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("full", lambda b: ~b.isin(0, 1)))).alias("missing"), F.sum(odd).alias("changed"))


@query(f"SELECT idx, CAST(4 AS BIGINT) AS version, CAST(1 AS BIGINT) AS dfbit, CAST(0 AS BIGINT) AS frag_offset, CAST(1 AS BIGINT) AS ttl FROM ({V})")
def version_and_flags(spark, d) -> DataFrame:
    rows = R.version_and_flags(bit_packets(spark, d))
    return rows.select("idx", *[B.bits_to_int(F.col(c)).alias(c) for c in ("version", "dfbit", "frag_offset", "ttl")])


@query(f"SELECT idx, CAST(LEAST(GREATEST(v * 7 % 3000, 40), 1500) AS BIGINT) AS length FROM ({V})")
def clamped_length(spark, d) -> DataFrame:
    return bit_packets(spark, d).select("idx", B.bits_to_int(R.clamp_length("tl", 40)).alias("length"))


@query(f"SELECT idx, CAST(CEIL((16 + 16 - CASE v % 3 WHEN 0 THEN 6 WHEN 1 THEN 5 ELSE 5 END) / 32.0) AS BIGINT) AS words FROM ({V})")
def header_words(spark, d) -> DataFrame:
    return bit_packets(spark, d).select("idx", R.header_words("ip_id", "gappy").alias("words"))


@query(f"SELECT flow, CASE WHEN AVG(1 - CASE WHEN v % 3 = 0 THEN 6 ELSE 5 END / 16.0) >= 1 THEN 'UDP' ELSE 'TCP' END AS protocol FROM ({V}) GROUP BY flow")
def dominant_protocol(spark, d) -> DataFrame:
    return R.dominant_protocol(bit_packets(spark, d), {"UDP": "gappy", "TCP": "ip_id"})


@query(f"SELECT idx, (FIRST_VALUE(v % 65536) OVER w + ROW_NUMBER() OVER w - 1) & 65535 AS ip_id FROM ({V}) WINDOW w AS (PARTITION BY flow, forward ORDER BY idx)")
def packet_ids(spark, d) -> DataFrame:
    return R.ip_ids(bit_packets(spark, d)).select("idx", B.bits_to_int(F.col("ip_id")).alias("ip_id"))


@query(
    f"""WITH p AS ({V}), s AS (SELECT *, v % 50 AS seg, (FIRST_VALUE(v * 1000) OVER (PARTITION BY flow, forward ORDER BY idx) + COALESCE(SUM(v % 50) OVER (PARTITION BY flow, forward ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) & 4294967295 AS seq FROM p),
 n AS (SELECT *, CAST((seq + seg) & 4294967295 AS BIGINT) AS next FROM s)
 SELECT a.idx, CAST(a.seq AS BIGINT) AS seq, COALESCE((SELECT ARG_MAX(b.next, b.idx) FROM n b WHERE b.flow = a.flow AND b.forward <> a.forward AND b.idx < a.idx), 0) AS ack FROM n a"""
)
def sequence_numbers(spark, d) -> DataFrame:
    return R.sequence_numbers(bit_packets(spark, d)).select("idx", "seq", "ack")


@query(f"WITH p AS ({V}), r AS (SELECT *, MIN(CASE WHEN NOT forward THEN idx END) OVER (PARTITION BY flow) AS r FROM p) SELECT idx, CASE WHEN r IS NULL OR idx <= r THEN 1 ELSE 0 END AS syn, CASE WHEN idx >= r THEN 1 ELSE 0 END AS ackf FROM r")
def handshake_flags(spark, d) -> DataFrame:
    return R.handshake_flags(bit_packets(spark, d)).select("idx", "syn", "ackf")


@query("WITH p AS (SELECT user_id, event_type AS t, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events), c AS (SELECT f, t, COUNT(*) AS n FROM p WHERE f IS NOT NULL GROUP BY ALL) SELECT f AS \"from\", t AS \"to\", ROUND(n / CAST(SUM(n) OVER (PARTITION BY f) AS DOUBLE), 6) AS p FROM c")
def direction_changes(spark, d) -> DataFrame:
    rows = packets(spark, d).select(F.col("user_id").alias("flow"), F.col("event_id").alias("idx"), F.col("event_type").alias("src_ip"))
    return R.transition_matrix(rows).withColumn("p", F.round("p", 6))


@query("SELECT user_id AS flow, CAST(12 AS BIGINT) AS steps, TRUE AS starts_forward FROM events GROUP BY user_id")
def sampled_directions(spark, d) -> DataFrame:
    walk = R.sample_directions(packets(spark, d).select(F.col("user_id").alias("flow")).distinct(), 0.6, 0.4, 12, 3)
    return walk.groupBy("flow").agg(F.count(F.lit(1)).alias("steps"), F.bool_or((F.col("idx") == 0) & F.col("forward")).alias("starts_forward"))


@query(f"SELECT flow, CAST(1 AS BIGINT) AS pairs, TRUE AS swapped FROM ({V}) GROUP BY flow")
def flow_ports(spark, d) -> DataFrame:
    low, high = F.least("src_port", "dst_port"), F.greatest("src_port", "dst_port")
    rows = R.flow_ports(bit_packets(spark, d), 4)
    mirrored = F.countDistinct(F.when(F.col("forward"), F.col("src_port")).otherwise(F.col("dst_port"))) == 1
    return rows.groupBy("flow").agg(F.countDistinct(F.struct(low, high)).alias("pairs"), mirrored.alias("swapped"))


@query("SELECT event_type AS address, ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type")
def address_shares(spark, d) -> DataFrame:
    return R.address_shares(packets(spark, d), "event_type").withColumn("share", F.round("share", 6))


OPTION_BITS = [1, 0, 1, 1] * 20 + [-1] * 8 + [0, 1] * 16 + [-1] * 16 + [1] * 24 + [-1] * 160


@query("SELECT event_id, CAST(8 AS BIGINT) AS first_kind, CAST(10 AS BIGINT) AS first_length, CAST(-8 AS BIGINT) AS gap, CAST(2 AS BIGINT) AS second_kind, CAST(4 AS BIGINT) AS second_length, CAST(3 AS BIGINT) AS third_kind FROM events")
def tcp_options(spark, d) -> DataFrame:
    bits = F.when(F.col("event_id").isNotNull(), F.array(*map(F.lit, OPTION_BITS)))
    rows = packets(spark, d).select("event_id", R.tcp_options(bits, 2).alias("o"))
    number = lambda first: B.bits_to_int(F.slice("o", first + 1, 8))
    gap = F.aggregate(F.slice("o", 81, 8), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return rows.select("event_id", number(0).alias("first_kind"), number(8).alias("first_length"), gap.alias("gap"), number(88).alias("second_kind"), number(96).alias("second_length"), number(136).alias("third_kind"))


# --- flows and chunks ------------------------------------------------------------------------


@query(f"WITH {PACKETS}, p AS (SELECT event_id, ROW_NUMBER() OVER (ORDER BY time, event_id) - 1 AS i, COUNT(*) OVER () AS n FROM packets) SELECT event_id, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS chunk FROM p")
def near_equal_chunks(spark, d) -> DataFrame:
    return FL.near_equal_chunks(packets(spark, d), "time", "event_id", 7).select("event_id", "chunk")


@query(f"WITH {PACKETS} SELECT event_id, CAST((ROW_NUMBER() OVER (ORDER BY time, event_id) - 1) // 100 AS INTEGER) AS chunk FROM packets")
def fixed_slices(spark, d) -> DataFrame:
    return FL.slices(packets(spark, d), "time", "event_id", 100).select("event_id", "chunk")


@query(f"WITH {PACKETS}, f AS (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY time, event_id) AS i FROM packets) SELECT user_id, CAST(i - 1 AS INTEGER) AS step, ROUND(value, 4) AS value FROM f")
def padded_series(spark, d) -> DataFrame:
    series = FL.padded_series(packets(spark, d), ["user_id"], ["time", "event_id"], ["value"])
    return FL.denormalize_series(series, ["user_id"], ["value"]).withColumn("value", F.round("value", 4))


@query("SELECT event_id, CAST(c AS BIGINT) AS chunk, c = k AS starts FROM (SELECT event_id, user_id % 3 AS k, UNNEST([0, 1, 2, 3]) AS c FROM events) WHERE c = k OR c > k AND (event_id + c) % 2 = 0")
def flow_tags(spark, d) -> DataFrame:
    flags = F.array(*[((F.col("event_id") + k) % 2 == 0).cast("int") for k in range(4)])
    rows = packets(spark, d).select("event_id", (F.col("user_id") % 3).alias("chunk"), flags.alias("flags"))
    return FL.propagate_flow_tags(rows, "chunk", "flags").select("event_id", "chunk", "starts")


@query(f"WITH p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY flow ORDER BY idx) AS i FROM ({V})) SELECT flow, CAST(SUM(CASE WHEN i <= 3 THEN length(replace(bin(v % 256), '0', '')) ELSE 0 END) AS BIGINT) AS ones, CAST(24 AS INTEGER) AS width FROM p GROUP BY flow")
def flattened_bits(spark, d) -> DataFrame:
    rows = packets(spark, d).select(F.col("user_id").alias("file"), "event_id", B.int_to_bits(F.floor("value") % 256, 8).alias("ttl"), B.int_to_bits(F.lit(7), 4).alias("tcp_sprt"))
    flat = FL.flattened_bits(rows, "file", "event_id", ["ttl", "tcp_sprt"])
    return flat.select(F.col("file").alias("flow"), F.size(F.filter("bits", lambda b: b == 1)).cast("bigint").alias("ones"), F.size("bits").alias("width"))


# --- scores ----------------------------------------------------------------------------------


@query("SELECT user_id, ROUND(AVG(CAST((a - b) * (a - b) AS DOUBLE)), 6) AS loss, ROUND(AVG(CAST(((a - b + 256) % 256) * ((a - b + 256) % 256) % 256 AS DOUBLE)), 6) AS wrapped FROM (SELECT user_id, CAST(FLOOR(value) AS BIGINT) % 256 AS a, event_id % 256 AS b FROM events) GROUP BY user_id")
def reconstruction_loss(spark, d) -> DataFrame:
    rows = packets(spark, d).select("user_id", (F.floor("value") % 256).alias("a"), (F.col("event_id") % 256).alias("b"))
    both = M.reconstruction_mse(rows, ["user_id"], "a", "b").join(M.reconstruction_mse(rows, ["user_id"], "a", "b", wrapped=True).withColumnRenamed("loss", "wrapped"), "user_id")
    return both.select("user_id", F.round("loss", 6).alias("loss"), F.round("wrapped", 6).alias("wrapped"))


@query("SELECT 's' || event_id AS sample, CAST(event_id AS DOUBLE) / 4 AS loss, CAST(user_id AS DOUBLE) / 8 AS grad_norm FROM events WHERE event_id % 3 > 0")
def scores_from_log(spark, d) -> DataFrame:
    line = F.when(F.col("event_id") % 3 > 0, F.format_string("sample=s%d, loss=%s, grad_norm=%s", "event_id", F.col("event_id") / 4, F.col("user_id") / 8)).otherwise("epoch done")
    return M.scores_from_log(packets(spark, d).select(line.alias("value")))


CUSTOMERS = "SELECT c_custkey AS id, c_mktsegment AS a, c_nationkey AS b, CAST(FLOOR(c_acctbal / 1000) AS BIGINT) AS c FROM customer"


@query(
    f"WITH c AS ({CUSTOMERS}), x AS (SELECT p.id, m.id AS model_id, CASE WHEN p.a = m.a THEN 1 ELSE 0 END + CASE WHEN p.b = m.b THEN 1 ELSE 0 END + CASE WHEN p.c = m.c THEN 1 ELSE 0 END AS equal FROM c p JOIN c m ON p.id % 2 = 0 AND m.id % 2 = 1), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY equal DESC, model_id) AS rank FROM x WHERE equal > 0) SELECT id, model_id, CAST(equal AS BIGINT) AS equal, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"
)
def nearest_rows(spark, d) -> DataFrame:
    return M.nearest_rows(*neighbours(spark, d), ["a", "b", "c"], 5)


def neighbours(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"), F.floor(F.col("c_acctbal") / 1000).alias("c"))
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


@query("WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, event_type FROM r WHERE r = 1")
def majority_votes(spark, d) -> DataFrame:
    return M.majority(packets(spark, d), ["user_id"], "event_type")


# --- mitigation ------------------------------------------------------------------------------


@query("SELECT event_id, '0.0.0.0' AS ip, CASE WHEN event_type <> 'view' THEN '00:00:00:00:00:00' END AS mac FROM events")
def one_identity(spark, d) -> DataFrame:
    rows = with_ip(spark, d).select("event_id", "ip", F.when(F.col("event_type") != "view", "aa:bb:cc:dd:ee:ff").alias("mac"))
    return MI.one_identity(rows, {"ip": "0.0.0.0", "mac": "00:00:00:00:00:00"})


@query(f"WITH {PACKETS}, i AS (SELECT event_id, address AS a FROM packets) SELECT event_id, CAST(a // 16777216 AS VARCHAR) || '.' || CAST(a // 65536 % 256 AS VARCHAR) || '.0.0' AS ip, 'aa:bb:cc:00:00:00' AS mac FROM i")
def coarse_identities(spark, d) -> DataFrame:
    rows = with_ip(spark, d).select("event_id", "ip", F.lit("aa:bb:cc:dd:ee:ff").alias("mac"))
    return MI.coarsen(rows, ["ip"], ["mac"])


@query("SELECT COUNT(*) AS n, COUNT(*) AS inside, TRUE AS moved FROM events")
def noise_bounds(spark, d) -> DataFrame:
    """Rows with noise: as many, whole numbers within the bounds, and most of them changed."""
    noisy = MI.add_noise(packets(spark, d).withColumn("old", F.col("value")), "user_id", (MI.NoisyField("value", 254.0, 0, 65535),), 0.1, 7)
    return noisy.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").between(0, 65535)).alias("inside"), (F.count_if(F.col("value") != F.col("old")) > F.count(F.lit(1)) / 2).alias("moved"))


# --- instruction sets ------------------------------------------------------------------------


@query("SELECT 'Which kind? ' || user_id AS instruction, event_type AS output, COUNT(*) AS n FROM events GROUP BY ALL")
def instruction_rows(spark, d) -> DataFrame:
    rows = packets(spark, d).select(F.col("user_id").cast("string").alias("data"), "event_type")
    return X.instructions(rows, "Which kind? ", "data", "event_type").groupBy("instruction", "output").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT COUNT(*) AS n, COUNT(*) AS matched, CAST(2 AS BIGINT) AS kinds FROM events")
def field_questions(spark, d) -> DataFrame:
    asked = X.field_questions(packets(spark, d).select("event_id"), {"ttl": "What is the TTL?", "len": "What is the length?"}, 1)
    right = F.col("output") == F.when(F.col("instruction") == "What is the TTL?", "<ttl>").otherwise("<len>")
    return asked.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("matched"), F.countDistinct("output").alias("kinds"))


@query("SELECT event_id, (user_id % 256) || ' 256 ' || 7 || ' -1 257 257' AS ids FROM events")
def encoded_bytes(spark, d) -> DataFrame:
    text = F.concat((F.col("user_id") % 256).cast("string"), F.lit(" <|pkt|>  7 300"))
    rows = X.encode_bytes(packets(spark, d).select("event_id", text.alias("t")), "t", 6)
    return rows.select("event_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("SELECT event_type AS label, COUNT(*) AS n, MIN(CAST(event_id AS VARCHAR)) AS first FROM events GROUP BY event_type")
def responses_by_label(spark, d) -> DataFrame:
    rows = packets(spark, d).select(F.concat(F.lit("make a "), "event_type", F.lit(" packet")).alias("p"), F.col("event_id").cast("string").alias("r"))
    return X.responses_by_label(rows, "p", "r").select("label", F.size("responses").cast("bigint").alias("n"), F.col("responses")[0].alias("first"))


SPLITS = "WITH c AS (SELECT event_type AS l, LEAST(COUNT(*), {cap}) AS n FROM events GROUP BY event_type), s AS (SELECT l, 'train' AS split, CAST(FLOOR(n * 0.95) AS BIGINT) AS n FROM c UNION ALL SELECT l, 'test', n - CAST(FLOOR(n * 0.95) AS BIGINT) FROM c) SELECT {name}, split, n FROM s WHERE n > 0"


@query(SPLITS.format(cap=100, name="l AS label"))
def split_sizes(spark, d) -> DataFrame:
    rows = packets(spark, d).select("event_id", F.col("event_type").alias("label"))
    return X.split_by_class(rows, "label", 100, 0.95, 3).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(SPLITS.format(cap=10**12, name="l AS output"))
def detection_set(spark, d) -> DataFrame:
    rows = packets(spark, d).select(F.col("event_id").cast("string").alias("t"), "event_type")
    return X.detection_set(rows, "t", "event_type", "Which? ").groupBy("output", "split").agg(F.count(F.lit(1)).alias("n"))


@query(SPLITS.format(cap=10**12, name="'Make ' || l || '.' AS instruction"))
def generation_set(spark, d) -> DataFrame:
    rows = packets(spark, d).select(F.col("event_id").cast("string").alias("t"), "event_type")
    return X.generation_set(rows, "t", "event_type", "Make {label}.").groupBy("instruction", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"{HEX} SELECT doc_id, {hex_sql(15, 1)} AS tos, {hex_sql(16, 2)} AS total_length, {hex_sql(23, 1)} AS protocol, {hex_sql(26, 4)} AS src_ip, {hex_sql(30, 4)} AS dst_ip, {hex_sql(36, 2)} AS dst_port, {hex_sql(42, 2)} AS ack_high FROM h")
def more_hex_fields(spark, d) -> DataFrame:
    named = ("tos", "total_length", "protocol", "src_ip", "dst_ip", "dst_port")
    rows = hex_packets(spark, d)
    return rows.select("doc_id", *[P.header_field(F.col("x"), f).alias(f) for f in named], P.hex_number(P.clean_hex(F.col("x")), 42, 2).alias("ack_high"))
