"""Queries over flows and graphs, decoders, attacks and mitigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import bits as B
from ..functions import codecs as K
from ..functions import packets as P
from ..operators import flows as FL
from ..operators import learned as L
from ..operators import membership as M
from ..operators import mitigation as MI
from ..operators import text_sets as X
from ..operators import topology as G
from ..streaming import sessions as SE
from .catalog import PACKETS, halves, packets, query, rounded, table

# --- graphs ----------------------------------------------------------------------------------


@query("SELECT l_suppkey, l_partkey, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL ORDER BY SUM(l_extendedprice) DESC, l_suppkey, l_partkey LIMIT 100")
def top_flows(spark, d) -> DataFrame:
    return G.top_flows(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_extendedprice").withColumn("total", F.round("total", 2))


def edges(spark, d):
    return G.edges_of(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


EDGES = "e AS (SELECT l_orderkey % 2 AS side, CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem WHERE l_suppkey <> l_partkey)"


@query(f"WITH {EDGES} SELECT node, COUNT(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def node_degrees(spark, d) -> DataFrame:
    return G.node_degrees(edges(spark, d))


@query(f"WITH {EDGES} SELECT LEAST(src, dst) AS a, GREATEST(src, dst) AS b, COUNT(*) AS times FROM e GROUP BY ALL")
def undirected_edges(spark, d) -> DataFrame:
    return G.undirected_edges(edges(spark, d))


@query(
    f"""WITH {EDGES}, nd AS (SELECT side, node, COUNT(*) AS n FROM (SELECT side, src AS node FROM e UNION ALL SELECT side, dst FROM e) GROUP BY ALL),
 ed AS (SELECT side, LEAST(src, dst) AS a, GREATEST(src, dst) AS b, COUNT(*) AS n FROM e GROUP BY ALL),
 nf AS (SELECT node, MAX(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS x, MAX(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS y FROM nd GROUP BY node),
 ef AS (SELECT a, b, MAX(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS x, MAX(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS y FROM ed GROUP BY a, b),
 tn AS (SELECT side, node FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY side ORDER BY n DESC, node) AS r FROM nd) WHERE r <= 10),
 te AS (SELECT side, a, b FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY side ORDER BY n DESC, a, b) AS r FROM ed) WHERE r <= 10),
 t AS (SELECT side, COUNT(*) AS t FROM nd GROUP BY side), g AS (SELECT n AS v, SUM(CASE WHEN nd.side = 0 THEN 1.0::DOUBLE / t ELSE -1.0::DOUBLE / t END) AS d FROM nd JOIN t ON nd.side = t.side GROUP BY n),
 w AS (SELECT v, SUM(d) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cd, LEAD(v) OVER (ORDER BY v) - v AS dx FROM g)
 SELECT (SELECT CAST(SUM(x * y) AS BIGINT) FROM nf) AS common_nodes, (SELECT ROUND(SUM(x * y) / CAST(SUM(x) AS DOUBLE), 6) FROM nf) AS nodes_rate, (SELECT CAST(SUM(x * y) AS BIGINT) FROM ef) AS common_edges, (SELECT ROUND(SUM(x * y) / CAST(SUM(x) AS DOUBLE), 6) FROM ef) AS edges_rate,
 (SELECT COUNT(*) FROM tn p JOIN tn q ON p.node = q.node WHERE p.side = 0 AND q.side = 1) AS common_top_nodes, (SELECT COUNT(*) FROM te p JOIN te q ON p.a = q.a AND p.b = q.b WHERE p.side = 0 AND q.side = 1) AS common_top_edges,
 (SELECT ROUND(SUM(ABS(cd) * dx) / (MAX(v) - MIN(v)), 6) FROM w) AS degree_emd"""
)
def topology_report(spark, d) -> DataFrame:
    real, synthetic = (G.edges_of(x, "l_suppkey", "l_partkey") for x in halves(table(spark, d, "lineitem"), "l_orderkey"))
    return rounded(G.compare(real, synthetic))


@query("SELECT address, COUNT(*) AS frequency FROM (SELECT CAST(l_suppkey AS VARCHAR) AS address FROM lineitem UNION ALL SELECT CAST(l_partkey AS VARCHAR) FROM lineitem) GROUP BY address")
def address_frequency(spark, d) -> DataFrame:
    return G.address_frequency(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


# --- flows -----------------------------------------------------------------------------------

KEY, ORDER = ["user_id", "event_type"], ["time", "event_id"]
GAPS = f"WITH {PACKETS}, q AS (SELECT *, time - LAG(time) OVER (PARTITION BY user_id, event_type ORDER BY time, event_id) AS gap FROM packets)"


@query(
    f"{GAPS} SELECT user_id, COUNT(*) AS packet_count, COUNT(DISTINCT port) AS unique_port, ROUND(AVG(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0 END), 6) AS proto_view, ROUND(AVG(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END), 6) AS proto_click, ROUND(AVG(value) + 1e-9, 6) AS value_mean, ROUND(STDDEV_SAMP(value), 6) AS value_std, MIN(value) AS value_min, MAX(value) AS value_max, "
    "ROUND(MAX(time) - MIN(time), 3) AS duration, ROUND(COALESCE(AVG(g), 0), 3) AS iat_mean, ROUND(COALESCE(STDDEV_SAMP(g), 0), 3) AS iat_std FROM (SELECT *, time - LAG(time) OVER (PARTITION BY user_id ORDER BY time, event_id) AS g FROM q) GROUP BY user_id"
)
def flow_features(spark, d) -> DataFrame:
    out = FL.flow_features(packets(spark, d), ["user_id"], "time", ORDER, ["port"], ["value"], "event_type", ["view", "click"])
    return out.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if c == "value_mean" else F.round(c, 3).alias(c) if c in ("duration", "iat_mean", "iat_std") else F.round(c, 6).alias(c) if c.startswith(("proto", "value_std")) else F.col(c) for c in out.columns])


@query(f"WITH {PACKETS} SELECT user_id, event_type, ROUND(MAX(time) - MIN(time), 3) AS duration FROM packets GROUP BY ALL")
def flow_duration(spark, d) -> DataFrame:
    return FL.durations(packets(spark, d), KEY, "time").withColumn("duration", F.round("duration", 3))


@query("SELECT user_id, event_type, COUNT(*) AS length FROM events GROUP BY ALL")
def session_lengths(spark, d) -> DataFrame:
    return FL.lengths(packets(spark, d), KEY)


@query(f"{GAPS} SELECT user_id, event_type, COUNT(*) AS gaps, ROUND(SUM(gap), 3) AS total, ROUND(MAX(gap), 3) AS longest FROM q WHERE gap IS NOT NULL GROUP BY ALL")
def interarrival_gaps(spark, d) -> DataFrame:
    rows = FL.gaps(packets(spark, d), KEY, "time", ORDER)
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("gaps"), F.round(F.sum("gap"), 3).alias("total"), F.round(F.max("gap"), 3).alias("longest"))


@query(f"WITH {PACKETS} SELECT event_id, CAST(CAST(r - 1 AS BIGINT) // CAST(CEIL(t / 8.0) AS BIGINT) AS INTEGER) AS chunk FROM (SELECT event_id, ROW_NUMBER() OVER (ORDER BY time, event_id) AS r, COUNT(*) OVER () AS t FROM packets)")
def chunks_fixed_size(spark, d) -> DataFrame:
    return FL.fixed_size_chunks(packets(spark, d), "time", "event_id", 8).select("event_id", "chunk")


@query(f"WITH {PACKETS}, s AS (SELECT MIN(time) AS lo, MAX(time) AS hi FROM packets), c AS (SELECT event_id, LEAST(FLOOR((time - lo) * 8 / ((hi - lo) * 1.00001)), 7) AS span FROM packets, s) SELECT event_id, CAST(DENSE_RANK() OVER (ORDER BY span) - 1 AS INTEGER) AS chunk FROM c")
def chunks_fixed_time(spark, d) -> DataFrame:
    return FL.fixed_time_chunks(packets(spark, d), "time", 8).select("event_id", "chunk")


@query(f"WITH {PACKETS}, s AS (SELECT MIN(time) AS lo, MAX(time) AS hi FROM packets), c AS (SELECT user_id, event_type, DENSE_RANK() OVER (ORDER BY LEAST(FLOOR((time - lo) * 8 / ((hi - lo) * 1.00001)), 7)) AS chunk FROM packets, s), k AS (SELECT DISTINCT user_id, event_type, chunk FROM c), g AS (SELECT *, chunk - LAG(chunk) OVER (PARTITION BY user_id, event_type ORDER BY chunk) AS step FROM k) SELECT user_id, event_type, CAST(COUNT(*) AS INTEGER) AS n_chunks, COUNT(DISTINCT step) <= 1 AS even FROM g GROUP BY ALL")
def cross_chunk_flows(spark, d) -> DataFrame:
    return FL.cross_chunk_flows(FL.fixed_time_chunks(packets(spark, d), "time", 8), KEY).drop("chunks")


@query(f"WITH {PACKETS} SELECT event_id, position FROM (SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY time, event_id) AS INTEGER) AS position FROM packets) WHERE position <= 5")
def head_per_flow(spark, d) -> DataFrame:
    return FL.head_per_flow(packets(spark, d), KEY, ORDER, 5).select("event_id", "position")


@query(
    f"""WITH {PACKETS}, f AS (SELECT DENSE_RANK() OVER (ORDER BY user_id, event_type) AS flow, value, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY time, event_id) AS i FROM packets), m AS (SELECT MAX(i) AS n FROM f), u AS (SELECT DISTINCT flow FROM f),
 s AS (SELECT u.flow, i.i, COALESCE(f.value, 0) AS x FROM u CROSS JOIN (SELECT UNNEST(RANGE(1, n + 1)) AS i FROM m) i LEFT JOIN f ON f.flow = u.flow AND f.i = i.i),
 p AS (SELECT b.i - a.i AS lag, a.flow, a.x AS a, b.x AS b FROM s a JOIN s b ON a.flow = b.flow AND b.i > a.i CROSS JOIN m WHERE b.i - a.i <= GREATEST(n - 2, 1)),
 r AS (SELECT lag, flow, CASE WHEN MIN(a) < MAX(a) AND MIN(b) < MAX(b) THEN CORR(a, b) END AS r FROM p GROUP BY ALL)
 SELECT CAST(lag AS INTEGER) AS lag, ROUND(AVG(CASE WHEN r IS NULL OR r = 0 THEN 1e-8 ELSE r END), 6) AS r FROM r GROUP BY lag"""
)
def autocorrelation(spark, d) -> DataFrame:
    return rounded(FL.autocorrelation(packets(spark, d), KEY, ORDER, "value"))


@query(
    f"""WITH {PACKETS}, f AS (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY time, event_id) AS i FROM packets), m AS (SELECT MAX(i) AS n FROM f), u AS (SELECT DISTINCT user_id FROM f),
 s AS (SELECT u.user_id, i.i, COALESCE(f.value, 0) AS x FROM u CROSS JOIN (SELECT UNNEST(RANGE(1, n + 1)) AS i FROM m) i LEFT JOIN f ON f.user_id = u.user_id AND f.i = i.i),
 p AS (SELECT b.i - a.i AS lag, a.user_id, a.x AS a, b.x AS b FROM s a JOIN s b ON a.user_id = b.user_id AND b.i > a.i CROSS JOIN m WHERE b.i - a.i <= GREATEST(n - 2, 1)),
 r AS (SELECT lag, user_id, CASE WHEN MIN(a) < MAX(a) AND MIN(b) < MAX(b) THEN CORR(a, b) END AS r FROM p GROUP BY ALL)
 SELECT CAST(lag AS INTEGER) AS lag, ROUND(AVG(CASE WHEN r IS NULL OR r = 0 THEN 1e-8 ELSE r END), 6) AS r FROM r GROUP BY lag"""
)
def autocorrelation_whole(spark, d) -> DataFrame:
    return rounded(FL.autocorrelation(packets(spark, d), ["user_id"], ORDER, "value"))


@query("WITH s AS (SELECT event_type AS candidate, UNNEST(['mean', 'std', 'max']) AS metric, UNNEST([AVG(value), STDDEV_SAMP(value), MAX(value)]) AS value FROM events GROUP BY event_type), k AS (SELECT candidate, RANK() OVER (PARTITION BY metric ORDER BY value) + (COUNT(*) OVER (PARTITION BY metric, value) - 1) / CAST(2 AS DOUBLE) AS r FROM s) SELECT candidate, SUM(r) AS rank_sum FROM k GROUP BY candidate")
def candidate_ranking(spark, d) -> DataFrame:
    stats = packets(spark, d).groupBy(F.col("event_type").alias("candidate")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("max"))
    return FL.candidate_ranking(stats.unpivot(["candidate"], ["mean", "std", "max"], "metric", "value"))


@query("WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, epoch_us(MIN(ts)) AS started, COUNT(*) AS packets, ROUND(SUM(value), 4) AS bytes FROM s GROUP BY user_id, n")
def flow_sessions(spark, d) -> DataFrame:
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = SE.flow_sessions(rows, "at", ["user_id"], "value", "2 hours")
    return out.select("user_id", F.unix_micros("started").alias("started"), "packets", F.round("bytes", 4).alias("bytes"))


# --- decoders --------------------------------------------------------------------------------

IP_SQL = "CAST(a // 16777216 AS VARCHAR) || '.' || CAST(a // 65536 % 256 AS VARCHAR) || '.' || CAST(a // 256 % 256 AS VARCHAR) || '.' || CAST(a % 256 AS VARCHAR)"
IPS = f"WITH {PACKETS}, i AS (SELECT event_id, a, {IP_SQL} AS ip FROM (SELECT event_id, address AS a FROM packets))"


def with_ip(spark, d):
    return packets(spark, d).withColumn("ip", A.int_to_ip(F.col("address")))


@query(f"{IPS} SELECT event_id, ip FROM i")
def int_to_ip(spark, d) -> DataFrame:
    return with_ip(spark, d).select("event_id", "ip")


@query(f"{IPS} SELECT event_id, a AS number FROM i")
def ip_to_int(spark, d) -> DataFrame:
    return with_ip(spark, d).select("event_id", A.ip_to_int(F.col("ip")).alias("number"))


@query(f"{IPS} SELECT event_id, LPAD(BIN(a), 32, '0') AS bits, ip FROM i")
def ip_bits(spark, d) -> DataFrame:
    return with_ip(spark, d).withColumn("bits", A.ip_to_bits(F.col("ip"))).select("event_id", "bits", A.bits_to_ip(F.col("bits")).alias("ip"))


@query(f"{IPS} SELECT event_id, CAST(a // 16777216 AS VARCHAR) || '.' || CAST(a // 65536 % 256 AS VARCHAR) || '.0.0' AS ip FROM i")
def mask_subnet(spark, d) -> DataFrame:
    return with_ip(spark, d).select("event_id", A.mask_subnet(F.col("ip")).alias("ip"))


@query("SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 2 + 4 WHEN 'view' THEN 16 WHEN 'signup' THEN 2 + 16 WHEN 'click' THEN 0 ELSE 1 + 8 + 16 END AS INTEGER) AS mask FROM events")
def tcp_flags_mask(spark, d) -> DataFrame:
    letters = F.when(F.col("event_type") == "error", "SR").when(F.col("event_type") == "view", "A").when(F.col("event_type") == "signup", "SA").when(F.col("event_type") == "click", "0").otherwise("FPA")
    return packets(spark, d).select("event_id", P.tcp_flags_mask(letters).alias("mask"))


@query("SELECT event_id, CAST(value AS BIGINT) % 65536 AS number FROM (SELECT event_id, FLOOR(value) AS value FROM events)")
def bits_to_int(spark, d) -> DataFrame:
    return packets(spark, d).select("event_id", B.bits_to_int(B.int_to_bits(F.floor("value") % 65536, 16)).alias("number"))


@query("SELECT event_id, LPAD(BIN(CAST(FLOOR(value) AS BIGINT) % 256), 8, '0') AS print FROM events")
def fingerprint(spark, d) -> DataFrame:
    return packets(spark, d).select("event_id", B.fingerprint(B.int_to_bits(F.floor("value") % 256, 8)).alias("print"))


HEX = "WITH h AS (SELECT doc_id, substr(md5(text) || md5(text || 'x'), 1, 28) || '45' || substr(md5(text || 'y') || md5(text || 'z'), 1, 60) AS x FROM documents)"


def hex_packets(spark, d):
    """Made-up packets from digests of the documents, with an IPv4 header of five words."""
    t = F.col("text")
    both = lambda a, b: F.concat(F.md5(a), F.md5(b))
    x = lambda s: F.concat(t, F.lit(s))
    return table(spark, d, "documents").select("doc_id", F.concat(F.substring(both(t, x("x")), 1, 28), F.lit("45"), F.substring(both(x("y"), x("z")), 1, 60)).alias("x"))


def hex_sql(first: int, n: int) -> str:
    return f"CAST('0x' || substr(x, {2 * first + 1}, {2 * n}) AS BIGINT)"


@query(f"{HEX} SELECT doc_id, {hex_sql(22, 1)} AS ttl, {hex_sql(18, 2)} AS ip_id, {hex_sql(34, 2)} AS src_port, {hex_sql(38, 4)} AS seq FROM h")
def hex_fields(spark, d) -> DataFrame:
    return hex_packets(spark, d).select("doc_id", *[P.header_field(F.col("x"), f).alias(f) for f in ("ttl", "ip_id", "src_port", "seq")])


@query(f"{HEX} SELECT doc_id, regexp_replace(substr(x, 1, 12), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS dst, regexp_replace(substr(x, 13, 12), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS src FROM h")
def mac_from_payload(spark, d) -> DataFrame:
    text = F.concat(F.lit("{'proto': 'TCP'} "), "x")
    return hex_packets(spark, d).select("doc_id", P.mac_from_payload(text, "dst").alias("dst"), P.mac_from_payload(text, "src").alias("src"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 3, 5), ' ') AS slice FROM documents")
def byte_slice(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.byte_slice(F.col("text"), 2, 5).alias("slice"))


@query(f"WITH {PACKETS} SELECT event_id, 'h' || user_id AS src, event_type AS proto FROM packets")
def header_values(spark, d) -> DataFrame:
    text = F.concat(F.lit("x {'src': 'h"), "user_id", F.lit("', 'proto': '"), "event_type", F.lit("'} 00ff"))
    return packets(spark, d).withColumn("t", text).select("event_id", P.ip_value(F.col("t"), "src").alias("src"), P.header_value(F.col("t"), "proto").alias("proto"))


# --- codecs ----------------------------------------------------------------------------------


@query("WITH m AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events) SELECT event_id, ROUND((value - lo) / (hi - lo), 6) AS code, ROUND(value, 4) AS back FROM events, m")
def minmax_codec(spark, d) -> DataFrame:
    rows = packets(spark, d)
    codec = K.MinMax.fit(rows, "value")
    coded = rows.select("event_id", codec.encode(F.col("value")).alias("code"))
    return coded.select("event_id", F.round("code", 6).alias("code"), F.round(codec.decode(F.col("code")), 4).alias("back"))


@query("SELECT event_id, event_type AS back, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) AS place FROM events")
def onehot_codec(spark, d) -> DataFrame:
    rows = packets(spark, d)
    codec = K.OneHot.fit(rows, "event_type")
    coded = rows.select("event_id", codec.encode(F.col("event_type")).alias("code"))
    return coded.select("event_id", codec.decode(F.col("code")).alias("back"), F.array_position("code", 1).cast("int").alias("place"))


@query("SELECT event_id, user_id * 2654435761 % 4294967296 AS back FROM events")
def bit_codec(spark, d) -> DataFrame:
    codec = K.Bits(32)
    return packets(spark, d).select("event_id", codec.decode(codec.encode(F.col("address"))).alias("back"))


# --- attacks ---------------------------------------------------------------------------------

CAP_KEYS, CAP_SENSITIVE = ["l_quantity", "l_returnflag"], ["l_linestatus"]
CAP = "WITH s AS (SELECT l_quantity AS k1, l_returnflag AS k2, l_linestatus AS v, CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL), t AS (SELECT k1, k2, SUM(n) AS t FROM s GROUP BY ALL), r AS (SELECT l_quantity AS k1, l_returnflag AS k2, l_linestatus AS v FROM lineitem WHERE l_orderkey % 2 = 0)"


def cap_sides(spark, d):
    return halves(table(spark, d, "lineitem").select("l_orderkey", *CAP_KEYS, *CAP_SENSITIVE), "l_orderkey")


@query(f"{CAP} SELECT ROUND(1 - AVG(COALESCE(n, 0) / t), 6) AS score FROM r JOIN t ON r.k1 = t.k1 AND r.k2 = t.k2 LEFT JOIN s ON r.k1 = s.k1 AND r.k2 = s.k2 AND r.v = s.v")
def cap(spark, d) -> DataFrame:
    return rounded(M.cap(*cap_sides(spark, d), CAP_KEYS, CAP_SENSITIVE))


@query(f"{CAP} SELECT ROUND(1 - AVG(COALESCE(n / t, 0)), 6) AS score FROM r LEFT JOIN t ON r.k1 = t.k1 AND r.k2 = t.k2 LEFT JOIN s ON r.k1 = s.k1 AND r.k2 = s.k2 AND r.v = s.v")
def zero_cap(spark, d) -> DataFrame:
    return rounded(M.cap(*cap_sides(spark, d), CAP_KEYS, CAP_SENSITIVE, zero=True))


@query(
    "WITH s AS (SELECT user_id AS k1, event_type AS k2, json_extract_string(props, '$.k') AS v FROM events WHERE event_id % 2 = 1), r AS (SELECT user_id AS k1, event_type AS k2, json_extract_string(props, '$.k') AS v, COUNT(*) AS m FROM events WHERE event_id % 2 = 0 GROUP BY ALL), "
    "sk AS (SELECT k1, k2, v, COUNT(*) AS n FROM s GROUP BY ALL), x AS (SELECT r.k1, r.k2, r.v, r.m, (CASE WHEN r.k1 <> sk.k1 THEN 1 ELSE 0 END + CASE WHEN r.k2 <> sk.k2 THEN 1 ELSE 0 END) AS h, sk.v AS sv, n FROM r CROSS JOIN sk), "
    "b AS (SELECT k1, k2, v, m, h, sv, n, MIN(h) OVER (PARTITION BY k1, k2, v) AS least FROM x), y AS (SELECT k1, k2, v, m, SUM(CASE WHEN sv = v THEN n ELSE 0 END) / CAST(SUM(n) AS DOUBLE) AS p FROM b WHERE h = least GROUP BY ALL) SELECT ROUND(1 - SUM(m * p) / SUM(m), 6) AS score FROM y"
)
def generalized_cap(spark, d) -> DataFrame:
    real, synthetic = halves(packets(spark, d).select("event_id", "user_id", "event_type", "port"), "event_id")
    return rounded(M.generalized_cap(real, synthetic, ["user_id", "event_type"], ["port"]))


MEMBERS = "WITH m AS (SELECT toxic AS y, CAST(n_chars AS DOUBLE) AS x FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"


def members(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query(f"{MEMBERS}, k AS (SELECT y, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / CAST(2 AS DOUBLE) AS r FROM m) SELECT ROUND((SUM(r) FILTER (y = 1) - COUNT(*) FILTER (y = 1) * (COUNT(*) FILTER (y = 1) + 1) / CAST(2 AS DOUBLE)) / (COUNT(*) FILTER (y = 1) * COUNT(*) FILTER (y <> 1)), 6) AS auc FROM k")
def membership_auc(spark, d) -> DataFrame:
    return rounded(M.membership_auc(members(spark, d), "toxic", "n_chars"))


RUNS = f"{MEMBERS}, v AS (SELECT x, CAST(COUNT(*) FILTER (y = 1) AS DOUBLE) AS p, CAST(COUNT(*) FILTER (y <> 1) AS DOUBLE) AS n FROM m GROUP BY x), c AS (SELECT p, n, SUM(p) OVER w AS cp, SUM(n) OVER w AS cn, SUM(p) OVER () AS tp, SUM(n) OVER () AS tn FROM v WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))"


@query(f"{RUNS.replace('WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)', '').replace('OVER w', 'OVER (ORDER BY x ROWS UNBOUNDED PRECEDING)')} SELECT ROUND(MAX(ABS(cp / tp - cn / tn)), 6) AS ks FROM c")
def membership_ks(spark, d) -> DataFrame:
    return rounded(M.membership_ks(members(spark, d), "toxic", "n_chars"))


@query(f"{RUNS.replace('WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)', '').replace('OVER w', 'OVER (ORDER BY x ROWS UNBOUNDED PRECEDING)')} SELECT ROUND(COALESCE(MAX((tp - cp + p) / tp) FILTER ((tn - cn + n) / tn <= 0.1), 0), 6) AS tpr FROM c")
def membership_tpr(spark, d) -> DataFrame:
    return rounded(M.membership_tpr(members(spark, d), "toxic", "n_chars", 0.1))


def guesses(spark, d):
    """Labels with a made-up guess: short documents are taken for bad ones."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select(F.col("quality").cast("string").alias("actual"), F.when(F.col("n_chars") < 1500, "0").otherwise("1").alias("guess"))


GUESSES = "WITH g AS (SELECT CAST(quality AS VARCHAR) AS a, CASE WHEN n_chars < 1500 THEN '0' ELSE '1' END AS b FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"
PRF = f"{GUESSES}, x AS (SELECT a AS label, COUNT(*) AS support, COUNT(*) FILTER (a = b) AS hit FROM g GROUP BY a), y AS (SELECT b AS label, COUNT(*) AS named FROM g GROUP BY b), z AS (SELECT x.label, COALESCE(hit / CAST(named AS DOUBLE), 0) AS p, hit / CAST(support AS DOUBLE) AS r, support FROM x LEFT JOIN y ON x.label = y.label)"


@query(f"{GUESSES} SELECT a AS actual, b AS predicted, COUNT(*) AS n FROM g GROUP BY ALL")
def confusion_matrix(spark, d) -> DataFrame:
    return M.confusion(guesses(spark, d), "actual", "guess")


@query(f"{PRF} SELECT label, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM z")
def label_scores(spark, d) -> DataFrame:
    return rounded(M.label_scores(guesses(spark, d), "actual", "guess"))


@query(f"{PRF}, q AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM z) SELECT ROUND(SUM(r * support) / SUM(support), 6) AS accuracy, ROUND(SUM(p * support) / SUM(support), 6) AS weighted_precision, ROUND(SUM(r * support) / SUM(support), 6) AS weighted_recall, ROUND(SUM(f * support) / SUM(support), 6) AS weighted_f1, ROUND(AVG(f), 6) AS macro_f1 FROM q")
def label_summary(spark, d) -> DataFrame:
    return rounded(M.label_summary(guesses(spark, d), "actual", "guess"))


@query("SELECT user_id, ROUND(EXP(AVG(value / 100)), 6) AS perplexity FROM events GROUP BY user_id")
def perplexity(spark, d) -> DataFrame:
    return rounded(M.perplexity(packets(spark, d).withColumn("loss", F.col("value") / 100), ["user_id"], "loss"))


@query("SELECT user_id, ROUND(SQRT(SUM(value * value)), 4) AS grad_norm FROM events GROUP BY user_id")
def gradient_norm(spark, d) -> DataFrame:
    return M.gradient_norm(packets(spark, d), ["user_id"], "value").withColumn("grad_norm", F.round("grad_norm", 4))


@query()
def detection_score(spark, d) -> DataFrame:
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    return L.detection(real, synthetic, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])


@query()
def downstream_accuracy(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem")
    real, synthetic = halves(rows, "l_orderkey")
    train, test = real.where(F.col("l_orderkey") % 4 == 0), real.where(F.col("l_orderkey") % 4 == 2)
    return rounded(L.downstream(train, synthetic, test, ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"], "l_returnflag", "decision_tree"))


# --- mitigation ------------------------------------------------------------------------------


@query("SELECT user_id, COALESCE(NULLIF(MAX(value) - MIN(value), 0), 254) AS sens_value FROM events GROUP BY user_id")
def dp_sensitivity(spark, d) -> DataFrame:
    return MI.sensitivities(packets(spark, d), "user_id", (MI.NoisyField("value", 254.0),))


@query()
def dp_laplace(spark, d) -> DataFrame:
    fields = (MI.NoisyField("value", 254.0, 0, 65535), MI.NoisyField("time", 1.0))
    return MI.add_noise(packets(spark, d), "user_id", fields, 0.1, 7).select("event_id", "value", "time")


@query("WITH p AS (SELECT event_id, substr(sha256('k' || CAST(user_id AS VARCHAR)), 1, 8) AS h FROM events) SELECT event_id, " + IP_SQL.replace("a ", "CAST('0x' || h AS BIGINT) ") + " AS ip FROM p")
def pseudonymize(spark, d) -> DataFrame:
    rows = packets(spark, d).select("event_id", F.col("user_id").cast("string").alias("ip"))
    return MI.pseudonymize(rows, ["ip"], [], "k")


@query("SELECT event_type AS label, ROW_NUMBER() OVER (ORDER BY event_type) - 1 AS index FROM (SELECT DISTINCT event_type FROM events)")
def label_index(spark, d) -> DataFrame:
    return X.label_index(packets(spark, d).withColumnRenamed("event_type", "label"), "label").withColumn("index", F.col("index").cast("bigint"))


@query()
def split_dataset(spark, d) -> DataFrame:
    rows = packets(spark, d).select("event_id", "event_type")
    return X.split_by_class(rows, "event_type", 100, 0.95, 3)
