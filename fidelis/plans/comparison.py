"""Queries that compare distributions, sets and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import distances as D
from ..operators import quality as Q
from ..operators import sets as S
from ..operators import tables as T
from .catalog import JSD, ORACLE, PACKETS, SIGNED, halves, long_sql, packets, query, rounded, shares_sql, sides, table

CATS = {"event_type": "event_type", "port": "port"}
NUMS = {"value": "value", "time": "time"}
LINE_NUMS = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount"}
LINE_CATS = {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_linenumber": "l_linenumber"}
EV_CATS = f"WITH {PACKETS}, {long_sql('packets', 'event_id', CATS, 'VARCHAR')}, {shares_sql()}"
EV_NUMS = f"WITH {PACKETS}, {long_sql('packets', 'event_id', NUMS, 'DOUBLE')}"
LN_NUMS = f"WITH {long_sql('lineitem', 'l_orderkey', LINE_NUMS, 'DOUBLE')}"
LN_CATS = f"WITH {long_sql('lineitem', 'l_orderkey', LINE_CATS, 'VARCHAR')}"
EMD_SQL = "(SELECT field, CASE WHEN COUNT(*) > 1 THEN SUM(ABS(cum)) / (COUNT(*) - 1) ELSE 0 END AS emd FROM (SELECT field, value, SUM(p - q) OVER (PARTITION BY field ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum FROM sh) GROUP BY field)"


def events(spark, d, fields):
    return sides(packets(spark, d), "event_id", list(fields))


def lines(spark, d, fields):
    return sides(table(spark, d, "lineitem"), "l_orderkey", list(fields))


@query(f"{EV_CATS} SELECT j.field, ROUND(jsd, 6) AS jsd, ROUND(emd, 6) AS emd FROM (SELECT field, SQRT(GREATEST({JSD}, 0)) AS jsd FROM sh GROUP BY field) j JOIN {EMD_SQL} e ON j.field = e.field")
def fidelity_categorical(spark, d) -> DataFrame:
    both = events(spark, d, CATS)
    return rounded(D.jsd(both, list(CATS)).join(D.categorical_emd(both, list(CATS)), "field"))


@query(f"{EV_CATS} SELECT ROUND(AVG(jsd), 6) AS mean_jsd, ROUND(AVG(emd), 6) AS mean_emd FROM (SELECT field, SQRT(GREATEST({JSD}, 0)) AS jsd FROM sh GROUP BY field) j JOIN {EMD_SQL} e ON j.field = e.field")
def fidelity_report_mean(spark, d) -> DataFrame:
    both = events(spark, d, CATS)
    return rounded(D.jsd(both, list(CATS)).join(D.categorical_emd(both, list(CATS)), "field").agg(F.avg("jsd").alias("mean_jsd"), F.avg("emd").alias("mean_emd")))


@query(f"{EV_CATS} SELECT field, ROUND({JSD}, 6) + 0.0 AS jsd FROM sh GROUP BY field")
def jsd_divergence(spark, d) -> DataFrame:
    return rounded(D.jsd(events(spark, d, CATS), list(CATS), squared=True))


@query(f"WITH {PACKETS}, {long_sql('packets', 'event_id', {'joint': chr(39) + 'x' + chr(39) + ' || event_type || ' + chr(39) + '|' + chr(39) + ' || port'}, 'VARCHAR')}, {shares_sql()} SELECT field, ROUND(SQRT({JSD}), 6) AS jsd FROM sh GROUP BY field")
def tuple_jsd(spark, d) -> DataFrame:
    return rounded(D.tuple_jsd(events(spark, d, CATS), list(CATS)))


@query(f"{EV_NUMS}, {SIGNED} SELECT field, ROUND(SUM(ABS(cd) * dx), 4) AS emd, ROUND(SUM(ABS(cd) * dx) / (MAX(value) - MIN(value)), 6) AS emd_of_range, ROUND(MAX(ABS(cd)), 6) AS ks FROM w GROUP BY field")
def property_divergence(spark, d) -> DataFrame:
    out = D.wasserstein(events(spark, d, NUMS), list(NUMS))
    return out.select("field", F.round("emd", 4).alias("emd"), F.round("emd_of_range", 6).alias("emd_of_range"), F.round("ks", 6).alias("ks"))


@query(f"{LN_NUMS}, {SIGNED} SELECT field, ROUND(1 - MAX(ABS(cd)), 6) AS score FROM w GROUP BY field")
def ks_complement(spark, d) -> DataFrame:
    return rounded(C.ks_complement(lines(spark, d, LINE_NUMS), list(LINE_NUMS)))


@query(f"{LN_CATS}, {shares_sql(1e-6)} SELECT field, ROUND(1 - 0.5 * SUM(ABS(p - q)), 6) AS score FROM sh GROUP BY field")
def tv_complement(spark, d) -> DataFrame:
    return rounded(C.tv_complement(lines(spark, d, LINE_CATS), list(LINE_CATS)))


@query(f"{LN_CATS}, {shares_sql(1e-6)} SELECT field, ROUND(SUM((q - p) * (q - p) / p), 6) AS statistic, COUNT(*) - 1 AS freedom FROM sh GROUP BY field")
def chi_square_statistic(spark, d) -> DataFrame:
    return rounded(C.chi_square(lines(spark, d, LINE_CATS), list(LINE_CATS)))


@query()
def chi_square_score(spark, d) -> DataFrame:
    return rounded(C.chi_square_score(lines(spark, d, LINE_CATS), list(LINE_CATS)))


@query(f"{LN_CATS}, {shares_sql()} SELECT field, ROUND(AVG(CASE WHEN q > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS score FROM sh WHERE p > 0 GROUP BY field")
def category_coverage(spark, d) -> DataFrame:
    return rounded(C.category_coverage(lines(spark, d, LINE_CATS), list(LINE_CATS)))


LIMITS = "m AS (SELECT field, MIN(value) FILTER (side = 'real') AS a0, MAX(value) FILTER (side = 'real') AS a1, MIN(value) FILTER (side = 'synthetic') AS b0, MAX(value) FILTER (side = 'synthetic') AS b1 FROM l GROUP BY field)"


@query(f"{EV_NUMS}, {LIMITS} SELECT field, ROUND(GREATEST(1 - GREATEST((b0 - a0) / (a1 - a0), 0) - GREATEST((a1 - b1) / (a1 - a0), 0), 0), 6) AS score FROM m")
def range_coverage(spark, d) -> DataFrame:
    return rounded(C.range_coverage(events(spark, d, NUMS), list(NUMS)))


@query(f"{EV_NUMS}, {LIMITS} SELECT field, ROUND(CASE WHEN LEAST(a1, b1) < GREATEST(a0, b0) THEN 0 ELSE (LEAST(a1, b1) - GREATEST(a0, b0)) / (GREATEST(a1, b1) - LEAST(a0, b0)) END, 6) AS score FROM m")
def interval_overlap(spark, d) -> DataFrame:
    return rounded(C.interval_overlap(events(spark, d, NUMS), list(NUMS)))


@query(f"{EV_NUMS}, {LIMITS} SELECT l.field, ROUND(AVG(CASE WHEN value BETWEEN a0 AND a1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS score FROM l JOIN m ON l.field = m.field WHERE side = 'synthetic' AND value IS NOT NULL GROUP BY l.field")
def boundary_adherence(spark, d) -> DataFrame:
    return rounded(C.boundary_adherence(events(spark, d, NUMS), list(NUMS)))


@query(f"WITH {PACKETS}, {long_sql('packets', 'event_id', {'value': 'value', 'gap': 'NULLIF(port, 1)'}, 'VARCHAR')} SELECT field, ROUND(1 - ABS(AVG(CASE WHEN value IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) FILTER (side = 'real') - AVG(CASE WHEN value IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) FILTER (side = 'synthetic')), 6) AS score FROM l GROUP BY field")
def missing_value_similarity(spark, d) -> DataFrame:
    both = sides(packets(spark, d).withColumn("gap", F.expr("nullif(port, 1)")), "event_id", ["value", "gap"])
    return rounded(C.missing_value_similarity(both, ["value", "gap"]))


def _statistic(name: str, sql: str) -> None:
    def run(spark, d) -> DataFrame:
        return rounded(C.statistic_similarity(lines(spark, d, LINE_NUMS), list(LINE_NUMS), name))

    run.__name__ = f"statistic_similarity_{name}"
    query(f"{LN_NUMS}, x AS (SELECT field, {sql} FILTER (side = 'real') AS r, {sql} FILTER (side = 'synthetic') AS s, MAX(value) FILTER (side = 'real') - MIN(value) FILTER (side = 'real') AS span FROM l GROUP BY field) SELECT field, ROUND(GREATEST(1 - ABS(r - s) / span, 0), 6) AS score FROM x")(run)


for _name, _sql in (("mean", "AVG(value)"), ("std", "STDDEV_SAMP(value)"), ("median", "QUANTILE_CONT(value, 0.5)")):
    _statistic(_name, _sql)

NUM_PAIRS, CAT_PAIRS = C.pair_names(list(LINE_NUMS)), C.pair_names(list(LINE_CATS))


def pair_sql(pairs, kind: str) -> str:
    return "l AS (" + " UNION ALL ".join(f"SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS side, '{a}|{b}' AS pair, CAST({a} AS {kind}) AS a, CAST({b} AS {kind}) AS b FROM lineitem" for a, b in pairs) + ")"


@query(f"WITH {pair_sql(NUM_PAIRS, 'DOUBLE')} SELECT pair, ROUND(1 - ABS(CORR(a, b) FILTER (side = 'real') - CORR(a, b) FILTER (side = 'synthetic')) / 2, 6) AS score FROM l GROUP BY pair")
def correlation_pearson(spark, d) -> DataFrame:
    return rounded(C.correlation_similarity(lines(spark, d, LINE_NUMS), NUM_PAIRS))


@query(
    f"WITH {pair_sql(NUM_PAIRS, 'DOUBLE')}, k AS (SELECT side, pair, RANK() OVER (PARTITION BY side, pair ORDER BY a) + (COUNT(*) OVER (PARTITION BY side, pair, a) - 1) / CAST(2 AS DOUBLE) AS a, RANK() OVER (PARTITION BY side, pair ORDER BY b) + (COUNT(*) OVER (PARTITION BY side, pair, b) - 1) / CAST(2 AS DOUBLE) AS b FROM l) "
    "SELECT pair, ROUND(1 - ABS(CORR(a, b) FILTER (side = 'real') - CORR(a, b) FILTER (side = 'synthetic')) / 2, 6) AS score FROM k GROUP BY pair"
)
def correlation_spearman(spark, d) -> DataFrame:
    return rounded(C.correlation_similarity(lines(spark, d, LINE_NUMS), NUM_PAIRS, "spearman"))


JOINT = "c AS (SELECT pair, a, b, CAST(COUNT(*) FILTER (side = 'real') AS DOUBLE) AS r, CAST(COUNT(*) FILTER (side = 'synthetic') AS DOUBLE) AS s FROM l GROUP BY ALL)"


@query(f"WITH {pair_sql(CAT_PAIRS, 'VARCHAR')}, {JOINT}, sh AS (SELECT pair, r / SUM(r) OVER (PARTITION BY pair) AS p, s / SUM(s) OVER (PARTITION BY pair) AS q FROM c) SELECT pair, ROUND(1 - 0.5 * SUM(ABS(p - q)), 6) AS score FROM sh GROUP BY pair")
def contingency_similarity(spark, d) -> DataFrame:
    return rounded(C.contingency_similarity(lines(spark, d, LINE_CATS), CAT_PAIRS))


@query(f"WITH {pair_sql(CAT_PAIRS, 'VARCHAR')}, {JOINT}, e AS (SELECT pair, CASE WHEN r = 0 THEN 1e-6 ELSE r END AS r, s FROM c), sh AS (SELECT pair, r / SUM(r) OVER (PARTITION BY pair) AS p, s / SUM(s) OVER (PARTITION BY pair) AS q FROM e) SELECT pair, ROUND(1 / (1 + SUM(CASE WHEN q > 0 THEN q * LN(q / p) - q + p ELSE p END)), 6) AS score FROM sh GROUP BY pair")
def discrete_kl(spark, d) -> DataFrame:
    return rounded(C.discrete_kl(lines(spark, d, LINE_CATS), CAT_PAIRS))


@query(
    f"WITH {pair_sql(NUM_PAIRS, 'DOUBLE')}, m AS (SELECT pair, MIN(a) AS a0, MAX(a) AS a1, MIN(b) AS b0, MAX(b) AS b1 FROM l WHERE side = 'real' GROUP BY pair), "
    "c AS (SELECT l.pair, LEAST(FLOOR((a - a0) * 10 / (a1 - a0)), 9) AS x, LEAST(FLOOR((b - b0) * 10 / (b1 - b0)), 9) AS y, CAST(COUNT(*) FILTER (side = 'real') AS DOUBLE) AS r, CAST(COUNT(*) FILTER (side = 'synthetic') AS DOUBLE) AS s FROM l JOIN m ON l.pair = m.pair WHERE a BETWEEN a0 AND a1 AND b BETWEEN b0 AND b1 GROUP BY ALL), "
    "sh AS (SELECT pair, (r / SUM(r) OVER (PARTITION BY pair) + 1e-5) / 1.001 AS p, (s / SUM(s) OVER (PARTITION BY pair) + 1e-5) / 1.001 AS q FROM c) SELECT pair, ROUND(1 / (1 + SUM(q * LN(q / p))), 6) AS score FROM sh GROUP BY pair"
)
def continuous_kl(spark, d) -> DataFrame:
    return rounded(C.continuous_kl(lines(spark, d, LINE_NUMS), NUM_PAIRS))


@query(
    "WITH m AS (SELECT MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT CASE WHEN l_quantity IS NULL OR l_quantity >= hi THEN 11 WHEN l_quantity < lo THEN 0 ELSE FLOOR((l_quantity - lo) * 10 / (hi - lo)) + 1 END AS a, l_returnflag AS b, CAST(COUNT(*) FILTER (l_orderkey % 2 = 0) AS DOUBLE) AS r, CAST(COUNT(*) FILTER (l_orderkey % 2 = 1) AS DOUBLE) AS s FROM lineitem, m GROUP BY ALL) "
    "SELECT 'l_quantity|l_returnflag' AS pair, ROUND(1 - 0.5 * SUM(ABS(r / tr - s / ts)), 6) AS score FROM c, (SELECT SUM(r) AS tr, SUM(s) AS ts FROM c)"
)
def discretized_contingency(spark, d) -> DataFrame:
    both = C.discretized(lines(spark, d, ["l_quantity", "l_returnflag"]), ["l_quantity"])
    return rounded(C.contingency_similarity(both, [("l_quantity", "l_returnflag")]))


@query(
    f"WITH {PACKETS}, c AS (SELECT event_id % 2 AS side, address AS value, COUNT(*) AS n FROM packets GROUP BY ALL), k AS (SELECT side, n / CAST(SUM(n) OVER (PARTITION BY side) AS DOUBLE) AS share, ROW_NUMBER() OVER (PARTITION BY side ORDER BY n DESC, value) AS rank FROM c), "
    f"sh AS (SELECT rank, COALESCE(SUM(share) FILTER (side = 0), 0) AS p, COALESCE(SUM(share) FILTER (side = 1), 0) AS q FROM k GROUP BY rank), w AS (SELECT p, q, SUM(p - q) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM sh) SELECT 'address' AS field, ROUND({JSD}, 6) + 0.0 AS jsd, ROUND(SUM(ABS(cum)), 6) AS emd FROM w"
)
def rank_distance(spark, d) -> DataFrame:
    return rounded(D.rank_distance(events(spark, d, ["address"]), "address"))


@query(f"WITH {PACKETS}, {long_sql('packets', 'event_id', {'port': 'LEAST(GREATEST(port, 0), 65535)'}, 'VARCHAR')}, {shares_sql()} SELECT field, ROUND(0.5 * SUM(ABS(p - q)), 6) AS tv, ROUND({JSD}, 6) + 0.0 AS jsd FROM sh GROUP BY field")
def port_distance(spark, d) -> DataFrame:
    return rounded(D.clamped_tv(events(spark, d, ["port"]), "port", 0, 65535))


@query(
    f"WITH {PACKETS}, l AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS side, event_type AS field, value FROM packets), {SIGNED} SELECT field, ROUND(SUM(ABS(cd) * dx), 4) AS emd FROM w GROUP BY field"
)
def conditional_feature_distance(spark, d) -> DataFrame:
    return D.conditional_distance(events(spark, d, ["event_type", "value"]), "event_type", "value").select("field", F.round("emd", 4).alias("emd"))


@query("SELECT CAST(l_quantity AS DOUBLE) AS value, ROUND(SUM(COUNT(*)) OVER (ORDER BY l_quantity) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS share FROM lineitem GROUP BY l_quantity")
def cumulative_shares(spark, d) -> DataFrame:
    return rounded(D.cumulative_shares(table(spark, d, "lineitem"), "l_quantity"))


FLAGS = "f AS (SELECT field, value, COUNT(*) FILTER (side = 'real') AS r, COUNT(*) FILTER (side = 'synthetic') AS s FROM l WHERE value IS NOT NULL GROUP BY ALL)"
IDS = {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "price": "l_extendedprice"}
ID_SQL = f"WITH {long_sql('lineitem', 'l_orderkey', IDS, 'VARCHAR')}, {FLAGS}"


def id_sides(spark, d):
    return sides(table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice")), "l_orderkey", list(IDS))


@query(f"{ID_SQL}, n AS (SELECT field, COUNT(*) FILTER (r > 0) AS real_values, COUNT(*) FILTER (s > 0) AS synthetic_values, COUNT(*) FILTER (r > 0 AND s > 0) AS common FROM f GROUP BY field) SELECT *, ROUND(common / CAST(real_values AS DOUBLE), 6) AS recall, ROUND(common / CAST(synthetic_values AS DOUBLE), 6) AS precision FROM n")
def identifier_overlap(spark, d) -> DataFrame:
    return rounded(S.identifier_overlap(id_sides(spark, d), list(IDS)))


@query(f"{ID_SQL}, n AS (SELECT field, SUM(CASE WHEN r > 0 THEN s ELSE 0 END) / CAST(SUM(s) AS DOUBLE) AS p, COUNT(*) FILTER (r > 0 AND s > 0) / CAST(COUNT(*) FILTER (r > 0) AS DOUBLE) AS q FROM f GROUP BY field) SELECT field, ROUND(p, 6) AS precision, ROUND(q, 6) AS recall, ROUND(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM n")
def extraction_scores(spark, d) -> DataFrame:
    return rounded(S.extraction_scores(id_sides(spark, d), list(IDS)))


@query(f"{ID_SQL} SELECT field, ROUND(AVG(CASE WHEN r > 0 AND s > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS score FROM f GROUP BY field")
def jaccard_coverage(spark, d) -> DataFrame:
    return rounded(S.jaccard_coverage(id_sides(spark, d), list(IDS)))


@query("WITH c AS (SELECT l_partkey, l_suppkey, COUNT(*) FILTER (l_orderkey % 2 = 0) AS r, COUNT(*) FILTER (l_orderkey % 2 = 1) AS s FROM lineitem GROUP BY ALL) SELECT 'joint' AS field, ROUND(AVG(CASE WHEN r > 0 AND s > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS score FROM c")
def tuple_coverage(spark, d) -> DataFrame:
    return rounded(S.tuple_coverage(lines(spark, d, ["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"]))


EXACT, NUMERIC = ["l_linenumber", "l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"]
NEAR = " AND ".join([*(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in EXACT), *(f"ABS(r.{c} - s.{c}) <= 0.01 * ABS(s.{c})" for c in NUMERIC)])


@query(f"WITH s AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1), r AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0) SELECT ROUND(AVG(CASE WHEN EXISTS (SELECT 1 FROM r WHERE {NEAR}) THEN CAST(0 AS DOUBLE) ELSE 1 END), 6) AS score FROM s")
def new_row_synthesis(spark, d) -> DataFrame:
    real, synthetic = halves(table(spark, d, "lineitem").select("l_orderkey", *EXACT, *NUMERIC), "l_orderkey")
    return rounded(S.new_row_synthesis(real, synthetic, EXACT, NUMERIC))


CARD = "k AS (SELECT c_custkey, c_custkey % 2 AS side, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"


def families(spark, d):
    parents, children = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    return [(parents.where(F.col("c_custkey") % 2 == k), children.where(F.col("o_custkey") % 2 == k)) for k in (0, 1)]


@query(f"WITH {CARD}, l AS (SELECT CASE WHEN side = 0 THEN 'real' ELSE 'synthetic' END AS side, 'children' AS field, CAST(n AS DOUBLE) AS value FROM k), {SIGNED} SELECT field, ROUND(1 - MAX(ABS(cd)), 6) AS score FROM w GROUP BY field")
def cardinality_shape(spark, d) -> DataFrame:
    return rounded(T.cardinality_shape(*families(spark, d), "c_custkey", "o_custkey"))


@query(f"WITH {CARD}, x AS (SELECT AVG(n) FILTER (side = 0) AS r, AVG(n) FILTER (side = 1) AS s, MAX(n) FILTER (side = 0) - MIN(n) FILTER (side = 0) AS span FROM k) SELECT 'children' AS field, ROUND(GREATEST(1 - ABS(r - s) / span, 0), 6) AS score FROM x")
def cardinality_mean(spark, d) -> DataFrame:
    return rounded(T.cardinality_statistic(*families(spark, d), "c_custkey", "o_custkey"))


@query("SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def denormalize_outer(spark, d) -> DataFrame:
    rows = T.denormalize(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_custkey", "o_orderpriority"), "c_custkey", "o_custkey")
    return rows.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


REPORTED = [*LINE_NUMS, *LINE_CATS]


def reported(spark, d):
    cast = [F.col(c).cast("string").alias(c) if c in LINE_CATS else F.col(c) for c in REPORTED]
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    real, synthetic = real.select(*cast), synthetic.select(*cast)
    return real, synthetic, T.TableMetadata.infer(real)


BINS = ", ".join(f"CASE WHEN {c} >= h_{c} THEN 11 WHEN {c} < l_{c} THEN 0 ELSE CAST(FLOOR(({c} - l_{c}) * 10 / (h_{c} - l_{c})) AS INTEGER) + 1 END AS {c}" for c in LINE_NUMS)
BOUNDS = ", ".join(f"MIN({c}) AS l_{c}, MAX({c}) AS h_{c}" for c in LINE_NUMS)


def mixed_sql() -> str:
    parts = []
    for a in LINE_NUMS:
        for b in LINE_CATS:
            parts.append(f"SELECT 'contingency_similarity' AS metric, '{a}|{b}' AS field, 1 - 0.5 * SUM(ABS(r / tr - s / ts)) AS score FROM (SELECT {a}, {b}, CAST(COUNT(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(COUNT(*) FILTER (side = 1) AS DOUBLE) AS s FROM z GROUP BY ALL), (SELECT CAST(COUNT(*) FILTER (side = 0) AS DOUBLE) AS tr, CAST(COUNT(*) FILTER (side = 1) AS DOUBLE) AS ts FROM z)")
    return " UNION ALL ".join(parts)


def as_part(sql: str, name: str, by: str) -> str:
    return f"SELECT '{name}' AS metric, {by} AS field, score FROM ({sql})"


def report_sql() -> str:
    z = f"WITH z AS (SELECT l_orderkey % 2 AS side, {BINS}, {', '.join(LINE_CATS)} FROM lineitem, (SELECT {BOUNDS} FROM lineitem WHERE l_orderkey % 2 = 0)) "
    shapes = [as_part(ORACLE[n], n, "field") for n in ("ks_complement", "tv_complement")]
    trends = [as_part(ORACLE["correlation_pearson"], "correlation_similarity", "pair"), as_part(ORACLE["contingency_similarity"], "contingency_similarity", "pair")]
    return f"SELECT property, metric, field, ROUND(ROUND(score, 6), 5) AS score FROM (SELECT 'Column Shapes' AS property, * FROM ({' UNION ALL '.join(shapes)}) UNION ALL SELECT 'Column Pair Trends', * FROM ({' UNION ALL '.join(trends)} UNION ALL SELECT * FROM ({z}{mixed_sql()})))"


@query(report_sql())
def quality_report(spark, d) -> DataFrame:
    return graded(spark, d)


def graded(spark, d) -> DataFrame:
    """Rounded in the same two steps as the SQL, which is made of other queries' SQL."""
    return Q.quality_report(*reported(spark, d)).select("property", "metric", "field", F.round(F.round("score", 6), 5).alias("score"))


@query(f"WITH p AS (SELECT property, AVG(score) AS score FROM ({report_sql()}) GROUP BY property) SELECT property, ROUND(score, 4) AS score FROM p UNION ALL SELECT 'Overall', ROUND(AVG(score), 4) FROM p")
def quality_properties(spark, d) -> DataFrame:
    return Q.property_scores(graded(spark, d)).select("property", F.round("score", 4).alias("score"))


@query()
def diagnostic_report(spark, d) -> DataFrame:
    return rounded(Q.diagnostic_report(*reported(spark, d)))


@query("SELECT 'ks_complement' AS metric, ROUND(AVG(score), 4) AS raw, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 'maximize' AS goal, ROUND(AVG(score), 4) AS normalized FROM (" + report_sql() + ") WHERE metric = 'ks_complement' UNION ALL SELECT 'tv_complement', ROUND(AVG(score), 4), 0.0::DOUBLE, 1.0::DOUBLE, 'maximize', ROUND(AVG(score), 4) FROM (" + report_sql() + ") WHERE metric = 'tv_complement'")
def normalized_scores(spark, d) -> DataFrame:
    out = Q.metric_table(*reported(spark, d), ["ks_complement", "tv_complement"])
    return out.select("metric", F.round("raw", 4).alias("raw"), "low", "high", "goal", F.round("normalized", 4).alias("normalized"))

