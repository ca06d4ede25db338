"""Queries of fitted models whose fit SQL can follow step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import histograms as H
from ..operators import mixture as MX
from ..operators import quality as Q
from ..operators.attacks import dependence_tree as fitted_tree
from ..operators.attacks import model_attack
from ..operators.learned import detection, train_and_test
from ..operators.learners import AdaBoost
from ..operators.tagged import tagged
from ..operators.transformer import HyperTransformer
from .catalog import JSD, ORACLE, PACKETS, halves, long_sql, packets, query, rounded, table
from .comparison import reported
from .reports import NUMBERS3

# --- Gaussian mixtures -----------------------------------------------------------------------

STEPS = 5


def mixture_sql(k: int, steps: int, name: str) -> str:
    """CTEs of expectation maximisation over p (id, x, y), from starts at even steps between the bounds: ``name``_t (c, w, mx, my, vx, vy) after t steps."""
    log = "LN(w) - LN(2 * PI()) - (LN(vx) + LN(vy)) / 2 - LN(sx) - LN(sy) - ((x - mx) * (x - mx) / vx + (y - my) * (y - my) / vy) / 2"
    parts = [f"{name}_0 AS (SELECT c, 1.0::DOUBLE / {k} AS w, ax + (c + 0.5::DOUBLE) / {k} * (bx - ax) AS mx, ay + (c + 0.5::DOUBLE) / {k} * (b_y - ay) AS my, 1.0::DOUBLE AS vx, 1.0::DOUBLE AS vy FROM (SELECT UNNEST(RANGE({k})) AS c), (SELECT MIN(x) AS ax, MAX(x) AS bx, MIN(y) AS ay, MAX(y) AS b_y FROM p))"]
    for t in range(steps + 1):
        parts.append(f"{name}_l{t} AS (SELECT id, x, y, c, {log} AS l FROM p, {name}_{t}, sc)")
        parts.append(f"{name}_z{t} AS (SELECT *, m + LN(SUM(EXP(l - m)) OVER (PARTITION BY id)) AS z FROM (SELECT *, MAX(l) OVER (PARTITION BY id) AS m FROM {name}_l{t}))")
        if t < steps:
            parts.append(f"{name}_s{t} AS (SELECT c, SUM(EXP(l - z)) AS n, SUM(EXP(l - z) * x) AS sx_, SUM(EXP(l - z) * y) AS sy_, SUM(EXP(l - z) * x * x) AS qx, SUM(EXP(l - z) * y * y) AS qy FROM {name}_z{t} GROUP BY c)")
            parts.append(f"{name}_{t + 1} AS (SELECT c, n / sc.rows AS w, sx_ / n AS mx, sy_ / n AS my, GREATEST(qx / n - (sx_ / n) * (sx_ / n), {MX.FLOOR}) AS vx, GREATEST(qy / n - (sy_ / n) * (sy_ / n), {MX.FLOOR}) AS vy FROM {name}_s{t}, sc)")
    return ", ".join(parts)


#: value and port of real packets in standard coordinates; gaps count as means.
REAL = f"""{PACKETS}, src AS (SELECT event_id, value AS a, CAST(port AS DOUBLE) AS b FROM packets), r AS (SELECT * FROM src WHERE event_id % 2 = 0),
 sc AS (SELECT COUNT(*) AS rows, AVG(a) AS ma, AVG(b) AS mb, SQRT(VAR_POP(a) * COUNT(a) / COUNT(*)) AS sx, SQRT(VAR_POP(b) * COUNT(b) / COUNT(*)) AS sy FROM r),
 p AS (SELECT ROW_NUMBER() OVER () AS id, (COALESCE(a, ma) - ma) / sx AS x, (COALESCE(b, mb) - mb) / sy AS y FROM r, sc)"""


@query(f"""WITH {REAL}, {mixture_sql(3, STEPS, 'g')}, o AS (SELECT AVG(a) AS oa, AVG(b) AS ob FROM src WHERE event_id % 2 = 1),
 f AS (SELECT event_id, (COALESCE(a, oa) - ma) / sx AS x, (COALESCE(b, ob) - mb) / sy AS y, sx, sy FROM src, sc, o WHERE event_id % 2 = 1),
 l AS (SELECT event_id, LN(w) - LN(2 * PI()) - (LN(vx) + LN(vy)) / 2 - LN(sx) - LN(sy) - ((x - mx) * (x - mx) / vx + (y - my) * (y - my) / vy) / 2 AS l FROM f, g_{STEPS}),
 z AS (SELECT event_id, MAX(m) + LN(SUM(EXP(l - m))) AS z FROM (SELECT *, MAX(l) OVER (PARTITION BY event_id) AS m FROM l) GROUP BY event_id)
 SELECT ROUND(AVG(z), 4) AS score FROM z""")
def mixture_three_components(spark, d) -> DataFrame:
    """Odd packets under three components fitted on the even ones by a fixed number of steps."""
    real, synthetic = halves(packets(spark, d), "event_id")
    return rounded(MX.mixture_log_likelihood(real, synthetic, ["value", "port"], 3, iterations=1, starts="spread", steps=STEPS, tolerance=0), 4)


@query(
    f"WITH {REAL}, {', '.join(mixture_sql(k, STEPS, f'g{k}') for k in (1, 2, 3))}, l AS ("
    + " UNION ALL ".join(f"SELECT {k} AS components, AVG(z) AS l FROM (SELECT DISTINCT id, z FROM g{k}_z{STEPS})" for k in (1, 2, 3))
    + "), b AS (SELECT components, l, -2 * l * rows + (components - 1 + 4 * components) * LN(rows) AS bic, rows FROM l, sc) SELECT components, ROUND(l, 4) AS log_likelihood, ROUND(bic / rows, 4) AS bic_per_row, bic = MIN(bic) OVER () AS chosen FROM b"
)
def mixture_selection(spark, d) -> DataFrame:
    """Numbers of components by the information criterion, after a fixed number of steps each."""
    real = halves(packets(spark, d), "event_id")[0]
    models = MX.fit(real, ["value", "port"], (1, 3), starts="spread", steps=STEPS, tolerance=0)
    rows = models[0].scale.rows
    return rounded(MX.selection(models, spark).select("components", "log_likelihood", (F.col("bic") / rows).alias("bic_per_row"), "chosen"), 4)


@query()
def mixture_best(spark, d) -> DataFrame:
    """One to three components from drawn starts, the best by the criterion."""
    return rounded(MX.mixture_log_likelihood(*halves(packets(spark, d), "event_id"), ["value", "port"], (1, 3), steps=8, iterations=1), 2)


# --- bins from the data ----------------------------------------------------------------------

EDGE = "(low + ({k}) * (high - low) / bins)"


@query(f"""WITH {PACKETS}, {long_sql('packets', 'event_id', {'value': 'value', 'port': 'port', 'time': 'time'}, 'DOUBLE')}, k AS (SELECT * FROM l WHERE value IS NOT NULL),
 b AS (SELECT field, COUNT(*) AS n, MIN(value) AS a, MAX(value) AS z, QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25) AS iqr FROM k WHERE side = 'real' GROUP BY field),
 w AS (SELECT *, (z - a) / (LOG2(n) + 1) AS even FROM b), v AS (SELECT *, CASE WHEN iqr > 0 THEN LEAST(2 * iqr * POWER(n, -1.0::DOUBLE / 3), even) ELSE even END AS width FROM w),
 e AS (SELECT field, CASE WHEN a = z THEN a - 0.5 ELSE a END AS low, CASE WHEN a = z THEN z + 0.5 ELSE z END AS high, CASE WHEN a = z THEN 1 ELSE CAST(CEIL((z - a) / CASE WHEN field = 'port' THEN GREATEST(width, 1) ELSE width END) AS BIGINT) END AS bins FROM v),
 f AS (SELECT field, side, value, low, high, bins, LEAST(FLOOR((value - low) / (high - low) * bins), bins - 1) AS i FROM k JOIN e USING (field) WHERE value BETWEEN low AND high),
 g AS (SELECT field, bins, side, CASE WHEN value < {EDGE.format(k='i')} THEN i - 1 WHEN i < bins - 1 AND value >= {EDGE.format(k='i + 1')} THEN i + 1 ELSE i END AS i FROM f),
 c AS (SELECT field, bins, i, CAST(COUNT(*) FILTER (side = 'real') AS DOUBLE) AS r, CAST(COUNT(*) FILTER (side = 'synthetic') AS DOUBLE) AS s FROM g GROUP BY ALL),
 h AS (SELECT field, bins, r / SUM(r) OVER (PARTITION BY field) AS p, s / SUM(s) OVER (PARTITION BY field) AS q FROM c)
 SELECT field, bins, ROUND({JSD}, 6) AS score FROM h GROUP BY field, bins""")
def continuous_divergence(spark, d) -> DataFrame:
    both = tagged(*halves(packets(spark, d), "event_id"), ["value", "port", "time"])
    return rounded(H.continuous_jsd(both, ["value", "port", "time"], whole=["port"]))


# --- one transformer for a table -------------------------------------------------------------

FLAGS = "SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_orderkey % 2 = 0"


@query(f"""WITH m AS (SELECT AVG(l_quantity) AS q, AVG(epoch_us(l_shipdate) * 1000.0::DOUBLE) AS t FROM lineitem WHERE l_orderkey % 2 = 0), s AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)
 SELECT 'l_quantity' AS field, ROUND(AVG(COALESCE(CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity END, q)), 4) AS mean FROM s, m
 UNION ALL SELECT 'l_shipdate', ROUND(AVG(COALESCE(epoch_us(l_shipdate) * 1000.0::DOUBLE, t)) / 1e13, 4) FROM s, m
 UNION ALL SELECT 'l_returnflag=' || v, ROUND(AVG(CASE WHEN l_returnflag = v THEN 1.0::DOUBLE ELSE 0 END), 4) FROM s, ({FLAGS}) GROUP BY v""")
def hyper_transform(spark, d) -> DataFrame:
    """Fitted on the even orders' rows; means of the odd ones' columns, small quantities taken for gaps."""
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    names = ["l_quantity", "l_shipdate", "l_returnflag"]
    fitted = HyperTransformer().fit(real.select(*names))
    out = fitted.transform(synthetic.select(F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).alias("l_quantity"), *names[1:]), unknown="ignore")
    scale = lambda c: F.col(f"`{c}`") / (1e13 if c == "l_shipdate" else 1.0)
    means = out.agg(*[F.avg(scale(c)).alias(f"m{i}") for i, c in enumerate(out.columns)])
    return rounded(means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(out.columns)]))), 4)


# --- naive Bayes with several keys -----------------------------------------------------------

KEYS = ["l_returnflag", "l_linenumber", "l_discount"]


@query(f"""WITH s AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1), r AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT l_linestatus AS v, COUNT(*) AS n FROM s GROUP BY v),
 t AS (SELECT SUM(n) AS n, COUNT(*) AS k FROM c), w AS (SELECT {' + '.join(f'(SELECT COUNT(DISTINCT {k}) + 1 FROM s)' for k in KEYS)} AS w),
 """ + ", ".join(f"k{i} AS (SELECT x, v, COALESCE(m, 0) AS m FROM (SELECT DISTINCT {k} AS x FROM s) CROSS JOIN c LEFT JOIN (SELECT {k} AS x, l_linestatus AS v, COUNT(*) AS m FROM s GROUP BY ALL) USING (x, v))" for i, k in enumerate(KEYS)) + f""",
 p AS (SELECT DISTINCT {', '.join(KEYS)} FROM r), g AS (SELECT {', '.join(KEYS)}, c.v, c.n, LN(c.n + 1) - LN(t.n + t.k) + {' + '.join(f'LN(k{i}.m + 1) - LN({len(KEYS)} * c.n + w.w)' for i in range(len(KEYS)))} AS score
  FROM p CROSS JOIN c CROSS JOIN t CROSS JOIN w {' '.join(f'JOIN k{i} ON k{i}.x = {k} AND k{i}.v = c.v' for i, k in enumerate(KEYS))}),
 b AS (SELECT * FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY {', '.join(KEYS)} ORDER BY score DESC, n DESC, v) = 1)
 SELECT ROUND(1 - AVG(CASE WHEN b.v = l_linestatus THEN 1.0::DOUBLE ELSE 0 END), 5) AS score FROM r JOIN b USING ({', '.join(KEYS)})""")
def bayes_attack_three_keys(spark, d) -> DataFrame:
    """What a naive Bayes attacker with three keys guesses of a real row's status; each share counts one more than seen."""
    real, synthetic = halves(table(spark, d, "lineitem"), "l_orderkey")
    return rounded(model_attack(real, synthetic, KEYS, "l_linestatus", "naive_bayes"), 5)


# --- boosted stumps and kernel machines ------------------------------------------------------


@query()
def adaboost_efficacy(spark, d) -> DataFrame:
    """Boosted stumps trained on the odd orders' rows and tested on the even ones: whether a row's line is open."""
    test, train = halves(table(spark, d, "lineitem"), "l_orderkey")
    return rounded(train_and_test(train, test, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"], "l_linestatus", AdaBoost(rounds=4)), 3)


@query()
def kernel_detection(spark, d) -> DataFrame:
    """How hard a machine with a radial kernel finds it to tell even from odd packets."""
    return rounded(detection(*halves(packets(spark, d), "event_id"), ["value", "port"], [], "svc", folds=2), 2)


# --- the tree that the data gives ------------------------------------------------------------

#: Grown from the first column: the heavier of its two edges, then the heavier edge to the column left.
TREE_CHOICE = f"""WITH m AS ({ORACLE['mutual_information']}), w AS (SELECT MAX(bits) FILTER (a = 'l_returnflag' AND b = 'l_linestatus') AS fs, MAX(bits) FILTER (a = 'l_returnflag' AND b = 'l_linenumber') AS fn, MAX(bits) FILTER (a = 'l_linestatus' AND b = 'l_linenumber') AS sn FROM m)
 SELECT 'l_linestatus' AS child, CASE WHEN fs >= fn OR fs >= sn THEN 'l_returnflag' ELSE 'l_linenumber' END AS parent FROM w
 UNION ALL SELECT 'l_linenumber', CASE WHEN fs < fn OR fn >= sn THEN 'l_returnflag' ELSE 'l_linestatus' END FROM w"""


@query(TREE_CHOICE)
def dependence_tree(spark, d) -> DataFrame:
    """Edges of the tree of columns with the most mutual information."""
    tree = fitted_tree(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return spark.createDataFrame([(parent, child) for parent, child in tree if parent], "parent string, child string")


@query(f"""WITH s AS ({ORACLE['chi_square_score']}), n AS (SELECT {', '.join(f'GREATEST(0, 1 - ABS(AVG({c}) FILTER (l_orderkey % 2 = 0) - AVG({c}) FILTER (l_orderkey % 2 = 1)) / (MAX({c}) FILTER (l_orderkey % 2 = 0) - MIN({c}) FILTER (l_orderkey % 2 = 0))) AS {c}' for c in NUMBERS3)} FROM lineitem)
 SELECT 'chi_square' AS metric, field, ROUND(score, 5) AS score FROM s {' '.join(f"UNION ALL SELECT 'statistic_similarity', '{c}', ROUND({c}, 5) FROM n" for c in NUMBERS3)}""")
def scores_of_columns(spark, d) -> DataFrame:
    """Two metrics on all columns of their kinds, by the registry."""
    return rounded(Q.scores(*reported(spark, d), ["chi_square", "statistic_similarity"]), 5)


# --- nearest words ---------------------------------------------------------------------------


@query("""WITH w AS (SELECT CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: ROUND(x, 1)) AS v FROM embeddings)
 SELECT id, word, ROUND(c, 6) AS cosine FROM (SELECT id, word, ROUND(list_cosine_similarity(r.v, w.v), 12) AS c FROM r, w WHERE list_dot_product(r.v, r.v) > 0 AND list_dot_product(w.v, w.v) > 0) QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY c DESC, word) = 1""")
def nearest_words(spark, d) -> DataFrame:
    """Each vector, rounded to tenths, decoded to the nearest one by a forest of random splits; the SQL compares all pairs."""
    rows = table(spark, d, "embeddings")
    words = rows.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    coarse = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 1)).alias("vector"))
    return rounded(V.nearest_words(coarse, words))
