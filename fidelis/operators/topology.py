"""Communication graphs: strongest flows, degrees, edges, and how much of a graph another one gives away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .distances import wasserstein


def top_flows(flows: DataFrame, keys: list[str], weight: str, n: int = 100) -> DataFrame:
    """The ``n`` groups with the largest sums, ties by key."""
    return flows.groupBy(*keys).agg(F.sum(weight).alias("total")).orderBy(F.desc("total"), *keys).limit(n)


def edges_of(flows: DataFrame, src: str, dst: str) -> DataFrame:
    """src, dst as text, without self loops and nulls; repeated rows stay."""
    return flows.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).where("src <> dst")


def node_degrees(edges: DataFrame) -> DataFrame:
    """node, degree: edge rows that touch a node; a repeated edge counts each time."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def undirected_edges(edges: DataFrame) -> DataFrame:
    """a < b, times: rows of an edge in either direction."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("times"))


#: Rows that a task counts at most, about: the more edges, the more tasks.
PART_ROWS = 500_000
#: Tasks that share a hub's edges.
SALTS = 16


def _both(real: DataFrame, synthetic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, x, y) and (a, b, x, y), written: degrees of nodes and times of undirected edges in the real and the synthetic graph, 0 where absent."""
    tag = lambda df, x, y: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    rows = tag(real, 1, 0).unionByName(tag(synthetic, 0, 1))
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    # Rows are spread before they are counted, so that no task's table of groups grows with the input.
    spread = lambda df, *keys: df.repartition(parts, *keys).groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    edges = stored(spread(rows, "a", "b"), "edges")
    ends = F.array(*[F.struct(F.col(p).alias("node"), F.pmod(F.xxhash64(q), F.lit(SALTS)).alias("salt")) for p, q in (("a", "b"), ("b", "a"))])
    nodes = edges.select(F.inline(ends), "x", "y")
    return stored(spread(spread(nodes, "node", "salt"), "node"), "nodes"), edges


def compare(real: DataFrame, synthetic: DataFrame, top_k: int = 10) -> DataFrame:
    """One row: common nodes and edges with their shares of the real ones, overlap of the ``top_k`` hubs
    and edges, and the distance of the degree distributions over the real degrees' range."""
    nodes, edges = _both(real, synthetic)

    def common(df: DataFrame, name: str) -> DataFrame:
        both, own = F.sum(((F.col("x") > 0) & (F.col("y") > 0)).cast("int")), F.sum((F.col("x") > 0).cast("int"))
        return df.agg(F.coalesce(both, F.lit(0)).cast("bigint").alias(f"common_{name}"), F.coalesce(F.try_divide(both, own), F.lit(0.0)).alias(f"{name}_rate"))

    def top(df: DataFrame, weight: str, keys: list[str]) -> DataFrame:
        return df.where(F.col(weight) > 0).orderBy(F.desc(weight), *keys).limit(top_k).select(*keys)

    def overlap(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return top(df, "x", keys).join(top(df, "y", keys), keys, "left_semi").agg(F.count(F.lit(1)).alias(f"common_top_{name}"))

    degrees = lambda side, x: nodes.where(F.col(x) > 0).select(F.lit(side).alias("side"), F.col(x).alias("degree"))
    distance = wasserstein(degrees("real", "x").union(degrees("synthetic", "y")), ["degree"]).agg(F.max("emd_of_range").alias("degree_emd"))  # one row, also for empty graphs
    out = common(nodes, "nodes")
    for part in (common(edges, "edges"), overlap(nodes, ["node"], "nodes"), overlap(edges, ["a", "b"], "edges"), distance):
        out = out.join(F.broadcast(part))  # single rows
    return out


def address_frequency(packets: DataFrame, src: str, dst: str) -> DataFrame:
    """address, frequency: how often an address is source or destination."""
    both = packets.select(F.explode(F.array(F.col(src).cast("string"), F.col(dst).cast("string"))).alias("address"))
    return both.where("address is not null").groupBy("address").agg(F.count(F.lit(1)).alias("frequency"))


def rank_top(df: DataFrame, keys: list[str], weight: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits groups before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), *[c for c in df.columns if c not in (*keys, weight)])
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
