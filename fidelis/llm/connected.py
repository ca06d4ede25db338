"""Connected components of a link table by alternating large and small stars in DataFrames.

Before each round every task joins the links that it reads, so that long chains get short early.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back, let_go, written

#: Links that a task joins at once.
AT_ONCE = 100_000


def _joined(edges: DataFrame) -> DataFrame:
    """Edges with the same components, from each node of a part of the rows to the smallest one connected there."""

    def stars(links: pa.Table) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(links.column(0).to_pylist(), links.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([r for _, r in pairs], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        let_go()
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= AT_ONCE:
                yield stars(pa.Table.from_batches(held))
                held = []
        if held:
            yield stars(pa.Table.from_batches(held))
            del held
        give_back()

    return edges.mapInArrow(run, "a bigint, b bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: links each neighbour (all larger ones, or all smaller ones) to the smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = seen.join(least, "a")
    out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a bigint, b bigint); root is the component's smallest node.

    Each round is written to the shared folder. Loops and repeated links don't matter; nodes without
    links have no row.
    """
    edges = written(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b"), "links")
    mark = None  # of the round before
    for _ in range(most_rounds):
        before, edges = edges, written(_star(_star(_joined(edges), True), False).distinct(), "links")
        dropped(before)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
