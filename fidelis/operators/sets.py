"""Scores of value sets: overlap of identifiers, extraction of memorised values, coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagged import REAL, long_form


def _flags(both: DataFrame, columns: list[str]) -> DataFrame:
    """By (field, value): counts on either side. One aggregation, partial before the shuffle."""
    values = long_form(both, columns, "string").where(F.col("value").isNotNull())
    return values.groupBy("field", "value").agg(F.sum((F.col("side") == REAL).cast("bigint")).alias("r"), F.sum((F.col("side") != REAL).cast("bigint")).alias("s"))


def identifier_overlap(both: DataFrame, columns: list[str]) -> DataFrame:
    """field, real_values, synthetic_values, common, recall and precision over distinct values (0 if empty)."""
    n = lambda c: F.count_if(c)
    row = _flags(both, columns).groupBy("field").agg(n(F.col("r") > 0).alias("real_values"), n(F.col("s") > 0).alias("synthetic_values"), n((F.col("r") > 0) & (F.col("s") > 0)).alias("common"))
    ratio = lambda d: F.coalesce(F.try_divide("common", d), F.lit(0.0))
    return row.select("*", ratio("real_values").alias("recall"), ratio("synthetic_values").alias("precision"))


def extraction_scores(both: DataFrame, columns: list[str]) -> DataFrame:
    """field, precision over synthetic occurrences, recall over distinct real values, f1."""
    hit = (F.col("r") > 0) & (F.col("s") > 0)
    row = _flags(both, columns).groupBy("field").agg(F.try_divide(F.sum(F.when(hit, F.col("s")).otherwise(0)), F.sum("s")).alias("precision"), F.try_divide(F.count_if(hit), F.count_if(F.col("r") > 0)).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return row.select("*", F.when(p + r > 0, 2 * p * r / (p + r)).when(p.isNotNull() & r.isNotNull(), 0.0).alias("f1"))


def jaccard_coverage(both: DataFrame, columns: list[str]) -> DataFrame:
    """field, score: distinct values on both sides over those on either."""
    return _flags(both, columns).groupBy("field").agg(F.avg(((F.col("r") > 0) & (F.col("s") > 0)).cast("double")).alias("score"))


def tuple_coverage(both: DataFrame, columns: list[str]) -> DataFrame:
    """The same over tuples of several columns."""
    return jaccard_coverage(both.withColumn("joint", F.to_json(F.struct(*columns))), ["joint"])


def new_rows(real: DataFrame, synthetic: DataFrame, exact: list[str], numeric: list[str], tolerance: float = 0.01) -> DataFrame:
    """Synthetic rows without a real row that matches in all fields.

    ``exact`` fields must be equal (null equals null), ``numeric`` ones within ``tolerance`` of the
    synthetic value's size. Numbers fall in cells of a logarithmic scale; a distinct real row is in the
    cells of each numeric field that hold values within reach, so the join is an equi-join on the exact
    fields and the cells of all numeric ones, also where all fields are numeric.
    """
    r = real.select(*[F.col(c).alias(f"r_{c}") for c in (*exact, *numeric)]).distinct()
    s = synthetic
    equal = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in exact]
    near = [(F.col(c).isNull() & F.col(f"r_{c}").isNull()) | (F.abs(F.col(f"r_{c}") - F.col(c)) <= tolerance * F.abs(F.col(c))) for c in numeric]
    width = 4 * tolerance
    name = lambda x, n: F.when(x.isNull(), F.lit("null")).when(x == 0, F.lit("0")).otherwise(F.concat((x > 0).cast("string"), n.cast("string")))
    for i, c in enumerate(numeric):
        x, y = F.col(f"r_{c}").cast("double"), F.col(c).cast("double")
        at = lambda v, out=0.0: F.floor((F.ln(F.abs(v)) + F.lit(out)) / F.lit(width))
        # |real - y| <= t |y| puts y between real / (1 + t) and real / (1 - t); a little more for rounding.
        reach = F.when(F.coalesce(x == 0, F.lit(True)), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(at(x, -math.log1p(tolerance) - 1e-9), at(x, -math.log1p(-tolerance) + 1e-9)))
        r = r.withColumn(f"_n{i}", F.explode(reach)).withColumn(f"_cell{i}", name(x, F.col(f"_n{i}"))).drop(f"_n{i}")
        s = s.withColumn(f"_cell{i}", name(y, at(y)))
        equal.append(s[f"_cell{i}"] == r[f"_cell{i}"])
    condition = None
    for c in equal + near:
        condition = c if condition is None else condition & c
    return s.join(r, condition, "left_anti").drop(*[f"_cell{i}" for i in range(len(numeric))])


def new_row_synthesis(real: DataFrame, synthetic: DataFrame, exact: list[str], numeric: list[str], tolerance: float = 0.01) -> DataFrame:
    """score: share of the synthetic rows that are new."""
    total = synthetic.agg(F.count(F.lit(1)).alias("total"))
    fresh = new_rows(real, synthetic, exact, numeric, tolerance).agg(F.count(F.lit(1)).alias("new"))
    return fresh.join(F.broadcast(total)).select(F.try_divide("new", "total").alias("score"))  # one row each
