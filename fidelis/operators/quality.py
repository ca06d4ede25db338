"""A registry of scores, their normalisation, and the quality and diagnostic reports as tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as C
from .sets import new_row_synthesis
from .tables import TableMetadata, cardinality_shape
from .tagged import tagged


class Goal(Enum):
    IGNORE = "ignore"
    MAXIMIZE = "maximize"
    MINIMIZE = "minimize"


@dataclass(frozen=True)
class Metric:
    """A score over the columns of some kinds, with its bounds and what is better."""

    name: str
    compute: Callable[[DataFrame, list], DataFrame]
    kinds: tuple[str, ...]
    pairs: bool = False
    goal: Goal = Goal.MAXIMIZE
    low: float = 0.0
    high: float = 1.0


REGISTRY: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    REGISTRY[metric.name] = metric
    return metric


NUMBERS, CATEGORIES = ("numerical", "datetime"), ("categorical", "boolean")
for _m in (
    Metric("ks_complement", C.ks_complement, NUMBERS), Metric("tv_complement", C.tv_complement, CATEGORIES), Metric("chi_square", C.chi_square_score, CATEGORIES),
    Metric("statistic_similarity", C.statistic_similarity, NUMBERS), Metric("boundary_adherence", C.boundary_adherence, NUMBERS), Metric("missing_value_similarity", C.missing_value_similarity, NUMBERS),
    Metric("category_coverage", C.category_coverage, CATEGORIES), Metric("range_coverage", C.range_coverage, NUMBERS),
    Metric("correlation_similarity", C.correlation_similarity, ("numerical",), True), Metric("contingency_similarity", C.contingency_similarity, CATEGORIES, True),
    Metric("continuous_kl", C.continuous_kl, ("numerical",), True), Metric("discrete_kl", C.discrete_kl, CATEGORIES, True),
):
    register(_m)


def normalize(raw: Column, low: float, high: float, goal: Goal) -> Column:
    """A score in [0, 1], 1 best: linear between finite bounds, exponential with one, a sigmoid with none."""
    if math.isinf(low) and math.isinf(high):
        x = 1 / (1 + F.exp(-raw))
    elif math.isinf(high):
        x = 1 - F.exp(F.lit(low) - raw)
    elif math.isinf(low):
        x = F.exp(raw - F.lit(high))
    else:
        x = (raw - F.lit(low)) / F.lit(high - low)
    return 1 - x if goal is Goal.MINIMIZE else x


def scores(real: DataFrame, synthetic: DataFrame, metadata: TableMetadata, names: list[str]) -> DataFrame:
    """metric, field, score of every named metric on all columns (or pairs) of its kinds, by field."""
    parts = []
    for name in names:
        m = REGISTRY[name]
        use = metadata.select(*m.kinds)
        if use and (not m.pairs or len(use) > 1):
            found = m.compute(tagged(real, synthetic, use), C.pair_names(use) if m.pairs else use)
            parts.append(found.select(F.lit(name).alias("metric"), F.col("pair" if m.pairs else "field").alias("field"), F.col("score").cast("double").alias("score")))
    if not parts:
        return real.sparkSession.createDataFrame([], "metric string, field string, score double")
    return reduce(DataFrame.unionByName, parts)


def metric_table(real: DataFrame, synthetic: DataFrame, metadata: TableMetadata, names: list[str]) -> DataFrame:
    """metric, raw (mean over fields, nulls left out), normalized, low, high, goal."""
    rows = scores(real, synthetic, metadata, names).groupBy("metric").agg(F.avg("score").alias("raw"))
    known = F.create_map(*[x for n in names for x in (F.lit(n), F.struct(F.lit(REGISTRY[n].low).alias("low"), F.lit(REGISTRY[n].high).alias("high"), F.lit(REGISTRY[n].goal.value).alias("goal")))])
    out = rows.withColumn("m", known[F.col("metric")]).select("metric", "raw", "m.*")
    each = reduce(lambda a, n: a.when(F.col("metric") == n, normalize(F.col("raw"), REGISTRY[n].low, REGISTRY[n].high, REGISTRY[n].goal)), names, F.when(F.lit(False), F.lit(None).cast("double")))
    return out.withColumn("normalized", each)


def quality_report(real: DataFrame, synthetic: DataFrame, metadata: TableMetadata) -> DataFrame:
    """property, metric, field, score: column shapes, pair trends (mixed pairs after cutting numbers into bins)."""
    shapes = scores(real, synthetic, metadata, ["ks_complement", "tv_complement"]).select(F.lit("Column Shapes").alias("property"), "*")
    trends = scores(real, synthetic, metadata, ["correlation_similarity", "contingency_similarity"])
    numbers, categories = metadata.select(*NUMBERS), metadata.select(*CATEGORIES)
    mixed = [(a, b) for a in numbers for b in categories]
    if mixed:
        cut = C.discretized(tagged(real, synthetic, [*numbers, *categories]), numbers)
        trends = trends.unionByName(C.contingency_similarity(cut, mixed).select(F.lit("contingency_similarity").alias("metric"), F.col("pair").alias("field"), "score"))
    return shapes.unionByName(trends.select(F.lit("Column Pair Trends").alias("property"), "*"))


def property_scores(report: DataFrame) -> DataFrame:
    """property, score: means over fields, and the row Overall: the mean of those."""
    by = report.groupBy("property").agg(F.avg("score").alias("score"))
    return by.unionByName(by.agg(F.avg("score").alias("score")).select(F.lit("Overall").alias("property"), "score"))


def diagnostic_report(real: DataFrame, synthetic: DataFrame, metadata: TableMetadata, sample: int | None = None, seed: int = 0) -> DataFrame:
    """property, score, verdict: coverage, boundaries and synthesis of new rows (of all synthetic rows, or of ``sample`` of them)."""
    cover = scores(real, synthetic, metadata, ["range_coverage", "category_coverage"]).agg(F.avg("score").alias("score")).select(F.lit("Coverage").alias("property"), "score")
    bounds = scores(real, synthetic, metadata, ["boundary_adherence"]).agg(F.avg("score").alias("score")).select(F.lit("Boundaries").alias("property"), "score")
    few = synthetic.orderBy(F.xxhash64(F.lit(seed), *synthetic.columns), *synthetic.columns).limit(sample) if sample is not None else synthetic
    fresh = new_row_synthesis(real, few, metadata.select(*CATEGORIES), metadata.select("numerical")).select(F.lit("Synthesis").alias("property"), "score")
    rows = cover.unionByName(bounds).unionByName(fresh)
    return rows.withColumn("verdict", _verdict())


def _verdict() -> Column:
    """In words; null where there is no score."""
    return F.when(F.col("score") >= 0.9, "SUCCESS").when(F.col("score") >= 0.5, "WARNING").when(F.col("score").isNotNull(), "DANGER")


# --- several tables ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Relation:
    """A child table's column that refers to its parent's key."""

    parent: str
    parent_key: str
    child: str
    child_key: str


def without_references(metadata: dict[str, TableMetadata], relations: list[Relation]) -> dict[str, TableMetadata]:
    """The tables' metadata with the children's references as ids, which no column score takes."""
    out = dict(metadata)
    for r in relations:
        out[r.child] = replace(out[r.child], kinds=out[r.child].kinds | {r.child_key: "id"})
    return out


def table_scores(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: dict[str, TableMetadata], names: list[str]) -> DataFrame:
    """table, metric, field, score: single-table metrics of each table."""
    each = [scores(real[t], synthetic[t], metadata[t], names).select(F.lit(t).alias("table"), "*") for t in real]
    return reduce(DataFrame.unionByName, each)


def multi_table_metric(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: dict[str, TableMetadata], name: str) -> DataFrame:
    """score: mean over tables of their mean over fields, nulls left out."""
    by = table_scores(real, synthetic, metadata, [name]).groupBy("table").agg(F.avg("score").alias("score"))
    return by.agg(F.avg("score").alias("score"))


def relation_scores(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], relations: list[Relation]) -> DataFrame:
    """parent, child, score: how alike the numbers of children for each parent are."""
    each = [cardinality_shape((real[r.parent], real[r.child]), (synthetic[r.parent], synthetic[r.child]), r.parent_key, r.child_key).select(F.lit(r.parent).alias("parent"), F.lit(r.child).alias("child"), "score") for r in relations]
    return reduce(DataFrame.unionByName, each)


def multi_table_quality(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: dict[str, TableMetadata], relations: list[Relation]) -> DataFrame:
    """property, table, metric, field, score: ``quality_report`` of each table and the parent-child relations."""
    known = without_references(metadata, relations)
    parts = [quality_report(real[t], synthetic[t], known[t]).select("property", F.lit(t).alias("table"), "metric", "field", "score") for t in real]
    if relations:
        own = relation_scores(real, synthetic, relations)
        parts.append(own.select(F.lit("Parent Child Relationships").alias("property"), F.col("child").alias("table"), F.lit("cardinality_shape").alias("metric"), F.col("parent").alias("field"), "score"))
    return reduce(DataFrame.unionByName, parts)


def multi_table_diagnostic(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: dict[str, TableMetadata], relations: list[Relation], sample: int | None = None) -> DataFrame:
    """property, score, verdict: means over tables of ``diagnostic_report``."""
    known = without_references(metadata, relations)
    each = [diagnostic_report(real[t], synthetic[t], known[t], sample).select(F.lit(t).alias("table"), "property", "score") for t in real]
    rows = reduce(DataFrame.unionByName, each).groupBy("property").agg(F.avg("score").alias("score"))
    return rows.withColumn("verdict", _verdict())


def metric_config(fields: list[dict], comparison: str = "quantitative") -> dict:
    """Columns and kinds for scores from a codec configuration: bits, word vectors and categories are categorical, floats numerical.

    A field may name several columns. The result names the columns of each kind, ready for ``series_report``.
    """
    kinds = {}
    for f in fields:
        kind = "numerical" if f.get("type") == "float" or f.get("encoding") == "float" else "categorical"
        for c in f["columns"] if "columns" in f else [f["column"]]:
            kinds[c] = kind
    return {"comparison": comparison, "kinds": kinds, "attribute": [c for c, k in kinds.items() if k == "categorical"], "feature": [c for c, k in kinds.items() if k == "numerical"]}


def flattened_scores(nested: dict, prefix: str = "") -> dict[str, float]:
    """A nested dictionary of scores as field to value; tuples and lists give their first part."""
    out = {}
    for k, v in nested.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flattened_scores(v, f"{name}.")
        else:
            out[name] = v[0] if isinstance(v, list | tuple) else v
    return out
