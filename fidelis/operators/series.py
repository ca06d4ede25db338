"""Scores and reports of flow tables as time series, and bundles of distances for whole captures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distances as D
from . import flows as FL
from . import sets as S
from .quality import Goal
from .tagged import REAL, tagged


def distribution_similarity(both: DataFrame, columns: list[str], kinds: dict[str, str]) -> DataFrame:
    """field, score: Jensen-Shannon distance of categorical columns (their joint one for several), Wasserstein distance of a numerical one.

    Categorical and numerical columns together are an error, as they have no common distance.
    """
    found = {kinds[c] for c in columns}
    if found == {"categorical"}:
        name = "|".join(columns)
        return D.jsd(both.withColumn("_joint", F.to_json(F.struct(*columns))), ["_joint"]).select(F.lit(name).alias("field"), F.col("jsd").alias("score"))
    if found == {"numerical"}:
        return D.wasserstein(both, columns).select("field", F.col("emd").alias("score"))
    raise ValueError("columns must be all categorical or all numerical")


@dataclass(frozen=True)
class SeriesMetric:
    """One line of a time-series report: a kind of score and its target columns."""

    kind: str
    target: tuple[str, ...] = ()


#: Goal and bounds of each kind of score (no upper bound: None).
KINDS = {
    "attribute": (Goal.MINIMIZE, 0.0, None), "feature": (Goal.MINIMIZE, 0.0, None), "session_length": (Goal.MINIMIZE, 0.0, None), "interarrival": (Goal.MINIMIZE, 0.0, None),
    "attribute_feature": (Goal.MINIMIZE, 0.0, None), "coverage": (Goal.MAXIMIZE, 0.0, 1.0), "range": (Goal.MAXIMIZE, 0.0, 1.0), "autocorrelation": (Goal.MINIMIZE, 0.0, None),
}


def series_report(real: DataFrame, synthetic: DataFrame, key: list[str], time: str, order: list[str], kinds: dict[str, str], metrics: list[SeriesMetric]) -> DataFrame:
    """metric, target, score, best, worst: one row for each line of ``metrics`` (bounds that don't exist are null).

    ``key`` are the columns of a flow, ``kinds`` says which columns are categorical or numerical. Scores
    of attributes count every row. An undefined score is null.
    """
    return reduce(DataFrame.unionByName, [_line(real, synthetic, key, time, order, kinds, m) for m in metrics])


def _line(real: DataFrame, synthetic: DataFrame, key: list[str], time: str, order: list[str], kinds: dict[str, str], m: SeriesMetric) -> DataFrame:
    from .columns import range_coverage

    columns = list(m.target)
    if m.kind in ("attribute", "feature"):
        found = distribution_similarity(tagged(real, synthetic, columns), columns, kinds).select("score")
    elif m.kind == "session_length":
        found = D.wasserstein(tagged(FL.lengths(real, key), FL.lengths(synthetic, key), ["length"]), ["length"]).select(F.col("emd").alias("score"))
    elif m.kind == "interarrival":
        found = D.wasserstein(tagged(FL.gaps(real, key, time, order), FL.gaps(synthetic, key, time, order), ["gap"]), ["gap"]).select(F.col("emd").alias("score"))
    elif m.kind == "attribute_feature":
        found = D.conditional_distance(tagged(real, synthetic, columns), *columns).agg(F.avg("emd").alias("score"))
    elif m.kind == "coverage":
        found = S.jaccard_coverage(tagged(real, synthetic, columns), columns).select("score")
    elif m.kind == "range":
        found = range_coverage(tagged(real, synthetic, columns), columns).select("score")
    elif m.kind == "autocorrelation":
        found = FL.autocorrelation_distance(*[FL.autocorrelation(df, key, order, columns[0]) for df in (real, synthetic)]).select("score")
    else:
        raise ValueError(f"unknown kind of score {m.kind!r}")
    goal, low, high = KINDS[m.kind]
    best, worst = (low, high) if goal is Goal.MINIMIZE else (high, low)
    of = lambda x: F.lit(x).cast("double")
    return found.select(F.lit(m.kind).alias("metric"), F.lit(",".join(columns)).alias("target"), F.col("score").cast("double").alias("score"), of(best).alias("best"), of(worst).alias("worst"))


# --- bundles of distances ---------------------------------------------------------------------


def capture_distances(real: DataFrame, synthetic: DataFrame, addresses: list[str], ports: list[str], protocol: str, numbers: list[str], since_start: str | None = None, flow: list[str] | None = None) -> DataFrame:
    """metric, value: how far two captures are apart.

    Addresses by the Jensen-Shannon divergence of their popularity ranks, ports (clamped to 16 bits) and
    the protocol by that of their shares, numbers by the Wasserstein distance; ``since_start`` is one
    counted from its side's least value. With ``flow`` the flows' sizes are compared, too.
    """
    columns = list(dict.fromkeys([*addresses, *ports, protocol, *numbers, *([since_start] if since_start else [])]))
    both = tagged(real, synthetic, columns)
    parts = [D.rank_distance(both, c).select(F.col("field").alias("metric"), F.col("jsd").alias("value")) for c in addresses]
    clamped = both.withColumns({c: F.least(F.greatest(F.col(c).cast("bigint"), F.lit(0)), F.lit(65535)) for c in ports}).withColumn(protocol, F.upper(F.trim(F.col(protocol).cast("string"))))
    parts.append(D.jsd(clamped, [*ports, protocol], squared=True).select(F.col("field").alias("metric"), F.col("jsd").alias("value")))
    numeric = [*numbers]
    if since_start:
        first = both.groupBy("side").agg(F.min(since_start).alias("_first"))  # two rows
        both = both.join(F.broadcast(first), "side").withColumn(since_start, F.col(since_start) - F.col("_first"))
        numeric.append(since_start)
    parts.append(D.wasserstein(both, numeric).select(F.col("field").alias("metric"), F.col("emd").alias("value")))
    if flow:
        sizes = tagged(*[FL.lengths(df, flow).withColumnRenamed("length", "flow_size") for df in (real, synthetic)], ["flow_size"])
        parts.append(D.wasserstein(sizes, ["flow_size"]).select(F.col("field").alias("metric"), F.col("emd").alias("value")))
    return reduce(DataFrame.unionByName, parts)


FIVE_TUPLE = ["srcip", "dstip", "srcport", "dstport", "proto"]


def netflow_distances(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """``capture_distances`` of flow records with the columns srcip .. proto, ts, td, pkt, byt."""
    return capture_distances(real, synthetic, FIVE_TUPLE[:2], FIVE_TUPLE[2:4], "proto", ["td", "pkt", "byt"], "ts")


def connection_log_distances(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """The same of connection logs with duration and the counters of both directions."""
    numbers = ["duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]
    return capture_distances(real, synthetic, FIVE_TUPLE[:2], FIVE_TUPLE[2:4], "proto", numbers, "ts")


def packet_distances(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """The same of packets with pkt_len and time, and of the sizes of their five-tuple flows."""
    return capture_distances(real, synthetic, FIVE_TUPLE[:2], FIVE_TUPLE[2:4], "proto", ["pkt_len"], "time", FIVE_TUPLE)


# --- the choice among candidates --------------------------------------------------------------


def in_time_range(candidate: DataFrame, real: DataFrame, time: str) -> DataFrame:
    """Rows of a candidate within the real data's range of time."""
    span = real.agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    return candidate.join(F.broadcast(span)).where(F.col(time).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")  # one row


def best_candidates(candidates: DataFrame, real: DataFrame, chunk: str, name: str, numbers: list[str], time: str) -> DataFrame:
    """Per chunk the rows of its best candidate, all chunks together, without rows outside the chunk's real range of time.

    Candidates are ranked by the Wasserstein distance of each number within the chunk; the smallest sum
    of ranks wins, ties by name. All chunks are compared in one pass.
    """
    span = real.groupBy(chunk).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    inside = candidates.join(span, chunk).where(F.col(time).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    names = inside.select(chunk, name).distinct()
    sides = inside.select(F.lit("synthetic").alias("side"), chunk, name, *numbers).unionByName(real.join(names, chunk).select(F.lit(REAL).alias("side"), chunk, name, *numbers))
    place = F.to_json(F.struct(F.col(chunk).alias("chunk"), F.col(name).alias("name")))
    scores = None
    for c in numbers:
        own = sides.select("side", place.alias("_place"), F.col(c).cast("double").alias("_x"))
        found = D.conditional_distance(own, "_place", "_x").select("field", F.lit(c).alias("number"), "emd")
        scores = found if scores is None else scores.unionByName(found)
    key = names.withColumn("field", F.to_json(F.struct(F.col(chunk).alias("chunk"), F.col(name).alias("name"))))
    rows = scores.join(key, "field").select(F.col(name).alias("candidate"), F.concat_ws("|", F.col(chunk).cast("string"), "number").alias("metric"), F.col("emd").alias("value"), chunk)
    ranked = rows.withColumn("_r", F.rank().over(_by("metric").orderBy("value")) + (F.count(F.lit(1)).over(_by("metric", "value")) - 1) / 2)
    best = ranked.groupBy(chunk, "candidate").agg(F.sum("_r").alias("_sum")).groupBy(chunk).agg(F.min(F.struct("_sum", "candidate")).alias("_best"))
    return inside.join(best.select(chunk, F.col("_best.candidate").alias(name)), [chunk, name], "left_semi")


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)
