"""Flows in time: features, gaps, chunks, autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flow_features(packets: DataFrame, key: list[str], time: str, order: list[str], distinct: list[str], numeric: list[str], protocol: str, protocols: list[str]) -> DataFrame:
    """One row a flow: packets, distinct values, protocol shares, mean, deviation, minimum and maximum of numbers, duration, gaps.

    Gaps follow ``order``; flows with one packet have gaps of 0 (and null deviations of numbers).
    """
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*key).orderBy(*order))
    rows = packets.withColumn("_gap", gap)
    parts: list[Column] = [F.count(F.lit(1)).alias("packet_count")]
    parts += [F.countDistinct(c).alias(f"unique_{c}") for c in distinct]
    parts += [F.avg(F.coalesce((F.col(protocol) == p).cast("double"), F.lit(0.0))).alias(f"proto_{p}") for p in protocols]
    parts += [f(c).alias(f"{c}_{name}") for c in numeric for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    parts += [(F.max(time) - F.min(time)).alias("duration"), F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("iat_mean"), F.coalesce(F.stddev_samp("_gap"), F.lit(0.0)).alias("iat_std")]
    return rows.groupBy(*key).agg(*parts)


def durations(packets: DataFrame, key: list[str], time: str) -> DataFrame:
    return packets.groupBy(*key).agg((F.max(time) - F.min(time)).alias("duration"))


def lengths(packets: DataFrame, key: list[str]) -> DataFrame:
    return packets.groupBy(*key).agg(F.count(F.lit(1)).alias("length"))


def gaps(packets: DataFrame, key: list[str], time: str, order: list[str]) -> DataFrame:
    """Differences of successive times within a flow, in the given order."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*key).orderBy(*order))
    return packets.withColumn("gap", gap).where("gap is not null")


def head_per_flow(packets: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each flow (or file), numbered by ``position`` from 1."""
    return packets.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("position") <= n)


def fixed_time_chunks(packets: DataFrame, time: str, chunks: int, slack: float = 1e-5) -> DataFrame:
    """Adds ``chunk``: equal spans of time, the last one a little longer; empty spans are left out, so numbers close up."""
    span = packets.agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    cut = packets.join(F.broadcast(span)).withColumn("_span", F.least(F.floor((F.col(time) - F.col("_low")) * chunks / F.greatest((F.col("_high") - F.col("_low")) * (1 + slack), F.lit(1e-300))), F.lit(chunks - 1)).cast("int"))
    used = cut.select("_span").distinct().withColumn("chunk", F.row_number().over(Window.orderBy("_span")) - 1)  # as many rows as chunks
    return cut.join(F.broadcast(used), "_span").drop("_span", "_low", "_high")


def global_positions(rows: DataFrame, order: str, tie: str, ranges: int = 256) -> DataFrame:
    """Adds ``position``, from 0, in the order of two columns without sorting all rows in one task.

    Approximate quantiles of ``order`` cut the rows into ranges; each is numbered on its own behind the
    counts of those before. Equal values of ``order`` stay in one range, so a third of all rows at
    one instant are cut once more by quantiles of ``tie``.
    """
    share = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx(order, share, 10000).alias("_c"))
    part = rows.join(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("_c", lambda b: b < F.col(order)))).drop("_c")  # one row of cuts
    fine = part.groupBy("_r").agg(F.percentile_approx(tie, share, 10000).alias("_t"), (F.min(order) == F.max(order)).alias("_one"))
    part = part.join(F.broadcast(fine), "_r").withColumn("_q", F.when(F.col("_one"), F.size(F.filter("_t", lambda b: b < F.col(tie)))).otherwise(0)).drop("_t", "_one")  # a row for each range
    before = Window.orderBy("_r", "_q").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy("_r", "_q").agg(F.count(F.lit(1)).alias("_n")).select("_r", "_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_r", "_q").orderBy(order, tie)
    return part.withColumn("_i", F.row_number().over(own)).join(F.broadcast(counts), ["_r", "_q"]).withColumn("position", F.col("_before") + F.col("_i") - 1).drop("_r", "_q", "_i", "_before")


def fixed_size_chunks(packets: DataFrame, time: str, tie: str, chunks: int) -> DataFrame:
    """Adds ``chunk``: ceil(rows / chunks) rows each, in order of time."""
    placed = global_positions(packets, time, tie)
    total = packets.agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunks), F.lit(1)).alias("_size"))
    return placed.join(F.broadcast(total)).withColumn("chunk", F.expr("position div _size").cast("int")).drop("position", "_size")  # one row


def near_equal_chunks(rows: DataFrame, order: str, tie: str, chunks: int) -> DataFrame:
    """Adds ``chunk``: sizes that differ by one row at most, the first ones larger, in the order of two columns."""
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n")))  # one row
    placed = global_positions(rows, order, tie).join(total).withColumn("_q", F.expr(f"_n div {chunks}")).withColumn("_rest", F.col("_n") % chunks)
    big = F.col("_rest") * (F.col("_q") + 1)
    chunk = F.when(F.col("position") < big, F.expr("position div (_q + 1)")).otherwise(F.col("_rest") + F.expr("(position - _rest * (_q + 1)) div greatest(_q, 1)"))
    return placed.withColumn("chunk", chunk.cast("int")).drop("position", "_n", "_q", "_rest")


def slices(rows: DataFrame, order: str, tie: str, size: int) -> DataFrame:
    """Adds ``chunk``: ``size`` rows each, the last one perhaps fewer."""
    return global_positions(rows, order, tie).withColumn("chunk", F.expr(f"position div {size}").cast("int")).drop("position")


def flattened_bits(rows: DataFrame, file: str, order: str, fields: list[str], n: int = 3) -> DataFrame:
    """file, bits: the bit arrays of the first ``n`` packets one after the other, without ports and addresses; missing packets are -1."""
    use = [f for f in fields if f != "src_ip" and "prt" not in f and "port" not in f]
    first = head_per_flow(rows, [file], [order], n)
    row = first.groupBy(file).agg(F.sort_array(F.collect_list(F.struct("position", F.concat(*use).alias("b")))).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda x: x["b"]))
    width = F.size(F.col("_p")[0]["b"])
    return row.select(file, F.slice(F.concat(flat, F.array_repeat(F.lit(-1), width * n)), F.lit(1), width * n).alias("bits"))


def cross_chunk_flows(chunked: DataFrame, key: list[str]) -> DataFrame:
    """Flow, its chunks in order, and whether they follow each other evenly."""
    row = chunked.groupBy(*key).agg(F.sort_array(F.collect_set("chunk")).alias("chunks"))
    steps = F.transform(F.slice("chunks", 2, F.greatest(F.size("chunks") - 1, F.lit(0))), lambda x, i: x - F.get("chunks", i))
    return row.select(*key, "chunks", F.size("chunks").alias("n_chunks"), (F.size(F.array_distinct(steps)) <= 1).alias("even"))


def propagate_flow_tags(flows: DataFrame, chunk: str, flags: str) -> DataFrame:
    """Copies a flow that starts in ``chunk`` into each later chunk that its ``flags`` array marks, without the start mark."""
    later = F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: (i > F.col(chunk)) & (F.get(flags, i) > 0))
    own = flows.withColumn("starts", F.lit(True))
    copies = flows.withColumn("_later", F.explode(later)).withColumn(chunk, F.col("_later").cast(flows.schema[chunk].dataType)).drop("_later").withColumn("starts", F.lit(False))
    return own.unionByName(copies)


def padded_series(packets: DataFrame, key: list[str], order: list[str], features: list[str], length: int | None = None) -> DataFrame:
    """Per flow, arrays of each feature's values padded with zeros to the longest flow, or cut or padded to ``length``, and ``present`` flags."""
    if length is None:
        length = packets.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    first = head_per_flow(packets, key, order, length)
    packed = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("position", *features))).alias("_s"))
    pad = lambda a: F.slice(F.concat(a, F.array_repeat(F.lit(0.0), length)), 1, length)
    return packed.select(*key, *[pad(F.transform(F.col(f"_s.{c}"), lambda x: x.cast("double"))).alias(c) for c in features], pad(F.transform("_s", lambda x: F.lit(1.0))).alias("present"))


def denormalize_series(series: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Rows of padded series again: only the steps that are present."""
    zipped = series.select(*key, F.posexplode(F.arrays_zip("present", *features)).alias("step", "x"))
    return zipped.where("x.present > 0").select(*key, "step", *[F.col(f"x.{c}").alias(c) for c in features])


def autocorrelation(packets: DataFrame, key: list[str], order: list[str], feature: str, length: int | None = None, most_lags: int | None = None) -> DataFrame:
    """lag, r: mean over flows of the Pearson correlation of a flow's zero-padded series with itself shifted by ``lag``.

    Series are padded to the longest flow, or cut or padded to ``length``. Lags 1 to length - 2,
    ``most_lags`` at most if given. An undefined or zero correlation counts 1e-8, one beyond 1 counts 0.
    """
    if length is None:
        return _whole_autocorrelation(packets, key, order, feature, most_lags)
    series = padded_series(packets, key, order, [feature], length)
    x = F.col(feature)

    lags = F.explode(F.sequence(F.lit(1), F.lit(max(1, min(length - 2, length if most_lags is None else most_lags))))).alias("lag")
    shifted = series.select(lags, x.alias("x")).select("lag", F.expr("slice(x, 1, size(x) - lag)").alias("a"), F.expr("slice(x, lag + 1, size(x) - lag)").alias("b"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
    n = F.size("a").cast("double")
    centred = shifted.select("lag", "a", "b", (total("a") / n).alias("ma"), (total("b") / n).alias("mb"))
    da, db = F.transform("a", lambda y: y - F.col("ma")), F.transform("b", lambda y: y - F.col("mb"))
    parts = centred.select("lag", da.alias("a"), db.alias("b"))
    product = lambda c, e: total(F.zip_with(c, e, lambda y, z: y * z))
    r = parts.select("lag", F.try_divide(product("a", "b"), F.sqrt(product("a", "a") * product("b", "b"))).alias("r"))
    return r.groupBy("lag").agg(F.avg(_tidy(F.col("r"))).alias("r"))


def _tidy(r: Column) -> Column:
    return F.when(r.isNull() | (r == 0), 1e-8).when(F.abs(r) > 1.0000001, 0.0).otherwise(r)


#: Values in a block of a series, and the length up to which products are summed directly.
BLOCK, DIRECT = 1 << 16, 512


def lag_products(rows: DataFrame, most_lags: int | None = None, block: int = BLOCK) -> DataFrame:
    """(flow, lag, ab): sums of x at i times x at i + lag over each flow's rows (flow, i from 1, x), for lags from 1 below its length.

    A flow is cut into blocks of ``block`` values. A block is multiplied with itself and each later one
    at all shifts at once by fast Fourier transforms, and a lag's parts are added up. So a task holds two
    blocks, a flow of one block gives one row a lag, and the blocks of a long flow meet in many tasks.
    """
    at = F.floor((F.col("i") - 1) / block)
    parts = rows.select("flow", at.alias("u"), F.struct("i", "x").alias("p")).groupBy("flow", "u").agg(F.sort_array(F.collect_list("p")).alias("p"))
    parts = parts.select("flow", "u", F.col("p.x").alias("x"))
    sizes = rows.groupBy("flow").agg(F.max(at).alias("top"))
    parts = parts.join(sizes, "flow")
    reach = F.col("top") if most_lags is None else F.least("top", F.col("u") + F.lit((most_lags - 1) // block + 1))
    back = F.lit(0) if most_lags is None else F.greatest(F.lit(0), F.col("u") - F.lit((most_lags - 1) // block + 1))
    own = parts.select("flow", "u", F.col("u").alias("v"), "x", F.lit(None).cast("array<double>").alias("y"))
    left = parts.where("u < top").select("flow", "u", F.explode(F.sequence(F.col("u") + 1, reach)).alias("v"), "x")
    right = parts.where("u > 0").select("flow", F.explode(F.sequence(back.cast("bigint"), F.col("u") - 1)).alias("u"), F.col("u").alias("v"), F.col("x").alias("y"))
    both = own.unionByName(left.join(right, ["flow", "u", "v"]))

    def products(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, lags, values = [], [], []
            for k in range(batch.num_rows):
                u, v = (batch.column(c)[k].as_py() for c in (1, 2))
                x = batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                y = x if u == v else batch.column(4)[k].values.to_numpy(zero_copy_only=False)
                shift = np.arange(1 - len(x), len(y)) + (v - u) * block
                if len(x) <= DIRECT and len(y) <= DIRECT:
                    all_ = np.correlate(y, x, "full")
                else:
                    n = 1 << (len(x) + len(y) - 1).bit_length()
                    wave = np.fft.irfft(np.conj(np.fft.rfft(x, n)) * np.fft.rfft(y, n), n)
                    all_ = np.concatenate([wave[n - len(x) + 1 :], wave[: len(y)]])
                keep = (shift > 0) if most_lags is None else (shift > 0) & (shift <= most_lags)
                keys.append(np.full(int(keep.sum()), k))
                lags.append(shift[keep])
                values.append(all_[keep])
                if sum(map(len, lags)) >= 50_000 or k == batch.num_rows - 1:
                    rows_ = pa.array(np.concatenate(keys))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_), pa.array(np.concatenate(lags), pa.int64()), pa.array(np.concatenate(values))], ["flow", "lag", "ab"])
                    keys, lags, values = [], [], []

    flow = rows.schema["flow"].dataType.simpleString()
    return both.mapInArrow(products, f"flow {flow}, lag bigint, ab double").groupBy("flow", "lag").agg(F.sum("ab").alias("ab"))


def _whole_autocorrelation(packets: DataFrame, key: list[str], order: list[str], feature: str, most_lags: int | None) -> DataFrame:
    """All packets and lags. Moments of both ends of a padded series are sums up to and from a packet; products come from ``lag_products``."""
    flow = F.struct(*key).alias("flow")
    rows = packets.select(flow, F.coalesce(F.col(feature).cast("double"), F.lit(0.0)).alias("x"), F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("i"))
    up, down = Window.partitionBy("flow").orderBy("i"), Window.partitionBy("flow").orderBy(F.desc("i"))
    sums = lambda w: F.struct(*[f.over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, f in (("one", F.sum("x")), ("two", F.sum(F.col("x") * F.col("x"))), ("low", F.min("x")), ("high", F.max("x")))])
    ends = rows.select("flow", "i", sums(up).alias("a"), sums(down).alias("b"))
    sizes = rows.groupBy("flow").agg(F.max("i").alias("n"))
    size = F.broadcast(sizes.agg(F.max("n").alias("length"), F.count(F.lit(1)).alias("flows")))  # one row
    last = F.greatest(F.col("length") - 2, F.lit(1))
    last = last if most_lags is None else F.least(last, F.lit(most_lags))
    # A flow's lags beyond its own length meet zeros only: their correlations are undefined.
    lags = lag_products(rows, most_lags).join(size).where(F.col("lag") <= last).join(sizes, "flow")
    lags = lags.withColumn("m", F.col("length") - F.col("lag"))
    lags = lags.withColumn("_end", F.least("m", "n")).join(ends.select("flow", F.col("i").alias("_end"), "a"), ["flow", "_end"])
    lags = lags.withColumn("_from", F.col("lag") + 1).join(ends.select("flow", F.col("i").alias("_from"), "b"), ["flow", "_from"])

    def varied(side: str, padded: Column) -> Column:
        zero = F.when(padded, 0.0)
        return F.least(F.col(f"{side}.low"), zero) < F.greatest(F.col(f"{side}.high"), zero)

    m, a, b = F.col("m"), F.col("a"), F.col("b")
    va, vb = m * a["two"] - a["one"] * a["one"], m * b["two"] - b["one"] * b["one"]
    defined = varied("a", m > F.col("n")) & varied("b", F.col("n") < F.col("length")) & (va > 0) & (vb > 0)
    r = F.when(defined, F.try_divide(m * F.col("ab") - a["one"] * b["one"], F.sqrt(va) * F.sqrt(vb)))
    rest = 1e-8 * (F.col("flows") - F.count(F.lit(1)))
    return lags.select("lag", "flows", _tidy(r).alias("r")).groupBy("lag", "flows").agg(((F.sum("r") + rest) / F.col("flows")).alias("r")).select("lag", "r")


def autocorrelation_distance(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """score: sum over lags of the differences over the sum of the real ones."""
    both = real.join(synthetic.withColumnRenamed("r", "s"), "lag")
    return both.agg(F.try_divide(F.sum(F.abs(F.col("r") - F.col("s"))), F.sum("r")).alias("score"))


def candidate_ranking(scores: DataFrame) -> DataFrame:
    """(candidate, metric, value) to candidate, rank_sum: ranks within each metric (ties by their mean), smallest first."""
    w = Window.partitionBy("metric")
    tied = F.count(F.lit(1)).over(Window.partitionBy("metric", "value"))
    ranked = scores.withColumn("r", F.rank().over(w.orderBy("value")) + (tied - 1) / 2)
    return ranked.groupBy("candidate").agg(F.sum("r").alias("rank_sum"))
