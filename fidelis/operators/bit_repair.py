"""Repairs generated header bits (arrays of -1, 0, 1 per field) so that they form legal packets.

Rows: ``flow``, ``idx`` (order in the flow), ``forward`` (direction) and bit arrays by field name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import bits_to_int, int_to_bits, let


def fill_missing_bits(bits: Column, seed: int) -> Column:
    """-1 becomes a random bit: those of a seeded hash of the place and the row's bits."""
    return let(_drawing_key(bits), lambda key: F.transform(bits, lambda b, i: F.when(b == -1, _drawn(seed, i, key)).otherwise(b.cast("int"))))


def _drawing_key(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda x: x.cast("string")), "")


def _drawn(seed: int, i: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), i, key), F.lit(2)).cast("int")


def constant_bits(width: int, value: int) -> Column:
    return F.array(*[F.lit((value >> k) & 1) for k in range(width - 1, -1, -1)])


def missing_bits(width: int) -> Column:
    return F.array_repeat(F.lit(-1), width)


def dominant_protocol(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """flow, protocol: the one whose bits are present most often. ``fields`` maps protocols to a bit array."""
    share = lambda c: F.avg(F.size(F.filter(c, lambda b: b >= 0)) / F.greatest(F.size(c), F.lit(1)))
    row = rows.groupBy("flow").agg(*[share(c).alias(p) for p, c in fields.items()])
    best = F.greatest(*fields) if len(fields) > 1 else F.col(next(iter(fields)))
    pick = F.lit(None).cast("string")
    for p in reversed(list(fields)):
        pick = F.when(F.col(p) == best, F.lit(p)).otherwise(pick)
    return row.select("flow", pick.alias("protocol"))


def header_words(*fields: str) -> Column:
    """32-bit words of a header: its present bits, rounded up."""
    return F.ceil(sum((F.size(F.filter(F.col(f), lambda b: b >= 0)) for f in fields), F.lit(0)) / 32)


def clamp_length(bits: str, low: Column | int, high: int = 1500, width: int = 16) -> Column:
    """A length field clamped to legal values."""
    low = F.lit(low) if isinstance(low, int) else low
    return int_to_bits(F.least(F.greatest(bits_to_int(F.col(bits)), low), F.lit(high)), width)


def version_and_flags(rows: DataFrame) -> DataFrame:
    """Version 4, do-not-fragment set, no fragment offset, options missing, a time to live of 1 where it was 0."""
    ttl = F.when(bits_to_int(F.col("ttl")) == 0, constant_bits(8, 1)).otherwise(F.transform("ttl", lambda b: b.cast("int")))
    return rows.withColumns({"version": constant_bits(4, 4), "rbit": constant_bits(1, 0), "dfbit": constant_bits(1, 1), "mfbit": constant_bits(1, 0), "frag_offset": constant_bits(13, 0), "ttl": ttl})


def directed(rows: DataFrame, forward: Column, backward: Column) -> Column:
    return F.when(F.col("forward"), forward).otherwise(backward)


def transition_matrix(rows: DataFrame, state: str = "src_ip") -> DataFrame:
    """from, to, p: how often a packet's sender follows another one in a flow."""
    pairs = rows.withColumn("prev", F.lag(state).over(Window.partitionBy("flow").orderBy("idx"))).where("prev is not null")
    counts = pairs.groupBy(F.col("prev").alias("from"), F.col(state).alias("to")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.groupBy("from").agg(F.sum("n").alias("t")), "from").select("from", "to", (F.col("n") / F.col("t")).alias("p"))


def sample_directions(flows: DataFrame, stay_forward: float, stay_backward: float, length: int, seed: int) -> DataFrame:
    """flow, idx, forward: a two-state walk of ``length`` steps per flow, drawn by a fold over seeded hashes."""
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), "flow", i), F.lit(1_000_003)) / 1_000_003.0
    step = lambda s, i: F.concat(s, F.array(F.when(F.element_at(s, -1), u(i) < stay_forward).otherwise(u(i) >= stay_backward)))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(length - 1)), F.array(F.lit(True)), step) if length > 1 else F.array(F.lit(True))
    return flows.select("flow", F.posexplode(walk).alias("idx", "forward"))


def ip_ids(rows: DataFrame) -> DataFrame:
    """ip_id counts up by one for each packet of the same direction from the first one's value."""
    own = Window.partitionBy("flow", "forward").orderBy("idx")
    start = F.first(bits_to_int(F.col("ip_id"))).over(own)
    return rows.withColumn("ip_id", int_to_bits((start + F.row_number().over(own) - 1).bitwiseAND(65535), 16))


def sequence_numbers(rows: DataFrame) -> DataFrame:
    """seq grows by the bytes that the same direction sent before; ack is the other direction's next number, 0 before any."""
    own = Window.partitionBy("flow", "forward").orderBy("idx")
    before = F.coalesce(F.sum("segment").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mask = 4294967295
    out = rows.withColumn("seq", (F.first("seq").over(own) + before).bitwiseAND(mask))
    flow = Window.partitionBy("flow").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    next_of = lambda side: F.last(F.when(F.col("forward") == side, (F.col("seq") + F.col("segment")).bitwiseAND(mask)), ignorenulls=True).over(flow)
    return out.withColumn("ack", F.coalesce(F.when(F.col("forward"), next_of(False)).otherwise(next_of(True)), F.lit(0)))


def handshake_flags(rows: DataFrame) -> DataFrame:
    """syn, ackf: SYN up to the first reply, SYN and ACK on that reply, ACK from then on; psh, rst, fin are 0."""
    reply = F.min(F.when(~F.col("forward"), F.col("idx"))).over(Window.partitionBy("flow"))
    return rows.withColumn("_r", reply).withColumns({
        "syn": F.when(F.col("_r").isNull() | (F.col("idx") <= F.col("_r")), 1).otherwise(0), "ackf": F.when(F.col("idx") >= F.col("_r"), 1).otherwise(0), "psh": F.lit(0), "rst": F.lit(0), "fin": F.lit(0),
    }).drop("_r")


#: TCP options by their bits: kind and length bytes (fixed values). 8 bits are an end or a no-op, 0 bits a gap.
TCP_OPTIONS = {32: (2, 4), 24: (3, 3), 16: (4, 2), 40: (5, 10), 80: (8, 10)}
#: Candidates in the order in which the first of equally near ones is taken, and the bits of all options (fixed values).
OPTION_SIZES, OPTION_BITS = (0, 8, 32, 24, 16, 40, 80), 320


def tcp_options(bits: Column, seed: int) -> Column:
    """Snaps the 320 option bits of a header to legal options, from left to right.

    At each place the run of present bits up to the next missing one is compared with the sizes that
    are left, and the nearest one is written there: kind and length, then the old bits, missing ones
    filled at random. Each option is used once; only gaps and no-ops repeat. A first bit of 0 in an
    option of 8 bits ends the options (in the first place it is taken for a gap instead, and no
    option of 8 bits follows). The fold runs in the JVM; null stays null.
    """
    mark = F.array_join(F.transform(bits, lambda b: F.when(b == -1, "-").when(b == 1, "1").otherwise("0")), "")
    state = lambda at, left, out: F.struct(at.cast("int").alias("at"), left.alias("left"), out.alias("out"))
    #: What is written in a place, by code: a gap, a no-op, an end, or an option by its size. A 2 stands for the old bit there.
    NOP, END, OLD = 1, 2, 2
    binary = lambda *numbers: [int(b) for x in numbers for b in f"{x:08b}"]
    pieces = {0: [-1] * 8, NOP: binary(1), END: binary(0)} | {n: binary(*pair) + [OLD] * (n - 16) for n, pair in TCP_OPTIONS.items()}

    def step(s: Column, text: Column) -> Column:
        to_gap = F.call_function("locate", F.lit("-"), text, s["at"] + 1)
        run = let(to_gap, lambda g: F.when(g == 0, OPTION_BITS - s["at"]).otherwise(g - 1 - s["at"]))
        # The nearest size, the first of several: distance and place in one number.
        place = let(run, lambda n: F.array_min(F.transform(s["left"], lambda x, i: F.abs(x - n) * len(OPTION_SIZES) + i)) % len(OPTION_SIZES))
        near = F.get(s["left"], place)
        return F.when(s["at"] >= OPTION_BITS, s).otherwise(let(near, lambda x: write(s, x, F.substring(text, s["at"] + 1, F.lit(1)))))

    def write(s: Column, near: Column, first: Column) -> Column:
        at, left = s["at"], s["left"]
        end = (near == 8) & (first == "0")
        code = F.when(near == 8, F.when(first == "1", NOP).when(at == 0, 0).otherwise(END)).otherwise(near)
        stop = F.when(end & (at > 0), F.lit(OPTION_BITS)).otherwise(at + F.greatest(near, F.lit(8)))
        kept = F.when((near == 0) | ((near == 8) & (first == "1")), left).otherwise(F.filter(left, lambda x: x != near))
        return state(stop, kept, F.concat(s["out"], F.array(code)))

    begin = state(F.lit(0), F.array(*map(F.lit, OPTION_SIZES)), F.array().cast("array<int>"))
    text = F.rpad(mark, OPTION_BITS, "-")
    codes = let(text, lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(OPTION_BITS // 8)), begin, lambda s, _: step(s, t), lambda s: s["out"]))
    known = F.create_map(*[x for code, piece in pieces.items() for x in (F.lit(code), F.array(*map(F.lit, piece)))])
    template = F.slice(F.concat(F.flatten(F.transform(codes, lambda c: known[c])), missing_bits(OPTION_BITS)), 1, OPTION_BITS)
    filled = lambda b, i, key: F.when(F.coalesce(b, F.lit(-1)) == -1, F.when(b == -1, _drawn(seed, i, key)).otherwise(-1)).otherwise(b.cast("int"))
    row = F.struct(bits.alias("old"), _drawing_key(bits).alias("key"))
    snapped = let(row, lambda r: F.transform(template, lambda t, i: F.when(t == OLD, filled(F.get(r["old"], i), i, r["key"])).otherwise(t)))
    return F.when(bits.isNotNull(), snapped)


def address_shares(rows: DataFrame, column: str = "src_ip") -> DataFrame:
    """address, share of the rows that have it, nulls left out."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("address")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("address", (F.col("n") / F.col("t")).alias("share"))  # one row


def flow_ports(rows: DataFrame, seed: int) -> DataFrame:
    """src_port, dst_port: two numbers drawn for each flow by a seeded hash, swapped in packets of the other direction."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "flow"), F.lit(65536)).cast("int")
    return rows.withColumns({"src_port": directed(rows, draw(0), draw(1)), "dst_port": directed(rows, draw(1), draw(0))})


def repair(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The fixed order of repairs for a TCP flow of bit rows with fields version .. ttl, ip_id and total length ``tl``."""
    out = version_and_flags(rows)
    for k, c in enumerate([c for c in ("ip_id", "tl", "ttl") if c in rows.columns]):
        out = out.withColumn(c, fill_missing_bits(F.col(c), seed + k))
    return ip_ids(out).withColumn("tl", clamp_length("tl", 40)) if "tl" in rows.columns else ip_ids(out)
