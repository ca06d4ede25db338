"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source has an integer share of a round, and its documents, in a seeded order, form blocks.
In a round of L slots, block k of a source with share c is released at floor(k L / c) and due at
ceil((k + 1) L / c); every slot goes to the released block with the earliest deadline. Such windows
are always feasible on one slot a time, so at any slot each source is less than one block from its
target. Rounds repeat the same schedule as long as all sources last; when one runs out, later
rounds share its slots among the others in proportion. As each source gives round v exactly
clamp(n - v c, 0, c) blocks, the rounds fall into few kinds (two more for each number of blocks that
sources have, at most), each scheduled once, and every block finds its slot by arithmetic.

Ties in the deadline go by the sources' keys. Sources without a share of their own that lie between
the same two named ones and give as many blocks form a class, whose blocks k share their window and
so follow each other by key (classes of the same place go by their numbers of blocks). A fold over
classes gives runs of slots, so it grows with the named shares and not with the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_SOURCES, MAX_ROUND = 200, 4096


def shares_of(weights: dict[str, float], slots: int = 1000) -> dict[str, int]:
    """Integer shares of a round of about ``slots`` slots from positive weights, one at least each."""
    total = sum(weights.values())
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    return {k: max(1, round(slots * w / total)) for k, w in weights.items()}


#: One step of earliest deadline first: the class that is next takes slots until its blocks or the time to the next release end.
_STEP = """(acc, _) -> transform(array(named_struct(
  'next', array_min(transform(e, (x, n) ->
    if(acc.given[n].k < x.c and (acc.given[n].k * slots) div x.c <= acc.t, named_struct('due', ((acc.given[n].k + 1) * slots + x.c - 1) div x.c, 'n', n), null))),
  'until', array_min(transform(e, (x, n) -> if(acc.given[n].k < x.c and (acc.given[n].k * slots) div x.c > acc.t, (acc.given[n].k * slots) div x.c, null))))),
 s -> if(s.next is null, acc, transform(array(least(e[s.next.n].m - acc.given[s.next.n].i, coalesce(s.until, slots) - acc.t)),
  took -> named_struct(
   't', acc.t + took,
   'given', transform(acc.given, (g, n) -> if(n <> s.next.n, g, if(g.i + took = e[n].m, named_struct('k', g.k + 1, 'i', 0L), named_struct('k', g.k, 'i', g.i + took)))),
   'out', concat(acc.out, array(named_struct('place', e[s.next.n].place, 'c', e[s.next.n].c, 'k', acc.given[s.next.n].k, 'first', acc.given[s.next.n].i, 'took', took, 't', acc.t)))))[0]))[0]"""

_NO_RUNS = "cast(array() as array<struct<place: bigint, c: bigint, k: bigint, first: bigint, took: bigint, t: bigint>>)"

#: Runs of slots of one round of ``slots`` slots: ``e`` are its classes (place, c, m: m sources with c blocks each), ``steps`` at least
#: the square root of the steps, which two folds share so that few long arrays are copied.
SCHEDULE = f"""
aggregate(sequence(1L, steps), named_struct('t', 0L, 'given', transform(e, x -> named_struct('k', 0L, 'i', 0L)), 'out', {_NO_RUNS}),
  (all, _) -> transform(array(aggregate(sequence(1L, steps), named_struct('t', all.t, 'given', all.given, 'out', {_NO_RUNS}), {_STEP})),
    part -> named_struct('t', part.t, 'given', part.given, 'out', concat(all.out, part.out)))[0],
  all -> all.out)
"""


def block_slots(sources: DataFrame) -> DataFrame:
    """key, j, slot, full of every block from the written table (key, place, share, blocks, part) of any number of sources.

    Only the kinds of rounds meet in one task and reach all of them: with B blocks there are sqrt(8 B) + 1 at most,
    as so many sources of different lengths have more blocks.
    """
    ends = sources.select(F.explode(F.expr("array(0L, blocks div share, (blocks + share - 1) div share)")).alias("v")).distinct()
    kinds = ends.select(F.col("v").alias("v_from"), F.lead("v").over(Window.orderBy("v")).alias("v_to")).where("v_to is not null")
    gives = sources.join(F.broadcast(kinds), F.expr("v_from * share < blocks")).withColumn("c", F.expr("least(share, blocks - v_from * share)"))

    # Members of a class are numbered in ranges of the key behind the counts of those before.
    kind = ["v_from", "place", "c"]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = gives.groupBy(*kind, "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(before(Window.partitionBy(*kind).orderBy("part"))), F.lit(0))
    cells = cells.select(*kind, "part", "n", earlier.alias("before"))
    classes = cells.groupBy(*kind).agg(F.sum("n").alias("m"))
    rounds = classes.groupBy("v_from").agg(F.sort_array(F.collect_list(F.struct("place", "c", "m"))).alias("e"), F.sum(F.expr("c * m")).alias("slots"), F.sum("c").alias("batches"))
    rounds = rounds.join(F.broadcast(kinds), "v_from").withColumn("steps", F.ceil(F.sqrt(2 * F.col("batches"))))
    rounds = rounds.withColumn("base", F.coalesce(F.sum(F.expr("slots * (v_to - v_from)")).over(before(Window.orderBy("v_from"))), F.lit(0)))
    runs = rounds.repartition("v_from").select("v_from", "v_to", "slots", "base", F.expr(f"inline({SCHEDULE})"))

    met = runs.join(cells, kind).where("before < first + took and first < before + n")
    own = F.row_number().over(Window.partitionBy(*kind, "part").orderBy("key")) - 1
    members = gives.drop("v_to").withColumn("own", own)
    at = members.join(met, [*kind, "part"]).withColumn("i", F.expr("before + own - first")).where("i >= 0 and i < took")
    # A source with very many rounds is cut, so that its blocks are made by many tasks.
    at = at.select("key", "share", "k", "v_from", "v_to", "slots", (F.col("base") + F.col("t") + F.col("i")).alias("at"), F.explode(F.expr("sequence(v_from, v_to - 1, 4096L)")).alias("v0"))
    at = at.repartition("key", "k", "v0").select("*", F.explode(F.expr("sequence(v0, least(v0 + 4096, v_to) - 1)")).alias("v"))
    whole = F.broadcast(sources.agg(F.min(F.expr("blocks div share")).alias("whole")))  # one row
    return at.join(whole).select("key", F.expr("v * share + k").alias("j"), F.expr("at + (v - v_from) * slots").alias("slot"), F.expr("v < whole").alias("full"))


def mix(docs: DataFrame, shares: dict[str, int], default: int = 1, block: int = 32, seed: str = "mix", hex_digits: int = 3, many: bool = False) -> DataFrame:
    """All rows of ``docs``, each once, with their places in the mixed sequence.

    Added columns (they replace columns of these names): mix_block (number of the row's block in its
    source), mix_slot (slot of that block), mix_position (slot times ``block`` plus the place in the
    block; ordering by it gives the mixed sequence), mix_on_target (in a round in which all sources
    still give their whole shares).

    ``shares`` gives integer shares of a round by source, ``default`` those of other sources. A null
    source is a source of its own. Within a source the order is that of md5(seed:doc_id), then
    doc_id; rows with the same doc_id, null ones included, are next to each other in any order.
    Sources need not divide into whole blocks; their last block may be short. An empty table gives
    no rows. More than 200 sources, or rounds of over 4096 slots, are an error unless ``many``, which
    changes nothing else: the schedule is the same for any number. No table of sources is gathered or
    broadcast; the time of a round's fold grows with the named shares' sum times their number.

    No source's rows meet in one task: they are numbered in 16 ** ``hex_digits`` ranges of the md5,
    whose counts are summed separately.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.col("row.doc_id").cast("string")))
    rows = own.select("row", F.coalesce(F.concat(F.lit("s"), F.col("row.source")), F.lit("null")).alias("key"), hashed.alias("h"))
    rows = rows.withColumn("range", F.substring("h", 1, hex_digits))
    ranges = rows.groupBy("key", "range").count()
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    named = F.create_map(*[x for k, v in shares.items() for x in (F.lit(f"s{k}"), F.lit(int(v)).cast("bigint"))]) if shares else None
    share: Column = F.coalesce(named[F.col("key")], F.lit(default).cast("bigint")) if shares else F.lit(default).cast("bigint")
    # Places in the order of keys: odd ones of named sources, even ones of what lies between them.
    names = sorted((f"s{k}" for k in shares), key=str.encode)
    smaller = F.size(F.filter(F.array(*map(F.lit, names)), lambda x: x < F.col("key"))) if names else F.lit(0)
    place = (2 * smaller + (F.col("key").isin(names).cast("int") if names else 0)).cast("bigint")
    counts = ranges.groupBy("key").agg(F.sum("count").alias("n")).select("key", place.alias("place"), share.alias("share"), F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))
    sources = written(counts.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "mixing-sources")
    if not many:
        size = sources.agg(F.count(F.lit(1)).alias("sources"), F.sum("share").alias("slots")).first()
        if size["sources"] > MAX_SOURCES or (size["slots"] or 0) > MAX_ROUND:
            raise ValueError(f"mixing takes {MAX_SOURCES} sources and {MAX_ROUND} slots a round at most")
    # Each range has the slots of its blocks in one array (a count / ``block`` of entries), so that whole rows move once, to their ranges.
    ends = ranges.select("key", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.col("count").alias("n"))
    cells = ends.select("key", "range", "before", F.explode(F.expr(f"sequence(before div {block}, (before + n - 1) div {block})")).alias("j"))
    cells = cells.join(block_slots(sources), ["key", "j"]).groupBy("key", "range").agg(F.min("before").alias("before"), F.sort_array(F.collect_list(F.struct("j", "slot", "full"))).alias("slots"))
    in_range = Window.partitionBy("key", "range").orderBy("h", "row.doc_id")
    placed = rows.withColumn("i", F.row_number().over(in_range)).join(cells, ["key", "range"]).withColumn("i", F.col("i") - 1 + F.col("before"))
    placed = placed.withColumn("j", F.expr(f"i div {block}"))
    own = F.get("slots", (F.col("j") - F.expr(f"before div {block}")).cast("int"))
    slot = own["slot"]
    added = {"mix_block": F.col("j"), "mix_slot": slot, "mix_position": slot * block + F.col("i") % block, "mix_on_target": own["full"]}
    return placed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
